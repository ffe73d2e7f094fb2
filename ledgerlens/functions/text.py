"""Text clean-up and keys as column expressions.

Java's ``\\s`` and Python's idea of white space differ, so every pattern here
names the white-space characters itself.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters treated as white space.
# Latin-1 characters are listed singly and the rest sits behind one range test, so a
# letter costs two comparisons.
_FAR_SPACE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
SPACE = r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0" + _FAR_SPACE + "]"
SPACE_NOT_LF = SPACE.replace(r"\n", "")
SPACE_CHARACTERS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
# The characters that end a line (carriage returns are folded before).
LINE_END = r"[\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_space(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE_CHARACTERS))


def strip_chars(c: Column, chars: str) -> Column:
    """Remove any of ``chars`` from both ends."""
    return F.trim(c, F.lit(chars))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n|\r", "\n")


def normalise_page_text(c: Column) -> Column:
    """Single blanks inside lines, no empty lines, no outer blanks; null gives ''."""
    text = unix_lines(F.coalesce(c, F.lit("")))
    # runs first: afterwards a line end has one blank before it at most, so time is linear
    text = F.regexp_replace(text, f"{SPACE_NOT_LF}+", " ")
    text = F.regexp_replace(text, " ?\n[ \n]*", "\n")
    return F.trim(text, F.lit(" \n"))


def clean_document_text(c: Column) -> Column:
    """No-break blanks to blanks, line ends to LF, ends trimmed."""
    return strip_space(unix_lines(F.replace(c, F.lit("\u00a0"), F.lit(" "))))


def word_count(c: Column) -> Column:
    tidy = collapse(F.coalesce(c, F.lit("")))
    return F.when(tidy == "", 0).otherwise(F.size(F.split(tidy, " "))).cast("int")


def character_count(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit("")))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def identifier_key(c: Column) -> Column:
    """Upper case, letters A-Z and digits only; null when nothing is left."""
    return blank_to_null(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""))


def _ascii_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def fold_text(value: str | None) -> str | None:
    """The full Unicode rule behind :func:`text_key`, for one non-ASCII value."""
    if value is None:
        return None
    bare = "".join(ch for ch in unicodedata.normalize("NFKD", value)
                   if not unicodedata.combining(ch))
    return " ".join(re.findall("[a-z0-9]+", bare.casefold()))


@F.pandas_udf(StringType())
def _fold_unicode(values: pd.Series) -> pd.Series:
    return values.map(fold_text, na_action="ignore")


def is_ascii(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7f]")


def text_key(c: Column) -> Column:
    """Accent- and case-free comparison key, null when empty.

    ASCII values stay in the JVM. Only values outside ASCII reach Python, where
    the Unicode decomposition lives.
    """
    plain = F.when(is_ascii(c), _ascii_key(c))
    return blank_to_null(F.coalesce(plain, _fold_unicode(F.when(~is_ascii(c), c))))


@functools.cache
def _folding() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case characters that full case folding changes: to one, and to several."""
    other = {ch: ch.casefold() for ch in map(chr, range(0x80, 0x1e944))
             if not 0xd800 <= ord(ch) < 0xe000 and ch.lower() == ch != ch.casefold()}
    return ({k: v for k, v in other.items() if len(v) == 1},
            {k: v for k, v in other.items() if len(v) > 1})


def fold_case(c: Column) -> Column:
    """Full Unicode case folding: lower case, and what folding changes after that.

    Text with characters that become several is put together anew from a literal map.
    """
    single, several = _folding()
    simple = F.translate(F.lower(c), "".join(single), "".join(single.values()))
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    full = F.array_join(F.transform(
        F.split(simple, ""), lambda ch: F.coalesce(table[ch], ch)), "")
    folded = F.when(simple.rlike(f"[{''.join(several)}]"), full).otherwise(simple)
    return F.when(is_ascii(c), F.lower(c)).otherwise(folded)


def casefold_ascii_words(c: Column) -> Column:
    """Case folded, every run outside a-z and 0-9 becomes a blank."""
    return F.trim(F.regexp_replace(fold_case(c), "[^a-z0-9]+", " "))


def contains_phrase(padded_source: Column, phrases: list[str]) -> Column:
    """Whole-phrase test on normalised text."""
    padded = F.concat(F.lit(" "), padded_source, F.lit(" "))
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | padded.contains(f" {phrase} ")
    return hit


def bounded_error(message: Column, kind: Column, limit: int = 4000) -> Column:
    """Error text, the error's class name when blank, cut to ``limit``."""
    return F.substring(F.coalesce(blank_to_null(strip_space(message)), kind), 1, limit)


def full_name(first: Column, last: Column) -> Column:
    """First and last name joined by a blank, blank parts left out."""
    return blank_to_null(F.concat_ws(
        " ", blank_to_null(strip_space(first)), blank_to_null(strip_space(last))))
