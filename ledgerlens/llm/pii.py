"""Personal data with offset-preserving deobfuscation.

Base patterns run on the text as it is. Texts that may hide something go through a chain of
transducers, each of which rewrites characters and keeps for every output character the
source interval it comes from: look-alike letters and full-width or mathematical forms
become ASCII and invisible characters vanish; bracketed, worded, spaced or coded "at" and
"dot" become @ and a point; spelled digits become digits. The same detectors run on the result, and what
they find is mapped back to source characters. Found spans that a base span of their
kind equals or contains add nothing; one that reaches beyond it stands beside it.

Matches that begin at one place are told apart by kind, in the order of ``KINDS``, then end.
Null text counts as empty and has no spans; repeated rows are scanned each for itself; an
empty table gives an empty table; input columns named like an added one are replaced. All
steps are linear in the length of the text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from typing import NamedTuple

from pyspark.sql import DataFrame

from ledgerlens.llm.common import annotate, sha256_hex

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that a failed try is not repeated inside the same run of
# characters; fixed values.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)

# Look-alikes of ASCII characters, as pairs of the same position; fixed values.
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХавеѕіјкморстухһԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρυ" "ıɑɡ․‧∙•﹒。‐‑‒–—−﹣＠﹫",
    "ABESIJKMHOPCTYXabesijkmopctyxhdqw" "ABEZHIKMNOPTYXoavpu" "iag......-------@@"))
INVISIBLE = frozenset("\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061"
                      "\u2062\u2063\u2064\ufeff")
# Words for digits, @ and the point; fixed values.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5",
    "fuenf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5",
    "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
}
AT_WORDS = "at|arroba|arobase"
DOT_WORDS = "dot|punkt|punto|point"

GAP = r"[^\S\n]{1,3}"
AT_BRACKET = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{AT_WORDS}|@)\s{{0,3}}[\])}}>]\s{{0,3}}",
                        re.IGNORECASE)
DOT_BRACKET = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{DOT_WORDS}|\.)\s{{0,3}}[\])}}>]\s{{0,3}}",
                         re.IGNORECASE)
LABEL = r"[A-Za-z0-9-]{1,63}+"
# an address in words: name at label dot label ...
WORDED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{{1,64}}+(?:(?:\.|{GAP}(?:{DOT_WORDS})"
                    rf"{GAP})[A-Za-z0-9_%+-]{{1,64}}+){{0,4}}(?:{GAP}(?:{AT_WORDS}){GAP}|@){LABEL}"
                    rf"(?:(?:{GAP}(?:{DOT_WORDS}){GAP}|\.){LABEL}){{1,6}}", re.IGNORECASE)
WORDED_PART = re.compile(rf"{GAP}(?:(?P<at>{AT_WORDS})|{DOT_WORDS}){GAP}", re.IGNORECASE)
NUMBER = "|".join(sorted(DIGITS, key=len, reverse=True))
SPELLED = re.compile(
    rf"\b(?:plus[\s,-]{{1,3}})?(?:{NUMBER}|[0-9])(?:(?:[\s,-]{{1,3}}|{GAP}(?:{DOT_WORDS}){GAP}"
    rf"|\.)(?:{NUMBER}|[0-9])){{5,}}\b", re.IGNORECASE)
# four numbers with worded or plain points between, each of one to three digits or digit words
OCTET = rf"(?:[0-9]{{1,3}}|(?:{NUMBER})(?:[\s-]{{1,3}}(?:{NUMBER})){{0,2}})"
WORDED_IP = re.compile(rf"\b{OCTET}(?:(?:{GAP}(?:{DOT_WORDS}){GAP}|\.){OCTET}){{3}}\b", re.IGNORECASE)
# @ with blanks around it, character references, percent encoding
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9_%+-])(?:[^\S\n]{1,3}@[^\S\n]{0,3}|@[^\S\n]{1,3})"
                       r"(?=[A-Za-z0-9-]+\.[A-Za-z])")
CODED_AT = re.compile(r"&#0{0,5}64;|&#x0{0,5}40;|&commat;|(?<=[A-Za-z0-9_+-])%40(?=[A-Za-z0-9])",
                      re.IGNORECASE)
CODED_DOT = re.compile(r"&#0{0,5}46;|&#x0{0,5}2e;|&period;|(?<=[A-Za-z0-9_+-])%2e(?=[A-Za-z0-9])",
                       re.IGNORECASE)
SPELLED_PART = re.compile(rf"({NUMBER}|[0-9])|(plus)|({DOT_WORDS}|\.)|[\s,-]+", re.IGNORECASE)

# What a text must hold for one of the patterns above to change it
BRACKETED = re.compile(rf"[\[({{<]\s{{0,3}}(?:{AT_WORDS}|{DOT_WORDS}|@|\.)\s{{0,3}}[\])}}>]",
                       re.IGNORECASE)
AT_WORD = re.compile(rf"\s(?:{AT_WORDS})\s", re.IGNORECASE)
DOT_WORD = re.compile(rf"\s(?:{DOT_WORDS})\s", re.IGNORECASE)
INNER_POINT = re.compile(r"\.\w")
TOKEN = re.compile(r"\w+")
SPOKEN = frozenset(DIGITS) | frozenset("0123456789")

ADDED = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
         "spans string, found array<struct<kind:string,start:long,end:long>>")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses, found from their @: all tries within one run of name characters end alike."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        segment = text[free:at]
        start = free + len(segment.rstrip(LOCAL))
        free = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", free)
    return out


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns."""
    spans = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    digits = text.encode("utf-8", "surrogatepass").translate(None, NOT_DIGIT)
    if len(digits) >= 4 and "." in text:
        spans += [(1, m.start(), m.end()) for m in IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
                         for p in m.group().split("."))]
    if len(digits) >= 13:
        for m in CARD.finditer(text):
            number = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(number) <= 19 and luhn(number):
                spans.append((2, m.start(), m.end()))
    if len(digits) >= 9 and "+" in text:
        spans += [(3, m.start(), m.end()) for m in PHONE.finditer(text)
                  if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return spans


class Tape(NamedTuple):
    """Characters, and where the source interval of each begins and ends."""

    text: str
    begin: list[int]
    end: list[int]

    def rewrite(self, parts: list[tuple[int, int, str]]) -> Tape:
        """Intervals replaced; every new character stands for the whole interval."""
        out, begin, end, at = [], [], [], 0
        for start, stop, new in parts:
            out += [self.text[at:start], new]
            begin += self.begin[at:start] + [self.begin[start]] * len(new)
            end += self.end[at:start] + [self.end[stop - 1]] * len(new)
            at = stop
        out.append(self.text[at:])
        return Tape("".join(out), begin + self.begin[at:], end + self.end[at:])


@cache
def folded(char: str) -> str:
    """ASCII form of one character, empty for invisible ones, itself if it has none."""
    if char in INVISIBLE:
        return ""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    plain = unicodedata.normalize("NFKC", char)
    return plain if plain.isascii() and len(plain) == 1 else char


def fold_characters(tape: Tape) -> Tape:
    """Look-alikes and compatibility forms to ASCII; invisible characters vanish."""
    parts = [(i, i + 1, folded(c)) for i, c in enumerate(tape.text)
             if c > "\x7f" and folded(c) != c]
    return tape.rewrite(parts) if parts else tape


def fold_marks(tape: Tape) -> Tape:
    """Coded, bracketed, spaced and worded "at" and "dot" to @ and point."""
    for pattern, mark in ((CODED_AT, "@"), (CODED_DOT, ".")):
        tape = tape.rewrite([(m.start(), m.end(), mark) for m in pattern.finditer(tape.text)])
    tape = tape.rewrite([(m.start(), m.end(), "@") for m in AT_BRACKET.finditer(tape.text)])
    tape = tape.rewrite([(m.start(), m.end(), ".") for m in DOT_BRACKET.finditer(tape.text)])
    tape = tape.rewrite([(m.start(), m.end(), "@") for m in SPACED_AT.finditer(tape.text)])
    parts = [(p.start(), p.end(), "@" if p.group("at") else ".")
             for m in WORDED.finditer(tape.text)
             for p in WORDED_PART.finditer(tape.text, m.start(), m.end())]
    return tape.rewrite(parts) if parts else tape


def fold_digits(tape: Tape) -> Tape:
    """Runs of six or more spelled digits, and four numbers with worded points, to digits;
    points between them are kept."""
    for pattern in (WORDED_IP, SPELLED):
        parts = []
        for m in pattern.finditer(tape.text):
            for p in SPELLED_PART.finditer(tape.text, m.start(), m.end()):
                digit, plus, point = p.groups()
                new = DIGITS.get(digit.lower(), digit) if digit else "+" if plus else "." * bool(point)
                parts.append((p.start(), p.end(), new))
        tape = tape.rewrite(parts) if parts else tape
    return tape


def may_hide(text: str) -> bool:
    """Whether any transducer may change the text; never false where one does."""
    if not text.isascii() and any(c > "\x7f" and (folded(c) != c or c == "\u0130")
                                  for c in set(text)):      # U+0130 counts as an i in patterns
        return True
    if BRACKETED.search(text):
        return True
    if AT_WORD.search(text) or "@" in text and DOT_WORD.search(text):
        if any(WORDED_PART.search(m.group()) for m in WORDED.finditer(text)):
            return True
    if "@" in text and SPACED_AT.search(text):
        return True
    if ("&" in text or "%" in text) and (CODED_AT.search(text) or CODED_DOT.search(text)):
        return True
    if (DOT_WORD.search(text) or INNER_POINT.search(text)) and WORDED_IP.search(text):
        return True
    # SPELLED holds six of these; ordinary words among them seldom stand in a row
    return (sum(map(SPOKEN.__contains__, TOKEN.findall(text.lower()))) >= 6
            and SPELLED.search(text) is not None)


def hidden(text: str) -> list[tuple[int, int, int]]:
    """What the detectors find after deobfuscation, in source positions."""
    tape = Tape(text, list(range(len(text))), list(range(1, len(text) + 1)))
    for transduce in (fold_characters, fold_marks, fold_digits):
        tape = transduce(tape)
    if tape.text == text:
        return []
    return [(k, tape.begin[s], tape.end[e - 1]) for k, s, e in detect(tape.text)]


def scan(text: str) -> tuple:
    base = sorted(detect(text))
    spans = list(base)
    if may_hide(text):
        taken = {k: [(s, e) for kind, s, e in base if kind == k] for k in range(4)}
        at = [0] * 4
        for k, s, e in sorted(hidden(text)):
            own = taken[k]
            while at[k] < len(own) and own[at[k]][0] <= s:
                at[k] += 1
            # base spans of a kind are apart: only the last to begin before can hold this one
            if not at[k] or own[at[k] - 1][1] < e:
                spans.append((k, s, e))
        spans.sort()
    counts = [sum(k == kind for k, _, _ in base) for kind in range(4)]
    of_base = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base)
    return (*counts, sha256_hex(of_base), ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans),
            [(KINDS[k], s, e) for k, s, e in spans])


def scan_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with base counts by kind, a digest of the base spans, and all spans."""
    return annotate(df, text, ADDED, lambda: lambda texts: [scan(t) for t in texts])
