"""Dates, money and status spellings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import (
    blank_to_null, casefold_ascii_words, collapse, strip_chars, strip_space)

MONEY = "decimal(38,2)"

# Month names accepted in a written date.
MONTH = ("January|February|March|April|May|June|July|August|September|October|November|December|"
         "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec")
# Where a date is looked for inside a value, in this order.
DATE_TOKENS = [
    r"(?U)\b\d{4}-\d{1,2}-\d{1,2}\b",
    r"(?U)\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b",
    rf"(?iU)\b(?:{MONTH})\s+\d{{1,2}},?\s+\d{{4}}\b",
    rf"(?iU)\b\d{{1,2}}\s+(?:{MONTH})\s+\d{{4}}\b",
]
# Spellings of a policy status, in matching order for documents.
DOCUMENT_STATUS = {
    "active": "active",
    "in force": "active",
    "in-force": "active",
    "issued": "active",
    "cancelled": "cancelled",
    "canceled": "cancelled",
    "terminated": "cancelled",
    "inactive": "cancelled",
    "pending": "pending",
    "pending issue": "pending",
    "not issued": "not_issued",
    "declined": "not_issued",
    "lapsed": "lapsed",
    "pending lapse": "pending_lapse",
    "trumped": "trumped",
}


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _month_first(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?i)^({MONTH})\s+(\d{{1,2}}),?\s+(\d{{4}})$", "$3-$1-$2")


def _day_first(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?i)^(\d{{1,2}})\s+({MONTH})\s+(\d{{4}})$", "$3-$2-$1")


def _numeric(c: Column, separators: str) -> Column:
    """Month/day/year to year-month-day; two-digit years pivot at 69."""
    c = F.regexp_replace(c, rf"^(\d{{1,2}})([{separators}])(\d{{1,2}})\2(\d{{4}})$", "$4-$1-$3")
    c = F.regexp_replace(c, r"^(\d{1,2})([/-])(\d{1,2})\2(69|[7-9]\d)$", "19$4-$1-$3")
    return F.regexp_replace(c, r"^(\d{1,2})([/-])(\d{1,2})\2([0-5]\d|6[0-8])$", "20$4-$1-$3")


def _short_month(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\d{4})-([A-Za-z]{3})[A-Za-z]*-(\d{1,2})$", "$1-$2-$3")


def _iso(year_first: Column) -> Column:
    """A year-month-day spelling as an ISO date, null when no such day exists."""
    # a parser that does not fit raises an error inside, so each spelling gets its own
    numeric = F.try_to_date(year_first, "yyyy-M-d")
    named = F.try_to_date(year_first, "yyyy-MMM-d")
    other = F.date_format(F.when(year_first.rlike("[A-Za-z]"), named).otherwise(numeric),
                          "yyyy-MM-dd")
    return F.when(year_first.rlike("^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}$"), F.when(
        year_first.try_cast("date").isNotNull(), year_first)).otherwise(other)


def date_token(c: Column) -> Column:
    """The part of a document value that looks like a date, else the whole value."""
    tidy = collapse(c)
    tries = [blank_to_null(F.regexp_extract(tidy, pattern, 0)) for pattern in DATE_TOKENS]
    return F.coalesce(*tries, blank_to_null(tidy))


def ordered_date(token: Column) -> Column:
    """Any accepted document spelling rewritten as year-month-day."""
    # a month can only lead a token that begins with a letter, the other forms with a digit
    return _short_month(F.when(token.rlike("^[A-Za-z]"), _month_first(token)).otherwise(
        _day_first(_numeric(token, "./-"))))


def _document_order(c: Column) -> Column:
    """The date inside a document value as year-month-day; the plainest spellings go first."""
    whole = F.trim(c)
    return (F.when(whole.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), whole)
            .when(whole.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.concat(
                F.substring(whole, 7, 4), F.lit("-"), F.substring(whole, 1, 2), F.lit("-"),
                F.substring(whole, 4, 2)))
            .otherwise(ordered_date(date_token(c))))


def document_date(c: Column) -> Column:
    """First date inside a document value as ISO text, null when none parses."""
    return _iso(_document_order(c))


def record_date(c: Column) -> Column:
    """Whole-value date as ISO text; an unknown spelling is kept as it is."""
    tidy = blank_to_null(strip_space(c.cast("string")))
    compact = F.regexp_replace(tidy, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    ordered = _short_month(_month_first(_numeric(compact, "/-")))
    loose = tidy.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & ~tidy.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(loose, tidy).otherwise(F.coalesce(_iso(ordered), tidy))


def _money_parts(c: Column) -> tuple[Column, Column]:
    tidy = strip_space(c)
    negative = tidy.startswith("(") & tidy.endswith(")")
    bare = F.regexp_replace(tidy, r"USD|usd|[$,]", "")
    return negative, strip_chars(bare, " ()")


def _signed(number: Column, negative: Column) -> Column:
    amount = F.bround(F.when(negative, -F.abs(number)).otherwise(number), 2)
    return amount.cast(MONEY)


def document_money(c: Column) -> Column:
    """First number inside a document value, two decimals, half-even."""
    negative, bare = _money_parts(c)
    number = F.regexp_extract(bare, r"-?\d+(?:\.\d+)?", 0)
    return _signed(blank_to_null(number).try_cast("decimal(38,10)"), negative)


def record_money(c: Column) -> Column:
    """The whole value must be one number, two decimals, half-even."""
    negative, bare = _money_parts(c.cast("string"))
    return _signed(blank_to_null(bare).try_cast("decimal(38,10)"), negative)


def money_text(c: Column) -> Column:
    return c.cast(MONEY).cast("string")


def policy_number(c: Column) -> Column:
    """Upper case, no blanks, at least four characters of the allowed shape."""
    tidy = strip_chars(F.regexp_replace(F.upper(c), r"(?U)[\s\x1c-\x1f]+", ""), ":;,.|")
    return F.when((F.length(tidy) >= 4) & tidy.rlike(r"^[A-Z0-9][A-Z0-9\-_/.]*$"), tidy)


def person_name(c: Column) -> Column:
    tidy = strip_chars(collapse(c), ":;|,")
    return F.when((F.length(tidy) >= 2) & tidy.rlike("[A-Za-z]"), tidy)


def plain_value(c: Column) -> Column:
    return blank_to_null(collapse(strip_chars(c, " \t:;|,")))


def status_words(c: Column) -> Column:
    return strip_chars(F.lower(collapse(c)), ":;|,.")


def known_status(tidy: Column) -> Column:
    """Exact spelling first, then the first alias found as whole words."""
    known = _literal_map(DOCUMENT_STATUS)
    exact = F.try_element_at(known, tidy)
    # few values need the search; a lambda keeps it out of the code compiled for a whole stage
    inside = F.filter(F.array(*map(F.lit, DOCUMENT_STATUS)), lambda alias: F.rlike(
        tidy, F.concat(F.lit(r"(?U)\b"), alias, F.lit(r"\b"))))
    any_alias = rf"(?U)\b(?:{'|'.join(DOCUMENT_STATUS)})\b"
    return F.coalesce(exact, F.when(tidy.rlike(any_alias), F.try_element_at(
        known, F.get(inside, F.lit(0)))))


def document_status(c: Column) -> Column:
    return known_status(status_words(c))


def record_status(key: Column) -> Column:
    """Status of a business record from its text key; unknown ones keep their words."""
    return F.coalesce(F.try_element_at(_literal_map(DOCUMENT_STATUS), key),
                      F.replace(key, F.lit(" "), F.lit("_")))


def question_text(c: Column) -> Column:
    return casefold_ascii_words(strip_space(c))


# Normaliser kinds of document fields: a preparing step (if any), then a finishing one. The
# two are separate columns, so a long step is written once in the plan.
NORMALISERS = {
    "identifier": (None, policy_number),
    "person": (None, person_name),
    "plain": (None, plain_value),
    "date": (_document_order, _iso),
    "money": (None, lambda c: document_money(c).cast("string")),
    "status": (status_words, known_status),
}
