from decimal import Decimal

import pytest

from ledgerlens.functions import text as tx
from ledgerlens.functions import values as v
from ledgerlens.functions.serialise import formula_safe


def test_document_dates(one):
    assert one(["2026-03-14", "03/14/2026", "March 14, 2026", "Mar 14 2026", "14 March 2026",
                "Sept 4, 2026", "3.4.2026", "03/14/85", "03/14/26", "due 3/4/26 noon", "02/30/2026",
                "someday", "may 5 2026"], v.document_date) == [
        "2026-03-14"] * 5 + ["2026-09-04", "2026-03-04", "1985-03-14", "2026-03-14", "2026-03-04",
                             None, None, "2026-05-05"]


def test_record_dates_keep_unknown_spellings(one):
    assert one(["2026-03-14", "03-14-2026", "March 14 2026", "14 March 2026", " ", None,
                "2026-3-4", "20260314"], v.record_date) == [
        "2026-03-14", "2026-03-14", "2026-03-14", "14 March 2026", None, None, "2026-3-4",
        "2026-03-14"]


def test_money(one):
    assert one(["$1,250", "USD 99.5", "$0.00", "($25.75)", "about 7 per month", "none", "1.005",
                "2.675"], v.document_money) == [
        Decimal("1250.00"), Decimal("99.50"), Decimal("0.00"), Decimal("-25.75"), Decimal("7.00"),
        None, Decimal("1.00"), Decimal("2.68")]
    assert one(["$1,250", "12 a month", "(3)", ""], v.record_money) == [
        Decimal("1250.00"), None, Decimal("-3.00"), None]


def test_statuses(one):
    assert one(["Active", "In Force", "Canceled", "Not Issued", "Pending Lapse", "Trumped.",
                "policy not issued yet", "??"], v.document_status) == [
        "active", "active", "cancelled", "not_issued", "pending_lapse", "trumped", "active", None]


def test_numbers_and_names(one):
    assert one(["pol - 2026-1", "AB1", ":POL/1_2.;", "A?BCD"], v.policy_number) == [
        "POL-2026-1", None, "POL/1_2", None]
    assert one([" Ann  Lee;", "7", "x", "12 34"], v.person_name) == ["Ann Lee", None, None, None]
    assert one([" | Gold  Plan; ", " :; "], v.plain_value) == ["Gold Plan", None]


@pytest.mark.parametrize("value, key", [
    ("Élodie  O'Neil", "elodie o neil"), ("STRASSE-ß", "strasse ss"), ("ﬁne ½", "fine 1 2"),
    ("--", None), (None, None)])
def test_text_key(one, value, key):
    assert one([value, "plain Text"], tx.text_key) == [key, "plain text"]


def test_page_text(one):
    raw = " a\t b \r\n\r\n    c d \r e\x1cf\n"
    assert one([raw, "", None], tx.normalise_page_text) == ["a b\nc d\ne f", "", ""]
    assert one([raw], tx.word_count) == [6]


def test_formula_guard(one):
    assert one(["=1+1", " +x", "-5", "+7.25", "@a", "plain", "", "-5-6"], formula_safe) == [
        "'=1+1", "' +x", "-5", "+7.25", "'@a", "plain", "", "'-5-6"]


def test_floats_that_json_cannot_hold(spark):
    from ledgerlens.functions.serialise import json_safe_rows
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [(1.5, [nan, -inf, None, 2.0], {"k": inf}, (nan, 3))],
        "a double, b array<double>, c map<string,double>, d struct<x:float,y:int>")
    row = json_safe_rows(df).first()
    assert row["a"] == "1.5" and row["b"] == ["nan", "-inf", None, "2.0"]
    assert row["c"] == {"k": "inf"} and tuple(row["d"]) == ("nan", 3)
