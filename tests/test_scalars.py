import random

import pytest
from pyspark.sql import functions as F

from entityops.functions import identifiers as I
from entityops.functions import text as T

A, B = F.col("a"), F.col("b")


@pytest.mark.parametrize(
    "value, expected",
    [
        ("ACME Logistics Pvt. Ltd.", "acme logistics"), ("zinc", "z"), ("Foo, Inc", "foo"), ("Acme Private Limited", "acme"),
        ("cafés", "cafe s"), ("Limited", ""), ("Corp Ltd", ""), (None, ""), ("STRASSE ß", "strasse ss"),
    ],
)
def test_norm_name(one, value, expected):
    assert one({"a": value}, T.norm_name(A)) == expected


def test_norm_text_and_id(one):
    assert one({"a": " A-b\tC d "}, T.norm_text(A)) == "a b c d"
    assert one({"a": " 27 aab\tc "}, T.norm_id(A)) == "27AABC"


def _lcs_table(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, start=1):
            previous, row[j] = row[j], previous + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_ratio_is_the_lcs_measure(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 90)))
    pairs = [(word(), word()) for _ in range(200)] + [("abc", "abc"), ("", "x"), ("kitten", "sitting")]
    got = [r.r for r in spark.createDataFrame(pairs, "a string, b string").select(T.ratio(A, B).alias("r")).collect()]
    want = []
    for a, b in pairs:
        a, b = " ".join(a.split()), " ".join(b.split())
        if not a or not b:
            want.append(0)
        elif a == b:
            want.append(100)
        else:
            size = len(a) + len(b)
            want.append(round((1.0 - (size - 2 * _lcs_table(a, b)) / size) * 100.0))
    assert got == want


def test_token_measures(one):
    assert one({"a": "b a", "b": "a b"}, T.token_sort_ratio(A, B)) == 1.0
    assert one({"a": "A", "b": "a"}, T.token_sort_ratio(A, B)) == 0.0
    assert one({"a": "north road 1", "b": "Road North"}, T.token_jaccard(A, B)) == 67
    assert one({"a": None, "b": "x"}, T.token_jaccard(A, B)) == 0


@pytest.mark.parametrize(
    "known, found, score",
    [("AB-1", "ab 1", 100), ("X9 · 33AALCS", "33aalcs", 100), ("12345678", "912345678", 94), ("123", "91234567", 85), ("abc", "xyz", 0), ("", "x", 0)],
)
def test_tax_match(one, known, found, score):
    assert one({"a": known, "b": found}, T.tax_match(A, B)) == score


@pytest.mark.parametrize("value, score", [("50.4", 50), ("50.5", 51), ("-5", 0), ("150", 100), ("77", 77), ("not a number", None), (None, None), ("NaN", None), ("inf", None), ("true", None)])
def test_clamp_score(one, value, score):
    assert one({"a": value}, T.clamp_score(A)) == score


@pytest.mark.parametrize(
    "value, iso",
    [
        ("2024-01-05", "2024-01-05"), ("05-02-2024", "2024-02-05"), ("5/2/2024", "2024-02-05"), ("05-Feb-2024", "2024-02-05"), ("5 feb 2024", "2024-02-05"),
        ("2024-03-01T10:00:00Z", "2024-03-01"), ("31-02-2024", None), ("soon", None), ("", None),
    ],
)
def test_parse_date(one, value, iso):
    assert one({"a": value}, T.parse_date(A).cast("string")) == iso


def test_display_and_codes(one):
    assert one({"a": None}, T.display(A)) == "—"
    assert one({"a": "true"}, T.display(A)) == "Yes"
    assert one({"a": "Pune"}, T.display(A, F.lit("cityCode"))) == "Pune (will resolve to city code)"
    assert one({"a": " 123 "}, T.pad_code(A)) == "0000000123"
    assert one({"a": "123456789012"}, T.pad_code(A)) == "123456789012"


@pytest.mark.parametrize("score, trust, blend", [(85, "match", "match"), (60, "partial", "partial"), (55, "partial", "mismatch"), (49, "mismatch", "mismatch")])
def test_status_buckets(one, score, trust, blend):
    assert one({"a": score}, T.trust_status(A), T.blend_status(A)) == (trust, blend)


@pytest.mark.parametrize(
    "kind, value, ok",
    [
        ("pan", " aabca1234f ", True), ("pan", "AABCA1234", False), ("gstin", "27AABCA1234F1Z5", True), ("gstin", "27AABCA1234F", False),
        ("gstin_checked", "27AAPFU0939F1ZV", True), ("gstin_checked", "27AAPFU0939F1ZA", False), ("ifsc", "HDFC0001234", True), ("ifsc", "HDFCX001234", False),
        ("iban", "DE89 3704 0044 0532 0130 00", True), ("iban", "DE00BAD", False), ("iban", "DE88370400440532013000", False),
        ("uscc", "91310000MA1FL1RD1C", True), ("uscc", "91310000MA1FL1RD1X", False), ("uscc", "91310000MA1FL1RIIC", False), ("trn", "100123456700003", True), ("trn", "200123456700003", False),
        ("ein", "12-3456789", True), ("ein", "02-3456789", False), ("gb_vat", "GB123456789", True), ("gb_crn", "SC123456", True), ("gb_crn", "123", False),
        ("email", "a.b@example.com", True), ("email", "a@b", False), ("phone_e164", "+49 170-1234567", True), ("luhn", "4539 1488 0343 6467", True), ("luhn", "4539 1488 0343 6468", False),
        ("bic", "deutdeff", True), ("bic", "DEUT", False), ("pin", "560001", True), ("udyam", "UDYAM-MH-01-1234567", True), ("cin", "U12345MH2020PTC123456", True),
        ("national_id_12", "no 1234 5678 9012.", True), ("pan", None, False),
    ],
)
def test_identifier_kinds(one, kind, value, ok):
    assert one({"a": value}, I.run_validator(kind, A)["ok"]) is ok


def test_registry_of_kinds(one):
    assert one({"a": "123456789"}, I.run_validator("ein", A)["normalised"]) == "12-3456789"
    with pytest.raises(KeyError):
        I.run_validator("unheard of", A)
    assert one({"a": " a b "}, I.run_validator("unheard of", A, strict=False)["normalised"]) == "AB"
    I.register_validator("even", lambda c: F.struct((F.length(c) % 2 == 0).alias("ok"), c.alias("normalised"), F.lit(None).cast("string").alias("reason")))
    assert one({"a": "ab"}, I.run_validator("even", A)["ok"]) is True
    assert {"name": "pan", "kind": "single-field", "countries": ["IN"]} in I.validator_catalog()


def test_derived_attributes(one):
    assert one({"a": "27AABCA1234F1Z5"}, I.embedded_pan(A), I.state_region(A)) == ("AABCA1234F", "MH")
    assert one({"a": "AABPA1234F"}, I.natural_person(A)) is True
    assert one({"a": "AABCA1234F"}, I.natural_person(A)) is False
    assert one({"a": "BADPAN"}, I.natural_person(A)) is None
