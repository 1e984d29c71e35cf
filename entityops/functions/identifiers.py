"""Identifier kinds: shape and checksum verdicts as Catalyst expressions, open to registration.

A kind is a function ``Column -> Column`` that returns ``struct<ok, normalised, reason>``.
Checksums over a fixed number of positions are unrolled, so they stay inside generated code; only
the kinds of free length (IBAN, Luhn) use a higher-order function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from entityops import constants as C
from entityops.functions.text import norm_id, strip

_KINDS: dict[str, tuple[Callable[[Column], Column], str, list[str] | None]] = {}


def register_validator(
    name: str, build: Callable[[Column], Column], kind: str = "single-field", countries: list[str] | None = None
) -> None:
    _KINDS[name] = (build, kind, countries)


def validator_catalog() -> list[dict]:
    return [{"name": n, "kind": _KINDS[n][1], "countries": _KINDS[n][2]} for n in sorted(_KINDS)]


def run_validator(name: str, value: Column, strict: bool = True) -> Column:
    """``strict``: an unknown kind is an error when the plan is built; otherwise it is accepted as is."""
    if name.strip().lower() in _KINDS:
        return _KINDS[name.strip().lower()][0](value)
    if strict:
        raise KeyError(f"unknown validator {name!r}")
    return _verdict(F.lit(True), norm_id(value), "")


def run_validator_by_column(kind: Column, value: Column, kinds: list[str]) -> Column:
    """Verdict for a column of kinds; kinds outside the list are accepted after normalising."""
    out = F
    for name in kinds:
        out = out.when(F.lower(F.trim(kind)) == name, run_validator(name, value))
    return out.otherwise(_verdict(F.lit(True), norm_id(value), ""))


def _verdict(ok: Column, normalised: Column, reason: str) -> Column:
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(
        ok.alias("ok"), normalised.alias("normalised"), F.when(~ok, F.lit(reason)).alias("reason")
    )


def _shaped(normalise: Callable[[Column], Column], pattern: str, reason: str) -> Callable[[Column], Column]:
    def build(value: Column) -> Column:
        text = normalise(value)
        return _verdict(text.rlike(pattern), text, reason)

    return build


def _code_at(text: Column, position: int, alphabet: str) -> Column:
    return F.instr(F.lit(alphabet), F.substring(text, position, 1)) - 1


def gstin_checksum_ok(text: Column) -> Column:
    total = F.lit(0)
    for position in range(1, 15):
        weighted = _code_at(text, position, C.GSTIN_ALPHABET) * (1 if position % 2 else 2)
        total = total + F.floor(weighted / 36) + weighted % 36
    expected = (F.lit(36) - total % 36) % 36
    return text.rlike(C.GSTIN_STRICT) & (_code_at(text, 15, C.GSTIN_ALPHABET) == expected)


def uscc_checksum_ok(text: Column) -> Column:
    """Letters outside the alphabet fail."""
    total = F.lit(0)
    for position, weight in enumerate(C.USCC_WEIGHTS, start=1):
        total = total + _code_at(text, position, C.USCC_ALPHABET) * weight
    expected = (F.lit(31) - total % 31) % 31
    legal = text.rlike(f"^[{C.USCC_ALPHABET}]{{18}}$")
    return text.rlike(C.USCC) & legal & (_code_at(text, 18, C.USCC_ALPHABET) == expected)


def luhn_ok(digits: Column) -> Column:
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    doubled = F.transform(
        numbers, lambda d, i: F.when(i % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    )
    return digits.rlike("^[0-9]+$") & (F.aggregate(doubled, F.lit(0), lambda acc, d: acc + d) % 10 == 0)


def iban_checksum_ok(text: Column) -> Column:
    rotated = F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4))
    codes = F.transform(
        F.split(rotated, ""), lambda c: F.instr(F.lit(C.GSTIN_ALPHABET), c) - 1
    )
    remainder = F.aggregate(
        codes, F.lit(0), lambda acc, v: F.when(v > 9, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97)
    )
    return text.rlike(C.IBAN_SHAPE) & (remainder == 1)


def _compact(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", "")


def _undashed(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)[\s-]+", "")


def _trimmed(value: Column) -> Column:
    return strip(F.coalesce(value, F.lit("")))


def _gstin_checked(value: Column) -> Column:
    text = F.upper(_trimmed(value))
    return _verdict(gstin_checksum_ok(text), text, "shape or checksum")


def _iban(value: Column) -> Column:
    text = norm_id(value)
    return _verdict(iban_checksum_ok(text), text, "shape or checksum")


def _luhn(value: Column) -> Column:
    text = _compact(value)
    return _verdict(luhn_ok(text), text, "checksum")


def _uscc(value: Column) -> Column:
    text = norm_id(value)
    return _verdict(uscc_checksum_ok(text), text, "shape or checksum")


def _ein(value: Column) -> Column:
    text = _undashed(value)
    ok = text.rlike(C.US_EIN)
    dashed = F.concat(F.substring(text, 1, 2), F.lit("-"), F.substr(text, F.lit(3)))
    return _verdict(ok, F.when(ok, dashed).otherwise(text), "shape")


def _national_id(value: Column) -> Column:
    found = F.regexp_extract(F.coalesce(value, F.lit("")), C.NATIONAL_ID_12, 0)
    return _verdict(found != "", _compact(found), "no 12 digit group")


register_validator("pan", _shaped(norm_id, C.PAN, "shape"), countries=["IN"])
register_validator("gstin", _shaped(norm_id, C.GSTIN_SHAPES, "shape"), countries=["IN"])
register_validator("gstin_checked", _gstin_checked, countries=["IN"])
register_validator("ifsc", _shaped(norm_id, C.IFSC, "shape"), countries=["IN"])
register_validator("pin", _shaped(_trimmed, C.PIN, "shape"), countries=["IN"])
register_validator("udyam", _shaped(norm_id, C.UDYAM, "shape"), countries=["IN"])
register_validator("cin", _shaped(norm_id, C.CIN, "shape"), countries=["IN"])
register_validator("national_id_12", _national_id, countries=["IN"])
register_validator("iban", _iban)
register_validator("bic", _shaped(lambda v: F.upper(_trimmed(v)), C.BIC, "shape"))
register_validator("email", _shaped(_trimmed, C.EMAIL, "shape"))
register_validator("phone_e164", _shaped(lambda v: F.regexp_replace(F.coalesce(v, F.lit("")), r"(?U)[\s-]", ""), C.PHONE_E164, "shape"))
register_validator("luhn", _luhn)
register_validator("uscc", _uscc, countries=["CN"])
register_validator("trn", _shaped(_compact, C.AE_TRN, "shape"), countries=["AE"])
register_validator("ein", _ein, countries=["US"])
register_validator("gb_vat", _shaped(norm_id, C.GB_VAT, "shape"), countries=["GB"])
register_validator("gb_crn", _shaped(norm_id, C.GB_CRN, "shape"), countries=["GB"])


# --- attributes derived from identifiers -----------------------------------------------------


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def state_region(gstin: Column) -> Column:
    return _lookup(F.substring(norm_id(gstin), 1, 2), C.STATE_REGION)


def embedded_pan(gstin: Column) -> Column:
    part = F.substring(norm_id(gstin), 3, 10)
    return F.when(part.rlike(C.PAN), part)


def holder_type(pan: Column) -> Column:
    text = norm_id(pan)
    return F.when(text.rlike(C.PAN), _lookup(F.substring(text, 4, 1), C.HOLDER_TYPE))


def natural_person(pan: Column) -> Column:
    return holder_type(pan) == "individual"
