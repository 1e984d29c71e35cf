"""Text normalisation and similarity as Catalyst expressions.

Only two kernels leave the JVM, both as Arrow UDFs over plain strings: Unicode NFKD folding (rows
without non-ASCII letters pass a null and cost nothing) and the LCS-based similarity ratio, for
which Spark has no built-in (``levenshtein`` is a different measure). The ratio is computed for all
different pairs of a batch at once.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from entityops import constants as C

NON_ASCII = r"[^\x00-\x7F]"
#: Characters whose places fit one machine word.
WORD = 64


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def present(col: Column) -> Column:
    return F.coalesce(col.cast("string").rlike(r"(?U)\S"), F.lit(False))


def blank(col: Column) -> Column:
    return ~present(col)


def strip_to_null(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[strip_to_null(c) for c in cols])


def norm_text(col: Column) -> Column:
    """Lower case, everything but ASCII letters, digits and white space to a blank, collapsed."""
    kept = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"(?U)[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def norm_words(col: Column) -> Column:
    """Lower case letters, digits and marks of any script, everything else to one blank."""
    kept = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " ")
    return F.trim(kept)


def norm_id(col: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", ""))


@F.pandas_udf(StringType())
def _nfkd_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).casefold())


def fold_case(col: Column) -> Column:
    """NFKD plus case folding. ASCII text never reaches Python."""
    return F.coalesce(_nfkd_casefold(F.when(col.rlike(NON_ASCII), col)), F.lower(col))


def _alnum_words(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, "[^a-z0-9]+", " "))


def norm_name(col: Column) -> Column:
    """Company name without legal suffixes; each suffix is tried once, in order, at any boundary."""
    text = strip(fold_case(F.coalesce(col, F.lit(""))))
    for suffix in C.LEGAL_SUFFIXES:
        escaped = suffix.replace(".", r"\.")
        text = F.regexp_replace(text, rf"(?s)^[ ,.\-]*(.*?)[ ,.\-]*{escaped}\z", "$1")
    return _alnum_words(text)


def norm_address(col: Column) -> Column:
    return _alnum_words(fold_case(F.coalesce(col, F.lit(""))))


def _lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over Python integers."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _similarity(a: str, b: str) -> float:
    if a == b:
        return 100.0
    size = len(a) + len(b)
    return (1.0 - (size - 2 * _lcs_length(a, b)) / size) * 100.0


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts of at most ``WORD`` characters as rows of code points (longer ones as empty rows), and the lengths of all."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    kept = [t if n <= WORD else "" for t, n in zip(texts, sizes)]
    width = max(1, int(sizes[sizes <= WORD].max(initial=0)))
    points = np.array(kept, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
    return points, sizes


def _lcs_lengths(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """``_lcs_length`` of many pairs of rows of code points: one step for each place of the right rows."""
    if a.size and b.size and max(a.max(), b.max()) < 256:
        a, b = a.astype(np.uint8), b.astype(np.uint8)
    full = np.where(a_sizes > 0, np.uint64(2**64 - 1) >> (WORD - np.maximum(a_sizes, 1)).astype(np.uint64), np.uint64(0))
    row, masks = full.copy(), np.zeros((len(a), 8), np.uint8)
    for j in range(b.shape[1]):
        bits = np.packbits(a == b[:, j, None], axis=1, bitorder="little")
        masks[:, : bits.shape[1]] = bits
        hit = row & masks.view("<u8")[:, 0] * (j < b_sizes)
        row = ((row + hit) | (row - hit)) & full
    return a_sizes - np.bitwise_count(row)


@F.arrow_udf(DoubleType())
def _similarity_udf(left: pa.Array, right: pa.Array) -> pa.Array:
    a, b = left.dictionary_encode(), right.dictionary_encode()
    at, to = (x.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    known = (at >= 0) & (to >= 0)
    if not known.any():
        return pa.nulls(len(left), pa.float64())
    texts_a, texts_b = a.dictionary.to_pylist(), b.dictionary.to_pylist()
    pairs, place = np.unique(at[known] * len(texts_b) + to[known], return_inverse=True)
    at, to = pairs // len(texts_b), pairs % len(texts_b)
    (points_a, sizes_a), (points_b, sizes_b) = _code_points(texts_a), _code_points(texts_b)
    n, m = sizes_a[at], sizes_b[to]
    size = n + m
    apart = np.divide(size - 2 * _lcs_lengths(points_a[at], np.minimum(n, WORD), points_b[to], m), size, out=np.zeros(len(size)), where=size > 0)
    score = (1.0 - apart) * 100.0
    for i in np.flatnonzero((n > WORD) | (m > WORD)):
        score[i] = _similarity(texts_a[at[i]], texts_b[to[i]])
    out = np.zeros(len(known))
    out[known] = score[place]
    return pa.array(out, mask=~known)


def _ratio(a: Column, b: Column) -> Column:
    """0..100 as a double."""
    return _similarity_udf(a, b)


def ratio(left: Column, right: Column) -> Column:
    """Similarity of the normalised texts, 0..100, half-even; 0 when a side is empty."""
    return ratio_of(norm_text(left), norm_text(right))


def ratio_of(a: Column, b: Column) -> Column:
    """The same for texts that are normalised already."""
    return F.when((a == "") | (b == ""), F.lit(0)).otherwise(F.rint(_ratio(a, b)).cast("int"))


def sorted_tokens(col: Column) -> Column:
    """The tokens in order; a text without white space is its only token."""
    text = F.coalesce(col, F.lit(""))
    tokens = F.array_join(F.sort_array(F.split(strip(text), r"(?U)\s+")), " ")
    return F.when(text.rlike(r"(?U)\s"), tokens).otherwise(text)


def token_sort_ratio(left: Column, right: Column) -> Column:
    """Order-free similarity on 0..1, case sensitive."""
    return _ratio(sorted_tokens(left), sorted_tokens(right)) / 100.0


def token_jaccard(left: Column, right: Column) -> Column:
    """Shared share of the token sets, 0..100, half-even."""
    return jaccard_of(norm_text(left), norm_text(right))


def jaccard_of(a: Column, b: Column) -> Column:
    ta, tb = F.split(a, " "), F.split(b, " ")
    share = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    return (
        F.when((a == "") | (b == ""), F.lit(0))
        .when(a == b, F.lit(100))
        .otherwise(F.rint(share * 100).cast("int"))
    )


def tax_match(known: Column, found: Column) -> Column:
    """Identifier agreement: equal or equal to one listed part 100, containment at least 85, else ratio."""
    return tax_match_of(known, norm_text(known), norm_text(found))


def tax_match_of(known: Column, a: Column, b: Column) -> Column:
    """The same with both sides normalised; ``known`` is still needed for its separators."""
    parts = tax_parts(known)
    return tax_score(parts, tax_part(parts, b), a, b)


def tax_parts(known: Column) -> Column:
    """The listed parts, normalised."""
    raw_parts = F.filter(F.split(F.coalesce(known, F.lit("")), r"(?U)[·,;/\s]+"), lambda p: F.trim(p) != "")
    return F.transform(raw_parts, norm_text)


def tax_part(parts: Column, b: Column) -> Column:
    """The first part that contains ``b`` or is contained in it."""
    return F.try_element_at(F.filter(parts, lambda p: (p != "") & (b.contains(p) | p.contains(b))), F.lit(1))


def tax_score(parts: Column, part: Column, a: Column, b: Column) -> Column:
    score = ratio_of(F.coalesce(part, a), b)
    return (
        F.when((a == "") | (b == ""), F.lit(0))
        .when((a == b) | F.array_contains(parts, b), F.lit(100))
        .when(part.isNotNull(), F.greatest(score, F.lit(85)))
        .otherwise(score)
    )


def bucket(score: Column, steps: list[tuple[int, str]], last: str) -> Column:
    out = F
    for limit, label in steps:
        out = out.when(score >= limit, F.lit(label))
    return out.otherwise(F.lit(last))


def trust_status(score: Column) -> Column:
    return bucket(score, C.TRUST_STATUS, "mismatch")


def blend_status(score: Column) -> Column:
    return bucket(score, C.BLEND_STATUS, "mismatch")


def trust_band(score: Column) -> Column:
    return F.when(score.isNull(), F.lit("insufficient")).otherwise(bucket(score, C.TRUST_BANDS, "low"))


def half_even(col: Column) -> Column:
    return F.rint(col).cast("int")


def clamp_score(col: Column) -> Column:
    """Text from outside to a 0..100 integer, half up; not a finite number -> null."""
    number = col.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(number + 0.5)))).cast("int")


def display(value: Column, needs: Column | None = None) -> Column:
    shown = F.when(value.isNull() | (value == ""), F.lit(C.EMPTY_DISPLAY))
    shown = shown.when(value == "true", F.lit("Yes")).when(value == "false", F.lit("No")).otherwise(value)
    if needs is None:
        return shown
    note = F
    for kind, text in C.RESOLUTION_NOTE.items():
        note = note.when(needs == kind, F.lit(text))
    return F.concat(shown, note.otherwise(F.lit("")))


def pad_code(code: Column) -> Column:
    """Numeric codes are padded to ten digits and never cut; everything else is only trimmed."""
    text = strip(code)
    return F.when(
        text.rlike("^[0-9]+$") & (F.length(text) < 10), F.lpad(text, 10, "0")
    ).otherwise(text)


def parse_date(col: Column) -> Column:
    """Five written formats, then an ISO prefix; anything else is null."""
    text = strip(col)
    by_month_name = F.regexp_replace(F.initcap(F.regexp_replace(text, "-", " ")), " +", " ")
    guarded = [
        (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", text, "yyyy-M-d"),
        (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", text, "d-M-yyyy"),
        (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", text, "d/M/yyyy"),
        (r"^[0-9]{1,2}[- ][A-Za-z]{3}[- ][0-9]{4}$", by_month_name, "d MMM yyyy"),
        (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", F.substring(text, 1, 10), "yyyy-MM-dd"),
    ]
    return F.coalesce(
        *[F.try_to_timestamp(F.when(text.rlike(shape), value), F.lit(fmt)).cast("date") for shape, value, fmt in guarded]
    )


def iso_date(col: Column) -> Column:
    """Date part of an ISO date or date-time text, else null."""
    text = col.cast("string")
    return F.when(
        text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), F.substring(text, 1, 10).try_cast("date")
    )


def java_regex(pattern: str) -> str:
    """Named groups and Unicode classes of a Python pattern in Java's dialect."""
    return "(?U)" + pattern.replace("(?P<", "(?<")
