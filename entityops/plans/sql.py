"""Small builders for oracle SQL: measures DuckDB lacks, and value lists of fixed tables."""

from __future__ import annotations

from entityops import constants as C


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows, names: str) -> str:
    """``(VALUES ...) names`` from Python rows."""
    body = ", ".join("(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) {names}"


def norm_text(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def norm_name(x: str) -> str:
    """ASCII only: accents are not folded here."""
    out = f"trim(lower(coalesce({x}, '')))"
    for suffix in C.LEGAL_SUFFIXES:
        escaped = suffix.replace(".", "\\.")
        out = f"regexp_replace({out}, '(?s)^[ ,.\\-]*(.*?)[ ,.\\-]*{escaped}$', '\\1')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence of two texts of at most 60 characters, by dynamic programming."""
    n = f"len({a})"
    row = (
        f"list_reduce(list_concat([[0 for _ in range({n} + 1)]], [[ascii(c)] for c in string_split({b}, '')]), "
        f"lambda prev, ch: list_reduce(list_concat([[0]], [[i] for i in range(1, {n} + 1)]), "
        f"lambda cur, i: list_append(cur, CASE WHEN ascii({a}[CAST(i[1] AS INT)]) = ch[1] "
        f"THEN prev[i[1]] + 1 ELSE greatest(prev[i[1] + 1], cur[i[1]]) END)))"
    )
    return f"list_last({row})"


def similarity(a: str, b: str) -> str:
    """0..100 as a double."""
    size = f"(len({a}) + len({b}))"
    return (
        f"CASE WHEN {a} = {b} THEN 100.0::DOUBLE "
        f"ELSE (1.0::DOUBLE - ({size} - 2 * {lcs(a, b)})::DOUBLE / {size}) * 100.0::DOUBLE END"
    )


def case_of(x: str, table: dict[str, str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(str(v))}" for k, v in table.items())
    return f"CASE {x} {arms} ELSE {default} END"


def weight(field: str) -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {v}" for k, v in C.FIELD_WEIGHTS.items())
    return f"CASE {field} {arms} ELSE 1 END"
