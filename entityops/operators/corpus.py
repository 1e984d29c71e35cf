"""Tagging of text tables: document type, personal identifiers, page signals and query intent.

Whole texts are read once per operator; word lists are fixed, so they are compiled into the
expressions and nothing is joined or shuffled.
"""

from __future__ import annotations

from collections import Counter

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from entityops import constants as C
from entityops.functions import text as T


# --- document type ---------------------------------------------------------------------------


def _anchor_hits(lowered: Column, anchors: dict[str, list[str]]) -> Column:
    cells = []
    for position, (doc_type, words) in enumerate(anchors.items()):
        hits = sum(F.when(lowered.contains(w.lower()), 1).otherwise(0) for w in words)
        cells.append(F.struct(hits.alias("hits"), F.lit(-position).alias("order"), F.lit(doc_type).alias("doc_type")))
    return F.sort_array(F.array(*cells), asc=False)


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _filename_hint(filename: Column, hints: dict[str, list[str]]) -> Column:
    lowered = F.replace(F.lower(filename), F.lit("-"), F.lit("_"))
    out = F
    for doc_type, words in hints.items():
        out = out.when(_any(lowered, words), F.lit(doc_type))
    return out.otherwise(F.lit(None).cast("string"))


def classify_corpus(
    documents: DataFrame, text: str = "text", country: str = "IN", filename: str | None = None, hint: str | None = None
) -> DataFrame:
    """Add doc_type, confidence, ambiguous and runner_up_gap.

    The type with most anchors wins, catalog order breaks ties and a tie is ambiguous.  A file name
    hint overrides it with at least 0.8, an explicit hint of the country with at least 0.85.
    """
    national = country == "IN"
    anchors = C.ANCHORS if national else C.LOCALE_ANCHORS[country]
    hints = C.FILENAME_HINTS if national else C.LOCALE_FILENAME_HINTS[country]
    rows = documents.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn("_ranked", _anchor_hits(F.col("_low"), anchors))
    top, second = F.col("_ranked")[0], F.col("_ranked")[1]
    found = top["hits"] > 0
    gap = top["hits"] - second["hits"]
    clear = found & (gap >= 1)
    doc_type = F.when(found, top["doc_type"])
    confidence = F.when(~found, F.lit(0.0)).when(clear, F.least(F.lit(0.99), F.lit(0.6) + F.lit(0.15) * top["hits"])).otherwise(F.lit(0.5))
    ambiguous = ~clear
    if filename is not None:
        named = _filename_hint(F.col(filename), hints)
        if national:
            only_national_id = _any(F.col("_low"), C.NATIONAL_ID_MARKERS) & ~_any(F.col("_low"), C.PAN_MARKERS)
            named = F.when((named == "IN_PAN_CARD") & only_national_id, F.lit("IN_ADDRESS_PROOF")).otherwise(named)
        confidence = F.when(named.isNotNull(), F.greatest(confidence, F.lit(0.8))).otherwise(confidence)
        ambiguous = ambiguous & named.isNull()
        doc_type = F.coalesce(named, doc_type)
    if hint is not None:
        given = F.upper(T.strip(F.col(hint)))
        valid = F.coalesce(given.startswith(f"{country}_"), F.lit(False))
        confidence = F.when(valid, F.greatest(confidence, F.lit(0.85))).otherwise(confidence)
        ambiguous = ambiguous & ~valid
        doc_type = F.when(valid, given).otherwise(doc_type)
    return rows.select(
        *documents.columns, doc_type.alias("doc_type"), confidence.alias("confidence"), ambiguous.alias("ambiguous"),
        F.when(found, gap).alias("runner_up_gap"),
    )


# --- redaction -------------------------------------------------------------------------------


def redact(df: DataFrame, blocked: list[str] | None = None) -> DataFrame:
    """Blocked columns become ``<redacted>``; identifier shaped tokens elsewhere become ``<id>``."""
    names = C.BLOCKED_COLUMNS if blocked is None else blocked
    out = []
    for name, data_type in df.dtypes:
        if name in names:
            out.append(F.lit("<redacted>").alias(name))
        elif data_type == "string":
            out.append(F.regexp_replace(F.col(f"`{name}`"), "(?U)" + C.ID_LIKE_TOKEN, "<id>").alias(name))
        else:
            out.append(F.col(f"`{name}`"))
    return df.select(*out)


# --- pages -----------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else html.unescape(v))


def clean_html(col: Column) -> Column:
    """Tags to blanks, entities resolved, white space collapsed; text without ``&`` stays in the JVM."""
    bare = F.regexp_replace(col, "<[^>]+>", " ")
    plain = F.coalesce(_unescape(F.when(bare.contains("&"), bare)), bare)
    return T.strip(F.regexp_replace(plain, r"(?U)\s+", " "))


def _capture(source: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(source, pattern, 1), F.lit(""))


def _meta(attributes: str) -> str:
    return rf"""(?i)<meta[^>]+{attributes}[^>]+content=["']([^"']+)["']"""


def _json_ld(source: Column) -> Column:
    """First organisation node of the page's JSON-LD blocks as a variant."""
    scripts = F.regexp_extract_all(
        source, F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1)
    )

    def nodes(script: Column) -> Column:
        parsed = F.try_parse_json(script)
        return F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.array(parsed))

    def is_organisation(node: Column) -> Column:
        kind = F.try_variant_get(node, "$['@type']", "string")
        return F.coalesce(kind.contains("Organization") | kind.isin("Corporation", "LocalBusiness"), F.lit(False))

    return F.try_element_at(F.filter(F.flatten(F.transform(scripts, nodes)), is_organisation), F.lit(1))


def page_signals(pages: DataFrame, keep_unnamed: bool = False) -> DataFrame:
    """Normalised address, host, and the company name, address and description a page states.

    pages: page_id, url, html.  The whole page is searched.  Pages that name nobody are dropped.
    """
    url = T.strip(F.col("url"))
    normal = F.when(url == "", None).when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    page = F.col("html")
    raw = pages.select(
        "page_id", normal.alias("url"), F.try_parse_url(normal, F.lit("HOST")).alias("host"),
        _capture(page, "(?is)<title[^>]*>([^<]+)</title>").alias("title"),
        _capture(page, _meta("property=[\"']og:site_name[\"']")).alias("site_name"),
        _capture(page, _meta("property=[\"']og:title[\"']")).alias("og_title"),
        _capture(page, _meta("(?:name|property)=[\"'](?:description|og:description)[\"']")).alias("description"),
        F.when(page.contains("ld+json"), _json_ld(page)).alias("_org"),
    )
    cleaned = raw.select(
        "page_id", "url", "host", *[clean_html(F.col(c)).alias(c) for c in ("title", "site_name", "og_title", "description")],
        F.try_variant_get("_org", "$.name", "string").alias("org_name"),
        F.try_variant_get("_org", "$.address.streetAddress", "string").alias("street"),
        F.try_variant_get("_org", "$.address.addressLocality", "string").alias("city"),
        F.try_variant_get("_org", "$.address.postalCode", "string").alias("postal_code"),
    )
    named = cleaned.withColumn("name", F.coalesce(*[F.nullif(c, F.lit("")) for c in ("org_name", "site_name", "og_title", "title")]))
    return named if keep_unnamed else named.where("name IS NOT NULL AND host <> ''")


# --- query intent ----------------------------------------------------------------------------


def _word(phrase: str) -> str:
    return rf"(?iU)\b{phrase}\b"


def _longest_first(table: dict[str, str]) -> list[tuple[str, str]]:
    return sorted(table.items(), key=lambda kv: -len(kv[0]))


def _choose(text: Column, table: list[tuple[str, str]]) -> Column:
    out = F
    for phrase, value in table:
        out = out.when(text.rlike(_word(phrase)), F.lit(value))
    return out.otherwise(F.lit(None).cast("string"))


def _first_capture(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, "(?iU)" + p, 1), F.lit("")) for p in patterns])


def _without(text: Column, pattern: Column) -> Column:
    """Replace a per-row pattern by blanks; a null pattern changes nothing."""
    return F.coalesce(F.regexp_replace(text, pattern, F.lit(" ")), text)


def _pattern_of(value: Column, table: dict[str, str], nth: int) -> Column:
    """Pattern of the nth alias of a value, or null."""
    by_value: dict[str, list[str]] = {}
    for alias, v in table.items():
        by_value.setdefault(v, []).append(alias)
    out = F
    for v, aliases in by_value.items():
        if len(aliases) > nth:
            out = out.when(value == v, F.lit(_word(aliases[nth])))
    return out.otherwise(F.lit(None).cast("string"))


def _most_aliases(table: dict[str, str]) -> int:
    return max(Counter(table.values()).values(), default=0)


def tag_query_intent(queries: DataFrame, column: str = "query") -> DataFrame:
    """Intent of free-text vendor queries, and whether it is good enough without a model.

    Adds intent, country, city, vendor_status, in_workflow, has_draft, tax_id, code, code_type,
    trading_name, confidence and immediate.  Queries nothing can be made of keep nulls.
    """
    c = F.col
    q = c("_q")
    df = queries.withColumn("_q", T.strip(c(column)))
    erp = F.when(q.rlike(_word("erp")), _first_capture(q, C.ERP_CODE_PATTERNS))
    bp = _first_capture(q, C.BP_CODE_PATTERNS)
    df = df.withColumns(
        {
            "_erp": erp,
            "_bp": bp,
            "_bare": F.when(q.rlike(r"(?U)^\d{4,10}$"), q),
            "_vendor_raw": F.nullif(F.regexp_extract(q, "(?iU)" + C.VENDOR_CODE, 1), F.lit("")),
            "_country_alias": _choose(q, _longest_first(C.COUNTRY_ALIASES)),
            "_city": _choose(q, _longest_first(C.CITY_ALIASES)),
            "_status": _choose(q, [(w, w.upper()) for w in C.STATUS_WORDS]),
            "_workflow": q.rlike(r"(?iU)\b(?:" + "|".join(C.WORKFLOW_PHRASES) + r")\b"),
            "_draft": q.rlike(r"(?iU)\b(?:" + "|".join(C.DRAFT_PATTERNS) + r")\b"),
            "_all": q.rlike("(?iU)" + C.LIST_ALL),
            "_tax_raw": F.upper(F.nullif(F.regexp_extract(q, "(?iU)" + C.TAX_TOKEN, 0), F.lit(""))),
        }
    )
    vendor = F.upper("_vendor_raw")
    at = F.instr(q, c("_vendor_raw"))
    rest = T.strip(F.concat(F.substr(q, F.lit(1), at - 1), F.substr(q, at + F.length("_vendor_raw"))))
    tagged = F.upper(F.regexp_extract(q, r"(?iU)\b(?:in|country)\s+([A-Za-z]{2})\b", 1))
    tokens = F.regexp_extract_all(F.upper(q), F.lit(r"(?U)\b([A-Z]{2})\b"), F.lit(1))
    own = F.coalesce(F.substring(vendor, 1, 2), F.lit(""))
    loose = F.try_element_at(F.filter(tokens, lambda x: x.isin(*C.KNOWN_ISO2) & (x != own)), F.lit(1))
    df = df.withColumns(
        {
            "_vendor": vendor,
            "_vendor_only": c("_vendor_raw").isNotNull() & (F.length(rest) < 4),
            "_country": F.coalesce(c("_country_alias"), F.when(tagged.isin(*C.KNOWN_ISO2), tagged), loose),
            "_tax": F.when(F.coalesce(c("_tax_raw") != vendor, c("_tax_raw").isNotNull()), c("_tax_raw")),
        }
    )
    df = df.withColumn("_w", _without(q, F.concat(F.lit("(?i)"), c("_vendor"))))
    df = df.withColumn("_w", _without(c("_w"), F.concat(F.lit("(?i)"), c("_tax"))))
    for column, table in (("_city", C.CITY_ALIASES), ("_country", C.COUNTRY_ALIASES)):
        for nth in range(_most_aliases(table)):
            df = df.withColumn("_w", _without(c("_w"), _pattern_of(c(column), table, nth)))
    df = df.withColumn("_w", _without(c("_w"), F.concat(F.lit(r"(?iU)\b"), c("_country"), F.lit(r"\b"))))
    df = df.withColumn("_w", F.regexp_replace(c("_w"), r"(?iU)\b(?:" + "|".join(C.STATUS_WORDS) + r")\b", " "))
    df = df.withColumn("_w", F.regexp_replace(c("_w"), "(?iU)" + C.LIST_ALL, " "))
    dropped = C.STOP_WORDS + list(C.CITY_ALIASES)
    kept = F.filter(F.split("_w", r"(?U)[\s,;]+"), lambda x: (x != "") & ~F.lower(x).isin(*dropped))
    name = F.array_join(kept, " ")
    df = df.withColumn("_name", F.when(F.length(name) >= 3, name))

    country, name, status = c("_country"), c("_name"), c("_status")
    none = F.lit(None)
    no_text = none.cast("string")
    no_flag = none.cast("boolean")

    def outcome(intent, confidence, code=no_text, code_type=no_text, **fields) -> Column:
        values = {
            "intent": F.lit(intent), "country": no_text, "city": no_text, "vendor_status": no_text, "in_workflow": no_flag, "has_draft": no_flag,
            "tax_id": no_text, "code": code, "code_type": code_type, "trading_name": no_text,
            "confidence": confidence if isinstance(confidence, Column) else F.lit(confidence),
        } | fields
        return F.struct(*[v.alias(k) for k, v in values.items()])

    yes = F.lit(True)
    place = {"country": country, "city": c("_city")}
    search = "attribute_search"
    listed = c("_erp").isNotNull() | c("_bp").isNotNull() | c("_bare").isNotNull()
    marker = F.when(q.rlike(r"(?iU)\b(?:" + "|".join(C.CODE_MARKERS) + r")\b"), "high").otherwise("medium")
    number = F.coalesce(T.pad_code(F.coalesce("_erp", "_bp")), c("_bare"))
    number_type = F.when(c("_erp").isNotNull(), C.ERP_CODE_TYPE).when(c("_bp").isNotNull(), C.BP_CODE_TYPE)
    has_country, has_name, has_tax = country.isNotNull(), name.isNotNull(), c("_tax").isNotNull()
    words = F.size(F.split(F.coalesce(name, F.lit("")), " "))
    result = (
        F.when(listed, outcome("code_lookup", marker, number, number_type))
        .when(c("_vendor_only"), outcome("code_lookup", "high", c("_vendor")))
        .when(
            has_country & c("_workflow"),
            outcome(search, "high", **place, has_draft=yes, in_workflow=yes, vendor_status=F.coalesce(status, F.lit("PENDING"))),
        )
        .when(has_country & c("_draft") & (c("_all") | ~has_name), outcome(search, "high", **place, has_draft=yes, vendor_status=status))
        .when(has_country & (c("_all") | (status.isNotNull() & ~has_name)), outcome(search, "high", **place, vendor_status=status))
        .when(has_tax & has_country, outcome(search, "high", **place, tax_id=c("_tax"), trading_name=name))
        .when(has_tax, outcome(search, "high", tax_id=c("_tax"), trading_name=name))
        .when(has_name & has_country, outcome(search, "high", **place, trading_name=name, vendor_status=status))
        .when(
            has_name,
            outcome(search, F.when(words >= 2, "medium").otherwise("low"), city=c("_city"), trading_name=name, vendor_status=status),
        )
        .when(has_country, outcome(search, "low", **place, vendor_status=status))
    )
    tagged_rows = df.withColumn("_r", F.when(q != "", result)).select(*queries.columns, "_r.*")
    sure = c("confidence") == "high"
    immediate = (
        F.when(c("intent").isNull(), False)
        .when((c("intent") == "code_lookup") & (c("confidence") != "low"), True)
        .when(c("tax_id").isNotNull(), False)
        .when(c("country").isNotNull() & c("trading_name").isNotNull(), True)
        .otherwise(sure & c("country").isNotNull())
    )
    return tagged_rows.withColumn("immediate", F.coalesce(immediate, F.lit(False)))


def normalise_country(col: Column) -> Column:
    """Country of a parsed query: a two letter code, or a spoken name, else null."""
    text = T.strip(col)
    spoken = F
    for name, iso2 in C.COUNTRY_ALIASES.items():
        spoken = spoken.when(F.lower(text) == name, F.lit(iso2))
    return F.when(text.rlike("^[A-Za-z]{2}$"), F.upper(text)).otherwise(spoken.otherwise(F.lit(None).cast("string")))
