"""Registered queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from entityops import constants as C
from entityops.operators import corpus as K
from entityops.plans import jobs, sql
from entityops.plans.registry import query

_SNIPPETS = [
    "GSTIN and Registration Certificate", "Permanent Account Number", "aadhaar", "ifsc cancelled MICR", "udyam", "certificate of incorporation",
    "", "gstin permanent account number", "utility bill",
]
_FILES = ["scan.pdf", "PAN-card.jpg", "my-utility.pdf", "gst_cert-1.pdf"]


def tagged_documents(t):
    """Documents with an official phrase behind their text, a file name and a sender's hint."""
    key = F.col("doc_id")

    def pick(items, by):
        return F.element_at(F.array(*[F.lit(x) for x in items]), (by % len(items) + 1).cast("int"))

    return t.documents.select(
        "doc_id", F.concat_ws("\n", "text", pick(_SNIPPETS, key)).alias("text"), pick(_FILES, F.floor(key / 9)).alias("filename"),
        F.when(key % 13 == 0, " in_iec_certificate").when(key % 13 == 1, "GB_X").alias("hint"),
    )


def _tagged_sql():
    snippets, files = ", ".join(map(sql.quote, _SNIPPETS)), ", ".join(map(sql.quote, _FILES))
    return f"""docs AS (SELECT doc_id, lower(concat_ws(chr(10), text, [{snippets}][doc_id % {len(_SNIPPETS)} + 1])) AS low,
  replace(lower([{files}][doc_id // 9 % {len(_FILES)} + 1]), '-', '_') AS file, CASE doc_id % 13 WHEN 0 THEN 'IN_IEC_CERTIFICATE' WHEN 1 THEN 'GB_X' END AS hint FROM documents)"""


def _anchor_sql(anchors):
    rows = [(d, p, w) for p, (d, words) in enumerate(anchors.items()) for w in words]
    return f"""hits AS (SELECT doc_id, a.d AS d, a.p AS p, count(*) AS n FROM docs JOIN {sql.values(rows, 'a(d, p, w)')} ON contains(low, lower(a.w)) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rn, n - coalesce(lead(n) OVER (PARTITION BY doc_id ORDER BY n DESC, p), 0) AS gap FROM hits),
top AS (SELECT doc_id, d AS ad, n, gap, gap >= 1 AS clear, CASE WHEN gap >= 1 THEN least(0.99::DOUBLE, 0.6::DOUBLE + 0.15::DOUBLE * n) ELSE 0.5::DOUBLE END AS ac FROM ranked WHERE rn = 1)"""


def _any_sql(words):
    return "(" + " OR ".join(f"contains(low, {sql.quote(w)})" for w in words) + ")"


_HINTS = " ".join(f"WHEN {' OR '.join(f'contains(file, {sql.quote(w)})' for w in words)} THEN {sql.quote(d)}" for d, words in C.FILENAME_HINTS.items())


@query(
    "agg_17_classify_corpus",
    f"""WITH {_tagged_sql()}, {_anchor_sql(C.ANCHORS)}, named AS (SELECT doc_id, CASE WHEN f = 'IN_PAN_CARD' AND {_any_sql(C.NATIONAL_ID_MARKERS)} AND NOT {_any_sql(C.PAN_MARKERS)}
    THEN 'IN_ADDRESS_PROOF' ELSE f END AS f, starts_with(hint, 'IN_') AS h, hint FROM (SELECT *, CASE {_HINTS} END AS f FROM docs))
SELECT n.doc_id, CASE WHEN h THEN hint ELSE coalesce(f, ad) END AS doc_type,
  greatest(coalesce(ac, 0), CASE WHEN f IS NOT NULL THEN 0.8::DOUBLE ELSE 0 END, CASE WHEN h THEN 0.85::DOUBLE ELSE 0 END) AS confidence,
  NOT coalesce(clear, false) AND f IS NULL AND NOT coalesce(h, false) AS ambiguous FROM named n LEFT JOIN top t ON n.doc_id = t.doc_id""",
)
def classify_corpus(t):
    return K.classify_corpus(tagged_documents(t), filename="filename", hint="hint").select("doc_id", "doc_type", "confidence", "ambiguous")


@query(
    "agg_17_classify_corpus_us",
    f"""WITH {_tagged_sql()}, {_anchor_sql(C.LOCALE_ANCHORS['US'])} SELECT d.doc_id, ad AS doc_type, coalesce(ac, 0) AS confidence, NOT coalesce(clear, false) AS ambiguous
FROM docs d LEFT JOIN top t ON d.doc_id = t.doc_id""",
)
def classify_us(t):
    return K.classify_corpus(tagged_documents(t), country="US").select("doc_id", "doc_type", "confidence", "ambiguous")


@query(
    "win_5_runner_up_gap",
    f"WITH {_tagged_sql()}, {_anchor_sql(C.ANCHORS)} SELECT doc_id, gap AS runner_up_gap FROM top",
)
def runner_up_gap(t):
    return K.classify_corpus(tagged_documents(t)).where("runner_up_gap IS NOT NULL").select("doc_id", F.col("runner_up_gap").cast("long").alias("runner_up_gap"))


@query(
    "prj_17_redact",
    r"""SELECT doc_id, '<redacted>' AS text, n_chars, regexp_replace(concat(source, ' ABCPD', lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0'), 'F ', 'x', text),
  '\b([A-Z]{5}[0-9]{4}[A-Z]|[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z])\b', '<id>', 'g') AS note FROM documents""",
)
def redact(t):
    rows = t.documents.select(
        "doc_id", "text", "n_chars",
        F.concat(F.col("source"), F.lit(" ABCPD"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit("F x"), F.col("text")).alias("note"),
    )
    return K.redact(rows)


def enriched_pages(t):
    """Pages, a part of them with Open Graph tags or structured data in front."""
    key = F.col("page_id")
    number = key.cast("string")
    org = F.concat(
        F.lit('<script type="application/ld+json">[{"@type": "WebSite"}, {"@type": "Organization", "name": "Org '), number,
        F.lit('", "address": {"streetAddress": "Road 1", "addressLocality": "Town", "postalCode": "'), number, F.lit('"}}]</script>'),
    )
    site = F.concat(F.lit('<META name="x" property="og:site_name" data-a="b" content="Site &amp; Co  '), number, F.lit('">'))
    front = (
        F.when(key % 5 == 0, org).when(key % 5 == 1, site).when(key % 5 == 2, F.lit('<script type="application/ld+json">{broken</script>'))
        .when(key % 5 == 3, F.lit("<meta name='description' content='All <b>about</b> us'>")).otherwise(F.lit(""))
    )
    url = F.when(key % 7 == 0, F.regexp_replace("url", "^https?://", " ")).otherwise(F.col("url"))
    return t.pages.select("page_id", url.alias("url"), F.concat(front, F.col("html")).alias("html"))


_PAGES = r"""p AS (SELECT page_id AS id, CASE WHEN page_id % 7 = 0 THEN concat('https://', regexp_replace(url, '^https?://', '')) ELSE url END AS url, html FROM pages),
t AS (SELECT *, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>([^<]+)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM p)"""


@query(
    "prj_18_page_signals",
    rf"""WITH {_PAGES} SELECT id AS page_id, url, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, nullif(title, '') AS title,
  CASE WHEN id % 5 = 1 THEN concat('Site & Co ', id) END AS site_name, CASE WHEN id % 5 = 0 THEN concat('Org ', id) END AS org_name, CASE WHEN id % 5 = 0 THEN 'Town' END AS city,
  CASE WHEN id % 5 = 0 THEN CAST(id AS VARCHAR) END AS postal_code, CASE WHEN id % 5 = 3 THEN 'All about us' END AS description,
  CASE WHEN id % 5 = 0 THEN concat('Org ', id) WHEN id % 5 = 1 THEN concat('Site & Co ', id) ELSE title END AS name
FROM t WHERE title <> '' OR id % 5 IN (0, 1)""",
)
def page_signals(t):
    return K.page_signals(enriched_pages(t)).select(
        "page_id", "url", "host", F.nullif("title", F.lit("")).alias("title"), "site_name", "org_name", "city", "postal_code", "description", "name"
    )


# --- query intent: the oracle is generated from the same word lists --------------------------

def _has(words: list[str]) -> str:
    return f"regexp_matches(q, {sql.quote('(?i)' + chr(92) + 'b(' + '|'.join(words) + ')' + chr(92) + 'b')})"


def _alias_sql(table: dict[str, str]) -> str:
    arms = " ".join(f"WHEN {_has([a])} THEN {sql.quote(v)}" for a, v in sorted(table.items(), key=lambda kv: -len(kv[0])))
    return f"CASE {arms} END"


def _capture_sql(patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(q, {sql.quote('(?i)' + p)}, 1), '')" for p in patterns) + ")"


def _strip_alias(text: str, value: str, table: dict[str, str]) -> str:
    by_value: dict[str, list[str]] = {}
    for alias, v in table.items():
        by_value.setdefault(v, []).append(alias)
    arms = []
    for v, aliases in by_value.items():
        body = text
        for a in aliases:
            body = f"regexp_replace({body}, {sql.quote('(?i)' + chr(92) + 'b' + a + chr(92) + 'b')}, ' ', 'g')"
        arms.append(f"WHEN {sql.quote(v)} THEN {body}")
    return f"CASE {value} {' '.join(arms)} ELSE {text} END"


_ISO = "[" + ", ".join(map(sql.quote, C.KNOWN_ISO2)) + "]"
_DROP = "[" + ", ".join(map(sql.quote, C.STOP_WORDS + list(C.CITY_ALIASES))) + "]"
_STATUS_ARMS = " ".join(f"WHEN {_has([w])} THEN {sql.quote(w.upper())}" for w in C.STATUS_WORDS)


@query(
    "prj_21_tag_query_intent",
    rf"""WITH base AS (SELECT query_id, trim(query) AS q FROM v_queries),
a AS (SELECT *, CASE WHEN {_has(['erp'])} THEN {_capture_sql(C.ERP_CODE_PATTERNS)} END AS erp, {_capture_sql(C.BP_CODE_PATTERNS)} AS bp,
    CASE WHEN regexp_matches(q, '^\d{{4,10}}$') THEN q END AS bare, nullif(regexp_extract(q, '(?i)\b([A-Z]{{2}}\d{{5,}})\b', 1), '') AS vraw,
    {_alias_sql(C.COUNTRY_ALIASES)} AS calias, {_alias_sql(C.CITY_ALIASES)} AS city, CASE {_STATUS_ARMS} END AS status,
    {_has(C.WORKFLOW_PHRASES)} AS wf, {_has(C.DRAFT_PATTERNS)} AS dr, regexp_matches(q, {sql.quote('(?is)' + C.LIST_ALL)}) AS la,
    upper(list_filter(regexp_extract_all(q, '(?i)\b[A-Z0-9]{{8,}}\b'), lambda x: regexp_matches(x, '\d'))[1]) AS traw FROM base),
b AS (SELECT *, upper(vraw) AS vendor, vraw IS NOT NULL AND length(trim(concat(substr(q, 1, instr(q, vraw) - 1), substr(q, instr(q, vraw) + length(vraw))))) < 4 AS vonly,
    coalesce(calias, CASE WHEN list_contains({_ISO}, upper(regexp_extract(q, '(?i)\b(?:in|country)\s+([A-Za-z]{{2}})\b', 1))) THEN upper(regexp_extract(q, '(?i)\b(?:in|country)\s+([A-Za-z]{{2}})\b', 1)) END,
      list_filter(regexp_extract_all(upper(q), '\b([A-Z]{{2}})\b'), lambda x: list_contains({_ISO}, x) AND x <> coalesce(upper(substr(vraw, 1, 2)), ''))[1]) AS country,
    CASE WHEN traw IS DISTINCT FROM upper(vraw) THEN traw END AS tax FROM a),
w1 AS (SELECT *, CASE WHEN vendor IS NOT NULL THEN regexp_replace(q, concat('(?i)', vendor), ' ', 'g') ELSE q END AS w FROM b),
w2 AS (SELECT * REPLACE (CASE WHEN tax IS NOT NULL THEN regexp_replace(w, concat('(?i)', tax), ' ', 'g') ELSE w END AS w) FROM w1),
w3 AS (SELECT * REPLACE ({_strip_alias('w', 'city', C.CITY_ALIASES)} AS w) FROM w2),
w4 AS (SELECT * REPLACE ({_strip_alias('w', 'country', C.COUNTRY_ALIASES)} AS w) FROM w3),
w5 AS (SELECT * REPLACE (CASE WHEN country IS NOT NULL THEN regexp_replace(w, concat('(?i)\b', country, '\b'), ' ', 'g') ELSE w END AS w) FROM w4),
w6 AS (SELECT * REPLACE (regexp_replace(regexp_replace(w, '(?i)\b({'|'.join(C.STATUS_WORDS)})\b', ' ', 'g'), {sql.quote('(?is)' + C.LIST_ALL)}, ' ', 'g') AS w) FROM w5),
n AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(w, '[\s,;]+'), lambda x: x <> '' AND NOT list_contains({_DROP}, lower(x))), ' ') AS nm FROM w6),
f AS (SELECT *, CASE WHEN length(nm) >= 3 THEN nm END AS name FROM n),
o AS (SELECT *, CASE WHEN coalesce(erp, bp, bare) IS NOT NULL THEN 1 WHEN vonly THEN 2 WHEN country IS NOT NULL AND wf THEN 3 WHEN country IS NOT NULL AND dr AND (la OR name IS NULL) THEN 4
    WHEN country IS NOT NULL AND (la OR (status IS NOT NULL AND name IS NULL)) THEN 5 WHEN tax IS NOT NULL AND country IS NOT NULL THEN 6 WHEN tax IS NOT NULL THEN 7
    WHEN name IS NOT NULL AND country IS NOT NULL THEN 8 WHEN name IS NOT NULL THEN 9 WHEN country IS NOT NULL THEN 10 END AS k FROM f),
r AS (SELECT query_id, k, CASE WHEN k <= 2 THEN 'code_lookup' WHEN k > 2 THEN 'attribute_search' END AS intent, CASE WHEN k IN (3, 4, 5, 6, 8, 10) THEN country END AS country,
    CASE WHEN k IN (3, 4, 5, 6, 8, 9, 10) THEN city END AS city, CASE WHEN k = 3 THEN coalesce(status, 'PENDING') WHEN k IN (4, 5, 8, 9, 10) THEN status END AS vendor_status,
    CASE WHEN k = 3 THEN true END AS in_workflow, CASE WHEN k IN (3, 4) THEN true END AS has_draft, CASE WHEN k IN (6, 7) THEN tax END AS tax_id,
    CASE k WHEN 1 THEN CASE WHEN coalesce(erp, bp) IS NOT NULL THEN lpad(coalesce(erp, bp), greatest(10, length(coalesce(erp, bp)))::INT, '0') ELSE bare END WHEN 2 THEN vendor END AS code,
    CASE WHEN k = 1 THEN CASE WHEN erp IS NOT NULL THEN 'ERP_VNDR_CD' WHEN bp IS NOT NULL THEN 'S4_BP_VNDR_CD' END END AS code_type,
    CASE WHEN k IN (6, 7, 8, 9) THEN name END AS trading_name,
    CASE WHEN k = 1 THEN CASE WHEN {_has(C.CODE_MARKERS)} THEN 'high' ELSE 'medium' END WHEN k BETWEEN 2 AND 8 THEN 'high' WHEN k = 9 THEN CASE WHEN contains(name, ' ') THEN 'medium' ELSE 'low' END
      WHEN k = 10 THEN 'low' END AS confidence FROM o)
SELECT * EXCLUDE (k), k IS NOT NULL AND (k <= 2 OR (tax_id IS NULL AND ((country IS NOT NULL AND trading_name IS NOT NULL) OR (confidence = 'high' AND country IS NOT NULL)))) AS immediate FROM r""",
    ("v_queries",),
)
def tag_query_intent(t):
    return K.tag_query_intent(t.v_queries()).drop("query")


@query(
    "prj_21_intent_counts_of_conversations",
    None,
)
def intents_of_conversations(t):
    """How often each intent occurs among the turns of the conversations (whole texts)."""
    tagged = K.tag_query_intent(t.conversations.select("conv_id", "turn", F.col("text").alias("query")))
    return tagged.groupBy("intent", "confidence", "immediate").agg(F.count(F.lit(1)).alias("turns"))


@query(
    "job_5_corpus_profile",
    f"""WITH {_tagged_sql()}, {_anchor_sql(C.ANCHORS)}, firsts AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents),
mails AS (SELECT doc_id, count(*) AS emails FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) WHERE regexp_matches(word, '{C.EMAIL}') GROUP BY doc_id)
SELECT d.source, d.lang, coalesce(t.ad, 'none') AS doc_type, count(*) AS documents, count(*) FILTER (first_id <> d.doc_id) AS copies,
  CAST(sum(coalesce(emails, 0)) AS BIGINT) AS emails FROM documents d LEFT JOIN top t ON d.doc_id = t.doc_id JOIN firsts f ON d.doc_id = f.doc_id LEFT JOIN mails m ON d.doc_id = m.doc_id
GROUP BY ALL""",
)
def corpus_profile(t):
    snippet = F.element_at(F.array(*[F.lit(x) for x in _SNIPPETS]), (F.col("doc_id") % len(_SNIPPETS) + 1).cast("int"))
    documents = t.documents.withColumn("tagged", F.concat_ws("\n", "text", snippet))
    return jobs.corpus_profile(documents, text="text", classify_text="tagged")
