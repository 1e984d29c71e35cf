"""Registered queries of the corpus operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityops.llm import byte_bpe, conversations, decontaminate, html_blocks, jaccard_join, language, license_scan, mil_quality, mixing, periodic_runs, privacy, quality_rules, token_files
from entityops.llm.storage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS five
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
ln AS (SELECT doc_id, host, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line,
              len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw
       FROM (SELECT doc_id, host, unnest(lines) AS line FROM w)),
freq AS (SELECT host, line, min(doc_id) AS owner FROM ln GROUP BY host, line HAVING count(DISTINCT doc_id) > 10),
gone AS (SELECT doc_id, sum(nw) AS gone FROM ln JOIN freq USING (host, line) WHERE doc_id <> owner GROUP BY 1),
s AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.gone, 0) AS gone
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (gone > 0 AND (n_words - gone < 10 OR 100 * (n_words - gone) < 20 * n_words)) AS kept
FROM b"""


@query("op7_quality_rules", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and the verdict of line frequency for every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_decontaminate")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified overlaps of documents with benchmark items."""
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def jaccard_sql(width: int, percent: int) -> str:
    """Components of documents by shingles of ``width`` words."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(words, i, greatest(i + {width - 1}, least(len(words), {width}))) AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {width - 2}, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
          JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
reach AS (SELECT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.low, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY 1) m ON m.doc_id = w.doc_id"""


@query("op9_jaccard_join", jaccard_sql(4, 85))
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles are alike."""
    return jaccard_join.join_components(_read(spark, sf_dir, "documents"))


#: The key of the registered query; a job passes its own secret.
DEMO_KEY = "surrogate key of the registered query"


@query("op2_privacy_surrogates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with surrogates, and what was replaced."""
    out = privacy.replace_entities(_read(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return out.select("doc_id", F.size("entities").alias("n_entities"), F.array_join(F.transform("entities", lambda e: e["kind"]), ",").alias("kinds"), "text")


def byte_vocabulary() -> byte_bpe.Vocabulary:
    return byte_bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the bytes they decode to, as digests."""
    back = byte_bpe.encode(_read(spark, sf_dir, "documents"), byte_vocabulary(), decoded=True)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every text and reads the files back."""
    path = f"{shared_folder(spark)}/tokens"
    token_files.write(_read(spark, sf_dir, "documents"), path, token_files.Format(public_tokenizers.path("word_bpe_49k.json")))
    return token_files.read(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, by prototypes of the documents that are not held out."""
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(language.held_out(F.col("doc_id"), 4, 2), F.lit(False)))
    prototypes = language.fit(docs.where(~F.col("held_out")))
    return language.predict(docs.select("doc_id", "held_out", "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")


@query("op3_mil_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from the labels that are not held out."""
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    out = F.coalesce(language.held_out(F.col("doc_id"), 5, 0), F.lit(False))
    model = mil_quality.fit(docs, labels.where(~out))
    scored = mil_quality.score(docs.withColumn("held_out", out), model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed license notices with their exact differences from the template."""
    found = license_scan.scan(_read(spark, sf_dir, "documents"))
    return found.withColumn("differences", F.array_join("differences", " "))


@query("op10_html_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _read(spark, sf_dir, "pages")
    model = html_blocks.fit(pages)
    return html_blocks.main_text(pages.select("page_id", "url", "html"), model).drop("html")


WORDS = "[\\x20\\x09-\\x0D]+"


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where the CRC-32 of the id ends in 0, the words from one place on repeat a stretch of them."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(crc % 10 == 0, F.filter(F.split("text", WORDS), lambda w: w != ""))
    some = docs.select("doc_id", "text", words.alias("words"), F.floor(crc / 10).alias("g"))
    some = some.withColumns({"n": F.size("words"), "first": F.when(F.size("words") > 0, F.col("g") % F.size("words"))})
    some = some.withColumn("period", 1 + F.floor((F.col("n") - F.col("first")) / (3 + F.col("g") % 8)))
    moved = F.transform("words", lambda w, i: F.when(i < F.col("first"), w).otherwise(F.get("words", (F.col("first") + (i - F.col("first")) % F.col("period")).cast("int"))))
    return some.select("doc_id", F.when(F.col("n") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text after repeats were planted, the longest of them, and digests of runs and collapsed texts."""
    found = periodic_runs.find_runs(with_planted_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.less")
    return rows.select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
p AS (SELECT *, sum(source_size) OVER before AS s_before, sum(w) OVER before AS w_before, sum(source_size) OVER () AS s_all, sum(w) OVER () AS w_all
      FROM s WINDOW before AS (ORDER BY source_size * 10 // w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 200 * source_size * (w_all - coalesce(w_before, 0)) <= (150 * s_all - 200 * coalesce(s_before, 0)) * w AS cut FROM p),
l AS (SELECT *, (150 * s_all - 200 * coalesce(sum(source_size) FILTER (cut) OVER (), 0)) * w AS shared, 100 * coalesce(sum(w) FILTER (NOT cut) OVER (), 1) AS unit FROM c),
t AS (SELECT source, source_size, CASE WHEN cut THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(shared AS DOUBLE) / CAST(unit AS DOUBLE) END AS target,
             CASE WHEN cut THEN 2 * source_size ELSE shared // unit END AS budget FROM l),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.budget, CASE WHEN t.source_size > 0 THEN t.budget // t.source_size ELSE 0 END AS epochs,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.size), d.doc_id, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM o"""


@query("op13_mix_sources", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of every document."""
    return mixing.mix_plan(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows dropped, emptied, cut, repeated or given to the user, by the CRC-32 of id and turn."""
    number = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    copies = F.when(number == 0, 0).when(number == 3, 2).otherwise(1)
    return turns.select(
        "conv_id",
        "turn",
        F.when(number == 4, "user").otherwise(role).alias("role"),
        F.when(number == 1, "").when(number == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the digest of every conversation after rows were damaged."""
    turns = _read(spark, sf_dir, "conversations")
    repaired = conversations.repair(damaged(turns))
    found = repaired.summary.join(conversations.text_digests(repaired.turns).withColumnRenamed("conv_id", "_d"), F.col("conv_id").eqNullSafe(F.col("_d")), "left").drop("_d")
    ids = turns.select(F.col("conv_id").alias("_id")).distinct()
    rows = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return rows.select(
        F.col("_id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
