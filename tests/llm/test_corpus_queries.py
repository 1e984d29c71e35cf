"""Registered corpus queries over whole small tables: against SQL, or against plain Python where SQL has no words for them."""

import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from entityops.llm import privacy
from entityops.llm.queries import ORACLES, QUERIES, jaccard_sql

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables are not on this machine")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "pages", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_number_has_a_query():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, tables, name):
    result = QUERIES[name](spark, SF_DIR)
    found = tables.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(result.columns) == sorted(names)
    assert sorted(str(tuple(r[n] for n in names)) for r in result.collect()) == sorted(map(str, found.fetchall()))


def test_predictions_of_held_out_documents(spark, tables):
    lang = dict(tables.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = QUERIES["op1_language_id"](spark, SF_DIR).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    quality = dict(tables.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = QUERIES["op3_mil_quality"](spark, SF_DIR).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    known = [r for r in rows if r.doc_id in quality]
    assert sum(r.predicted == quality[r.doc_id] for r in known) >= 0.9 * len(known)


def plain_words(text):
    marks = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
    return [x for x in (w.strip(marks).lower() for w in re.split("[ \t\n\x0b\x0c\r]+", text)) if x]


def leaking(texts, items):
    """Documents with 13 successive words, or the whole of a shorter item, of a benchmark item."""
    runs = {tuple(w[i : i + 13]) for w in map(plain_words, items) for i in range(max(1, len(w) - 12))}
    sizes = {len(r) for r in runs}
    out = set()
    for doc, text in texts.items():
        w = plain_words(text or "")
        if any(tuple(w[i : i + n]) in runs for n in sizes for i in range(len(w) - n + 1)):
            out.add(doc)
    return out


def test_leaks_of_the_tables(spark, tables):
    texts = dict(tables.execute("SELECT doc_id, text FROM documents").fetchall())
    items = [t for (t,) in tables.execute("SELECT text FROM benchmark").fetchall()]
    assert {r.doc_id for r in QUERIES["op8_decontaminate"](spark, SF_DIR).collect()} == leaking(texts, items)


def test_licenses_of_the_tables(spark, tables):
    texts = dict(tables.execute("SELECT doc_id, text FROM documents").fetchall())
    lines = {"Apache-2.0": "Licensed under the Apache License, Version 2.0", "MIT": "Released under the MIT License", "Rights reserved": "All rights reserved", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3"}
    want = {(d, k, m.start()) for d, t in texts.items() for k, line in lines.items() for m in re.finditer(re.escape(line), t or "")}
    assert {(r.doc_id, r.license, r.begin) for r in QUERIES["op5_license_scan"](spark, SF_DIR).collect() if not r.n_differences} == want


def masked(text):
    return re.sub("|".join(f"(?:{p})" for p in (privacy.EMAIL, privacy.IPV4, r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\b\d{16}\b", r"\bAKIA[A-Z0-9]{16}\b", r"password=\S{6,}", r"\b[0-9a-f]{40}\b")), "@", text)


def test_private_data_of_the_tables(spark, tables):
    texts = dict(tables.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = QUERIES["op2_privacy_surrogates"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        old = texts[row.doc_id]
        assert masked(row.text) == masked(old) and (row.n_entities > 0) == (masked(old) != old) == (row.text != old)


def test_pipeline_against_plain_python(spark, tables):
    """The stages one by one in Python and SQL; texts are compared without the surrogates themselves."""
    docs = tables.execute("SELECT doc_id, text, source FROM documents").fetchall()
    kept = {r[0] for r in tables.execute(f"SELECT doc_id FROM ({ORACLES['op7_quality_rules']}) WHERE kept").fetchall()}
    texts = {d: t for d, t, _ in docs if d in kept}  # no line of these small hosts is above the limit of eleven documents
    left = duckdb.connect()
    left.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    left.executemany("INSERT INTO documents VALUES (?, ?)", list(texts.items()))
    single = [d for d, _, c in sorted((r[0], r[1], r[2]) for r in left.execute(jaccard_sql(5, 80)).fetchall()) if d == c]
    texts = {d: texts[d] for d in single}
    items = [t for (t,) in tables.execute("SELECT text FROM benchmark").fetchall()]
    gone = leaking(texts, items)
    texts = {d: t for d, t in texts.items() if d not in gone}
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    from entityops.llm.byte_bpe import _encoder
    from entityops.llm.queries import byte_vocabulary

    library = _encoder(byte_vocabulary())
    for row in rows:
        ids = np.frombuffer(row.ids, "<u4").tolist()
        text = library.decode(ids)
        assert masked(text) == masked(texts[row.doc_id]) and library.encode_ordinary(text) == ids and len(ids) == row.n_tokens
        assert row.ids_sha256 == hashlib.sha256(row.ids).hexdigest() and row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert [name for name, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
