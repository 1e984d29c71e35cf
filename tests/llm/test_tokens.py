"""Token operators against the tokenizer libraries, and stores read back."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from entityops.llm import byte_bpe, token_files
from entityops.llm.queries import byte_vocabulary

WORD_PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None,
    "",
    " ",
    "Hello, world!! It's the end... don't\t stop now  x",
    "Größe ÀÉ é İ ΟΔΟΣ İstanbul ǅ 中文字 12345 ½ ⅷ 🙂🙂 ́start",
    "a" * 3000 + " " + "ab1" * 500,
    "<|endoftext|> and <|startoftext|>.",
    "x\x1cy \x1d !\x1e! \x85 ﻿z  \n\n\n  tail   ",
    "word, word. WORD! (word) 'word' word's. 'sword's,",
]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, frame string, block string")


def rows_of(texts):
    return [(i, t, "x", None, "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(spark, reference):
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choices("ab cé中🙂.,'st\n 1", k=rng.randint(0, 80))) for _ in range(60)]
    table = docs(spark, rows_of(texts) + [(3, TEXTS[3], "", "", ""), (None, "no id", "", "", "")])
    encoded = byte_bpe.encode(table, byte_vocabulary(), decoded=True)
    got = encoded.collect()
    assert len(got) == len(texts) + 2
    for row in got:
        text = "no id" if row.doc_id is None else texts[row.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert np.frombuffer(row.ids, "<u4").tolist() == ids and row.n_tokens == len(ids) and bytes(row.decoded) == text.encode()
    again = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(encoded.drop("decoded"), byte_vocabulary()).collect()}
    assert again == {r.doc_id: bytes(r.decoded) for r in got}
    assert byte_bpe.encode(table.limit(0), byte_vocabulary()).count() == 0


def test_batches_closed_by_bytes(spark, reference, tmp_path):
    """Blocks of one number hold the same rows in both scans, also where Spark closes batches by their bytes."""
    rng = random.Random(3)
    texts = {f"document number {i:06d}": "".join(rng.choices("ab cd e.", k=rng.randint(0, 300))) for i in range(400)}
    spark.createDataFrame(list(texts.items()), "doc_id string, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4096")
    try:
        got = byte_bpe.encode(spark.read.parquet(f"{tmp_path}/docs"), byte_vocabulary(), decoded=True).collect()
    finally:
        spark.conf.set(name, before)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == {k: reference.encode_ordinary(t) for k, t in texts.items()}
    assert len(got) == len(texts) and all(bytes(r.decoded) == texts[r.doc_id].encode() for r in got)


def test_each_word_is_encoded_in_one_place(spark):
    table = docs(spark, rows_of(["the cat", "the dog the", "a cat"])).repartition(3)
    rows = byte_bpe.dictionary_rows(table, "text", public_tokenizers.PATTERN).collect()
    assert len(rows) == len({(r.block, r.word) for r in rows}) and {r.word for r in rows} == {"the", " cat", " dog", " the", "a"}


def test_unknown_ids_are_an_error(spark):
    bad = spark.createDataFrame([(1, bytearray(np.array([60000], "<u4").tobytes()))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="token-byte table"):
        byte_bpe.decode(bad, byte_vocabulary()).collect()


def expected(texts):
    tokenizer = Tokenizer.from_file(WORD_PATH)
    tokenizer.encode_special_tokens = True
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]


def test_store_reads_back(spark, tmp_path):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choices(["The", "cat,", "été", "sat.", "x1!", " odd"], k=rng.randint(0, 400))) for _ in range(60)]
    rows = rows_of(texts)
    rng.shuffle(rows)
    form = token_files.Format(WORD_PATH, block_bytes=600)
    token_files.write(docs(spark, rows), str(tmp_path), form, shards=5)
    ids = expected(texts)
    starts = np.cumsum([0, *map(len, ids)])
    got = sorted(token_files.read(spark, str(tmp_path)).collect())
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got] == [
        (i, int(starts[i]), len(x), zlib.crc32(x.tobytes()), x.tobytes()) for i, x in enumerate(ids)
    ]
    few = sorted(token_files.read(spark, str(tmp_path), [3, 40, 4000]).collect())
    assert [(r.doc_id, r.start) for r in few] == [(3, int(starts[3])), (40, int(starts[40]))]
    blocks = spark.read.parquet(f"{tmp_path}/blocks")
    assert blocks.count() > 5 and {len(r["counts"]) == len(r["offsets"]) for r in blocks.collect()} == {True}


def test_store_of_odd_tables(spark, tmp_path):
    form = token_files.Format(WORD_PATH)
    token_files.write(docs(spark, []), f"{tmp_path}/none", form)
    assert token_files.read(spark, f"{tmp_path}/none").count() == 0
    rows = [(7, "b", "", "", ""), (None, "a", "", "", ""), (7, "b", "", "", ""), (7, None, "", "", ""), (-5, "c c", "", "", "")]
    token_files.write(docs(spark, rows), f"{tmp_path}/odd", form, shards=3)
    got = token_files.read(spark, f"{tmp_path}/odd").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -5, 7, 7, 7] and [r.start for r in got] == [0, 2, 5, *np.cumsum([r.n_tokens for r in got[2:4]]) + 5]
    assert sorted(r.n_tokens for r in got) == [1, 2, 2, 2, 3]


def test_changed_dictionary_is_noticed(spark, tmp_path):
    token_files.write(docs(spark, rows_of(["a b c"] * 20)), str(tmp_path / "a"), token_files.Format(WORD_PATH))
    head = spark.read.parquet(f"{tmp_path}/a/dictionary").first()
    spark.createDataFrame([(head["hash"], bytearray(b"other bytes"), head["width"])], "hash string, data binary, width int").write.parquet(f"{tmp_path}/b/dictionary")
    spark.read.parquet(f"{tmp_path}/a/blocks").write.parquet(f"{tmp_path}/b/blocks")
    with pytest.raises(ValueError, match="hash"):
        token_files.read(spark, f"{tmp_path}/b")
