"""Wavelet-matrix files: every question against the plain list, whole tables against the plain tokenizer."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from provider_analytics.llm import wavelet
from provider_analytics.llm.queries import END_ID, QUERIES, tokenizer_path

SCHEMA = "doc_id bigint, text string, id string, start int, file string"


def file_of(tokens):
    documents = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([len(tokens)], pa.int64())], ["id", "tokens"])
    return wavelet.WaveletFile(wavelet.build(np.array(tokens, np.uint32), documents))


@pytest.mark.parametrize("n, top", [(1, 0), (1, 1), (7, 3), (500, 1), (3000, 49_407), (200_000, 300), (70_000, 1 << 20)])
def test_against_a_list(n, top):
    rng = np.random.default_rng(n)
    tokens = np.minimum(rng.zipf(1.3, n), top).tolist()
    file = file_of(tokens)
    assert file.all_tokens().tolist() == tokens and file.tokens == n
    for place in {0, n - 1, *rng.integers(0, n, 20).tolist()}:
        assert file.access(place) == tokens[place]
    for token in {tokens[0], tokens[-1], 0, top, top + 1, *rng.choice(tokens, 4).tolist()}:
        places = [i for i, t in enumerate(tokens) if t == token]
        assert file.count(token) == len(places) and file.occurrences(token).tolist() == places
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert file.count(token, a, b) == sum(a <= p < b for p in places)
        for k in {0, len(places) - 1, len(places) // 2} if places else ():
            assert file.occurrence(token, k) == places[k]
        with pytest.raises(IndexError):
            file.occurrence(token, len(places))
    with pytest.raises(IndexError):
        file.access(n)


def test_questions_open_few_blocks():
    file = file_of(np.random.default_rng(2).integers(0, 1000, 1_000_000))
    opened = []
    read = file._read_block
    file._block = lambda plane, block: opened.append((plane, block)) or read(plane, block)
    file.access(777_777)
    assert len(set(opened)) == file.levels


def test_empty_and_foreign():
    assert file_of([]).all_tokens().tolist() == [] and file_of([]).count(0) == 0
    with pytest.raises(ValueError):
        wavelet.WaveletFile(b"something else")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [None, "", " ", "one two", "é ß 日本語 <|endoftext|> x", "z" * 5000] + [
        " ".join(rng.choice(["the", "of", "Cat.", "don't", "12,5"]) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    out = [(i * 7 % len(texts), t, "x", 1, "f") for i, t in enumerate(texts)]
    return out + [(None, "no id", "x", 1, "f"), (None, "a", "x", 1, "f"), (3, "again", "x", 1, "f")] + [(5, "same", "x", 1, "f")] * 30


@pytest.mark.parametrize("shard_tokens", [1, 300, 1 << 20])
def test_files(spark, rows, shard_tokens):
    plain = Tokenizer.from_file(tokenizer_path())
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    files = wavelet.write_shards(docs, tokenizer_path(), END_ID, shard_tokens=shard_tokens)
    held = sorted(files.collect(), key=lambda r: r.shard)
    assert [f.shard for f in held] == list(range(len(held)))
    assert [f.start for f in held] == np.cumsum([0, *(f.tokens for f in held)])[:-1].tolist()
    found = sorted(wavelet.read_documents(files).collect(), key=lambda r: (r.start, r.tokens))
    ids = lambda t: plain.encode(t or "", add_special_tokens=False).ids + [END_ID]
    want = {}
    for d, t, *_ in rows:
        want.setdefault(d, []).append(np.array(ids(t), "<u4").tobytes())
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append(bytes(r.ids))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert [r.doc_id for r in found] == sorted((d for d, *_ in rows), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in found] == np.cumsum([0, *(r.tokens for r in found)])[:-1].tolist()

    the = ids("the")[0]
    want_places = sorted((d or -1, i) for d, t, *_ in rows for i, x in enumerate(ids(t)) if x == the)
    assert sorted((r.doc_id or -1, r.place) for r in wavelet.find_token(files, the).collect()) == want_places
    counts = {r.token: r.occurrences for r in wavelet.count_tokens(files, [the, END_ID, 1 << 30]).collect()}
    assert counts == {the: len(want_places), END_ID: len(rows) + sum(ids(t)[:-1].count(END_ID) for _, t, *_ in rows), 1 << 30: 0}


def test_other_ids_and_empty(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "y z"), (None, None)], "key string, body string")
    found = wavelet.read_documents(wavelet.write_shards(docs, tokenizer_path(), None, "key", "body"), "key").orderBy("start", "tokens").collect()
    assert [(r.key, r.tokens) for r in found] == [(None, 0), ("a", 2), ("b", 1)]
    files = wavelet.write_shards(spark.createDataFrame([], SCHEMA), tokenizer_path(), END_ID)
    assert files.collect() == [] and wavelet.read_documents(files).collect() == []


def test_query(spark, rows, tmp_path):
    plain = Tokenizer.from_file(tokenizer_path())
    own = {d: t for d, t, *_ in rows if d is not None}  # one row an id, so that starts are fixed
    spark.createDataFrame([(d, t, "x", 1, "f") for d, t in own.items()], SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op13_wavelet_shards"](spark, str(tmp_path))
    want, start = [], 0
    for d in sorted(own):
        ids = np.array(plain.encode(own[d] or "", add_special_tokens=False).ids + [END_ID], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in found.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
