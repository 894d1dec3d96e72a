"""Packing: ids as the tokenizer gives them, every token once, limits kept, little padding."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from provider_analytics.llm import packing
from provider_analytics.llm.queries import END_ID, tokenizer_path

TEXTS = ["", " ", "a", "It's  fine. don't\tdo it\x1c b", "ÀÉ é́ İstanbul ΣΑΣ ς", "<|endoftext|> x<|startoftext|>y <|endoftext|>", "日本語 テスト 123 4.5,..",
         "¿Qué? «ßẞ» ꙮ 🙂🙂 ª º µ", "\n\n  .,.,", "ｆｕｌｌ ﬁ x y z\x0bq", "the The THE the. the, the.,", "x" * 3000, "Öäü,. ÿŸ"]


def test_tokens_as_the_tokenizer_gives_them(monkeypatch):
    plain = Tokenizer.from_file(tokenizer_path())
    rnd = random.Random(3)
    alphabet = list("abcXYZ .,\n'!é́ßÅ1") + ["the", "'s", " ", "İ"]
    texts = TEXTS + ["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(1500)]
    monkeypatch.setattr(packing, "_CACHE_PARTS", 500)
    for last in (END_ID, None):
        encoder = packing.ChunkTokenizer(tokenizer_path(), last)
        found = [x for i in range(0, len(texts), 200) for x in encoder(texts[i:i + 200])]
        for text, ids in zip(texts, found, strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids + ([] if last is None else [last]), text


def fill(examples, limits, cut=True, pool=16):
    rows = []
    packer = packing.Packer(limits, lambda key, ids, start, length, total, seq, offset: rows.append((key, start, length, total, seq, offset)), pool, cut)
    for key, (n, loss) in enumerate(examples):
        packer.add(key, np.arange(n, dtype=np.uint32), loss)
    packer.run()
    return rows


def check(examples, limits, rows):
    covered, sequences = {}, {}
    for key, start, length, total, seq, offset in rows:
        assert length > 0 and total == examples[key][0]
        covered.setdefault(key, []).append((start, start + length))
        sequences.setdefault(seq, []).append((offset, key, start, length))
    for key, (n, _) in enumerate(examples):
        parts = sorted(covered.get(key, []))
        assert [a for a, _ in parts] == [0, *[b for _, b in parts[:-1]]][: len(parts)] and (parts[-1][1] if parts else 0) == n
    for pieces in sequences.values():
        pieces.sort()
        ends = [o + n for o, _, _, n in pieces]
        assert [o for o, *_ in pieces] == [0, *ends[:-1]] and ends[-1] <= limits.tokens and len(pieces) <= limits.segments
        loss = sum(n if examples[k][1] is None else int(examples[k][1][a:a + n].sum()) for _, k, a, n in pieces)
        assert loss <= limits.loss
    return sequences


@pytest.mark.parametrize("seed", range(8))
def test_limits(seed):
    rnd = np.random.default_rng(seed)
    limits = packing.Limits(int(rnd.integers(1, 200)), int(rnd.integers(1, 9)), int(rnd.integers(1, 120)))
    examples = [(int(n), None if rnd.random() < 0.3 else rnd.random(n) < rnd.random()) for n in rnd.integers(1, 400, 120)]
    check(examples, limits, fill(examples, limits))


def test_little_padding():
    rnd = np.random.default_rng(0)
    examples = [(int(n), None) for n in rnd.lognormal(6, 1.5, 3000).clip(1, 50_000)]
    sequences = check(examples, packing.Limits(), fill(examples, packing.Limits(), pool=256))
    assert len(sequences) <= -(-sum(n for n, _ in examples) // 4096) + 2


def test_whole_examples_stay_whole():
    examples = [(n, None) for n in (60, 50, 40, 250, 30, 20, 10)]
    limits = packing.Limits(100, 3, 100)
    rows = fill(examples, limits, cut=False)
    check(examples, limits, rows)
    assert all(length == total for *_, length, total, _, _ in [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in rows] if total <= 100)


def test_loss_limit_binds():
    loss = np.ones(50, bool)
    rows = fill([(50, loss)] * 10 + [(50, ~loss)] * 10, packing.Limits(100, 10, 50), cut=False)
    assert len({r[4] for r in rows}) == 10


def test_edges(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (100, None), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS ids", "2 AS start")
    ids = packing.tokenize(df, tokenizer_path(), END_ID)
    assert ids.count() == len(rows)
    pieces = packing.pack(ids, packing.Limits(64, 4, 64)).collect()
    whole = {r.doc_id: r.ids for r in ids.collect()}
    for doc, data in whole.items():
        parts = sorted((p.start, bytes(p.ids)) for p in pieces if p.doc_id == doc)
        assert b"".join(x for _, x in parts) == bytes(data) * (2 if doc == 100 else 1)
        assert sum(p.length for p in pieces if p.doc_id == doc) * 4 == len(data) * (2 if doc == 100 else 1)
    assert packing.pack(ids.limit(0), packing.Limits()).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, bytearray(b""))], "doc_id int, ids binary")
    assert packing.pack(nothing, packing.Limits()).collect() == []
    with pytest.raises(ValueError):
        packing.Limits(tokens=0)


def test_query(spark):
    import zlib

    from provider_analytics.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    plain = Tokenizer.from_file(tokenizer_path())
    ids = {r.doc_id: plain.encode(r.text, add_special_tokens=False).ids + [END_ID]
           for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op2_vector_packing"](spark, folder).collect()
    for r in rows:
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    check([(len(ids[d]), None) for d in range(len(ids))], packing.Limits(),
          [(r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) for r in rows])


def test_marks_behind_words_are_remembered_apart():
    encoder = packing.ChunkTokenizer(tokenizer_path(), None)
    plain = Tokenizer.from_file(tokenizer_path())
    texts = ["Cat%%% dog%%% cat: (dog) x<|endoftext|> it's= a_b", "dog### cat!? éa$$$ don't' <|endoftext|>!"]
    assert [ids.tolist() for ids in encoder(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert {"cat", "dog", "%%%", "###"} <= encoder.part.keys() and not {"Cat%%%", "dog%%%", "dog###"} & encoder.part.keys()
