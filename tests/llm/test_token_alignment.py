"""Alignment of two tokenizers against a plain computation, text by text and over all documents."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from provider_analytics.llm import token_alignment as ta
from provider_analytics.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, pairs string, key int, copies string"
FILES = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
ODD = ["a", "the cat", " lead", "trail ", "two  blanks", "tab\tin side", "x\n\ny z", "x \ny", "x\n y", "x \n y", "a▁b", "<s> a </s> <unk> <0x41>",
       "<|endoftext|> b", "日本語 テスト", "é é ﬁ ｆ Å", "\x00 \x1c a", " x y  z", "　", " ", "\n", "a" * 300, "=" * 77 + " " + "-" * 130,
       "don't they'll 12,345.67", "🙂🙂 👩‍👩‍👧", "x​y ​", "ü" * 50, "\r\n a\r\n", "a\x85 b", "q  r"]


@pytest.fixture(scope="module")
def plain():
    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    of = ta.byte_characters()
    names = {i: p for p, i in first.get_vocab().items()}

    def piece(i):
        return bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()

    def align(text):
        if not text:
            return []
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        a, b = [(i, bytes(of[c] for c in names[i])) for i in a], [(i, piece(i)) for i in b]
        if not all(b"".join(x for _, x in side) == (" " + text).encode() for side in (a, b)):
            return []

        def ends(side):
            at, out = 0, []
            for _, x in side:
                at += len(x)
                out.append(at)
            return out

        cuts = sorted(set(ends(a)) & set(ends(b)))
        groups = [([], []) for _ in cuts]
        for k, side in enumerate((a, b)):
            for (i, _), e in zip(side, ends(side), strict=True):
                groups[next(g for g, c in enumerate(cuts) if e <= c)][k].append(i)
        return groups

    return align


def spelled(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def texts():
    rng = random.Random(2)
    words = ["the", "The", "gamma", "onereth,", "éènement.", "\nnew", "x\ny", "", " ", "12", "a▁", "tôt", "--", "lee.\nEn"]
    return ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(300)]


def test_aligner(plain, monkeypatch):
    monkeypatch.setattr(ta, "_CACHE_UNITS", 40)
    aligner = ta.Aligner(ta.ByteLevel(FILES[0]), ta.Pieces(FILES[1]))
    every = texts()
    for k in range(0, len(every), 60):
        part = every[k:k + 60]
        for rows, found in aligner.texts(pa.array(part)):
            for j, row in enumerate(rows.tolist()):
                groups = plain(part[row])
                assert (found.fragments[j] or "") == spelled(groups), repr(part[row])
                if groups:
                    assert found.counts[j].tolist() == [sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups),
                                                        sum(len(a) * len(b) for a, b in groups)]
                    links = Counter(x * ta.PAIR + y for a, b in groups for x in a for y in b)
                    at = slice(found.ends[j], found.ends[j + 1])
                    assert dict(zip(found.pairs[at].tolist(), found.times[at].tolist(), strict=True)) == links


def test_large_groups(plain, monkeypatch):
    monkeypatch.setattr(ta, "_LARGE", 1)
    test_aligner(plain, monkeypatch)


def expected(rows, plain):
    groups = [plain(t) for _, t, *_ in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    documents = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (a, _), n in documents.items():
        most[a] = max(most[a], n)
    return [(d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()),
             sum(n for p, n in own.items() if documents[p] == most[p[0]]), sum(n * documents[p] for p, n in own.items()),
             hashlib.sha256(spelled(g).encode()).hexdigest() if g else "") for (d, *_), g, own in zip(rows, groups, links, strict=True)]


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_query(spark, plain, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(ta, "BROADCAST_PAIRS", broadcast)
    every = texts()
    rows = [(i, t, "x", 1, "c") for i, t in enumerate([None, "", *every, *every[:40], *["the cat"] * 50])] + [(None, "the cat", "x", 1, "c"), (3, "a b", "x", 1, "c")]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op12_token_alignment"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[7])
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(expected(rows, plain), key=key)


def test_empty_and_no_tokens(spark):
    assert ta.alignment_measures(spark.createDataFrame([], SCHEMA), *FILES).collect() == []
    found = ta.alignment_measures(spark.createDataFrame([(1, None, "x", 1, "c"), (2, "a▁", "x", 1, "c")], SCHEMA), *FILES).collect()
    assert sorted(tuple(r) for r in found) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_groups_are_returned(spark, plain):
    found = ta.align_texts(spark.createDataFrame([("the cats",), (None,)], "text string"), *FILES).orderBy("n_a").collect()
    assert found[0].groups == "" and found[1].groups == spelled(plain("the cats")) and sum(found[1].times) == found[1].n_links
