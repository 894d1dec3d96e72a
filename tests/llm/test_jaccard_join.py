"""Near duplicates against all pairs, the index's promise, streaming of groups, edges."""

import random

import numpy as np
import pytest

from provider_analytics.llm import jaccard_join as jj


def shingles(text):
    words = [w.lower() for w in (text or "").encode().translate(jj._LOWER).split()]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def plain(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (d, a) in enumerate(sets):
        for j in range(i):
            e, b = sets[j]
            if d is not None and e is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), None if d is None else least[find(i)]) for i, (d, s) in enumerate(sets)), key=str)


def found(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4).selectExpr("*", "1 AS `set`", "'x' AS sig", "2 AS doc")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.near_duplicates(df).collect()), key=str)


def family(rnd, size, copies, rate):
    """A text and copies of it with words replaced here and there."""
    base = [f"w{rnd.randrange(5000)}" for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(copies):
        words = [f"n{rnd.randrange(10**6)}" if rnd.random() < rate * rnd.random() else w for w in base]
        if rnd.random() < 0.3:
            words = words[: max(1, len(words) - rnd.randrange(1 + len(words) // 4))]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed):
    rnd = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [t for size in (1, 3, 4, 5, 6, 8, 9, 12, 17, 25, 30, 40, 60, 90, 150, 400, 900) for _ in range(3) for t in family(rnd, size, 4, 0.12)]
    texts += [" ".join([f"u{rnd.randrange(10**6)}" for _ in range(rnd.choice([20, 60, 100]))]) + " " + passage for _ in range(60)]
    texts += ["same text of more than five words"] * 20 + ["x " * 500, "X  x\t" * 300, "x x x x", None, "", "  \n", "One word"]
    docs = [(i * 3 + 1, t) for i, t in enumerate(rnd.sample(texts, len(texts)))]
    assert found(spark, docs) == plain(docs)


def test_edges(spark):
    docs = [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A B c d e f"), (9, "other"), (2, None), (2, "")]
    assert found(spark, docs) == plain(docs)
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == [(1, 0, 1)]
    assert found(spark, [(1, "w " * 200_000 + "end")]) == [(1, 2, 1)]


def test_small_round_limits_change_nothing(spark, monkeypatch):
    rnd = random.Random(11)
    texts = [t for _ in range(2) for t in family(rnd, 120, 40, 0.10)] + family(rnd, 120, 30, 0.2)
    docs = list(enumerate(texts))
    wanted = plain(docs)
    assert found(spark, docs) == wanted
    for name, value in (("GROUP_SIZE", 2), ("COST_CAP", 3), ("BROADCAST_IDS", 0), ("HUB_ROUNDS", 1)):
        monkeypatch.setattr(jj, name, value)
    monkeypatch.setattr(jj, "BATCH_ROWS", 4)
    assert found(spark, docs) == wanted


def test_index_has_enough_units():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in [*range(1, 400), 1000, 5000, 20_000]]
    units = jj.index_rows(sets)[3]
    sizes = np.array([len(s) for s in sets])
    # Sets of up to two shingles need none: similar ones are equal.
    assert (units[sizes > 2] >= jj.needed(sizes)[sizes > 2]).all()


def test_similar_sets_share_units():
    """Of two sets at the threshold, the smaller one's own segments, with their neighbours, meet the other's."""
    rng = np.random.default_rng(3)
    for n in [3, 4, 8, 9, 21, 24, 25, 30, 57, 100, 333, 1500]:
        for _ in range(20):
            small = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            grown = np.unique(np.concatenate([small, rng.integers(0, 2**63, len(small) // 3, dtype=np.uint64)]))
            swapped = small.copy()
            k = len(small) // 7
            swapped[rng.choice(len(small), k, replace=False)] = rng.integers(0, 2**63, k, dtype=np.uint64)
            for other in (grown, np.unique(swapped)):
                sig, who, mark, _ = jj.index_rows([small, other])
                own = set(sig[(who == 0) & (mark >= 1)].tolist())
                assert own & set(sig[who == 1].tolist()), (n, len(other))


def test_isolated_pairs_at_band_borders(spark):
    """Pairs that share nothing with the rest, similarities from 0.75 to 0.80, sizes on both sides of each border: what
    a set has alone in one scheme must not count against partners it meets in the other."""
    rnd = random.Random(5)
    docs = []

    def text(words):
        docs.append((len(docs), " ".join(words)))

    def fresh(n):
        return [f"f{rnd.randrange(10**12)}" for _ in range(n)]

    tops = [int(t) for t in jj.bands(500) if t > 17]
    for top in tops:
        for large in [top - 1, top, top + 1, top + 2, top + 3]:
            for share in (0.75, 0.77, 0.80):
                words = fresh(large + 4)
                text(words)
                text(words[:-(-int(100 * share) * large // 100) + 4])  # a part of it
                for small in (large, large - 1):  # as many, or one fewer, some in place of others
                    both = -int(-share * (large + small) // (1 + share))
                    words = fresh(large + 4)
                    text(words)
                    text(words[:both + 4] + fresh(small - both))
    wanted = plain(docs)
    assert sum(d != c for d, _, c in wanted) >= 0.8 * len(docs) / 2  # rounding leaves some just below
    assert found(spark, docs) == wanted


def test_groups_pass_as_a_stream(spark):
    rnd = random.Random(6)
    rows = [(rnd.randrange(60), rnd.randrange(12), rnd.choice([0, 1]), None) for _ in range(900)]
    rows += [(10**6 + i, 1, -1, (i, 5, 6)) for i in range(30)]
    rows += [(777, i, 0, None) for i in range(500)] + [(778, 1, 0, None)] * 300
    df = spark.createDataFrame(rows, "sig bigint, `set` bigint, mark int, facts struct<doc: bigint, n: int, units: int>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = jj.shared_only(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    groups = {}
    for sig, s, mark, *_ in rows:
        if mark >= 0:
            groups.setdefault(sig, set()).add((s, mark))
    wanted = sorted((sig, s, m, len(g)) for sig, g in groups.items() if len({s for s, _ in g}) > 1 for s, m in g)
    assert sorted((r.sig, r.set, r.mark, r.cost) for r in got if r.mark >= 0) == wanted
    assert sorted(r.facts.doc for r in got if r.mark == -1) == list(range(30))


def test_one_of_each_group_stays(spark):
    texts = ["a b c d e f g"] * 3 + ["z y x w v u", None, "", "q"]
    docs = [(i, t, "k") for i, t in enumerate(texts)] + [(0, "a b c d e f g", "k"), (3, "z y x w v u t s r q p", "k"), (None, "n", "k"), (None, "n", "k")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, component_id string")
    kept = jj.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([0, 3, 3, 4, 5, 6, None, None], key=str)  # 3 has two texts


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(5)
    for n, other in ((1, 1), (30, 12), (200, 30), (5000, 900)):
        a, b = (rng.integers(0, 2**63, size, dtype=np.uint64) for size in (n, n + other))
        b[:n - other // 2] = a[:n - other // 2]
        apart = int(np.bitwise_count(jj.sketch(a).view(np.uint64) ^ jj.sketch(b).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_sets_that_meet_but_differ_too_much_make_no_pairs(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    rows = []
    for name in range(60):  # any two share 120 to 130 of 200, but the last is like the first
        values = base.copy()
        values[rng.permutation(200)[:45]] = rng.integers(0, 2**63, 45, dtype=np.uint64)
        if name == 59:
            values = first.copy()
            values[:20] = rng.integers(0, 2**63, 20, dtype=np.uint64)
        first = values if name == 0 else first
        rows.append((1, name, True, 200, 200, 13, 0, 0, name, jj.sketch(values).tolist()))
    state = spark.createDataFrame(rows, "sig bigint, set bigint, asks boolean, n int, most int, band int, alone int, below int, root bigint, sketch array<bigint>")
    met = jj._others(state, state.filter("asks").select("sig", *jj._facts(state)))
    assert sorted((r.a, r.set) for r in met.select("a", "set").collect()) == [(0, 59), (59, 0)]
