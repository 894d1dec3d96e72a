"""Exact Jaccard self-join on word shingles by partitioning the universe.

Shingles are hashed into segments, as many as the size band asks for. Two sets that are similar enough differ in few
shingles, and a differing shingle can spoil one segment only, so some segments must be equal. Every set indexes, for
its band and the one below, its segment subsets and, for a share of the segments, the subsets with one shingle
left out, which find segments that differ by one. A set then has to look up only as many segments as pigeonholes are
needed; which, is allocated by cost: segments nobody shares are free, and of the shared ones the rarest are taken. What
is found is verified on the whole sets.

Near copies come in groups of thousands. A segment's sets are first compared with one of them, the one with most in
common with others; sets that are then connected need not be compared with each other, and only pairs of still
separate sets are tried one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import top_per_group
from .common import BATCH_ROWS, batches_of, release, tidied, written

#: Words of a shingle; the similarity is at least 3/4. The size bands below belong to that figure.
SHINGLE = 5
#: Up to this size each shingle is a segment of its own.
SMALL = 24
#: Texts that a task has split into words at a time.
TEXTS = 512
#: Segments for each pigeonhole that is needed, and the share of segments that index one-deletion neighbours.
SPARE, DEEP = 1.15, 32
#: A segment's cost is how many sets share it; beyond this it is not counted further.
COST_CAP = 200_000
#: Ids up to this number may be broadcast; beyond it the same join is shuffled.
BROADCAST_IDS = 500_000
#: Rounds in which the sets of a signature are compared with one of them; and up to how many separate sets of a
#: signature are then compared one by one, before the sets that ask look again in a finer partition.
HUB_ROUNDS, GROUP_SIZE = 1, 32
#: 64-bit words of the sketch that tells apart sets which meet in the finest partition.
SKETCH_WORDS = 32

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, arithmetic modulo 2**64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingle hashes of each text in ascending order. Words are what blanks separate, A-Z in lower case;
    fewer words than a shingle has are one shingle, no words none. Shingles count as equal when their 64-bit hashes are."""
    words = [t.translate(_LOWER).split() for t in texts]
    counts = [len(w) for w in words]
    flat = np.fromiter((h for w in words for h in map(xxhash.xxh3_64_intdigest, w)), np.uint64, sum(counts))
    rolled = np.zeros(len(flat), np.uint64)
    for i in range(SHINGLE):
        n = max(0, len(flat) - i)
        rolled[:n] = rolled[:n] * _P + flat[i:]
    rolled = mix(rolled)
    out, at = [], 0
    for n in counts:
        if n >= SHINGLE:
            out.append(np.unique(rolled[at:at + n - SHINGLE + 1]))
        elif n:
            short = np.array([n], np.uint64)
            for i in range(at, at + n):
                short = short * _P + flat[i:i + 1]
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def bands(largest: int) -> np.ndarray:
    """The largest size of each band. A set's partners that are not smaller are in its band or the next."""
    tops = [1]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, 4 * tops[-1] // 3))
    return np.array(tops, np.int64)


def needed(size: np.ndarray) -> np.ndarray:
    """Pigeonholes a set needs: one more than the shingles it can differ in from a set that is not smaller."""
    return size // 3 + 1


def segment_counts(tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments of each band's scheme, 0 where shingles stand for themselves, and how many of them are deep."""
    counts = np.where(tops <= SMALL, 0, np.ceil(needed(tops) * SPARE).astype(np.int64) + 1)
    return counts, np.where(counts > 0, -(-counts // DEEP), 0)


def index_rows(sets: list[np.ndarray], spare: float = SPARE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For many sets: signature, which set, mark, and the units each set has. A mark of 0 is not the set's own band;
    1 is a segment subset of its own; 2 + 2*s the subset of deep segment s and 3 + 2*s one of its neighbours."""
    sig, who, mark, units, _, _ = scheme_rows(sets)
    return sig, who, mark, units


def scheme_rows(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same, with the units each set has in the scheme of the band below, and its band."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tops = bands(int(sizes.max(initial=1)))
    counts, deep = segment_counts(tops)
    band = np.searchsorted(tops, sizes)
    units, below = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    parts = []
    for own in (True, False):
        scheme, count = (band, units) if own else (band - 1, below)
        # Up to two shingles, similar sets are equal ones.
        chosen = np.flatnonzero((sizes > 0) & (scheme >= 0) & (tops[np.maximum(scheme, 0)] > 2))
        plain = chosen[counts[scheme[chosen]] == 0]
        if len(plain):
            who = np.repeat(plain, sizes[plain])
            h = np.concatenate([sets[i] for i in plain])
            parts.append((mix(mix(h) + _P * scheme[who].astype(np.uint64)), who, np.full(len(who), int(own))))
            count[plain] = sizes[plain]
        cut = chosen[counts[scheme[chosen]] > 0]
        if not len(cut):
            continue
        who = np.repeat(cut, sizes[cut])
        h = np.concatenate([sets[i] for i in cut])
        m = counts[scheme]
        base = np.zeros(len(sets), np.int64)
        base[cut] = np.cumsum(m[cut]) - m[cut]
        segment = ((h >> np.uint64(20)) % m[who].astype(np.uint64)).astype(np.int64)
        place = base[who] + segment
        total = int(m[cut].sum())
        value = mix(h + _P)
        # Sums modulo 2**64 by halves: exact in doubles, as a segment has less than 2**20 shingles.
        low = np.bincount(place, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
        high = np.bincount(place, (value >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
        sums, held = low + (high << np.uint64(32)), np.bincount(place, minlength=total)
        owner = np.repeat(cut, m[cut])
        number = np.arange(total) - base[owner]
        salt = mix(scheme[owner].astype(np.uint64) * _P + number.astype(np.uint64))
        is_deep = number < deep[scheme[owner]]
        there = np.flatnonzero(held > 0)
        mark = np.where(is_deep[there], 2 + 2 * number[there], 1) if own else np.zeros(len(there), np.int64)
        parts.append((mix(sums[there] + salt[there]), owner[there], mark))
        near = np.flatnonzero(is_deep[place] & (held[place] >= 2))
        at = place[near]
        mark = 3 + 2 * number[at] if own else np.zeros(len(near), np.int64)
        parts.append((mix(sums[at] - value[near] + salt[at]), who[near], mark))
        count += np.bincount(owner[there], minlength=len(sets)) + np.bincount(owner[held * is_deep >= 2], minlength=len(sets))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), units, below, band
    return *(np.concatenate([p[i] for p in parts]) for i in range(3)), units, below, band


def sketch(values: np.ndarray) -> np.ndarray:
    """Bits by hash, each set where an odd number of a set's shingles fall on it. A shingle that one of two sets has alone
    changes one bit, so two sets differ in at least as many shingles as sketches in bits."""
    size = 64 * SKETCH_WORDS
    held = np.bincount(((values >> np.uint64(32)) % np.uint64(size)).astype(np.int64), minlength=size)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").view("<i8")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts in parts that are small as lists of words."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def set_id(values: np.ndarray) -> int:
    """What equal sets share; sets of different size never do in practice and are told apart by it as well."""
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Signatures sig, set, mark, and one row for each document with mark -1, whose facts are doc, n, band, and the
    units of the own scheme and of the one below."""
    kind = docs.schema[id_col].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found = shingle_sets(texts)
            ids = np.array([set_id(s) for s in found], np.int64)
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            _, first = np.unique(np.where(named, ids, -1), return_index=True)
            first = np.array([i for i in first if named[i]], np.int64)  # equal sets of a batch are indexed once
            sig, who, mark, *facts_of = scheme_rows([found[i] for i in first])
            each = dict(zip(ids[first].tolist(), np.stack(facts_of, axis=1).tolist(), strict=True))
            n = len(texts)
            sets, sigs = ids[first][who], _signed(sig)
            facts = pa.struct([("doc", batch.column(0).type), *((f, pa.int32()) for f in ("n", "units", "below", "band"))])
            names = ["sig", "set", "mark", "facts"]
            for at in range(0, len(sigs), 50_000):
                part = slice(at, at + 50_000)
                columns = [pa.array(sigs[part]), pa.array(sets[part]), pa.array(mark[part].astype(np.int32)), pa.nulls(len(sigs[part]), facts)]
                yield pa.RecordBatch.from_arrays(columns, names)
            places = _signed(mix(ids.view(np.uint64) + np.arange(n, dtype=np.uint64)))
            about = pa.StructArray.from_arrays(
                [batch.column(0), pa.array([len(s) for s in found], pa.int32()),
                 *(pa.array([each.get(i, (0, 0, 0))[f] for i in ids.tolist()], pa.int32()) for f in range(3))],
                fields=list(facts))
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(ids), pa.array(np.full(n, -1, np.int32)), about], names)

    picked = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return picked.mapInArrow(tidied(emit), f"sig bigint, set bigint, mark int, facts struct<doc: {kind}, n: int, units: int, below: int, band: int>")


def shared_only(rows: DataFrame) -> DataFrame:
    """Of the index, the documents and the signatures that more than one set has, with how many rows share each, in
    `cost`. Rows come sorted by signature and pass as a stream; an open group is held back up to COST_CAP rows. Most
    signatures have one row, so only the others are put in order of set and mark, here."""
    spread = rows.repartition("sig").sortWithinPartitions("sig")
    names = [*rows.columns, "cost"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        joined: int | None = None  # the signature of an open group that was let through because it is so large

        def settle(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, joined
            held = []
            if not table.num_rows:
                return
            sig, sets, mark = (table.column(c).to_numpy() for c in ("sig", "set", "mark"))
            signature = mark >= 0
            yield from docs_of(table, ~signature)
            at = np.flatnonzero(signature)
            if not len(at):
                return
            new = np.concatenate([[True], np.diff(sig[at]) != 0, [True]])
            several = ~(new[:-1] & new[1:])
            several[0] |= sig[at[0]] == joined
            several[-1] |= not last  # the last group may go on
            at = at[several]
            if not len(at):
                return
            at = at[np.lexsort((mark[at], sets[at], sig[at]))]
            sig, sets, mark = sig[at], sets[at], mark[at]
            again = np.zeros(len(at), bool)
            again[1:] = (sig[1:] == sig[:-1]) & (sets[1:] == sets[:-1]) & (mark[1:] == mark[:-1])
            at, sig, sets = at[~again], sig[~again], sets[~again]
            starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            ends = np.append(starts[1:], len(sig))
            shared = sets[starts] != sets[ends - 1]
            if joined is not None:
                shared[0] |= sig[0] == joined
            sizes = ends - starts
            if not last:
                open_from = int(starts[-1])
                if sizes[-1] < COST_CAP or not shared[-1]:
                    held = table.take(pa.array(at[open_from:])).combine_chunks().to_batches()
                    starts, shared, sizes = starts[:-1], shared[:-1], sizes[:-1]
                    at = at[:open_from]
                    joined = joined if open_from == 0 else None
                else:
                    joined = int(sig[-1])
            chosen = np.repeat(shared, sizes)
            cost = np.repeat(np.minimum(sizes, COST_CAP), sizes)[chosen]
            yield from out(table.take(pa.array(at[chosen])), cost)

        def docs_of(table: pa.Table, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
            if mask.any():
                part = table.filter(pa.array(mask))
                yield from out(part, np.zeros(part.num_rows, np.int64))

        def out(part: pa.Table, cost: np.ndarray) -> Iterator[pa.RecordBatch]:
            if part.num_rows:
                yield from part.append_column("cost", pa.array(cost.astype(np.int32))).combine_chunks().to_batches()

        for batch in batches:
            if batch.num_rows:
                yield from settle(pa.Table.from_batches([*held, batch]), last=False)
        if held:
            yield from settle(pa.Table.from_batches(held), last=True)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return spread.mapInArrow(tidied(keep), f"{fields}, cost int").select(*names)


def allocate(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """sig, set: the segments each set looks up. A set needs as many units as pigeonholes; those nobody shares are
    free, the rest come from the shared segments in the order of their cost. Leaving one out of a deep segment is a unit
    of its own that costs all lookups of the segment."""
    own = shared.filter("mark >= 1").withColumn("segment", F.when(F.col("mark") >= 2, F.floor(F.col("mark") / 2) - 1))
    own = own.withColumn("left_out", (F.col("mark") >= 2) & (F.col("mark") % 2 == 1))
    used = own.groupBy("set").agg((F.count(F.when(~F.col("left_out"), 1)) + F.count_distinct("segment")).alias("used"))
    wanting = classes.join(used, "set").select("set", (F.floor(F.col("n") / 3) + 1 - F.col("units") + F.col("used")).alias("want")).filter("want > 0")
    asked = own.join(wanting, "set")
    whole = F.sum("cost").over(Window.partitionBy("set", "segment"))
    unit = F.when(F.col("left_out"), F.struct(whole.alias("cost"), F.lit(1).alias("kind"), F.col("segment").cast("bigint").alias("unit")))
    unit = unit.otherwise(F.struct(F.col("cost").cast("bigint").alias("cost"), F.lit(0).alias("kind"), F.col("sig").alias("unit")))
    ranked = asked.withColumn("unit", unit).withColumn("place", F.dense_rank().over(Window.partitionBy("set").orderBy("unit")))
    return ranked.filter(F.col("place") <= F.col("want")).select("sig", "set").distinct()


def whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """set, n, items for the sets in `wanted`: the sorted hashes, made again from the text of a set's first document.
    Few ids are broadcast, so that texts stay where they are; more are joined by a shuffle."""
    firsts = classes.join(wanted, "set", "left_semi").select(F.col("first_doc").alias(id_col))
    if firsts.count() <= BROADCAST_IDS:
        firsts = F.broadcast(firsts)
    texts = docs.select(id_col, text_col).join(firsts, id_col, "left_semi").select(text_col)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [s for s in shingle_sets([t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["set", "items"])

    made = texts.mapInArrow(tidied(make), "set bigint, items binary")
    return made.dropDuplicates(["set"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs a, b those with 100 * shared >= 75 * all."""
    left = sets.select(F.col("set").alias("a"), F.col("items").alias("left"))
    right = sets.select(F.col("set").alias("b"), F.col("items").alias("right"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(tidied(check), "a bigint, b bigint")


def connected(links: DataFrame) -> DataFrame:
    """set, root: the smallest set that can be reached. Every round takes the smallest root around a set and then that
    one's root, so paths halve; rounds go on until nothing changes, each from a written table."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    at = written(edges.groupBy(F.col("a").alias("set")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "roots")
    while True:
        around = edges.join(at.select(F.col("set").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("set")).agg(F.min("r").alias("r"))
        best = at.join(around, "set").select("set", "root", F.least("root", "r").alias("best"))
        jump = at.select(F.col("set").alias("best"), F.col("root").alias("far"))
        step = written(best.join(jump, "best").select("set", "root", F.least("best", "far").alias("next")), "roots")
        if step.filter("next < root").isEmpty():
            return at
        at = step.select("set", F.col("next").alias("root"))


def _fitting() -> Column:
    """Whether two sets of sizes n and m can be similar at all: by size, by what each can share at most, and by how much
    each differs from the other at least. Similar sets share 3/7 of both sizes and differ in 1/7. What a set has alone
    in a scheme counts against sets of that scheme only: its own scheme has the bands from its own up, the scheme below
    those down to the band below."""
    n, m, both = F.col("n"), F.col("m"), F.col("n") + F.col("m")
    share = (7 * F.col("most") >= 3 * both) & (7 * F.col("other_most") >= 3 * both)
    band, other = F.col("band"), F.col("other_band")
    differ = F.greatest(F.when(other >= band, F.col("alone")), F.when(other <= band, F.col("below")),
                        F.when(band >= other, F.col("other_alone")), F.when(band <= other, F.col("other_below")),
                        F.col("n") - F.col("most") + F.col("m") - F.col("other_most"))
    return (4 * n >= 3 * m) & (4 * m >= 3 * n) & share & (7 * differ <= both)


def members_of(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets of every signature that some set asks for: sig, set, asks, n, most, band, alone, below. `most` is how many
    shingles a set may share with another, `alone` in how many it differs at least from any other that has the set's own
    scheme, `below` from any other that has the scheme of the band below: every segment of a scheme that nobody shares
    stands for one, whether it is this set's or the other's. The schemes are counted apart, as sets that have one of them
    in common need not share anything in the other. A deep segment is two units but, shared as it is, no difference, so
    as many as there are deep ones do not count."""
    asked = allocate(shared, classes).withColumn("asks", F.lit(True))
    signed = shared.filter("mark >= 0").select("sig", "set").distinct()
    used = shared.filter("mark >= 0").groupBy("set").agg(F.count_if(F.col("mark") >= 1).alias("used"), F.count_if(F.col("mark") == 0).alias("used_below"))
    least = lambda units, used: F.greatest(F.lit(0), F.col(units) - F.col(used) - F.ceil(F.col("n") / 64) - 2)
    facts = classes.join(used, "set").select(
        "set", "n", F.col("n").alias("most"), "band", least("units", "used").alias("alone"), least("below", "used_below").alias("below"))
    members = signed.join(asked, ["sig", "set"], "left").withColumn("any", F.max("asks").over(Window.partitionBy("sig")))
    return members.filter("any").select("sig", "set", F.coalesce("asks", F.lit(False)).alias("asks")).join(facts, "set")


def finer(state: DataFrame, sets: DataFrame) -> DataFrame:
    """The same as members_of for costly signatures, partitioned as finely as can be: every shingle a segment.

    state: the members of signatures that sets ask for, with `costly` where the asking set is to be treated here. Sets
    that could meet one of those give all their shingles, apart for each size band; a costly one asks for as many
    as it needs pigeonholes, those that no other set has being free and the rarest of the rest taken. What
    many sets share, like a passage they all quote, is left out unless it is most of a set. Rows have the sketch of
    their set as well."""
    wanted = state.groupBy("sig").agg(F.bool_or("costly").alias("any")).filter("any").select("sig")
    parts = state.join(wanted, "sig").groupBy("set").agg(F.bool_or("costly").alias("costly"))
    items = sets.join(parts, "set").select("set", "costly", "items")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column(2)):
                values = np.frombuffer(raw.as_py(), np.uint64)
                n = len(values)
                band = int(np.searchsorted(bands(n), n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(values)), pa.array(np.full(n, batch.column(0)[i].as_py(), np.int64)),
                     pa.array(np.full(n, batch.column(1)[i].as_py(), bool)), pa.array(np.full(n, n, np.int32)), pa.array(np.full(n, band, np.int32))],
                    ["item", "set", "costly", "n", "band"])

    spelled = items.mapInArrow(tidied(spell), "item bigint, set bigint, costly boolean, n int, band int")
    cost = F.count("*").over(Window.partitionBy("item"))
    spelled = written(spelled.withColumn("cost", cost).filter("cost > 1"), "spelled")
    free = spelled.groupBy("set").agg((F.first("n") - F.count("*")).alias("lonely"))
    place = F.row_number().over(Window.partitionBy("set").orderBy("cost", "item"))
    asking = spelled.filter("costly").withColumn("place", place).join(free, "set")
    asking = asking.filter(F.col("place") <= F.floor(F.col("n") / 7) + 1 - F.col("lonely"))
    key = lambda band: F.xxhash64("item", band).alias("sig")
    asks = asking.select("item", "set", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band")).select(key(F.col("band")), "set", F.lit(True).alias("asks"))
    rows = spelled.select(key(F.col("band")), "set", F.lit(False).alias("asks")).union(asks).groupBy("sig", "set").agg(F.bool_or("asks").alias("asks"))
    rows = rows.withColumn("any", F.bool_or("asks").over(Window.partitionBy("sig"))).filter("any").drop("any")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [sketch(np.frombuffer(raw, np.uint64)) for raw in batch.column(1).to_pylist()]
            flat = pa.array(np.concatenate(drawn) if drawn else np.zeros(0, np.int64))
            ends = pa.array(np.arange(len(drawn) + 1, dtype=np.int32) * SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], ["set", "sketch"])

    sketches = items.select("set", "items").mapInArrow(tidied(draw), "set bigint, sketch array<bigint>")
    sizes = free.join(spelled.select("set", "n", "band").distinct(), "set").join(sketches, "set")
    return rows.join(sizes, "set").select("sig", "set", "asks", "n", (F.col("n") - F.col("lonely")).alias("most"), "band",
                                          F.col("lonely").alias("alone"), F.col("lonely").alias("below"), "sketch")


class _Search:
    """Links found so far, pairs tried so far, and the whole sets that are compared."""

    def __init__(self, sets: DataFrame):
        self.sets, self.links, self.tried, self.number = sets, None, None, 0

    def separate(self, members: DataFrame) -> DataFrame | None:
        """Members of signatures whose sets are not all connected yet, with root, group size; None if there are none."""
        state = members.withColumn("root", F.col("set"))
        if self.links is not None:
            state = members.join(connected(self.links), "set", "left").withColumn("root", F.coalesce("root", "set"))
        groups = state.groupBy("sig").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count("*").alias("size"), F.bool_or("asks").alias("_any"))
        state = written(state.join(groups.filter("_a < _b AND _any").select("sig", "size"), "sig"), "separate")
        return None if state.isEmpty() else state

    def compare(self, pairs: DataFrame) -> None:
        pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = written(pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti"), "pairs")
        found = written(verified(pairs, self.sets), "links")
        self.links = found if self.links is None else self.links.unionByName(found)
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        self.number += 1

    def with_one(self, state: DataFrame) -> None:
        """Compare the sets of each signature with one of them: first the one with least of its own, then any."""
        order = F.col("alone") if self.number == 0 else F.xxhash64("set", F.lit(self.number)).alias("alone")
        hubs = state.groupBy("sig").agg(F.min(F.struct(order.alias("o"), *_facts(state))).alias("hub"))
        self.compare(_others(state, hubs.select("sig", "hub.*")).filter(F.col("asks") | F.col("calls")).select("a", F.col("set").alias("b")))

    def one_by_one(self, state: DataFrame) -> None:
        """Compare every set that asks with the others of the signature that are not connected with it."""
        self.compare(_others(state, state.filter("asks").select("sig", *_facts(state))).select("a", F.col("set").alias("b")))


def _facts(state: DataFrame) -> list[str]:
    return [c for c in ("set", "n", "root", "asks", "most", "band", "alone", "below", "sketch") if c in state.columns]


def _others(state: DataFrame, some: DataFrame) -> DataFrame:
    """Members of signatures with the given sets of the same signature, as a, that may be similar and are not connected.
    Where both have sketches, these may differ in 1/7 of both sizes as well."""
    names = {"set": "a", "n": "m", "root": "other", "asks": "calls", "most": "other_most", "band": "other_band",
             "alone": "other_alone", "below": "other_below", "sketch": "other_sketch"}
    some = some.select("sig", *[F.col(old).alias(new) for old, new in names.items() if old in some.columns])
    fitting = (F.col("root") != F.col("other")) & _fitting()
    if "sketch" in state.columns:
        bits = F.zip_with("sketch", "other_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
        fitting &= 7 * F.aggregate(bits, F.lit(0), lambda total, n: total + n) <= F.col("n") + F.col("m")
    return state.join(some, "sig").filter(fitting)


def similar_links(docs: DataFrame, shared: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """Links a, b between sets, enough to connect all that are connected; None if there are none."""
    members = written(members_of(shared, classes), "members")
    if members.isEmpty():
        return None
    search = _Search(written(whole_sets(docs, classes, members.select("set").distinct(), id_col, text_col), "sets"))
    state = members
    for _ in range(HUB_ROUNDS):
        search.with_one(state.withColumn("root", F.col("set")) if "root" not in state.columns else state)
        state = search.separate(members)
        if state is None:
            return search.links
    # Sets that ask for what many others have, and are not connected with them, look again in a finer partition.
    costly = state.filter(F.col("asks") & (F.col("size") > GROUP_SIZE)).select("set").distinct().withColumn("costly", F.lit(True))
    state = written(state.join(costly, "set", "left").withColumn("costly", F.col("asks") & F.coalesce("costly", F.lit(False))), "allotted")
    search.one_by_one(state.withColumn("asks", F.col("asks") & ~F.col("costly")))
    if not state.filter("costly").isEmpty():
        fine = written(finer(state, search.sets), "finer")
        for _ in range(HUB_ROUNDS):
            rest = search.separate(fine)
            if rest is None:
                return search.links
            search.with_one(rest)
        rest = search.separate(fine)
        if rest is not None:
            search.one_by_one(rest)
    return search.links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id for every document: the size of its set and the smallest id that links reach.

    A document without words or text has an empty set, links with nothing and is its own component. Documents with
    equal sets are linked. A null id cannot name a component: such a document gets a null one and takes no part in links.
    Repeated rows each get a row; an empty table gives none. Only the two named columns are read."""
    spark = docs.sparkSession
    batches_of(spark, 8 * BATCH_ROWS)
    shared = written(shared_only(index(docs, id_col, text_col)), "shared")
    release(spark)
    each = shared.filter("mark = -1").select("facts.doc", "set", "facts.n", "facts.units", "facts.below", "facts.band")
    classes = each.filter(F.col("doc").isNotNull() & (F.col("n") > 0)).groupBy("set").agg(
        F.min("doc").alias("first_doc"), F.first("n").alias("n"), *(F.max(f).alias(f) for f in ("units", "below", "band")))
    classes = written(classes, "classes")
    links = similar_links(docs, shared, classes, id_col, text_col)
    named = classes.select("set", F.col("first_doc").alias("component_id"))
    if links is not None:
        roots = connected(links)
        whole = roots.join(named, "set").groupBy("root").agg(F.min("component_id").alias("whole"))
        named = named.join(roots.join(whole, "root").select("set", "whole"), "set", "left").select(
            "set", F.coalesce("whole", "component_id").alias("component_id"))
    out = each.join(named, "set", "left")
    component = F.when(F.col("doc").isNull() | (F.col("n") == 0), F.col("doc")).otherwise(F.col("component_id"))
    return out.select(F.col("doc").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component with all its columns, the one with the smallest id; rows without words and those with a
    null id stay. Where ids repeat, rows are told apart by id and text, and of rows with both the same and words one
    stays, so a text that is like no other never goes."""
    repeated = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1")
    if repeated.isEmpty():
        key, keyed = id_col, docs
    else:
        key, named = "_key", F.struct(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("text"))
        keyed = docs.withColumn(key, F.when(F.col(id_col).isNotNull(), named))
    found = written(near_duplicates(keyed, key, text_col), "components")
    gone = found.filter(F.col(key) != F.col("component_id")).select(key).distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = keyed.join(gone, key, "left_anti")
    if key == id_col:
        return kept.select(*docs.columns)
    wordy = found.filter(F.col(key).isNotNull() & (F.col("n_shingles") > 0)).groupBy(key).count().filter("count > 1").select(key)
    one = top_per_group(kept.join(wordy, key, "left_semi"), [key], [F.xxhash64(*docs.columns)], 1)
    return kept.join(wordy, key, "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))
