"""Periodic run detection over words: Lyndon roots by group refinement, extended to runs.

The first phase of a grouping suffix sorter puts every suffix into the group of the longest Lyndon word it starts with;
groups are taken from the highest down, and each hands its length to the suffixes just before it. Stopping there gives
the Lyndon array without sorting suffixes. It is taken under the order of the words' numbers and under the reverse
order: the root of every run is the longest Lyndon word at some place under one of the two. A root is extended to both
sides by longest common extensions, and what is long enough is a run.

Words are compared as numbers of a text's own dictionary, so equality is exact. Extensions use hashes of prefixes in two
moduli; a run found with them is compared word by word, and a text where that fails is done again with another base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least this many words and this many periods.
MIN_LENGTH, MIN_PERIODS = 6, 4
#: Places whose extensions are searched at a time.
BLOCK = 1 << 18
_MODULI = (np.uint64(2147483647), np.uint64(2147483629))


def lyndon_array(codes: list[int]) -> list[int]:
    """The length of the longest Lyndon word at each place, numbers in ascending order. Linear but for sorting the
    members of a group by place."""
    n = len(codes)
    order = sorted(range(n), key=codes.__getitem__)
    at, group = [0] * n, [0] * n  # place in the order; where the group of a suffix begins there
    end, length = {}, {}  # of a group, by its beginning
    for k, i in enumerate(order):
        at[i] = k
        group[i] = group[order[k - 1]] if k and codes[order[k - 1]] == codes[i] else k
        end[group[i]], length[group[i]] = k + 1, 1
    out, before = [1] * n, [-1] * n  # before: the last suffix to the left that is in a lower group
    high = n
    while high:
        own = group[order[high - 1]]
        members = order[own:high]
        high = own
        size = length[own]
        if len(members) > 1:
            members.sort()
        calls: dict[int, int] = {}
        for i in members:
            out[i] = size
            p = i - 1
            while p >= 0 and group[p] > own:
                p = before[p]
            if p >= 0 and group[p] == own:
                p = before[p]
            before[i] = p
            if p >= 0:
                calls[p] = calls.get(p, 0) + 1
        if not calls:
            continue
        # Those called oftest leave first, so they end up highest; each goes right above its old group.
        leaving: dict[tuple[int, int], list[int]] = {}
        for p, times in calls.items():
            leaving.setdefault((-times, group[p]), []).append(p)
        for times, old in sorted(leaving) if len(leaving) > 1 else leaving:
            moved = leaving[times, old]
            to = last = end[old]
            grown = length[old] - times * size
            for p in moved:
                to -= 1
                k, other = at[p], order[to]
                order[k], order[to] = other, p
                at[other], at[p] = k, to
            for p in moved:
                group[p] = to
            end[old] = to  # nobody may be left: then the group keeps its beginning under the new name
            end[to], length[to] = last, grown
    return out


class _Extensions:
    """Longest common extensions of two places, for many pairs at once."""

    def __init__(self, codes: np.ndarray, seed: int):
        self.codes, n = codes, len(codes)
        self.tables = []
        for m, modulus in enumerate(_MODULI):
            base = np.uint64((0x9E3779B1 * (seed * 2 + m + 1)) % (int(modulus) - 1000) + 500)
            powers = np.ones(n + 1, np.uint64)
            have, step = 1, base
            while have <= n:
                more = min(have, n + 1 - have)
                powers[have:have + more] = powers[:more] * step % modulus
                step, have = step * step % modulus, have + more
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) % modulus * powers[:n] % modulus, out=sums[1:])
            self.tables.append((modulus, powers, sums % modulus))

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the `size` words from i and from j > i are equal, by hash."""
        good = np.ones(len(i), bool)
        for modulus, powers, sums in self.tables:
            x = (sums[i + size] + modulus - sums[i]) % modulus * powers[j - i] % modulus
            good &= x == (sums[j + size] + modulus - sums[j]) % modulus
        return good

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on and from j > i on are equal."""
        low, high = np.zeros(len(i), np.int64), len(self.codes) - j
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.same(i, j, middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j > i are equal."""
        low, high = np.zeros(len(i), np.int64), i.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.same(i - middle, j - middle, middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def runs_of(codes: np.ndarray, min_length: int = 2, min_periods: int = 2) -> list[tuple[int, int, int]]:
    """All runs as start, length, smallest period, by start and period: stretches of at least `min_periods` >= 2 periods
    and `min_length` numbers that no neighbour extends."""
    codes = np.asarray(codes, np.int64)
    n = len(codes)
    if n < max(2, min_length):
        return []
    _, codes = np.unique(codes, return_inverse=True)
    roots = np.stack([np.array(lyndon_array(c.tolist()), np.int64) for c in (codes, codes.max() - codes)])
    places = np.arange(n)
    places, periods = np.concatenate([places, places]), roots.ravel()
    inside = places + periods < n
    places, periods = places[inside], periods[inside]
    seed = 0
    while True:
        found: set[tuple[int, int, int]] = set()
        reach = _Extensions(codes, seed)
        for k in range(0, len(places), BLOCK):
            i, p = places[k:k + BLOCK], periods[k:k + BLOCK]
            left, right = reach.backward(i, i + p), reach.forward(i, i + p)
            length = left + p + right
            good = length >= np.maximum(min_length, min_periods * p)
            found.update(zip((i - left)[good].tolist(), length[good].tolist(), p[good].tolist(), strict=True))
        if all(np.array_equal(codes[s:s + size - p], codes[s + p:s + size]) for s, size, p in found):
            return sorted(found, key=lambda r: (r[0], r[2]))
        seed += 1


def stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """Parts of a text, as first and behind the last word, outside of which no run of MIN_PERIODS periods and MIN_LENGTH
    words can be. A run of L words and period q has L - 2 places for three words in sequence, 4 of one kind if q is 1, and
    else at least 4q - 2 >= 3q of q kinds; so what lies at such a place occurs three times in the run. What occurs less
    often in its part cuts the part, until nothing changes. A run with a word to extend it would be one run with that word,
    so no part ends where a run could go on."""
    n = len(codes)
    if n < MIN_LENGTH:
        return []
    top = int(codes.max()) + 1
    _, pairs = np.unique(codes[:-1] * top + codes[1:], return_inverse=True)
    _, triples = np.unique(pairs[:-1] * top + codes[2:], return_inverse=True)
    m, part = len(triples), np.zeros(n - 2, np.int64)
    left = np.arange(m)
    while len(left):
        _, kind, counts = np.unique(part[left] * m + triples[left], return_inverse=True, return_counts=True)
        good = left[counts[kind] >= 3]
        if not len(good):
            return []
        numbers = np.cumsum(np.diff(good, prepend=good[0]) > 1)
        long = np.bincount(numbers)[numbers] >= MIN_LENGTH - 2
        good, numbers = good[long], numbers[long]
        if len(good) == len(left):
            first = np.flatnonzero(np.diff(numbers, prepend=-1))
            last = np.append(first[1:], len(good)) - 1
            return [(int(good[a]), int(good[b]) + 3) for a, b in zip(first, last, strict=True)]
        left = good
        part[left] = numbers
    return []


def text_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """start, length, period of the runs of a text with at least MIN_LENGTH words and MIN_PERIODS periods."""
    if len(words) < MIN_LENGTH:
        return []
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) > len(words) - 3:  # after its first period a run has three words or more, none of them new
        return []
    return [(start + a, length, p) for a, b in stretches(codes) for start, length, p in runs_of(codes[a:b], MIN_LENGTH, MIN_PERIODS)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that some run has after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, p in runs:
        change[start + p] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def detect_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, runs, collapsed for every document: its runs by start and period, and the text with one period of each,
    words joined by one space.

    Words are what ASCII blanks separate. A run is a stretch of at least six words and four periods of its smallest
    period, counted in words from 0, that no neighbouring word extends. A null or empty text, like one of blanks only,
    has no runs and an empty collapsed text. Every row gives a row, repeated ids and null ids too; an empty table gives
    none. Only the two named columns are read. A text is worked on as a whole and alone, so tasks share nothing."""
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for raw in batch.column(1).cast(pa.binary()):
                words = (raw.as_py() or b"").split()
                runs = text_runs(words)
                found.append([{"start": s, "length": size, "period": p} for s, size, p in runs])
                texts.append(b" ".join(collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(run)), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(
        emit, f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string").withColumnRenamed("id", id_col)
