"""Alignment of two tokenizers over a corpus, each distinct text once.

Documents are grouped by their full text; each distinct text is tokenised by both tokenizers and aligned where tokens of
both end at the same byte. What a text says about pairs of ids counts as often as the text occurs, and the measures of a
text are joined to the ids of all documents that have it.

Neither tokenizer joins characters across a single space, so a text with only such blanks next to its spaces is aligned
space by space, and a word that comes again is looked up. Any other text is aligned as a whole."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import settle

_CACHE_UNITS, _CACHE_PAIRS = 400_000, 6_000_000
#: Texts aligned at a time, and pairs of ids up to which their counts are broadcast; beyond, the same join is shuffled.
TEXTS, BROADCAST_PAIRS = 512, 500_000
#: Link pairs of a group from which on equal ids are counted before they are paired.
_LARGE = 4096
#: Fixed: what counts as white space to either tokenizer, and more.
_BLANK = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_IRREGULAR = f"^{_BLANK}|{_BLANK}$| {_BLANK}|{_BLANK} "
#: A pair of ids as one number: the first times this plus the second.
PAIR = 1 << 32


def byte_characters() -> dict[str, int]:
    """The byte each character of a byte-level piece stands for: printable ones stand for themselves, the others, in
    order, have the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """The first tokenizer: byte-level pieces, special tokens' strings being plain text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        of = byte_characters()
        pieces = {i: p for p, i in self.tokenizer.get_vocab().items()}
        self.bytes = [bytes(of[c] for c in pieces[i]) if set(pieces.get(i, "\n")) <= of.keys() else b"" for i in range(max(pieces) + 1)]

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]


class Pieces:
    """The second: pieces with U+2581 for a space and one in front, other bytes by their number."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        name = self.model.id_to_piece
        self.bytes = [bytes([int(name(i)[3:-1], 16)]) if self.model.is_byte(i) else name(i).replace("▁", " ").encode()
                      for i in range(self.model.get_piece_size())]

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.model.encode(units, num_threads=1)


class _Unit:
    """What is known of aligned units, in columns: fragment of the group text, counts, and pairs from ends[i] to
    ends[i + 1] in pairs and times. Fragments are null where the units' bytes differ."""

    def __init__(self, fragments: list, counts: np.ndarray, ends: np.ndarray, pairs: np.ndarray, times: np.ndarray):
        self.fragments, self.counts, self.ends, self.pairs, self.times = fragments, counts, ends, pairs, times


class Aligner:
    """Aligns texts by two tokenizers with `encode` (a space in front of each unit) and `bytes`, those of each id."""

    def __init__(self, first, second):
        self.sides = (first, second)
        self.lengths = [np.array([len(b) for b in side.bytes], np.int64) for side in self.sides]
        texts = [[str(i) for i in range(len(side.bytes))] for side in self.sides]
        self.names = [[[t + s for t in texts[k]] for s in (",", "|;"[k])] for k in (0, 1)]  # with what follows: more, or the end
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.known = _Unit([], np.zeros((0, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _encoded(self, k: int, units: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units, whose unit each is, and which units' bytes are those of the text."""
        each = self.sides[k].encode(units)
        counts = np.array([len(ids) for ids in each], np.int64)
        ids = np.fromiter(chain.from_iterable(each), np.int64, int(counts.sum()))
        table = self.sides[k].bytes
        if b"".join(map(table.__getitem__, ids.tolist())) == b"".join(raw):
            whole = np.bincount(np.repeat(np.arange(len(units)), counts), self.lengths[k][ids], len(units))
            good = whole == np.array([len(r) for r in raw])
            if good.all():
                return ids, np.repeat(np.arange(len(units)), counts), good
        good = np.array([b"".join(map(table.__getitem__, x)) == r for x, r in zip(each, raw, strict=True)], bool)
        return ids, np.repeat(np.arange(len(units)), counts), good

    def align(self, units: list[str]) -> _Unit:
        """The units aligned, each with a space in front."""
        raw = [b" " + u.encode() for u in units]
        (a, a_of, a_good), (b, b_of, b_good) = (self._encoded(k, units, raw) for k in (0, 1))
        good = a_good & b_good
        a, a_of, b, b_of = a[good[a_of]], a_of[good[a_of]], b[good[b_of]], b_of[good[b_of]]
        a_ends, b_ends = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        cuts = np.intersect1d(a_ends, b_ends)  # ids without bytes end where the one before does
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        n = len(cuts)
        held_a, held_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        owner = np.zeros(n, np.int64)
        owner[a_group] = a_of
        # The text of the groups: ids of a group, first those of one side, each with what follows it.
        stops_a, stops_b = np.cumsum(held_a), np.cumsum(held_b)
        a_last, b_last = np.arange(1, len(a) + 1) == stops_a[a_group], np.arange(1, len(b) + 1) == stops_b[b_group]
        words = [self.names[0][e][i] for i, e in zip(a.tolist(), a_last.tolist(), strict=True)]
        words += [self.names[1][e][i] for i, e in zip(b.tolist(), b_last.tolist(), strict=True)]
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable").tolist()
        words = [words[i] for i in order]
        tokens = [np.bincount(x, minlength=len(units)) for x in (a_of, b_of)]
        ends = np.cumsum(tokens[0] + tokens[1]).tolist()
        fragments = ["".join(words[s:e])[:-1] if g else None for s, e, g in zip([0, *ends], ends, good.tolist(), strict=False)]
        # Pairs of ids that share a group.
        links = held_a * held_b
        small = links <= _LARGE
        group = np.repeat(np.arange(n)[small], links[small])
        at = np.arange(len(group)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
        left = a[(stops_a - held_a)[group] + at // np.maximum(held_b[group], 1)]
        right = b[(stops_b - held_b)[group] + at % np.maximum(held_b[group], 1)]
        found = [(owner[group], left * PAIR + right, np.ones(len(group), np.int64))]
        for g in np.flatnonzero(~small).tolist():
            x, nx = np.unique(a[stops_a[g] - held_a[g]:stops_a[g]], return_counts=True)
            y, ny = np.unique(b[stops_b[g] - held_b[g]:stops_b[g]], return_counts=True)
            found.append((np.full(len(x) * len(y), owner[g]), np.add.outer(x * PAIR, y).ravel(), np.multiply.outer(nx, ny).ravel()))
        of, pairs, times = summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
        counts = np.stack([*tokens, np.bincount(owner, minlength=len(units)),
                           np.bincount(of, times, len(units)).astype(np.int64)], axis=1)
        return _Unit(fragments, counts, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(units)))]), pairs, times)

    def _learn(self, words: list[str]) -> None:
        new, old = self.align(words), self.known
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.known = _Unit(old.fragments + new.fragments, np.concatenate([old.counts, new.counts]), np.concatenate([old.ends, old.ends[-1] + new.ends[1:]]),
                           np.concatenate([old.pairs, new.pairs]), np.concatenate([old.times, new.times]))

    def regular(self, texts: pa.Array) -> _Unit:
        """Texts without two blanks side by side of which one is a space, and without blanks at their ends."""
        if len(self.number) > _CACHE_UNITS or len(self.known.pairs) > _CACHE_PAIRS:
            self._forget()
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy()
        words = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        names = words.dictionary.to_pylist()
        self._learn([w for w in names if w not in self.number])
        known = self.known
        which = np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))
        fragments = pa.array([known.fragments[i] for i in which.tolist()], pa.string())
        at = words.indices.to_numpy()
        # A join with a null in it is null: then the text's bytes differ.
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fragments.take(pa.array(at))), ";").to_pylist()
        units, of = which[at], np.repeat(np.arange(len(texts)), np.diff(offsets))
        counts = np.stack([np.bincount(of, known.counts[units, c], len(texts)) for c in range(4)], axis=1).astype(np.int64)
        # Once for each unit of a text: a word that a text has often is often in few rows.
        of, units, repeats = summed(of, units, np.ones(len(of), np.int64))
        sizes = known.ends[units + 1] - known.ends[units]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        rows = np.repeat(known.ends[units] - stops + sizes, sizes) + np.arange(total)
        of, pairs, times = summed(np.repeat(of, sizes), known.pairs[rows], known.times[rows] * np.repeat(repeats, sizes))
        return _Unit(joined, counts, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]), pairs, times)

    def texts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, _Unit]]:
        """Rows of the given texts, none of them null or empty, and these aligned."""
        odd = pc.match_substring_regex(texts, _IRREGULAR)
        for kind, how in ((pc.invert(odd), self.regular), (odd, lambda x: self.align(x.to_pylist()))):
            rows = np.flatnonzero(kind.to_numpy(zero_copy_only=False))
            if len(rows):
                yield rows, how(texts.filter(kind))


def summed(of: np.ndarray, values: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (of, value) once, in order, with the sum of their times."""
    if not len(of):
        return of.astype(np.int64), values, times
    kinds, values = np.unique(values, return_inverse=True)
    keys, places = np.unique(of * len(kinds) + values, return_inverse=True)
    return keys // len(kinds), kinds[keys % len(kinds)], np.bincount(places, times, len(keys)).astype(np.int64)


def align_texts(texts: DataFrame, first: str, second: str, text_col: str = "text") -> DataFrame:
    """Every row of `texts` with n_a, n_b, n_groups, n_links, the groups as text (ids of the first tokenizer, a bar, ids of
    the second; groups parted by semicolons), and its pairs of ids with how many links each has.

    first and second are the files of a byte-level and of a piece tokenizer, at a path that every executor has. A null
    or empty text, and one whose tokens do not spell it, has no tokens: zeros, an empty text, no pairs."""
    columns = [f.name for f in texts.schema]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    at = columns.index(text_col)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for whole in batches:
            aligner = aligner or Aligner(ByteLevel(first), Pieces(second))
            for k in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(k, TEXTS)
                column = pc.fill_null(batch.column(at), "")
                there = np.flatnonzero(pc.not_equal(column, "").to_numpy(zero_copy_only=False))
                n = batch.num_rows
                counts, groups, lists = np.zeros((n, 4), np.int64), np.full(n, "", object), [np.zeros(n, np.int64)]
                pairs, times, rows_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for rows, found in aligner.texts(column.take(pa.array(there))) if len(there) else ():
                    rows = there[rows]
                    good = np.array([f is not None for f in found.fragments], bool)
                    counts[rows[good]] = found.counts[good]
                    groups[rows] = [f or "" for f in found.fragments]
                    of = np.repeat(np.arange(len(rows)), np.diff(found.ends))
                    mine = good[of]
                    rows_of.append(rows[of][mine]), pairs.append(found.pairs[mine]), times.append(found.times[mine])
                of = np.concatenate(rows_of)
                order = np.argsort(of, kind="stable")
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x)[order])) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(counts[:, c]) for c in range(4)), pa.array(groups.tolist(), pa.string()), *lists],
                    [*columns, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return texts.mapInArrow(emit, f"{kinds}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
                                  "pairs array<bigint>, times array<bigint>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, documents, best of aligned distinct texts with `copies`: in how many documents a pair is linked, and whether
    no pair with the same first id is in more."""
    counts = aligned.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("documents"))
    counts = settle(counts, "pair-counts")
    most = counts.groupBy(F.floor(F.col("pair") / PAIR).alias("a")).agg(F.max("documents").alias("most"))
    return counts.withColumn("a", F.floor(F.col("pair") / PAIR)).join(most, "a").select(
        "pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def alignment_measures(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document id_col, n_a, n_b, n_groups, n_links, n_best (links whose pair is linked in as many documents as
    any pair of its first id), count_sum (over its links, the documents their pair is linked in), groups_sha256.

    A text without tokens has zeros and an empty groups_sha256. Copies of a text are aligned once and share their row of
    measures; how many there are only weighs the counts, so a text that a third of all documents have costs one row
    for each task that reads it. Every row gives a row, null and repeated ids too; an empty table gives none. Only the
    two named columns are read. Texts meet again by their SHA-256."""
    picked = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    distinct = picked.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    keyed = align_texts(distinct, first, second).withColumns({"key": F.unhex(F.sha2("text", 256)), "groups_sha256": F.sha2("groups", 256)})
    aligned = settle(keyed.filter("n_a > 0").drop("text", "groups"), "aligned")
    counts = settle(pair_counts(aligned), "best-pairs")
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    links = aligned.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("key", F.col("link.pairs").alias("pair"), "link.times")
    sums = links.join(counts, "pair").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    measures = aligned.join(sums, "key").select("key", *numbers, "groups_sha256")
    each = picked.select("doc", F.unhex(F.sha2("text", 256)).alias("key"))
    return each.join(measures, "key", "left").select(
        F.col("doc").alias(id_col), *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
