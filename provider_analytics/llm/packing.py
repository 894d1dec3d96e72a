"""Vector bin packing of token sequences.

Examples have three demands: tokens, one segment, and loss-bearing tokens. Sequences are filled one at a time: of the
examples at hand that fit, the one whose demand has the largest dot product with what the sequence has left goes in.
When none fits, one is cut to fill the rest. Every task packs its own partition as a stream and keeps a bounded pool,
so no text moves between machines, and only the last sequence of a partition can be short."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

_CACHE_PARTS, _CACHE_TOKENS = 500_000, 6_000_000
#: Letters whose words are looked up in lower case, and marks that may stand behind such a word.
_LETTERS, _MARKS = "a-zA-ZÀ-ÖØ-öø-ÿ", ".,:;!?()[]{}/*+-=#$%&@_~^\""
_EACH_LETTER = "".join(c for c in map(chr, range(256)) if re.match(f"[{_LETTERS}]", c))


class ChunkTokenizer:
    """Token ids of whole texts, by way of the chunks between blanks, each distinct one of a batch looked up once.

    The tokenizer never joins characters across a blank, so a text's ids are those of its chunks in order. Latin letters
    with marks behind them are a lower-case word and a run of marks, which the tokenizer separates as well; apostrophes
    and what special tokens are written with are no such marks. A
    part is a word, a run of marks or any other chunk; a chunk is two parts, the second mostly the empty one. Ids of
    parts are remembered; the memory is emptied when large. `last` ends every text."""

    def __init__(self, path: str, last: int | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.last = Tokenizer.from_file(path), last
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.part: dict[str, int] = {}
        self.ends = np.zeros(1, np.int64)  # of each part in ids, from the second on
        self._add_parts([""], np.zeros(0, np.int32), np.zeros(1, np.int64))

    def _add_parts(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.part.update(zip(parts, range(len(self.part), len(self.part) + len(parts)), strict=True))
        self.ends = np.concatenate([self.ends, self.used + np.cumsum(lengths)])
        self.used += len(ids)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(encoded), np.int32), np.array([len(ids) for ids in encoded], np.int64)

    def _numbers(self, parts: pa.Array, words: bool) -> np.ndarray:
        """The number of each part; those that are new are tokenised first."""
        distinct = parts.dictionary_encode()
        names = distinct.dictionary.to_pylist()
        new = [name for name in names if name not in self.part]
        if words:  # together in one text, which is cut where a token ends a word
            ids, _ = self._encode([" ".join(new[i:i + 64]) for i in range(0, len(new), 64)])
            self._add_parts(new, ids, np.diff(np.flatnonzero(self.ends_word[ids]) + 1, prepend=0))
        else:
            self._add_parts(new, *self._encode(new))
        return np.fromiter(map(self.part.__getitem__, names), np.int64, len(names))[distinct.indices.to_numpy()]

    def _lists(self, chunks: pa.Array) -> pa.ListArray:
        """The ids of each of the chunks, and `last` behind them."""
        core = pc.utf8_rtrim(chunks, _MARKS)
        plain = pc.match_substring_regex(core, f"^[{_LETTERS}]+$")
        odd = pc.invert(plain).to_numpy(zero_copy_only=False)
        heads, tails = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        heads[~odd] = self._numbers(pc.utf8_lower(core.filter(plain)), words=True)
        tails[~odd] = self._numbers(pc.utf8_ltrim(chunks.filter(plain), _EACH_LETTER), words=False)
        heads[odd] = self._numbers(chunks.filter(pa.array(odd)), words=False)
        parts = np.stack([heads, tails], axis=1).ravel()
        starts = self.ends[parts]
        lengths = self.ends[parts + 1] - starts
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.ids[np.repeat(starts - stops + lengths, lengths) + np.arange(total)]
        offsets = np.concatenate([[0], stops[1::2], [total + (self.last is not None)]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids if self.last is None else np.append(ids, np.int32(self.last))))

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has. The blanks that split here are white space
        to the tokenizer as well."""
        if len(self.part) > _CACHE_PARTS or self.used > _CACHE_TOKENS:
            self._forget()
        split = pc.ascii_split_whitespace(texts)
        ends = split.offsets.to_numpy()
        chunks = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        at, ends = chunks.indices.to_numpy(), ends[1:] - ends[0]
        at = np.insert(at, ends, len(chunks.dictionary))  # what ends a text
        lists = self._lists(chunks.dictionary).take(pa.array(at))
        stops = lists.offsets.to_numpy()[ends + np.arange(len(ends)) + 1]
        return lists.values.to_numpy(), np.diff(stops.astype(np.int64), prepend=0)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not texts:
            return []
        ids, counts = self.flat(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(counts[:-1]))


def tokenize(df: DataFrame, tokenizer: str, last: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids: the token ids of every whole text as little-endian unsigned 32-bit numbers, with `last` at the end.
    A null text counts as empty. `tokenizer` is the path of a tokenizer file that every executor has."""
    kind = df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or ChunkTokenizer(tokenizer, last)
            ids, counts = encoder.flat(batch.column(1))
            ends = np.concatenate([[0], 4 * np.cumsum(counts)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["id", "ids"])

    picked = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return picked.mapInArrow(tidied(encode), f"id {kind}, ids binary").withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold."""

    tokens: int = 4096
    segments: int = 128
    loss: int = 4096

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits are at least 1")


@dataclass
class _Example:
    key: int
    ids: np.ndarray
    loss: np.ndarray | None  # running count of loss-bearing tokens, from 0; None where every token bears loss
    start: int
    end: int

    def demand(self) -> tuple[int, int]:
        tokens = self.end - self.start
        return tokens, tokens if self.loss is None else int(self.loss[self.end] - self.loss[self.start])

    def fits_up_to(self, tokens: int, loss: int) -> int:
        """How many tokens from the start fit."""
        most = min(tokens, self.end - self.start)
        if self.loss is None:
            return min(most, loss)
        return min(most, int(np.searchsorted(self.loss, self.loss[self.start] + loss, side="right")) - 1 - self.start)


class Packer:
    """Fills sequences from a pool. `emit` takes (key, ids, start, length, total, sequence, offset)."""

    def __init__(self, limits: Limits, emit, pool: int = 1024, cut: bool = True):
        self.limits, self.emit, self.pool, self.cut = limits, emit, pool, cut
        self.examples: list[_Example] = []
        self.tokens, self.loss = np.zeros(2 * pool, np.int64), np.zeros(2 * pool, np.int64)
        self.sequence = 0

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None = None) -> None:
        """loss: whether each token bears loss."""
        running = None if loss is None else np.concatenate([[0], np.cumsum(loss)])
        self._push(_Example(key, ids, running, 0, len(ids)))
        if len(self.examples) >= 2 * self.pool:
            self.run(self.pool)

    def _push(self, example: _Example) -> None:
        """Into the pool, without the parts that fill a sequence by themselves."""
        while True:
            tokens, loss = example.demand()
            if tokens <= self.limits.tokens and loss <= self.limits.loss:
                break
            piece = example.fits_up_to(self.limits.tokens, self.limits.loss)
            self._place(example, piece, 0)
            self.sequence += 1
        at = len(self.examples)
        self.examples.append(example)
        self.tokens[at], self.loss[at] = tokens, loss

    def _place(self, example: _Example, piece: int, offset: int) -> None:
        self.emit(example.key, example.ids, example.start, piece, len(example.ids), self.sequence, offset)
        example.start += piece

    def _drop(self, at: int) -> None:
        last = len(self.examples) - 1
        self.examples[at] = self.examples[last]
        self.tokens[at], self.loss[at] = self.tokens[last], self.loss[last]
        self.examples.pop()

    def run(self, leave: int = 0) -> None:
        """Fill sequences until at most `leave` examples are left."""
        while len(self.examples) > leave:
            self._fill()

    def _fill(self) -> None:
        limits, offset, segments, loss = self.limits, 0, 0, 0
        while self.examples and segments < limits.segments and offset < limits.tokens:
            n = len(self.examples)
            free = limits.tokens - offset, limits.segments - segments, limits.loss - loss
            tokens, losses = self.tokens[:n], self.loss[:n]
            # Dot product of demand and what is left, both as shares of the limits; the segment's part is the same for all.
            score = tokens * (free[0] / limits.tokens**2) + losses * (free[2] / limits.loss**2)
            score[(tokens > free[0]) | (losses > free[2])] = -1.0
            at = int(score.argmax())
            if score[at] >= 0:
                example = self.examples[at]
                piece = int(tokens[at])
                loss += int(losses[at])
                self._place(example, piece, offset)
                self._drop(at)
            elif not self.cut:
                break
            else:
                at = int(tokens.argmax())
                example = self.examples[at]
                piece = example.fits_up_to(free[0], free[2])
                if piece <= 0:
                    break
                before = example.demand()[1]
                self._place(example, piece, offset)
                self.tokens[at], self.loss[at] = example.demand()
                loss += before - int(self.loss[at])
            offset += piece
            segments += 1
        self.sequence += 1


def pack(df: DataFrame, limits: Limits, id_col: str = "doc_id", ids_col: str = "ids", loss_col: str | None = None,
         cut: bool = True) -> DataFrame:
    """One row for each piece: id_col, start, length, ids, doc_tokens, sequence_id, offset. Every token of every example
    is in exactly one piece; pieces stand gapless from offset 0; no sequence exceeds a limit.

    `ids_col` holds little-endian unsigned 32-bit ids; null or empty ones give no piece. `loss_col`, if given, holds one
    byte for each token, not 0 where it bears loss; without it, or where it is null, all do. With cut=False only
    examples beyond a limit are cut. sequence_id is unique in the result: the partition's number and a count in
    it, so a task that runs again gives the same. Only the named columns are read; repeated rows are packed each."""
    kind = df.schema[id_col].dataType.simpleString()
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
              ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        keys, rows = [], []

        def emit(key, ids, start, length, total, sequence, offset):
            keys.append(key)
            rows.append((start, length, ids[start:start + length].tobytes(), total, base + sequence, offset))

        def result(type_):
            columns = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)]
            batch = pa.RecordBatch.from_arrays([pa.array(keys, type_), *columns], ["id", *(n for n, _ in fields)])
            keys.clear()
            rows.clear()
            return batch

        packer, type_ = Packer(limits, emit, cut=cut), None
        for batch in batches:
            type_ = batch.schema.types[0]
            for key, ids, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if ids:
                    packer.add(key, np.frombuffer(ids, "<u4"), None if loss is None else np.frombuffer(loss, np.uint8) != 0)
                if len(rows) >= 1024:
                    yield result(type_)
        packer.run()
        if rows:
            yield result(type_)

    loss = F.lit(None).cast("binary") if loss_col is None else F.col(loss_col)
    picked = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"), loss.alias("loss"))
    schema = f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return picked.mapInArrow(tidied(run), schema).withColumnRenamed("id", id_col)
