"""Sharding by a keyed permutation of row numbers.

Rows get a dense number in the order of their key. A balanced Feistel network permutes the smallest range of an even
number of bits that holds all numbers; results beyond the last row are sent through again until they land inside
(cycle walking), which keeps it a permutation of exactly the rows. Place p goes to shard p mod k, slot p div k. Both
directions are computable for any row without looking at another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered

ROUNDS = 8


class FeistelPermutation:
    """A permutation of 0 .. size-1, fixed by size and seed."""

    def __init__(self, size: int, seed: int):
        self.size = size
        self.half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        steps = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.keys = list(self._mix(steps + np.array([seed & (2**64 - 1)], np.uint64)))

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        """The finishing steps of splitmix64, arithmetic modulo 2**64."""
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def _through(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (self._mix(left + key) & self.mask), left
            else:
                left, right = right, left ^ (self._mix(right + key) & self.mask)
        return (left << self.half) | right

    def _walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        out = np.asarray(numbers, np.uint64).copy()
        if self.size and len(out) and int(out.max()) >= self.size:
            raise ValueError("row number outside the table")
        todo = np.arange(len(out))
        with np.errstate(over="ignore"):
            while len(todo):
                out[todo] = self._through(out[todo], back)
                todo = todo[out[todo] >= np.uint64(self.size)]
        return out.astype(np.int64)

    def place(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, back=False)

    def row(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, back=True)


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """The columns of `df` named in `order`, and row, shard, slot. Shard sizes differ by one row at most, slots
    count from 0 without gaps, and the result depends on the rows, `shards` and `seed` alone. Rows that agree in all
    columns of `order` are interchangeable. Null keys come first; an empty table gives an empty result."""
    if shards < 1:
        raise ValueError("at least one shard")
    rows = numbered(df.select(*order), order, "row")
    size = rows.count()
    permutation = FeistelPermutation(size, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = permutation.place(batch.column("row").to_numpy())
            columns = [*batch.columns, pa.array((at % shards).astype(np.int32)), pa.array(at // shards)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "shard", "slot"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(place, f"{fields}, shard int, slot bigint")


def row_at(shard: int, slot: int, size: int, shards: int, seed: int = 0) -> int:
    """The row number that stands at a slot of a shard; the inverse of shard_rows."""
    return int(FeistelPermutation(size, seed).row(np.array([slot * shards + shard]))[0])


def shard_documents(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot for all documents. size is the text's UTF-8 bytes plus 1, 1 for a
    null text; its crc32 is that of no bytes. Texts are read once and not moved."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    slim = docs.select(F.col("doc_id"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(slim, ["doc_id", "size", "text_crc32"], shards, seed)
