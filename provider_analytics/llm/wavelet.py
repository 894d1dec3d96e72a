"""Token ids in wavelet-matrix files, one file a shard.

A wavelet matrix keeps one plane of bits for each bit of an id, from the highest down. Each plane holds that bit of every
id in the order the planes above give: stably parted, ids with a 0 before ids with a 1. With the count of ones before
each block, a rank takes one block, and token access, counting and the place of an occurrence take one rank or select a
plane. Blocks are compressed one by one, so a question opens a few blocks of a file, and reading everything runs the
partings backwards.

A file is: magic, length of the header, header (JSON), then for each plane its blocks, the ends of these and the ones
before each, and the documents (an Arrow stream of ids and token counts)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import scratch_path
from .common import BATCH_ROWS, batches_of
from .packing import ChunkTokenizer

MAGIC = b"WVMATRX1"
#: Bits of a block, and tokens from which on a shard takes no further document.
BLOCK_BITS, SHARD_TOKENS = 1 << 16, 1 << 20
_BLOCK_BYTES = BLOCK_BITS // 8
#: Bytes of a row group of the table of files, so that readers hold few files at a time.
_ROW_GROUP = 16 << 20


def parted(values: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The values with a 0 before those with a 1, each in their order."""
    return np.concatenate([values.take(np.flatnonzero(~ones)), values.take(np.flatnonzero(ones))])


def build(tokens: np.ndarray, documents: pa.RecordBatch) -> bytes:
    """The file of a shard. tokens: the ids of all its documents; documents: columns id and tokens, how many each has."""
    n = len(tokens)
    levels = max(1, int(tokens.max(initial=0)).bit_length())
    values = tokens.astype(np.uint16 if levels <= 16 else np.uint32)
    compressor = zstandard.ZstdCompressor(level=1)
    parts: list[bytes] = []
    at = 0

    def put(raw: bytes) -> list[int]:
        nonlocal at
        parts.append(raw)
        at += len(raw)
        return [at - len(raw), len(raw)]

    planes = []
    for level in range(levels - 1, -1, -1):
        ones = (values & values.dtype.type(1 << level)) != 0
        raw = np.packbits(ones, bitorder="little").tobytes()
        blocks = [raw[k:k + _BLOCK_BYTES] for k in range(0, len(raw), _BLOCK_BYTES)]
        stored = [compressor.compress(b) for b in blocks]
        held = [int(np.bitwise_count(np.frombuffer(b, np.uint8)).sum()) for b in blocks]
        planes.append({
            "blocks": put(b"".join(stored)), "ends": put(np.cumsum([len(b) for b in stored], dtype="<u4").tobytes()),
            "before": put(np.concatenate([[0], np.cumsum(held)]).astype("<u4").tobytes()), "zeros": n - sum(held)})
        values = parted(values, ones)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(documents)
    head = json.dumps({"tokens": n, "planes": planes, "documents": put(sink.getvalue().to_pybytes())}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *parts])


class WaveletFile:
    """Answers from the bytes of one file. Places count from 0 over the tokens of the shard."""

    def __init__(self, raw: bytes, cached: int = 64):
        raw = memoryview(raw)
        if raw[:8] != MAGIC:
            raise ValueError("no wavelet-matrix file")
        start = 12 + int.from_bytes(raw[8:12], "little")
        head = json.loads(bytes(raw[12:start]))
        self._raw, self._start, self._head = raw, start, head
        self.tokens: int = head["tokens"]
        self.levels = len(head["planes"])
        self.zeros = [p["zeros"] for p in head["planes"]]
        self._ends = [np.frombuffer(self._section(p["ends"]), "<u4") for p in head["planes"]]
        self._before = [np.frombuffer(self._section(p["before"]), "<u4").astype(np.int64) for p in head["planes"]]
        self._block = lru_cache(maxsize=cached)(self._read_block)

    def _section(self, place: list[int]) -> memoryview:
        return self._raw[self._start + place[0]:self._start + place[0] + place[1]]

    def _read_block(self, plane: int, block: int) -> np.ndarray:
        """The bits of a block, each as a byte."""
        ends = self._ends[plane]
        stored = self._section(self._head["planes"][plane]["blocks"])[int(ends[block - 1]) if block else 0:int(ends[block])]
        bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(stored)), np.uint8), bitorder="little")
        return bits[:min(BLOCK_BITS, self.tokens - block * BLOCK_BITS)]

    def documents(self) -> pa.RecordBatch:
        """Columns id and tokens, in the order of their tokens."""
        table = pa.ipc.open_stream(self._section(self._head["documents"])).read_all().combine_chunks()
        return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)

    def rank(self, plane: int, place: int) -> int:
        """Ones of a plane before a place."""
        block, rest = divmod(place, BLOCK_BITS)
        return int(self._before[plane][block]) + (int(np.count_nonzero(self._block(plane, block)[:rest])) if rest else 0)

    def select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th bit, from 0, of this kind in a plane."""
        before = self._before[plane]
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK_BITS, self.tokens) - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * BLOCK_BITS + int(np.flatnonzero(self._block(plane, block) == bit)[k - int(before[block])])

    def access(self, place: int) -> int:
        """The token at a place."""
        if not 0 <= place < self.tokens:
            raise IndexError(place)
        token = 0
        for plane in range(self.levels):
            bit = int(self._block(plane, place // BLOCK_BITS)[place % BLOCK_BITS])
            ones = self.rank(plane, place)
            place = self.zeros[plane] + ones if bit else place - ones
            token = 2 * token + bit
        return token

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where, below the last plane, the occurrences of a token among the places from start to before stop stand."""
        if token < 0 or token >> self.levels:
            return 0, 0
        for plane in range(self.levels):
            a, b = self.rank(plane, start), self.rank(plane, stop)
            if token >> (self.levels - 1 - plane) & 1:
                start, stop = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often a token occurs from start to before stop."""
        a, b = self._range(token, start, self.tokens if stop is None else stop)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of a token, from 0."""
        first, end = self._range(token, 0, self.tokens)
        if not 0 <= k < end - first:
            raise IndexError(k)
        place = first + k
        for plane in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - plane) & 1
            place = self.select(plane, bit, place - self.zeros[plane] if bit else place)
        return place

    def occurrences(self, token: int) -> np.ndarray:
        """All places of a token, ascending."""
        first, end = self._range(token, 0, self.tokens)
        places = np.arange(first, end)
        for plane in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - plane) & 1
            places = self._selected(plane, bit, places - self.zeros[plane] if bit else places)
        return places

    def _selected(self, plane: int, bit: int, ks: np.ndarray) -> np.ndarray:
        """select for ascending numbers; a block is opened once."""
        before = self._before[plane]
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK_BITS, self.tokens) - before
        blocks = np.searchsorted(before, ks, side="right") - 1
        out = np.empty_like(ks)
        for block in np.unique(blocks).tolist():
            mine = blocks == block
            out[mine] = block * BLOCK_BITS + np.flatnonzero(self._block(plane, block) == bit)[ks[mine] - before[block]]
        return out

    def all_tokens(self) -> np.ndarray:
        """Every token in order: the partings of the planes undone from the last to the first."""
        values = np.zeros(self.tokens, np.uint16 if self.levels <= 16 else np.uint32)
        for plane in range(self.levels - 1, -1, -1):
            blocks = [self._read_block(plane, k) for k in range(len(self._ends[plane]))]
            ones = np.concatenate(blocks).view(bool) if blocks else np.zeros(0, bool)
            before = np.empty_like(values)
            before[np.flatnonzero(~ones)] = values[:self.zeros[plane]]
            before[np.flatnonzero(ones)] = values[self.zeros[plane]:]
            values = before | (ones.astype(values.dtype) << (self.levels - 1 - plane))
        return values


def write_shards(docs: DataFrame, tokenizer: str, last: int | None, id_col: str = "doc_id", text_col: str = "text",
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Tokenise all texts and write them as wavelet-matrix files in ascending order of id_col: a table with one row a
    file, of shard (its order), start (tokens before it), tokens, documents and file, in the folder the cluster shares.

    `tokenizer` is the path of a tokenizer file that every executor has; `last`, if given, ends every document. Null ids
    come first, rows with equal ids by text; a null text counts as empty. A document is in one file, so a file
    holds `shard_tokens` or one document beyond that; an empty table gives no file. Rows are dealt by range of id,
    text hash and place, so even one id with most rows spreads over tasks. Only the named columns are read."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, number, start = None, 0, 0
        ids: list = []
        tokens: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal number, start, held
            documents = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(np.concatenate(counts))], ["id", "tokens"])
            file = build(np.concatenate(tokens), documents)
            row = {"part": part, "number": number, "start": start, "tokens": held, "documents": documents.num_rows, "file": file}
            number, start, held = number + 1, start + held, 0
            ids.clear(), tokens.clear(), counts.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("start", pa.int64()), ("tokens", pa.int64()),
                            ("documents", pa.int64()), ("file", pa.binary())])
        for batch in batches:
            encoder = encoder or ChunkTokenizer(tokenizer, last)
            flat, lengths = encoder.flat(batch.column(1))
            at, stops = 0, np.cumsum(lengths)
            while at < batch.num_rows:  # documents up to the one that fills the shard
                done = int(stops[at - 1]) if at else 0
                to = min(int(np.searchsorted(stops, done + shard_tokens - held)) + 1, batch.num_rows)
                ids.append(batch.column(0).slice(at, to - at))
                tokens.append(flat[done:int(stops[to - 1])].astype(np.uint32))
                counts.append(lengths[at:to])
                held += int(stops[to - 1]) - done
                at = to
                if held >= shard_tokens:
                    yield close()
        if ids:
            yield close()

    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tied = picked.withColumn("hash", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    order = ["id", "hash", "at"]
    ranged = tied.repartitionByRange(*order).sortWithinPartitions("id", "hash", "text", "at").select("id", "text")
    made = ranged.mapInArrow(emit, "part int, number int, start bigint, tokens bigint, documents bigint, file binary")
    path = scratch_path(spark, "wavelet-files")
    batches_of(spark, 4 * BATCH_ROWS)  # a chunk is looked up once a batch
    made.write.option("parquet.block.size", _ROW_GROUP).parquet(path)
    batches_of(spark, BATCH_ROWS)
    files = spark.read.schema(made.schema).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task that wrote
    parts = files.groupBy("part").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("_t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"))
    placed = files.join(F.broadcast(parts), "part")
    return placed.select((F.col("_n") + F.col("number")).alias("shard"), (F.col("_t") + F.col("start")).alias("start"),
                         "tokens", "documents", "file").withMetadata("file", {"id": kind})


def _each_file(files: DataFrame, columns: list[str], schema: str, rows) -> DataFrame:
    """Rows made from each file. rows(file, *columns) gives record batches."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file = WaveletFile(batch.column(0)[i].as_buffer())
                yield from rows(file, *(batch.column(k + 1)[i].as_py() for k in range(len(columns))))

    return files.select("file", *columns).mapInArrow(read, schema)


def read_documents(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, start, tokens, ids for every document of the files: the tokens before it, how many it has, and these as
    little-endian unsigned 32-bit numbers, read back from the planes."""
    kind = files.schema["file"].metadata["id"]

    def rows(file: WaveletFile, start: int) -> Iterator[pa.RecordBatch]:
        documents, flat = file.documents(), file.all_tokens().astype("<u4")
        counts = documents.column(1).to_numpy()
        stops = np.concatenate([[0], np.cumsum(counts)])
        for k in range(0, documents.num_rows, 4096):
            part = documents.slice(k, 4096)
            own = stops[k:k + part.num_rows + 1]
            packed = pa.Array.from_buffers(
                pa.binary(), part.num_rows, [None, pa.py_buffer((4 * (own - own[0])).astype(np.int32)), pa.py_buffer(flat[own[0]:own[-1]])])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(start + own[:-1]), part.column(1), packed], ["id", "start", "tokens", "ids"])

    return _each_file(files, ["start"], f"id {kind}, start bigint, tokens bigint, ids binary", rows).withColumnRenamed("id", id_col)


def find_token(files: DataFrame, token: int, id_col: str = "doc_id") -> DataFrame:
    """id_col, place for every occurrence of a token, the place counted from 0 in its document. Of the planes only the
    blocks on the way to an occurrence are opened; files without the token are settled by its count."""
    kind = files.schema["file"].metadata["id"]

    def rows(file: WaveletFile) -> Iterator[pa.RecordBatch]:
        if not file.count(token):
            return
        documents, places = file.documents(), file.occurrences(token)
        stops = np.cumsum(documents.column(1).to_numpy())
        owner = np.searchsorted(stops, places, side="right")
        starts = stops - documents.column(1).to_numpy()
        for k in range(0, len(places), 100_000):
            part = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays(
                [documents.column(0).take(pa.array(owner[part])), pa.array(places[part] - starts[owner[part]])], ["id", "place"])

    return _each_file(files, [], f"id {kind}, place bigint", rows).withColumnRenamed("id", id_col)


def count_tokens(files: DataFrame, tokens: list[int]) -> DataFrame:
    """token, occurrences over all files for each of the given tokens, by ranks alone; 0 where a token is in no file."""
    wanted = sorted(set(tokens))

    def rows(file: WaveletFile) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([file.count(t) for t in wanted], pa.int64())], ["token", "n"])

    counted = _each_file(files, [], "token bigint, n bigint", rows)
    given = files.sparkSession.createDataFrame([(t, 0) for t in wanted], "token bigint, n bigint")
    return counted.unionByName(given).groupBy("token").agg(F.sum("n").alias("occurrences"))

