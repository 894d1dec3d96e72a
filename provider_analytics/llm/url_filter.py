"""URL filter over a sorted digest array.

The list of rules becomes one file: 64-bit xxhash keys in ascending order, the offsets of the rule strings and the
strings themselves. Tasks map the file into memory, so all workers of a machine share its pages, look all
candidates of a batch up with one vectorised binary search, and confirm every key that is found against the stored
string, so a collision of digests never decides."""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file travels to every executor; longer lists are refused, never cut.
MAX_RULES = 50_000_000
_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, A-Z in lower case; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_after_scheme(url), "/", 1)).otherwise("")
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.translate(host, _ASCII_UPPER, _ASCII_LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    plain = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    path = F.when(F.instr(plain, "/") > 0, F.substring(plain, F.instr(plain, "/"), F.length(plain))).otherwise("")
    return F.when(F.instr(url, "://") > 0, path).otherwise("")


def _after_scheme(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def write_digest_file(rules: Iterable[tuple[str, str]], path: str) -> None:
    """Rules are (rule, verdict); a rule is a host and a path prefix, `net/es/`. The first of equal rules counts."""
    unique = dict(reversed([(rule.encode(), verdict) for rule, verdict in rules]))
    if len(unique) > MAX_RULES:
        raise ValueError(f"{len(unique)} rules; a digest file takes {MAX_RULES}")
    if bad := sorted(set(unique.values()) - {"allow", "block"}):
        raise ValueError(f"verdicts are allow or block, not {bad}")
    texts = sorted(unique, key=lambda text: (xxhash.xxh64_intdigest(text), text))
    keys = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
    ends = np.cumsum([0, *map(len, texts)], dtype=np.uint64)
    lengths = sorted({len(text) - _host_length(text) for text in texts})
    with open(path, "wb") as out:
        out.write(np.array([len(texts), len(lengths), *lengths], np.uint64).tobytes())
        out.write(keys.tobytes() + ends.tobytes())
        out.write(bytes(unique[text] == "block" for text in texts) + b"".join(texts))


def _host_length(rule: bytes) -> int:
    return rule.index(b"/") if b"/" in rule else len(rule)


class DigestArray:
    """A mapped digest file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        n, k = np.frombuffer(data, np.uint64, 2)
        n, k = int(n), int(k)
        self.path_lengths = [int(x) for x in np.frombuffer(data, np.uint64, k, 16)]
        self.keys = np.frombuffer(data, np.uint64, n, 16 + 8 * k)
        self.ends = np.frombuffer(data, np.uint64, n + 1, 16 + 8 * (k + n))
        self.blocks = np.frombuffer(data, np.uint8, n, 24 + 8 * (k + 2 * n))
        self.data, self.texts_at = data, 24 + 8 * (k + 2 * n) + n

    def text(self, at: int) -> bytes:
        return self.data[self.texts_at + int(self.ends[at]):self.texts_at + int(self.ends[at + 1])]

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """For each wanted string its place in the array, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys) or not wanted:
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, wanted), np.uint64, len(wanted))
        at = np.searchsorted(self.keys, keys)
        open_ = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys))
        for i in open_:
            place = int(at[i])
            while place < len(self.keys) and self.keys[place] == keys[i]:
                if self.text(place) == wanted[i]:
                    out[i] = place
                    break
                place += 1
        return out

    def judge(self, hosts: list[bytes], paths: list[bytes]) -> list[tuple[bytes, bool] | None]:
        """The longest rule that fits each host and path, and whether it blocks. Of rules of one length the one
        with the longer host wins."""
        wanted, owner = [], []
        for row, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            suffix = host
            while suffix:
                for length in self.path_lengths:
                    if length <= len(path):
                        wanted.append(suffix + path[:length])
                        owner.append((row, len(suffix)))
                suffix = suffix.partition(b".")[2]
        best: list[tuple[int, int, int] | None] = [None] * len(hosts)
        for i, place in enumerate(self.find(wanted)):
            if place >= 0:
                row, host_length = owner[i]
                found = (len(wanted[i]), host_length, int(place))
                if best[row] is None or found > best[row]:
                    best[row] = found
        return [None if x is None else (self.text(x[2]), bool(self.blocks[x[2]])) for x in best]


def ship_rules(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Write the digest file and let Spark carry it to every executor, also to those that join later.
    Returns the name under which tasks find it."""
    folder = os.path.realpath(tempfile.mkdtemp(prefix="url-rules-"))
    path = os.path.join(folder, "rules")
    write_digest_file(rules, path)
    with open(path, "rb") as file:
        name = f"url-rules-{xxhash.xxh3_128_hexdigest(file.read())}"
    os.rename(path, os.path.join(folder, name))
    if not any(x.endswith(name) for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
               otherwise: str = "allow") -> DataFrame:
    """One row for each row of `df`: id_col, host, path, rule, verdict. A rule fits its host and all subdomains where
    the path starts with the rule's; the longest rule decides, and a url that no rule fits gets `otherwise`.

    A null url or one without :// has an empty host and path and fits no rule. Other columns of `df` are not
    looked at, whatever their names. Repeated rows stay repeated; an empty table gives an empty result."""
    name = ship_rules(df.sparkSession, rules)
    kind = df.schema[id_col].dataType.simpleString()
    url = F.col(url_col)
    parts = df.select(F.col(id_col).alias("id"), F.coalesce(url_host(url), F.lit("")).alias("host"),
                      F.coalesce(url_path(url), F.lit("")).alias("path"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()
            found = array.judge(hosts, paths)
            rule = pa.array([None if x is None else x[0].decode() for x in found], pa.string())
            verdict = pa.array([otherwise if x is None else "block" if x[1] else "allow" for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], ["id", "host", "path", "rule", "verdict"])

    out = parts.mapInArrow(probe, f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
