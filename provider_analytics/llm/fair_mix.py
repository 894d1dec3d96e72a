"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue: its documents in shuffled order, then all of them again in another order, for as many
epochs as a document may be repeated. A copy's virtual finish time is its source's cumulative size divided by the
source's target. All copies are range-sorted by finish time and the mix takes the first of them up to the budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

WEIGHTS = (5, 2, 1)
#: A word: anything but space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """source, source_size -> source, source_size, target.

    Sources in code point order, null last, take the weights in turn. The budget, `share` of all sizes, is dealt out
    by weight; where a target would exceed `repeats` times its source's size it stops there and the rest goes to the
    others by weight. Closed form: sources fill up in the order of size/weight, so the level is found from running
    sums. One row for each source is handled in one task: 16 bytes a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    weighed = sizes.withColumn("_w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("_cap", F.col("source_size") * repeats).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    everything = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy("_ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        weighed.withColumn("_budget", F.sum("source_size").over(everything) * share)
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_open", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.col("_open"))
    )
    # The level is that of the first source, in filling order, that does not fill up.
    level = F.min(F.when(F.col("_level") < F.col("_ratio"), F.struct("_ratio", F.col("_open").alias("_o"), "_level"))).over(everything)
    return levels.withColumn("_at", level["_level"]).select(
        "source", "source_size",
        F.when(F.col("_at").isNull() | (F.col("_ratio") <= F.col("_at")), F.col("_cap").cast("double"))
        .otherwise(F.col("_at") * F.col("_w")).alias("target"),
    )


def _running(df: DataFrame, order: list[Column], group: list[str], amount: str, total: str) -> DataFrame:
    """Add `total`: the sum of `amount` over the row and all rows before it in its group, in the given order, which
    must start with the group. Each task sums its own range as a stream; what earlier ranges hold comes in as one
    row for each range and group."""
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = ranged.withColumn("_part", F.spark_partition_id())
    sums = placed.groupBy("_part", *group).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", *group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    names = ranged.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sofar = None, 0
        for batch in batches:
            values = batch.column(amount).to_numpy()
            if not len(values):
                continue
            change = np.zeros(len(values), bool)
            keys = [batch.column(g) for g in group]
            for column in keys:
                codes = column.dictionary_encode().indices.fill_null(-1).to_numpy()
                change[1:] |= codes[1:] != codes[:-1]
            first = tuple(column[0].as_py() for column in keys)
            change[0] = first != last
            sums = np.cumsum(values, dtype=np.int64)
            heads = np.flatnonzero(change)
            base = np.zeros(len(values), np.int64)
            base[: heads[0] if len(heads) else len(values)] = -sofar
            for head, end in zip(heads, [*heads[1:], len(values)], strict=False):
                base[head:end] = sums[head] - values[head]
            out = sums - base
            last, sofar = tuple(column[len(values) - 1].as_py() for column in keys), int(out[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*names, "_part", "_own"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    summed = placed.mapInArrow(add, f"{fields}, _own bigint")
    same = F.lit(True)
    starts = starts.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_start")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = summed.join(starts, (F.col("_part") == F.col("_p")) & same)
    return joined.withColumn(total, F.col("_own") + F.col("_start")).select(*names, total)


def mix_sources(docs: DataFrame, sizes: Column, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
                repeats: int = 2, seed: int = 0) -> DataFrame:
    """One row for each document: doc_id, row, size, source, source_size, target, copies, taken.

    `row` tells equal documents apart and is stable for one reading of the table. The order inside a source is that
    of md5(seed:epoch:doc_id), so reruns agree; documents that share a doc_id are ordered by size, then by row.
    Copies are whole documents: the cut falls near finish time 1, where every source is at its target but for a part
    of a document, and the sum never exceeds the budget. A null source is a source of its own; a document without words has size 0 and
    is never taken, as is one whose source has target 0. An empty table gives an empty result."""
    slim = checkpointed(docs.select("doc_id", "source", sizes.cast("bigint").alias("size")).withColumn("row", F.monotonically_increasing_id()))
    by_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = checkpointed(source_targets(by_source, weights, share, repeats))
    total = slim.agg(F.sum("size")).first()[0] or 0
    copies = slim.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("epoch"))
    copies = copies.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))))
    order = [F.col("source").asc_nulls_last(), F.col("epoch"), F.col("key"), F.col("size"), F.col("row")]
    queued = _running(copies, order, ["source"], "size", "finish_size")
    goals = targets.select(F.col("source").alias("_s"), "target")  # one row for each source
    timed = queued.join(goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").filter("target > 0")
    timed = timed.withColumn("finish", F.col("finish_size") / F.col("target")).select("row", "source", "epoch", "key", "size", "finish")
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("epoch"), F.col("key"), F.col("row")]
    queue = _running(timed.withColumn("_all", F.lit(0)), order, ["_all"], "size", "used")
    taken = queue.filter(F.col("used") <= F.lit(float(total)) * share).groupBy("row").agg(F.count("*").alias("copies"))
    return (
        slim.join(taken, "row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .join(targets.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
        .select("doc_id", "row", "size", "source", "source_size", "target", "copies", "taken")
    )


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 0) -> DataFrame:
    """The documents of the mix, as often as it takes them, with their own columns. Size is the number of words.
    Documents that share doc_id and source are taken equally often, as often as the most frequent of them."""
    mixed = mix_sources(docs, word_count(F.col("text")), weights, share, repeats, seed)
    counts = mixed.filter("copies > 0").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source")).agg(F.max("copies").alias("_copies"))
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & docs["source"].eqNullSafe(F.col("_source"))
    taken = docs.join(counts, same).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    return taken.select(*[docs[c] for c in docs.columns])
