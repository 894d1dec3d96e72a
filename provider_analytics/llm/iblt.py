"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A fingerprint is a small table of cells; every paragraph's digest goes into three of them, one in each third, and a
cell holds how many digests it has, their exclusive or and that of their checks. Subtracting two sketches cancels what
both documents have. From the difference, cells with one digest left are peeled: the digest is known, leaves its other
cells, and may make those single. If cells remain, the pair is tried again with a table four times as large, so the
differing digests are always recovered in full.

Cells are rows. All steps group by the document's key first, so after one exchange by key they need no other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Cells of a fingerprint, and by how much a table grows when peeling fails.
BASE_CELLS, GROWTH = 24, 4
#: Passes over the three thirds in one attempt.
ROUNDS = 4


def paragraphs(text: Column) -> Column:
    """Digests of the distinct paragraphs: the lines that are not blank."""
    lines = F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")
    return F.array_distinct(F.transform(lines, lambda p: F.xxhash64(p)))


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-1)).bitwiseAND(0xFFFFFFFF)


def cell(digest: Column, third: int | Column, cells: int) -> Column:
    third = F.lit(third) if isinstance(third, int) else third
    return (third * (cells // 3) + F.pmod(F.xxhash64(digest, third), F.lit(cells // 3))).cast("int")


def sketch(digests: DataFrame, cells: int, by: list[str]) -> DataFrame:
    """by, digest -> by, cell, n, x, c. `digests` has one row for each digest; what `by` names must be partitioned
    already if no exchange is wanted."""
    placed = digests.select(*by, "digest", check(F.col("digest")).alias("chk"),
                            F.explode(F.array(*[cell(F.col("digest"), t, cells) for t in range(3)])).alias("cell"))
    return placed.groupBy(*by, "cell").agg(F.count("*").alias("n"), F.bit_xor("digest").alias("x"), F.bit_xor("chk").alias("c"))


def _nonzero() -> Column:
    return F.col("known").isNotNull() | (F.col("n") != 0) | (F.col("x") != 0) | (F.col("c") != 0)


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "cell", "known").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c")).filter(_nonzero())


def subtract(sketches: DataFrame, by: list[str], sign: str) -> DataFrame:
    """by, cell, n, x, c and a column of +1 or -1 -> the difference sketch of each `by`."""
    signed = sketches.select(*by, "cell", F.lit(None).cast("bigint").alias("known"), (F.col("n") * F.col(sign)).alias("n"), "x", "c")
    return _merged(signed, by)


def peel(difference: DataFrame, by: list[str], cells: int) -> DataFrame:
    """Recover digests, one third after the other. Rows with `known` hold a recovered digest and, in n, its side; rows
    without are cells that are left. Within a third a digest has one cell, so none is taken out twice."""
    state = difference
    third_size = cells // 3
    for third in [0, 1, 2] * ROUNDS:
        x, n, c = F.col("x"), F.col("n"), F.col("c")
        single = (F.col("cell") == cell(x, third, cells)) & (F.abs(n) == 1) & (c == check(x)) & F.col("known").isNull()
        here = F.floor(F.col("cell") / third_size) == third
        row = [F.col("cell").alias("cell"), F.col("known").alias("known"), n.alias("n"), x.alias("x"), c.alias("c")]
        nothing = F.lit(None).cast("bigint")
        zero = F.lit(0).cast("bigint")
        others = [F.struct(cell(x, t, cells).alias("cell"), nothing.alias("known"), (-n).alias("n"), x.alias("x"), c.alias("c"))
                  for t in range(3) if t != third]
        found = F.struct(F.lit(None).cast("int").alias("cell"), x.alias("known"), n.alias("n"), zero.alias("x"), zero.alias("c"))
        steps = F.when(here & single, F.array(found, *others)).otherwise(F.array(F.struct(*row)))
        state = _merged(state.select(*by, F.inline(steps)), by)
    return state


def differing(pairs: DataFrame, cells: int = BASE_CELLS) -> DataFrame:
    """For frames `key, pair, left, right` of digest arrays: key, pair, only_left, only_right, the digests that one side
    has and the other lacks. Tables grow until every pair is peeled. Each attempt is written to the shared folder;
    pairs without a difference come back with empty lists."""
    by = ["key", "pair"]
    todo, done = pairs, None
    while True:
        spread = by_key(todo)
        sides = spread.select(*by, F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("left").alias("digests")),
                                                     F.struct(F.lit(-1).alias("sign"), F.col("right").alias("digests")))).alias("side"))
        digests = sides.select(*by, "side.sign", F.explode("side.digests").alias("digest"))
        peeled = peel(subtract(sketch(digests, cells, [*by, "sign"]), by, "sign"), by, cells)
        known = F.col("known")
        result = peeled.groupBy(*by).agg(
            F.collect_list(F.when(F.col("n") > 0, known)).alias("only_left"),
            F.collect_list(F.when(F.col("n") < 0, known)).alias("only_right"),
            F.bool_or(known.isNull()).alias("stuck"),
        )
        result = written(result, f"peeled-{cells}")
        settled = result.filter(~F.col("stuck")).drop("stuck")
        done = settled if done is None else done.unionByName(settled)
        stuck = result.filter("stuck").select(*by)
        if stuck.isEmpty():
            break
        todo = todo.join(stuck, by, "left_semi")
        cells *= GROWTH
    empty = F.array().cast("array<bigint>")
    return pairs.select(*by).join(done, by, "left").select(
        *by, F.coalesce("only_left", empty).alias("only_left"), F.coalesce("only_right", empty).alias("only_right"))


def likeness(left: Column, right: Column, only_left: Column, only_right: Column) -> Column:
    """Shared paragraphs over all, from the counts of the two sketches and what was peeled; 1 for two empty ones."""
    differ = F.size(only_left) + F.size(only_right)
    shared = (left + right - differ) / 2
    return F.when(left + right == 0, F.lit(1.0)).otherwise(shared / (shared + differ))


def by_key(df: DataFrame) -> DataFrame:
    """Partition by key into as many parts as shuffles have. The number is given, so that parts are not merged by their
    size: lists of digests are short next to the cells that are made of them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")


def fingerprints(digests: DataFrame, cells: int, by: list[str]) -> DataFrame:
    """by, side, digest -> by and, for each side in `side`, the sketch as text: cells in order as cell:n:x:c in hex."""
    rows = sketch(digests, cells, [*by, "side"])
    text = F.concat_ws(":", F.hex("cell"), F.hex("n"), F.hex("x"), F.hex("c"))
    one = F.struct("cell", text.alias("text"))
    return rows.groupBy(*by).agg(*[
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, one))), lambda r: r["text"]), ",").alias(s)
        for s in ("own", "edited")])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, next_text: the text of the document that follows in ascending id, of the first for the last.

    Ids are cut into ranges at quantiles that are ids themselves, and the document at a cut also goes, marked, to the
    range before it; so a window over each range sees every document's successor and texts move once. Null ids come
    before all others; documents of one id are ordered by text."""
    spark = docs.sparkSession
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = [i / ranges for i in range(1, ranges)]
    least, cuts = docs.agg(F.min(id_col), F.percentile_approx(id_col, points, 20 * ranges)).first()
    least = (0 if least is None else least) - 1
    has_null = docs.filter(F.col(id_col).isNull()).limit(1).count() > 0
    bounds = sorted({*(cuts or []), least + 1, *([least] if has_null else [])})
    known = F.lit(bounds).cast("array<bigint>")
    powers = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    at_or_before = F.aggregate(
        F.lit(powers).cast("array<int>"), F.lit(0),
        lambda found, p: F.when(F.coalesce(F.get(known, found + p - 1) <= F.col("k"), F.lit(False)), found + p).otherwise(found))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col), F.lit(least)).alias("k"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("range", at_or_before - 1)
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("copy"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(len(bounds))).cast("int").alias("range"), F.lit(True).alias("copy"))
    first = F.get(known, F.col("range")) == F.col("k")
    placed = rows.select("id", "k", "text", F.inline(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    window = Window.partitionBy("range").orderBy("copy", "k", "text")
    return placed.withColumn("next_text", F.lead("text").over(window)).filter(~F.col("copy")).select("id", "text", "next_text")


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as many characters from the start of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, cells: int = BASE_CELLS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, only_edited, only_next for
    every whole text: likeness to its edited text and to the next document, and the digests of the paragraphs that only
    the other version has. A null text counts as empty; documents without paragraphs have an empty fingerprint and are
    like each other. Equal texts have equal fingerprints. Repeated rows each get a row; an empty table gives none."""
    linked = with_next(docs)
    edited = edited_text(F.col("text"), F.col("next_text"))
    base = linked.select(
        F.col("id").alias("doc_id"), F.length("text").cast("bigint").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"),
        paragraphs(F.col("text")).alias("own"), paragraphs(edited).alias("edited"), paragraphs(F.col("next_text")).alias("following"),
    ).withColumn("key", F.monotonically_increasing_id())
    base = written(base, "paragraphs")
    pairs = base.select("key", F.inline(F.array(
        F.struct(F.lit("edited").alias("pair"), F.col("own").alias("left"), F.col("edited").alias("right")),
        F.struct(F.lit("next").alias("pair"), F.col("own").alias("left"), F.col("following").alias("right")))))
    changes = differing(pairs, cells).groupBy("key").agg(*[
        F.first(F.when(F.col("pair") == pair, F.struct("only_left", "only_right")), ignorenulls=True).alias(pair)
        for pair in ("edited", "next")])
    spread = by_key(base)
    sides = spread.select("key", F.explode(F.map_from_arrays(F.array(F.lit("own"), F.lit("edited")), F.array("own", "edited"))).alias("side", "digests"))
    marks = fingerprints(sides.select("key", "side", F.explode("digests").alias("digest")), cells, ["key"])
    marks = marks.select("key", F.col("own").alias("fingerprint"), F.col("edited").alias("edited_fingerprint"))
    sizes = base.select("key", "doc_id", "n_chars", "edited_sha256", F.size("own").alias("n_own"), F.size("edited").alias("n_edited"),
                        F.size("following").alias("n_next"))
    near = [likeness(F.col("n_own"), F.col(n), F.col(f"{p}.only_left"), F.col(f"{p}.only_right")).alias(f"near_{p}")
            for p, n in (("edited", "n_edited"), ("next", "n_next"))]
    return sizes.join(changes, "key").join(marks, "key", "left").select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
        F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"), *near,
        F.col("edited.only_right").alias("only_edited"), F.col("next.only_right").alias("only_next"))
