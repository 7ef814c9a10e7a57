"""Mixing sources to target weights: a golden-ratio schedule of slots, each slot a block of its source's shuffled words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import scratch

#: Fraction part of the golden ratio: the step of the low-discrepancy sequence.
GOLDEN = 0.6180339887498949
#: Words of a block at the most.
BLOCK_WORDS = 65_536
#: Each source gets about this many slots at least (fewer only when it gives fewer words).
LEAST_SLOTS = 64
#: A source gives each of its documents this many times at the most.
MOST_REPEATS = 3
#: Bits of the hash that shuffles a source's documents.
HASH_BITS = 60
#: Slots that are ranked together; ranks of earlier chunks are added from a table of counts.
CHUNK = 4_096


def word_count(text: str) -> F.Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in `text`, null 0, without an array of the words."""
    marks = F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.coalesce(F.when(marks.rlike(r"^[\x20\x09-\x0D]"), 0).otherwise(F.length(marks)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target, take): the share of all words by weight, at most MOST_REPEATS times the source's size.

    Weights repeat over the sources by code point, null last. The excess of capped sources goes to the others by weight until none
    is above its cap: sorted by cap over weight, the capped sources are the leading ones, so running sums find the level in one
    pass. The frame has one row a source, and only this frame is ordered as a whole.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * MOST_REPEATS)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    all_rows = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.sum("weight").over(rest))
        .withColumn("over", F.col("level") * F.col("weight") > F.col("cap"))
        .withColumn("level", F.first(F.when(~F.col("over"), F.col("level")), ignorenulls=True).over(all_rows))
    )
    cap = F.col("cap").cast("double")
    share = F.coalesce(F.least(F.col("level") * F.col("weight"), cap), cap)
    return per.select("source", "source_size", share.alias("target")).withColumn("take", F.round("target").cast("long"))


def _stream(sizes: DataFrame, docs: int) -> DataFrame:
    """`sizes` with `at`: the words of its source that stand before the document in the source's shuffled order.

    Order: `h`, then id and size. Running sums stay inside (source, leading bits of h); a table of those cells' sums adds the rest.
    """
    bits = max(4, (max(docs, 1).bit_length() + 1) // 2)
    cells = sizes.withColumn("cell", F.shiftrightunsigned("h", HASH_BITS - bits))
    ahead = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.groupBy("source", "cell").agg(F.sum("size").alias("words")).select("source", "cell", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "cell").orderBy("h", "id", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    right = starts.select(F.col("source").alias("s"), F.col("cell").alias("c"), "start")
    return cells.join(right, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).withColumn("at", F.col("start") + F.col("inside")).drop("s", "c", "start", "inside", "cell")


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """(source_no, rank, position): which source each of the schedule's slots draws from and the slot's rank within that source.

    Point i is frac((i + 1/2) * golden ratio); it falls into one source's part of the cumulative slot weights. Sources and points
    meet through equal cells of the unit interval, an equality join. The few slots by which the points miss a source's number are
    put at the end, so each source has exactly `slots` ranks.
    """
    spark = plan.sparkSession
    grid = 1 << max(10, min(20, slots.bit_length() - 6))
    running = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    parts = plan.filter("slots > 0").withColumn("hi", F.sum("slots").over(running) / F.lit(float(max(slots, 1)))).withColumn("lo", F.col("hi") - F.col("slots") / F.lit(float(max(slots, 1))))
    parts = parts.withColumn("hi", F.when(F.col("hi") > 1 - 1e-12, F.lit(2.0)).otherwise(F.col("hi"))).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("source_no")), F.lit(0.0)))
    parts = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * grid), F.least(F.floor(F.col("hi") * grid), F.lit(grid - 1).cast("long")))))
    x = (F.col("id") + F.lit(0.5)) * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("position"), (x - F.floor(x)).alias("u")).withColumn("cell", F.floor(F.col("u") * grid))
    drawn = points.join(parts.select("cell", "source_no", "lo", "hi"), "cell").filter("u >= lo and u < hi").select("source_no", "position").withColumn("chunk", F.expr(f"position div {CHUNK}"))
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("position")) - 1)
    ranked = ranked.join(offsets, ["source_no", "chunk"]).select("source_no", (F.col("rank") + F.col("before")).alias("rank"), "position")
    ranked = ranked.join(plan.select("source_no", "slots"), "source_no").filter("rank < slots").select("source_no", "rank", "position")
    have = counts.groupBy("source_no").agg(F.sum("n").alias("n"))
    missing = plan.join(have, "source_no", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < slots")
    tail = missing.select("source_no", F.explode(F.sequence("n", F.col("slots") - 1)).alias("rank"), F.lit(None).cast("long").alias("position"))
    return ranked.unionByName(tail)


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of `docs`: how many of its words the mix takes, repeats counted.

    Each source's words stand in the order of a hash of id and text and are cut into blocks of equal numbers of words. The slots of
    a source, by rank, take its blocks in order, up to MOST_REPEATS times around; the last slot is cut so that a source gives its
    target, rounded. A document that a block border or the last slot cuts gives the words on the near side. So no document is taken
    more than MOST_REPEATS times, and the result depends on the rows alone.

    Null texts and texts without words have size 0 and give nothing; a null source is a source of its own; null ids are ids like
    others; repeated rows each keep their place (rows alike in all three columns may swap places). An empty table gives an empty
    result; columns other than the three are not read. Everything runs as DataFrame expressions.
    """
    spark = docs.sparkSession
    # The leading bits of an MD5, which other engines have too, so that SQL can tell the order.
    mark = F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_column), F.lit(""))))
    place = F.conv(F.substring(mark, 1, HASH_BITS // 4), 16, 10).cast("long")
    sizes = docs.select(
        F.col(id_column).alias("id"),
        F.col(source_column).alias("source"),
        word_count(text_column).alias("size"),
        place.alias("h"),
        F.monotonically_increasing_id().alias("uid"),
    )
    sizes = scratch.table(sizes, "sizes")
    block = F.least(F.lit(block_words).cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("take") / LEAST_SLOTS)))
    plan = (
        targets(sizes, weights)
        .withColumn("block", block)
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
        .withColumn("around", F.when(F.col("source_size") > 0, F.expr("take div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("take") - F.col("around") * F.col("source_size"))
        .withColumn("slots", F.col("around") * F.col("blocks") + F.ceil(F.col("rest") / F.col("block")))
        .withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))))
    )
    plan = scratch.table(plan, "plan")
    slots = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    drawn = schedule(plan, slots).join(plan.select("source_no", "slots", "block", "blocks", "rest"), "source_no")
    last_cut = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") % F.col("block") > 0)
    visits = drawn.select("source_no", (F.col("rank") % F.col("blocks")).alias("b"), last_cut.alias("cut"), F.when(last_cut, F.col("rest") % F.col("block")).alias("part"))
    visits = visits.groupBy("source_no", "b").agg(F.sum(F.when(F.col("cut"), 0).otherwise(1)).alias("whole"), F.max("part").alias("part"))

    stream = _stream(sizes, sizes.count())
    right = plan.select(F.col("source").alias("s"), "source_no", "source_size", "target", "block", "blocks", "slots")
    placed = stream.join(right, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source", "h")
    first, last = F.expr("at div block"), F.least(F.expr("(at + size - 1) div block"), F.col("slots") - 1)
    cut = placed.withColumn("b", F.explode_outer(F.when((F.col("size") > 0) & (first <= last), F.sequence(first, last))))
    lo = F.greatest(F.col("at"), F.col("b") * F.col("block"))
    hi = F.least(F.col("at") + F.col("size"), (F.col("b") + 1) * F.col("block"))
    given = F.col("whole") * (hi - lo) + F.greatest(F.lit(0), F.least(hi, F.col("b") * F.col("block") + F.coalesce("part", F.lit(0))) - lo)
    return (
        cut.join(visits, ["source_no", "b"], "left")
        .groupBy("uid", "id", "size", "source_size", "target")
        .agg(F.coalesce(F.sum(given), F.lit(0)).cast("long").alias("taken"))
        .select(F.col("id").alias(id_column), "size", "source_size", "target", "taken")
    )
