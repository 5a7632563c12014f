"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: the whole's words are shared by weight; a source whose share exceeds ``most_epochs``
times its own words stops there, and the excess is shared again among the others.

Schedule: slot k of K takes the source into whose part of the cumulative targets the point
frac((k + 1) * golden ratio) falls (or the base-2 van der Corput point), so any stretch of the
schedule holds the sources in about their shares. A source's slots are ranked; its documents,
shuffled by a hash, form a stream that is cut into blocks of equal words, and its r-th slot
takes block r modulo its number of blocks: an epoch, then the next. A document's words taken
are those of its pieces in the blocks, as often as each block is taken.

Settling: slots are whole and a source's last block is short, so after the schedule a source
has taken a run of its repeated stream that ends near its target, not at it. The run is then
drawn on or cut back to the rounded target, whatever the size of the blocks.

Ranks and stream places are two-level prefix sums (by stretches of slots, by ranges of the
hash, by ranges of the sources' order), so neither a source with most of the rows nor very many
sources (hosts, say) end in one task; one task sees a number per stretch or range at most.

Edge cases: null sources are a source of their own, last in order; null or empty texts have
size 0 and are taken 0 times; repeated rows and null doc_ids are rows like any other; a table
without words gives targets of 0; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, word_count, written

GOLDEN = 0.6180339887498949
STRETCH = 4096


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds place, from 0 in ``order``: ranges of the order are numbered in tasks of their own,
    behind the number of rows in the ranges before."""
    dealt = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("range").orderBy(*order)) - 1
    return dealt.withColumn("within", within).join(before, "range").withColumn("place", F.col("before") + F.col("within")).drop("range", "within", "before")


def running_sum(rows: DataFrame, column: str) -> DataFrame:
    """Adds upto, the sum of ``column`` up to and with each place."""
    cut = rows.withColumn("stretch", F.floor(F.col("place") / STRETCH))
    sums = cut.groupBy("stretch").agg(F.sum(column).alias("words"))
    before = sums.select("stretch", F.coalesce(F.sum("words").over(W.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    within = F.sum(column).over(W.partitionBy("stretch").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn("within", within).join(before, "stretch").withColumn("upto", F.col("before") + F.col("within")).drop("stretch", "within", "before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most_epochs: int) -> DataFrame:
    """place (from 0, in code point order), source, source_size, target of each source, weights
    repeating in that order."""
    sums = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").isNull(), F.encode("source", "UTF-8")])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = written(sums.select("place", "source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * most_epochs).cast("double").alias("cap")), "sources")
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= level * F.col("weight")
        total, taken, free, n = sources.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if not free or n == capped:
            break
        level, capped = ((total or 0) - (taken or 0.0)) / free, n
    target = F.least("cap", F.lit(float(level)) * F.col("weight")) if free else F.col("cap")
    return sources.select("place", "source", "source_size", target.alias("target"))


def points(slot: Column, kind: str = "golden") -> Column:
    """The slot's point in [0, 1)."""
    if kind == "golden":
        # the fraction of k * golden in 53-bit steps, exact for k below 2**53: products of halves
        # of at most 27 bits never leave 64 bits, and only the low 53 bits matter
        step, half = int(GOLDEN * (1 << 53)), (1 << 26) - 1
        high, low = F.shiftright(slot + 1, 26), (slot + 1).bitwiseAND(half)
        middle = (high * (step & half) + low * (step >> 26) + high.bitwiseAND((step >> 26) & 1) * (1 << 26)).bitwiseAND((1 << 27) - 1)
        return (F.shiftleft(middle, 26) + low * (step & half)).bitwiseAND((1 << 53) - 1).cast("double") / float(1 << 53)
    if kind == "van_der_corput":
        return F.conv(F.rpad(F.reverse(F.bin(slot)), 53, "0"), 2, 10).cast("double") / float(1 << 53)
    raise ValueError(kind)


def schedule(spark: SparkSession, parts: DataFrame, slots: int, kind: str = "golden", grid: int = 4096) -> DataFrame:
    """slot, source_no, rank (from 0, within the source) from ``parts``: source_no, low, high.

    The parts are one small row per source; a broadcast happens only below Spark's own size
    threshold, and beyond it the join is made on the ``grid`` cells of [0, 1): with as many
    cells as sources, a cell meets about two of them."""
    points_ = spark.range(slots).select(F.col("id").alias("slot"), points(F.col("id"), kind).alias("x"))
    cells = parts.select("source_no", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * grid), F.least(F.floor(F.col("high") * grid), F.lit(grid - 1)))).alias("cell"))
    placed = points_.withColumn("cell", F.floor(F.col("x") * grid)).join(cells, "cell").where("x >= low and x < high")
    placed = placed.select("slot", "source_no", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    counts = placed.groupBy("source_no", "stretch").agg(F.count("*").alias("n"))
    before = counts.select("source_no", "stretch", (F.sum("n").over(W.partitionBy("source_no").orderBy("stretch")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("source_no", "stretch").orderBy("slot")) - 1
    return placed.withColumn("within", within).join(before, ["source_no", "stretch"]).select("slot", "source_no", (F.col("before") + F.col("within")).alias("rank"))


def words_within(run: Column) -> Column:
    """A row's words among the first ``run`` words of its source's stream, repeated endlessly."""
    rest = run % F.col("source_size")
    return ((run - rest) / F.col("source_size")).cast("long") * F.col("size") + F.greatest(F.lit(0), F.least(rest - F.col("start"), F.col("size")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most_epochs: int = 3, kind: str = "golden", seed: int = 9, block_words: int | None = None) -> DataFrame:
    """doc_id, source, key (hash of the text), size, source_size, target, taken of each row."""
    spark = docs.sparkSession
    sizes = written(docs.select("doc_id", "source", F.xxhash64("text").alias("key"), word_count(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sizes, weights, most_epochs)
    goal = F.col("target")
    sources = written(running_sum(targets, "target").select("source", "source_size", "target", (F.col("place") + 1).alias("source_no"), "upto"), "targets")
    total = sources.agg(F.max("upto")).first()[0] or 0.0
    block = block_words or int(min(max(total // 2_000_000, 1), 8192))
    slots = int(-(-total // block))
    parts = sources.where("target > 0").select("source_no", ((F.col("upto") - goal) / total).alias("low"), F.when(F.col("upto") >= total, 1.0).otherwise(F.col("upto") / total).alias("high")) if total else sources.select("source_no", F.lit(0.0).alias("low"), F.lit(0.0).alias("high")).limit(0)
    blocks = F.ceil(F.col("source_size") / block)
    grid = max(4096, 1 << sources.count().bit_length())
    ranked = schedule(spark, parts, slots, kind, grid).join(sources.where("source_size > 0").select("source_no", "source_size", blocks.alias("blocks")), "source_no")
    times = ranked.where(F.col("rank") < F.col("blocks") * most_epochs).groupBy("source_no", "source_size", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))
    times = written(times, "times")
    in_block = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    runs = written(times.groupBy("source_no").agg(F.sum(in_block * F.col("times")).alias("run")), "runs")

    keyed = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select("doc_id", sizes["source"], "key", "size", "source_size", "target", "source_no")
    shuffle = F.xxhash64("doc_id", "key", F.lit(seed))
    bits = max(10, (sizes.count() >> 20).bit_length())  # about a million rows a range
    placed = keyed.withColumn("place", shuffle).withColumn("range", F.shiftrightunsigned("place", 64 - bits))
    ranges = placed.groupBy("source_no", "range").agg(F.sum("size").alias("words"))
    before = ranges.select("source_no", "range", (F.sum("words").over(W.partitionBy("source_no").orderBy("range")) - F.col("words")).alias("before"))
    upto = F.sum("size").over(W.partitionBy("source_no", "range").orderBy("place", "doc_id", "key").rowsBetween(W.unboundedPreceding, 0))
    stream = placed.withColumn("upto", upto).join(before, ["source_no", "range"]).withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
    stream = written(stream.select("doc_id", "source", "key", "size", "source_size", "target", "source_no", "start"), "stream")
    pieces = stream.where("size > 0").select("source_no", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    taken = pieces.join(times.drop("source_size"), ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(words * F.col("times")).alias("taken"))
    with_size = stream.where("size > 0").join(taken, ["source_no", "start"], "left").join(runs, "source_no", "left")
    settled = words_within(F.round("target").cast("long")) - words_within(F.coalesce("run", F.lit(0)))
    columns = ["doc_id", "source", "key", "size", "source_size", "target"]
    return with_size.select(*columns, (F.coalesce("taken", F.lit(0)) + settled).cast("long").alias("taken")).unionByName(stream.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def op9_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
