"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

The mix is a sequence of slots of ``block`` words. Slot i lies at the golden-ratio point
frac(i / phi); the source whose stretch of cumulative target weight covers the point owns the slot.
Slots are ranked per source. Each source's documents, shuffled by a hash, form one stream of words,
read twice over, and cut into blocks of equal length: the k-th slot of a source takes its k-th block.
A source takes its target, rounded: its last block is cut off there, slots beyond are left empty, and a source
that the points gave too few slots, as one smaller than a slot may be, gets the rest after the schedule's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.columns import WORDS, hash_long
from webloom.plans.prefix import running_total
from webloom.plans.tables import Stash

#: Weights of sources by their place in code-point order, null last.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Slots of the whole mix, which set the length of a block.
SLOTS = 1 << 17
#: Pieces into which a source's stream, and the schedule, are cut for running sums.
PIECES = 1024
#: Stretches of [0, 1) by which points meet the sources' stretches.
BINS = 4096
GOLDEN = 0.6180339887498949


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets by water-filling: weight * level, but never above ``most`` times a source's size.

    ``sizes`` has (source, source_size), one row per source; windows over them, here and in the schedule, run in one
    task, which some millions of sources would still fit. In order of cap / weight, the sources
    before some place are full; the level then follows from what is left, and the first place whose
    level is below its own cap / weight is the right one.
    """
    every = Window.partitionBy()
    ranked = sizes.withColumn("__i", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__i") % len(weights)).cast("int"))
    caps = ranked.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * float(most))
    by_ratio = every.orderBy(F.col("__cap") / F.col("__w"), "__i")
    past = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * float(share)
    level = (total - F.coalesce(F.sum("__cap").over(past), F.lit(0.0))) / F.sum("__w").over(rest)
    levels = caps.withColumn("__level", level)
    fits = F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__level"))
    return (
        levels.withColumn("__final", F.max(fits).over(every))
        .withColumn("target", F.least(F.col("__cap"), F.coalesce(F.col("__final") * F.col("__w"), F.col("__cap"))))
        .select("source", "source_size", "target", F.col("__i").alias("place"))
    )


def schedule(spark, targets: DataFrame, slots: int) -> DataFrame:
    """(place, k, slot): the k-th slot of each source, from golden-ratio points through cumulative weights."""
    whole = Window.partitionBy()
    upto = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("target").over(upto) / F.sum("target").over(whole)
    ends = targets.where("target > 0").withColumn("__hi", share)
    stretches = ends.withColumn("__lo", F.coalesce(F.lag("__hi").over(whole.orderBy("place")), F.lit(0.0)))
    last = F.row_number().over(whole.orderBy(F.desc("place"))) == 1
    stretches = stretches.withColumn("__hi", F.when(last, F.lit(1.0)).otherwise(F.col("__hi")))
    in_bins = stretches.select(
        "place", "__lo", "__hi",
        F.explode(F.sequence(F.floor(F.col("__lo") * BINS), F.least(F.floor(F.col("__hi") * BINS), F.lit(BINS - 1)))).alias("__bin"),
    )
    point = F.col("id") * F.lit(GOLDEN)
    points = spark.range(slots).withColumn("__u", point - F.floor(point)).withColumn("__bin", F.floor(F.col("__u") * BINS))
    owned = points.join(in_bins, "__bin").where("__u >= __lo and __u < __hi")
    piece = F.floor(F.col("id") / max(1, slots // PIECES))
    return running_total(owned.select("place", "id", piece.alias("__piece")), ["place"], "__piece", ["id"], F.lit(1).cast("long"), "k").select("place", "k", F.col("id").alias("slot"))


def with_rest(scheduled: DataFrame, targets: DataFrame, block: int, slots: int) -> DataFrame:
    """The slots, and after them, for each source that has too few for its words, those that it lacks."""
    had = scheduled.groupBy("place").agg(F.count("*").alias("had"))
    need = F.ceil(F.col("words") / block)
    lacking = targets.select("place", words_of(F.col("target")).alias("words")).join(had, "place", "left").withColumn("had", F.coalesce("had", F.lit(0).cast("long"))).where(F.col("had") < need)
    rest = lacking.select("place", "had", F.explode(F.sequence("had", need - 1)).alias("k")).select("place", "k", (F.lit(slots) + F.col("k") - F.col("had")).alias("slot"))
    return scheduled.unionByName(rest)


def words_of(target: Column) -> Column:
    """The words that a source takes: its target, rounded."""
    return F.floor(target + 0.5).cast("long")


def mix_sources(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row per document: its size, its source's size and target, the words the mix takes, and the first slot that
    takes some (null if none does).

    A null source is a source of its own, placed last; null and empty texts have size 0 and are taken 0
    times. Repeated rows and ids count one by one. An empty table gives no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "mix")
    rows = stash.put(
        docs.select(
            "doc_id", "source", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORDS)).cast("long").alias("size"),
            hash_long(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("__h"),
        ), "sizes",
    )
    targets = stash.put(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    block = max(1, -int(-total // slots))
    n_slots = max(1, -int(-total // block))
    known = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select(
        "doc_id", "size", "__h", "source_size", "target", "place", F.shiftright("__h", 52 - 10).alias("__piece")
    )
    placed = stash.put(running_total(known, ["place"], "__piece", ["__h", "doc_id", "size"], F.col("size"), "start"), "stream")
    words = words_of(F.col("target"))
    read = placed.where("size > 0").select("place", "start", "size", "source_size", words.alias("words"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pass"))
    at = F.col("start") + F.col("pass") * F.col("source_size")
    inside = read.select("place", "start", at.alias("lo"), F.least(at + F.col("size"), "words").alias("hi")).where("lo < hi")
    pieces = inside.select("*", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))).alias("k"))
    scheduled = stash.put(schedule(spark, targets, n_slots), "slots")
    taken = (
        pieces.join(with_rest(scheduled, targets, block, n_slots), ["place", "k"])
        .withColumn("part", F.least("hi", (F.col("k") + 1) * block) - F.greatest("lo", F.col("k") * block))
        .groupBy("place", "start").agg(F.sum("part").alias("taken"), F.min("slot").alias("first_slot"))
    )
    used = placed.where("size > 0").join(taken, ["place", "start"], "left")
    cols = ["doc_id", "size", "source_size", "target", "taken", "first_slot"]
    none = F.lit(None).cast("long").alias("first_slot")
    return used.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).select(cols).unionByName(
        placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), none)
    )
