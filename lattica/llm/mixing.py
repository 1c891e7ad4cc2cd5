"""Mixing sources to target weights by a low-discrepancy schedule.

Slots 0, 1, 2, ... get the golden-ratio points frac(i * 0.618...), which are mapped through the sources' cumulative target shares:
each stretch of slots then holds every source in its share. A source's documents are laid end to end in a hashed order, twice over,
and its first words, as many as its target, are cut into as many equal blocks as it has slots: its r-th slot takes block r. So a
source meets its target to the word, whatever the points; one that no point falls to has a slot of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Slots of a whole mix; blocks grow with the corpus, so the schedule doesn't.
SLOTS = 1 << 18
#: Golden-ratio multiplier modulo 2**32.
GOLDEN = 2654435769
BUCKETS = 4096


def word_count(text: str = "text") -> Column:
    c = F.coalesce(F.col(text), F.lit(""))
    # a word ends where a gap or the end follows; counted without an array of all words
    return F.regexp_count(c, F.lit(common.WORD)).cast("long")


def targets(sizes: DataFrame, *, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, size) -> source, source_size, target.

    Water filling: sorted by size per weight, the smallest sources stop at `most` times their size, and the rest shares what is left
    by weight. Window over one row per source.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in (3, 1, 2)]), (F.row_number().over(by_name) - 1) % 3 + 1)
    s = sizes.select("source", F.col("size").alias("source_size")).withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("weight").over(after))
    # the level of the first source that isn't full holds for it and for all after it
    s = s.withColumn("open", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything))
    share_of = F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("open.level") * F.col("weight")))
    return s.select("source", "source_size", share_of.alias("target"))


def schedule(goal: DataFrame, slots: int) -> DataFrame:
    """goal(source, target) -> slot, source, block: slots in mixing order, each with the block of its source that it takes.

    A source that none of the `slots` points falls to has one block, in the slot at its place among the shares, beside that slot's own.
    """
    spark = goal.sparkSession
    edges = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = goal.where("target > 0").select("source", (F.sum("target").over(edges) / F.sum("target").over(everything)).alias("hi"), (F.col("target") / F.sum("target").over(everything)).alias("share"))
    parts = 256
    # cells of the unit interval make the look-up of a point an equi-join; a source reaches into the cells it covers
    lo = F.greatest(F.col("hi") - F.col("share"), F.lit(0.0))
    cells = shares.select("source", lo.alias("lo"), "hi", F.explode(F.sequence(F.floor(lo * parts), F.floor(F.col("hi") * parts))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") * F.lit(GOLDEN)) % F.lit(1 << 32) / F.lit(float(1 << 32))).alias("x")).withColumn("cell", F.floor(F.col("x") * parts))
    last = F.max("hi").over(everything)
    cells = cells.withColumn("hi", F.when(F.col("hi") == last, F.lit(2.0)).otherwise(F.col("hi")))
    hit = common.saved(points.join(cells, "cell").where("x >= lo and x < hi").select("slot", "source"))
    met = hit.select(F.col("source").alias("s")).distinct()
    missed = shares.join(met, F.col("source").eqNullSafe(F.col("s")), "left_anti").select(F.least(F.floor((F.col("hi") - F.col("share") / 2) * slots), F.lit(slots - 1)).cast("long").alias("slot"), "source")
    hit = hit.union(missed).withColumn("stretch", F.floor(F.col("slot") / 1024))
    return common.running_sum(hit.select("slot", "source", "stretch"), ["source"], "stretch", [F.col("slot")], F.lit(1), "block").select("slot", "source", "block")


def laid_out(sized: DataFrame) -> DataFrame:
    """sized(doc_id, source, size, ...) with `at`: where the document starts in its source's hashed order."""
    key = F.xxhash64(F.lit("mix"), F.col("doc_id"))
    df = sized.withColumn("key", key).withColumn("bucket", F.pmod(key, F.lit(BUCKETS)))
    return common.running_sum(df, ["source"], "bucket", [F.col("key"), F.col("doc_id"), F.col("tie")], F.col("size"), "at").drop("key", "bucket")


def row_hashes() -> list[Column]:
    """128 bits that tell rows apart by doc_id, source and text."""
    return [F.xxhash64("doc_id", "source", "text").alias("hash"), F.xxhash64(F.lit("mix"), "doc_id", "source", "text").alias("other")]


def mix(docs: DataFrame, *, slots: int = SLOTS, epochs: int = 2) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, first, again (words taken in the first and in later rounds), order, tie.

    A source's taken words are its target, rounded to a word. `order` has (words, slot, block) for each round in which words of the
    document are taken: where the first of them stands in the mix. Sizes are words; a null or empty text has 0 and takes 0. Null is a
    source of its own, the last one. Repeated rows are documents of their own, told apart by `tie`. Extra columns aren't read. An empty
    table gives no rows.
    """
    hashed = docs.select("doc_id", "source", *row_hashes(), word_count().alias("size"))
    repeat = F.row_number().over(Window.partitionBy("hash", "other").orderBy("size"))
    sized = common.saved(hashed.select("doc_id", "source", F.struct("hash", "other", repeat.alias("repeat")).alias("tie"), "size"))
    sizes = common.saved(sized.groupBy("source").agg(F.sum("size").cast("long").alias("size")))
    goal = common.saved(targets(sizes))
    total = goal.agg(F.sum("target")).first()[0] or 0.0
    plan = common.saved(schedule(goal, min(slots, max(1, round(total)))))
    blocks = plan.groupBy(F.col("source").alias("b")).agg(F.count(F.lit(1)).alias("blocks"))
    none = F.lit(0).cast("long")
    goal = goal.join(blocks, F.col("source").eqNullSafe(F.col("b")), "left").select(F.col("source").alias("s"), "source_size", "target", F.round("target").cast("long").alias("words"), F.coalesce("blocks", none).alias("blocks"))
    out = laid_out(sized).join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rounds = []
    for k in range(epochs):
        start = F.col("at") + F.lit(k) * F.col("source_size")
        words = F.greatest(F.least(start + F.col("size"), F.col("words")) - start, none)
        # block b holds the words w with w * blocks div words = b
        out = out.withColumn(f"words{k}", words).withColumn(f"block{k}", F.when(F.col(f"words{k}") > 0, F.call_function("div", start * F.col("blocks"), F.col("words"))))
        slot = plan.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("slot").alias(f"slot{k}"))
        out = out.join(slot, F.col("source").eqNullSafe(F.col("s")) & (F.col(f"block{k}") == F.col("b")), "left").drop("s", "b")
        rounds.append(F.struct(F.col(f"words{k}").alias("words"), F.col(f"slot{k}").alias("slot"), F.col(f"block{k}").alias("block")))
    taken = sum((F.col(f"words{k}") for k in range(1, epochs)), F.col("words0"))
    order = F.filter(F.array(*rounds), lambda r: r["words"] > 0)
    return out.select("doc_id", "source", "tie", "size", "source_size", "target", taken.alias("taken"), F.col("words0").alias("first"), (taken - F.col("words0")).alias("again"), order.alias("order"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, *, with_order: bool = False, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each round in which a document is taken, its text cut where the mix ends within it.

    Rows come sorted in the order of the mix, by the slot in which they begin; with_order adds it as `slot` and `block`.
    """
    takes = mix(docs, **options).where("taken > 0").select(F.col("tie.hash").alias("_hash"), F.col("tie.other").alias("_other"), F.explode("order").alias("_take"), F.col("size").alias("_size"))
    takes = takes.groupBy("_hash", "_other", "_size").agg(F.collect_list("_take").alias("_takes"))
    # one shuffle of the texts, on which the join and the removal of repeated rows both stand
    own = docs.select("*", *(h.alias(f"_key{k}") for k, h in enumerate(row_hashes()))).repartition(common.partitions(docs.sparkSession), "_key0", "_key1").dropDuplicates(["_key0", "_key1"])
    rows = own.join(takes, (F.col("_key0") == F.col("_hash")) & (F.col("_key1") == F.col("_other"))).withColumn("_take", F.explode("_takes")).withColumn("_words", F.col("_take.words"))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("_words") >= F.col("_size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), ""))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_words") >= F.col("_size"), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    rows = rows.withColumn("text", text).orderBy("_take.slot", "_take.block", "doc_id", "_key0")
    return rows.select(*docs.columns, *([F.col("_take.slot").alias("slot"), F.col("_take.block").alias("block")] if with_order else []))
