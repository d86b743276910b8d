"""Mixing sources to target weights (9): weighted fair queueing.

Each source's documents stand in a seeded random order. A document's virtual finish time is the running sum of its source's sizes, through
this document, divided by the source's weight; a source may be walked max_repeat times. All copies ordered by finish time and cut at the
total budget are the mix: at virtual time V every source has given min(max_repeat * size, weight * V), which is water filling.

DataFrame functions only. Running sums are never taken over a whole source in one task: a source is cut into slices of the random key of about
SLICE_ROWS rows, slice totals give each slice its offset, and the sum inside a slice is a window. The global order is not sorted as a whole
either: finish times fall into BINS equal ranges, whose totals name the one range that the budget cuts, and only that range is sorted.
Identical rows are taken together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import pinned, row_key, small, table, without

#: Rows of a source's slice, aimed at.
SLICE_ROWS = 2048
#: Ranges of finish time.
BINS = 4096

WORD = r"[^\x20\x09-\x0D]+"


def n_words(col: str) -> F.Column:
    """Words between ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, size_col: str, *, source_col: str = "source", id_cols: Sequence[str] = ("doc_id",), weights: Sequence[float] = (1, 2, 3), max_repeat: int = 3, share: float = 1.0, seed: int = 9) -> DataFrame:
    """docs with source_size (long), target (double) and copies (int, 0 to max_repeat: how often the mix takes the row).

    Sources, by code point with null last, have the weights in turn. Columns of the output's names are replaced, others stay.
    A null size is 0. Rows equal in id_cols, source and size are taken alike. An empty table, or one without any size, takes nothing.
    Deterministic for the same rows, however they are partitioned.
    """
    spark = docs.sparkSession
    base = without(docs, "source_size", "target", "copies", "__k1", "__k2", "__src", "__size")
    base = base.withColumns({"__src": F.col(source_col).cast("string"), "__size": F.coalesce(F.col(size_col), F.lit(0)).cast("long")})
    base = base.select("*", *row_key(1000 * seed, *id_cols, "__src", "__size"))
    items = pinned(base.groupBy("__k1", "__k2", "__src").agg((F.max("__size") * F.count(F.lit(1))).alias("__size")))

    by_name = Window.orderBy(F.col("__src").isNull(), F.col("__src"))
    sources = items.groupBy("__src").agg(F.sum("__size").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    sources = sources.withColumn("__rank", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__rank") - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumns({"__w": weight, "__cap": F.col("__sum") * max_repeat})
    # water filling: sources by the time at which they run dry; the level is found at the first that does not
    dry = Window.orderBy(F.col("__cap") / F.col("__w"), "__rank")
    before = dry.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.floor(F.sum("__sum").over(whole) * share) - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    sources = pinned(sources.withColumns({"__level": level, "__budget": F.floor(F.sum("__sum").over(whole) * share).cast("long")}))
    facts = sources.agg(F.count(F.lit(1)).alias("n"), F.max("__budget").alias("budget"), F.min(F.when(F.col("__level") <= F.col("__cap") / F.col("__w"), F.struct((F.col("__cap") / F.col("__w")).alias("dry"), "__rank", "__level"))).alias("first"), F.max(F.col("__cap") / F.col("__w")).alias("last")).first()
    budget, last = facts["budget"] or 0, facts["last"] or 0.0
    level = last if facts["first"] is None else facts["first"]["__level"]
    target = F.least(F.col("__cap").cast("double"), F.col("__w") * F.lit(float(level)))
    sources = sources.withColumn("__target", target).select(F.col("__src").alias("__name"), "__rank", "__sum", "__w", "__target", F.greatest(F.ceil(F.col("__n") / SLICE_ROWS), F.lit(1)).alias("__slices"))

    unit = F.shiftrightunsigned("__k1", 11) / F.lit(float(1 << 53))
    names = small(sources, facts["n"], 128)
    placed = items.join(names, F.col("__src").eqNullSafe(F.col("__name"))).withColumn("__slice", F.floor(unit * F.col("__slices")).cast("long"))
    totals = placed.groupBy("__rank", "__slice").agg(F.sum("__size").alias("__part"))
    totals = totals.withColumn("__before", F.sum("__part").over(Window.partitionBy("__rank").orderBy("__slice")) - F.col("__part")).drop("__part")
    inside = Window.partitionBy("__rank", "__slice").orderBy("__k1", "__k2").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.join(totals, ["__rank", "__slice"]).withColumn("__cum", F.col("__before") + F.sum("__size").over(inside))
    rounds = F.when(F.col("__sum") > 0, F.least(F.lit(max_repeat), F.floor(F.col("__target") / F.col("__sum")) + 1)).otherwise(0).cast("int")
    placed = pinned(placed.select("__k1", "__k2", "__rank", "__size", "__sum", "__w", "__target", "__cum", rounds.alias("__rounds")))

    width = (level or 1.0) * 1.02 / BINS

    def finish(e):
        return (F.col("__cum") + (e - 1) * F.col("__sum")) / F.col("__w")

    def bin_of(f):
        return F.least(F.floor(f / F.lit(width)), F.lit(BINS)).cast("long")

    copies = placed.where("__rounds > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("__rounds"))).alias("__e"))
    copies = copies.select("__size", "__rank", "__k1", "__k2", "__e", finish(F.col("__e")).alias("__f")).withColumn("__bin", bin_of(F.col("__f")))
    bins = copies.groupBy("__bin").agg(F.sum("__size").alias("__part"))
    bins = bins.withColumn("__through", F.sum("__part").over(Window.orderBy("__bin")))
    cut = bins.where(F.col("__through") > budget).agg(F.min(F.struct("__bin", (F.col("__through") - F.col("__part")).alias("before"))).alias("c")).first()["c"]
    order = ["__f", "__rank", "__e", "__k1", "__k2"]
    here, stop = BINS + 1, None
    if cut is not None:
        here = cut["__bin"]
        edge = copies.where(F.col("__bin") == here).withColumn("__run", F.sum("__size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        stop = edge.where(F.col("__run") <= budget - cut["before"]).agg(F.max(F.struct(*order)).alias("s")).first()["s"]

    def taken(e):
        f = finish(e)
        below = bin_of(f) < here
        if stop is None:
            return below
        last_one = F.struct(F.lit(stop["__f"]).alias("__f"), F.lit(stop["__rank"]).alias("__rank"), F.lit(stop["__e"]).alias("__e"), F.lit(stop["__k1"]).cast("long").alias("__k1"), F.lit(stop["__k2"]).cast("long").alias("__k2"))
        this = F.struct(f.alias("__f"), F.col("__rank"), e.cast("int").alias("__e"), F.col("__k1"), F.col("__k2"))
        return below | ((bin_of(f) == here) & (this <= last_one))

    one_by_one = sum(((F.col("__rounds") >= e) & taken(F.lit(e))).cast("int") for e in range(1, max_repeat + 1))
    verdict = placed.select("__k1", "__k2", F.col("__sum").alias("source_size"), F.col("__target").alias("target"), one_by_one.alias("copies"))
    return base.join(verdict, ["__k1", "__k2"], "left").drop("__k1", "__k2", "__src", "__size")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("size"))
    return mix_sources(docs, "size").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
