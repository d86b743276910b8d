"""Sharding (7): a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows of partition i that go to shard j are a draw without replacement from the shard's capacity, so the matrix of counts is multivariate
hypergeometric with exact margins. The driver draws it from one count per partition. Each partition permutes its rows locally and cuts the
order at the matrix row's sums; the exchange brings rows to their shards, which permute again. DataFrame functions only; the one exchange
of rows is by (shard, range of the second random key), so that a shard of any size is spread over many tasks.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import pinned, small, table, without

#: Rows, aimed at, of a piece of a shard that one task orders.
PIECE_ROWS = 2048


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` balls taken from good + bad are good; inversion outwards from the mode, so about as many steps as the deviation is wide. Integers of any size."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    log_p = sum(lg(n + 1) - lg(k + 1) - lg(n - k + 1) for n, k in ((good, mode), (bad, draws - mode))) - (lg(good + bad + 1) - lg(draws + 1) - lg(good + bad - draws + 1))
    u = rng.random() - math.exp(log_p)
    p_up = p_down = math.exp(log_p)
    up = down = mode
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], capacities: list[int], rng: random.Random) -> list[list[int]]:
    """A row of len(capacities) counts for each partition; rows sum to counts, columns to capacities."""
    left, rest, out = list(capacities), sum(capacities), []
    for n in counts:
        row, todo, pool = [], n, rest
        for j, free in enumerate(left):
            got = hypergeometric(rng, free, pool - free, todo) if j + 1 < len(left) else todo
            pool -= free
            todo -= got
            row.append(got)
        left = [a - b for a, b in zip(left, row, strict=True)]
        rest -= n
        out.append(row)
    return out


def shuffle_into_shards(docs: DataFrame, n_shards: int = 8, *, seed: int = 7) -> DataFrame:
    """docs with shard (int) and slot (long, 0 upwards in each shard without gaps); shard sizes are at most one apart, in row counts.

    Every row counts, repeated ones too; no column's value matters, so nulls and hot values change nothing. Columns called shard or slot are
    replaced. With fewer rows than shards some shards stay empty; an empty table gives an empty result.
    The input is checkpointed first, so a retried task sees the same rows at the same places.
    """
    spark = docs.sparkSession
    base = pinned(without(docs, "shard", "slot", "__id", "__part", "__r", "__at", "__cuts", "__piece", "__before", "__r2"))
    base = base.withColumn("__id", F.monotonically_increasing_id())
    base = base.withColumns({"__part": F.shiftright("__id", 33), "__r": F.xxhash64(F.lit(seed), "__id")})
    counts = {r["__part"]: r["n"] for r in base.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a partition
    total = sum(counts.values())
    parts = sorted(counts)
    sizes = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([counts[p] for p in parts], sizes, random.Random(seed))
    cuts = spark.createDataFrame([(p, [sum(row[: j + 1]) for j in range(n_shards)]) for p, row in zip(parts, matrix, strict=True)], "__part long, __cuts array<long>")
    # the place in the partition's own random order, then the shard whose share of that order it falls in
    local = base.sortWithinPartitions("__r", "__id").withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    local = local.join(small(cuts, len(parts), 32 + 8 * n_shards), "__part")
    shard = sum((F.col("__at") >= F.col("__cuts")[j]).cast("int") for j in range(n_shards - 1)) if n_shards > 1 else F.lit(0)
    pieces = max(1, math.ceil(total / n_shards / PIECE_ROWS))
    second = F.xxhash64("__id", F.lit(seed + 1))
    local = local.withColumns({"shard": shard, "__r2": second}).withColumn("__piece", F.floor(F.shiftrightunsigned("__r2", 11) / F.lit(float(1 << 53)) * pieces).cast("long"))
    offsets = local.groupBy("shard", "__piece").agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.withColumn("__before", F.sum("__n").over(Window.partitionBy("shard").orderBy("__piece")) - F.col("__n")).drop("__n")
    again = Window.partitionBy("shard", "__piece").orderBy("__r2", "__id")
    out = local.join(offsets, ["shard", "__piece"]).withColumn("slot", (F.col("__before") + F.row_number().over(again) - 1).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in base.columns if not c.startswith("__")], "shard", "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return shuffle_into_shards(docs, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
