"""Sorted streams of Arrow batches, and equal neighbours in a table that is range-partitioned over all tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small, stored


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches as batches of whole groups of equal keys, with where the groups begin (and the end)."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cut = np.zeros(len(batch), bool)
        for k in keys:
            c = batch.column(k)
            cut[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        cut[0] = bool(rest) and any(rest[-1].column(k)[-1] != batch.column(k)[0] for k in keys)
        begin = np.flatnonzero(cut)
        if not len(begin):
            rest.append(batch)
            continue
        done = [*rest, batch.slice(0, begin[-1])]
        sizes = np.concatenate(([0], begin + sum(map(len, rest)))) if rest else np.concatenate(([0], begin))
        out = pa.Table.from_batches(done).combine_chunks()
        if len(out):
            yield out.to_batches()[0], np.unique(sizes)
        rest = [batch.slice(begin[-1])]
    if rest:
        out = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
        yield out, np.array([0, len(out)])


def _neighbours(batches: Iterator[pa.RecordBatch], lean: bool = False) -> Iterator[pa.RecordBatch]:
    """Records that may have an equal, of sorted (key, run, rid, pack), and summaries of the key groups that touch the partition's ends.

    lean: only records with an equal (key, run) matter, and those of groups that are settled here come without key and run.
    """
    names = ["summary", "key", "run", "rid", "pack", "run_dup", "mixed", "rep", "n"]

    def judged(rows: pa.RecordBatch, begin: np.ndarray, first: bool, last: bool) -> pa.RecordBatch:
        run = rows.column("run").to_numpy()
        new = np.zeros(len(rows), bool)
        new[begin[:-1]] = True
        new[1:] |= run[1:] != run[:-1]
        of_run = np.cumsum(new) - 1
        run_dup = np.bincount(of_run)[of_run] > 1
        of_key = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        mixed = (np.bincount(of_key, new) > 1)[of_key]
        ends = sorted({0} if first else set()) + sorted({len(begin) - 2} if last and not (first and len(begin) == 2) else set())
        use = run_dup if lean else run_dup | (mixed & new)
        use, edge = use.copy(), np.zeros(len(rows), bool)
        blocks = []
        for g in ends:
            lo, hi = begin[g], begin[g + 1]
            use[lo:hi] = edge[lo:hi] = True
            at = sorted({of_run[lo], of_run[hi - 1]})
            where = [int(np.flatnonzero(of_run[lo:hi] == r)[0] + lo) for r in at]
            counts = [int((of_run[lo:hi] == r).sum()) for r in at]
            blocks.append((where, counts))
        keep = np.flatnonzero(use)
        idx = np.concatenate([keep, *(np.array(w, np.int64) for w, _ in blocks)]).astype(np.int64)
        n = np.concatenate([np.zeros(len(keep), np.int64), *(np.array(c, np.int64) for _, c in blocks)]).astype(np.int64)
        got = rows.take(pa.array(idx))
        if lean:
            blank = pa.array(~edge[idx] & (n == 0))
            got = pa.record_batch([*(pc.if_else(blank, pa.scalar(None, pa.int64()), got.column(c)) for c in ("key", "run")), got.column("rid"), got.column("pack")], ["key", "run", "rid", "pack"])
        return pa.record_batch([pa.array(n > 0), *(got.column(c) for c in ("key", "run", "rid", "pack")), pa.array(run_dup[idx]), pa.array(mixed[idx]), pa.array(new[idx]), pa.array(n)], names)

    held, first = None, True
    for block in whole_groups(batches, ["key"]):
        if held is not None:
            yield judged(*held, first, False)
            first = False
        held = block
    if held is not None:
        yield judged(*held, first, True)


def _lean_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _neighbours(batches, lean=True)


def equal_neighbours(df: DataFrame, *, lean: bool = False) -> DataFrame:
    """Of df(key, run, rid, pack, all long): the records with run_dup (another record has the same key and run) or, one or a few for each key and run
    (rep), with mixed (another record has the same key with another run). lean: only those with run_dup, and key and run may be null.

    Sampled splitters range-partition the records over (key, run, rid, pack), so that a group of any size is spread; partitions sort locally
    and compare neighbours; groups that touch a partition's end are settled from one or two summaries a partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "run", "rid", "pack"]
    spread = df.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = stored(spread.mapInArrow(_lean_neighbours if lean else _neighbours, "summary boolean, key long, run long, rid long, pack long, run_dup boolean, mixed boolean, rep boolean, n long"))
    ends = found.where("summary")
    keys = ends.groupBy("key").agg((F.min("run") != F.max("run")).alias("__mixed"))
    runs = ends.groupBy("key", "run").agg((F.sum("n") > 1).alias("__dup"))
    out = found.where("not summary").join(small(keys, 4 * n, 32), "key", "left").join(small(runs, 4 * n, 32), ["key", "run"], "left")
    out = out.withColumns({"run_dup": F.col("run_dup") | F.coalesce("__dup", F.lit(False)), "mixed": F.col("mixed") | F.coalesce("__mixed", F.lit(False))})
    return out.where(F.col("run_dup") if lean else F.col("run_dup") | (F.col("mixed") & F.col("rep"))).select(*order, "run_dup", "mixed", "rep")
