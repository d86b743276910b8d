"""Suffix-array dedup (10): remove every byte that a LENGTH-byte string covers which also starts elsewhere, and tell the shorter passages that repeat.

A suffix array over all bytes would be many times the corpus. Two equal strings have equal insides, so it suffices to sort the suffixes at
anchors: the anchor of a PASSAGE-byte window is the place in it where the hash of the leading ANCHOR bytes is least, which its content alone decides, so equal
windows have their anchors at equal places. A LENGTH-byte window belongs to the anchor of its leading PASSAGE bytes; all windows of one anchor are a run of neighbouring starts.

1. A suffix is the sequence of its leading tokens: its first eight bytes as a number, then the names (64-bit hashes) of its first ANCHOR bytes, of the RIGHT bytes that every
   LENGTH-byte window of the anchor has from there on, and of the run's whole extent, to the left of the anchor too. Sampled splitters range-partition the suffixes by these, then by text and
   place, so that a hot passage is spread; each bucket is sorted by multikey quicksort and compared with its neighbours, across bucket ends by summaries.
   Equal extents: all their windows repeat. Equal RIGHT bytes and different extents: the edges of a repeated passage. Equal ANCHOR bytes: maybe a shorter passage.
2. Of the edges, one for each distinct extent, every window's hash is sorted and compared in the same way; of suffixes with equal ANCHOR bytes the PASSAGE-byte
   windows at every STEP-th place around the anchor, so that each passage of PASSAGE + STEP bytes that repeats is met and nothing shorter than PASSAGE is.
3. The repeated windows of each document are united and its bytes cut. Texts without any are not moved, if the names of the others are few enough to be sent to them.

Equality is of the leading bytes and the 64-bit hashes together: strings that differ to the right of the anchor would have to agree in three hashes, those that differ only to the left of it
in one. A bucket holds about BUCKET suffixes, from the corpus's bytes, as the sort is in memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, small, stored, table, without
from .streams import equal_neighbours
from .textscan import mix, pieces, raw

LENGTH, PASSAGE, ANCHOR, STEP = 400, 256, 128, 16
#: Starts of the ANCHOR-byte strings in a passage, and what every LENGTH-byte window has from its anchor on.
SPAN = PASSAGE - ANCHOR + 1
RIGHT = LENGTH - SPAN + 1
PIECE, BUCKET = 256 << 10, 1 << 20

_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9FB21C651E98DF25)
    h += b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def hashes128(buf: np.ndarray) -> np.ndarray:
    """Hash of the 128 bytes from each position."""
    h = _BYTES[buf]
    for k in (1, 2, 4, 8, 16, 32, 64):
        h = _join(h[:-k], h[k:])
    return h


def hash256(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _join(h[at], h[at + 128])


def window_hashes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the LENGTH bytes from each of the positions."""
    return _join(hash256(h, at), hash256(h, at + LENGTH - 256))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        values = np.minimum(values[:-k], values[k:])
        k *= 2
    return np.minimum(values[: len(values) - (width - k)], values[width - k :]) if width > k else values


def leading(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a long that sorts as they do."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | buf[at + k].astype(np.uint64)
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each anchor of the texts: text, leading bytes, names of its ANCHOR and RIGHT bytes and of its extent, and pack(place, how far back the first window starts, how many
    windows). Without a LENGTH-byte window the last two names are 0."""
    count = np.maximum(np.diff(off) - PASSAGE + 1, 0)
    total = int(count.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 6
    h = hashes128(buf)
    bits = np.uint64(int(len(h)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = _sliding_least((mix(h) & ~low) | np.arange(len(h), dtype=np.uint64), SPAN)
    begin = np.concatenate(([0], np.cumsum(count)))
    start = np.arange(total) + np.repeat(off[:-1] - begin[:-1], count)
    place = (least[start] & low).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = place[1:] != place[:-1]
    new[begin[:-1][count > 0]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], total) - 1
    t = np.searchsorted(begin, first, side="right") - 1
    a, p = start[first], place[first]
    b = np.minimum(start[last], off[t + 1] - LENGTH)
    n = np.maximum(b - a + 1, 0)
    right, extent = np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint64)
    has = np.flatnonzero(n)
    a_, b_, p_ = a[has], b[has], p[has]
    right[has] = _join(hash256(h, p_), hash256(h, p_ + RIGHT - 256))
    end = b_ + LENGTH - 256
    extent[has] = _join(_join(hash256(h, a_), hash256(h, np.minimum(a_ + 256, end))), hash256(h, end)) ^ mix(((b_ - a_) << 16 | (p_ - a_)).astype(np.uint64))
    return t, leading(buf, p), h[p].view(np.int64), right.view(np.int64), extent.view(np.int64), (p - off[t]) << 16 | (p - a) << 8 | n


_SUFFIX = ["lead", "name", "right", "extent", "rid", "pack"]
_LONGS = ", ".join(f"{c} long" for c in _SUFFIX)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in pieces(batch, "text", PIECE):
            t, lead, name, right, extent, pack = anchors(*raw(rows.column("text")))
            yield pa.record_batch([pa.array(lead), pa.array(name), pa.array(right), pa.array(extent), rows.column("rid").take(pa.array(t)), pa.array(pack)], _SUFFIX)


def multikey_order(columns: Sequence[np.ndarray], few: int = 1 << 12) -> np.ndarray:
    """The rows' order by successive columns: multikey quicksort, which parts the rows into less, equal and more on one column and goes on to the next with the equal ones. Few rows
    are sorted at once."""
    order = np.arange(len(columns[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, k = todo.pop()
        if k == len(columns) or hi - lo < 2:
            continue
        rows = order[lo:hi]
        if hi - lo <= few:
            order[lo:hi] = rows[np.lexsort([c[rows] for c in reversed(columns[k:])])]
            continue
        values = columns[k][rows]
        sample = np.sort(values[:: max(1, len(values) // 63)])
        pivot = sample[len(sample) // 2]
        less, more = values < pivot, values > pivot
        a, b = lo + int(less.sum()), hi - int(more.sum())
        order[lo:hi] = np.concatenate((rows[less], rows[~(less | more)], rows[more]))
        todo += [(lo, a, k), (a, b, k + 1), (b, hi, k)]
    return order


#: What compared suffixes are told: whole (another has the extent), edge (one for each extent, if another extent has the RIGHT bytes), maybe (another has the ANCHOR bytes).
_FOUND = f"level int, n long, {_LONGS}, whole boolean, edge boolean, maybe boolean, head boolean"


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's suffixes, sorted and compared: those that are told something or whose group touches the bucket's ends (level 0), and the counts of these groups (levels 1 to 3)."""
    rows = pa.Table.from_batches(list(batches), pa.schema([(c, pa.int64()) for c in _SUFFIX]))
    n = len(rows)
    if not n:
        return
    columns = [rows.column(c).to_numpy() for c in _SUFFIX]
    order = multikey_order(columns)
    lead, name, right, extent, rid, pack = columns = [c[order] for c in columns]
    differs = lambda c: np.concatenate(([True], c[1:] != c[:-1]))
    new1 = differs(lead) | differs(name)
    new2 = new1 | differs(right)
    new3 = new2 | differs(extent)
    id1, id2, id3 = (np.cumsum(x) - 1 for x in (new1, new2, new3))
    has = pack & 255 > 0
    whole = (np.bincount(id3) > 1)[id3] & has
    edge = (np.bincount(id2, new3) > 1)[id2] & has
    maybe = (np.bincount(id1) > 1)[id1]
    touches = (id1 == 0) | (id1 == id1[-1])
    keep = np.flatnonzero(whole | edge | maybe | touches)
    level, count, at = [np.zeros(len(keep), np.int32)], [np.zeros(len(keep), np.int64)], [keep]
    for k, ids in ((1, id1), (2, id2), (3, id3)):
        for g in sorted({0, int(ids[-1])}):
            members = np.flatnonzero(ids == g)
            members = members[new3[members] | (members == members[0])] if k == 2 else members[:1]  # of the RIGHT bytes each end's extents, of the others how many there are
            if k == 2:
                members = members[[0, -1]]
            level.append(np.full(len(members), k, np.int32)), count.append(np.full(len(members), int((ids == g).sum()))), at.append(members)
    level, count, at = map(np.concatenate, (level, count, at))
    plain = (level == 0) & ~touches[at] & ~edge[at] & ~maybe[at]
    yield pa.record_batch([pa.array(level), pa.array(count), *(pa.array(c[at], mask=plain if k < 4 else None) for k, c in enumerate(columns)), *(pa.array(c[at]) for c in (whole, edge, maybe, new3))], [c.split()[0] for c in _FOUND.split(", ")])


def compared(suffixes: DataFrame, n: int) -> DataFrame:
    """Suffixes that are told something, with ends of buckets settled."""
    found = stored(suffixes.repartitionByRange(n, *_SUFFIX).mapInArrow(_buckets, _FOUND))
    by1, by2, by3 = (_SUFFIX[:k] for k in (2, 3, 4))
    ends = found.where("level > 0")
    names = ends.where("level = 1").groupBy(*by1).agg((F.sum("n") > 1).alias("__maybe"))
    edges = ends.where("level = 2").groupBy(*by2).agg((F.min("extent") != F.max("extent")).alias("__edge"))
    extents = ends.where("level = 3").groupBy(*by3).agg((F.sum("n") > 1).alias("__whole"))
    out = found.where("level = 0")
    for more, by, name, flag in ((names, by1, "maybe", "__maybe"), (edges, by2, "edge", "__edge"), (extents, by3, "whole", "__whole")):
        out = out.join(small(more, 4 * n, 48), by, "left").withColumn(name, F.col(name) | F.coalesce(flag, F.lit(False))).drop(flag)
    has = F.col("pack").bitwiseAND(F.lit(255)) > 0
    return out.withColumns({"whole": F.col("whole") & has, "edge": F.col("edge") & has & F.col("head"), "maybe": F.col("maybe") & (F.col("head") | ~(F.col("whole") & has))}).where("whole or edge or maybe")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every LENGTH-byte window of the edges named, and the PASSAGE-byte windows around the other suffixes named. pack: twice the start, and 1 for the latter."""
    for batch in batches:
        for rows in pieces(batch, "text", PIECE):
            buf, off = raw(rows.column("text"))
            h = hashes128(buf)
            named = rows.column("anchors").combine_chunks() if isinstance(rows.column("anchors"), pa.ChunkedArray) else rows.column("anchors")
            flat = named.flatten()
            name, right, pack, edge, maybe = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("name", "right", "pack", "edge", "maybe"))
            t = np.repeat(np.arange(len(rows)), np.diff(np.asarray(named.offsets)))
            place, size = pack >> 16, np.diff(off)[t]
            n = np.where(edge, pack & 255, 0)
            of = np.repeat(np.arange(len(n)), n)
            start = np.arange(len(of)) + np.repeat(place - (pack >> 8 & 255) - (np.cumsum(n) - n), n)
            rid = rows.column("rid")
            yield pa.record_batch([pa.array(right[of]), pa.array(window_hashes(h, start + off[t[of]]).view(np.int64)), rid.take(pa.array(t[of])), pa.array(start << 1)], ["key", "run", "rid", "pack"])
            back = np.arange(0, SPAN, STEP)
            start = place[:, None] - back
            ok = maybe[:, None] & (start >= 0) & (start + PASSAGE <= size[:, None])
            of, which = np.nonzero(ok)
            start = start[ok]
            run = hash256(h, start + off[t[of]]) ^ mix((which + 1).astype(np.uint64))
            yield pa.record_batch([pa.array(name[of] ^ 1), pa.array(run.view(np.int64)), rid.take(pa.array(t[of])), pa.array(start << 1 | 1)], ["key", "run", "rid", "pack"])


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def _cut(keep: Sequence[str], text_col: str):
    def covered(begin: np.ndarray, stop: np.ndarray, size: int) -> np.ndarray:
        return np.cumsum(np.bincount(begin, minlength=size + 1) - np.bincount(stop, minlength=size + 1))[:size] > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, text_col):
                buf, off = raw(rows.column(text_col))
                n_bytes, removed, repeated, spans, kept = np.diff(off), [], [], [], []
                for a, b, pairs in zip(off[:-1], off[1:], rows.column("__spans"), strict=True):
                    flat = pairs.values
                    body = buf[a:b]
                    if flat is None or not len(flat):
                        removed.append(0), repeated.append(0), spans.append([]), kept.append(body.tobytes())
                        continue
                    begin, stop = flat.field("start").to_numpy(), flat.field("stop").to_numpy()
                    cut = flat.field("cut").to_numpy(zero_copy_only=False)
                    cover = covered(begin[cut], stop[cut], len(body))
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], cover.astype(np.int8), [0]))))
                    removed.append(int(cover.sum()))
                    repeated.append(int(covered(begin, stop, len(body)).sum()))
                    spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                    kept.append(body[~cover].tobytes())
                columns = [pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(repeated, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(kept, pa.binary())]
                yield pa.record_batch([*(rows.column(c) for c in keep), *columns], [*keep, "n_bytes", "n_removed", "n_repeated", "removed_spans", "kept_bytes"])

    return run


def cut_repeats(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", keep: Sequence[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, by default all) with n_bytes, n_removed, n_repeated (bytes inside strings of PASSAGE bytes that were found to start elsewhere too; more than 0 for every
    document with a repeated string of PASSAGE + STEP bytes), removed_spans (maximal runs of removed bytes, byte offsets in the UTF-8 text) and kept_bytes (binary: a cut may fall
    inside a character).

    A null text is empty; texts shorter than LENGTH lose nothing; very long ones are scanned whole, one at a time. Each row is a place of its own: of rows with equal
    texts, repeated rows too, all lose what repeats. Rows equal in id and text share one key, so they are told apart by their number. An empty table gives no rows.
    Columns of the output's names are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, *(c for c in ("n_bytes", "n_removed", "n_repeated", "removed_spans", "kept_bytes", "__rid", "__spans") if c != text_col))
    keep = [c for c in docs.columns if keep is None or c in keep]
    inputs = list(dict.fromkeys([*keep, text_col]))
    text = F.col(text_col).cast("string")
    rows = docs.select(*inputs, F.xxhash64(F.lit(1010), F.col(id_col), F.col(id_col).isNull(), text).alias("__rid"))
    long_texts = rows.where(F.octet_length(text) >= PASSAGE).select(F.col("__rid").alias("rid"), text.alias("text"))
    total = long_texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // (SPAN * BUCKET)))
    found = compared(long_texts.mapInArrow(_suffixes, _LONGS), n)
    start = F.shiftright("pack", 16) - F.shiftright("pack", 8).bitwiseAND(F.lit(255))
    whole = found.where("whole").select("rid", start.alias("start"), (start + F.col("pack").bitwiseAND(F.lit(255)) - 1 + LENGTH).alias("stop"), F.lit(True).alias("cut"))
    named = found.where("edge or maybe").groupBy("rid").agg(F.collect_list(F.struct("name", "right", "pack", "edge", "maybe")).alias("anchors"))
    named = stored(named)
    windows = _only(long_texts, named.select("rid"), named.count()).join(named, "rid").mapInArrow(_windows, "key long, run long, rid long, pack long")
    single = equal_neighbours(windows, lean=True)
    begin, short = F.shiftright("pack", 1), F.col("pack").bitwiseAND(F.lit(1)) == 1
    single = single.select("rid", begin.alias("start"), (begin + F.when(short, PASSAGE).otherwise(LENGTH)).alias("stop"), (~short).alias("cut"))
    spans = stored(whole.union(single).groupBy("rid").agg(F.collect_set(F.struct("start", "stop", "cut")).alias("__spans")).withColumnRenamed("rid", "__rid"))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["n_bytes long, n_removed long, n_repeated long, removed_spans array<struct<start:long,stop:long>>, kept_bytes binary"])
    n_hit = spans.count()
    if n_hit * 24 > BROADCAST_BYTES:
        return rows.join(spans, "__rid", "left").drop("__rid").mapInArrow(_cut(keep, text_col), schema)
    hit = F.broadcast(spans.select("__rid"))
    touched = rows.join(hit, "__rid", "left_semi").join(spans, "__rid", "left").drop("__rid").mapInArrow(_cut(keep, text_col), schema)
    zero, none = F.lit(0).cast("long"), F.array().cast("array<struct<start:long,stop:long>>")
    clean = F.coalesce(text, F.lit(""))
    others = rows.join(hit, "__rid", "left_anti").select(*keep, F.octet_length(clean).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_repeated"), none.alias("removed_spans"), clean.cast("binary").alias("kept_bytes"))
    return touched.union(others)


def _only(rows: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """Rows of the names, if these are few enough to be sent to the rows; else all, for the join behind."""
    return rows.join(F.broadcast(names), "rid", "left_semi") if n * 24 <= BROADCAST_BYTES else rows


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = cut_repeats(docs, keep=["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"), "n_repeated")
