"""Benchmark decontamination (1): one Aho-Corasick automaton over the windows of normalised benchmark items, run once over each text.

Normalised, an item or a text is its sequence of words (runs of 0-9, a-z after A-Z is lower-cased, and all that is not ASCII). A pattern is a window
of `window` consecutive item words, or a whole shorter item. The automaton runs over word numbers; only stretches of words that occur in some item can hold
a match, so it is run on those, and every match is compared word for word with the text. Words keep their byte offsets, which give
the spans in the original.

The texts are never shuffled. The patterns go to the executors as a broadcast of at most `block_bytes` of item text; a larger benchmark is
split into as many blocks as that takes, each scanned for, and the hits are merged by row key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import row_key, table, without
from .textscan import ALNUM, LOWER, pieces, raw, word_hashes, words

#: Bytes of item text that one automaton holds.
BLOCK_BYTES = 32 << 20

HIT_COLUMNS = "n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<start:int,stop:int>>, contaminated boolean"


def item_words(text: str | None) -> list[bytes]:
    buf, off = raw(pa.array([text], pa.string()))
    low = LOWER[buf].tobytes()
    start, end, _ = words(buf, off, ALNUM)
    return [low[a:b] for a, b in zip(start, end, strict=True)]


def windows(items: Sequence[tuple[object, str | None]], size: int) -> dict[tuple[bytes, ...], set[str]]:
    """Each window and the ids, as strings, of the items that it stands in; an id of null gives windows without an id."""
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, text in items:
        w = item_words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            ids = out.setdefault(tuple(w[i : i + size]), set())
            if item_id is not None:
                ids.add(str(item_id))
    return out


class Matcher:
    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]) -> None:
        import ahocorasick

        self.patterns = list(patterns.items())
        vocabulary = sorted({w for p in patterns for w in p})
        number = {w: i for i, w in enumerate(vocabulary)}
        ends = np.cumsum([len(w) for w in vocabulary], dtype=np.int64)
        buf = np.frombuffer(b"".join(vocabulary), np.uint8)
        hashes = word_hashes(buf, np.concatenate(([0], ends[:-1])) if len(ends) else ends, ends)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order.astype(np.int64)
        self.shortest = min(map(len, patterns), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for i, (p, _) in enumerate(self.patterns):
            self.automaton.add_word(tuple(number[w] for w in p), i)
        if self.patterns:
            self.automaton.make_automaton()

    def scan(self, col: pa.Array) -> pa.RecordBatch:
        """HIT_COLUMNS for each text."""
        buf, off = raw(col)
        start, end, first = words(buf, off, ALNUM)
        n = np.diff(first)
        hit, items = np.zeros(len(start), bool), [set() for _ in range(len(col))]
        if self.patterns and len(start):
            h = word_hashes(buf, start, end, lower=True)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            number = np.where(known, self.numbers[at], -1)
            opens = known.copy()
            opens[1:] &= ~known[:-1]
            head = first[:-1][n > 0]
            opens[head] = known[head]
            lo = np.flatnonzero(opens)
            closes = known.copy()
            closes[:-1] &= ~known[1:]
            closes[head[1:] - 1] = known[head[1:] - 1]
            hi = np.flatnonzero(closes) + 1
            long_enough = hi - lo >= self.shortest
            text_of = np.searchsorted(first, lo, side="right") - 1
            for a, b, d in zip(lo[long_enough], hi[long_enough], text_of[long_enough], strict=True):
                for last, i in self.automaton.iter(tuple(number[a:b].tolist())):
                    pattern, ids = self.patterns[i]
                    to = a + last + 1
                    span = range(to - len(pattern), to)
                    if all(LOWER[buf[start[j] : end[j]]].tobytes() == w for j, w in zip(span, pattern, strict=True)):
                        hit[span.start : to] = True
                        items[d] |= ids
        sums = np.concatenate(([0], np.cumsum(hit)))
        n_hit = sums[first[1:]] - sums[first[:-1]]
        spans: list[list] = [[] for _ in range(len(col))]
        for d in np.flatnonzero(n_hit):
            here = hit[first[d] : first[d + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], here.astype(np.int8), [0]))))
            points = np.concatenate(([0], np.cumsum((buf[off[d] : off[d + 1]] & 0xC0) != 0x80)))
            for a, b in zip(edge[::2] + first[d], edge[1::2] + first[d] - 1, strict=True):
                spans[d].append({"start": int(points[start[a] - off[d]]), "stop": int(points[end[b] - off[d]])})
        names = [sorted(x) for x in items]
        columns = [pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(n_hit > 0)]
        return pa.record_batch(columns, ["n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated"])


_matchers: dict[object, Matcher] = {}


def _scanner(patterns, keep: Sequence[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = patterns.value["name"]
        if name not in _matchers:
            _matchers.clear()
            _matchers[name] = Matcher(patterns.value["patterns"])
        for batch in batches:
            for rows in pieces(batch, text_col):
                found = _matchers[name].scan(rows.column(text_col))
                yield pa.record_batch([rows.column(c) for c in keep] + found.columns, [*keep, *found.schema.names])

    return run


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, keep: Sequence[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (its columns `keep`, by default all) with n_words, n_hit (words inside an occurrence of a window), n_items and item_ids (items with
    occurring windows, ids as strings in order), spans (maximal runs of hit words, as code point offsets in the original text) and contaminated.

    A null text has no words; an empty benchmark, or items without words, hit nothing; repeated items count once; overlapping and repeated
    matches mark a word once. Columns of the output's names are replaced.
    """
    import uuid

    out = ["n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated"]
    docs = without(docs, *(c for c in out if c != text_col))
    keep = [c for c in docs.columns if keep is None or c in keep]
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    items = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def patterns(b: int):
        return sc.broadcast({"name": uuid.uuid4().hex, "patterns": windows([tuple(r) for r in items.where(F.col("b") == b).select("i", "t").collect()], window)})

    inputs = list(dict.fromkeys([*keep, text_col]))
    if blocks == 1:
        return docs.select(*inputs).mapInArrow(_scanner(patterns(0), keep, text_col), f"{schema}, {HIT_COLUMNS}")
    keyed = docs.select(*inputs, *row_key(101, *inputs))
    n_words = keyed.mapInArrow(_scanner(sc.broadcast({"name": "none", "patterns": {}}), [*keep, "__k1", "__k2"], text_col), f"{schema}, __k1 long, __k2 long, {HIT_COLUMNS}").select(*keep, "__k1", "__k2", "n_words")
    found = None
    for b in range(blocks):
        part = keyed.dropDuplicates(["__k1", "__k2"]).mapInArrow(_scanner(patterns(b), ["__k1", "__k2"], text_col), f"__k1 long, __k2 long, {HIT_COLUMNS}").where("contaminated").select("__k1", "__k2", "item_ids", "spans")
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("__k1", "__k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("__spans"))
    both = keyed.dropDuplicates(["__k1", "__k2"]).join(merged, ["__k1", "__k2"]).select("__k1", "__k2", F.col(text_col).alias("text"), "item_ids", "__spans")
    merged = both.mapInArrow(_merge, "__k1 long, __k2 long, n_hit long, item_ids array<string>, spans array<struct<start:int,stop:int>>")
    out_df = n_words.join(merged, ["__k1", "__k2"], "left")
    empty = {"item_ids": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<start:int,stop:int>>"), "n_hit": F.lit(0).cast("long")}
    out_df = out_df.withColumns({c: F.coalesce(c, e) for c, e in empty.items()})
    return out_df.withColumns({"n_items": F.size("item_ids").cast("long"), "contaminated": F.col("n_hit") > 0}).select(*keep, *out)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several blocks, overlapping or touching by words alone, as maximal runs, and the words in them."""
    for batch in batches:
        for rows in pieces(batch, "text"):
            counts, merged = [], []
            for text, spans in zip(rows.column("text").to_pylist(), rows.column("__spans").to_pylist(), strict=True):
                buf, off = raw(pa.array([text], pa.string()))
                start, end, _ = words(buf, off, ALNUM)
                points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                a, b = points[start], points[end]
                hit = np.zeros(len(a) + 1, bool)
                for s in spans:
                    hit[np.searchsorted(a, s["start"]) : np.searchsorted(b, s["stop"]) + 1] = True
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[:-1].astype(np.int8), [0]))))
                counts.append(int(hit[:-1].sum()))
                merged.append([{"start": int(a[x]), "stop": int(b[y - 1])} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            yield pa.record_batch([rows.column("__k1"), rows.column("__k2"), pa.array(counts, pa.int64()), rows.column("item_ids"), pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], ["__k1", "__k2", "n_hit", "item_ids", "spans"])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mark_contaminated(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents
), i AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), m AS (
  SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, k)
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
