"""Quality rules (2): rule statistics of whole texts, hard base rules, and an isolation forest on the statistics.

The forest is fitted on a bounded sample of documents labelled good: trees of random splits, each on SAMPLE rows. The mean path length to
a document's leaf gives its anomaly score; the threshold is the one that separates the labelled rows best while rejecting at
most MAX_LOSS of those labelled good. Both fits use at most FIT_ROWS labelled rows, those of least hash, whatever the size of the input; every
document's statistics cover its whole text, and every document is scored. The model (some hundred small trees) is the only broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, without
from .textscan import SPACED, class_table, grams, mix, per_text, pieces, raw, word_hashes, words

#: Labelled rows that the forest and its threshold are fitted on, at most.
FIT_ROWS = 20_000
TREES, SAMPLE = 200, 256
#: Share of the documents labelled good that the threshold may reject.
MAX_LOSS = 0.002

MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8

SYMBOLS = class_table(b"#*$%&|<>")
NOT_NEWLINE = class_table(b"\n", negate=True)
MARKS = class_table(b"!?")
UPPER = class_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct_words", "n_stutter"]
BASE = COUNTS[:5]
#: Repeated windows are left to the base rule, which judges them by itself.
RATES = ["word_length", "symbols", "dup_lines", "upper", "marks", "distinct", "stutter"]


def _repeats(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values with the texts they stand in: which stand more than once in their text, and which stood in it before."""
    key = mix(values + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    again[order[1:][same]] = True
    return twice, again


def statistics(col: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS for each text; null counts as empty."""
    buf, off = raw(col)
    start, end, first = words(buf, off, SPACED)
    n = np.diff(first)
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    h = word_hashes(buf, start, end)
    owner = np.repeat(np.arange(len(n)), n)
    g, begin = grams(h, first, REPEAT_WINDOW)
    counts = np.diff(begin)
    twice, _ = _repeats(g, np.repeat(np.arange(len(n)), counts))
    at = np.arange(len(g)) + np.repeat(first[:-1] - begin[:-1], counts)
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + REPEAT_WINDOW, -1)
    repeated = np.cumsum(cover)[:-1] > 0
    l_start, l_end, l_first = words(buf, off, NOT_NEWLINE)
    full = np.searchsorted(start, l_end) > np.searchsorted(start, l_start)
    l_owner = np.repeat(np.arange(len(n)), np.diff(l_first))[full]
    _, again = _repeats(word_hashes(buf, l_start[full], l_end[full]), l_owner)
    _, seen = _repeats(h, owner)
    stutter = np.zeros(len(h), bool)
    stutter[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    here = lambda lut: per_text(lut[buf], off)
    return {
        "n_words": n,
        "word_chars": per_text(points[end] - points[start], first),
        "n_symbols": here(SYMBOLS),
        "n_dup_lines": np.bincount(l_owner[again], minlength=len(n)),
        "n_repeat_words": per_text(repeated, first),
        "n_lines": np.bincount(l_owner, minlength=len(n)),
        "n_upper": here(UPPER),
        "n_marks": here(MARKS),
        "n_stutter": per_text(stutter, first),
        "n_distinct_words": n - per_text(seen, first),
    }


def rates(s: dict[str, np.ndarray]) -> np.ndarray:
    """The columns RATES, which don't grow with the text by themselves."""
    w, c, lines = np.maximum(s["n_words"], 1.0), np.maximum(s["word_chars"], 1.0), np.maximum(s["n_lines"], 1.0)
    # distinct words fall off with length in any text; against the square root of the length they don't
    distinct = np.log((s["n_distinct_words"] + 1.0) / w**0.9)
    return np.column_stack([s["word_chars"] / w, s["n_symbols"] / w, s["n_dup_lines"] / lines, s["n_upper"] / c, s["n_marks"] / w, distinct, s["n_stutter"] / w])


def _unseen(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a failed search among n rows."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as arrays. A leaf has no child and holds its depth plus the path length that its rows would still take."""

    def __init__(self, x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(x))
        depth = int(np.ceil(np.log2(max(self.size, 2)))) + 4
        self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)], depth, rng) for _ in range(trees)]

    @staticmethod
    def _grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, child, path = [0], [0.0], [-1], [0.0]
        todo = [(0, np.arange(len(x)), 0)]
        # a split range a little wider than the rows': what lies outside of the sample is cut off early too
        low, high = x.min(0), x.max(0)
        room = 0.25 * (high - low) + 1e-3
        box = {0: (low - room, high + room)}
        while todo:
            node, rows, d = todo.pop()
            lo, hi = box.pop(node)
            if len(rows) <= 1 and d > 0 or d >= depth:
                path[node] = d + float(_unseen(len(rows)))
                continue
            f = int(rng.integers(x.shape[1]))
            c = float(rng.uniform(lo[f], hi[f]))
            feature[node], cut[node], child[node] = f, c, len(feature)
            left = x[rows, f] < c
            for side, own in ((0, rows[left]), (1, rows[~left])):
                at = len(feature)
                feature.append(0), cut.append(0.0), child.append(-1), path.append(0.0)
                a, b = lo.copy(), hi.copy()
                (b if side == 0 else a)[f] = c
                box[at] = (a, b)
                todo.append((at, own, d + 1))
        return np.array(feature), np.array(cut), np.array(child), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length over its expectation: near 1 for what is isolated early."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, child, path in self.trees:
            node = np.zeros(len(x), np.int64)
            live = rows
            while len(live):
                live = live[child[node[live]] >= 0]
                at = node[live]
                node[live] = child[at] + (x[live, feature[at]] >= cut[at])
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / max(float(_unseen(self.size)), 1e-9))


def threshold(scores: np.ndarray, good: np.ndarray, max_loss: float = MAX_LOSS) -> float:
    """The score from which on rows are rejected: the best balance of rejected bad and kept good rows within max_loss of the good ones."""
    if not len(scores) or good.all():
        return float(np.quantile(scores, 1 - max_loss)) + 1e-9 if len(scores) else 2.0
    order = np.argsort(-scores, kind="stable")
    s, g = scores[order], good[order]
    bad_found, good_lost = np.cumsum(~g) / max((~g).sum(), 1), np.cumsum(g) / max(g.sum(), 1)
    allowed = (good_lost <= max_loss) & np.append(s[1:] != s[:-1], True)
    if not allowed.any():
        return float(s[0]) + 1e-9
    best = np.flatnonzero(allowed)[np.argmax((bad_found - good_lost)[allowed])]
    following = s[best + 1] if best + 1 < len(s) else s[best] - 1e-6
    return float((s[best] + following) / 2)



def _scorer(model, keep: Sequence[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for rows in pieces(batch, text_col):
                s = statistics(rows.column(text_col))
                failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])
                score = m["forest"].score(rates(s)) if m["forest"] else np.zeros(len(failed))
                kept = ~failed & (score < m["threshold"])
                yield pa.record_batch([*(rows.column(c) for c in keep), *(pa.array(s[c], pa.int64()) for c in BASE), pa.array(failed), pa.array(score), pa.array(kept)], [*keep, *BASE, "base_failed", "anomaly", "kept"])

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in pieces(batch, "text"):
            s = statistics(rows.column("text"))
            yield pa.record_batch([rows.column("quality"), *(pa.array(s[c], pa.int64()) for c in COUNTS)], ["quality", *COUNTS])


def fit(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", fit_rows: int = FIT_ROWS, seed: int = 2) -> dict:
    """Forest and threshold from at most fit_rows labelled documents. Null labels are no labels; a document labelled twice is bad if one label says so.

    Without a good row the forest is None and only the base rules decide.
    """
    named = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").cast("int").alias("quality"))
    named = named.orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(named), "__id").select("quality", "text")
    schema = "quality int, " + ", ".join(f"{c} long" for c in COUNTS)
    got = rows.mapInArrow(_features, schema).toPandas()
    s = {c: got[c].to_numpy(np.int64) for c in COUNTS}
    x, good = rates(s), got["quality"].to_numpy() > 0
    by_value = np.lexsort(x.T) if len(x) else np.zeros(0, int)  # the same forest, however the rows came in
    x, good = x[by_value], good[by_value]
    base = (s["n_words"][by_value] < MIN_WORDS) | (100 * s["n_repeat_words"][by_value] > REPEAT_PERCENT * s["n_words"][by_value])
    if not (good & ~base).any():
        return {"forest": None, "threshold": 2.0}
    forest = Forest(x[good & ~base], seed=seed)
    return {"forest": forest, "threshold": threshold(forest.score(x[~base]), good[~base])}


def judge_quality(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", keep: Sequence[str] | None = None, fit_rows: int = FIT_ROWS, seed: int = 2) -> DataFrame:
    """docs (its columns `keep`, by default all) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly and kept.

    A null text is empty, so it fails the base rules. Repeated rows are judged alike; an empty table gives an empty result. Columns of the
    output's names are replaced.
    """
    docs = without(docs, *(c for c in [*BASE, "base_failed", "anomaly", "kept"] if c != text_col))
    keep = [c for c in docs.columns if keep is None or c in keep]
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col, id_col=id_col, fit_rows=fit_rows, seed=seed) | {"name": uuid.uuid4().hex})
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in BASE] + ["base_failed boolean", "anomaly double", "kept boolean"])
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(_scorer(model, keep, text_col), schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
