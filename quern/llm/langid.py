"""Language ID (4): interpolated Kneser-Ney character models, one a language, in sorted hash arrays.

A text is lower-cased, every run of characters that are not letters becomes one blank, and each character is predicted from the ORDER - 1
before it. Of every order there is one table for all languages together: the hashes of the n-grams that any language has seen, sorted, and beside
them the interpolated log probability in each language; the same for contexts with their back-off weights. So one search gives all languages' values, and
only n-grams that no language knows fall back to a shorter one. The language of least cross-entropy a character wins; a text whose cross-entropy is above
what its language's calibration texts reach is flagged as rejected.

The models are fitted on at most FIT_DOCS whole documents a language, those of least hash, which bounds what is broadcast; counting them is
distributed. Every document is scored as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import pinned, small, stored, table, without
from .textscan import mix, pieces

ORDER = 5
#: Labelled documents of a language that are used, at most: three quarters to fit, a quarter to calibrate.
FIT_DOCS = 2000
#: Share of calibration texts that the rejection threshold lets fail.
REJECT_SHARE = 0.001
PAD, BLANK = 1, 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def characters(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised texts, each after ORDER - 1 pads, and the text of each position."""
    pad = "\x01" * (ORDER - 1)
    joined = "".join(pad + (t or "").replace("\x01", " ") for t in texts).lower()
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code[~_letters()[code] & (code != PAD)] = BLANK
    keep = np.ones(len(code), bool)
    keep[1:] = ~((code[1:] == BLANK) & ((code[:-1] == BLANK) | (code[:-1] == PAD)))
    code = code[keep]
    return code, np.maximum(np.cumsum(code == PAD) // (ORDER - 1) - 1, 0)


def hashes_at(code: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k characters that end at each of the positions."""
    h = np.zeros(len(at), np.uint64)
    for j in range(k - 1, -1, -1):
        h += code[at - j].astype(np.uint64)
        h += np.uint64(1)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return mix(h)


def matrix_hash(grams: np.ndarray) -> np.ndarray:
    """The same hash of the n-grams in the rows."""
    h = np.zeros(len(grams), np.uint64)
    for j in range(grams.shape[1]):
        h = (h + grams[:, j].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return mix(h)


class Sorted:
    """Sorted distinct hashes with a row of values each, found by their leading bits."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        bits = max(8, int(len(hashes)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.heads = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        head = (h >> self.shift).astype(np.int64)
        at, stop = self.heads[head], self.heads[head + 1]
        live = np.flatnonzero(at < stop)
        at = at[live]
        while len(live):
            same = self.hashes[at] == h[live]
            out[live[same]] = at[same]
            more = ~same & (at + 1 < stop[live])
            live, at = live[more], at[more] + 1
        return out


class Models:
    """The tables of all languages. counts: for each language the matrix of its ORDER-grams and how often each stood."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        n_langs = len(self.langs)
        alphabet = len({int(c) for g, _ in counts.values() for c in np.unique(g[:, -1])}) + 1
        types = {lang: counts[lang] for lang in self.langs}
        by_order: dict[int, dict[str, tuple[np.ndarray, np.ndarray]]] = {}
        for k in range(ORDER, 0, -1):
            by_order[k] = types
            below = {}
            for lang, (g, _) in types.items():
                short, times = np.unique(g[:, 1:], axis=0, return_counts=True) if k > 1 else (g[:0], np.zeros(0))
                below[lang] = (short, times.astype(float))  # of how many n-grams each is the end: its continuation count
            types = below
        self.unknown = np.full(n_langs, -np.log(alphabet))
        self.grams: dict[int, Sorted] = {}
        self.contexts: dict[int, Sorted] = {}
        self.limits, self.sharpness = np.full(n_langs, np.inf), 10.0
        if not n_langs:
            return
        for k in range(1, ORDER + 1):
            every = np.unique(np.concatenate([g for g, _ in by_order[k].values()]), axis=0)
            hashes, ctx = matrix_hash(every), matrix_hash(every[:, :-1])
            if k > 1:
                lower = self.grams[k - 1]
                below = np.exp(lower.values[lower.find(matrix_hash(every[:, 1:]))].astype(float))
            else:
                below = np.exp(self.unknown)[None, :].repeat(len(every), 0)
            contexts = np.unique(ctx)
            weight, logs = np.ones((len(contexts), n_langs)), np.zeros((len(every), n_langs))
            for i, lang in enumerate(self.langs):
                g, times = by_order[k][lang]
                once, twice = (times == 1).sum(), (times == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                own = np.searchsorted(contexts, matrix_hash(g[:, :-1]))
                total = np.bincount(own, times, len(contexts))
                kinds = np.bincount(own, minlength=len(contexts))
                seen = total > 0
                weight[seen, i] = discount * kinds[seen] / total[seen]
                at = np.searchsorted(contexts, ctx)
                p = weight[at, i] * below[:, i]
                rows = Sorted(hashes, np.arange(len(hashes))[:, None])
                mine = rows.values[rows.find(matrix_hash(g)), 0]
                p[mine] += np.maximum(times - discount, 0) / total[own]
                logs[:, i] = np.log(p)
            self.grams[k] = Sorted(hashes, logs.astype(np.float32))
            self.contexts[k] = Sorted(contexts, np.log(weight).astype(np.float32))

    def entropies(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character in each language, and the number of letters, of each text."""
        code, text = characters(texts)
        here = np.flatnonzero(code != PAD)
        out = np.zeros((len(here), len(self.langs)), np.float32)
        live = np.arange(len(here))
        for k in range(ORDER, 0, -1):
            at = self.grams[k].find(hashes_at(code, here[live], k))
            found = at >= 0
            out[live[found]] += self.grams[k].values[at[found]]
            live = live[~found]
            if not len(live):
                break
            ctx = self.contexts[k].find(hashes_at(code, here[live] - 1, k - 1))
            known = ctx >= 0
            out[live[known]] += self.contexts[k].values[ctx[known]]
        out[live] += self.unknown
        owner = text[here]
        n = np.bincount(owner, minlength=len(texts))
        sums, full = np.zeros((len(texts), len(self.langs))), n > 0
        if full.any():
            sums[full] = np.add.reduceat(out, (np.cumsum(n) - n)[full], axis=0, dtype=np.float64)
        letters = np.bincount(owner, code[here] != BLANK, len(texts)).astype(np.int64)
        return -sums / np.maximum(n, 1)[:, None], letters

    def calibrate(self, entropies: np.ndarray, truth: np.ndarray, letters: np.ndarray) -> None:
        """Set each language's rejection limit and the sharpness of the score from texts with known languages."""
        use = letters > 0
        entropies, truth = entropies[use], truth[use]
        for i in range(len(self.langs)):
            own = entropies[truth == i, i]
            if len(own):
                self.limits[i] = float(np.quantile(own, 1 - REJECT_SHARE)) * 1.02
        if len(truth):
            loss = []
            grid = np.array([1, 2, 4, 8, 16, 32])
            for s in grid:
                z = -s * entropies
                z -= z.max(1, keepdims=True)
                loss.append(float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth])))
            self.sharpness = float(grid[int(np.argmin(loss))])

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether the text is rejected."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropies, letters = self.entropies(texts)
        best = entropies.argmin(1)
        rows = np.arange(len(texts))
        z = -self.sharpness * entropies
        z = np.exp(z - z.max(1, keepdims=True))
        score = np.where(letters > 0, z[rows, best] / z.sum(1), 0.0)
        least = np.where(letters > 0, entropies[rows, best], 0.0)
        rejected = (letters == 0) | (least > self.limits[best])
        return [self.langs[b] if n else "und" for b, n in zip(best, letters, strict=True)], score, least, rejected


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in pieces(batch, "text"):
            langs = np.array(rows.column("lang").to_pylist(), dtype=object)
            texts = rows.column("text").to_pylist()
            for lang in sorted(set(langs)):
                code, _ = characters([t for t, x in zip(texts, langs, strict=True) if x == lang])
                at = np.flatnonzero(code != PAD)
                _, first, times = np.unique(hashes_at(code, at, ORDER), return_index=True, return_counts=True)
                ends = at[first]
                grams = np.stack([code[ends - j] for j in range(ORDER - 1, -1, -1)], 1).astype("<u4")
                text = grams.tobytes().decode("utf-32-le", "surrogatepass")
                yield pa.record_batch([pa.array([lang] * len(ends), pa.string()), pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string()), pa.array(times, pa.int64())], ["lang", "gram", "n"])


def _rater(models, keep: Sequence[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, text_col, 1 << 20):
                lang, score, entropy, rejected = models.value.predict(rows.column(text_col).to_pylist())
                yield pa.record_batch([*(rows.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], [*keep, "lang_pred", "score", "cross_entropy", "rejected"])

    return run


def _entropies(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, "text", 1 << 20):
                e, letters = models.value.entropies(rows.column("text").to_pylist())
                yield pa.record_batch([rows.column("lang"), pa.array(list(e), pa.list_(pa.float64())), pa.array(letters)], ["lang", "e", "letters"])

    return run


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, seed: int = 4) -> Models:
    """Models from labelled rows; rows without text or language don't count."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "text"))
    # the least hashes of each language are found without its texts, copies counting once; then only the sample's texts are moved
    hashes = stored(rows.select("lang", "h").distinct())
    sizes = pinned(hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    # of the distinct hashes a share that holds far more than the sample is ranked
    share = F.shiftright("h", 11) / F.lit(float(1 << 53)) + 0.5 < (2.0 * fit_docs + 1000) / F.col("n")
    ranked = hashes.join(small(sizes, sizes.count(), 64), "lang").where(share).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= fit_docs)
    limits = pinned(ranked.groupBy("lang").agg(F.max("h").alias("limit")))
    rows = rows.join(small(limits, limits.count(), 64), "lang").where(F.col("h") <= F.col("limit")).groupBy("lang", "h").agg(F.first("text").alias("text"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    rows = stored(rows.select("lang", "text", "r"))
    counts = rows.where("r % 4 != 0").select("lang", "text").mapInArrow(_counter, "lang string, gram string, n long")
    got = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).orderBy("lang", "gram").toArrow()
    langs, grams, n = np.array(got["lang"].to_pylist(), dtype=object), "".join(got["gram"].to_pylist()), np.array(got["n"], dtype=float)
    codes = np.frombuffer(grams.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64).reshape(-1, ORDER)
    models = Models({lang: (codes[langs == lang], n[langs == lang]) for lang in dict.fromkeys(langs)})
    if models.langs:
        sent = labelled.sparkSession.sparkContext.broadcast(models)
        held = rows.where("r % 4 = 0").select("lang", "text").mapInArrow(_entropies(sent), "lang string, e array<double>, letters long").toPandas()
        place = {lang: i for i, lang in enumerate(models.langs)}
        held = held[held["lang"].isin(place)]
        if len(held):
            models.calibrate(np.stack(held["e"].to_numpy()), held["lang"].map(place).to_numpy(), held["letters"].to_numpy())
    return models


def identify_language(docs: DataFrame, models: Models, *, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, by default all) with lang_pred, score (0 to 1), cross_entropy (nats a character) and rejected.

    lang_pred is always a language of the models, also where rejected is true, but `und` for a null text or one without letters (score 0). Columns of
    the output's names are replaced. With no language learned all is `und`.
    """
    docs = without(docs, *(c for c in ("lang_pred", "score", "cross_entropy", "rejected") if c != text_col))
    keep = [c for c in docs.columns if keep is None or c in keep]
    sent = docs.sparkSession.sparkContext.broadcast(models)
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string, score double, cross_entropy double, rejected boolean"])
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(_rater(sent, keep, text_col), schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    models = fit(docs.where(~held_out).select("text", "lang"))
    out = identify_language(docs.select("doc_id", "text"), models, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
