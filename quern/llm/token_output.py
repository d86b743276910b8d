"""Token-ID output (6): Parquet files of token ids in order of the document id, with encodings, row groups and page indexes that suit
selective reads.

Layout: one row per document, (part, id, place in the part, number of ids, ids). The ids are dictionary-encoded (a vocabulary's ids fit one
dictionary page), the ascending numbers delta-encoded; row groups and pages are small and Parquet's column and offset indexes are written, so a
range of documents, or the counts without the ids, are read without the rest. Where a document's ids start in the whole sequence
is the sum of earlier parts' counts, which comes from the count column alone, plus its place in its part.

Tokenizing: the vocabulary's pre-tokenizer drops white space and never joins letters with marks, so a text is the sequence of its runs of
letters, of digits and of marks, and each run's ids hang on the run alone. A piece's runs are cut and numbered by Arrow's dictionary encoding; each distinct run is
looked up once a piece, and encoded once a worker. What may be read otherwise (an apostrophe, an unusual character) is looked up between blanks as a whole, and a text with a
special token's name, or any text where the tokenizer file has other settings, goes to the tokenizer as it is. The table of runs is emptied when full, so its memory is bounded.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_dir, small, table
from .textscan import LOWER, class_table, pieces, raw

#: Runs that a worker remembers, and bytes of text that are encoded together.
REMEMBERED, PIECE = 400_000, 4 << 20
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
# The settings of a tokenizer file under which runs stand alone (white space dropped; letters, digits and marks apart; lower case; each word's last token marked).
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: A word of letters that have one lower-case letter each.
LETTERS = re.compile("[a-zA-Z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+").fullmatch
WORD_END, SPECIAL = "</w>", "<|"

BLANK = class_table(b" \t\n\x0b\x0c\r")
BLANK[128:] = False
#: 0 blank, 1 letter, 2 digit, 3 mark; bytes from 128 on count as letters, and what isn't one of those below makes its whole stretch odd.
KIND = np.full(256, 3, np.uint8)
KIND[BLANK] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
#: Control characters and the apostrophe.
ODD = np.zeros(256, bool)
ODD[[*(c for c in range(32) if not BLANK[c]), 39, 127]] = True

#: Settings of Spark's Parquet writer.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#place": "false",
}


def odd_bytes(buf: np.ndarray) -> np.ndarray:
    """Bytes that a run can't be told by: controls, apostrophes, and all beyond ASCII but the letters U+00C0 to U+024F (two bytes each) that have one lower-case letter."""
    odd = ODD[buf]
    high = np.flatnonzero(buf >= 128)
    if len(high):
        b, lead = buf[high].astype(np.int32), buf[high] >= 0xC0
        after = buf[np.minimum(high + 1, len(buf) - 1)].astype(np.int32)
        point = (b - 0xC0) * 64 + after - 128
        fine = lead & (point >= 0xC0) & (point < 0x250) & (b < 0xE0) & (point != 0xD7) & (point != 0xF7) & (point != 0x130)
        fine[1:] |= ~lead[1:] & fine[:-1] & (high[1:] == high[:-1] + 1)
        odd[high] = ~fine
    return odd


def runs(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All runs of the texts, in lower case as far as ASCII goes, and how many each text has. A stretch between blanks with an odd byte is one run."""
    kind = KIND[buf]
    new = np.ones(len(buf), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[off[:-1][off[:-1] < len(buf)]] = True
    odd = np.flatnonzero(odd_bytes(buf))
    if len(odd):
        blank = kind == 0
        edge = np.flatnonzero(blank)
        edge = np.union1d(edge, off) if len(edge) else np.asarray(off)  # blanks and starts of texts end stretches
        k = np.searchsorted(edge, odd, side="right")
        at_start = np.concatenate(([0], edge))[k]
        lo = np.where(kind[np.minimum(at_start, len(buf) - 1)] == 0, at_start + 1, at_start)
        hi = np.append(edge, len(buf))[k]
        lo, first = np.unique(lo, return_index=True)
        inside = np.zeros(len(buf) + 1, np.int8)
        np.add.at(inside, lo + 1, 1)
        np.add.at(inside, np.maximum(hi[first], lo + 1), -1)
        new[np.cumsum(inside, dtype=np.int32)[:-1] > 0] = False
    use = kind != 0
    start = np.flatnonzero(new & use)
    ends = np.cumsum(use, dtype=np.int32)
    offsets = np.append(ends[start] - 1, ends[-1] if len(ends) else 0)
    n = np.diff(np.searchsorted(start, off))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(LOWER[buf[use]]))]), n


class Stretches:
    """Token ids of runs of text, remembered up to a bound."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(Path(path).read_text(encoding="utf-8"))
        special = all(SPECIAL in t["content"] for t in settings["added_tokens"])
        self.known_settings = special and settings["model"].get("end_of_word_suffix") == WORD_END and all(settings[k] == v for k, v in SETTINGS.items())
        vocabulary = self.tokenizer.get_vocab()
        # words of known letters need no normalizer: spelled as the vocabulary spells bytes, they go to the same model with blanks between them
        self.model = Tokenizer.from_file(path)
        self.model.normalizer, self.model.pre_tokenizer = Sequence([]), WhitespaceSplit()
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelling = {c: spell(chr(c))[0][0] for c in range(0xC0, 0x250) if LETTERS(chr(c))} if self.known_settings else {}
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith(WORD_END)]] = True
        self.empty()

    def empty(self) -> None:
        self.at: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.ends, self.known = np.zeros(1 << 16, np.int32), 0

    def add(self, part: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        total = len(ids)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.known + len(part) >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.ids[self.used : self.used + total] = ids
        self.ends[self.known + 1 : self.known + len(part) + 1] = self.used + np.cumsum(counts)
        self.at.update(zip(part, range(self.known, self.known + len(part)), strict=True))
        self.used += total
        self.known += len(part)

    def whole(self, texts: list[str], tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        """The tokenizer's own ids of each text, end to end, and their counts."""
        found = [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def learn(self, new: list[bytes]) -> None:
        for lo in range(0, len(new), 20_000):
            words, spelled, others = [], [], []
            for w in new[lo : lo + 20_000]:
                if w.isalpha():
                    words.append(w)
                    spelled.append(w.decode())
                elif LETTERS(text := w.decode()):
                    words.append(w)
                    spelled.append(text.lower().translate(self.spelling))
                else:
                    others.append(w)
            self.add(others, *self.whole([w.decode() for w in others]))
            # the last token of each word is marked in the vocabulary
            ids = self.whole([" ".join(spelled)], self.model)[0]
            self.add(words, ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1))

    def lists(self, texts: pa.Array, end_id: int) -> tuple[pa.ListArray, np.ndarray]:
        """The ids of each run of texts without special names, a list with the end id behind each text; and how many lists each text has."""
        cut, n = runs(*raw(texts))
        coded = cut.dictionary_encode()
        distinct = [*coded.dictionary.to_numpy(zero_copy_only=False), b" "]  # the end id stands for a blank, which no run holds
        if self.known > REMEMBERED or self.used > 16 * REMEMBERED:
            self.empty()
        if not self.known:
            self.add(distinct[-1:], np.array([end_id], np.int32), np.array([1]))
        found = list(map(self.at.get, distinct))
        new = [w for w, i in zip(distinct, found, strict=True) if i is None]
        if new:
            self.learn(new)
            found = list(map(self.at.__getitem__, distinct))
        which = np.array(found, np.int32)
        table = pa.ListArray.from_arrays(pa.array(self.ends[: self.known + 1]), pa.array(self.ids[: self.used]))
        return table.take(pa.array(which[np.insert(coded.indices.to_numpy(), np.cumsum(n), len(distinct) - 1)])), n + 1

    def encode(self, texts: Sequence[str] | pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's end id included, and how many each text has. A null text is empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        named = np.asarray(pc.match_substring(texts, SPECIAL)) if self.known_settings else np.ones(len(texts), bool)
        found, n_lists = self.lists(pc.if_else(pa.array(named), "", texts) if named.any() else texts, end_id)
        ids = found.values.to_numpy()
        ends = np.asarray(found.offsets)[np.concatenate(([0], np.cumsum(n_lists)))]
        n = np.diff(ends).astype(np.int64)
        if named.any():
            own, counts = self.whole(texts.filter(pa.array(named)).to_pylist())
            ids = np.insert(ids, np.repeat(ends[:-1][named], counts), own)
            n[named] += counts
        return ids, n


@lru_cache(maxsize=1)
def _stretches(path: str) -> Stretches:
    return Stretches(path)


def _encoder(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in pieces(batch, "text", PIECE):
                ids, n = _stretches(tokenizer_path).encode(rows.column("text"), end_id)
                off = np.concatenate(([0], np.cumsum(n)))
                yield pa.record_batch(
                    {
                        "part": pa.array(np.full(len(n), part, np.int32)),
                        "doc_id": rows.column("doc_id"),
                        "place": pa.array(place + off[:-1]),
                        "n_tokens": pa.array(n),
                        "ids": pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)),
                    }
                )
                place += int(off[-1])
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs to `path` in the layout above, in ascending order of id_col (null first; equal ids by a hash of the text).

    A null text is an empty one, of the end id alone. Only the id and the text are read; an empty table gives files without rows.
    Whole texts are encoded. id_col is written as doc_id.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("__tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "__tie").sortWithinPartitions("doc_id", "__tie", "text").drop("__tie")
    out = rows.mapInArrow(_encoder(tokenizer_path, end_id), "part int, doc_id long, place long, n_tokens long, ids array<int>")
    out.write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of the files at path; columns that are not used are not read."""
    files = spark.read.schema("part int, doc_id long, place long, n_tokens long, ids array<int>").parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("__sum"))
    parts = parts.withColumn("__before", F.sum("__sum").over(Window.orderBy("part")) - F.col("__sum")).drop("__sum")
    bound = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.join(small(parts, bound, 32), "part").select("doc_id", (F.col("__before") + F.col("place")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
        off = np.asarray(ids.offsets) * 4
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.record_batch([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write docs' tokens to a new place in the shared folder, read them back, and give doc_id, start, n_tokens and ids_crc32."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, str(tokenizer_path))
    return read_tokens(spark, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))
