"""Substring dedup (8): near-duplicate passages by compact windows.

The tokens of a text are its five-word shingles. Under one hash function, a compact window (first, place, last) holds every stretch that contains `place` and lies in first..last:
all have the same min-hash, that of `place`. The windows are the nodes of the Cartesian tree over the token hashes whose extent is at
least the shortest passage; about 2n / length of them stand for all stretches of a text. Stretches of similarity s in two texts share a min-hash under one function with
probability s, so FUNCTIONS functions miss a near-duplicate passage with (1 - s) to that power, and an exactly repeated one never.

1. The windows of all texts, one record a function and window, are range-partitioned by (function and min-hash, content, text, place) and sorted. The content is a hash of
   the shingles of the window within RADIUS of its place, 46 or more: windows of one content are an exactly repeated passage. The first of a partition leads and is linked to the others of other texts, and where
   its text holds the content again, to the first of another text.
2. The leaders of one min-hash, from whatever partition, are compared on their shingles within RADIUS of the place, in blocks of BLOCK leaders: each with the first, and
   those that hold no passage in common with it with all others. Place by place a passage is a stretch of MIN_WORDS words or more whose Jaccard similarity is at least SIMILARITY; where
   enough shingles are shared up to SHIFT places off, the two stretches are trimmed to where they agree, else all stretches between shared shingles are tried, and the similarity of the sets
   is computed. (A changed, added or moved word breaks four shingles or more, so a passage of the similarity holds a run of at least 20 unchanged ones; RUN of them tell which windows may hold a passage in common.)
3. Interval join: the passages of two texts on one diagonal (difference of places) that overlap are united into one, then those that overlap by half in both texts (a line over
   and over gives a passage on each of many diagonals), and those that follow one another in both, with an edit between them, if what they share is similar enough to the whole.
4. The query gives classes: one row per document, with the least id of the texts that passages join to its own, and the stretches of it that passages cover.

Rows of equal text are links of their own, whole text to whole text with the row of least id, and only that row takes part in the steps above.

A passage in m texts gives about m links and not their square. Shingles are compared on 16 bits within windows that share a 64-bit min-hash. A window is looked at against all others of its
min-hash only where it is unlike the first, through an index of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .jaccard_join import SHINGLE, SIMILARITY, shingle_sets
from .shared import BROADCAST_BYTES, pinned, small, stored, table
from .streams import whole_groups
from .textscan import _powers, mix, pieces

#: Words of the shortest passage that is looked for.
MIN_WORDS = 50
#: Share of passages of just the similarity that may be missed, and the functions that this takes.
MISSED = 0.002
FUNCTIONS = math.ceil(math.log(MISSED) / math.log(1 - SIMILARITY))
#: A passage of least length that contains a place has all its shingles within so many of it.
RADIUS = MIN_WORDS - SHINGLE
#: Leaders of a min-hash that are compared in one task, and that are compared without an index.
BLOCK, FEW = 20_000, 12
#: Shingles of a run, and so many runs are shared by two windows with a passage in common.
RUN, SHARED = 16, 4
#: Shingles that two passages of least length and the similarity share.
COMMON = math.ceil(2 * (MIN_WORDS - SHINGLE + 1) * SIMILARITY / (1 + SIMILARITY) - 1e-9)
#: A passage of the similarity and of less than twice the least length has no more added or left out shingles than this.
BITS = 2048
SHIFT = int(2 * (MIN_WORDS - SHINGLE + 1) * (1 / SIMILARITY - 1)) // 2 + 1
PIECE = 512 << 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_SEEDS = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def compact_windows(values: np.ndarray, begin: np.ndarray, length: int, reach: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first, place and last of every compact window of at least `length` tokens; texts are values[begin[i]:begin[i + 1]].

    Equal values count as smaller to the left, so each stretch is in one window. Found by doubling: all positions that are least in some stretch of `length`
    are nodes of the tree, and each grows left and right over minima of 1, 2, 4, ... tokens. reach: windows need not be told further than this from their places.
    """
    none = np.zeros(0, np.int64)
    sizes = np.diff(begin)
    count = np.maximum(sizes - length + 1, 0)
    total = int(count.sum())
    if not total:
        return none, none, none
    bits = np.uint64(int(len(values)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    keyed = (values & ~low) | np.arange(len(values), dtype=np.uint64)  # all distinct; the leftmost of equals is least
    levels = [keyed]
    most = min(int(sizes.max()), len(values), max(length, reach or len(values)))
    while 2 << (len(levels) - 1) <= most:
        k = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-k], levels[-1][k:]))
    top = int(length).bit_length() - 1
    starts = np.arange(total) + np.repeat(begin[:-1] - (np.cumsum(count) - count), count)
    least = np.minimum(levels[top][starts], levels[top][starts + length - (1 << top)])
    place = np.unique((least & low).astype(np.int64))
    own = keyed[place]
    text = np.searchsorted(begin, place, side="right") - 1
    lo, hi = begin[text], begin[text + 1]
    first, last = place.copy(), place + 1
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        for _ in range(1):
            can = first - step >= lo
            ok = np.zeros(len(place), bool)
            ok[can] = levels[k][first[can] - step] > own[can]
            first[ok] -= step
            can = last + step <= hi
            ok = np.zeros(len(place), bool)
            ok[can] = levels[k][last[can]] > own[can]
            last[ok] += step
    return first, place, last - 1


def _window_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    length = MIN_WORDS - SHINGLE + 1
    for batch in batches:
        for rows in pieces(batch, "text", PIECE):
            g, begin, _ = shingle_sets(rows.column("text"))
            up, down = _powers(1 << max(16, len(g).bit_length()))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(g * up[: len(g)])))
            for seed in _SEEDS:
                h = mix(g ^ seed)
                first, place, last = compact_windows(h, begin, length, RADIUS)
                opens = (place == 0) | (g[place] != g[place - 1])  # of one shingle over and over the first place stands for all
                opens[np.isin(place, begin)] = True
                first, place, last = first[opens], place[opens], last[opens]
                lo, hi = np.maximum(first, place - RADIUS), np.minimum(last, place + RADIUS) + 1
                content = mix((sums[hi] - sums[lo]) * down[lo] + ((place - lo) * 128 + hi - place).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
                t = np.searchsorted(begin, place, side="right") - 1
                base = begin[t]
                yield pa.record_batch([pa.array(h[place].view(np.int64)), *(rows.column(c).take(pa.array(t)) for c in ("rid", "doc_id")), pa.array(content.view(np.int64)), pa.array((place - base).astype(np.int32)), pa.array((place - lo).astype(np.int8)), pa.array((hi - 1 - place).astype(np.int8))], ["key", "rid", "doc_id", "content", "place", "before", "after"])


_WINDOW = ("rid", "place", "before", "after")
_RECORD = "key long, rid long, place int, before byte, after byte, doc_id long, lead_rid long, lead_place int, lead_before byte, lead_after byte, lead_doc_id long, kind int"
_NAMES = ["rid", "start", "stop", "lead_rid", "lead_start", "lead_stop", "similarity"]
_IDS = "doc_id long, lead_doc_id long"
_LINK = f"rid long, start int, stop int, lead_rid long, lead_start int, lead_stop int, similarity double, {_IDS}"


def _carried(rows: pa.RecordBatch) -> list[str]:
    """Columns that a window has beside its own, the id: links carry them for both of their texts, so that no join has to find them for each link."""
    return [c for c in rows.schema.names if c not in ("key", *_WINDOW, "content", "block", "i", "j", "shingles")]


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (kind 0) to the first window of equal key and content, and these leaders (kind 1) where the key has another or may have one in the next partition."""

    def judged(rows: pa.RecordBatch, begin: np.ndarray, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        own = [*_WINDOW, *_carried(rows)]
        names = ["key", *own, *(f"lead_{c}" for c in own), "kind"]
        rid, content, every = rows.column("rid").to_numpy(), rows.column("content").to_numpy(), np.arange(len(rows))
        opens = np.zeros(len(rows), bool)
        opens[begin[:-1]] = True
        opens[1:] |= content[1:] != content[:-1]
        several = np.add.reduceat(opens, begin[:-1], dtype=np.int64) > 1
        several[0] |= first
        several[-1] |= last
        lead = np.maximum.accumulate(np.where(opens, every, 0))
        # a leader that holds the content again is linked there by the first window of another text
        foreign = rid != rid[lead]
        first_foreign = np.full(len(rows), -1)
        first_foreign[lead[foreign][::-1]] = every[foreign][::-1]
        again = every[~foreign & ~opens & (first_foreign[lead] >= 0)]
        asked = every[opens & np.repeat(several, np.diff(begin))]
        for x, y, kind in ((every[foreign], lead[foreign], 0), (first_foreign[lead[again]], again, 0), (asked, asked, 1)):
            a, b = rows.take(pa.array(x)), rows.take(pa.array(y))
            yield pa.record_batch([a.column("key"), *(a.column(c) for c in own), *(b.column(c) if kind == 0 else pa.nulls(len(b), b.column(c).type) for c in own), pa.array(np.full(len(a), kind, np.int32))], names)

    held, first = None, True
    for block in whole_groups(batches, ["key"]):
        if held is not None:
            yield from judged(*held, first, False)
            first = False
        held = block
    if held is not None:
        yield from judged(*held, first, True)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles, 16 bits of each, within RADIUS of the place of each window that is asked for."""
    names = ["key", "place", "before", "after", "block", "blocks"]
    for batch in batches:
        for rows in pieces(batch, "text", PIECE):
            g, begin, _ = shingle_sets(rows.column("text"))
            short = (g >> np.uint64(48)).astype(np.uint16)
            asked = rows.column("asked")
            asked = asked.combine_chunks() if isinstance(asked, pa.ChunkedArray) else asked
            flat = asked.flatten()
            t = np.repeat(np.arange(len(rows)), np.diff(np.asarray(asked.offsets)))
            at = begin[t] + flat.field("place").to_numpy()
            lo, hi = at - flat.field("before").to_numpy(), at + flat.field("after").to_numpy() + 1
            n = hi - lo
            ends = np.cumsum(n)
            data = short[np.arange(int(n.sum())) + np.repeat(lo - (ends - n), n)]
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate(([0], 2 * ends)).astype(np.int32)), pa.py_buffer(data)])
            yield pa.record_batch([*(rows.column(c).take(pa.array(t)) for c in ("rid", "doc_id")), *(flat.field(c) for c in names), blobs], ["rid", "doc_id", *names, "shingles"])


_WIDTH, _LEAST = 2 * RADIUS + 1, RADIUS + 1


class _Block:
    """Windows of min-hashes, laid place under place: tokens is 0 where a window has no shingle."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        self.rid, self.place, self.block = (rows.column(c).to_numpy() for c in ("rid", "place", "block"))
        before, after = (rows.column(c).to_numpy().astype(np.int64) for c in ("before", "after"))
        self.n = before + after + 1
        self.across = rows.column("i").to_numpy() != rows.column("j").to_numpy()
        blobs = rows.column("shingles")
        blobs = blobs.combine_chunks() if isinstance(blobs, pa.ChunkedArray) else blobs
        data = np.frombuffer(blobs.buffers()[2], np.uint16)
        first = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs)].astype(np.int64) // 2
        self.tokens = np.zeros((len(rows), _WIDTH), np.uint32)
        at = np.repeat(np.arange(len(rows)), self.n)
        step = np.arange(len(at)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.tokens[at, step + np.repeat(RADIUS - before, self.n)] = data[step + np.repeat(first, self.n)].astype(np.uint32) + 1
        self.low = self.place - RADIUS  # the text's shingle in the first column
        run = self.tokens * np.uint32(0x9E3779B1)
        for k in (1, 2, 4, 8):
            run = (run[:, :-k] ^ (run[:, :-k] >> np.uint32(15))) * np.uint32(0x85EBCA77) + run[:, k:]
        start = np.arange(run.shape[1])
        inside = (start >= (RADIUS - before)[:, None]) & (start + RUN <= (RADIUS + after + 1)[:, None])
        # of one and the same shingle over and over there is a run at every shift; such a passage is found place by place, so these runs are told by their columns too
        repeats = np.concatenate((np.zeros((len(rows), 1), np.int32), np.cumsum(self.tokens[:, 1:] == self.tokens[:, :-1], axis=1)), axis=1)
        over = repeats[:, RUN - 1 :] - repeats[:, : -RUN + 1] == RUN - 1
        run = np.where(over, run ^ (start.astype(np.uint32) + np.uint32(1)) * np.uint32(0xC2B2AE3D), run)
        self.runs = np.where(inside, run | np.uint32(1), np.uint32(0))
        self.key = rows.column("key").to_numpy()
        # which of BITS values the shingles have, and how many more shingles there are than values
        self.bits = np.zeros((len(rows), BITS // 64), np.uint64)
        for lo in range(0, len(rows), 2000):
            tokens = self.tokens[lo : lo + 2000]
            flags = np.zeros((len(tokens), BITS), bool)
            flags[np.arange(len(tokens))[:, None], (tokens * np.uint32(0x9E3779B1)) >> np.uint32(33 - BITS.bit_length())] = True
            flags[:, 0] = False  # that of 0, no shingle; a shingle of this value is in the excess
            self.bits[lo : lo + 2000] = np.packbits(flags, axis=1).view(np.uint64)
        self.excess = self.n - np.bitwise_count(self.bits).sum(1, dtype=np.int64)

    def may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Different texts, and of two blocks one of each."""
        return (self.rid[a] != self.rid[b]) & (~self.across[a] | (self.block[a] != self.block[b]))

    def aligned(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each pair, place by place: whether there is a passage, the columns of the longest one, and its similarity, less than 0 if it doesn't begin and end with equal shingles."""
        found, x, y, similarity = np.zeros(len(a), bool), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.zeros(len(a))
        span = (np.arange(_LEAST, _WIDTH + 1)[None, None, :] - np.arange(_WIDTH - _LEAST + 1)[None, :, None]).astype(np.int16)
        cost = round(2 * SIMILARITY / (1 - SIMILARITY))
        for lo in range(0, len(a), 2000):
            p, q = self.tokens[a[lo : lo + 2000]], self.tokens[b[lo : lo + 2000]]
            both = (p > 0) & (q > 0)
            same = both & (p == q)
            some = np.flatnonzero(same.sum(1) * (1 + SIMILARITY) >= 2 * SIMILARITY * _LEAST - 1e-9)
            if not len(some):
                continue
            sums = np.zeros((len(some), _WIDTH + 1), np.int32)
            np.cumsum(np.where(same[some], 1, np.where(both[some], -cost, -(1 << 16))), axis=1, out=sums[:, 1:])
            good = (sums[:, None, _LEAST:] >= sums[:, : _WIDTH - _LEAST + 1, None]) & (span >= _LEAST)
            tidy = same[some][:, None, _LEAST - 1 :] & same[some][:, : _WIDTH - _LEAST + 1, None]  # begins and ends with an equal shingle; only where no such stretch is long enough another is taken, and marked
            length = np.where(good, np.where(tidy, span + np.int16(128), span), np.int16(0)).reshape(len(some), -1)
            best = length.argmax(1)
            long = length[np.arange(len(some)), best] & 127
            ok = long > 0
            at, start = lo + some[ok], best[ok] // span.shape[2]
            stop = start + long[ok]
            hits = np.concatenate((np.zeros((len(some), 1), np.int32), np.cumsum(same[some], axis=1)), axis=1)[ok]
            m = hits[np.arange(len(at)), stop] - hits[np.arange(len(at)), start]
            m = m / (2 * (stop - start) - m)
            found[at], x[at], y[at], similarity[at] = True, start, stop, np.where(length[ok, best[ok]] > 128, m, -m)
        return found, x, y, similarity

    def shifted(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair, whether both have a stretch long enough with as many shingles that stand in the other, at the same place or up to SHIFT places off, as a passage takes."""
        out = np.zeros(len(a), bool)
        for lo in range(0, len(a), 2000):
            p, q = self.tokens[a[lo : lo + 2000]], self.tokens[b[lo : lo + 2000]]
            mine = (p == q) & (p > 0)
            yours = mine.copy()
            for k in range(1, SHIFT + 1):
                for x, y, u, v in ((p[:, k:], q[:, :-k], mine[:, k:], yours[:, :-k]), (p[:, :-k], q[:, k:], mine[:, :-k], yours[:, k:])):
                    same = (x == y) & (x > 0)
                    u |= same
                    v |= same
            at = np.flatnonzero(np.minimum(mine.sum(1), yours.sum(1)) >= COMMON)
            for own, tokens in ((mine, p), (yours, q)):
                at = at[self._dense(own[at], tokens[at] > 0)]
            out[lo + at] = True
        return out

    @staticmethod
    def _dense(same: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Whether a stretch of length n >= _LEAST has m of same, so that m / (n + l - m) can reach the similarity with another of length l, which is at least _LEAST and m."""
        ok = np.zeros(len(same), bool)
        long = np.arange(_LEAST, _WIDTH + 1)[None, :] - np.arange(_WIDTH - _LEAST + 1)[:, None] >= _LEAST
        sums = np.zeros((2, len(same), _WIDTH + 1), np.float32)
        for k, (hit, most) in enumerate(((1 + SIMILARITY, SIMILARITY), (1.0, SIMILARITY))):
            np.cumsum(np.where(inside, same * np.float32(hit) - np.float32(most), np.float32(-1000)), axis=1, out=sums[k, :, 1:])
        for lo in range(0, len(same), 2000):
            x = [v[lo : lo + 2000, None, _LEAST:] - v[lo : lo + 2000, : _WIDTH - _LEAST + 1, None] for v in sums]
            ok[lo : lo + 2000] = ((x[0] >= SIMILARITY * _LEAST - 0.1) & (x[1] >= -0.1) & long).any(axis=(1, 2))
        return ok

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair, whether as many shingles of each may stand in the other as a passage takes: no fewer than are told apart by their bits."""
        out = np.zeros(len(a), bool)
        for lo in range(0, len(a), 20_000):
            p, q = a[lo : lo + 20_000], b[lo : lo + 20_000]
            out[lo : lo + 20_000] = np.bitwise_count(self.bits[p] & self.bits[q]).sum(1, dtype=np.int64) + np.minimum(self.excess[p], self.excess[q]) >= COMMON
        return out

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple, np.ndarray]:
        """Which pairs hold a passage place by place; the links: window, columns, window, columns, similarity; and the pairs with shingles enough for one at other places."""
        linked, asked = np.zeros(len(a), bool), np.flatnonzero(self.common(a, b))
        a, b = a[asked], b[asked]
        found, x, y, similarity = self.aligned(a, b)
        linked[asked[found]] = True
        return linked, (a[found], x[found], y[found], b[found], x[found], y[found], similarity[found]), np.stack((a[~found], b[~found]))

    def unlike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs that surely hold no passage. Where no shingle stands twice in a window and those of both follow one another alike, the shared ones of two stretches are all from one to another,
        and the stretches are no shorter than what these span: so all such spans are tried."""
        out = np.zeros(len(a), bool)
        column, span = np.arange(_WIDTH, dtype=np.int16), _WIDTH - COMMON + 1
        for lo in range(0, len(a), 500):
            p, q = self.tokens[a[lo : lo + 500]], self.tokens[b[lo : lo + 500]]
            plain = np.ones(len(p), bool)
            for tokens in (p, q):
                ordered = np.sort(tokens, axis=1)
                plain &= ~((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] > 0)).any(1)
            same = (p[:, :, None] == q[:, None, :]) & (p > 0)[:, :, None]
            shared, place = same.any(2), same.argmax(2).astype(np.int16)
            reach = np.maximum.accumulate(np.where(shared, place, np.int16(-1)), axis=1)
            plain &= ~(shared[:, 1:] & (place[:, 1:] <= reach[:, :-1])).any(1)
            at = np.flatnonzero(plain)
            shared, place = shared[at], place[at]
            count = np.cumsum(shared, axis=1, dtype=np.int16)
            x, y = slice(0, span), slice(_WIDTH - span, _WIDTH)
            both = count[:, None, y] - count[:, x, None] + np.int16(1)
            long = np.maximum(column[None, y] - column[x, None] + np.int16(1), np.int16(_LEAST))
            other = np.maximum(place[:, None, y] - place[:, x, None] + np.int16(1), np.int16(_LEAST))
            good = (both * np.float32(1 + SIMILARITY) >= (long[None] + other) * np.float32(SIMILARITY) - np.float32(0.01)) & shared[:, None, y] & shared[:, x, None]
            out[lo + at] = ~good.any(axis=(1, 2))
        return out

    def edited(self, linked: list[tuple], left: np.ndarray) -> list[tuple]:
        """Links of pairs of windows with shifted shingles, of texts that have no link under the min-hash yet."""
        left = left[:, self.shifted(*left)]
        left = left[:, ~self.unlike(*left)]
        name = lambda i, j: (int(self.key[i]), min(int(self.rid[i]), int(self.rid[j])), max(int(self.rid[i]), int(self.rid[j])))
        known, out = {name(i, j) for part in linked for i, j in zip(part[0].tolist(), part[3].tolist(), strict=True)}, []
        for i, j in left.T.tolist():
            if (pair := name(i, j)) in known:
                continue
            p, q = np.flatnonzero(self.tokens[i]), np.flatnonzero(self.tokens[j])
            if passages := _passages(self.tokens[i][p], self.tokens[j][q], _LEAST):
                known.add(pair)
                a0, a1, b0, b1, value = map(np.array, zip(*passages, strict=True))
                out.append((np.full(len(a0), i), p[0] + a0, p[0] + a1, np.full(len(a0), j), q[0] + b0, q[0] + b1, value))
        return out

    def rest(self, lo: int, hi: int, alone: np.ndarray) -> list[tuple]:
        """Links, and pairs that may have shifted shingles, of the windows `alone` of one min-hash (lo to hi) with all its others: an index of the runs tells which may hold a passage in common. Of each tree
        of windows that links join already one window is linked."""
        out, n = [], hi - lo
        owner, column = np.nonzero(self.runs[lo:hi])
        run = self.runs[lo:hi][owner, column]
        order = np.argsort(run, kind="stable")
        run, owner = run[order], owner[order]
        if not len(run):
            return out
        new = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        several = np.maximum.reduceat(owner, new) != np.minimum.reduceat(owner, new)
        use = np.repeat(several, np.diff(np.append(new, len(run))))
        run, owner = run[use], owner[use]
        enough = np.bincount(owner, minlength=n) >= SHARED
        tree = np.zeros(n, np.int64)  # windows that links join; those that are linked to the first are one tree
        tree[alone - lo] = alone - lo
        for a in (alone - lo)[enough[alone - lo]].tolist():
            mine = np.unique(self.runs[lo + a])
            first, last = np.searchsorted(run, mine), np.searchsorted(run, mine, side="right")
            size = last - first
            hits = owner[np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)]
            near = np.flatnonzero((np.bincount(hits, minlength=n) >= SHARED) & (tree != tree[a]))
            near = near[self.may(np.full(len(near), lo + a), lo + near)]
            if not len(near):
                continue
            _, links, left = self.links(np.full(len(near), lo + a), lo + near)
            trees, one = np.unique(tree[links[3] - lo], return_index=True)
            tree[np.isin(tree, trees)] = tree[a]
            out.append((tuple(c[one] for c in links), left))
        return [(links, left[:, tree[left[0] - lo] != tree[left[1] - lo]]) for links, left in out]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the windows of a min-hash, of one block or of two: of all with the first, and of those that have none with it with all others."""
    for rows, begin in whole_groups(batches, ["key", "i", "j"]):
        block, size = _Block(rows), np.diff(begin)
        lead = np.repeat(begin[:-1], size)
        every = np.arange(len(rows))
        ask = every[(every != lead) & block.may(lead, every)]
        linked, *first = block.links(lead[ask], ask)
        found = [first]
        alone = every != lead
        alone[ask[linked]] = False
        pairs = []
        for g in np.flatnonzero(np.add.reduceat(alone, begin[:-1]) * (size > 2)).tolist():
            lo, hi = int(begin[g]), int(begin[g + 1])
            own = lo + np.flatnonzero(alone[lo:hi])
            if hi - lo <= FEW:
                x, y = np.repeat(own, hi - lo - 1), np.tile(np.arange(lo + 1, hi), len(own))
                pairs.append(np.stack((x, y))[:, (x < y) | ~alone[y]])
            else:
                found += block.rest(lo, hi, own)
        if pairs:
            x, y = np.concatenate(pairs, axis=1)
            may = (x != y) & block.may(x, y)
            found.append(block.links(x[may], y[may])[1:])
        out = [links for links, _ in found]
        out += block.edited(out, np.concatenate([left for _, left in found], axis=1))
        a, a0, a1, b, b0, b1, similarity = (np.concatenate(c) for c in zip(*out, strict=True))
        rid, low = block.rid, block.low
        swap = rid[a] > rid[b]
        one, two = (a, low[a] + a0, low[a] + a1 - 1), (b, low[b] + b0, low[b] + b1 - 1)
        columns = [np.where(swap, one[k], two[k]) for k in range(3)] + [np.where(swap, two[k], one[k]) for k in range(3)]
        kinds = {"rid": pa.int64(), "lead_rid": pa.int64()}
        arrays = [pa.array(rid[c] if name in kinds else c, kinds.get(name, pa.int32())) for name, c in zip(_NAMES, columns, strict=False)]
        more = {f"{side}{c}": rows.column(c).take(pa.array(at)) for side, at in (("", np.where(swap, a, b)), ("lead_", np.where(swap, b, a))) for c in _carried(rows)}
        yield pa.record_batch([*arrays, pa.array(similarity, pa.float64()), *more.values()], [*_NAMES, *more])


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Interval join of the passages of a pair of texts and a diagonal: overlapping ones become one, of their least similarity, from the first to the last equal shingle."""
    for rows, _ in whole_groups(batches, ["lead_rid", "rid"]):
        pair = [rows.column(c).to_numpy() for c in ("lead_rid", "rid", "diagonal")]
        differs = [np.concatenate(([True], c[1:] != c[:-1])) for c in pair]
        group = np.cumsum(np.logical_or.reduce(differs)) - 1
        start, stop, lead_stop = (rows.column(c).to_numpy().astype(np.int64) for c in ("start", "stop", "lead_stop"))
        order = np.lexsort((start, group))
        group, start, stop, lead_stop, similarity = group[order], start[order], stop[order], lead_stop[order], rows.column("similarity").to_numpy()[order]
        big = int(stop.max()) + 2
        reach = np.maximum.accumulate(stop + group * big)
        new = np.ones(len(group), bool)
        new[1:] = (start[1:] + group[1:] * big) > reach[:-1]
        at = np.flatnonzero(new)
        tidy = similarity > 0
        tidy |= ~np.repeat(np.logical_or.reduceat(tidy, at), np.diff(np.append(at, len(tidy))))
        start = np.minimum.reduceat(np.where(tidy, start, big), at)
        stop, lead_stop = (np.maximum.reduceat(np.where(tidy, x, -1), at) for x in (stop, lead_stop))
        similarity = np.minimum.reduceat(np.abs(similarity), at)
        at = order[at]
        lead_rid, rid, lead_start = pair[0][at], pair[1][at], start - pair[2][at]
        keep = _bridged(np.cumsum(differs[0] | differs[1])[at], start, stop, lead_start, lead_stop, similarity)
        more = {c: rows.column(c).take(pa.array(at[keep])) for c in rows.schema.names if c not in (*_NAMES, "diagonal")}
        yield pa.record_batch([*(pa.array(c[keep]) for c in (rid, start, stop, lead_rid, lead_start, lead_stop, similarity)), *more.values()], [*_NAMES, *more])


def _bridged(pair: np.ndarray, start: np.ndarray, stop: np.ndarray, lead_start: np.ndarray, lead_stop: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """The passages that are left when each takes in those that overlap it by half in both texts, or follow it in both; the arrays are changed."""
    order = np.lexsort((start, pair))
    keep = np.ones(len(order), bool)
    near = pair[order[1:]] == pair[order[:-1]]
    shared = 2 * similarity / (1 + similarity) * (stop - start + 1)
    into = -1
    for k in np.flatnonzero(near).tolist():
        a, b = order[k], order[k + 1]
        a = into if into >= 0 and pair[into] == pair[b] and not keep[a] else a
        own, lead = min(stop[a], stop[b]) - start[b] + 1, min(lead_stop[a], lead_stop[b]) - max(lead_start[a], lead_start[b]) + 1
        if 2 * own >= min(stop[a] - start[a], stop[b] - start[b]) + 1 and 2 * lead >= min(lead_stop[a] - lead_start[a], lead_stop[b] - lead_start[b]) + 1:
            # on another diagonal, as of a line over and over: each shingle is in a passage of both texts
            stop[a], lead_start[a], lead_stop[a] = max(stop[a], stop[b]), min(lead_start[a], lead_start[b]), max(lead_stop[a], lead_stop[b])
            similarity[a], keep[b], into = min(similarity[a], similarity[b]), False, a
            shared[a] = 2 * similarity[a] / (1 + similarity[a]) * (stop[a] - start[a] + 1)
            continue
        if lead_start[b] < lead_start[a]:
            continue
        over = max(0, stop[a] - start[b] + 1, lead_stop[a] - lead_start[b] + 1)
        both = shared[a] + max(0, shared[b] - over)
        end, lead_end = max(stop[a], stop[b]), max(lead_stop[a], lead_stop[b])
        value = both / (end - start[a] + 1 + lead_end - lead_start[a] + 1 - both)
        if value >= SIMILARITY:
            stop[a], lead_stop[a], shared[a], similarity[a], keep[b], into = end, lead_end, both, min(value, 1.0), False, a
    return keep


def _agreeing(inside: np.ndarray, cost: int) -> tuple[int, int]:
    """The stretch with the greatest sum, where a shingle that the other text has adds 1 and another takes `cost`."""
    sums = np.concatenate(([0], np.cumsum(np.where(inside, 1, -cost))))
    lows = np.minimum.accumulate(sums)
    stop = int(np.argmax(sums - lows))
    start = int(np.flatnonzero(sums[: stop + 1] == lows[stop])[-1])
    return start, stop


def _passage(a: np.ndarray, b: np.ndarray, length: int) -> tuple[int, int, int, int, float] | None:
    """Start and stop in a and in b, and the similarity, of a passage that is similar enough. A low cost bridges edits that stand together; a similarity of 0.8 needs 8 of 9, which
    the highest cost makes sure of."""
    # both stretches lie on one diagonal: often they agree place by place to the ends, which is found without looking shingles up
    exact = None
    if len(a) == len(b):
        start, stop = _agreeing(a == b, 8)
        if stop - start >= length and (similarity := _jaccard(a[start:stop], b[start:stop])) >= SIMILARITY:
            exact = start, stop, start, stop, similarity
            if stop - start == len(a):
                return exact
    in_b = (a[:, None] == b).any(1)
    if in_b.sum() < length * SIMILARITY:
        return exact
    for cost in (4, 6, 8):
        a0, a1 = _agreeing(in_b, cost)
        if a1 - a0 < length:
            continue
        b0, b1 = _agreeing((b[:, None] == a[a0:a1]).any(1), cost)
        if b1 - b0 < length:
            continue
        if (similarity := _jaccard(a[a0:a1], b[b0:b1])) >= SIMILARITY:
            return exact if exact and exact[1] - exact[0] > a1 - a0 else (a0, a1, b0, b1, similarity)
    return exact or _between(a, b, length)


def _between(a: np.ndarray, b: np.ndarray, length: int) -> tuple[int, int, int, int, float] | None:
    """The longest passage from one shared shingle to another, all such pairs tried; where it is too short, it takes in what stands beside it. (An edit near an end costs the trimming above more
    than the shingles beyond it bring, but a passage of least length needs these.)"""
    at = {}
    for j, v in enumerate(b.tolist()):
        at.setdefault(v, []).append(j)
    first = [(i, at[v].pop(0)) for i, v in enumerate(a.tolist()) if at.get(v)]
    every = np.array(first, np.int64).reshape(-1, 2)
    step = np.diff(every, axis=0)
    beside = np.concatenate(([False], (step == 1).all(1), [False]))
    best = None
    for x, y in (every.T, every[beside[1:] | beside[:-1]].T):  # once without shingles that stand alone, which may be equal by chance
        n, least = len(x), math.ceil(2 * SIMILARITY * length / (1 + SIMILARITY) - 1e-9)
        if n < least:
            continue
        i, j = np.arange(n - least + 1)[:, None], np.arange(n)  # so many are shared at least, so no span begins later or ends before
        low = np.minimum.accumulate(np.where(j >= i, y, len(b)), axis=1)[:, least - 1 :]
        high = np.maximum.accumulate(np.where(j >= i, y, -1), axis=1)[:, least - 1 :]
        j = j[least - 1 :]
        long, other = np.maximum(x[j] - x[i] + 1, length), np.maximum(high - low + 1, length)
        both = j - i + 1
        good = both * (1 + SIMILARITY) >= SIMILARITY * (long + other) - 1e-9
        if not good.any():
            continue
        score = np.where(good, (long + other) * 256 + both, 0)
        for _ in range(min(8, int(good.sum()))):
            i, j = divmod(int(score.argmax()), score.shape[1])
            score[i, j] = 0
            a0, b0 = min(int(x[i]), len(a) - int(long[i, j])), min(int(low[i, j]), len(b) - int(other[i, j]))
            a1, b1 = a0 + int(long[i, j]), b0 + int(other[i, j])
            if min(a0, b0) >= 0 and (similarity := _jaccard(a[a0:a1], b[b0:b1])) >= SIMILARITY and (best is None or a1 - a0 + b1 - b0 > best[1] - best[0] + best[3] - best[2]):
                best = a0, a1, b0, b1, similarity
                break
    return best


def _passages(a: np.ndarray, b: np.ndarray, length: int) -> list[tuple[int, int, int, int, float]]:
    """All passages of two stretches: after one is found, what is left of both on either side is searched again."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a_lo, a_hi, b_lo, b_hi = todo.pop()
        if min(a_hi - a_lo, b_hi - b_lo) < length:
            continue
        if found := _passage(a[a_lo:a_hi], b[b_lo:b_hi], length):
            a0, a1, b0, b1, similarity = found
            out.append((a_lo + a0, a_lo + a1, b_lo + b0, b_lo + b1, similarity))
            todo += [(a_lo + a1, a_hi, b_lo + b1, b_hi), (a_lo, a_lo + a0, b_lo, b_lo + b0)]
    return out


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    s, t = set(a.tolist()), set(b.tolist())
    both = len(s & t)
    return both / (len(s) + len(t) - both)


def _copies(rows: DataFrame) -> DataFrame:
    """rid of every row whose text another row of lesser id has, and that row's rid and id as lead_rid and other_id."""
    named = rows.select("rid", "doc_id", F.xxhash64(F.lit(809), "text").alias("t1"), F.xxhash64("text", F.lit(810)).alias("t2")).distinct()
    groups = named.groupBy("t1", "t2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return pinned(named.join(groups, ["t1", "t2"]).where(F.col("rid") != F.col("m.rid")).select("rid", F.col("m.rid").alias("lead_rid"), F.col("m.doc_id").alias("other_id")))


def _long_enough(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """rid, doc_id and text of the rows whose texts have the bytes of MIN_WORDS words."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), _row_name(text_col, id_col).alias("rid")).where(F.octet_length("text") >= 2 * MIN_WORDS - 1)


def _row_name(text_col: str, id_col: str) -> Column:
    return F.xxhash64(F.lit(808), F.col(id_col), F.col(id_col).isNull(), F.col(text_col).cast("string"))


def _whole(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows that copies names, with the words of their texts as n, where these are enough."""
    return rows.join(small(copies, copies.count(), 48), "rid").dropDuplicates(["rid"]).withColumn("n", F.regexp_count(F.lower("text"), F.lit(WORD)).cast("long")).where(F.col("n") >= MIN_WORDS).drop("text")


def _united(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """The links of the texts of rows, without those of copies: text and leader by rid, where the passage starts and stops in each by shingles, the similarity, and both ids."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    again = copies.select(F.col("rid").alias("__again"))
    single = rows.join(small(again, again.count(), 24), F.col("rid") == F.col("__again"), "left_anti")
    windows = single.select("rid", "doc_id", "text").mapInArrow(_window_records, "key long, rid long, doc_id long, content long, place int, before byte, after byte")
    order = ["key", "content", "rid", "place"]
    found = stored(windows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_lead, _RECORD))
    # a min-hash of leaders from several texts: the leaders' shingles are cut from the texts and compared in blocks
    leaders = found.where("kind = 1").select("key", *_WINDOW)
    keys = pinned(leaders.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("low"), F.max("rid").alias("high")).where("low != high").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    leaders = leaders.join(keys, "key").withColumn("block", F.pmod(F.xxhash64("rid", "place"), "blocks"))
    # as many as a text has words, so a row is bounded by its text
    wanted = leaders.groupBy("rid").agg(F.collect_list(F.struct("key", "place", "before", "after", "block", "blocks")).alias("asked"))
    wanted = stored(wanted)
    # only texts that are asked for are moved, if their names are few enough to be sent to the rows
    names = wanted.select("rid")
    n_names = names.count()
    moved = single.select("rid", "doc_id", "text")
    moved = moved.join(F.broadcast(names), "rid", "left_semi") if n_names * 24 <= BROADCAST_BYTES else moved
    inside = moved.dropDuplicates(["rid"]).join(wanted, "rid").select("rid", "doc_id", "text", "asked").mapInArrow(_contents, "rid long, doc_id long, key long, place int, before byte, after byte, block long, blocks long, shingles binary")
    paired = inside.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o")).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")}).drop("o", "blocks")
    near = paired.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "rid", "place").mapInArrow(_compare, _LINK)
    own, lead = F.col("place"), F.col("lead_place")
    exact = found.where("kind = 0").select("rid", (own - F.col("before")).alias("start"), (own + F.col("after")).alias("stop"), "lead_rid", (lead - F.col("lead_before")).alias("lead_start"), (lead + F.col("lead_after")).alias("lead_stop"), F.lit(1.0).alias("similarity"), "doc_id", "lead_doc_id")
    links = exact.union(near).withColumn("diagonal", F.col("start") - F.col("lead_start"))
    return links.repartition(n, "lead_rid", "rid").sortWithinPartitions("lead_rid", "rid", "diagonal").mapInArrow(_unite, f"rid long, start long, stop long, lead_rid long, lead_start long, lead_stop long, similarity double, {_IDS}")


def repeated_passages(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Links of passages of at least MIN_WORDS words and SIMILARITY: doc_id, other_id (the text that leads), where the passage starts in each and how many words
    it has, in words of letters and digits, and the Jaccard similarity of the two passages' five-word shingles (of a united passage the least of its parts', or what they share of the whole).

    Every text with such a passage elsewhere is in some link; texts that share one are linked to the same or to linked leaders. Passages within one
    text are no links. A null, empty or shorter text has none; very long ones are scanned whole, one at a time; only the id and the text are read, so other columns don't clash. Null ids are
    given out as null. Rows equal in id and text are one text. An empty table gives no rows.
    """
    rows = _long_enough(docs, text_col, id_col)
    copies = _copies(rows)
    united = _united(rows, copies)
    n_words = lambda a, b: F.col(b) - F.col(a) + SHINGLE
    passages = united.select("doc_id", F.col("lead_doc_id").alias("other_id"), F.col("start").alias("start_word"), n_words("start", "stop").alias("n_words"), F.col("lead_start").alias("other_start_word"), n_words("lead_start", "lead_stop").alias("other_n_words"), "similarity")
    whole = _whole(rows, copies)
    zero = F.lit(0).cast("long")
    return passages.union(whole.select("doc_id", "other_id", zero, "n", zero, "n", F.lit(1.0)))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each text that its passages cover, overlapping and adjoining ones as one, in words."""
    for rows, begin in whole_groups(batches, ["rid"]):
        rid, start, stop = (rows.column(c).to_numpy() for c in ("rid", "start", "stop"))
        group = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        stop = stop + SHINGLE  # behind the last word
        big = int(stop.max()) + 1
        reach = np.maximum.accumulate(stop + group * big)
        new = np.ones(len(rid), bool)
        new[1:] = (group[1:] != group[:-1]) | (start[1:] + group[1:] * big > reach[:-1])
        at = np.flatnonzero(new)
        words = np.maximum.reduceat(stop, at) - start[at]
        first = np.concatenate((np.searchsorted(group[at], np.arange(len(begin) - 1)), [len(at)]))
        spans = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(start[at]), pa.array(words)], ["start_word", "n_words"]))
        yield pa.record_batch([pa.array(rid[begin[:-1]]), spans], ["rid", "passages"])


_SPANS = "array<struct<start_word:bigint,n_words:bigint>>"


def passage_classes(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least id of the texts that passages join, directly or through others), n_passages, n_repeated (words in passages) and passages: the stretches of
    the text, in words of letters and digits, that are covered by passages of a link, united where they overlap or adjoin.

    Two texts with a passage of at least MIN_WORDS words and SIMILARITY in common are of one class, since each min-hash joins all its windows that hold one by a tree of links; the passages are
    those of the trees' links, which may end before one that a text shares with another than it is linked to. A row without a passage elsewhere is a class of its own. A text of MIN_WORDS words or
    more that another row has too is one whole passage. Null ids come after all others, and a class of null ids has a null class_id. Null, empty and shorter texts have no passage; very long ones
    are scanned whole, one at a time. Only the id and the text are read, so other columns don't clash. Rows equal in id and text are one text, and each is given. An empty table gives no rows.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _long_enough(docs, text_col, id_col)
    copies = _copies(rows)
    names = ["rid", "start", "stop", "lead_rid", "lead_start", "lead_stop"]
    united = stored(_united(rows, copies).select(*names))
    labels = components(united.select(F.col("rid").alias("a"), F.col("lead_rid").alias("b")).distinct())
    sides = united.select("rid", "start", "stop").union(united.select(*names[3:])).distinct()
    spans = sides.repartition(n, "rid").sortWithinPartitions("rid", "start").mapInArrow(_spans, f"rid long, passages {_SPANS}")
    tops = copies.select("rid", "lead_rid").union(copies.select("lead_rid", "lead_rid").distinct())
    whole = pinned(_whole(rows.select("rid", "text"), tops))
    alike = whole.join(labels.withColumnRenamed("node", "lead_rid"), "lead_rid", "left").select("rid", F.coalesce("component", "lead_rid").alias("component"), F.array(F.struct(F.lit(0).cast("long").alias("start_word"), F.col("n").alias("n_words"))).cast(_SPANS).alias("passages"))
    others = labels.withColumnRenamed("node", "rid").join(spans, "rid").join(whole.select("rid"), "rid", "left_anti").select("rid", "component", "passages")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), _row_name(text_col, id_col).alias("rid"))
    told = stored(own.join(alike.union(others), "rid", "left"))
    least = pinned(told.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("class_id"), F.lit(True).alias("joined")))
    out = told.withColumn("component", F.coalesce("component", "rid")).join(small(least, least.count(), 32), "component", "left")
    out = out.withColumn("passages", F.coalesce("passages", F.array().cast(_SPANS)))
    counted = F.aggregate("passages", F.lit(0).cast("long"), lambda x, y: x + y["n_words"])
    return out.select("doc_id", F.when(F.col("joined"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.size("passages").cast("long").alias("n_passages"), counted.alias("n_repeated"), "passages")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
