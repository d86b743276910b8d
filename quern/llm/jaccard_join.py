"""N-gram Jaccard join (5): the chosen-path join over sets of five-word shingles, similarity 0.8 or more.

Texts of equal words are one class from the start, so copies are never paired. Each class has COORDINATES min-hash tokens of its shingle set. A
run starts with all classes in one node; a node picks coordinates by a hash of its own name, 1 / similarity of them in expectation, and sends each of its
classes to the children named by the token there: a shared token keeps two similar sets together. Nodes of at most SMALL classes are compared pair by pair on their
tokens; larger ones split again. From DEPTH on, a large node's members are linked to its least member, its leader, where they are similar to it. If at most MANY are not,
or at LAST, these are compared with all members in blocks of MANY, once for all nodes of one leader, so that every pair is looked at and no task holds all rows; a node with
more of them splits again.
RUNS runs are made side by side; by RUNS >= log(1 - recall) / log(1 - success) for the target recall.

Tokens only propose. The proposed links' components are then compared exactly, all pairs of a component in blocks of BLOCK classes, on the whole shingle sets:
that gives every link of similarity >= 0.8 inside, the classes' link counts, and the final classes.
Nothing is collected; all that is broadcast is the names of large nodes, behind a size check.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import pinned, small, stored, table, without
from .streams import whole_groups
from .textscan import ALNUM, grams, mix, pieces, raw, word_hashes, words

SIMILARITY, SHINGLE = 0.8, 5
COORDINATES = 64
SMALL, DEPTH, LAST, MANY, BLOCK = 64, 2, 12, 4096, 512
#: Target recall, and the share of similar pairs that one run is sure to bring into a small node.
RECALL, SUCCESS = 0.99, 0.25
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - SUCCESS))
#: Shared tokens from which a pair is proposed: three deviations below the similarity.
PROPOSED = math.floor(COORDINATES * (SIMILARITY - 3 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDINATES)))

_STEPS = np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, where each text's begin, and a 128-bit name of each text's word sequence (two columns).

    A text of fewer than SHINGLE words, but not none, has one shingle: all of it.
    """
    buf, off = raw(col)
    start, end, first = words(buf, off, ALNUM)
    h = word_hashes(buf, start, end, lower=True)
    n = np.diff(first)
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(first[:-1], n).astype(np.uint64)
    names = np.zeros((len(n), 2), np.uint64)
    for i, c in enumerate((0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(h ^ mix((place + np.uint64(1)) * np.uint64(c))))))
        names[:, i] = mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64))
    g, begin = grams(h, first, SHINGLE)
    short = (n > 0) & (n < SHINGLE)
    if short.any():
        g = np.insert(g, begin[:-1][short], names[short, 0])
        begin = begin + np.concatenate(([0], np.cumsum(short)))
    return g, begin, names


def signatures(g: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """COORDINATES least hashes of each set that is not empty."""
    out = np.zeros((len(begin) - 1, COORDINATES), np.uint32)
    full = np.diff(begin) > 0
    at = begin[:-1][full]
    if len(at):
        for j, seed in enumerate(_SEEDS):
            out[full, j] = np.minimum.reduceat((((g ^ seed) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32), at)
    return out


def _fixed(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(values)
    width = rows.shape[1] * rows.itemsize
    return pa.array([rows[i].tobytes() for i in range(len(rows))], pa.binary()) if len(rows) else pa.array([], pa.binary()) if width else pa.array([b""] * len(rows))


def _sign(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, "__text"):
                g, begin, names = shingle_sets(rows.column("__text"))
                full = pa.array(np.diff(begin) > 0)
                null = pa.scalar(None, pa.binary())
                yield pa.record_batch([*(rows.column(c) for c in keep), pc.if_else(full, _fixed(names), null), pc.if_else(full, _fixed(signatures(g, begin)), null)], [*keep, "__rep", "__sig"])

    return run


def _child_nodes(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a node and its tokens: the children it goes to, as (row, child)."""
    rows, children = [], []
    for j in range(COORDINATES):
        pick = mix(node + _STEPS[j : j + 1])
        chosen = np.flatnonzero(pick < np.uint64(int((1 << 64) / (SIMILARITY * COORDINATES))))
        rows.append(chosen)
        children.append(mix(pick[chosen] + mix(sig[chosen, j].astype(np.uint64) + np.uint64(7))))
    return np.concatenate(rows), np.concatenate(children)


def _tokens(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        sig, reps = _tokens(batch.column("__sig")), batch.column("__rep")
        for r in range(RUNS):
            rows, child = _child_nodes(np.full(len(sig), mix(np.array([r + 1], np.uint64))[0]), sig)
            yield pa.record_batch([pa.array(child.view(np.int64)), reps.take(pa.array(rows))], ["node", "__rep"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        rows, child = _child_nodes(batch.column("node").to_numpy().view(np.uint64), _tokens(batch.column("__sig")))
        yield pa.record_batch([pa.array(child.view(np.int64)), batch.column("__rep").take(pa.array(rows))], ["node", "__rep"])


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each member of a large node shares enough tokens with the node's least member."""
    for batch in batches:
        if not len(batch):
            continue
        near = (_tokens(batch.column("__sig")) == _tokens(batch.column("lead_sig"))).sum(1) >= PROPOSED
        yield pa.record_batch([batch.column("lead"), batch.column("__rep"), pa.array(near)], ["lead", "__rep", "near"])


def _forest(sig: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join all rows with enough equal tokens, directly or through others, one fewer than members a tree. A row is compared with those that no tree has yet."""
    left, out = np.arange(len(sig)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            a = todo.pop()
            near = np.count_nonzero(sig[left] == sig[a], axis=1) >= PROPOSED
            found = left[near].tolist()
            left = left[~near]
            out += [(a, b) for b in found]
            todo += found
    return out


def _tree(similar: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what a symmetric matrix joins, one fewer than members a component."""
    n = len(similar)
    seen, out = np.zeros(n, bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        todo = [root]
        while todo:
            a = todo.pop()
            for b in np.flatnonzero(similar[a] & ~seen):
                seen[b] = True
                out.append((a, int(b)))
                todo.append(int(b))
    return out


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within small nodes: those of a spanning forest over the pairs with enough shared tokens, from the least member first, so that nodes that hold
    the same texts give the same links."""
    for rows, begin in whole_groups(batches, ["node"]):
        sig, reps = _tokens(rows.column("__sig")), rows.column("__rep")
        leader = np.repeat(begin[:-1], np.diff(begin))
        near = (sig == sig[leader]).sum(1) >= PROPOSED
        a, b = [leader[near]], [np.flatnonzero(near)]
        missed = np.add.reduceat(~near, begin[:-1])
        for i in np.flatnonzero((missed > 1) | ((missed > 0) & (np.diff(begin) > 2))):
            tree = np.array(_forest(sig[begin[i] : begin[i + 1]]), dtype=np.int64).reshape(-1, 2) + begin[i]
            a.append(tree[:, 0])
            b.append(tree[:, 1])
        a, b = np.concatenate(a), np.concatenate(b)
        loop = a != b
        yield pa.record_batch([reps.take(pa.array(a[loop])), reps.take(pa.array(b[loop]))], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in pieces(batch, "__text"):
            g, begin, names = shingle_sets(rows.column("__text"))
            sets = [np.unique(g[a:b]).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            same = pc.equal(_fixed(names), rows.column("__rep"))
            out = pa.record_batch([rows.column("component"), rows.column("__rep"), pa.array(sets, pa.binary())], ["component", "__rep", "set"])
            yield out.filter(same)


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections, by products of the members' incidence matrices over stretches of the shared shingles."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    use = times[at] > 1
    owner, column = owner[use], shared[at[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, width = int((times > 1).sum()), max(256, (4 << 20) // max(n, 1))
    out = np.zeros((n, n))
    for lo in range(0, total, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((n, min(width, total - lo)), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def _verify(similarity: float):
    share = Fraction(similarity).limit_denominator(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in whole_groups(batches, ["component", "i", "j"]):
            reps, blobs = rows.column("__rep").to_pylist(), rows.column("set").to_pylist()
            own, i, j = (rows.column(c).to_numpy() for c in ("block", "i", "j"))
            a, b, links = [], [], []
            for lo, hi in zip(begin[:-1], begin[1:], strict=True):
                if hi - lo < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in blobs[lo:hi]]
                if hi - lo == 2:
                    both = len(np.intersect1d(*sets, assume_unique=True))
                    inter = np.array([[len(sets[0]), both], [both, len(sets[1])]], float)
                else:
                    inter = _intersections(sets)
                size = np.diag(inter)
                near = inter * share.denominator >= share.numerator * (size[:, None] + size[None, :] - inter)  # whole numbers, below 2**53
                np.fill_diagonal(near, False)
                if i[lo] != j[lo]:
                    near &= own[lo:hi][:, None] != own[lo:hi][None, :]
                for k, n in enumerate(near.sum(1)):
                    if n:
                        a.append(reps[lo + k]), b.append(None), links.append(int(n))
                for x, y in _tree(near):
                    a.append(reps[lo + x]), b.append(reps[lo + y]), links.append(0)
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], ["a", "b", "links"])

    return run


def _grouped(df: DataFrame, *keys: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, "__rep")


def propose_links(reps: DataFrame) -> DataFrame:
    """a and b of proposed links among reps(__rep, __sig)."""
    rows = stored(reps.mapInArrow(_roots, "node long, __rep binary"))
    edges, depth = None, 1
    while True:
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        large = pinned(counts.where(F.col("n") > SMALL))
        n_large = large.count()
        named = small(large, n_large, 32)
        few = rows.join(named, "node", "left_anti") if n_large else rows
        few = few.join(counts.where(F.col("n") <= SMALL).select("node"), "node")
        many = rows.join(named, "node").join(reps, "__rep") if n_large else None
        led = None
        if n_large and depth >= DEPTH:
            lead = many.groupBy("node").agg(F.min(F.struct("__rep", "__sig")).alias("m")).select("node", F.col("m.__rep").alias("lead"), F.col("m.__sig").alias("lead_sig"))
            lead = pinned(lead)
            # many nodes have the same leader and much the same members: each is compared with it once
            members = many.join(small(lead, n_large, 400), "node").select("lead", "__rep", "__sig", "lead_sig").dropDuplicates(["lead", "__rep"])
            led = stored(members.mapInArrow(_led, "lead binary, __rep binary, near boolean"))
            far = pinned(led.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("near")).alias("far")).where("far > 0"))
            ends = far if depth >= LAST else far.where(F.col("far") <= MANY)
            # every member that is not similar to the leader meets all members, block by block
            last = led.join(small(ends, n_large, 64), "lead").withColumns({"cs": F.ceil(F.col("far") / MANY), "ks": F.ceil(F.col("n") / MANY)})
            every = last.select("lead", "__rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cs") - 1)).alias("c"), F.pmod(F.xxhash64("lead", "__rep"), "ks").alias("k"))
            apart = last.where("not near").select("lead", "__rep", F.pmod(F.xxhash64("__rep", "lead"), "cs").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ks") - 1)).alias("k"))
            few = few.union(every.union(apart).select(F.xxhash64("lead", "c", "k").alias("node"), "__rep").distinct())
            more = far.where(F.col("far") > MANY) if depth < LAST else far.limit(0)
            more = pinned(lead.join(more, "lead").select("node"))
            n_large = more.count()
            many = many.join(small(more, n_large, 24), "node") if n_large else None
        links = _grouped(few.join(reps, "__rep").select("node", "__rep", "__sig"), "node").mapInArrow(_propose, "a binary, b binary").distinct()
        if led is not None:
            links = links.union(led.where("near and __rep != lead").select(F.col("lead").alias("a"), F.col("__rep").alias("b")).distinct())
        edges = stored(links) if edges is None else edges.union(stored(links))
        if not n_large:
            return edges.distinct()
        rows = stored(many.select("node", "__rep", "__sig").mapInArrow(_split, "node long, __rep binary"))
        depth += 1


def join_near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY, keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, by default all) with class_id (the least id of the texts that links of similarity or more join, directly or through others),
    n_links (how many other word sequences the row's own links to), n_copies (rows of the same words, this one too) and is_first
    (true for exactly one row of each class, one of least id).

    Texts without words, null ones too, are classes of their own row. Null ids come after all others, and a class of null ids has a null class_id.
    Repeated rows are copies. Columns of the output's names are replaced.
    """
    docs = without(docs, *(c for c in ("class_id", "n_links", "n_copies", "is_first") if c not in (text_col, id_col)))
    keep = [c for c in docs.columns if keep is None or c in keep]
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text")).withColumn("__th", F.xxhash64(F.lit(505), "__text"))
    signed = stored(base.mapInArrow(_sign(["__id", "__th"]), "__id long, __th long, __rep binary, __sig binary"))
    # a class is known by the row of least id, and that by id and text, as ids may be null or repeat
    least_row = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__th").alias("th")))
    reps = signed.where("__rep is not null").groupBy("__rep").agg(least_row.alias("m"), F.count(F.lit(1)).alias("n_copies"), F.first("__sig").alias("__sig"))
    reps = stored(reps.select("__rep", F.col("m.id").alias("__first"), F.col("m.th").alias("__text_hash"), "n_copies", "__sig"))
    proposed = propose_links(reps.select("__rep", "__sig"))
    groups = components(proposed)

    members = groups.select(F.col("node").alias("__rep"), "component").join(reps.select("__rep", "__first", "__text_hash"), "__rep")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    sets = base.join(members, (F.col("__th") == F.col("__text_hash")) & F.col("__id").eqNullSafe(F.col("__first"))).select("component", "__rep", "__text").mapInArrow(_sets, "component binary, __rep binary, set binary").dropDuplicates(["__rep"])
    blocks = F.ceil(F.col("n") / BLOCK)
    sets = sets.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("__rep"), blocks))
    pairs = sets.select("component", "__rep", "set", "block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("o")).select("component", "__rep", "set", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    checked = stored(_grouped(pairs, "component", "i", "j").mapInArrow(_verify(similarity), "a binary, b binary, links long"))
    classes = components(checked.where("b is not null")).select(F.col("node").alias("__rep"), "component")
    links = checked.groupBy(F.col("a").alias("__rep")).agg(F.sum("links").alias("n_links"))

    facts = reps.select("__rep", "__first", "__text_hash", "n_copies").join(classes, "__rep", "left").join(links, "__rep", "left").withColumn("component", F.coalesce("component", "__rep"))
    least = facts.groupBy("component").agg(F.min("__first").alias("class_id"), F.min(F.struct(F.col("__first").isNull(), F.col("__first"), F.col("__rep"))).getField("__rep").alias("__top"))
    facts = facts.join(least, "component").select("__rep", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("__top") == F.col("__rep")).alias("__leads"), "__first", "__text_hash")
    return _attach(docs, signed, facts, keep, id_col, text_col)


def _attach(docs: DataFrame, signed: DataFrame, facts: DataFrame, keep: list[str], id_col: str, text_col: str) -> DataFrame:
    """The facts of each row's word sequence, and for one row of a class is_first."""
    if keep == [id_col]:
        rows = signed.select(F.col("__id").cast(docs.schema[id_col].dataType).alias(id_col), "__id", "__th", "__rep")
    else:
        schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns)
        inputs = docs.select("*", F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text")).withColumn("__th", F.xxhash64(F.lit(505), "__text"))
        rows = inputs.mapInArrow(_name([*docs.columns, "__id", "__th"]), f"{schema}, __id long, __th long, __rep binary")
    rows = rows.join(facts, "__rep", "left")
    # of several rows of the same words and least id the first in an order of their own is kept
    same_row = F.col("__id").eqNullSafe(F.col("__first")) & (F.col("__th") == F.col("__text_hash"))
    ties = signed.join(facts.where("__leads"), "__rep").where(same_row).groupBy("__rep").agg(F.count(F.lit(1)).alias("__ties")).where("__ties > 1")
    rows = rows.withColumn("is_first", F.col("__rep").isNull() | (F.col("__leads") & same_row))
    if ties.limit(1).count():
        from pyspark.sql import Window

        tied = rows.join(ties.select("__rep"), "__rep", "left_semi").where("is_first")
        order = [F.col(f"`{c}`") for c in keep if "map" not in docs.schema[c].dataType.simpleString()]
        tied = tied.withColumn("is_first", F.row_number().over(Window.partitionBy("__rep").orderBy(*order)) == 1)
        others = rows.join(ties.select("__rep").withColumn("__tied", F.lit(True)), "__rep", "left").where(~(F.col("is_first") & F.coalesce("__tied", F.lit(False)))).drop("__tied")
        rows = others.unionByName(tied)
    class_id = F.when(F.col("__rep").isNull(), F.col("__id")).otherwise(F.col("class_id"))
    return rows.select(*[F.col(f"`{c}`") for c in keep], class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("is_first", F.lit(False)).alias("is_first"))


def _name(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, "__text"):
                _, begin, names = shingle_sets(rows.column("__text"))
                rep = pc.if_else(pa.array(np.diff(begin) > 0), _fixed(names), pa.scalar(None, pa.binary()))
                yield pa.record_batch([*(rows.column(c) for c in keep), rep], [*keep, "__rep"])

    return run


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return join_near_duplicates(docs, keep=["doc_id"]).select("doc_id", "class_id", "n_links", "n_copies")
