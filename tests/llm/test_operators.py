"""The training-data operators against plain versions, on odd small tables and on the driver's smallest."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import decontam, jaccard_join, langid, line_dedup, mixing, quality, registry, sharding, substring_arrays, substring_windows, token_output
from quern.llm.graph import components

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(folder=FOLDER):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, a null id twice."""
    rng = random.Random(3)
    long_text = " ".join(rng.choice(["alpha", "Beta,", "gamma.", "délta", "ε"]) + str(rng.randrange(9999)) for _ in range(4000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 1), (4, long_text, "en", "a", 9), (5, long_text, "de", "b", 9), (5, long_text, "de", "b", 9), (None, "one two three", None, "b", 1), (None, "one two three four five six", "fr", "c", 2), (6, "ONE two,three", "fr", "a", 3)]
    rows += [(10 + i, f"shared line\nown {i} line\nShared LINE \n\n", "en", "a", 5) for i in range(12)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df, *names):
    return df.withColumns({n: F.lit("mine") for n in names})


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(name, spark, compare):
    got, want = compare(registry.queries()[name], registry.oracle_sql()[name], FOLDER)
    assert got == want


# 1


def plain_hits(text, items, size=10):
    w = words(text)
    hit, found = set(), set()
    for item, other in items:
        o = words(other)
        for i in range(max(1, len(o) - size + 1) if o else 0):
            p = o[i : i + size]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit |= set(range(j, j + len(p)))
                    found |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_decontamination(spark, block_bytes):
    items = [(1, "a b c d e f g h i j k l"), (2, "Short One"), (2, "Short One"), (3, None), (4, "... !"), (None, "nul item words"), (5, "é ü ñ a b c d e f g h")]
    docs = [(1, "x A b, c d e f g h i J! y"), (2, "short ONE short one"), (3, None), (4, ""), (5, "a nul item words b"), (6, "ü É Ü Ñ a b c"), (7, "é ü ñ a b c d e f g h i j k l"), (7, "é ü ñ a b c d e f g h i j k l"), (8, "short ones"), (9, "short\none")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = clash(spark.createDataFrame(docs, "doc_id long, text string"), "n_hit", "spans", "other")
    out = decontam.mark_contaminated(df, bench, block_bytes=block_bytes).collect()
    assert len(out) == len(docs) and all(r["other"] == "mine" for r in out)
    for r in out:
        n, hit, found = plain_hits(r["text"], items)
        assert (r["n_words"], r["n_hit"], r["item_ids"], r["n_items"], r["contaminated"]) == (n, hit, found, len(found), hit > 0), r
        assert sum(len(words(r["text"][s["start"] : s["stop"]])) for s in r["spans"]) == hit
    assert not decontam.mark_contaminated(df, bench.limit(0)).where("contaminated").count()


# 2


def plain_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics(odd, spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    out = quality.judge_quality(clash(odd, "kept", "n_words"), labels).collect()
    assert len(out) == odd.count()
    for r in out:
        s = plain_quality(r["text"])
        assert tuple(r[c] for c in quality.BASE) == s
        assert r["base_failed"] == (s[0] < 20 or 100 * s[4] > 30 * s[0]) and not (r["kept"] and r["base_failed"])
    for text in texts().values():
        s = quality.statistics(pa.array([text]))
        assert tuple(int(s[c][0]) for c in quality.BASE) == plain_quality(text)


def test_forest_tells_junk_and_keeps_clean():
    rng = np.random.default_rng(0)
    good = rng.normal(0, 1, (3000, 5))
    bad = np.vstack([rng.normal(0, 1, (50, 5)) + 8, rng.normal(0, 1, (50, 5)) * [1, 9, 1, 1, 9]])
    forest = quality.Forest(good)
    scores = forest.score(np.vstack([good, bad]))
    cut = quality.threshold(scores, np.arange(len(scores)) < len(good))
    assert (scores[:3000] >= cut).mean() <= quality.MAX_LOSS and (scores[3000:3050] >= cut).mean() > 0.9
    assert np.allclose(forest.score(good[:7]), scores[:7])


def test_quality_without_labels(odd, none, spark):
    empty = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert quality.judge_quality(odd, empty).where("kept != (not base_failed)").count() == 0
    assert quality.judge_quality(none, empty).count() == 0


# 3


def test_line_dedup_odd(odd, none):
    out = line_dedup.drop_common_lines(clash(odd, "n_lines", "extra")).collect()
    assert len(out) == odd.count() and all(r["extra"] == "mine" for r in out)
    for r in out:
        if r["doc_id"] and r["doc_id"] >= 10:
            assert (r["n_lines"], r["n_dropped"], r["kept_text"]) == (5, 2, f"own {r['doc_id'] - 10} line\n\n")
        else:
            assert (r["n_dropped"], r["kept_text"]) == (0, r["text"] or "")
    assert line_dedup.drop_common_lines(none).count() == 0


def test_repeated_rows_are_one_document(spark):
    df = spark.createDataFrame([(1, "same")] * 12 + [(2, "a\nb\nc"), (3, "a\nc")], "doc_id long, text string")
    assert line_dedup.drop_common_lines(df).where("n_dropped > 0").count() == 0
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.drop_common_lines(df, min_docs=2).where("doc_id > 1").collect()}
    assert got == {2: "b", 3: ""}


# 4


def test_kneser_ney_sums_to_one():
    m = langid.Models({x: _counts(t) for x, t in (("en", ["the theme then", "there"]), ("xx", ["öö ab", "ba"]))})
    alphabet = "then mröab"
    for context in ("", "th", "the t", "zzz"):
        code, _ = langid.characters([context])
        total = np.zeros(2)
        for c in {*langid.characters([alphabet])[0].tolist()} - {langid.PAD} | {0x7A}:
            base = code.tolist()
            total += np.exp(_log(m, np.array([*base, c]), len(base)))
        assert (total <= 1.0001).all() and (total > 0.9).all()


def _counts(lines):
    code, _ = langid.characters(lines)
    at = np.flatnonzero(code != langid.PAD)
    grams, n = np.unique(np.stack([code[at - j] for j in range(langid.ORDER - 1, -1, -1)], 1), axis=0, return_counts=True)
    return grams, n.astype(float)


def _log(m, code, at):
    h = lambda at, k: langid.hashes_at(code, np.array([at]), k)
    out = np.zeros(len(m.langs))
    for k in range(langid.ORDER, 0, -1):
        row = m.grams[k].find(h(at, k))[0]
        if row >= 0:
            return out + m.grams[k].values[row]
        if k > 1 and (ctx := m.contexts[k].find(h(at - 1, k - 1))[0]) >= 0:
            out += m.contexts[k].values[ctx]
        elif k == 1:
            out += m.contexts[1].values[0]
    return out + m.unknown


def test_language_accuracy_and_odd(spark, odd, none):
    folder = "/root/testdata/sf0.01"
    out = registry.queries()["op4_language_id"](spark, folder)
    both = out.join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (both["lang"] == both["lang_pred"]).mean() > 0.97 and both["score"].between(0, 1).all()
    models = langid.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    got = langid.identify_language(clash(odd, "score"), models).collect()
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1
    assert langid.identify_language(none, models).count() == 0
    assert {r["lang_pred"] for r in langid.identify_language(odd, langid.fit(none)).collect()} == {"und"}


def test_language_fit_counts_copies_once(spark):
    # nearly all rows are copies of one text; the sample holds all distinct texts nevertheless
    rows = [(f"nur einmal steht hier {'abcdefghij'[i % 10] * (i + 1)} im satz", "de") for i in range(20)] + [("an english line of text", "en")]
    docs = spark.createDataFrame(rows + [("immer wieder derselbe text", "de")] * 3000, "text string, lang string")
    copied, single = langid.fit(docs, fit_docs=30), langid.fit(docs.distinct(), fit_docs=30)
    assert copied.langs == single.langs == ["de", "en"]
    assert np.array_equal(copied.grams[langid.ORDER].hashes, single.grams[langid.ORDER].hashes)


# 5


def plain_classes(docs, similarity=0.8):
    """id -> (class, links), and the words' own classes, for (id, text) rows with distinct ids."""
    seq = {i: tuple(words(t)) for i, t in docs}
    first = {}
    for i in sorted(seq):
        first.setdefault(seq[i] or ("", i), i)
    reps = sorted(first.values())
    sets = {i: {seq[i]} if len(seq[i]) < 5 else {seq[i][k : k + 5] for k in range(len(seq[i]) - 4)} for i in reps}
    parent, links = {i: i for i in reps}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in reps:
        for b in reps:
            if a < b and seq[a] and seq[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (find(first[seq[i] or ("", i)]), links[first[seq[i] or ("", i)]]) for i in seq}


def near_copies(n, seed=5):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(900)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(base[i % 6] if i % 3 else base[0])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


def test_jaccard_join(spark, monkeypatch):
    rows = near_copies(90) + [(200, None), (201, ""), (202, "a b"), (203, "A b"), (204, "a c")]
    want = plain_classes(rows)
    monkeypatch.setattr(jaccard_join, "SMALL", 8)  # so that the cluster is split, and at last cut into parts
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "MANY", 16)
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"), "class_id", "more")
    out = {r["doc_id"]: r for r in jaccard_join.join_near_duplicates(df).collect()}
    assert {i: (r["class_id"], r["n_links"]) for i, r in out.items()} == want and all(r["more"] == "mine" for r in out.values())
    assert Counter(r["class_id"] for r in out.values() if r["is_first"]) == Counter({c for c, _ in want.values()})


def test_links_in_large_nodes_of_strangers(spark, monkeypatch):
    # tokens from three values each: strangers share a third, too few to be linked, and nodes stay large nevertheless
    rng = np.random.default_rng(3)
    sig = rng.integers(1, 4, (3000, jaccard_join.COORDINATES)).astype(np.uint32)
    for k in range(0, 60, 2):
        sig[k + 1] = sig[k]
        sig[k + 1, :6] = 9
    monkeypatch.setattr(jaccard_join, "SMALL", 1)
    monkeypatch.setattr(jaccard_join, "MANY", 16)  # the largest nodes split again, the others end in blocks
    reps = spark.createDataFrame([(bytearray(k.to_bytes(16, "big")), bytearray(s.tobytes())) for k, s in enumerate(sig)], "__rep binary, __sig binary")
    got = {tuple(sorted((int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")))) for r in jaccard_join.propose_links(reps).collect()}
    alike = np.stack([(sig == s).sum(1) >= jaccard_join.PROPOSED for s in sig])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(np.triu(alike, 1))), strict=True)) and len(got) >= 30


def test_jaccard_join_odd(odd, none):
    out = jaccard_join.join_near_duplicates(odd).collect()
    assert len(out) == odd.count()
    assert sorted(r["n_copies"] for r in out if r["doc_id"] in (4, 5)) == [3, 3, 3] and {r["class_id"] for r in out if r["doc_id"] in (4, 5)} == {4}
    assert sum(r["is_first"] for r in out if r["doc_id"] in (4, 5)) == 1
    assert jaccard_join.join_near_duplicates(none).count() == 0


def test_tied_first_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert jaccard_join.join_near_duplicates(df).where("is_first").count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def join_rows(spark, since):
    """Rows that the joins of the SQL executions from `since` on made."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    for k in range(since, store.executionsCount()):
        run = store.executionsList(k, 1).head()
        made, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            metrics = node.metrics().iterator()
            while "Join" in node.name() and metrics.hasNext():
                metric = metrics.next()
                if metric.name() == "number of output rows" and made.contains(metric.accumulatorId()):
                    total += int(made.apply(metric.accumulatorId()).replace(",", ""))
    return total


@pytest.mark.parametrize("few", [0, 100, 200_000])
def test_rounds_of_components_join_fewer_and_fewer_edges(spark, monkeypatch, few):
    monkeypatch.setattr("quern.llm.graph.FEW_EDGES", few, raising=False)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + j) for i in range(60) for j in range(i)] + [(5000 + 50 * k, 5001 + 50 * k + i) for k in range(10) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(60)} | {5000 + 50 * k + i: 5000 + 50 * k for k in range(10) for i in range(41)}
    assert join_rows(spark, since) <= 4 * len(edges) and (few > len(edges) or join_rows(spark, since) > 0)


# 6


def test_tokens(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(token_output.TOKENIZER))
    encode = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, token_output.END_ID]
    out = {r["doc_id"]: r for r in registry.queries()["op6_token_output"](spark, FOLDER).collect()}
    start = 0
    for i, text in sorted(texts().items()):
        ids = encode(text)
        assert (out[i]["start"], out[i]["n_tokens"], out[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    s = token_output.Stretches(public_tokenizers.path(token_output.TOKENIZER))
    for text in ["it's don't <|endoftext|>x", "é ́a ΣΑΣ Σ", " \t\x0b\xa0 a\x85b\x1c ", "ﬁ ½ 漢字かな İstanbul ẞ!! Ab.", "Å ŉ. Ǆ, ª", "'s 'S' DON'T,x 12a3 é2! ..'ll", "x\x00y\x7f ×÷ aé×b", "<|ENDOFTEXT|>", "É'é ÉÉ a̐", ""]:
        assert s.encode([text], token_output.END_ID)[0].tolist() == encode(text)
    rng = random.Random(6)
    mixed = ["".join(rng.choice(["a", "B", "é", "É", " ", "\n", "'", "s", "1", "²", ".", "-", "ß", "漢", "́", "\xa0", "ll", "İ", "Σ", "<|"]) for _ in range(rng.randrange(30))) for _ in range(500)]
    ids, n = s.encode(mixed, token_output.END_ID)
    assert ids.tolist() == [i for t in mixed for i in encode(t)] and n.tolist() == [len(encode(t)) for t in mixed]
    s.known_settings = False  # as with another tokenizer's file: texts go to it whole
    assert s.encode(["it's a Tést", None, "x"], 1)[0].tolist() == [*encode("it's a Tést"), 1, *encode("x")]
    rows = token_output.token_digest(odd).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len(encode(r["text"])) for r in odd.collect())
    ends = {r["start"] + r["n_tokens"] for r in rows}
    assert {r["start"] for r in rows} - {0} <= ends and len(rows) == odd.count()
    assert token_output.token_digest(none).count() == 0


def test_token_files_are_read_in_part(spark, tmp_path, odd):
    import public_tokenizers
    import pyarrow.parquet as pq

    token_output.write_tokens(odd, str(tmp_path / "t"), public_tokenizers.path(token_output.TOKENIZER))
    plan = token_output.read_tokens(spark, str(tmp_path / "t")).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan.split("ReadSchema")[1]
    meta = pq.ParquetFile(max((tmp_path / "t").glob("*.parquet"), key=lambda p: p.stat().st_size)).metadata.row_group(0)
    by_name = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings and any("DICTIONARY" in e for e in by_name["ids.list.element"].encodings)
    assert by_name["doc_id"].has_offset_index and by_name["doc_id"].has_column_index


# 7


@pytest.mark.parametrize("n", [0, 3, 1000])
def test_sharding(spark, n):
    df = spark.range(n).select((F.col("id") % 7).alias("doc_id"), F.lit("x").alias("shard"), F.when(F.col("id") % 2 == 0, "t").alias("text"))
    out = sharding.shuffle_into_shards(df, 8).collect()
    assert len(out) == n
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots.get(j, [])) for j in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert sorted(r["doc_id"] for r in out) == sorted(i % 7 for i in range(n))


def test_hypergeometric():
    rng = random.Random(1)
    got = Counter(sharding.hypergeometric(rng, 5, 7, 4) for _ in range(20000))
    from math import comb

    for k in range(5):
        assert abs(got[k] / 20000 - comb(5, k) * comb(7, 4 - k) / comb(12, 4)) < 0.02
    m = sharding.communication_matrix([10**10, 0, 7], [5 * 10**9, 10**10 - 5 * 10**9 + 7], rng)
    assert [sum(r) for r in m] == [10**10, 0, 7] and [sum(c) for c in zip(*m, strict=True)] == [5 * 10**9, 5 * 10**9 + 7]


# 8


def test_compact_windows():
    rng = np.random.default_rng(1)
    for _ in range(60):
        begin = np.concatenate(([0], np.cumsum(rng.integers(0, 60, 4))))
        v, length = rng.integers(0, 30, begin[-1]).astype(np.uint64) << np.uint64(40), int(rng.integers(2, 12))
        want = set()
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            for c in range(a, b):
                f = l = c
                while f > a and v[f - 1] > v[c]:
                    f -= 1
                while l + 1 < b and v[l + 1] >= v[c]:
                    l += 1
                if l - f + 1 >= length:
                    want.add((f, c, l))
        assert set(zip(*(x.tolist() for x in substring_windows.compact_windows(v, begin, length)), strict=True)) == want


def test_repeated_passages(spark, none, odd):
    rng = random.Random(8)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passage, near = fresh(70), fresh(80)
    edited = list(near)
    edited[40] = "other"
    rows = [(i, " ".join(fresh(60) + passage + fresh(60))) for i in range(30)] + [(50, " ".join(fresh(20) + near)), (51, " ".join(edited + fresh(90)))]
    rows += [(60 + i, " ".join(fresh(150))) for i in range(10)] + [(70 + i, " ".join(fresh(40) + passage[:30] + fresh(40))) for i in range(3)] + [(80, None)]
    out = substring_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x for r in out for x in (r["doc_id"], r["other_id"])} == {*range(30), 50, 51}
    assert all(r["similarity"] >= 0.8 and r["n_words"] >= 50 for r in out)
    assert substring_windows.repeated_passages(none).count() == 0
    assert {x for r in substring_windows.repeated_passages(odd).collect() for x in (r["doc_id"], r["other_id"])} == {4, 5}


def test_passage_functions_for_the_recall():
    assert substring_windows.MISSED == 0.002 and (1 - substring_windows.SIMILARITY) ** substring_windows.FUNCTIONS <= 0.002 and len(substring_windows._SEEDS) == 4


def test_passages_around_a_frequent_line(spark):
    # six passages of 50 words, twice each, and forty other texts hold the same line, and the least hashes of the passages are the line's
    rng = random.Random(9)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]

    def fits(passage):  # least hashes with the line on the one side, and on the other what surrounds the passage, within 22 shingles
        g, _, _ = jaccard_join.shingle_sets(pa.array([" ".join(passage)]))
        places = [int(np.argmin(substring_windows.mix(g ^ seed))) for seed in substring_windows._SEEDS[:3]]
        return all(10 <= p < 22 for p in places[::2]) and 24 <= places[1] < 36

    passage, rows = next(p for p in (fresh(50) for _ in range(5000)) if fits(p)), []
    line = passage[10:40]
    for passage in [p for p in (fresh(10) + line + fresh(10) for _ in range(300)) if fits(p)][:6]:
        rows += [(len(rows) + side, " ".join(fresh(60) + passage + fresh(60))) for side in range(2)]
    assert len(rows) == 12
    rows += [(100 + i, " ".join(fresh(50) + line + fresh(50))) for i in range(40)]
    out = substring_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(sorted((r["doc_id"], r["other_id"]))) for r in out} == {(k, k + 1) for k in range(0, 12, 2)}


def test_leaders_on_both_sides_of_a_partition_end():
    w = substring_windows
    kinds = {"key": pa.int64(), "rid": pa.int64(), "content": pa.int64(), "place": pa.int32(), "before": pa.int8(), "after": pa.int8()}
    part = lambda rids: pa.record_batch([pa.array([v] * len(rids) if v is not None else rids, t) for v, t in zip((5, None, 7, 20, 20, 25), kinds.values(), strict=True)], list(kinds))
    heads = [r for rids in ([1, 2], [3, 4]) for b in w._lead(iter([part(rids)])) for r in b.to_pylist() if r["kind"] == 1]
    assert [r["rid"] for r in heads] == [1, 3]
    blob = np.arange(46, dtype=np.uint16).tobytes()
    rows = pa.RecordBatch.from_pylist([{c: r[c] for c in ("key", *w._WINDOW)} | {"i": 0, "j": 0, "block": 0, "shingles": blob} for r in heads])
    rows = rows.set_column(rows.schema.get_field_index("before"), "before", rows.column("before").cast(pa.int8()))
    assert [(r["lead_rid"], r["rid"], r["start"], r["stop"], r["similarity"]) for b in w._compare(iter([rows])) for r in b.to_pylist()] == [(1, 3, 0, 45, 1.0)]


def plain_links(windows):
    """Pairs of windows that hold a passage place by place, found by trying all stretches."""
    w = substring_windows
    out = set()
    for i, (ta, ca) in enumerate(windows):
        for j, (tb, cb) in enumerate(windows[:i]):
            same = [x is not None and y is not None and x == y for x, y in zip(ca, cb, strict=True)]
            both = [x is not None and y is not None for x, y in zip(ca, cb, strict=True)]
            if ta != tb and any(all(both[x:y]) and (m := sum(same[x:y])) >= w.SIMILARITY * (2 * (y - x) - m) for x in range(w._WIDTH) for y in range(x + w._LEAST, w._WIDTH + 1)):
                out.add((j, i))
    return out


def joined(n, pairs):
    group = list(range(n))
    for a, b in pairs:
        group = [group[a] if g == group[b] else g for g in group]
    return {frozenset(i for i in range(n) if group[i] == g) for g in group}


@pytest.mark.parametrize("few", [1, 100])
def test_windows_of_a_min_hash_lose_no_link(monkeypatch, few):
    w = substring_windows
    monkeypatch.setattr(w, "FEW", few)
    rng = np.random.default_rng(11)
    families = [rng.integers(0, 60000, w._WIDTH) for _ in range(5)]
    windows, records = [], []
    for k in range(60):
        before, after = int(rng.integers(0, 46)), 45
        cells = families[k % 5].copy()
        for _ in range(rng.integers(0, 4)):
            at = int(rng.integers(0, w._WIDTH - 5))
            cells[at : at + 5] = rng.integers(0, 60000, 5)
        cells[45:75] = families[0][45:75]  # what all of them share is too short for a passage
        cells[45 - before] = rng.integers(0, 60000)
        windows.append((k % 50, [None] * (45 - before) + cells[45 - before :].tolist()))
        records.append({"key": 1, "rid": k % 50, "place": 200 + k, "before": before, "after": after, "block": 0, "i": 0, "j": 0, "shingles": cells[45 - before :].astype(np.uint16).tobytes()})
    rows = pa.RecordBatch.from_pylist(records)
    got = [r for b in w._compare(iter([rows])) for r in b.to_pylist()]
    number = {(r["rid"], r["place"]): k for k, r in enumerate(records)}
    assert all(r["stop"] - r["start"] + 1 >= 46 and abs(r["similarity"]) >= 0.8 for r in got)
    want = plain_links(windows)
    assert len(want) > 50
    # links are told by texts and places; windows that plain links join are joined by the found ones
    found = set()
    for r in got:
        for i, (t, _) in enumerate(windows):
            for j, (u, _) in enumerate(windows):
                if t == r["rid"] and u == r["lead_rid"] and records[i]["place"] - records[j]["place"] == r["start"] - r["lead_start"]:
                    found.add((min(i, j), max(i, j)))
    assert len(number) == 60 and joined(60, found) == joined(60, want)


def test_all_passages_of_a_pair(spark):
    rng = random.Random(10)
    fresh = lambda n: [f"q{rng.randrange(10**9)}" for _ in range(n)]
    one, two, grown = fresh(60), fresh(100), fresh(160)
    rows = [(1, one + fresh(12) + two), (2, one + fresh(12) + two), (3, fresh(20) + grown), (4, grown[:90] + fresh(1) + grown[90:] + fresh(30))]
    out = substring_windows.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    found = {frozenset(((r["doc_id"], r["start_word"]), (r["other_id"], r["other_start_word"]))): r for r in out}
    assert found[frozenset(((1, 0), (2, 0)))]["n_words"] == 60 and found[frozenset(((1, 72), (2, 72)))]["n_words"] == 100
    whole = found[frozenset(((3, 20), (4, 0)))]  # over the inserted word
    assert {whole["n_words"], whole["other_n_words"]} == {160, 161}
    a, b = np.arange(300, dtype=np.uint32), np.arange(300, dtype=np.uint32)
    b[56:72] = np.arange(1000, 1016)
    assert [p[:2] for p in substring_windows._passages(a[:168], b[:168], 46)] == [(72, 168), (0, 56)]


def test_passages_with_a_word_added_near_an_end(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"e{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(40):  # 42 of 51 shingles are shared
        p, at = fresh(50), (5, 8, 12, 38, 42, 45, 25, 30)[k % 8]
        rows += [(2 * k, " ".join(fresh(40) + p + fresh(40))), (2 * k + 1, " ".join(fresh(30) + p[:at] + fresh(1) + p[at:] + fresh(50)))]
    out = substring_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(sorted((r["doc_id"], r["other_id"]))) for r in out} == {(2 * k, 2 * k + 1) for k in range(40)}


def test_a_passage_is_found_if_any_two_stretches_are_one():
    rng, w, length, some = np.random.default_rng(3), substring_windows, 14, 0
    fresh = lambda n: rng.integers(0, 60000, n).tolist()
    for _ in range(120):
        base = fresh(17)
        q = list(base)
        for _ in range(rng.integers(1, 4)):
            at, k = int(rng.integers(0, len(q))), int(rng.integers(0, 3))
            q[at : at + k * int(rng.integers(0, 2))] = fresh(k)
        a, b = (fresh(rng.integers(0, 3)) + x + fresh(rng.integers(0, 3)) for x in (base, q))
        stretches = [[set(x[i:j]) for i in range(len(x)) for j in range(i + length, len(x) + 1)] for x in (a, b)]
        want = any(len(s & t) >= w.SIMILARITY * len(s | t) for s in stretches[0] for t in stretches[1])
        got = w._passage(np.array(a, np.uint32), np.array(b, np.uint32), length)
        assert (got is not None) == want
        some += want
    assert some > 60


def test_passages_of_one_shingle_unlike_the_first_window_are_linked():
    w, rng = substring_windows, np.random.default_rng(12)
    records = []
    for k in range(w.FEW + 10):  # the first two hold the shingle once, the others 46 times; what stands before it differs
        cells = rng.integers(1, 60000, 20 + k + 46)
        cells[20 + k : None if k > 1 else 21 + k] = 7
        records.append({"key": 1, "rid": k, "place": 100, "before": 20 + k, "after": 45, "block": 0, "i": 0, "j": 0, "shingles": cells.astype(np.uint16).tobytes()})
    got = {(r["lead_rid"], r["rid"]) for b in w._compare(iter([pa.RecordBatch.from_pylist(records)])) for r in b.to_pylist()}
    assert joined(len(records), got) == {frozenset({0}), frozenset({1}), frozenset(range(2, len(records)))}


def window_pairs(rng, n):
    """Windows in pairs, the second with words changed, added, left out, moved or twice; most of the shingles are shared."""
    w, records = substring_windows, []
    for k in range(n):
        cells = rng.integers(1, 60000, w._WIDTH).tolist()
        other = list(cells)
        for _ in range(rng.integers(1, 20)):
            at, size = int(rng.integers(0, w._WIDTH - 8)), int(rng.integers(1, 8))
            other[at : at + size * int(rng.integers(0, 2))] = rng.integers(1, 60000, int(rng.integers(0, size + 1))).tolist()
        if k % 11 == 0:
            other = other[30:60] + other[:30] + other[60:]
        if k % 13 == 0:
            other[40:60] = other[20:40]
        for side, x in enumerate((cells, (other + rng.integers(1, 60000, w._WIDTH).tolist())[: w._WIDTH])):
            records.append({"key": k, "rid": side, "place": 100, "before": 45, "after": 45, "block": 0, "i": 0, "j": 0, "shingles": np.array(x, np.uint16).tobytes()})
    return pa.RecordBatch.from_pylist(records)


def test_only_pairs_without_a_passage_are_passed_over():
    w = substring_windows
    block = w._Block(window_pairs(np.random.default_rng(17), 700))
    a, b = np.arange(0, 1400, 2), np.arange(1, 1400, 2)
    passed = w._Block.unlike(block, a, b) | ~block.common(a, b)
    want = np.array([bool(w._passages(block.tokens[i], block.tokens[j], w._LEAST)) for i, j in zip(a, b, strict=True)])
    assert want.sum() > 100 and (~want).sum() > 100
    assert not (passed & want).any()
    assert (passed & ~want).sum() > 0.5 * (~want).sum()


def test_passage_classes(spark, none, odd):
    rng = random.Random(14)
    fresh = lambda n: [f"k{rng.randrange(10**9)}" for _ in range(n)]
    one, two, text = fresh(60), fresh(70), fresh(80)
    rows = [(1, fresh(10) + one + fresh(30)), (2, one + fresh(40) + two), (3, fresh(5) + two), (4, fresh(120)), (5, text), (9, text), (None, text), (11, fresh(30) * 2), (12, ["short"]), (14, one[:40] + fresh(60))]
    rows = [(i, " ".join(w), "x") for i, w in rows] + [(4, None, "x"), (6, "", "x"), (None, None, "x")]
    rows.append(rows[0])  # a row again is the same text
    out = substring_windows.passage_classes(spark.createDataFrame(rows, "doc_id long, text string, class_id string")).collect()
    told = Counter((r["doc_id"], r["class_id"], r["n_passages"], r["n_repeated"], tuple(map(tuple, r["passages"]))) for r in out)
    alone = lambda i: (i, i, 0, 0, ())
    assert told == Counter(
        [(1, 1, 1, 60, ((10, 60),))] * 2 + [(2, 1, 2, 130, ((0, 60), (100, 70))), (3, 1, 1, 70, ((5, 70),)), alone(4), alone(4), *((i, 5, 1, 80, ((0, 80),)) for i in (5, 9, None)), alone(11), alone(12), alone(14), alone(6), alone(None)]
    )
    assert substring_windows.passage_classes(none).count() == 0
    assert substring_windows.passage_classes(odd).count() == odd.count()


def test_classes_against_all_pairs(spark):
    # edited copies of a few texts: every two texts with a passage of 46 shingles of the similarity in common, place by place or across an added word, are of one class
    rng, w = random.Random(15), substring_windows
    fresh = lambda n: [f"m{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for family in (fresh(70) for _ in range(6)):
        for _ in range(12):
            words = list(family)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = fresh(rng.randrange(2))
            texts.append(words)
    sets = [[{hash(tuple(t[k : k + 5])) for k in range(i, i + n)} for n in (46, 47, 48) for i in range(len(t) - 4 - n + 1)] for t in texts]
    linked = {(i, j) for j in range(len(texts)) for i in range(j) if any(len(s & t) >= w.SIMILARITY * len(s | t) for s in sets[i] for t in sets[j])}
    out = w.passage_classes(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(linked) > 100 and len(out) == len(texts)
    class_id = {r["doc_id"]: r["class_id"] for r in out}
    assert [p for p in linked if class_id[p[0]] != class_id[p[1]]] == []
    assert {r["doc_id"] for r in out if r["n_passages"]} == {i for p in linked for i in p}


def test_a_line_over_and_over_is_one_passage_of_a_pair(spark):
    rng = random.Random(16)
    fresh = lambda n: [f"l{rng.randrange(10**9)}" for _ in range(n)]
    line = fresh(12)
    df = spark.createDataFrame([(i, " ".join(fresh(40) + line * (20 + i) + fresh(40))) for i in range(8)], "doc_id long, text string")
    out = substring_windows.repeated_passages(df).collect()
    pairs = {(r["doc_id"], r["other_id"]) for r in out}
    assert len(out) <= 2 * len(pairs), Counter((r["doc_id"], r["other_id"]) for r in out)  # not one for each of many diagonals
    assert joined(8, [(r["doc_id"], r["other_id"]) for r in out]) == {frozenset(range(8))}
    for r in substring_windows.passage_classes(df).collect():
        (start, n), want = r["passages"][0], 12 * (20 + r["doc_id"])
        assert r["class_id"] == 0 and r["n_passages"] == 1 and start <= 40 and start + n >= 40 + want and n <= want + 24


# 9


def test_mixing(spark, odd, none):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(1, 9)) for i in range(3000)] + [(i, "d", 1) for i in range(3000, 3010)] + [(9000, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix_sources(df, "size").collect()
    size, weight, taken = Counter(), {}, Counter()
    for _, s, n in rows:
        size[s] += n or 0
    for k, s in enumerate(sorted(size, key=lambda s: (s is None, s))):
        weight[s] = k % 3 + 1
    total, target, left = sum(size.values()), {}, set(size)
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        dry = {s for s in left if weight[s] * level >= 3 * size[s]}
        target |= {s: 3 * size[s] for s in dry} if dry else {s: weight[s] * level for s in left}
        left = left - dry if dry else set()
    for r in out:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 3
        taken[r["source"]] += (r["size"] or 0) * r["copies"]
    assert all(abs(taken[s] - target[s]) <= 10 for s in size) and sum(taken.values()) <= total
    again = mixing.mix_sources(df.repartition(3), "size").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    assert mixing.mix_sources(clash(odd, "copies").withColumn("w", mixing.n_words("text")), "w").count() == odd.count()
    assert mixing.mix_sources(none.withColumn("w", F.lit(1)), "w").count() == 0


# 10


def plain_cut(rows, length=400):
    seen = Counter(b[k : k + length] for _, b in rows for k in range(len(b) - length + 1))
    out = []
    for i, b in rows:
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                cover[k : k + length] = b"\x01" * length
        out.append((i, len(b), sum(cover), len(re.findall(rb"\x01+", bytes(cover))), hashlib.sha256(bytes(x for c, x in zip(cover, b, strict=True) if not c)).hexdigest()))
    return sorted(out)


def digest(df, **kw):
    out = substring_arrays.cut_repeats(df, **kw).select("doc_id", "n_bytes", "n_removed", F.size("removed_spans"), F.sha2("kept_bytes", 256))
    return sorted(map(tuple, out.collect()), key=lambda r: (r[0] is None, r))


@pytest.fixture(scope="module")
def repeats():
    rng = random.Random(10)
    fresh = lambda n: "".join(rng.choice("abcdé ñ") for _ in range(n))
    common, twice, line, passage = fresh(700), fresh(390), fresh(150), fresh(250)
    rows = [(i, fresh(rng.randrange(300)) + common[rng.randrange(90) : 700 - rng.randrange(90)] + fresh(rng.randrange(500))) for i in range(12)]
    rows += [(20, twice + fresh(50)), (21, fresh(50) + twice), (22, "z" * 1500), (23, "ab" * 700), (24, None), (25, "")] + [(30 + i, common) for i in range(3)]
    edited = common[:300] + "X" + common[301:]
    rows += [(40, edited), (41, edited + fresh(10)), (42, common + common), (43, fresh(40000) + common[:500] + fresh(40000))]
    rows += [(50 + i, fresh(200) + line + fresh(200)) for i in range(40)]  # a common line, too short to be cut or told
    held = fresh(300) + passage + fresh(300)
    return rows + [(90, held), (91, held), (92, fresh(400) + passage + fresh(20)), (93, fresh(9) + passage[:240] + fresh(9))]


@pytest.mark.parametrize("bucket", [1 << 20, 50])
def test_suffix_array_dedup(spark, none, odd, repeats, monkeypatch, bucket):
    monkeypatch.setattr(substring_arrays, "BUCKET", bucket)  # small ones put many ends into the groups
    df = clash(spark.createDataFrame(repeats, "doc_id long, text string"), "n_removed", "n_repeated", "mine")
    assert digest(df) == plain_cut([(i, (t or "").encode()) for i, t in repeats])
    assert {r["mine"] for r in substring_arrays.cut_repeats(df).collect()} == {"mine"}
    assert substring_arrays.cut_repeats(none).count() == 0
    rows = odd.collect()
    plain = Counter(r[1:] for r in plain_cut([(k, (r["text"] or "").encode()) for k, r in enumerate(rows)]))
    assert Counter(r[1:] for r in digest(odd)) == plain and Counter(r[0] for r in digest(odd)) == Counter(r["doc_id"] for r in rows)


def test_passages_that_are_too_short_to_be_cut_are_told(spark, repeats):
    told = {r["doc_id"]: r["n_repeated"] for r in substring_arrays.cut_repeats(spark.createDataFrame(repeats, "doc_id long, text string")).collect()}
    rows = [(i, (t or "").encode()) for i, t in repeats]
    least, sure = substring_arrays.PASSAGE, substring_arrays.PASSAGE + substring_arrays.STEP
    for (i, _, n_least, *_), (_, _, n_sure, *_) in zip(plain_cut(rows, least), plain_cut(rows, sure), strict=True):
        assert told[i] <= n_least and (told[i] > 0 or not n_sure), i
    assert told[92] > 0 and not any(told[50 + i] for i in range(40))


def test_texts_move_by_the_join_where_names_are_many(spark, repeats, monkeypatch):
    df = spark.createDataFrame(repeats, "doc_id long, text string")
    want = digest(df)
    monkeypatch.setattr(substring_arrays, "BROADCAST_BYTES", 0)
    assert digest(df) == want


def test_multikey_order():
    rng = np.random.default_rng(4)
    columns = [rng.integers(-3, 4, 5000), rng.integers(0, 3, 5000), rng.integers(-(2**62), 2**62, 5000)]
    assert np.array_equal(substring_arrays.multikey_order(columns, few=4), np.lexsort(columns[::-1]))
    assert len(substring_arrays.multikey_order([np.zeros(0, np.int64)])) == 0


def test_suffix_array_dedup_on_driver_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    assert digest(docs) == plain_cut([(i, t.encode()) for i, t in texts().items()])


def test_repeated_rows_are_removed(spark):
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(600))
    df = spark.createDataFrame([(1, text), (1, text), (None, text[:500])], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_arrays.cut_repeats(df).orderBy("doc_id").collect()] == [500, 600, 600]
