"""The pipeline against plain versions of its stages, each on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from quern.llm import token_output

from tests.llm.test_operators import FOLDER, plain_classes, plain_hits, plain_quality


def test_stages(spark):
    import duckdb

    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    good = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        rows = out.collect()
        ids = [r["doc_id"] for r in rows]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS and Counter(map(repr, rows)).keys() <= Counter(map(repr, before)).keys()
        if name == "quality rules":
            fails = {r["doc_id"] for r in before if (s := plain_quality(r["text"]))[0] < 20 or 100 * s[4] > 30 * s[0]}
            assert not fails & set(ids) and {i for i, q in good.items() if q and i not in fails} - set(ids) == set()
        elif name == "n-gram Jaccard join":
            want = plain_classes([(r["doc_id"], r["text"]) for r in before])
            assert sorted(ids) == sorted({c for c, _ in want.values()})
        elif name == "benchmark decontamination":
            assert sorted(ids) == sorted(r["doc_id"] for r in before if not plain_hits(r["text"], items)[1])
        elif name == "mixing sources to target weights":
            size = {r["doc_id"]: len(r["text"].split()) for r in before}
            assert max(Counter(ids).values()) <= 3 and sum(size[i] for i in ids) <= sum(size.values())
        else:
            import public_tokenizers

            s = token_output.Stretches(public_tokenizers.path(token_output.TOKENIZER))
            assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == sorted((r["doc_id"], int(s.encode([r["text"]], 1)[1][0])) for r in before)
        docs, before = spark.createDataFrame(rows, out.schema), rows


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_stages_on_odd_rows(spark):
    from pyspark.sql import functions as F

    long_text = " ".join(f"word{i * 7919 % 5003}" for i in range(30000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long_text, "en", "a", 9), (3, long_text, "en", "a", 9), (None, "just " + long_text[:900], None, None, 1), (4, " ".join(f"other{i}" for i in range(80)), "en", "b", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{FOLDER}/documents.parquet").schema).withColumns({c: F.lit(c) for c in ("kept", "class_id", "copies", "spans", "a.b")})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        out = stage(spark, docs, FOLDER)
        if k == len(corpus_pipeline.STAGES) - 1:
            assert sorted(r["n_tokens"] for r in out.collect())[:2] == [1, 1] and out.count() == len(rows)
            continue
        assert out.columns == docs.columns
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert set(got) <= {r[:2] for r in rows} and all(r["kept"] == "kept" and r["a.b"] == "a.b" for r in out.collect())
        if k == 0:
            assert not {(1, None), (2, "")} & set(got)
        elif k == 1:
            assert sorted(map(repr, got)) == sorted(repr(r[:2]) for r in [*rows[:3], *rows[4:]])
        elif k == 2:
            assert len(got) == len(rows)
