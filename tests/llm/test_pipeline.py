"""The pipeline's stages on the smallest documents, each held against its own input."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import minhash, mixing, outliers
from millrace.llm.common import stored, table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "packing"]
    first = docs = table(spark, DATA, "documents")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA))
        seen.append(docs)
    for kept in seen[1:-1]:
        assert kept.columns == first.columns
    quality, lined, distinct, mixed, packed = seen[1:]
    verdicts = {r.doc_id: r.kept for r in outliers.quality_verdicts(first).select("doc_id", "kept").collect()}
    assert {r.doc_id for r in quality.collect()} == {i for i, ok in verdicts.items() if ok}
    assert {r.doc_id for r in lined.collect()} <= {r.doc_id for r in quality.collect()}
    assert minhash.near_duplicates(distinct, 5).filter("NOT kept").count() == 0
    taken = {r.doc_id: r.copies for r in mixing.mix(distinct).collect()}
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert copies == {i: n for i, n in taken.items() if n}
    total = packed.groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in total} == set(copies)


def test_stages_take_nulls_repeats_clashing_columns_and_nothing(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 80)) for _ in range(12)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(3, texts[3], "en", "a"), (None, texts[4], None, None), (None, None, "en", None), (20, "", "en", "a")]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("copies", "kept", "n_lines", "m0", "component", "key", "size", "h", "n")})
    for df in (docs, docs.filter("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stored(stage(spark, df, ""))
            assert df.columns == docs.columns
        assert {r.text for r in df.collect()} <= set(texts)
        pieces = corpus_pipeline.STAGES[-1][1](spark, df, "")
        assert (pieces.count() > 0) == (df.count() > 0)
