"""The pipeline of five stages on small tables with odd rows."""

from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def tables(spark, path, extra):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    more = spark.createDataFrame(extra, "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True).withColumns({c: F.lit("own") for c in ("score", "hits", "row", "gone", "spans", "_group")})
    for name, df in {"documents": docs, "labels": spark.read.parquet(f"{DATA}/labels.parquet"), "benchmark": spark.read.parquet(f"{DATA}/benchmark.parquet")}.items():
        df.write.parquet(f"file://{path}/{name}.parquet")
    return f"file://{path}"


def words(mark, n=70):
    return " ".join(f"{mark}{k}" for k in range(n))


def test_pipeline_rows(spark, tmp_path):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    extra = [
        (9001, words("a")), (9002, words("a") + " end"),  # near copies: the first stays
        (9003, words("b")), (9003, words("c")), (9004, words("d")),  # one doc_id, texts of their own: all stay
        (9005, words("e")), (9005, words("e")),  # a repeated row: one stays
        (9006, "Well. " + item + " So there."),  # holds a benchmark item: goes
        (None, words("f")), (None, words("f") + " end"), (None, None), (9007, ""), (9008, None),
        (9009, words("g", 20) + " " + words("h")), (9010, words("k", 20) + " " + words("h", 69) + " " + words("m", 200)),  # share a passage
    ]
    d = tables(spark, tmp_path / "t", extra)
    out = corpus_pipeline.run(spark, d)
    assert out.columns == ["doc_id", "n_pieces", "ids"]
    rows = [r for r in out.collect() if r.doc_id is None or r.doc_id > 9000]
    count = lambda i: sum(r.doc_id == i for r in rows)
    assert [count(9000 + k) for k in range(1, 9)] == [1, 0, 2, 1, 1, 0, 1, 1]
    assert sorted(r.n_pieces > 0 for r in rows if r.doc_id is None) == [False, True]
    whole = {r.doc_id: r.n_pieces for r in corpus_pipeline.encode_pieces(spark, spark.createDataFrame(extra, "doc_id long, text string"), d).collect()}
    left = {r.doc_id: r.n_pieces for r in rows}
    assert left[9009] == whole[9009] and left[9010] < 0.85 * whole[9010]


def test_stages_on_empty_tables(spark, tmp_path):
    d = tables(spark, tmp_path / "t", [(1, None)])
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        assert out.collect() == [] and (name == "sentencepiece" or out.columns == docs.columns)


def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    """Without labels and benchmark items no row is rejected."""
    d = tables(spark, tmp_path / "t", [])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    none = str(tmp_path / "none")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"file://{none}/{name}.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, f"file://{none}").count() == docs.count()
    assert corpus_pipeline.drop_benchmark_items(spark, docs, f"file://{none}").count() == docs.count()
