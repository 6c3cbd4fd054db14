import random

import corpus_pipeline


def test_stages_over_a_small_corpus(spark, tmp_path):
    from tests.llm.test_operators import prose

    r = random.Random(1)
    rows, labels = [], []
    item = prose(9999, 30)
    for i in range(160):
        w = prose(i, 60).split()
        if i % 8 == 0:
            for _ in range(2):
                w.insert(r.randrange(len(w)), "idiot")
        labels.append((i, 1, int(i % 8 == 0)))
        rows.append((i, " ".join(w), "en", "s", 0))
    near = rows[1][1].split()
    near[-1] = "other"
    rows += [(1000, " ".join(near), "en", "s", 0), (1001, f"{prose(7000, 20)}\n{item}", "en", "s", 0), (1002, None, "en", "s", None), (1003, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i for i in range(160) if i % 8} | {1002, 1003}


def test_every_stage_keeps_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.schema.names == docs.schema.names and out.count() > 100


def odd_rows(spark):
    from tests.llm.test_operators import prose

    long = prose(1, 40_000)
    rows = [(1, None, 5), (2, "", 0), (None, prose(2, 80), None), (None, prose(2, 80), None), (3, long, 9), (4, long, 9), (5, prose(3, 70), 1), (5, prose(4, 70), 1), (6, "   ", 3)]
    names = "doc_id bigint, text string, n_chars int, clean string, removed_lines int, tid string, key string, keep string, `a.b` string, id int, h int, lines string"
    return spark.createDataFrame([(*r, "c", 1, "t", "k", "p", "x", 7, 8, "l") for r in rows], names)


def test_stages_with_nulls_ties_and_clashing_names(spark):
    docs = odd_rows(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table, most in ((docs, 9), (docs.where("false"), 0)):
            out = stage(spark, table, "/root/testdata/sf0.001")
            assert out.schema.names == docs.schema.names, name
            got = out.collect()
            assert len(got) <= most and (not most or {1, 2, 3, 5, 6} <= {x.doc_id for x in got} and all((x.clean, x.tid, x["a.b"], x.lines) == ("c", "t", "x", "l") for x in got)), name
            if name == "near_dedup" and most:
                assert sorted((x.doc_id or 0, x.text is None) for x in got) == [(0, False), (1, True), (2, False), (3, False), (5, False), (5, False), (6, False)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 9


def test_stages_bound_the_bytes_of_arrow_batches(spark):
    import pyarrow as pa

    from docloom.llm.common import BATCH_BYTES

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 9000, 1, 1).selectExpr("id", "repeat('x', 2000) as text")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, docs, "/root/testdata/sf0.001")
            got = texts.mapInArrow(sizes, "rows bigint, bytes bigint").collect()
            assert sum(x.rows for x in got) == 9000 and max(x.bytes for x in got) <= BATCH_BYTES + 100_000, name
            spark.conf.set(key, "1m")
            corpus_pipeline.pack(spark, docs, "")
            assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
