"""Operators on small fixtures and against their SQL."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from docloom import catalog
from docloom.functions import text
from docloom.operators import clinical, quality, reports, scrub, similarity, timeline
from docloom.sources import files, sinks

DIR = "/root/testdata/sf0.001"
FAST = sorted(catalog.ORACLES)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    a, b = catalog.QUERIES[name](spark, DIR).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda p: sorted((tuple("" if x != x or x is None else round(float(x), 5) if isinstance(x, float) or str(type(x)).find("numpy.float") > 0 else str(x)[:10] if "time" in str(type(x)).lower() or "date" in str(type(x)).lower() else str(x) for x in r) for r in p[columns].itertuples(index=False)), key=str)
    assert rows(a) == rows(b)


def test_masking_numbers_and_shares_placeholders():
    it = scrub.mask_main("Mail a@b.org or c@d.org, again a@b.org, SSN 000-00-0001, MRN: TEST000001")
    assert it.text == "Mail [EMAIL_1] or [EMAIL_2], again [EMAIL_1], SSN [SSN_1], MRN: [MRN_2]"
    assert len(it.found) == 4 and scrub.mask_main(it.text).found == {}
    assert scrub.mask_main("x@y.org z@w.org").text == "[EMAIL_2] [EMAIL_1]" and scrub.mask_worker("x@y.org z@w.org").text == "[EMAIL_1] [EMAIL_2]"


@pytest.mark.parametrize("token,bad", [("%%%", True), ("|", True), ("a", False), ("word", False), ("....", True), ("...", True), ("x-1", False)])
def test_garbage(spark, token, bad):
    assert spark.createDataFrame([(token,)], "w string").select(quality.is_garbage(F.col("w")).alias("g")).first().g is bad


@pytest.mark.parametrize("value,low,high,want", [(1.0, 3.5, 11.0, "CRITICAL_LOW"), (3.0, 3.5, 11.0, "LOW"), (8.0, 3.5, 11.0, "NORMAL"), (15.0, 3.5, 11.0, "HIGH"), (23.0, 3.5, 11.0, "CRITICAL_HIGH"), (5.0, None, None, "UNKNOWN")])
def test_status(spark, value, low, high, want):
    df = spark.createDataFrame([(value, low, high)], "v double, l double, h double")
    assert df.select(clinical.status(F.col("v"), F.col("l"), F.col("h")).alias("s")).first().s == want


def test_labs_of_a_line(spark):
    df = spark.createDataFrame([(1, "WBC 8.5 x10E3/uL (3.5-11.0)\nWBC 15.0 H\nHGB 9.0 L\nnothing")], "doc_id bigint, text string")
    assert [(x.test, x.value, x.status) for x in clinical.labs(df).orderBy("line_no").collect()] == [("WBC", 8.5, "NORMAL"), ("WBC", 15.0, "HIGH"), ("HGB", 9.0, "LOW")]


def test_chunks(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abc",), ("",)], "t string")
    assert [x.c for x in df.select(text.chunks(F.col("t"), 4, 1).alias("c")).collect()] == [["abcd", "defg", "ghij"], ["abc"], [""]]
    with pytest.raises(ValueError):
        text.chunks(F.col("t"), 4, 4)


def test_leaders_are_greedy_not_components(spark):
    words = [f"word{i:02d}" for i in range(20)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:18])), (3, " ".join(words[:16])), (4, " ".join(words)), (5, "a b")]
    got = dict(similarity.leaders(spark.createDataFrame(rows, "doc_id bigint, text string"), 0.85).collect())
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = dict(similarity.components(links).collect())
    assert set(got.values()) == {0, 100} and got[40] == 0


def test_most_events():
    for n in (0, 5, 10, 11, 60, 200):
        for kb in (0.5, 1.0, 3.0, 5.0):
            m = n
            while m * 0.1 > kb and m > 10:
                m -= 1
            assert timeline.most(n, kb) == m


def test_markdown_and_upsert(spark):
    assert files.to_markdown("<h1>T</h1><p>a <b>c</b></p><table><tr><th>x</th><th>y</th></tr><tr><td colspan=2>z</td></tr></table>") == "# T\n\na **c**\n\n| x | y |\n|---|---|\n| z | <Merged> |"
    docs = spark.createDataFrame([(1, 'q "x"', "a  \na\n\n\n\nb")], "doc_id bigint, name string, text string")
    out = sinks.markdown(docs, {"name": F.col("name")}, F.lit(2)).first().markdown
    assert out.startswith('---\nname: "q \\"x\\""\n---\n') and "\na\n\nb\n" in out and out.endswith("replaced: 2.*")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_records_of_reports(spark):
    texts = [
        "DOB: 01/02/1980\nCT scan of the chest 3/4/2021\nFindings: nodule seen by Dr. Jane Roe in the left lung\nupper part of it\nIMPRESSION: call 555-010-0001 about the nodule",
        "Biopsy\nDiagnosis: Carcinoma of skin\nwell differentiated\nNOTE: none\nMargins: Free",
        "Weight 80 kg, Temp 37.5 C, pain 12", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert [r.report_class for r in reports.classes(df).orderBy("doc_id").collect()] == ["imaging", "pathology", "unknown", "unknown"]
    assert [r.report_date for r in reports.dates(df).orderBy("doc_id").collect()] == [None, None, None, None]
    far = df.where("doc_id = 0").withColumn("text", F.regexp_replace("text", "\n", " " * 101))
    assert reports.dates(far).first().report_date == "3/4/2021"
    assert reports.dates(df.withColumn("filename", F.lit("note 5-6-2020.txt"))).first().report_date == "5-6-2020"
    i = reports.imaging(df).orderBy("doc_id").first()
    assert (i.modality, i.body_part, i.impression) == ("ct", "chest", "call [PHONE] about the nodule")
    assert i.findings[0] == "nodule seen by [NAME] in the left lung\nupper part of it"
    p = reports.pathology(df).collect()
    assert [(r.specimen_type, r.diagnosis, r.margins) for r in p] == [("unspecified", "Carcinoma of skin\nwell differentiated", "negative")]
    v = reports.vital_signs(df).collect()
    assert [(r.weight, r.weight_unit, r.temperature, r.temperature_unit, r.pain) for r in v] == [(80.0, "kg", 37.5, "C", None)]


def test_distance_and_statistics(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r.d for r in df.select(similarity.euclidean(F.col("a"), F.col("b")).alias("d")).collect()] == [5.0, None]
    found = spark.createDataFrame([(1,), (1,), (2,)], "cluster int")
    assert tuple(similarity.statistics(found).first()) == (3, 2, 1, 1, 1 / 3)
    assert tuple(similarity.statistics(found.where("false")).first()) == (0, 0, 0, 0, 0.0)


def test_yaml_scalars(spark):
    df = spark.createDataFrame([("plain",), ('a: "b"',), (None,)], "s string")
    assert [r.y for r in df.select(sinks.yaml_scalar(F.col("s")).alias("y")).collect()] == ["plain", '"a: \\"b\\""', None]
    assert spark.range(1).select(sinks.yaml_size(F.lit(3)).alias("n")).first().n == 1624


def test_jaccard_pairs_compare_few(spark, monkeypatch):
    """All pairs by brute force; of texts that share one rare word and little else none is compared."""
    rng = random.Random(5)
    vocabulary = [f"word{i:04d}" for i in range(3000)]
    texts = [" ".join(rng.sample(vocabulary, rng.randint(20, 60))) for _ in range(120)]
    texts += [f"shared{k // 60} " + " ".join(rng.sample(vocabulary, 40)) for k in range(120)]
    for k in range(40):
        words = texts[k * 5].split()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += ["", "a b c", "seven words that make their only text match", "words seven that make their only text match", "lone", None]
    sets = {i: {w for w in t.lower().split() if len(w) > 3} for i, t in enumerate(texts) if t}
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and x and len(x & y) / len(x | y) >= 0.85}
    compared, alike = [], similarity.alike
    monkeypatch.setattr(similarity, "alike", lambda pairs, *rest: compared.append(pairs.count()) or alike(pairs, *rest))
    got = {(r.a, r.b): r.similarity for r in similarity.jaccard_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == want and len(want) > 20
    assert compared[0] <= 2 * len(want)  # the prefix filter alone leaves the 3540 pairs that share a rare word
