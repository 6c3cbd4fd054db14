"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import audio, bloomlm, decontaminate, licenses, linechunks, lpt, omh, packing, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, class_rows, kept: near-duplicate classes of all documents."""
    return omh.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents."""
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    return lpt.shards(table(spark, sf_dir, "documents"))


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, removed_lines, clean (text without repeated passages) for all documents."""
    return linechunks.clean(table(spark, sf_dir, "documents")).select("doc_id", "removed_lines", "clean")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity and place of each benchmark item in each document that contains it."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents."""
    return bloomlm.scores(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and fuzzy notices of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to WARC archives and read back."""
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.selectExpr("key as page_id", "payload_bytes", "digest as payload_digest", "kind as record_type", "refers as refers_to", "problem")


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored media and audio features of all documents."""
    return audio.summaries(audio.media(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_near_dedup, op2_toxicity, op3_lpt_shards, op4_line_chunks, op5_decontaminate, op6_bloom_lm, op7_packing, op8_license_scan, op9_warc, op10_audio)
}
#: Three of the operators can be told in SQL: every chunk of lines from and to each line, every window of a benchmark item's size,
#: and what the archives give back.
ORACLES: dict[str, str] = {
    "op4_line_chunks": r"""
with d as (select doc_id, text, string_split(text, chr(10)) ls from documents where text is not null and text <> ''),
l as (select doc_id, unnest(range(0, len(ls)))::int i, unnest(ls) x from d),
w as materialized (select *, sum(len(list_filter(string_split_regex(x, '\s+'), lambda v: v <> ''))) over (partition by doc_id order by i) upto, len(list_filter(string_split_regex(x, '\s+'), lambda v: v <> '')) n from l),
c as (select a.doc_id, a.i s, min(b.i) e from w a join w b on a.doc_id = b.doc_id and b.i >= a.i and b.upto - a.upto + a.n >= 40 group by a.doc_id, a.i
 union select b.doc_id, max(a.i), b.i from w a join w b on a.doc_id = b.doc_id and b.i >= a.i and b.upto - a.upto + a.n >= 40 group by b.doc_id, b.i),
t as materialized (select c.doc_id, s, e, array_to_string(ls[s + 1:e + 1], chr(10)) chunk from c join d using (doc_id)),
k as (select chunk, min((doc_id, s)) first from t group by chunk having count(*) > 1),
g as (select distinct t.doc_id, unnest(range(s, e + 1)) i from t join k using (chunk) where (t.doc_id, s) <> first),
r as (select w.doc_id, count(g.i) removed, string_agg(x, chr(10) order by w.i) filter (where g.i is null) kept from w left join g on g.doc_id = w.doc_id and g.i = w.i group by w.doc_id)
select documents.doc_id, coalesce(removed, 0)::int removed_lines, case when coalesce(removed, 0) = 0 then text when regexp_matches(coalesce(kept, ''), '\S') then kept else '' end clean from documents left join r using (doc_id)""",
    "op5_decontaminate": r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') ws from documents), b as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') ws from benchmark),
s as (select doc_id, len(ws) n, ws, unnest(range(0, greatest(0, len(ws) - 4))) p from w), t as (select item_id, len(ws) n, array_to_string(ws[p + 1:p + 5], ' ') g from (select *, unnest(range(0, greatest(0, len(ws) - 4))) p from b)),
i as materialized (select item_id, n, g, count(*) c from t group by all), h as materialized (select s.doc_id, i.item_id, s.p, i.g, i.c, least(s.n, i.n) - 4 m, i.n - 4 k, s.n from s join i on array_to_string(s.ws[s.p + 1:s.p + 5], ' ') = i.g),
q as (select distinct doc_id, item_id, m, k, p0 from (select doc_id, item_id, m, k, n, unnest(range(greatest(0, p - m + 1), least(p, n - 4 - m) + 1)) p0 from h)),
o as (select q.doc_id, q.item_id, q.m, q.k, p0, h.g, least(count(*), any_value(h.c)) common from q join h on h.doc_id = q.doc_id and h.item_id = q.item_id and h.p between p0 and p0 + q.m - 1 group by all),
v as (select doc_id, item_id, p0, m, sum(common) / (any_value(m) + any_value(k) - sum(common))::double similarity from o group by doc_id, item_id, p0, m, k)
select doc_id, item_id, similarity, p0::bigint first_word, (p0 + m + 4)::bigint end_word from v where similarity >= 0.8 - 1e-12 qualify row_number() over (partition by doc_id, item_id order by similarity desc, p0) = 1""",
    "op9_warc": """
with p as (select page_id, encode(coalesce(html, '')) b, sha1(coalesce(html, '')) d from pages), q as (select *, octet_length(b) n, max(page_id) over (partition by d) last from p)
select page_id, n::bigint payload_bytes, d payload_digest, case when n >= 1000 and page_id <> last then 'revisit' else 'response' end record_type, case when n >= 1000 and page_id <> last then last end refers_to, null::varchar problem from q""",
}
