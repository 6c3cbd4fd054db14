"""Registered queries of the library's own operators, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import fixed, shared, text
from docloom.functions.text import sql_literal as lit
from docloom.operators import clinical, hashing, pii, quality, relevance, reports, scrub, similarity, templates, timeline
from docloom.plans import compression
from docloom.sources import files, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
YEAR = 2025


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: length(w) > 0)"
NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '\[.*?\]', '', 'g'), '\d{1,2}/\d{1,2}/\d{2,4}', 'DATE', 'g'))"""


def n_of(pattern: str, col: str = "text") -> str:
    return f"len(regexp_extract_all({col}, {lit(pattern)}))"


def case(classes: list[tuple[str, str]], col: str, other: str) -> str:
    return "case " + " ".join(f"when regexp_matches({col}, {lit('(?i)' + p)}) then {lit(name)}" for name, p in classes) + f" else {lit(other)} end"


# quality


@query(rf"""
with m as (select doc_id, {n_of('[a-zA-Z]')}::double / greatest(length(text), 1) alpha, {n_of(chr(92) + 's')} sp, length(text) n, len({WORDS}) n_words from documents),
p as (select *, sp::double / greatest(n, 1) space, case when n_words > 0 then (n - sp)::double / n_words else 0.0::double end wl from m),
s as (select doc_id, n_words, (case when alpha > 0.5 then 0.3::double else 0.0::double end) + (case when space > 0.1 and space < 0.3 then 0.2::double else 0.0::double end)
  + (case when wl > 3 and wl < 15 then 0.3::double else 0.0::double end) + (case when n_words > 10 then 0.2::double else 0.0::double end) score from p)
select doc_id, n_words, round(score, 6) score, score >= 0.4 passed from s""")
def ocr_quality_gate(spark, sf_dir):
    return quality.gate(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


@query(rf"select doc_id, length(text) chars, len(string_split(text, chr(10))) lines, len({WORDS}) n_words, {n_of(fixed.PLACEHOLDER)} placeholders from documents")
def doc_stats(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(t).alias("chars"), F.size(F.split(t, "\n")).alias("lines"), text.word_count(t).alias("n_words"), F.size(pii.placeholders(t)).alias("placeholders")
    )


GARBAGE_SQL = " or ".join(f"regexp_matches(w, {lit(p)})" for p in fixed.GARBAGE_TOKENS)


@query(rf"""
with t as (select doc_id, unnest({WORDS}) w from documents)
select doc_id, count(*) tokens, count(*) filter (where (length(w) = 1 and not regexp_matches(w, '[a-zA-Z0-9]')) or {GARBAGE_SQL}) garbage from t group by doc_id""")
def garbage_tokens(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("w"))
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(quality.is_garbage(F.col("w"))).alias("garbage"))


@query(r"""
with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) i, regexp_replace(unnest(string_split(text, chr(10))), '\s+$', '') x from documents),
k as (select *, lag(x) over (partition by doc_id order by i) p from l),
c as (select doc_id, string_agg(x, chr(10) order by i) t from k where not (p is not null and x = p and length(x) > 0 and length(x) < 50) group by doc_id)
select doc_id, md5(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) clean_md5 from c""")
def ocr_stutter_clean(spark, sf_dir):
    return quality.clean_stutter(table(spark, sf_dir, "documents")).select("doc_id", F.md5(F.encode("clean", "UTF-8")).alias("clean_md5"))


def words_table(spark, sf_dir):
    """Recognised words made of the line items: an order is a page, a line a word."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("word_idx"), F.when(F.col("l_quantity") > 45, "|||").otherwise(F.col("l_linestatus")).alias("text"),
        (F.col("l_quantity") * 2).alias("confidence"),
        F.struct((F.col("l_linenumber") * 60).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(50.0).alias("width"), F.lit(20.0).alias("height")).alias("bbox"),
    )


@query(r"""
with w as (select l_orderkey doc_id, case when l_quantity > 45 then '|||' else l_linestatus end t, l_quantity * 2 confidence from lineitem),
m as (select doc_id, count(*) n_words, median(confidence) median_confidence, avg(confidence) mean_confidence, min(confidence) min_confidence,
  sum(len(regexp_extract_all(t, '[a-zA-Z]')))::double / sum(length(t)) alpha_ratio, avg(case when t = '|||' then 1.0 else 0.0 end) garbage_ratio from w group by doc_id),
s as (select *, greatest(0.0, least(1.0, 0.5 * median_confidence / 100 + 0.25 * least(alpha_ratio / 0.5, 1.0) - 0.25 * least(garbage_ratio / 0.15, 1.0) - case when n_words < 10 then 0.1 else 0.0 end)) score from m)
select doc_id, n_words, round(median_confidence, 6) median_confidence, round(mean_confidence, 6) mean_confidence, round(min_confidence, 6) min_confidence,
  round(alpha_ratio, 6) alpha_ratio, round(garbage_ratio, 6) garbage_ratio, round(score, 6) score, case when score >= 0.7 then 'HIGH' when score >= 0.4 then 'MEDIUM' else 'LOW' end as level,
  array_to_string(list_filter([case when median_confidence < 60 then 'LOW_CONFIDENCE' end, case when garbage_ratio > 0.15 then 'HIGH_GARBAGE_DENSITY' end, case when alpha_ratio < 0.5 then 'LOW_ALPHA_RATIO' end,
   case when n_words < 10 then 'SPARSE_TEXT' end, case when score < 0.7 then 'NEEDS_MANUAL_REVIEW' end], lambda x: x is not null), ',') flags from s""")
def ocr_word_quality(spark, sf_dir):
    out = quality.word_quality(words_table(spark, sf_dir))
    return out.select("doc_id", "n_words", *[r6(c) for c in ("median_confidence", "mean_confidence", "min_confidence", "alpha_ratio", "garbage_ratio", "score")], "level", F.array_join("flags", ",").alias("flags"))


@query(r"""
with w as (select l_orderkey doc_id, l_linenumber i, l_linenumber * 60 x, l_quantity * 2 c from lineitem where l_quantity * 2 < 50),
g as (select *, case when abs(x - (lag(x) over p + 50)) >= 50 then 1 else 0 end brk from w window p as (partition by doc_id order by i)),
r as (select *, sum(brk) over (partition by doc_id order by i) region from g)
select doc_id, count(*) n_words, region::bigint region, min(x)::double x, max(x + 50)::double "right", round(avg(c), 6) confidence from r where region < 10 group by doc_id, region""".replace("count(*) n_words, ", ""))
def ocr_low_regions(spark, sf_dir):
    return quality.low_regions(words_table(spark, sf_dir)).select("doc_id", "region", "x", "right", r6("confidence"))


# fingerprints


@query(f"select doc_id, sha256({NORM}) content_hash from documents")
def content_hash(spark, sf_dir):
    return hashing.content_hash(table(spark, sf_dir, "documents"))


@query(f"""
with h as (select doc_id, sha256({NORM}) content_hash from documents)
select doc_id, content_hash, min(doc_id) over w first_id, count(*) over w copies, doc_id <> min(doc_id) over w is_duplicate from h window w as (partition by content_hash)""")
def exact_duplicates(spark, sf_dir):
    return hashing.exact_duplicates(table(spark, sf_dir, "documents"))


@query(f"select doc_id, {case(fixed.DOCUMENT_TYPES, 'lower(left(text, 500))', 'unknown')} document_type from documents")
def document_type(spark, sf_dir):
    return hashing.document_type(table(spark, sf_dir, "documents"))


NOTE_SQL = r"""(select l_orderkey * 10 + l_linenumber doc_id, l_orderkey, l_shipdate,
 'Office visit on ' || strftime(l_shipdate, '%m/%d/%Y') || chr(10) || 'WBC ' || (l_quantity::int)::varchar || '.5 x10E3/uL (3.5-11.0)' || chr(10) || 'Glucose: ' || (l_quantity * 4)::int::varchar || ' mg/dL'
 || chr(10) || 'BP: ' || (100 + l_quantity::int)::varchar || '/80 HR 7' || l_linenumber::varchar || chr(10) || 'started metformin ' || (l_quantity::int * 10)::varchar || ' mg PO BID ' || strftime(l_shipdate, '%-m/%-d/%Y')
 || chr(10) || 'Lab results ' || case when l_quantity > 40 then '99/99/2020' else strftime(l_shipdate, '%m/%d/%Y') end as text from lineitem)"""


def notes(spark, sf_dir):
    """A clinical note for each line item."""
    q = F.col("l_quantity").cast("int")
    parts = [
        F.concat(F.lit("Office visit on "), F.date_format("l_shipdate", "MM/dd/yyyy")), F.concat(F.lit("WBC "), q.cast("string"), F.lit(".5 x10E3/uL (3.5-11.0)")),
        F.concat(F.lit("Glucose: "), (F.col("l_quantity") * 4).cast("int").cast("string"), F.lit(" mg/dL")), F.concat(F.lit("BP: "), (q + 100).cast("string"), F.lit("/80 HR 7"), F.col("l_linenumber").cast("string")),
        F.concat(F.lit("started metformin "), (q * 10).cast("string"), F.lit(" mg PO BID "), F.date_format("l_shipdate", "M/d/yyyy")),
        F.concat(F.lit("Lab results "), F.when(F.col("l_quantity") > 40, "99/99/2020").otherwise(F.date_format("l_shipdate", "MM/dd/yyyy"))),
    ]
    items = shared.dealt_out(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity"), "l_orderkey", "l_linenumber")
    return items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), "l_orderkey", "l_shipdate", F.concat_ws("\n", *parts).alias("text"))


@query(f"select doc_id, array_to_string(list_sort(list_distinct(list_concat({', '.join(f'regexp_extract_all(text, {lit(p)})' for p in fixed.DATES)}))), ';') dates from {NOTE_SQL}")
def document_dates(spark, sf_dir):
    return hashing.dates(notes(spark, sf_dir)).select("doc_id", F.array_join(F.array_sort("dates"), ";").alias("dates"))


@query(f"""
with h as (select doc_id, list_filter(string_split({NORM}, ' '), lambda w: length(w) > 2) ws from documents),
w as (select doc_id, unnest(ws) w from h), d as (select distinct w from w),
k as (select w, list_reduce(list_prepend(0::bigint, list_transform(string_split(w, ''), lambda c: ord(c)::bigint)), lambda s, c: (s * 31 + c) & 4294967295) k from d),
v as (select doc_id, b, sum((k >> b) & 1) ones, count(*) n from w join k using (w), range(32) t(b) group by doc_id, b)
select doc_id, sum(case when 2 * ones > n then 1::bigint << b::int else 0 end)::bigint simhash from v group by doc_id
union all select doc_id, 0 from h where len(ws) = 0""")
def simhash(spark, sf_dir):
    return hashing.simhash(table(spark, sf_dir, "documents"))


@query(f"""
with h as (select doc_id, list_filter(string_split({NORM}, ' '), lambda w: length(w) > 2) ws from documents),
w as (select doc_id, unnest(ws) w from h), d as (select distinct w from w),
k as (select w, list_reduce(list_prepend(0::bigint, list_transform(string_split(w, ''), lambda c: ord(c)::bigint)), lambda s, c: (s * 31 + c) & 4294967295) k from d),
v as (select doc_id, b, sum((k >> b) & 1) ones, count(*) n from w join k using (w), range(32) t(b) group by doc_id, b),
s as (select doc_id, sum(case when 2 * ones > n then 1::bigint << b::int else 0 end)::bigint simhash from v group by doc_id union all select doc_id, 0 from h where len(ws) = 0),
p as materialized (select simhash, min(doc_id) doc_id, count(*) docs from s group by simhash)
select least(x.doc_id, y.doc_id) a, greatest(x.doc_id, y.doc_id) b, x.docs + y.docs docs, 'near' relation from p x join p y on x.simhash < y.simhash and bit_count(xor(x.simhash, y.simhash)) = 1
union all select p.doc_id, s.doc_id, p.docs, 'member' from s join p using (simhash)""")
def near_prints(spark, sf_dir):
    return hashing.near_prints(table(spark, sf_dir, "documents"))


@query("""
select o_orderkey doc_id, o_orderdate::date "date", row_number() over (order by o_orderdate::date, o_orderkey) document_number from orders""")
def timeline_order(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("date"))
    return hashing.number_documents(rows).select("doc_id", "date", "document_number")


# personal data


def mention_sql(pattern: str) -> str:
    return f"with m as (select doc_id, regexp_extract_all(text, {lit(pattern)}) v from documents) select doc_id, (generate_subscripts(v, 1) - 1)::int as position, unnest(v) as value from m"


@query(mention_sql(fixed.PII["EMAIL"]))
def pii_mentions_email(spark, sf_dir):
    return pii.mentions(table(spark, sf_dir, "documents"), "EMAIL")


@query(mention_sql(fixed.PII["PHONE"]))
def pii_mentions_phone(spark, sf_dir):
    return pii.mentions(table(spark, sf_dir, "documents"), "PHONE")


@query(mention_sql(fixed.FULL_NAME))
def pii_mentions_name(spark, sf_dir):
    return pii.mentions(table(spark, sf_dir, "documents"), "FULL_NAME", fixed.FULL_NAME)


COUNT_SQL = " union all ".join(f"select doc_id, {lit(k)} kind, {n_of(p)}::bigint n from documents" for k, p in fixed.PII.items() if k not in ("ADDRESS", "CITY_STATE"))


@query(f"select * from ({COUNT_SQL}) where n > 0")
def pii_counts_by_type(spark, sf_dir):
    return pii.counts(table(spark, sf_dir, "documents"))


@query(f"select kind, sum(n)::bigint detections, count(*) documents from ({COUNT_SQL}) where n > 0 group by kind")
def pii_audit(spark, sf_dir):
    return pii.audit(table(spark, sf_dir, "documents"))


@query("select doc_id, " + " or ".join(f"regexp_matches(text, {lit(p)})" for p in fixed.LEFT_OVER.values()) + " might_contain_pii from documents")
def might_contain_pii(spark, sf_dir):
    return pii.might_contain(table(spark, sf_dir, "documents"))


@query("select conv_id, turn, " + ", ".join(f"regexp_matches(text, {lit(fixed.LEFT_OVER[k])}) has_{k}" for k in ("phone", "ssn", "email")) + " from conversations where text is not null")
def assert_scrubbed(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", pii.assert_scrubbed(F.col("text")).alias("f"))
    return found.select("conv_id", "turn", *[F.array_contains("f", k).alias(f"has_{k}") for k in ("phone", "ssn", "email")])


@query()
def pii_scrub(spark, sf_dir):
    return scrub.scrub(table(spark, sf_dir, "documents")).select("doc_id", "text", "count")


@query()
def pii_scrub_worker(spark, sf_dir):
    return scrub.scrub(table(spark, sf_dir, "documents"), "worker").select("doc_id", "text", "count")


@query()
def placeholder_counts(spark, sf_dir):
    return pii.placeholder_counts(scrub.scrub(table(spark, sf_dir, "documents")))


# templates

LINES_SQL = r"""l as (select distinct doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') line from documents)"""


@query(f"with {LINES_SQL} select line, count(*) documents from l where length(line) >= 20 group by line having count(*) >= 3")
def template_line_frequencies(spark, sf_dir):
    return templates.line_frequencies(table(spark, sf_dir, "documents")).where("documents >= 3")


@query(rf"""
with {LINES_SQL}, t as (select line from l where length(line) >= 20 group by line having count(*) >= greatest(2, floor((select count(*) from documents) * 0.005))),
x as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) i, unnest(string_split(text, chr(10))) raw from documents),
k as (select doc_id, string_agg(raw, chr(10) order by i) t from x where regexp_replace(raw, '^\s+|\s+$', '', 'g') not in (select line from t) group by doc_id)
select d.doc_id, md5(coalesce(k.t, '')) text_md5, length(d.text) - length(coalesce(k.t, '')) chars_removed from documents d left join k using (doc_id)""")
def template_strip_lite(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = templates.strip_lines(docs, templates.template_lines(docs, 0.005))
    return out.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "chars_removed")


@query(r"""
with d as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: lower(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))) ls from documents),
g0 as (select doc_id, ls, k::int size, unnest(range(0, greatest(0, len(ls) - k + 1))) at_line from d, range(2, 6) a(k)), g as (select doc_id, size, at_line, array_to_string(ls[at_line + 1:at_line + size], chr(10)) content from g0),
f as (select sha256(content) as "key", size, doc_id, min(at_line) at_line from g where length(regexp_replace(content, '\s+', '', 'g')) >= 10 group by all)
select "key", size, count(*) documents, round(avg(at_line), 6) avg_line, min(doc_id) first_doc from f group by "key", size having count(*) >= 3""")
def template_ngrams(spark, sf_dir):
    return templates.ngrams(table(spark, sf_dir, "documents")).select("key", "size", "documents", r6("avg_line"), "first_doc")


# similarity

SETS_SQL = r"s as (select doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 3)) ws from documents)"


@query(rf"""
with {SETS_SQL}, f as (select doc_id, len(ws) n, list_sort(ws) ws from s where len(ws) > 0),
h as (select min(doc_id) doc_id, n, ws from f group by n, ws),
p as (select a.doc_id a, b.doc_id b, len(list_intersect(a.ws, b.ws)) c, a.n na, b.n nb from h a join h b on a.doc_id < b.doc_id and least(a.n, b.n) >= 0.85 * greatest(a.n, b.n)),
q as (select a, b, c::double / (na + nb - c) similarity from p)
select a, b, round(similarity, 6) similarity from q where similarity >= 0.85
union all select h.doc_id, f.doc_id, 1.0 from f join h using (n, ws) where f.doc_id <> h.doc_id""")
def jaccard_pairs(spark, sf_dir):
    return similarity.jaccard_pairs(table(spark, sf_dir, "documents")).select("a", "b", r6("similarity"))


# A document follows the smallest leader it is like: settled one by one in the order of doc_id.
LEADER_SQL = rf"""
s as materialized (select doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 3))) ws from SOURCE),
f as (select min(doc_id) doc_id, ws, len(ws) n from s where len(ws) > 0 group by ws),
p as materialized (select a.doc_id a, b.doc_id b from f a join f b on a.doc_id < b.doc_id and least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) where len(list_intersect(a.ws, b.ws))::double / (a.n + b.n - len(list_intersect(a.ws, b.ws))) >= 0.85),
o as materialized (select doc_id, row_number() over (order by doc_id) i from f), q as materialized (select b, list(a order by a) before from p group by b),
w(i, leaders, leader, doc_id) as (select 0::bigint, []::bigint[], null::bigint, null::bigint union all
 select w.i + 1, case when len(list_filter(coalesce(q.before, []), lambda x: list_contains(w.leaders, x))) > 0 then w.leaders else list_append(w.leaders, o.doc_id) end,
  coalesce(list_filter(coalesce(q.before, []), lambda x: list_contains(w.leaders, x))[1], o.doc_id), o.doc_id from w join o on o.i = w.i + 1 left join q on q.b = o.doc_id),
l as materialized (select s.doc_id, case when len(s.ws) = 0 then s.doc_id else w.leader end leader_id from s left join f using (ws) left join w on w.doc_id = f.doc_id)"""


@query(f"with recursive {LEADER_SQL.replace('SOURCE', 'documents')} select doc_id, leader_id from l")
def jaccard_leader_dedup(spark, sf_dir):
    return similarity.leaders(table(spark, sf_dir, "documents"))


COS_SQL = "(select a.vec_id a, b.vec_id b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) similarity from embeddings a join embeddings b on a.vec_id < b.vec_id)"


@query(f"select a, b, round(similarity, 6) similarity, case when similarity >= 0.95 then 'DUPLICATE' when similarity >= 0.85 then 'SIMILAR' else 'RELATED' end relationship from {COS_SQL} where similarity >= 0.35")
def cosine_pairs(spark, sf_dir):
    return similarity.cosine_pairs(table(spark, sf_dir, "embeddings"), 0.35).select("a", "b", r6("similarity"), "relationship")


@query(f"""
with recursive e as (select a, b from {COS_SQL} where similarity >= 0.4 union all select b, a from {COS_SQL} where similarity >= 0.4),
r(n, m) as (select vec_id, vec_id from embeddings union select e.a, r.m from r join e on r.n = e.b)
select n vec_id, min(m) "cluster" from r group by n""")
def similarity_clusters(spark, sf_dir):
    return similarity.clusters(table(spark, sf_dir, "embeddings"), 0.4)


@query("with x as (select label, generate_subscripts(embedding, 1) - 1 as dim, unnest(embedding)::double v from embeddings) select label, dim::int dim, round(avg(v), 6) as value from x group by label, dim")
def centroids_mean(spark, sf_dir):
    return similarity.pooled(table(spark, sf_dir, "embeddings"), "label").select("label", "dim", r6("value"))


@query("with x as (select label, generate_subscripts(embedding, 1) - 1 as dim, unnest(embedding)::double v from embeddings) select label, dim::int dim, round(max(v), 6) as value from x group by label, dim")
def centroids_max(spark, sf_dir):
    return similarity.pooled(table(spark, sf_dir, "embeddings"), "label", "max").select("label", "dim", r6("value"))


# clinical


@query(rf"select doc_id, round(case when len({WORDS}) = 0 then 0.0 else ({' + '.join(n_of(p) for p in fixed.MEDICAL_TERMS)}) * 100.0 / len({WORDS}) end, 6) density from {NOTE_SQL}")
def medical_density(spark, sf_dir):
    n = text.word_count(F.col("text"))
    return notes(spark, sf_dir).select("doc_id", F.round(F.coalesce(F.try_divide(text.medical_terms(F.col("text")) * 100.0, n), F.lit(0.0)), 6).alias("density"))


LAB_SQL = " union all ".join(
    f"select doc_id, i line_no, {lit(k)} test, regexp_extract(line, {lit(p)}, 1) raw, coalesce(nullif(regexp_extract(line, {lit(p)}, 2), ''), {lit(u)}) unit, {lo if lo is not None else 'null'}::double lo, {hi if hi is not None else 'null'}::double hi, line from ls"
    for k, (p, lo, hi, u) in fixed.LABS.items()
)
LABS_SQL = rf"""
with ls as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 i, unnest(string_split(text, chr(10))) line from {NOTE_SQL}),
t as ({LAB_SQL}), v as (select *, try_cast(raw as double) as val, upper(regexp_extract(line, {lit(fixed.LAB_FLAG)}, 1)) flag, regexp_extract(line, {lit(fixed.LAB_RANGE)}, 1) r1, regexp_extract(line, {lit(fixed.LAB_RANGE)}, 2) r2 from t where raw <> ''),
labs as (select doc_id, line_no::int line_no, test, val as value, unit, try_cast(r1 as double) ref_low, try_cast(r2 as double) ref_high,
 case when flag in ('H', 'HIGH') then 'HIGH' when flag in ('L', 'LOW') then 'LOW' when flag in ('HH', 'CRIT') then 'CRITICAL_HIGH' when flag = 'LL' then 'CRITICAL_LOW' when lo is null then 'UNKNOWN'
  when val < lo * 0.5 then 'CRITICAL_LOW' when val > hi * 2 then 'CRITICAL_HIGH' when val < lo then 'LOW' when val > hi then 'HIGH' else 'NORMAL' end status,
 (80 + case when unit <> '' then 10 else 0 end + case when r1 <> '' then 10 else 0 end) / 100.0::double confidence from v where val is not null)"""


@query(LABS_SQL + " select * from labs")
def labs_v2(spark, sf_dir):
    return clinical.labs(notes(spark, sf_dir))


@query(LABS_SQL + """ select doc_id, case when bool_or(test in ('WBC', 'RBC', 'HGB', 'PLT')) then 'CBC' when bool_or(test in ('SODIUM', 'POTASSIUM', 'BUN', 'CREATININE')) then 'BMP'
 when bool_or(test in ('AST', 'ALT', 'ALP', 'BILIRUBIN')) then 'LFT' else 'General' end panel, count(*) tests, count(*) filter (where status not in ('NORMAL', 'UNKNOWN')) abnormal from labs group by doc_id""")
def lab_panels(spark, sf_dir):
    return clinical.panels(clinical.labs(notes(spark, sf_dir)))


def lab_history(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("patient"), F.lit("WBC").alias("test"), F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("value"))


@query(r"""
with s as (select l_orderkey patient, l_shipdate d, l_quantity v, abs(l_quantity - lag(l_quantity) over (partition by l_orderkey order by l_shipdate, l_quantity)) swing from lineitem),
g as (select patient, count(*) points, (list(v order by d, v))[1] first_v, (list(v order by d desc, v desc))[1] last_v, max(swing) swing from s group by patient)
select patient, 'WBC' test, points, first_v as "first", last_v as "last", case when points < 2 then 'INSUFFICIENT_DATA' when swing > 1.5 * abs(last_v - first_v) then 'FLUCTUATING'
 when abs((last_v - first_v) / first_v) < 0.05 then 'STABLE' when last_v > first_v then 'INCREASING' else 'DECREASING' end trend from g""")
def lab_trends(spark, sf_dir):
    return clinical.trends(lab_history(spark, sf_dir))


@query(r"""
select l_orderkey patient, l_linenumber line, l_quantity as value, lag(l_quantity) over w previous, round((l_quantity - lag(l_quantity) over w) / lag(l_quantity) over w * 100, 6) change_pct
from lineitem window w as (partition by l_orderkey order by l_linenumber, l_shipdate, l_quantity)""")
def prev_panel_trend(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("patient"), F.lit("WBC").alias("test"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("day"), F.col("l_quantity").alias("value"))
    return timeline.previous(rows, "patient", "line", "day", "value").select("patient", "line", "value", "previous", r6("change_pct"))


@query(rf"""select doc_id, least({n_of(r'(?i)\b(?:diagnos|assessment|impression|A\/P)')}, 10) diagnoses, least({n_of(r'(?i)\b(?:mg|mcg|tablet|capsule|PO|IV)\b')} / 2.0::double, 20.0) medications,
 {n_of(r'(?i)\b(?:WBC|HGB|PLT|Na|K|Cr|BUN|glucose)\b')} labs, least({n_of(r'\b(?:H|L|HIGH|LOW|CRIT)\b')}, {n_of(r'(?i)\b(?:WBC|HGB|PLT|Na|K|Cr|BUN|glucose)\b')}) abnormal_labs from {NOTE_SQL}""")
def extraction_counts(spark, sf_dir):
    return clinical.lite_counts(notes(spark, sf_dir))


@query(rf"""select doc_id, left(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S') and (regexp_matches(x, '(?i)\b(?:diagnos|assessment|impression|medication|lab|vital|finding)')
 or regexp_matches(x, '(?i)\b(?:WBC|HGB|BP|HR|mg|mcg)\b')))[1:10], chr(10)), 1000) narrative from {NOTE_SQL}""")
def narrative_lite(spark, sf_dir):
    return clinical.lite_narrative(notes(spark, sf_dir))


# relevance


def relevance_sql(source: str) -> str:
    terms = lambda ts: "[" + ", ".join(map(lit, ts)) + "]"
    n = {k: f"len(list_filter({terms(ts)}, lambda t: contains(lower(text), t)))" for k, (_, ts) in fixed.CLINICAL.items()}
    refs = " + ".join(f"n_{k} * {w}" for k, (w, _) in fixed.CLINICAL.items())
    return rf"""
with c as (select doc_id, {', '.join(f'{v} n_{k}' for k, v in n.items())}, len(list_filter({terms(fixed.ADMINISTRATIVE)}, lambda t: contains(lower(text), t))) > 0 administrative,
 length(regexp_replace(text, '\s+', '', 'g')) solid, length(array_to_string(regexp_extract_all(text, {lit(fixed.PLACEHOLDER)}), '')) held, len({WORDS}) n_words from {source}),
d as (select *, {refs} clinical_references, case when solid = 0 then 1.0 else held::double / solid end placeholder_density from c),
e as (select *, case when n_words = 0 then 0.0 else least(1.0, clinical_references * 1.5::double / n_words) end medical_density from d),
f as (select *, greatest(0.0, least(100.0, 50 - case when placeholder_density > 0.6 then 40 when placeholder_density > 0.4 then 25 when placeholder_density > 0.2 then 10 else 0 end + medical_density * 50 + least(30, clinical_references * 2)
 + case when n_diagnoses > 0 then 10 else 0 end + case when n_procedures > 0 then 10 else 0 end + case when n_outcomes > 0 then 15 else 0 end + case when n_lab_vitals > 0 then 8 else 0 end + case when n_treatments > 0 then 7 else 0 end
 - case when administrative then 50 else 0 end)) score from e)"""


@query(relevance_sql("documents") + " select doc_id, round(score, 6) score, round(placeholder_density, 6) placeholder_density, round(medical_density, 6) medical_density, clinical_references::bigint clinical_references, administrative, case when administrative then 'discard' when score >= 60 then 'keep' when score >= 30 then 'demote' else 'discard' end recommendation from f")
def relevance_score(spark, sf_dir):
    out = relevance.relevance(table(spark, sf_dir, "documents"), YEAR)
    return out.select("doc_id", r6("score"), r6("placeholder_density"), r6("medical_density"), F.col("clinical_references").cast("bigint").alias("clinical_references"), "administrative", "recommendation")


@query(relevance_sql(NOTE_SQL) + " select doc_id, case when administrative then 'discarded' when score >= 60 then 'kept' when score >= 30 then 'demoted' else 'discarded' end bucket from f")
def relevance_buckets(spark, sf_dir):
    return relevance.buckets(notes(spark, sf_dir), YEAR)


# events

EVENT_SQL = rf"""
with a as (select doc_id, list_concat({', '.join(f"list_transform(regexp_extract_all(text, {lit(p)}, 1), lambda d: struct_pack(t := {lit(k)}, c := {lit(c)}, raw := d))" for k, c, p in timeline.EVENTS)}) es from {NOTE_SQL}),
b as (select doc_id, (generate_subscripts(es, 1) - 1)::int idx, unnest(es) e from a),
x as (select doc_id, idx, e.t as type, e.c as confidence, e.raw as raw, try_strptime(e.raw, '%m/%d/%Y')::date as "date" from b),
ev as (select * from x where year("date") between 1900 and 2100)"""


@query(EVENT_SQL + ' select doc_id, idx, type, confidence, "date", (month("date") <= 12 and day("date") <= 12 and month("date") <> day("date")) ambiguous from ev')
def events_extract(spark, sf_dir):
    return timeline.events(notes(spark, sf_dir))


@query(EVENT_SQL + " select doc_id, 'ParseError' tag, 'not a date: ' || raw message, true recoverable from x where \"date\" is null")
def event_errors(spark, sf_dir):
    return timeline.date_errors(notes(spark, sf_dir))


DEDUP_SQL = EVENT_SQL + ', r as (select *, row_number() over (partition by "date", type order by doc_id, idx) n, count(*) over (partition by "date", type) merged from ev), dd as (select "date", type, doc_id, idx, confidence, merged from r where n = 1)'


@query(DEDUP_SQL + " select * from dd")
def events_dedup(spark, sf_dir):
    return timeline.deduplicate(timeline.events(notes(spark, sf_dir)))


@query(DEDUP_SQL + " select * from dd order by case confidence when 'high' then 3 else 2 end desc, \"date\" desc, doc_id, idx limit 50")
def events_compress(spark, sf_dir):
    return timeline.compress(timeline.deduplicate(timeline.events(notes(spark, sf_dir))), 5.0)


@query(EVENT_SQL + ' select type, count(*) events, min("date") first_date, max("date") last_date from ev group by type')
def timeline_summary(spark, sf_dir):
    return timeline.summary(timeline.events(notes(spark, sf_dir)))


PATIENT_SQL = EVENT_SQL + ", y as (select doc_id // 10 patient, *, row_number() over (partition by doc_id order by idx, \"date\", type) - 1 n from ev)"


@query(PATIENT_SQL + """
select patient, 1 as section, "date", doc_id, idx, concat_ws(chr(10), '  - id: ' || doc_id || '-' || type || '-' || n, '    date: ' || strftime("date", '%Y-%m-%d'), '    type: ' || type, '    source: ' || doc_id, '    confidence: ' || confidence) yaml from y
union all
select patient, 0, min("date"), min(doc_id), -1, concat_ws(chr(10), 'patient:', '  id: ' || patient, '', 'dateRange:', '  start: ' || strftime(min("date"), '%Y-%m-%d'), '  end: ' || strftime(max("date"), '%Y-%m-%d'),
  '  durationDays: ' || date_diff('day', min("date"), max("date")), '', 'totalDocuments: ' || count(distinct doc_id), 'totalEvents: ' || count(*), 'estimatedBytes: ' || (count(*) * 200 + 1024), '', 'timeline:') from y group by patient""")
def yaml_timeline(spark, sf_dir):
    found = timeline.events(notes(spark, sf_dir)).withColumn("patient", F.expr("doc_id div 10"))
    return sinks.yaml_timeline(found, "patient")


# files and documents


@query(r"""
with f as (select page_id, 'C:\docs\' || regexp_replace(url, '^https?://', '') filename from pages),
n as (select page_id, left(regexp_replace(regexp_replace(filename, '^.*[/\\]', ''), '\.{2,}', '.', 'g'), 180) as name from f)
select page_id, name, nullif(lower(regexp_extract(name, '^.+\.([^.]+)$', 1)), '') extension, case when name = '' then 'EMPTY_NAME' else array_to_string(list_filter([case when length(name) < 3 then 'NAME_TOO_SHORT' end,
 case when regexp_matches(name, '[<>:"|?*]') then 'INVALID_CHARS' end, case when not regexp_matches(name, '^.+\.([^.]+)$') then 'MISSING_EXTENSION' end,
 case when regexp_matches(name, '^.+\.([^.]+)$') and lower(regexp_extract(name, '^.+\.([^.]+)$', 1)) not in ('pdf', 'docx', 'png', 'jpg', 'jpeg', 'webp', 'txt', 'csv', 'json', 'md') then 'EXT_NOT_ALLOWED' end], lambda x: x is not null), ',') end issues from n""")
def file_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("C:\\docs\\"), F.regexp_replace("url", "^https?://", "")).alias("filename"), F.lit("text/plain").alias("mime"), F.lit(1).alias("size"))
    return files.validate(rows).select("page_id", "name", "extension", F.array_join("issues", ",").alias("issues"))


@query()
def html_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.html_to_markdown("html").alias("markdown"))


@query(r"""
with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) i, regexp_replace(unnest(string_split(text, chr(10))), '\s+$', '') x from documents),
k as (select *, lag(x) over (partition by doc_id order by i) p from l),
c as (select doc_id, string_agg(x, chr(10) order by i) t from k where not (p is not null and x = p and length(x) > 0 and length(x) < 50) group by doc_id)
select doc_id, '---' || chr(10) || 'source_file: "' || doc_id || '"' || chr(10) || 'language: "' || lang || '"' || chr(10) || 'characters: "' || length(text) || '"' || chr(10) || '---' || chr(10) || chr(10) || '# Document Extraction' || chr(10) || chr(10)
 || regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || '---' || chr(10)
 || '*CONFIDENTIALITY NOTICE: This document has been automatically scrubbed of PII. Original entities replaced: 0.*' markdown from c join documents using (doc_id)""")
def markdown_doc(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fields = {"source_file": F.col("doc_id"), "language": F.col("lang"), "characters": F.length("text")}
    return sinks.markdown(docs, fields, F.lit(0))


@query("""with c as (select doc_id, text, greatest(0, ceil((length(text) - 512) / 462.0))::int m from documents),
e as (select doc_id, text, unnest(range(0, m + 1)) k from c) select doc_id, k::int k, md5(substring(text, k * 462 + 1, 512)) chunk_md5 from e""")
def chunk_text(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"), 512, 50)).alias("k", "chunk"))
    return each.select("doc_id", "k", F.md5(F.encode("chunk", "UTF-8")).alias("chunk_md5"))


# the compression pipeline


QUALITY_SQL = rf"""m as (select doc_id, text, {n_of('[a-zA-Z]')}::double / greatest(length(text), 1) alpha, {n_of(chr(92) + 's')} sp, length(text) n, len({WORDS}) n_words from documents),
g as materialized (select doc_id, text, (case when alpha > 0.5 then 0.3::double else 0.0::double end) + (case when sp::double / greatest(n, 1) > 0.1 and sp::double / greatest(n, 1) < 0.3 then 0.2::double else 0.0::double end)
 + (case when n_words > 0 and (n - sp)::double / n_words > 3 and (n - sp)::double / n_words < 15 then 0.3::double else 0.0::double end) + (case when n_words > 10 then 0.2::double else 0.0::double end) score from m)"""
FACTS_SQL = f"least({n_of(fixed.LITE_DIAGNOSIS)}, 10) diagnoses, least({n_of(fixed.LITE_MEDICATION)} / 2.0::double, 20.0) medications, {n_of(fixed.LITE_LAB)} labs, least({n_of(fixed.LITE_FLAG)}, {n_of(fixed.LITE_LAB)}) abnormal_labs"
TOLD_SQL = rf"""left(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S') and (regexp_matches(x, {lit(fixed.LITE_KEYS[0])}) or regexp_matches(x, {lit(fixed.LITE_KEYS[1])})))[1:10], chr(10)), 1000) narrative"""
COMPRESSION_SQL = rf"""with recursive {QUALITY_SQL},
v as (select * from g where score >= 0.4), tl as (select distinct doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') line from v),
tt as materialized (select line from tl where length(line) >= 20 group by line having count(*) >= greatest(2, floor((select count(*) from v) * 0.5))),
tx as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) i, unnest(string_split(text, chr(10))) raw from v),
lv as materialized (select v.doc_id, coalesce(string_agg(raw, chr(10) order by i) filter (where regexp_replace(raw, '^\s+|\s+$', '', 'g') not in (select line from tt)), '') as text from v join tx using (doc_id) group by v.doc_id),
{LEADER_SQL.replace('SOURCE', 'lv')},
k as (select lv.doc_id, nullif(leader_id, lv.doc_id) duplicate_of, length(text) kept_chars, {FACTS_SQL}, {TOLD_SQL} from lv join l using (doc_id)),
r as (select g.doc_id, length(text)::int original_chars, score, score >= 0.4 passed, duplicate_of, case when duplicate_of is null then kept_chars end::int kept_chars, case when duplicate_of is null then diagnoses end::int diagnoses,
 case when duplicate_of is null then medications end medications, case when duplicate_of is null then labs end::int labs, case when duplicate_of is null then abnormal_labs end::int abnormal_labs, case when duplicate_of is null then narrative end narrative from g left join k using (doc_id)),
z as (select *, coalesce(nullif(kept_chars, 0), case when passed and duplicate_of is null then original_chars else 0 end)::int final_chars from r)"""


@query(COMPRESSION_SQL + " select doc_id, original_chars, round(score, 6) quality, passed, duplicate_of::double duplicate_of, kept_chars::double kept_chars, diagnoses::double diagnoses, medications, labs::double labs, abnormal_labs::double abnormal_labs, md5(narrative) narrative_md5, final_chars from z")
def compression_documents(spark, sf_dir):
    out = compression.run(table(spark, sf_dir, "documents"))
    whole = {c: F.col(c).cast("double") for c in ("duplicate_of", "kept_chars", "diagnoses", "labs", "abnormal_labs")}
    return out.withColumns({"quality": F.round("quality", 6), "narrative_md5": F.md5(F.encode("narrative", "UTF-8"))} | whole).drop("narrative")


@query(COMPRESSION_SQL + """ select count(*) documents, count(*) filter (where final_chars > 0) successful, count(*) filter (where final_chars = 0) failed, count(*) filter (where passed) passed, count(duplicate_of) duplicates,
 sum(original_chars)::bigint original_chars, sum(kept_chars)::bigint output_chars, sum(length(narrative))::bigint narrative_chars, sum(diagnoses)::bigint diagnoses, sum(medications) medications, sum(labs)::bigint labs, sum(abnormal_labs)::bigint abnormal_labs,
 round(1 - (case when sum(length(narrative)) > 0 then sum(length(narrative)) else sum(kept_chars) end)::double / sum(original_chars), 6) ratio from z""")
def compression_totals(spark, sf_dir):
    return compression.totals(compression.run(table(spark, sf_dir, "documents"))).withColumn("ratio", F.round("ratio", 6))


@query(f"""with {QUALITY_SQL} select doc_id, length(text)::int original_chars, case when score >= 0.4 then length(text) else 0 end::int final_chars, round(score, 6) quality, score >= 0.4 passed,
 case when score >= 0.4 then least({n_of(fixed.LITE_DIAGNOSIS)}, 10) + least({n_of(fixed.LITE_MEDICATION)} / 2.0::double, 20.0) + {n_of(fixed.LITE_LAB)} end extractions,
 case when score < 0.4 then 'OCR quality too low: ' || printf('%.0f', score * 100) || '%' when score < 0.6 then 'Low OCR quality: ' || printf('%.0f', score * 100) || '%' else '' end warnings from g""")
def compression_single(spark, sf_dir):
    out = compression.single(table(spark, sf_dir, "documents")).drop("narrative")
    return out.withColumns({"quality": F.round("quality", 6), "warnings": F.array_join("warnings", ",")})


@query(f"""with {QUALITY_SQL} select 'OCR_QUALITY' stage, 'OCR Quality Gate' title, count(*) documents_in, count(*) filter (where score >= 0.4) documents_out, count(*) filter (where score < 0.4) left_out from g
union all select 'NARRATIVE_GENERATION', 'Narrative Generation', count(*), count(*), 0 from g""")
def compression_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return compression.stage("OCR_QUALITY", docs).union(compression.stage("NARRATIVE_GENERATION", docs))


@query("select 0.7::double ratio, floor(sum(length(text)) * (1 - 0.7::double) + 0.5)::bigint output_chars from documents")
def compression_estimate(spark, sf_dir):
    return compression.estimate(table(spark, sf_dir, "documents"))


# records of reports

REPORT_SQL = r"""(select p_partkey doc_id, case p_size % 4
 when 0 then 'Radiology MRI of the ' || case p_partkey % 3 when 0 then 'knee' when 1 then 'hip' else 'brain' end || chr(10) || 'Impression: mass measuring ' || p_size::varchar || ' mm' || chr(10) || 'DOB: 01/02/1980 seen'
 when 1 then 'Biopsy' || chr(10) || 'Specimen: skin number ' || p_partkey::varchar || chr(10) || 'Final Diagnosis: melanoma in situ' || chr(10) || 'PTNM: T' || (p_size % 5)::varchar || chr(10) || 'Margins: ' || case p_partkey % 3 when 0 then 'clear' when 1 then 'involved' else 'close' end
 when 2 then 'Discharge instructions BP: 1' || (10 + p_size)::varchar || '/80 HR 7' || (p_partkey % 10)::varchar || ' Temp: 98.6 F Weight: 180 lb Pain: ' || (p_partkey % 14)::varchar || '/10'
 else 'Lab panel WBC 7.5 on 3/' || (1 + p_partkey % 28)::varchar || '/2024' end as text from part)"""


def report_notes(spark, sf_dir):
    """A report for each part."""
    s, k = F.col("p_size"), F.col("p_partkey")
    pick = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    join = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    body = (
        F.when(s % 4 == 0, join("Radiology MRI of the ", pick("knee", "hip", "brain"), "\nImpression: mass measuring ", s, " mm\nDOB: 01/02/1980 seen"))
        .when(s % 4 == 1, join("Biopsy\nSpecimen: skin number ", k, "\nFinal Diagnosis: melanoma in situ\nPTNM: T", s % 5, "\nMargins: ", pick("clear", "involved", "close")))
        .when(s % 4 == 2, join("Discharge instructions BP: 1", s + 10, "/80 HR 7", k % 10, " Temp: 98.6 F Weight: 180 lb Pain: ", k % 14, "/10"))
        .otherwise(join("Lab panel WBC 7.5 on 3/", k % 28 + 1, "/2024"))
    )
    return shared.dealt_out(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(k.alias("doc_id"), body.alias("text"))


def first(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(text, {lit(pattern)}, {group}), '')"


@query(
    f"select doc_id, case when regexp_matches(text, {lit(fixed.REPORT_LAB)}) and regexp_matches(text, {lit('(?i)' + '|'.join(fixed.REPORT_TESTS))}) then 'lab_report' else "
    f"{case(fixed.REPORT_CLASSES, 'text', 'unknown')} end report_class from {REPORT_SQL}"
)
def report_class(spark, sf_dir):
    return reports.classes(report_notes(spark, sf_dir))


@query(f"select doc_id, {first(fixed.RECORD_DATES[0], 0)} report_date from (select doc_id, regexp_replace(text, 'DOB: [0-9/]+', '') as text from {REPORT_SQL})")
def report_dates(spark, sf_dir):
    return reports.dates(report_notes(spark, sf_dir))


@query(f"""
with x as (select doc_id, {case(fixed.REPORT_MODALITIES, 'text', 'other')} modality, coalesce({', '.join(map(first, fixed.BODY_PARTS))}, 'unspecified') body_part,
 list_filter(list_transform(list_concat(regexp_extract_all(text, {lit('(?i)(?:Findings?|Impression|Conclusion)[:' + chr(92) + 's]*([^' + chr(92) + 'n]+)')}, 1),
 {', '.join(f'regexp_extract_all(text, {lit(p)}, 1)' for p in fixed.FINDINGS[1:2])}, {f'regexp_extract_all(text, {lit(fixed.FINDINGS[2])}, 1)'}), lambda f: trim(f)), lambda f: length(f) > 10) f,
 {first(fixed.IMPRESSION + '[:' + chr(92) + 's]*([^' + chr(92) + 'n]+)')} impression from {REPORT_SQL})
select doc_id, modality, body_part, array_to_string(f[1:10], ';') findings, impression from x where len(f) > 0 or impression is not null""")
def report_imaging(spark, sf_dir):
    return reports.imaging(report_notes(spark, sf_dir)).withColumn("findings", F.array_join("findings", ";"))


@query(f"""
with x as (select doc_id, {', '.join(f'{first(p, g)}::double as {name}' for name, p, g in fixed.REPORT_VITALS)}, {first(fixed.REPORT_VITALS[4][1], 2)} tu, {first(fixed.REPORT_VITALS[6][1], 2)} wu from {REPORT_SQL})
select * exclude (tu, wu, pain), case when pain <= 10 then pain end pain, case when temperature is not null then case when lower(tu) like '%c%' then 'C' else 'F' end end temperature_unit,
 case when weight is not null then case when lower(wu) like 'k%' then 'kg' else 'lb' end end weight_unit from x
where coalesce({', '.join(name for name, _, _ in fixed.REPORT_VITALS)}) is not null""")
def report_vitals(spark, sf_dir):
    return reports.vital_signs(report_notes(spark, sf_dir))


@query(f"""
select doc_id, coalesce({first(fixed.PATHOLOGY['specimen_type'])}, 'unspecified') specimen_type, {first(fixed.PATHOLOGY_DIAGNOSIS + '[:' + chr(92) + 's]*([^' + chr(92) + 'n]+)')} diagnosis,
 {first(fixed.PATHOLOGY['grade'])} grade, {first(fixed.PATHOLOGY['stage'])} stage,
 case lower({first(fixed.PATHOLOGY['margins'])}) {' '.join(f"when {lit(k)} then {lit(v)}" for k, v in fixed.MARGINS.items())} end margins
from {REPORT_SQL} where regexp_matches(text, {lit(fixed.PATHOLOGY_DIAGNOSIS)})""")
def report_pathology(spark, sf_dir):
    return reports.pathology(report_notes(spark, sf_dir))


# vectors


@query("""
with x as (select vec_id, label, generate_subscripts(embedding, 1) i, unnest(embedding)::double v from embeddings), c as (select label, i, avg(v) m from x group by label, i)
select vec_id, label, round(sqrt(sum((v - m) * (v - m))), 6) distance from x join c using (label, i) group by vec_id, label""")
def euclidean_distances(spark, sf_dir):
    """Each vector's distance to the centroid of its label."""
    v = table(spark, sf_dir, "embeddings")
    each = similarity.pooled(v, "label").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("centroid"))
    return v.join(each, "label").select("vec_id", "label", F.round(similarity.euclidean(F.col("embedding"), F.col("centroid")), 6).alias("distance"))


@query(f"""
with recursive e as (select a, b from {COS_SQL} where similarity >= 0.4 union all select b, a from {COS_SQL} where similarity >= 0.4),
r(n, m) as (select vec_id, vec_id from embeddings union select e.a, r.m from r join e on r.n = e.b), c as (select n, min(m) c from r group by n), g as (select c, count(*) k from c group by c)
select sum(k)::bigint as total, count(*) as unique_rows, count(*) filter (where k = 1) singletons, (sum(k) - count(*))::bigint removed, round((sum(k) - count(*)) / sum(k)::double, 6) reduction from g""")
def dedup_stats(spark, sf_dir):
    return similarity.statistics(similarity_clusters(spark, sf_dir)).withColumn("reduction", F.round("reduction", 6))


from docloom import catalog_records, catalog_timelines  # noqa: E402, F401  they register further queries
