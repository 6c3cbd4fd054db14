"""Registered queries of timelines, template corpora, semantic deduplication, pages and sinks, and the SQL that gives the same rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.catalog import COS_SQL, NORM, case, query, r6, table
from docloom.functions import errors, fixed
from docloom.functions.text import sql_literal as lit
from docloom.operators import corpus, hashing, master, scrub, semantic, similarity
from docloom.sources import pages, sinks

AS_OF = datetime.date(2025, 6, 1)

# the master timeline

FILES = """(select doc_id, text, case doc_id % 4 when 0 then 'scan_' || strftime(d, '%m-%d-%Y') || '.pdf' when 1 then 'note ' || strftime(d, '%Y/%m/%d') when 2 then 'visit ' || strftime(d, '%b %-d, %Y') else 'letter 13/45/2024' end filename
 from (select *, date '2024-01-01' + (doc_id % 45)::int d from documents) where length(text) > 0)"""


def files(spark, sf_dir) -> DataFrame:
    """The documents as files whose names have dates of several forms, or none."""
    d = F.date_add(F.lit(datetime.date(2024, 1, 1)), (F.col("doc_id") % 45).cast("int"))
    name = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("scan_"), F.date_format(d, "MM-dd-yyyy"), F.lit(".pdf"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("note "), F.date_format(d, "yyyy/MM/dd")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("visit "), F.date_format(d, "MMM d, yyyy"))).otherwise("letter 13/45/2024")
    )
    return table(spark, sf_dir, "documents").select("doc_id", "text", name.alias("filename"))


def written(col: str) -> str:
    """The first date of a text."""
    out = []
    for k, p in enumerate(fixed.PRIMARY_DATES):
        a, b, c = (f"regexp_extract({col}, {lit(p)}, {g})" for g in (1, 2, 3))
        month = "(list_position(['" + "', '".join(master.MONTHS) + f"'], lower({a})))" if k == 2 else f"try_cast({b if k == 1 else a} as int)"
        day, year = f"try_cast({c if k == 1 else b} as int)", f"try_cast({a if k == 1 else c} as int)"
        out.append(f"case when {month} between 1 and 12 and {day} between 1 and 31 and {year} >= 1 then make_date({year}, {month}, 1) + ({day} - 1) end")
    return "coalesce(" + ", ".join(out) + ")"


PRINTS = f"""h as (select doc_id, list_filter(string_split({NORM}, ' '), lambda w: length(w) > 2) ws from f),
wd as (select doc_id, unnest(ws) w from h), di as (select distinct w from wd),
k as (select w, list_reduce(list_prepend(0::bigint, list_transform(string_split(w, ''), lambda c: ord(c)::bigint)), lambda s, c: (s * 31 + c) & 4294967295) k from di),
vo as (select doc_id, b, sum((k >> b) & 1) ones, count(*) n from wd join k using (w), range(32) t(b) group by doc_id, b),
pr as (select doc_id, sum(case when 2 * ones > n then 1::bigint << b::int else 0 end)::bigint simhash from vo group by doc_id union all select doc_id, 0 from h where len(ws) = 0)"""
MASTER = f"""f as materialized (select *, coalesce({written('filename')}, {written('left(text, 500)')}) written from {FILES}), {PRINTS},
m as materialized (select doc_id, filename, coalesce(written, date '{AS_OF}') "date", written is not null dated, sha256({NORM}) content_hash, simhash, {case(fixed.DOCUMENT_TYPES, "lower(filename || ' ' || left(text, 500))", 'unknown')} document_type,
 row_number() over (order by coalesce(written, date '{AS_OF}'), doc_id) document_number from f join pr using (doc_id)),
p as (select a.document_number, b.document_number other_number, b.content_hash other_hash, a.content_hash = b.content_hash same, 1 - 2 * bit_count(xor(a.simhash, b.simhash)) / 64.0::double sim,
 a.document_type = b.document_type and abs(date_diff('day', a."date", b."date")) <= 3 event from m a join m b on b.document_number < a.document_number),
q as (select * from p where same or sim >= 0.95 or (event and sim >= 0.7) qualify row_number() over (partition by document_number order by other_number) = 1),
du as materialized (select q.document_number, other_number, (select min(document_number) from m where content_hash = q.other_hash) original_number, case when same then 1.0 else sim end similarity,
 case when same then 'exact' when sim >= 0.95 then 'near-duplicate' else 'same-event' end difference from q)"""


@query(f'with {MASTER} select doc_id, document_number, filename, "date", dated, content_hash, simhash, document_type from m')
def master_documents(spark, sf_dir):
    return master.documents(files(spark, sf_dir), AS_OF).drop("text")


@query(f"with {MASTER} select document_number, other_number, original_number, round(similarity, 6) similarity, difference from du")
def master_duplicates(spark, sf_dir):
    found = master.duplicates(similarity.shared_table(master.documents(files(spark, sf_dir), AS_OF)))
    return found.select("document_number", "other_number", "original_number", r6("similarity"), "difference")


@query(f"""with {MASTER} select count(*) total_documents, count(*) - (select count(*) from du where difference <> 'same-event') unique_documents, (select count(*) from du where difference <> 'same-event') duplicates,
 min("date") earliest, max("date") latest from m""")
def master_summary(spark, sf_dir):
    docs = similarity.shared_table(master.documents(files(spark, sf_dir), AS_OF))
    return master.summary(docs, master.duplicates(docs))


@query(f"with {MASTER} select document_type, count(*) documents, min(document_number) first_number from m group by document_type")
def master_types(spark, sf_dir):
    return master.types(master.documents(files(spark, sf_dir), AS_OF))


SIGNS = "case document_type " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in fixed.TYPE_SIGNS.items()) + " else '📄' end"
TYPE_NAME = "array_to_string(list_transform(string_split(document_type, '_'), lambda w: upper(left(w, 1)) || w[2:]), ' ')"


@query(f"""with {MASTER}, x as (select m.*, original_number, similarity, difference, f.text, string_split(f.text, chr(10)) ls from m join f using (doc_id) left join du using (document_number))
select document_number, md5(case when difference in ('exact', 'near-duplicate') then '### [DUPLICATE] ' || strftime("date", '%m/%d/%Y') || ' | ' || filename || chr(10) || '⚠️ This document is a ' || difference || ' of document #' || original_number
 || ' (' || printf('%.1f', similarity * 100) || '% similar). Content omitted to reduce redundancy.' || chr(10)
 else '### ' || {SIGNS} || ' ' || strftime("date", '%m/%d/%Y') || ' | ' || filename || chr(10) || '**Document #' || document_number || '** | Type: ' || {TYPE_NAME} || ' | Hash: `' || left(content_hash, 8) || '`'
 || case when difference = 'same-event' then chr(10) || '> 🔗 **Related**: This document appears to reference the same clinical encounter as document #' || original_number || ' but contains different information.' || chr(10) else '' end
 || chr(10) || chr(10) || case when len(ls) > 50 then array_to_string(ls[1:50], chr(10)) || chr(10) || chr(10) || chr(10) || '> ⚠️ **Content truncated** - ' || (len(ls) - 50) || ' additional lines omitted for readability.' || chr(10) else text || chr(10) end
 || chr(10) || chr(10) || '---' || chr(10) end) markdown_md5 from x where document_type <> 'lab_report'""")
def master_markdown(spark, sf_dir):
    """Sections of documents that are no laboratory reports."""
    docs = similarity.shared_table(master.documents(files(spark, sf_dir), AS_OF))
    rows = master.markdown(docs).where("section = 1").join(docs.where("document_type <> 'lab_report'").select("document_number"), "document_number")
    return rows.select("document_number", F.md5(F.encode("markdown", "UTF-8")).alias("markdown_md5"))


@query(f"""with f as (select doc_id, text, 'file ' || doc_id || '.txt' filename from documents where text is not null), {PRINTS}
select doc_id, sha256({NORM}) content_hash, simhash, len(string_split_regex(text, '\\s+'))::int word_count, {case(fixed.DOCUMENT_TYPES, "lower(filename || ' ' || left(text, 500))", 'unknown')} document_type from f join pr using (doc_id)""")
def fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("filename", F.concat(F.lit("file "), F.col("doc_id").cast("string"), F.lit(".txt")))
    return hashing.fingerprints(docs, "filename").drop("dates")


# the corpus of templates

CFG = corpus.Config(share=0.004)
TEMPLATES = rf"""d as (select doc_id, string_split(coalesce(text, ''), chr(10)) raw, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))) ls from documents),
g0 as (select doc_id, ls, raw, k::int size, unnest(range(0, greatest(0, len(ls) - k + 1)))::int pos from d, range(2, 6) t(k)),
g as materialized (select doc_id, size, pos, array_to_string(ls[pos + 1:pos + size], chr(10)) content, array_to_string(raw[pos + 1:pos + size], chr(10)) original from g0),
r as materialized (select doc_id, size, pos, content, original from g where length(regexp_replace(content, '\s', '', 'g')) >= 10),
o as (select content, size, doc_id, min(pos) pos from r group by all), n as (select count(*) n, avg(len(raw)) lines from d),
c as (select content, size, count(*) documents, avg(pos) average, min(doc_id) first_doc from o group by all having count(*) >= greatest(3, floor((select n from n) * {CFG.share}))),
e as materialized (select c.*, o.pos, (select original from r where r.doc_id = first_doc and r.pos = o.pos and r.size = c.size) original, trim(regexp_replace(c.content, '\s+', ' ', 'g')) plain from c join o on o.content = c.content and o.size = c.size and o.doc_id = first_doc),
t as materialized (select a.*, case when average < lines * 0.2 then 'START' when average > lines * 0.8 then 'END' else 'MIDDLE' end position from e a, n where not exists (
 select 1 from e b where contains(b.plain, a.plain) and (-b.size, -b.documents, b.first_doc, b.pos) < (-a.size, -a.documents, a.first_doc, a.pos)))"""
HEAD = "lower(array_to_string(string_split(original, chr(10))[1:3], ' '))"
KIND = (
    "case " + " ".join(f"when regexp_matches({HEAD}, {lit(p)}) then {lit(k)}" for k, p in fixed.TEMPLATE_KINDS) + " when position = 'START' then 'HEADER' when position = 'END' then 'FOOTER' "
    + " ".join(f"when regexp_matches({HEAD}, {lit(p)}) then {lit(k)}" for k, p in fixed.TEMPLATE_WORDS) + " else 'BOILERPLATE' end"
)
FNV = "list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(string_split(content, ''), lambda c: ord(c)::hugeint)), lambda h, c: (xor(h, c) * 1099511628211::hugeint) & 18446744073709551615::hugeint)"


def templates(spark, sf_dir) -> DataFrame:
    return similarity.shared_table(corpus.build(table(spark, sf_dir, "documents"), CFG))


@query(f"with {TEMPLATES} select 'tpl_' || left(lpad(lower(to_hex(({FNV})::ubigint)), 16, '0'), 8) id, md5(original) content_md5, size::int as lines, length(original)::int chars, {KIND} kind, position, documents, round(documents / (select n from n), 6) frequency, first_doc from t")
def corpus_templates(spark, sf_dir):
    return templates(spark, sf_dir).select("id", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), "lines", "chars", "kind", "position", "documents", r6("frequency"), "first_doc")


@query(f"with {TEMPLATES} select {KIND} kind, position, count(*) templates from t group by all")
def corpus_statistics(spark, sf_dir):
    return corpus.statistics(templates(spark, sf_dir))


DELTAS = f"""{TEMPLATES}, x as (select distinct r.doc_id, unnest(range(r.pos, r.pos + r.size)) line from r join t on t.content = r.content and t.size = r.size),
u as (select doc_id, unnest(range(0, len(raw))) line, unnest(raw) content, len(raw) n from d),
v as materialized (select u.doc_id, string_agg(u.content, chr(10) order by u.line) filter (where x.line is null) kept, count(x.line) / count(*)::double coverage from u left join x on x.doc_id = u.doc_id and x.line = u.line group by u.doc_id)"""


@query(f"with {DELTAS} select doc_id, length(coalesce(text, ''))::int original_chars, length(coalesce(kept, ''))::int delta_chars, round(coverage, 6) coverage, md5(coalesce(kept, '')) kept_md5 from v join documents using (doc_id)")
def corpus_deltas(spark, sf_dir):
    found = corpus.strip(table(spark, sf_dir, "documents"), templates(spark, sf_dir), CFG)
    kept = F.array_join(F.transform("unique_lines", lambda u: u["content"]), "\n")
    return found.select("doc_id", "original_chars", "delta_chars", r6("coverage"), F.md5(F.encode(kept, "UTF-8")).alias("kept_md5"))


@query(f"with {DELTAS} select sum(length(text))::bigint original_chars, sum(length(coalesce(kept, '')))::bigint delta_chars, round(sum(length(coalesce(kept, ''))) / sum(length(text))::double, 6) ratio, (select count(*) from t) templates from v join documents using (doc_id)")
def corpus_totals(spark, sf_dir):
    found = templates(spark, sf_dir)
    return corpus.totals(corpus.strip(table(spark, sf_dir, "documents"), found, CFG), found).withColumn("ratio", F.round("ratio", 6))


@query("select doc_id, md5(text) text_md5 from documents")
def corpus_round_trip(spark, sf_dir):
    """Texts put together again from what the lossless deltas hold."""
    docs, found = table(spark, sf_dir, "documents"), templates(spark, sf_dir)
    deltas = similarity.shared_table(corpus.strip(docs, found, CFG, lossless=True))
    return corpus.reconstruct(deltas, found).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


# semantic deduplication

LEAST = 0.4
CLUSTERS = f"""ed as materialized (select * from {COS_SQL}), li as (select a, b from ed where similarity >= {LEAST} union all select b, a from ed where similarity >= {LEAST}),
re(n, m) as (select vec_id, vec_id from embeddings union select li.a, re.m from re join li on re.n = li.b), cl as (select n vec_id, min(m) as "cluster" from re group by n),
si as (select "cluster", count(*) members from cl group by 1), pa as (select x."cluster", avg(similarity) average, min(similarity) least from ed join cl x on x.vec_id = a join cl y on y.vec_id = b and x."cluster" = y."cluster" group by 1)"""


def members(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return similarity.shared_table(semantic.clusters(vectors, similarity.cosine_pairs(vectors, LEAST), LEAST))


@query(f"""with recursive {CLUSTERS} select 'cluster_' || (row_number() over (order by "cluster") - 1) cluster_id, "cluster", case when members = 1 then 'SINGLETON' when average >= 0.95 then 'DUPLICATE_GROUP' when average >= {LEAST} then 'SIMILAR_GROUP' else 'TOPIC_GROUP' end kind,
 members, round(coalesce(average, 1.0), 6) average, round(coalesce(least, 1.0), 6) least_similarity from si left join pa using ("cluster")""")
def cluster_descriptions(spark, sf_dir):
    return semantic.described(table(spark, sf_dir, "embeddings"), members(spark, sf_dir), least=LEAST).withColumns({"average": F.round("average", 6), "least_similarity": F.round("least_similarity", 6)})


WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: length(w) > 0))"
TERMS = " + ".join(f"len(regexp_extract_all(text, {lit(p)}))" for p in fixed.MEDICAL_TERMS)


@query(f"""with recursive {CLUSTERS}, do_ as (select doc_id vec_id, length(text) chars, 0.8 * 0.3 + 0.2 * least(1.0, case when {WORDS} = 0 then 0 else ({TERMS}) * 100.0::double / {WORDS} end / 20) rest from documents),
sc as (select "cluster", vec_id, 0.3 * chars / max(chars) over (partition by "cluster") + rest score from cl join do_ using (vec_id))
select "cluster", case when members = 1 then "cluster" else coalesce(sc.vec_id, "cluster") end representative, round(case when members = 1 then 1.0 else coalesce(score, 0) end, 6) score
from si left join sc using ("cluster") qualify row_number() over (partition by "cluster" order by round(score, 9) desc, sc.vec_id) = 1""")
def cluster_representatives(spark, sf_dir):
    return semantic.representatives(members(spark, sf_dir), table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


@query()
def text_embeddings(spark, sf_dir):
    return semantic.embed(table(spark, sf_dir, "documents"))


@query("""select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / greatest(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 1e-300), 6) squared from embeddings""")
def unit_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", similarity.normalized(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared"))


# masking


@query("""with l as (select l_orderkey doc_id, l_linenumber % 2 side, 'v' || (l_partkey % 50) v, '[A_' || min(l_linenumber) || ']' p from lineitem group by all)
select doc_id, v original, case when bool_or(side = 1) then max(p) filter (where side = 1) else max(p) end placeholder from l group by doc_id, v""")
def merged_replacements(spark, sf_dir):
    """Two maps of each order, made of its even and its odd lines, as one."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("side"), F.concat(F.lit("v"), (F.col("l_partkey") % 50).cast("string")).alias("v"))
    rows = li.agg(F.concat(F.lit("[A_"), F.min("l_linenumber").cast("string"), F.lit("]")).alias("p"))
    none = F.create_map().cast("map<string,string>")
    both = rows.groupBy("doc_id").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("side") == s, F.struct("v", "p")))).alias(f"m{s}") for s in (0, 1)])
    each = both.select("doc_id", F.explode(scrub.merged(F.coalesce("m0", none), F.coalesce("m1", none))).alias("original", "placeholder"))
    return each


def spans_sql(pattern: str, group: int = 0) -> str:
    return f"with m as (select doc_id, regexp_extract_all(text, {lit(pattern)}, {group}) v from documents) select doc_id, (generate_subscripts(v, 1) - 1)::int as position, unnest(v) as value from m"


def _values(name: str, pattern: str, group: int = 0) -> None:
    from docloom.operators import pii

    def run(spark, sf_dir):
        return pii.values(table(spark, sf_dir, "documents"), pattern, group)

    run.__name__ = name
    query(spans_sql(pattern, group))(run)


for _kind in ("SSN", "DATE", "CREDIT_CARD", "ZIPCODE", "CITY_STATE", "PO_BOX"):
    _values(f"pii_mentions_{_kind.lower()}", fixed.PII[_kind])
_values("pii_record_numbers", scrub.MRN, 2)
_values("pii_labelled_names", scrub.LABELLED, 3)
_values("pii_titled_names", fixed.TITLED_NAME)


def _spans() -> str:
    from docloom.catalog_records import CHART_SQL

    each = [(k, fixed.PII[k], 0) for k in ("ADDRESS", "CITY_STATE", "PO_BOX")] + [("MRN", scrub.MRN, 2), ("NAME", scrub.LABELLED, 3)]
    return f"with n as materialized {CHART_SQL} " + " union all ".join(f"select doc_id, {lit(k)} kind, unnest(regexp_extract_all(text, {lit(p)}, {g})) as value, true as there from n" for k, p, g in each)


@query(_spans())
def pii_spans(spark, sf_dir):
    """Spans in charts, and whether the text has the value at their places."""
    from docloom.catalog_records import charts

    docs = charts(spark, sf_dir)
    found = scrub.spans(docs).join(docs, "doc_id")
    return found.select("doc_id", "kind", "value", (F.expr("substring(text, start + 1, end - start)") == F.col("value")).alias("there"))


@query()
def pii_audit_summary(spark, sf_dir):
    found = scrub.audit(scrub.scrub(table(spark, sf_dir, "documents"), "worker"))
    return found.withColumn("by_kind", F.to_json("by_kind"))


@query()
def sentence_chunks(spark, sf_dir):
    return scrub.chunked(table(spark, sf_dir, "documents"))


# pages

PAGES = """(select l_orderkey doc_id, l_linenumber page_no, case when l_linenumber = 2 and l_orderkey % 3 = 0 then 'Title' else 'Clinic ' || l_orderkey % 5 end || chr(10) || 'body ' || l_partkey || case when l_orderkey % 2 = 0 then chr(10) || 'Page of file' else '' end as text from lineitem)"""


def page_rows(spark, sf_dir) -> DataFrame:
    """A page for each line item, with a header and, in every other order, a footer."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    s = lambda c: c.cast("string")
    head = F.when((n == 2) & (o % 3 == 0), "Title").otherwise(F.concat(F.lit("Clinic "), s(o % 5)))
    said = F.concat(head, F.lit("\nbody "), s(F.col("l_partkey")), F.when(o % 2 == 0, "\nPage of file").otherwise(""))
    return table(spark, sf_dir, "lineitem").select(o.alias("doc_id"), n.alias("page_no"), said.alias("text"))


@query(f"""with p as (select *, string_split(text, chr(10)) ls, count(*) over (partition by doc_id) n from {PAGES}), q as (select *, ls[1] f, ls[-1] l, count(*) over (partition by doc_id, ls[1]) nf, count(*) over (partition by doc_id, ls[-1]) nl from p),
c as (select *, case when n > 3 and nf > n * 0.75 then 1 else 0 end a, case when n > 3 and nl > n * 0.75 then 1 else 0 end b from q)
select doc_id, page_no, array_to_string(ls[1 + a:len(ls) - b], chr(10)) as text from c""")
def pages_without_repeats(spark, sf_dir):
    return pages.without_repeats(page_rows(spark, sf_dir))


@query(f"""with p as (select doc_id, page_no, string_split(text, chr(10))[1] f from {PAGES}), c as (select *, count(*) over (partition by doc_id, f order by page_no) k from p)
select doc_id, f, k as count from c qualify row_number() over (partition by doc_id order by k desc, page_no) = 1""")
def page_modes(spark, sf_dir):
    return pages.mode(page_rows(spark, sf_dir).select("doc_id", "page_no", F.get(F.split("text", "\n"), F.lit(0)).alias("f")), "doc_id", "page_no", "f")


# sinks


def yaml_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    n = F.col("l_linenumber")
    drug = F.concat(F.lit("drug: "), (F.col("l_partkey") % 9).cast("string"))
    meds = li.select(F.col("l_orderkey").alias("patient"), drug.alias("name"), F.col("day").alias("started"), F.when(n % 3 == 0, F.date_add("day", 5)).alias("stopped"), F.when(n % 2 == 0, "pain").alias("reason"))
    trends = li.select(F.col("l_orderkey").alias("patient"), F.col("l_returnflag").alias("name"), F.lit("STABLE").alias("trend"), "day", F.col("l_quantity").cast("int").alias("value"), F.when(F.col("l_quantity") > 40, "H").alias("flag"), n.alias("k")).groupBy("patient", "name", "trend", F.col("day").alias("date")).agg(F.min("value").alias("value"), F.min("flag").alias("flag"))
    record = dict(zip(("tag", "message", "recoverable", "impact", "suggestion"), errors.record("OCRWarning", F.concat(F.lit("page "), n.cast("string"))), strict=False))
    bad = li.where("l_quantity > 45").select(F.col("l_orderkey").alias("patient"), *record.values())
    return meds, trends, bad


@query("""with i as (select *, l_shipdate::date as d from lineitem),
me as (select l_orderkey patient, case when l_linenumber % 3 = 0 then 3 else 2 end section, 'drug: ' || l_partkey % 9 || '|' || strftime(d, '%Y-%m-%d') item, '    - name: "drug: ' || l_partkey % 9 || '"' || chr(10) || '      started: ' || strftime(d, '%Y-%m-%d')
 || case when l_linenumber % 3 = 0 then chr(10) || '      stopped: ' || strftime(d + 5, '%Y-%m-%d') else '' end || case when l_linenumber % 2 = 0 then chr(10) || '      reason: pain' else '' end yaml from i),
po as (select l_orderkey patient, l_returnflag item, d, min(l_quantity::int) v, min(case when l_quantity > 40 then 'H' end) f from i group by all),
tr as (select patient, 4 section, item, '  - name: ' || item || chr(10) || '    trend: STABLE' || chr(10) || '    values:' || chr(10)
 || string_agg('      - date: ' || strftime(d, '%Y-%m-%d') || chr(10) || '        value: ' || v || case when f is not null then chr(10) || '        flag: H' else '' end, chr(10) order by d) yaml from po group by patient, item),
er as (select l_orderkey patient, 5 section, 'OCRWarning|page ' || l_linenumber item, '  - type: OCRWarning' || chr(10) || '    message: page ' || l_linenumber || chr(10) || '    suggestion: Read the page again.' || chr(10) || '    recoverable: true' || chr(10) || '    impact: low' yaml from i where l_quantity > 45),
al as (select * from me union all select patient, section, item, yaml from tr union all select * from er), nu as (select *, row_number() over (partition by patient, section order by item, yaml) nth, min(section) over (partition by patient, section in (2, 3)) lead_ from al)
select patient, section::int section, nth::int item, case when nth > 1 then yaml else case when section = 2 then chr(10) || 'medications:' || chr(10) || '  current:' || chr(10) when section = 3 and lead_ = 3 then chr(10) || 'medications:' || chr(10) || '  discontinued:' || chr(10)
 when section = 3 then '  discontinued:' || chr(10) when section = 4 then chr(10) || 'labTrends:' || chr(10) else chr(10) || 'warnings:' || chr(10) end || yaml end yaml from nu""")
def yaml_parts(spark, sf_dir):
    return sinks.yaml_parts("patient", *yaml_inputs(spark, sf_dir))


@query("""select sum(case when l_quantity > 45 then 1 else 0 end)::bigint errors, 0::bigint unrecoverable from lineitem""")
def error_counts(spark, sf_dir):
    return errors.collected(yaml_inputs(spark, sf_dir)[2]).drop("by_tag")
