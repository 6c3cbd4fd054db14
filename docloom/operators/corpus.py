"""A corpus of templates: runs of lines that many documents share, what is left of each document without them, and its reconstruction.

Runs are met by the hashes of their normalised lines; a template keeps the lines of the first document that has it. Templates
that lie within another are left out. Null texts count as documents without lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import fixed, text
from docloom.operators.similarity import shared_table

#: Letters of the pieces by which templates within others are looked for; a template has ten letters at least.
GRAM = 8


@dataclass(frozen=True)
class Config:
    """Sizes of runs, the share of documents and the number of them that make a template, how lines are normalised, and how many documents are looked at (None: all)."""

    low: int = 2
    high: int = 5
    share: float = 0.3
    least: int = 3
    spaces: bool = True
    lower: bool = True
    numbers: bool = False
    sample: int | None = None


def normalised(line: Column, cfg: Config = Config()) -> Column:
    if cfg.spaces:
        line = text.trimmed(F.regexp_replace(line, r"\s+", " "))
    if cfg.lower:
        line = F.lower(line)
    return F.regexp_replace(line, r"\d+", "#") if cfg.numbers else line


@F.pandas_udf(T.StringType())
def fnv1a(texts: pd.Series) -> pd.Series:
    """The 64-bit FNV-1a hash of a text's UTF-16 units, as hexadecimal digits."""

    def one(t: str) -> str:
        h, units = 0xCBF29CE484222325, t.encode("utf-16-le", "surrogatepass")
        for i in range(0, len(units), 2):
            h = (h ^ (units[i] | units[i + 1] << 8)) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return texts.map(one, na_action="ignore")


def runs(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, size, at (first line) and key (hash of the normalised lines) of each run of lines with ten letters or more."""
    lines = F.transform(F.split("text", "\n"), lambda x: normalised(x, cfg))
    rows = docs.where("text is not null").select("doc_id", lines.alias("lines"))

    def of(k: int) -> Column:
        starts = F.when(F.size("lines") >= k, F.sequence(F.lit(0), F.size("lines") - k)).otherwise(F.array().cast("array<int>"))

        def one(i: Column) -> Column:
            content = F.array_join(F.slice(F.col("lines"), i + 1, k), "\n")
            return F.struct(F.lit(k).alias("size"), i.alias("at"), F.when(F.length(F.regexp_replace(content, r"\s", "")) >= 10, F.unhex(F.md5(F.encode(content, "UTF-8")))).alias("key"))

        return F.transform(starts, one)

    each = F.filter(F.concat(*[of(k) for k in range(cfg.low, cfg.high + 1)]), lambda r: r["key"].isNotNull())
    return rows.select("doc_id", F.inline(each))


def position(average: Column, lines: Column) -> Column:
    """START, END or MIDDLE by a run's average first line among the documents' average number of lines."""
    return F.when(average < lines * 0.2, "START").when(average > lines * 0.8, "END").otherwise("MIDDLE")


def kind(content: Column, place: Column) -> Column:
    """The kind of a template by its first three lines, then its place, then its words."""
    head = F.lower(F.array_join(F.slice(F.split(content, "\n"), 1, 3), " "))
    out = F.lit("BOILERPLATE")
    for name, pattern in reversed(fixed.TEMPLATE_WORDS):
        out = F.when(text.rlike(head, pattern), name).otherwise(out)
    out = F.when(place == "START", "HEADER").when(place == "END", "FOOTER").otherwise(out)
    for name, pattern in reversed(fixed.TEMPLATE_KINDS):
        out = F.when(head.rlike(pattern), name).otherwise(out)
    return out


def build(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The templates of a corpus: id, key, content, lines, chars, kind, position, documents, frequency, first_doc and place (their order)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if cfg.sample is not None:
        rows = rows.orderBy("doc_id").limit(cfg.sample)
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(F.split("text", "\n"))).alias("lines")).first()
    n, lines = whole.n, whole.lines or 0.0
    first = runs(rows, cfg).groupBy("key", "size", "doc_id").agg(F.min("at").alias("at"))
    where = F.min(F.struct("doc_id", "at"))
    found = first.groupBy("key", "size").agg(F.count(F.lit(1)).alias("documents"), F.avg("at").alias("average"), where.alias("first"))
    found = shared_table(found.where(F.col("documents") >= max(cfg.least, int(n * cfg.share))).where(F.lit(n >= cfg.least)))
    texts = rows.join(found.select(F.col("first.doc_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("first_doc"), F.split("text", "\n").alias("all"))
    each = found.select("key", "size", "documents", "average", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("at")).join(texts, "first_doc")
    content = F.array_join(F.slice("all", F.col("at") + 1, F.col("size")), "\n")
    each = each.select("key", F.col("size").alias("lines"), content.alias("content"), "documents", (F.col("documents") / F.lit(float(max(n, 1)))).alias("frequency"), "first_doc", "at", position(F.col("average"), F.lit(lines)).alias("position"))
    each = shared_table(each.withColumn("plain", normalised(F.col("content"), cfg)))
    # larger templates come first, then more frequent ones, then those met first
    order = F.struct((-F.col("lines")).alias("a"), (-F.col("documents")).alias("b"), F.col("first_doc").alias("c"), F.col("at").alias("d"), F.col("key").alias("e"))
    each = each.withColumn("place", order)
    kept = each.join(within(each), "key", "left_anti")
    line_kind = F.transform(F.split("content", "\n"), lambda x: normalised(x, cfg))
    return kept.select(
        F.concat(F.lit("tpl_"), F.left(fnv1a(F.array_join(line_kind, "\n")), F.lit(8))).alias("id"), "key", "content", "lines", F.length("content").alias("chars"), kind(F.col("content"), F.col("position")).alias("kind"), "position",
        "documents", "frequency", "first_doc", "place",
    )


def within(templates: DataFrame) -> DataFrame:
    """key of templates whose text stands in that of an earlier one (columns key, plain, place).

    Templates meet by pieces of GRAM letters: one stands in another only if the other has its rarest piece."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("plain") - GRAM + 1, F.lit(1))), lambda i: F.substring("plain", i, F.lit(GRAM))))
    pieces = shared_table(templates.select("key", F.explode(grams).alias("gram")))
    often = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = pieces.join(shared_table(often), "gram").groupBy("key").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    small = templates.select("key", "plain", "place").join(rarest, "key").alias("s")
    large = templates.select("key", "plain", "place").join(pieces, "key").alias("l")
    inside = small.join(large, "gram").where("l.place < s.place and contains(l.plain, s.plain)")
    return inside.select("s.key").distinct()


def apart(matches: Column) -> Column:
    """Matches (start, end) by their start, without overlaps: of two that overlap the one that ends later takes the other's place."""
    empty = F.filter(matches, lambda _: F.lit(False))

    def step(done: Column, m: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when((F.size(done) == 0) | (m["start"] > F.get(done, F.size(done) - 1)["end"]), F.concat(done, F.array(m))).when(m["end"] > last["end"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(m))).otherwise(done)

    return F.aggregate(F.array_sort(matches), empty, step)


def strip(docs: DataFrame, templates: DataFrame, cfg: Config = Config(), lossless: bool = False) -> DataFrame:
    """What is left of each document: doc_id, original_chars, delta_chars, ratio, coverage, refs (start, end, id) and unique_lines (line, content).

    Lines of all matches count as covered, also of matches that another takes the place of. lossless: only lines of the refs whose
    text is the template's, so that reconstruct() gives back every text."""
    found = runs(docs, cfg).join(templates.select("key", "id", "lines"), "key")
    match = F.struct(F.col("at").alias("start"), (F.col("at") + F.col("lines") - 1).alias("end"), F.col("lines").alias("size"), "id")
    matches = found.groupBy("doc_id").agg(F.collect_set(match).alias("matches"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(matches, "doc_id", "left").withColumn("all", F.split("text", "\n"))
    refs = F.when(F.col("matches").isNotNull(), apart(F.col("matches")))
    rows = rows.withColumn("refs", F.coalesce(refs, F.array().cast("array<struct<start:int,end:int,size:int,id:string>>")))
    if lossless:
        held = rows.select("doc_id", "all", F.explode("refs").alias("r")).select("doc_id", "all", F.col("r.id").alias("id"), F.col("r.start").alias("start")).join(templates.select("id", F.split("content", "\n").alias("lines")), "id")
        same = F.filter(F.transform("lines", lambda x, i: F.when(F.get("all", F.col("start") + i) == x, F.col("start") + i)), lambda i: i.isNotNull())
        covered = held.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(same))).alias("covered"))
        rows = rows.join(covered, "doc_id", "left")
    else:
        inside = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["end"]))))
        rows = rows.withColumn("covered", inside)
    rows = rows.withColumn("covered", F.coalesce("covered", F.array().cast("array<int>")))
    unique = F.filter(F.transform("all", lambda x, i: F.struct(i.alias("line"), x.alias("content"))), lambda u: ~F.array_contains("covered", u["line"]))
    rows = rows.withColumn("unique_lines", unique)
    left = F.length(F.array_join(F.transform("unique_lines", lambda u: u["content"]), "\n"))
    chars = F.length("text")
    return rows.select(
        "doc_id", chars.alias("original_chars"), left.alias("delta_chars"), F.coalesce(F.try_divide(left, chars), F.lit(1.0)).alias("ratio"), (F.size("covered") / F.size("all")).alias("coverage"),
        F.transform("refs", lambda r: r.dropFields("size")).alias("refs"), "unique_lines",
    )


def reconstruct(deltas: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id and text: the templates' lines and the unique lines of each document in order; where both have a line the unique one counts."""
    refs = deltas.select("doc_id", F.explode("refs").alias("r")).select("doc_id", F.col("r.start").alias("start"), F.col("r.id").alias("id"))
    lines = refs.join(templates.select("id", "content"), "id").select("doc_id", "start", F.posexplode(F.split("content", "\n")).alias("i", "content"))
    lines = lines.select("doc_id", (F.col("start") + F.col("i")).alias("line"), F.lit(1).alias("rank"), "content")
    own = deltas.select("doc_id", F.explode("unique_lines").alias("u")).select("doc_id", "u.line", F.lit(0).alias("rank"), "u.content")
    each = own.union(lines).groupBy("doc_id", "line").agg(F.min(F.struct("rank", "content"))["content"].alias("content"))
    texts = each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda s: s["content"]), "\n").alias("text"))
    return deltas.select("doc_id").join(texts, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def totals(deltas: DataFrame, templates: DataFrame) -> DataFrame:
    """One row: characters before and after, their ratio, and the number of templates."""
    n = templates.agg(F.count(F.lit(1)).alias("templates"))
    one = deltas.agg(F.coalesce(F.sum("original_chars"), F.lit(0)).alias("original_chars"), F.coalesce(F.sum("delta_chars"), F.lit(0)).alias("delta_chars"))
    return one.join(F.broadcast(n)).select("original_chars", "delta_chars", F.coalesce(F.try_divide("delta_chars", "original_chars"), F.lit(1.0)).alias("ratio"), "templates")


def statistics(templates: DataFrame) -> DataFrame:
    """Templates by kind and position."""
    return templates.groupBy("kind", "position").agg(F.count(F.lit(1)).alias("templates"))


def top(templates: DataFrame, most: int = 5) -> DataFrame:
    """The first templates in their order: kind, frequency and the start of their text."""
    return templates.orderBy("place").limit(most).select("kind", "frequency", F.concat(F.left("content", F.lit(50)), F.lit("...")).alias("preview"))


def process(docs: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Templates, deltas and totals of a corpus."""
    templates = shared_table(build(docs, cfg))
    deltas = shared_table(strip(docs, templates, cfg))
    return templates, deltas, totals(deltas, templates)
