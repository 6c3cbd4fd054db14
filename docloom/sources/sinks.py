"""Markdown documents, YAML timelines and keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.quality import clean_stutter


def front_matter(fields: dict[str, Column]) -> Column:
    """YAML front matter with values quoted as JSON."""
    quoted = [F.concat(F.lit(f"{k}: "), F.regexp_extract(F.to_json(F.struct(F.coalesce(v.cast("string"), F.lit("")).alias("v"))), r'^\{"v":(.*)\}$', 1)) for k, v in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *quoted, F.lit("---"))


def markdown(docs: DataFrame, fields: dict[str, Column], count: Column) -> DataFrame:
    """doc_id and markdown: front matter, the cleaned text, and a notice with the number of replacements."""
    body = clean_stutter(docs.select("doc_id", "text"))
    notice = F.concat(F.lit("*CONFIDENTIALITY NOTICE: This document has been automatically scrubbed of PII. Original entities replaced: "), count.cast("string"), F.lit(".*"))
    parts = (front_matter(fields), F.lit(""), F.lit("# Document Extraction"), F.lit(""), F.col("clean"), F.lit(""), F.lit("---"), notice)
    return docs.join(body, "doc_id").select("doc_id", F.concat_ws("\n", *parts).alias("markdown"))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with rows put in place of those with the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def write_markdown(docs: DataFrame, path: str) -> None:
    """Write the column markdown as text files."""
    docs.select("markdown").write.text(path, lineSep="\n\n")


def yaml_scalar(col: Column) -> Column:
    """A string as YAML has it: in quotes if it holds signs with a meaning there."""
    special = col.rlike(r"[:#\[\]{}|>*&!%@`]")
    return F.when(special, F.concat(F.lit('"'), F.regexp_replace(col, '"', '\\\\"'), F.lit('"'))).otherwise(col)


def yaml_size(events: Column) -> Column:
    """Estimated bytes of a YAML timeline of so many events: 200 for each and 1024."""
    return events * 200 + 1024


def yaml_timeline(found: DataFrame, key: str) -> DataFrame:
    """Events (key, doc_id, idx, type, confidence, date) as blocks of one YAML document for each key.

    A row for each block: key, section (0: head, with the first date and doc_id; 1: an event), date, doc_id, idx, yaml. Blocks joined by line ends in
    the order of these columns are the document; no key's events are gathered in one value, however many there are. Where documents share an id, the numbers of their events run on, by place, date and type.
    """
    nth = F.row_number().over(Window.partitionBy(key, "doc_id").orderBy("idx", "date", "type")) - 1
    entry = F.concat_ws(
        "\n", F.concat(F.lit("  - id: "), F.concat_ws("-", "doc_id", "type", nth)), F.concat(F.lit("    date: "), F.date_format("date", "yyyy-MM-dd")), F.concat(F.lit("    type: "), "type"),
        F.concat(F.lit("    source: "), yaml_scalar(F.col("doc_id").cast("string"))), F.concat(F.lit("    confidence: "), "confidence"),
    )
    events = found.select(key, F.lit(1).alias("section"), "date", "doc_id", "idx", entry.alias("yaml"))
    n, first, last = F.count(F.lit(1)), F.min("date"), F.max("date")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    head = F.concat_ws(
        "\n", F.lit("patient:"), F.concat(F.lit("  id: "), yaml_scalar(F.first(F.col(key).cast("string")))), F.lit(""), F.lit("dateRange:"), line("  start", first), line("  end", last),
        line("  durationDays", F.datediff(last, first)), F.lit(""), line("totalDocuments", F.count_distinct("doc_id")), line("totalEvents", n), line("estimatedBytes", yaml_size(n)), F.lit(""), F.lit("timeline:"),
    )
    heads = found.groupBy(key).agg(head.alias("yaml"), first.alias("date"), F.min("doc_id").alias("doc_id"))
    heads = heads.select(key, F.lit(0).alias("section"), "date", "doc_id", F.lit(-1).alias("idx"), "yaml")
    return heads.unionByName(events)


def yaml_parts(key: str, medications: DataFrame | None = None, trends: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """Further blocks of the YAML documents: key, section (2: current and 3: discontinued medications, 4: trends, 5: warnings), item and yaml.

    medications: key, name, started, stopped (null: current), reason. trends: key, name, trend, date, value, flag. errors: key, tag, message,
    suggestion, recoverable, impact. A block holds one entry; the first of its section starts with the section's name."""
    scalar = lambda c: yaml_scalar(F.col(c).cast("string"))
    line = lambda lead, col: F.concat(F.lit(lead), col.cast("string"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    out = []
    if medications is not None:
        state = F.when(F.col("stopped").isNull(), 2).otherwise(3)
        entry = F.concat_ws("\n", line("    - name: ", scalar("name")), line("      started: ", day("started")), line("      stopped: ", day("stopped")), line("      reason: ", scalar("reason")))
        out.append(medications.select(key, state.alias("section"), F.concat_ws("|", "name", day("started")).alias("item"), entry.alias("yaml")))
    if trends is not None:
        point = F.concat_ws("\n", line("      - date: ", day("date")), line("        value: ", F.col("value")), line("        flag: ", scalar("flag")))
        points = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", point.alias("p")))), lambda s: s["p"]), "\n")
        each = trends.groupBy(key, "name", "trend").agg(points.alias("points"))
        entry = F.concat_ws("\n", line("  - name: ", scalar("name")), line("    trend: ", F.col("trend")), F.lit("    values:"), F.col("points"))
        out.append(each.select(key, F.lit(4).alias("section"), F.col("name").alias("item"), entry.alias("yaml")))
    if errors is not None:
        entry = F.concat_ws("\n", line("  - type: ", F.col("tag")), line("    message: ", scalar("message")), line("    suggestion: ", scalar("suggestion")), line("    recoverable: ", F.col("recoverable")), line("    impact: ", F.col("impact")))
        out.append(errors.select(key, F.lit(5).alias("section"), F.concat_ws("|", "tag", "message").alias("item"), entry.alias("yaml")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    nth = F.row_number().over(Window.partitionBy(key, "section").orderBy("item", "yaml"))
    both = F.min("section").over(Window.partitionBy(key, F.col("section").isin(2, 3)))
    head = F.when(F.col("section") == 2, "\nmedications:\n  current:\n").when((F.col("section") == 3) & (F.col("lead") == 3), "\nmedications:\n  discontinued:\n").when(F.col("section") == 3, "  discontinued:\n")
    head = head.when(F.col("section") == 4, "\nlabTrends:\n").otherwise("\nwarnings:\n")
    rows = rows.withColumns({"nth": nth, "lead": both})
    return rows.select(key, "section", F.col("nth").alias("item"), F.when(F.col("nth") == 1, F.concat(head, F.col("yaml"))).otherwise(F.col("yaml")).alias("yaml"))


def yaml_metadata(events: Column, included: Column, original_kb: Column, compressed_kb: Column, as_of: str, deduplication: str = "aggressive") -> Column:
    """The block of metadata: sizes, ratio (1 at most) and events of a compression."""
    ratio = F.least(F.lit(1.0), F.coalesce(F.try_divide(compressed_kb, original_kb), F.lit(0.0)))
    two = lambda c, n: F.format_string(f"%.{n}f", c.cast("double"))
    part = lambda lead, col, tail="": F.concat(F.lit(lead), col.cast("string"), F.lit(tail))
    return F.concat_ws(
        "\n", F.lit(f'metadata:\n  generatedAt: {as_of}\n  version: "1.0.0"\n  schemaVersion: "1.0.0"\n\n  compression:'), part("    originalSizeKb: ", two(original_kb, 2)), part("    compressedSizeKb: ", two(compressed_kb, 2)),
        part("    ratio: ", two(ratio * 100, 1), "%"), part("    eventsTotal: ", events), part("    eventsIncluded: ", included), part("    eventsRemoved: ", events - included), F.lit(f"    deduplication: {deduplication}"),
    )


def zipped(docs: DataFrame, name: str, per: int = 1000) -> DataFrame:
    """archive and content: the Markdown (column markdown) of documents as files Scrubbed_<name>.md in ZIP archives of about `per` documents.

    Files of one name in an archive are numbered. Archives are as many as the documents need; none holds them all."""
    import io
    import zipfile

    n = max(1, -(-docs.count() // per))
    rows = docs.where("markdown is not null").select(F.pmod(F.xxhash64(name, "markdown"), F.lit(n)).alias("archive"), F.col(name).cast("string").alias("name"), "markdown")

    def pack(table):
        import pyarrow as pa

        out, met = io.BytesIO(), {}
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for title, said in sorted(zip(table.column("name").to_pylist(), table.column("markdown").to_pylist(), strict=True), key=lambda r: (r[0] or "", r[1])):
                met[title] = met.get(title, 0) + 1
                z.writestr(zipfile.ZipInfo(f"Scrubbed_{title}{f'_{met[title]}' if met[title] > 1 else ''}.md"), said)
        return pa.table({"archive": pa.array([table.column("archive")[0].as_py()], pa.int64()), "content": pa.array([out.getvalue()], pa.binary())})

    return rows.groupBy("archive").applyInArrow(pack, "archive bigint, content binary")


def new_id() -> Column:
    """A random identifier for each row; it changes when a row is computed again, so write it before it is used."""
    return F.uuid()
