"""File names, files as texts, and HTML as Markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import fixed

# Media types of accepted files; images are accepted by their prefix.
MEDIA = ["application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/plain", "text/csv", "text/markdown", "application/json"]


def normalised_name(col: Column) -> Column:
    """File name without path, control characters, runs of space and dots; 180 characters at most."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(col, r"^\s+|\s+$", ""), r"^[A-Za-z]:\\", ""), r"^.*[/\\]", "")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[\x00-\x1F\x7F]", ""), r"\s+", " "), r"^\s+|\s+$", "")
    return F.left(F.regexp_replace(out, r"\.{2,}", "."), F.lit(180))


def extension(col: Column) -> Column:
    """Lower-case part after the last dot; null if that dot is the first or last character."""
    return F.nullif(F.lower(F.regexp_extract(col, r"^.+\.([^.]+)$", 1)), F.lit(""))


def validate(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Adds name, extension and issues to rows with filename, mime and size; no issues: accepted."""
    rows = files.withColumn("name", normalised_name(F.col("filename"))).withColumn("extension", extension(F.col("name")))
    flag = lambda test, code: F.when(test, F.lit(code))
    media = (F.coalesce("mime", F.lit("")) != "") & ~F.col("mime").startswith("image/") & ~F.col("mime").isin(MEDIA)
    found = F.array_compact(F.array(
        flag(F.length("name") < 3, "NAME_TOO_SHORT"), flag(F.col("name").rlike(r'[<>:"|?*]'), "INVALID_CHARS"), flag(F.col("extension").isNull(), "MISSING_EXTENSION"),
        flag(~F.col("extension").isin(fixed.EXTENSIONS), "EXT_NOT_ALLOWED"), flag(media, "MIME_NOT_ALLOWED"),
        flag(F.col("size") > max_bytes if max_bytes is not None else F.lit(False), "FILE_TOO_LARGE"), flag(F.col("size") == 0, "EMPTY_FILE"),
    ))
    return rows.withColumn("issues", F.when(F.coalesce("name", F.lit("")) == "", F.array(F.lit("EMPTY_NAME"))).otherwise(found))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, mime, size, content and text of files; other kinds than texts have a null text for the parsers of other formats (pages.parsed)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = extension(F.col("path"))
    mime = F.when(ext == "pdf", "application/pdf").when(ext == "docx", MEDIA[1]).when(ext.isin("png", "jpg", "jpeg", "webp"), F.concat(F.lit("image/"), ext))
    mime = mime.when(ext == "csv", "text/csv").when(ext == "md", "text/markdown").when(ext == "json", "application/json").when(ext == "txt", "text/plain").otherwise("")
    rows = files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), mime.alias("mime"), F.col("length").alias("size"), "content")
    readable = F.col("mime").startswith("text/") | (F.col("mime") == "application/json")
    return rows.select("path", "filename", "mime", "size", "content", F.when(readable, F.decode("content", "UTF-8")).alias("text"))


class _Markdown(HTMLParser):
    """Headings, paragraphs, emphasis, lists, images and tables as Markdown; all text is kept."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.row: list[str] | None = None
        self.rows: list[list[str]] = []
        self.tables = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("h1", "h2", "h3", "h4"):
            self.out.append("\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "ul", "ol"):
            self.out.append("\n\n" if tag == "p" else "\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "li":
            self.out.append("- ")
        elif tag == "img":
            self.out.append(f"[Image: {a.get('alt') or 'no description'}]")
        elif tag == "table":
            self.rows, self.tables = [], self.tables + 1
        elif tag == "tr" and self.tables:
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append("")
            span = a.get("colspan") or "1"
            self.row += ["<Merged>"] * (min(int(span), 100) - 1 if span.isdigit() else 0)

    def handle_endtag(self, tag):
        if tag in ("h1", "h2", "h3", "h4", "p"):
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag in ("li", "ul", "ol"):
            self.out.append("\n")
        elif tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None
        elif tag == "table" and self.tables:
            self.tables -= 1
            line = lambda cells: "| " + " | ".join(re.sub(r"\s+", " ", c).strip() for c in cells) + " |"
            if self.rows:
                self.out.append("\n" + "\n".join([line(self.rows[0]), "|" + "---|" * len(self.rows[0]), *map(line, self.rows[1:])]) + "\n\n")

    def handle_data(self, data):
        if self.row:
            self.row[next((i for i in range(len(self.row) - 1, -1, -1) if self.row[i] != "<Merged>"), 0)] += data
        else:
            self.out.append(data)


def to_markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(parser.out)).strip()


@F.pandas_udf(T.StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    return html.map(to_markdown)
