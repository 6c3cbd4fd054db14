"""Pages of PDF files and images as texts: lines from placed words, headers and footers removed, quality over pages; DOCX files as Markdown.

The placed words of a page, and what optical recognition read on it, come as columns: no PDF library or recogniser is part of
this library. A recogniser is a function from a page's image to words that runs in the tasks.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators import quality
from docloom.sources.files import to_markdown

BREAK = "\n\n--- Page Break ---\n\n"
LEAST_CHARS, LINE_GAP, WORD_GAP = 50, 5, 4
#: Words as recognisers give them.
BOXED = "array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"
PLACED = "array<struct<x:double,y:double,width:double,str:string>>"


def lines_of(items: list) -> str:
    """The lines of a page from its placed words: words at nearly one height are a line, a gap is a space, the highest line comes first."""
    lines: list[list] = []
    for item in items:
        word, x, width = item["str"] or "", item["x"], item["width"]
        y = int((item["y"] + 0.5) // 1)
        if not word.strip():
            continue
        line = next((line for line in lines if abs(line[0] - y) < LINE_GAP), None)
        if line is None:
            lines.append([y, word, x + width])
        else:
            line[1] += (" " if x - line[2] > WORD_GAP else "") + word
            line[2] = x + width
    return "\n".join(line[1] for line in sorted(lines, key=lambda line: -line[0]))


@F.pandas_udf(T.StringType())
def page_lines(items: pd.Series) -> pd.Series:
    return items.map(lines_of, na_action="ignore")


def words(col: Column) -> Column:
    """Recognised words with boxes as place and size, and whether they are noise."""
    return F.transform(
        col,
        lambda w: F.struct(
            w["text"].alias("text"), w["confidence"].alias("confidence"),
            F.struct(w["bbox"]["x0"].alias("x"), w["bbox"]["y0"].alias("y"), (w["bbox"]["x1"] - w["bbox"]["x0"]).alias("width"), (w["bbox"]["y1"] - w["bbox"]["y0"]).alias("height")).alias("bbox"),
            quality.is_garbage(w["text"]).alias("is_garbage"),
        ),
    )


def recognised(images: DataFrame, read: Callable[[bytes], list[dict]] | None) -> DataFrame:
    """Rows (doc_id, page_no, content) with the words that a recogniser reads (columns words and ocr_text); nulls without one or where it fails."""
    kind = f"words {BOXED}, ocr_text string"

    @F.pandas_udf(kind)
    def run(contents: pd.Series) -> pd.DataFrame:
        out = []
        for c in contents:
            try:
                found = read(c) if c is not None else None
            except Exception:  # noqa: BLE001  a page that cannot be read is marked, not lost
                found = None
            out.append((found, None if found is None else " ".join(w["text"] for w in found)))
        return pd.DataFrame(out, columns=["words", "ocr_text"])

    if read is None:
        return images.withColumns({"words": F.lit(None).cast(BOXED), "ocr_text": F.lit(None).cast("string")})
    return images.withColumn("r", run("content")).select(*images.columns, "r.words", "r.ocr_text")


def page_quality(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, score, level and flags of pages with recognised words."""
    each = pages.where("size(words) > 0").select(F.struct("doc_id", "page_no").alias("doc_id"), F.posexplode(words(F.col("words"))).alias("word_idx", "w")).select("doc_id", "word_idx", "w.text", "w.confidence")
    found = quality.word_quality(each)
    return found.select("doc_id.doc_id", "doc_id.page_no", "score", "level", "flags")


def page_texts(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, text and used_ocr of pages (doc_id, page_no, items, ocr_text): a page with few letters takes what was recognised on it."""
    digital = F.coalesce(page_lines("items"), F.lit(""))
    few = F.length(F.regexp_replace(F.array_join(F.transform("items", lambda i: i["str"]), " "), r"^\s+|\s+$", "")) < LEAST_CHARS
    few = F.coalesce(few, F.lit(True))
    number = F.col("page_no").cast("string")
    read = F.when(F.col("ocr_text").isNotNull(), F.concat(F.lit("[OCR_RECOVERED_PAGE_"), number, F.lit("]\n"), "ocr_text")).otherwise(F.concat(F.lit("[OCR_UNAVAILABLE_PAGE_"), number, F.lit("]\n")))
    return pages.select("doc_id", "page_no", F.when(few, read).otherwise(digital).alias("text"), (few & F.col("ocr_text").isNotNull()).alias("used_ocr"))


def mode(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, value and count of the value that is most frequent for each key; of equally frequent ones the first to get there."""
    from pyspark.sql import Window

    nth = F.count(F.lit(1)).over(Window.partitionBy(key, value).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    best = rows.withColumn("__n", nth).groupBy(key).agg(F.max(F.struct(F.col("__n").alias("n"), (-F.col(order)).alias("o"), F.col(value).alias("v"))).alias("b"))
    return best.select(key, F.col("b.v").alias(value), F.col("b.n").alias("count"))


def without_repeats(pages: DataFrame, share: float = 0.75, most_chars: int = 150) -> DataFrame:
    """doc_id, page_no and text: of documents of more than three pages, without a first or last line that more than share of the pages have."""
    lines = F.split("text", "\n")
    first, last = F.trim(F.get(lines, F.lit(0))), F.trim(F.element_at(lines, -1))
    rows = pages.select("doc_id", "page_no", "text", first.alias("first"), last.alias("last"))
    n = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    out = rows.join(n, "doc_id")
    for end in ("first", "last"):
        common = mode(rows.where(F.col(end) != "").select("doc_id", "page_no", end), "doc_id", "page_no", end)
        out = out.join(common.select("doc_id", F.col(end).alias(f"common_{end}"), F.col("count").alias(f"n_{end}")), "doc_id", "left")
    gone = lambda end: F.coalesce((F.col("pages") > 3) & (F.col(f"n_{end}") > F.col("pages") * share) & (F.col(end) == F.col(f"common_{end}")) & (F.length(end) < most_chars), F.lit(False))
    head = F.when(gone("first"), F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
    # a single line that was the header leaves nothing for the footer
    left_last = F.trim(F.element_at(head, -1))
    tail = F.when(gone("last") & (F.size(head) > 0) & F.coalesce(left_last == F.col("common_last"), F.lit(False)), F.slice(head, F.lit(1), F.size(head) - 1)).otherwise(head)
    return out.select("doc_id", "page_no", F.array_join(tail, "\n").alias("text"))


def documents(pages: DataFrame) -> DataFrame:
    """doc_id, text, pages, ocr_pages, score, level, flags and needs_review of documents by their pages (doc_id, page_no, items, words, ocr_text).

    The quality is that of the worst recognised page, with the flags of all; null if no page was recognised."""
    texts = page_texts(pages)
    cleaned = without_repeats(texts).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda s: s["text"]), BREAK).alias("text"))
    counts = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if("used_ocr").alias("ocr_pages"))
    used = page_quality(pages).join(texts.where("used_ocr").select("doc_id", "page_no"), ["doc_id", "page_no"])
    worst = F.min(F.struct("score", "page_no", "level"))
    found = used.groupBy("doc_id").agg(worst.alias("w"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"))
    found = found.select("doc_id", "w.score", "w.level", "flags")
    out = cleaned.join(counts, "doc_id").join(found, "doc_id", "left")
    return out.withColumn("needs_review", F.coalesce(quality.needs_review(F.col("score"), F.col("level"), F.col("flags")), F.lit(False)))


def repaired(regions: DataFrame, read: Callable[[bytes, dict], str] | None) -> DataFrame:
    """Regions of low confidence (columns content and box, beside others) with the text that a second recogniser reads in them; without one, or where it fails, null."""
    if read is None:
        return regions.withColumn("repaired", F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def run(contents: pd.Series, boxes: pd.DataFrame) -> pd.Series:
        def one(content, box):
            try:
                return read(content, box)
            except Exception:  # noqa: BLE001  the region stays as it was
                return None

        return pd.Series([one(c, b) for c, b in zip(contents, boxes.to_dict("records"), strict=True)], dtype=object)

    return regions.withColumn("repaired", run("content", "box"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_html(content: bytes) -> str:
    """The body of a DOCX file as HTML: headings, paragraphs, lists, bold and slanted text, tables."""
    from html import escape

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def on(props, tag: str) -> bool:
        found = None if props is None else props.find(f"{_W}{tag}")
        return found is not None and found.get(f"{_W}val") not in ("0", "false", "none")

    def runs(p) -> str:
        out = []
        for r in p.iter(f"{_W}r"):
            said = "".join(escape(x.text or "") if x.tag == f"{_W}t" else "<br/>" if x.tag == f"{_W}br" else "\t" if x.tag == f"{_W}tab" else "" for x in r)
            props = r.find(f"{_W}rPr")
            for tag, mark in (("i", "em"), ("b", "strong")):
                if said and on(props, tag):
                    said = f"<{mark}>{said}</{mark}>"
            out.append(said)
        return "".join(out)

    def block(e) -> str:
        if e.tag == f"{_W}tbl":
            cells = lambda tr: "".join(f"<td>{' '.join(runs(p) for p in tc.iter(f'{_W}p'))}</td>" for tc in tr.findall(f"{_W}tc"))
            return "<table>" + "".join(f"<tr>{cells(tr)}</tr>" for tr in e.findall(f"{_W}tr")) + "</table>"
        if e.tag != f"{_W}p":
            return ""
        props = e.find(f"{_W}pPr")
        style = None if props is None else props.find(f"{_W}pStyle")
        name = "" if style is None else (style.get(f"{_W}val") or "")
        said = runs(e)
        if name.lower().startswith("heading") and name[7:].strip().isdigit():
            n = min(int(name[7:]), 6)
            return f"<h{n}>{said}</h{n}>"
        if props is not None and props.find(f"{_W}numPr") is not None:
            return f"<ul><li>{said}</li></ul>"
        return f"<p>{said}</p>" if said else ""

    return "".join(block(e) for e in body) if body is not None else ""


PARSED = "text string, error string"


def parsed(files: DataFrame) -> DataFrame:
    """path, filename, mime, text and error of files (path, filename, mime, content).

    Texts are read whole and DOCX files become Markdown; PDF files and images need their pages (documents() above) and say so;
    other kinds, and files that cannot be read, have an error."""

    @F.pandas_udf(PARSED)
    def run(names: pd.Series, mimes: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for name, mime, content in zip(names, mimes, contents, strict=True):
            text = error = None
            try:
                if mime == "application/vnd.openxmlformats-officedocument.wordprocessingml.document":
                    text = to_markdown(docx_html(content))
                elif mime in ("text/plain", "text/csv", "text/markdown", "application/json") or (name or "").endswith((".md", ".csv")):
                    text = content.decode("utf-8", "replace")
                elif mime == "application/pdf" or (mime or "").startswith("image/"):
                    error = "the pages of this file have to be recognised"
                else:
                    error = f"Unsupported file type: {mime}"
            except Exception as e:  # noqa: BLE001  a broken file is a row with an error
                error = f"{type(e).__name__}: {e}"
            out.append((text, error))
        return pd.DataFrame(out, columns=["text", "error"])

    return files.withColumn("r", run("filename", "mime", "content")).select("path", "filename", "mime", "r.text", "r.error")
