"""Laboratory values with a unit, their panels, tables and changes: the first of three extractors.

Every match of a test counts, values stay as they are written, and a status needs a range. Null texts have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed, text


def shown(low: float | None, high: float | None) -> str | None:
    """A range as it is written."""
    return None if low is None else f"{low:g}-{high:g}"


def _one(test: str, pattern: str, low: float | None, high: float | None) -> Column:
    """All places of a test in a text: test, value, unit, range, status."""

    def row(place: Column) -> Column:
        value = F.regexp_extract(place, pattern, 1)
        x = value.cast("double")
        status = F.lit("Normal")
        if low is not None:
            below, above = fixed.FIRST_CRITICAL.get(test, (None, None))
            status = F.when(x < low, "Low").when(x > high, "High").otherwise("Normal")
            bad = [x < below] * (below is not None) + [x > above] * (above is not None)
            for test_ in bad:
                status = F.when(test_, "Critical").otherwise(status)
        return F.struct(F.lit(test).alias("test"), value.alias("value"), F.regexp_extract(place, fixed.FIRST_UNIT, 2).alias("unit"), F.lit(shown(low, high)).alias("reference"), status.alias("status"))

    return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), row)


def labs(notes: DataFrame) -> DataFrame:
    """doc_id, idx (in the order of tests, then of places), test, value, unit, reference, status."""
    each = F.concat(*[_one(test, *v) for test, v in fixed.FIRST_LABS.items()])
    return notes.where("text is not null").select("doc_id", F.posexplode(each).alias("idx", "lab")).select("doc_id", "idx", "lab.*")


def panel_name(test: Column, panels: list[tuple[str, list[str]]] = fixed.FIRST_PANELS, other: str = "Lab Results") -> Column:
    """An aggregate over tests: the first panel with one of them."""
    out = F.lit(other)
    for name, tests in reversed(panels):
        out = F.when(F.max(test.isin(tests)), name).otherwise(out)
    return out


def joined(lines: Column, order: Column) -> Column:
    """An aggregate: lines in order, with line ends between."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("at"), lines.alias("line")))), lambda s: s["line"]), "\n")


def sign(status: Column, signs: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in signs.items() for x in kv]), status)


def tables(found: DataFrame, date: DataFrame) -> DataFrame:
    """doc_id, panel and markdown: the table of each document's values. date: doc_id and the date as it is to be shown."""
    row = F.concat(F.lit("| "), "test", F.lit(" | "), "value", F.lit(" "), "unit", F.lit(" | "), F.coalesce("reference", F.lit("N/A")), F.lit(" | "), sign(F.col("status"), fixed.STATUS_SIGNS), F.lit(" "), "status", F.lit(" |"))
    rows = found.groupBy("doc_id").agg(panel_name(F.col("test")).alias("panel"), joined(row, F.col("idx")).alias("rows"))
    head = F.concat(F.lit("### 🧪 "), "panel", F.lit("\n**Date**: "), "date", F.lit("\n\n| Test | Value | Reference Range | Status |\n|------|-------|----------------|--------|\n"), "rows", F.lit("\n"))
    return rows.join(date, "doc_id").select("doc_id", "panel", head.alias("markdown"))


def changes(found: DataFrame, order: DataFrame) -> DataFrame:
    """doc_id, idx, test, previous, value and change in per cent of values whose test the panel before has too.

    order: doc_id and place, the panels' places from 1 without gaps. Of a test that the panel before has more than once the
    first value counts. Where that is 0 the change is not a number or infinite, as it is written."""
    now = found.join(order, "doc_id").withColumn("x", F.col("value").try_cast("double")).where("x is not null")
    before = now.groupBy((F.col("place") + 1).alias("place"), "test").agg(F.min(F.struct("idx", "x"))["x"].alias("previous"))
    rows = now.join(before, ["place", "test"]).withColumn("change", F.col("x") - F.col("previous"))
    part = F.try_divide("change", "previous")
    shown_part = F.when(F.col("previous") != 0, text.fixed_decimals(part * 100, 1)).otherwise(F.when(F.col("change") > 0, "Infinity").when(F.col("change") < 0, "-Infinity").otherwise("NaN"))
    big = (F.abs(part) > 0.10) | ((F.col("previous") == 0) & (F.col("change") != 0))
    way = F.when(F.col("change") > 0, "↑").when(F.col("change") < 0, "↓").otherwise("→")
    bold = F.when(F.coalesce(big, F.lit(False)), "**").otherwise("")
    line = F.concat(F.lit("- "), bold, "test", bold, F.lit(": "), text.number(F.col("previous")), F.lit(" → "), text.number(F.col("x")), F.lit(" ("), way, F.lit(" "), shown_part, F.lit("%)"))
    return rows.select("doc_id", "idx", "test", "previous", F.col("x").alias("value"), (part * 100).alias("change_pct"), line.alias("line"))


def trends(found: DataFrame, order: DataFrame) -> DataFrame:
    """doc_id and markdown: the changes against the panel before."""
    rows = changes(found, order).groupBy("doc_id").agg(joined(F.col("line"), F.col("idx")).alias("lines"))
    return rows.select("doc_id", F.concat(F.lit("#### Trends vs Previous\n"), "lines").alias("markdown"))
