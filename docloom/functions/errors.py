"""Errors as rows, and runs that are tried again."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tag, impact and what helps, of errors that a run can go on after.
KINDS = {
    "ParseError": (None, "Check the file's format."), "DateAmbiguityError": ("medium", "Check month and day."), "OCRWarning": ("low", "Read the page again."),
    "DeduplicationError": ("medium", "Compare the events."), "CompressionSizeExceededError": ("high", "Allow a larger size."), "ValidationError": ("high", "Correct the value."), "FileSystemError": ("high", "Check path and rights."),
}


class Failure(Exception):
    """An error with a tag, details and whether another try may help."""

    def __init__(self, tag: str, message: str, recoverable: bool = True, **details: object):
        super().__init__(message)
        self.tag, self.message, self.recoverable, self.details = tag, message, recoverable, details

    def record(self) -> dict:
        """The error as a row."""
        impact, help_ = KINDS.get(self.tag, (None, ""))
        return {"tag": self.tag, "message": self.message, "recoverable": self.recoverable, "impact": impact, "suggestion": help_, "details": {k: str(v) for k, v in self.details.items()}}


def record(tag: str, message: Column, recoverable: bool = True, **details: Column) -> list[Column]:
    """The columns of an error row."""
    impact, help_ = KINDS.get(tag, (None, ""))
    held = F.create_map(*[x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]) if details else F.create_map().cast("map<string,string>")
    return [F.lit(tag).alias("tag"), message.alias("message"), F.lit(recoverable).alias("recoverable"), F.lit(impact).cast("string").alias("impact"), F.lit(help_).alias("suggestion"), held.alias("details")]


def collected(errors: DataFrame) -> DataFrame:
    """One row of an error table (columns tag and recoverable): all, those that a run cannot go on after, and the number of each tag."""
    each = errors.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("recoverable")).alias("bad"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("errors"), F.coalesce(F.sum("bad"), F.lit(0)).alias("unrecoverable"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("by_tag"))


def tried(run: Callable[[], object], attempts: int = 3, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[object, Exception | None]:
    """The result of a run and no error, or no result and the last error; waits twice as long before each further try and ends at an error that is not recoverable.

    For the driver's own steps; tasks are tried again by Spark."""
    if attempts <= 0:
        raise ValueError("attempts must be greater than 0")
    last: Exception | None = None
    for k in range(attempts):
        try:
            return run(), None
        except Exception as e:  # noqa: BLE001  the caller gets it
            last = e
            if not getattr(e, "recoverable", True):
                break
            if k + 1 < attempts:
                sleep(delay * 2**k)
    return None, last
