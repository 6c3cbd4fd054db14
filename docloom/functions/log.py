"""A log of JSON lines that shows no content: long values, values of several lines and values of telling keys are left out."""

from __future__ import annotations

import json
import logging
import re
from datetime import datetime, timezone

from docloom.functions import fixed

_TELLING = [re.compile(p) for p in fixed.REDACTED]
HIDDEN = "[REDACTED]"


def redacted(value: object) -> object:
    """A value as a log may show it."""
    if isinstance(value, str):
        return HIDDEN if len(value) > 120 or "\n" in value else value
    if isinstance(value, (list, tuple)):
        return [redacted(v) for v in value]
    if isinstance(value, dict):
        return {k: HIDDEN if any(p.search(str(k)) for p in _TELLING) else redacted(v) for k, v in value.items()}
    return value


class Log:
    """debug, info, warn and error with a message and fields; in production only warnings and errors are written."""

    def __init__(self, name: str = "docloom", production: bool = False):
        self.to, self.production = logging.getLogger(name), production

    def line(self, level: str, message: str, **fields: object) -> str | None:
        """The line of an entry; None if it is not written."""
        if self.production and level not in ("warn", "error"):
            return None
        shown = redacted(fields)
        return json.dumps({"timestamp": datetime.now(timezone.utc).isoformat(), "level": level, "message": redacted(message), **shown}, ensure_ascii=False, default=str)

    def write(self, level: str, message: str, **fields: object) -> None:
        if (line := self.line(level, message, **fields)) is not None:
            self.to.log({"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}[level], line)

    def debug(self, message: str, **fields: object) -> None:
        self.write("debug", message, **fields)

    def info(self, message: str, **fields: object) -> None:
        self.write("info", message, **fields)

    def warn(self, message: str, **fields: object) -> None:
        self.write("warn", message, **fields)

    def error(self, message: str, **fields: object) -> None:
        self.write("error", message, **fields)
