"""The engine's log: one logger, to the console and, if asked for, to a file on the driver."""

from __future__ import annotations

import logging
import sys

FORMAT = "%(asctime)s %(levelname)-7s %(name)s: %(message)s"


def logger(name: str = "cadenza", level: str = "INFO", file: str | None = None) -> logging.Logger:
    """The logger of that name. Called again, it takes the new level and adds the file, but never a handler twice."""
    log = logging.getLogger(name)
    log.setLevel(level)
    log.propagate = False
    have = {getattr(h, "baseFilename", "console") for h in log.handlers}
    handlers = [] if "console" in have else [logging.StreamHandler(sys.stderr)]
    if file:
        wanted = logging.FileHandler(file, encoding="utf-8", delay=True)
        handlers += [] if wanted.baseFilename in have else [wanted]
    for h in handlers:
        h.setFormatter(logging.Formatter(FORMAT))
        log.addHandler(h)
    return log


def report_errors(log: logging.Logger, df, keys: list[str], most: int = 100) -> int:
    """Log the series whose row has an error (of reduce_series), at most `most` of them; returns how many there are."""
    bad = df.where("error is not null").select(*keys, "error").distinct()
    n = bad.count()
    for r in bad.orderBy(*keys).limit(most).collect():
        log.error("%s: %s", "/".join(str(r[k]) for k in keys), r["error"])
    if n > most:
        log.error("and %d more series", n - most)
    return n
