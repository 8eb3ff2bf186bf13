"""The grouped map that sequential operators share: a series at a time, sorted, as numpy arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cadenza.schema import KEYS, CadenzaError


def _types(df: DataFrame, names: list[str]) -> str:
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{n}` {fields[n]}" for n in names)


def per_series(df: DataFrame, fn: Callable[..., dict], columns: str, keys: list[str] = KEYS, order: str = "mjd", value: str | list[str] = "value") -> DataFrame:
    """fn(t, x, ...) of each series gives arrays of the series' length, which become columns beside all others.

    A series is one group, so it must fit in a task; series run in parallel.
    """
    values = [value] if isinstance(value, str) else value

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        return pdf.assign(**fn(pdf[order].to_numpy(float), *[pdf[v].to_numpy(float) for v in values]))

    names = [c.split()[0] for c in columns.split(",")]
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept).groupBy(*keys).applyInPandas(run, f"{_types(df, kept)}, {columns}")


def reduce_series(df: DataFrame, fn: Callable[..., list[dict] | dict], columns: str, keys: list[str] = KEYS, order: str = "mjd", value: str | list[str] = "value") -> DataFrame:
    """fn(t, x, ...) of each series gives one row or several. A series that fails gives a row with its error instead."""
    values = [value] if isinstance(value, str) else value
    names = [c.split()[0] for c in _top_level(columns)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        key = {k: pdf[k].iloc[0] for k in keys}
        try:
            rows = fn(pdf[order].to_numpy(float), *[pdf[v].to_numpy(float) for v in values])
            rows = [rows] if isinstance(rows, dict) else rows
            error = None
        except (ArithmeticError, LookupError, ValueError, np.linalg.LinAlgError, CadenzaError) as e:
            rows, error = [{}], f"{type(e).__name__}: {e}"
        return pd.DataFrame([{**key, **{n: r.get(n) for n in names}, "error": error} for r in rows], columns=[*keys, *names, "error"])

    return df.select(*keys, order, *values).groupBy(*keys).applyInPandas(run, f"{_types(df, keys)}, {columns}, error string")


def _top_level(columns: str) -> list[str]:
    """Column declarations, cut at commas outside of angle brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(columns[at:i].strip())
            at = i + 1
    return [*out, columns[at:].strip()]
