"""Registry of named driver queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from . import params as P

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def query(name: str, oracle: Callable[[], str] | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = lambda: nudge_rounding(oracle())
        return fn

    return deco


NUDGE = 1e-9  # moves exact decimal ties off the rounding boundary, same on both sides


def nudge_rounding(sql: str, places: int = P.ROUND) -> str:
    """Rewrite every ``round(<expr>, 6)`` of an oracle text to ``round(<expr> + 1e-9, 6)``."""
    out, i, key = [], 0, "round("
    tail = f", {places})"
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            ch = sql[k]
            depth += ch == "("
            depth -= ch == ")"
            if depth == 0:
                break
            k += 1
        inner = sql[j + len(key):k + 1]
        if inner.endswith(tail):
            expr = nudge_rounding(inner[: -len(tail)], places)
            out.append(sql[i:j] + f"round(({expr}) + {NUDGE}{tail}")
        else:
            out.append(sql[i:k + 1])
        i = k + 1


def rounded(df: DataFrame, places: int = P.ROUND, fine: tuple = (), coarse: tuple = ()) -> DataFrame:
    """Round every floating column (results are compared to 6 places).

    ``fine`` columns (interpolated percentiles, whose exact decimal value has
    seven digits and would sit on a rounding tie at six) are rounded to 9;
    ``coarse`` columns (magnitudes near 1e8, e.g. joules, where summation order
    moves the sixth decimal) are rounded to 3.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            if f.name in fine:
                cols.append(F.round(F.col(f.name), 9).alias(f.name))
            elif f.name in coarse:
                cols.append(F.round(F.col(f.name) + NUDGE, 3).alias(f.name))
            else:
                cols.append(F.round(F.col(f.name) + NUDGE, places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
