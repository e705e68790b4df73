"""Registered queries: each runs an operator chain over the fixture views of one
scale-factor folder. ``ORACLES`` holds the independent DuckDB statement of the
same result for the correctness gate. Double outputs are rounded to 6 decimals
in both engines only at this presentation edge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich as E
from ..operators import features as FT
from ..sources.fixtures import Views, with_views
from . import sqlparts as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def decimal_rounding(sql: str) -> str:
    """Rewrite every ``round(x, d)`` as rounding of ``x`` cast to DECIMAL.

    Spark rounds a double through its decimal value (half up), DuckDB through
    the binary value; on exact ties like 7.9390625 they differ. Rounding the
    decimal cast in DuckDB gives Spark's answer.
    """
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 1, j + 6, -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        if comma < 0:
            out.append(sql[i:k])
        else:
            inner = decimal_rounding(sql[j + 6:comma])
            digits = sql[comma + 1:k - 1].strip()
            out.append(sql[i:j] + f"cast(round(cast({inner} as decimal(38,12)), {digits}) as double)")
        i = k


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = decimal_rounding(oracle)
        return fn
    return deco


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals (comparison edge only), after 12: both
    engines then see the same decimal where a value lies within an ulp of a tie."""
    return df.select(*[F.round(F.round(F.col(c), 12), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r6sql(cols: list[str]) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


def enriched(v: Views, completed_only: bool = True) -> DataFrame:
    return E.enrich(v.history, v.fg, v.capacity, v.shortage, completed_only)


def train_rows(v: Views, columns: list[str] | None = None) -> DataFrame:
    """Training rows (T2 -> F3 -> T3 -> F4). Each feature query reads them several
    times; the joins behind them are written once under the shared checkpoint folder, with
    the ``columns`` that the query reads, if not all."""
    return E.training_rows(enriched(v), columns=columns)


#: What the workload, history and encoding queries read of the training rows.
TIMED_READ = ["production_number", "material", "production_line", "created_date", "planned_start_date", "actual_start_date",
              "order_quantity", FT.TARGET]
