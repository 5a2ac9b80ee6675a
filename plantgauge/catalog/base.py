"""Registration of queries and assembly of their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plantgauge.session import configure
from plantgauge.sources.driver_views import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# named subqueries a twin may use; later ones may use earlier ones
CTES: dict[str, str] = {name: re.sub(r"\{(\w+)\}", r"\1", text) for name, text in VIEWS.items()}

DIGITS = 6


def settle_doubles(df: DataFrame) -> DataFrame:
    """Doubles at six digits; the boundary avoids exact decimal halves, so that
    summation order cannot flip a digit."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            col = F.floor(col * F.lit(1e6) + F.lit(0.5001)) / F.lit(1e6)
        out.append(col.alias(f.name))
    return df.select(*out)


def r(expr: str, digits: int) -> str:
    """The library's rounding, in SQL."""
    return f"(floor(({expr}) * 1e{digits} + 0.500001) / 1e{digits})"


def u(expr: str) -> str:
    """The md5 draw in [0, 1), in SQL."""
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def pick(expr: str, n: str) -> str:
    """The md5 draw in [0, n), in SQL."""
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT % ({n}))"


def _needed(text: str) -> list[str]:
    names = set()
    todo = [text]
    while todo:
        for word in set(re.findall(r"\w+", todo.pop())):
            if word in CTES and word not in names:
                names.add(word)
                todo.append(CTES[word])
    return [n for n in CTES if n in names]


def twin(text: str, doubles: str = "") -> str:
    """A stand-alone statement: the needed subqueries, then the query with its
    double columns settled like the Spark side."""
    ctes = [f"{n} AS ({CTES[n]})" for n in _needed(text)]
    head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
    if not doubles:
        return head + f"SELECT * FROM ({text}) AS q"
    swaps = ", ".join(f"floor({c} * 1e6 + 0.5001) / 1e6 AS {c}" for c in doubles.split())
    return head + f"SELECT * REPLACE ({swaps}) FROM ({text}) AS q"


def query(oracle: str | None = None, doubles: str = "", name: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``doubles`` lists its double columns."""

    def register(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return settle_doubles(fn(Tables(configure(spark), folder)))

        run.__name__ = key
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = twin(oracle, doubles)
        return fn

    return register
