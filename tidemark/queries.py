"""Every query of the reference's operators, by name, with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.catalog import FAMILIES, WIDE_FAMILIES
from tidemark.plans.expression import compile_frame, compile_sql
from tidemark.sources.tables import PANEL_SQL, WIDE_SQL, panel, wide_panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Decimals kept of results, and a shift off the halfway points, so that two engines' sums agree.
PLACES, SHIFT = 6, 3.3e-10


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded, a negative zero as zero, and dates as text: what two engines print alike."""
    shown = {"double": lambda c: F.round(F.col(c) + SHIFT, PLACES) + F.lit(0.0), "date": lambda c: F.col(c).cast("string")}
    return df.select(*[shown.get(t, F.col)(c).alias(c) for c, t in df.dtypes])


def r6(sql: str) -> str:
    """rounded() of a double, in SQL."""
    return f"round({sql} + {SHIFT}, {PLACES}) + 0.0"


def _factor_query(family: dict[str, str], source: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(compile_frame(source(spark, sf_dir), family).select("instrument", "date", *family))


def _factor_sql(family: dict[str, str], with_sql: str, source: str) -> str:
    ctes, columns = compile_sql(family, source)
    listed = ", ".join(f"{r6(sql)} AS {name}" for name, sql in columns.items())
    return f"WITH {with_sql},\n{ctes}\nSELECT instrument, date::VARCHAR AS date, {listed} FROM _last"


for _families, _read, _with, _source in ((FAMILIES, panel, PANEL_SQL, "panel"), (WIDE_FAMILIES, wide_panel, WIDE_SQL, "wide")):
    for _name, _family in _families.items():
        QUERIES[f"factors_{_name}"] = _factor_query(_family, _read)
        ORACLE_SQL[f"factors_{_name}"] = _factor_sql(_family, _with, _source)


def query(name: str, sql: str | None = None, with_panel: bool = True):
    """Register a query; sql may start from the panel's CTEs."""
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {PANEL_SQL},\n{sql}" if with_panel else sql
        return f

    return register


from tidemark import disclosure_queries, lifecycle_queries, panel_queries, selection_queries, universe_queries, validation_queries  # noqa: E402, F401
