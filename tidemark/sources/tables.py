"""Scans: the star-schema tables, and the dense weekly bar panel that stands for a market.

A panel is long: (date, instrument, fields...), one row for each instrument and calendar step from its first to its
last observation, with nulls where nothing was observed. Reads are plain Parquet scans, so filters and column lists
reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed bars: one row per (supplier, week) with open, high, low, close, vol and amount."""
    trades = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("instrument"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity", "l_extendedprice",
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("at"),
    )
    return trades.groupBy("instrument", "date").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"), F.sum("l_quantity").alias("vol"), F.sum("l_extendedprice").alias("amount"),
    )


def densify(observed: DataFrame, step_days: int = 7) -> DataFrame:
    """Every calendar step of each instrument from first to last; day_no counts steps since 1970-01-05 (a Monday)."""
    span = observed.groupBy("instrument").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    grid = span.select("instrument", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step_days} DAYS"))).alias("date"))
    dense = grid.join(observed, ["instrument", "date"], "left")
    return dense.withColumn("day_no", F.floor(F.datediff("date", F.lit("1970-01-05").cast("date")) / step_days).cast("int"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel with valuation, size, turnover and industry columns derived from the supplier."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("instrument"), F.col("s_nationkey").alias("industry"))
    dense = densify(bars(spark, sf_dir)).join(suppliers, "instrument", "left")
    key = F.col("instrument")
    return dense.select(
        "instrument", "date", "day_no", "open", "high", "low", "close", "vol", "amount",
        (F.col("vol") / (key % 50 + 100)).alias("turnover"), (F.col("close") * (key % 97 + 1000)).alias("mcap"),
        (F.col("close") / (key % 37 + 20)).alias("pe"), (F.col("close") / (key % 11 + 200)).alias("pb"), "industry",
    )


#: The same panel in SQL, as the leading CTEs of an oracle.
PANEL_SQL = """
trades AS (
  SELECT l_suppkey AS instrument, date_trunc('week', l_shipdate)::DATE AS date, l_extendedprice / l_quantity AS price,
    l_quantity, l_extendedprice, l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem
), bars AS (
  SELECT instrument, date, first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS close, sum(l_quantity) AS vol, sum(l_extendedprice) AS amount
  FROM trades GROUP BY instrument, date
), span AS (SELECT instrument, min(date) AS a, max(date) AS b FROM bars GROUP BY instrument
), grid AS (SELECT instrument, unnest(generate_series(a, b, INTERVAL 7 DAY))::DATE AS date FROM span
), panel AS (
  SELECT g.instrument, g.date, ((g.date - DATE '1970-01-05') // 7)::INTEGER AS day_no, open, high, low, close, vol, amount,
    vol / (g.instrument % 50 + 100) AS turnover, close * (g.instrument % 97 + 1000) AS mcap,
    close / (g.instrument % 37 + 20) AS pe, close / (g.instrument % 11 + 200) AS pb, s_nationkey AS industry
  FROM grid g LEFT JOIN bars b USING (instrument, date) LEFT JOIN supplier s ON s.s_suppkey = g.instrument
)"""


def _slot(base: int, step: int, mod: int, back: int) -> str:
    """A made quarterly figure, `back` quarters of 13 weeks before a row's own."""
    return f"({base} + (instrument % 31) * 10 + (((day_no - day_no % 13) / 13 - {back}) * {step} + instrument) % {mod})"


#: Figures of statements by quarter: name, and (base, step, modulus) of the made values; slots 0 (own quarter) to 7.
STATEMENT = {"rev": (1000, 37, 211), "cost": (600, 23, 173), "cfo": (90, 31, 67), "ni": (120, 41, 89), "assets": (5000, 53, 907), "cash": (400, 19, 101), "rd": (30, 7, 23), "debt": (1800, 29, 307), "cur": (1500, 43, 251), "curliab": (900, 47, 199), "inv": (300, 17, 83)}
#: Made fields beside the panel's, as SQL that Spark and DuckDB read alike: valuation, flows by order size, holdings
#: from abroad, margin trading, estimates and block trades (null where nothing happened), quarterly statement slots.
MADE_FIELDS: dict[str, str] = {
    "ps": "close / (instrument % 23 + 30)", "dv_ttm": "(instrument % 7) * 0.5", "dv_ratio": "(instrument % 5) * 0.4", "ocfps": "open / (instrument % 19 + 8)", "bps": "low / (instrument % 3 + 2)",
    "volume_ratio": "vol / (instrument % 29 + 10)", "debt_share": "30.0 + instrument % 40 + day_no % 13", "vwap": "amount / nullif(vol, 0)", "float_cap": "mcap * 0.6",
    **{f"buy_{k}": f"amount * (day_no % {m} + 1) / 100" for k, m in (("sm", 7), ("md", 11), ("lg", 13), ("xl", 5))},
    **{f"sell_{k}": f"amount * (instrument % {m} + 1) / 100" for k, m in (("sm", 9), ("md", 8), ("lg", 15), ("xl", 6))},
    "nb_ratio": "CASE WHEN instrument % 3 = 0 THEN 0.0 ELSE (day_no % 17 + instrument % 5) * 0.1 END", "nb_value": "mcap * (day_no % 17 + instrument % 5) * 0.001",
    "mg_buy": "CASE WHEN instrument % 4 <> 1 THEN amount * (day_no % 7 + 1) / 40 END", "mg_bal": "CASE WHEN instrument % 4 <> 1 THEN mcap * (day_no % 11 + 3) * 0.001 END",
    "mg_sell_vol": "CASE WHEN instrument % 4 <> 1 THEN vol * (day_no % 6) / 30 END", "mg_sec_bal": "CASE WHEN instrument % 4 <> 1 THEN mcap * (day_no % 9) * 0.0002 END",
    "eps_surprise": "CASE WHEN day_no % 13 = instrument % 13 THEN ((instrument + day_no) % 21 - 10) * 0.01 END", "rev_surprise": "CASE WHEN day_no % 13 = instrument % 13 THEN ((instrument * 3 + day_no) % 17 - 8) * 0.02 END",
    "revised_up": "CASE WHEN (day_no + instrument) % 4 = 0 THEN (day_no % 3) * 1.0 END", "revised_down": "CASE WHEN (day_no + instrument) % 4 = 0 THEN ((day_no + instrument) % 5) * 0.5 END",
    "block_net": "CASE WHEN (day_no + instrument * 7) % 9 = 0 THEN amount * ((instrument + day_no) % 5 - 2) * 0.01 END", "insider_net": "CASE WHEN (day_no + instrument * 5) % 11 = 0 THEN mcap * ((instrument + day_no) % 7 - 3) * 0.0001 END",
    "visits": "CASE WHEN (day_no + instrument * 3) % 6 = 0 THEN ((instrument + day_no) % 8) * 1.0 END", "holders": "10000.0 + (instrument % 53) * 100 + (day_no % 29) * 10",
    **{f"{name}_q{k}": _slot(*f, k) for name, f in STATEMENT.items() for k in range(8 if name in ("rev", "cost", "cfo", "ni") else 6)},
}


def wide_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with MADE_FIELDS; columns that no expression reads are pruned."""
    return panel(spark, sf_dir).selectExpr("*", *[f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in MADE_FIELDS.items()])


WIDE_SQL = f"{PANEL_SQL}, wide AS (SELECT *, {', '.join(f'CAST({sql} AS DOUBLE) AS {name}' for name, sql in MADE_FIELDS.items())} FROM panel)"


def write_by_year(df: DataFrame, path: str, date_col: str = "date", mode: str = "append", files: int = 8) -> None:
    """Sink: Parquet partitioned by the year of a date, `files` or fewer a year, each with whole instruments, sorted for narrow reads."""
    df.withColumn("year", F.year(date_col)).repartition("year", F.pmod(F.xxhash64("instrument"), F.lit(files))).sortWithinPartitions("instrument", date_col).write.mode(mode).partitionBy("year").parquet(path)


def read_window(spark: SparkSession, path: str, start: str, end: str, lookback_days: int = 0) -> DataFrame:
    """Partition-pruned read of [start - lookback, end]; trim to start after rolling expressions have been computed."""
    first = F.date_sub(F.lit(start).cast("date"), lookback_days)
    return spark.read.parquet(path).where((F.col("year") >= F.year(first)) & (F.col("year") <= F.year(F.lit(end).cast("date"))) & F.col("date").between(first, F.lit(end).cast("date")))
