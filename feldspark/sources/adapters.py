"""Demonstration tables in the canonical schema: derived columns by plain arithmetic, the same text in Spark and DuckDB.

The source tables have no nulls; those here come from the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of transactions from `events`; {dt} is the time in seconds.
EVENTS = {
    "TransactionID": "event_id",
    "TransactionDT": "{dt}",
    "isFraud": "CASE WHEN (event_id * 7 + user_id * 3) % 10 < 2 THEN 1 ELSE 0 END",
    "TransactionAmt": "value",
    "ProductCD": "event_type",
    "card1": "user_id",
    "card2": "CASE WHEN event_id % 20 < 1 THEN NULL ELSE user_id % 7 END",
    "card3": "150 + user_id % 3",
    "card4": "CASE WHEN event_id % 50 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'visa' WHEN user_id % 3 = 1 THEN 'mastercard' ELSE 'discover' END",
    "card5": "CASE WHEN user_id % 11 = 0 THEN NULL ELSE user_id % 5 END",
    "card6": "CASE WHEN user_id % 2 = 0 THEN 'credit' ELSE 'debit' END",
    "addr1": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id % 13 END",
    "addr2": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id % 4 END",
    "P_emaildomain": "CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN 'a.example' WHEN user_id % 4 = 2 THEN 'b.example' ELSE 'c.example' END",
    "R_emaildomain": "CASE WHEN event_id % 3 = 0 THEN NULL WHEN user_id % 4 = 1 THEN 'a.example' ELSE 'c.example' END",
    "DeviceInfo": "CASE WHEN event_id % 5 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'SAMSUNG SM-G9' ELSE 'Moto G4 Build' END",
    "D1": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id % 3 END",
    "M1": "CASE event_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'F' ELSE NULL END",
    "M4": "CASE event_id % 4 WHEN 0 THEN 'M0' WHEN 1 THEN 'M1' WHEN 2 THEN 'M2' ELSE NULL END",
    "C1": "value * (1 + user_id % 3)",
    "C2": "CAST(event_id % 17 AS DOUBLE)",
    "V1": "CASE WHEN event_id % 100 < 30 THEN NULL ELSE value + event_id % 7 END",
    "V2": "CASE WHEN event_id % 100 < 30 THEN NULL ELSE value * 2 + event_id % 5 END",
    "V3": "CASE WHEN event_id % 100 < 60 THEN NULL ELSE CAST(event_id % 23 AS DOUBLE) END",
    "V4": "CASE WHEN event_id % 100 < 95 THEN NULL ELSE value END",
    "V5": "CASE WHEN event_id % 100 < 30 THEN NULL ELSE CAST(user_id % 19 AS DOUBLE) END",
    "V6": "CASE WHEN event_id % 1000 = 0 THEN 2.0 ELSE 1.0 END",
    "V7": "1.0",
}
#: Seconds of an event since 2024-01-01.
EVENT_TIME = {"spark": "timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)", "duckdb": "CAST(floor(epoch(ts)) AS BIGINT) - 1704067200"}

#: Numeric columns from `lineitem`: k is a number for the nulls, split parts the rows 6 : 2 : 2, y is a label.
LINES = {
    "k": "l_orderkey * 31 + l_partkey * 7 + l_linenumber",
    "split": "CASE WHEN (l_orderkey + l_linenumber) % 10 < 6 THEN 0 WHEN (l_orderkey + l_linenumber) % 10 < 8 THEN 1 ELSE 2 END",
    "y": "CASE WHEN (l_partkey * 3 + l_suppkey) % 10 < 3 OR l_quantity > 45 THEN 1 ELSE 0 END",
    "qty": "l_quantity",
    "price": "l_extendedprice",
    "disc": "l_discount",
    "tax": "l_tax",
    "p03": "CASE WHEN (l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 100 < 3 THEN NULL ELSE l_extendedprice END",
    "q30": "CASE WHEN (l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 100 < 30 THEN NULL ELSE l_quantity END",
    "p30": "CASE WHEN (l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 100 < 30 THEN NULL ELSE l_extendedprice * l_tax END",
    "p60": "CASE WHEN (l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 100 < 60 THEN NULL ELSE l_extendedprice END",
    "p95": "CASE WHEN (l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 100 < 95 THEN NULL ELSE l_extendedprice END",
    "cents": "l_extendedprice * l_discount",
    "debt": "l_extendedprice * (l_tax - 0.04) * l_quantity",
    "near": "CASE WHEN l_orderkey % 1000 = 0 THEN 2.0 ELSE 1.0 END",
    "one": "1.0",
}
SPLIT = LINES["split"]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(*[F.expr(e.format(dt=EVENT_TIME["spark"])).alias(c) for c, e in EVENTS.items()])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(*[F.expr(e).alias(c) for c, e in LINES.items()])


def transactions_sql() -> str:
    return "SELECT " + ", ".join(f"{e.format(dt=EVENT_TIME['duckdb'])} AS {c}" if c != e else c for c, e in EVENTS.items()) + " FROM events"


def lines_sql() -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in LINES.items()) + " FROM lineitem"
