"""Outputs: Parquet by split, parameters as JSON, manifest, report and CSV. Paths may be of any file system that Spark writes."""

from __future__ import annotations

import json
import platform
from dataclasses import asdict, is_dataclass
from functools import reduce
from typing import Any

import numpy
import pandas
import pyarrow
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.split import NAMES

META = ["TransactionID", "TransactionDT", "isFraud", "split", "window_id", "card_key_id", "transaction_month", "transaction_year"]


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_meta(df: DataFrame, path: str) -> None:
    write_parquet(df.select(*[c for c in META[:5] if c in df.columns]), path)


def write_splits(df: DataFrame, tracks: dict[str, list[str]], folder: str) -> None:
    """meta and each track's features as floats, for each split in a folder of its own: <name>_<split>.

    Features carry TransactionID, since rows of a table have no order. Each table is written in one job, partitioned by split,
    and read back by split without a scan of the others.
    """
    parts = {"meta": [F.col(c) for c in META if c in df.columns]} | {f"features_{k}": [F.col("TransactionID"), *[F.col(f"`{c}`").cast("float").alias(c) for c in own if c in df.columns]] for k, own in tracks.items()}
    named = F.element_at(F.array(*map(F.lit, NAMES)), F.col("split").cast("int") + 1).alias("split_name")
    for name, columns in parts.items():
        df.select(*columns, named).write.mode("overwrite").partitionBy("split_name").option("compression", "snappy").parquet(f"{folder}/{name}")


def read_split(spark: SparkSession, folder: str, name: str, split: str) -> DataFrame:
    """One table of one split, as write_splits() left it."""
    return spark.read.parquet(f"{folder}/{name}").where(F.col("split_name") == split).drop("split_name")


def union(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, which have the same columns in whatever order."""
    return reduce(DataFrame.unionByName, parts)


def plain(value: Any) -> Any:
    """Parameters as JSON has them: numpy's numbers and arrays, tuples and dataclasses become plain."""
    if is_dataclass(value) and not isinstance(value, type):
        return plain(asdict(value))
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set | frozenset):
        return [plain(v) for v in value]
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


def save_json(spark: SparkSession, value: Any, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(json.dumps(plain(value), indent=2).encode()))
    finally:
        stream.close()


def load_json(spark: SparkSession, path: str) -> Any:
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0][0])


def save_text(spark: SparkSession, text: str, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def source_of(name: str) -> str:
    """Where a feature comes from: flag, encoded, engineered, pca or raw."""
    if name.startswith("Vpca_"):
        return "pca"
    if name.endswith("_missing"):
        return "flag"
    if name.endswith("_freq") or name.endswith("_freq_log"):
        return "encoded"
    made = ("transaction_", "card_", "amt_", "card1_freq_x", "addr1_freq_x", "is_weekend", "TransactionAmt_log", "missing_crucial_info", "email_match")
    return "engineered" if name.startswith(made) else "raw"


def manifest(spark: SparkSession, tracks: dict[str, list[str]], importance: dict[str, float], psi: dict[str, float], missing: dict[str, float], aucs: dict[str, float]) -> DataFrame:
    """A row for each feature of a track, the most important first, with its rank."""
    names = list(dict.fromkeys(tracks["sel"] + tracks["pca"]))
    rows = [(c, source_of(c), c in tracks["sel"], c in tracks["pca"], float(importance.get(c, 0.0)), psi.get(c), missing.get(c), aucs.get(c)) for c in names]
    rows = [(*r, i + 1) for i, r in enumerate(sorted(rows, key=lambda r: (-r[4], r[0])))]
    schema = "name string, source string, track_a boolean, track_b boolean, importance_gain double, psi_train_val double, missing_rate_train double, univariate_auc double, importance_rank int"
    return spark.createDataFrame(rows, schema)


def write_csv(df: DataFrame, path: str, ids: list[str]) -> None:
    """Features as CSV with a header, and the identifiers beside them in <path>_ids; both carry the first identifier."""
    df.drop(*ids[1:]).write.mode("overwrite").csv(path, header=True)
    df.select(*ids).write.mode("overwrite").csv(f"{path}_ids", header=True)


#: Where the published description and the published program differ, or leave a choice, and what is done here.
DECISIONS = (
    "Rates of missing values are measured after NaN, infinities and extreme values are made missing.",
    "Equal values share their mean rank in the AUC, which is the importance unless boosted trees are asked for.",
    "Codes of categories aren't clipped, transformed or scaled; missing categories have the code of `unknown`.",
    "Component blocks follow the numbers of missing values before imputation.",
    "Flags of V groups stay in the track with components.",
)


def report(params: dict, timings: dict[str, float], counts: dict[str, int]) -> str:
    """The run in Markdown."""
    table = lambda head, rows: ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(str, r)) + " |" for r in rows), ""]
    reduced, clean, imputed = params.get("reduce", {}), params.get("clean", {}), params.get("impute", {}).get("plan", {})
    psi, importance = reduced.get("psi", {}), reduced.get("importance", {})
    lines = ["# Preparation report", "", "## Splits", "", *table(("Split", "Rows"), counts.items())]
    lines += ["## Seconds by stage", "", *table(("Stage", "Seconds"), [(k, f"{v:.1f}") for k, v in timings.items()])]
    dropped = [(k, len(v)) for k, v in clean.items()] + [("hard prune", len(reduced.get("drop_hard", ()))), ("correlation", len(reduced.get("drop_corr", ())))]
    lines += ["## Dropped columns", "", *table(("Reason", "Columns"), dropped)]
    lines += ["## Imputation", "", *table(("Method", "Columns"), [(m, sum(v == m for v in imputed.values())) for m in ("none", "knn", "median")])]
    rates = params.get("impute", {}).get("rates", params.get("missing_rate", {}))
    lines += ["## Imputation by column", "", *table(("Column", "Missing", "Method"), [(c, f"{rates.get(c, 0):.4f}", m) for c, m in sorted(imputed.items())])]
    lines += ["## Deviations", "", *table(("Setting", "Value", "Default"), [(k, v, asdict(Config())[k]) for k, v in (params.get("config") or {}).items() if asdict(Config()).get(k) != v]), *(f"* {x}" for x in DECISIONS), ""]
    lines += ["## Missing flags", "", *table(("Flag", "Taken from"), sorted(params.get("flags", {}).items()))]
    lines += ["## Selected features", "", *table(("Rank", "Feature", "Importance", "PSI"), [(i + 1, c, f"{importance.get(c, 0):.4f}", f"{psi.get(c, 0):.4f}") for i, c in enumerate(reduced.get("track_a", ()))])]
    lines += ["## Features with components", "", *table(("Place", "Feature"), [(i + 1, c) for i, c in enumerate(reduced.get("track_b", ()))])]
    lines += ["## Least stable features", "", *table(("Feature", "PSI"), [(c, f"{v:.4f}") for c, v in sorted(psi.items(), key=lambda x: -x[1])[:10]])]
    lines += ["## Versions", "", *table(("Part", "Version"), [("Python", platform.python_version()), *((m.__name__, m.__version__) for m in (pyspark, numpy, pandas, pyarrow))])]
    return "\n".join(lines)
