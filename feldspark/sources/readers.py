"""Typed CSV and Parquet scans, and the joined source table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import roles
from ..operators import stats

INTEGERS = {"TransactionID": T.IntegerType(), "TransactionDT": T.LongType(), "isFraud": T.ByteType()}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark reads is there."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require(spark: SparkSession, *paths: str) -> None:
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing input: {', '.join(missing)}")


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("-", "_") for c in df.columns])


def type_of(name: str) -> T.DataType:
    """The type of a column of the canonical schema: integers and strings by name, all else float."""
    name = name.replace("-", "_")
    return INTEGERS.get(name) or (T.StringType() if name in roles.STRINGS else T.FloatType())


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with types by the names in its header: one scan, nothing inferred."""
    require(spark, path)
    schema = T.StructType([T.StructField(c, type_of(c)) for c in header(spark, path)])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def identity_csv(spark: SparkSession, path: str) -> DataFrame:
    """The identity file: names with _ for -, types by name; text that isn't a number is null."""
    require(spark, path)
    raw = normalise_names(spark.read.option("header", True).csv(path))
    return raw.select(*[F.col(f"`{c}`").try_cast(type_of(c)).alias(c) for c in raw.columns])


def inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    require(spark, path)
    return spark.read.csv(path, header=True, inferSchema=True)


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    require(spark, path)
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def join_identity(transactions: DataFrame, identity: DataFrame, key: str = "TransactionID", check: bool = True) -> DataFrame:
    """Transactions with their identity columns, if any. check: no key is twice in either table, so no row is added or lost."""
    if check:
        for side in (transactions, identity):
            if not stats.is_unique(side, key):
                raise ValueError(f"{key} is not unique")
    return transactions.join(identity, key, "left")


def csv_to_parquet(spark: SparkSession, transactions: str, identity: str, out: str, force: bool = False) -> DataFrame:
    """The joined source as Parquet; an existing one is taken as it is, unless force."""
    if force or not exists(spark, out):
        require(spark, transactions, identity)
        join_identity(typed_csv(spark, transactions), identity_csv(spark, identity)).write.mode("overwrite").option("compression", "snappy").parquet(out)
    return spark.read.parquet(out)
