"""A corpus pipeline of five stages over documents: language ID, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents, the
last one tokens. doc_id identifies a document. Null or empty texts have no language and go in the first stage; repeated
rows of a document are one document of its group in the second.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feldspark.llm import bpe, decontaminate, jaccard_join, language_id, secret_scan
from feldspark.llm._common import stored

#: Cosine with a language's prototype below which a document is in none of the languages.
LEAST_COSINE = 0.1
#: Words of a shingle and percent of similarity of near duplicates.
WIDTH, PERCENT = 5, 80
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in; the others go."""
    found = language_id.identify(docs, language_id.fit(docs), into=("__lang", "__score"))
    return found.where((F.col("__lang") != language_id.UNKNOWN) & (F.col("__score") >= LEAST_COSINE)).select(*docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id."""
    return jaccard_join.keep_representatives(docs, WIDTH, PERCENT)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and n_chars changed accordingly."""
    redacted = secret_scan.redact_documents(docs.withColumn("__before", F.length("text")))
    return redacted.withColumn("n_chars", F.col("n_chars") - F.col("__before") + F.length("text")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of all documents, with digests of the ids and of what they decode to."""
    return bpe.encode_texts(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", keep_known_languages),
    ("jaccard_join", keep_one_of_group),
    ("decontamination", keep_clean_of_benchmark),
    ("secret_scan", redact_secrets),
    ("bpe", encode),
]

#: Hyperdimensional cosines and merges are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each keeps is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
