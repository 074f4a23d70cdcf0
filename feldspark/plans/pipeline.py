"""The pipeline: fit on the training rows, transform all rows, a checkpoint after each stage, and resumption."""

from __future__ import annotations

import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import roles
from ..config import Config
from ..operators import checks, clean, encode, engineer, flags, impute, reduce, scale, split, stats, tables, winsor
from ..sources import readers, sinks

STAGES = ("split", "clean", "engineer", "encode", "flags", "winsor", "impute", "scale", "reduce", "export")
#: Stages that change no row and have no checkpoint.
VIEWS = ("split",)


class Pipeline:
    """Stages over a source table in a folder. Checkpoints lie under a digest of the configuration, so stale ones are never used.

    The split is a projection of the source, which should be a stored table: it isn't written a second time. A run that
    ended before its first checkpoint begins with the source again.
    """

    def __init__(self, spark: SparkSession, cfg: Config, folder: str):
        self.spark, self.cfg = spark, cfg
        self.folder = f"{folder.rstrip('/')}/{cfg.key()}"
        self.params: dict = {}
        self.timings: dict[str, float] = {}

    def path(self, stage: str) -> str:
        return f"{self.folder}/after_{stage}"

    def run(self, source: DataFrame | None = None, stage: str = "all", force: bool = False) -> DataFrame:
        """Runs all stages, or one after the latest checkpoint before it; force: checkpoints are made anew."""
        if stage != "all" and stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}; one of {', '.join(STAGES)}, all")
        wanted = STAGES if stage == "all" else STAGES[: STAGES.index(stage) + 1]
        first = 0
        for i, s in enumerate(wanted):
            last = i == len(wanted) - 1 and stage != "all"
            if not force and not last and readers.exists(self.spark, f"{self.path(s)}/_SUCCESS") and readers.exists(self.spark, self._params_path(s)):
                first = i + 1
        if first:
            self.params = sinks.load_json(self.spark, self._params_path(wanted[first - 1]))
            df = self.spark.read.parquet(self.path(wanted[first - 1]))
        elif source is None:
            raise ValueError("no checkpoint to resume from, and no source")
        else:
            df = source
        for s in wanted[first:]:
            began = time.time()
            with tables.compiled(self.spark):
                df = getattr(self, s)(df)
                if s not in VIEWS:
                    sinks.write_parquet(df, self.path(s))
                    df = self.spark.read.parquet(self.path(s))
            self.timings[s] = time.time() - began
            sinks.save_json(self.spark, self.params, self._params_path(s))
        return df

    def _params_path(self, stage: str) -> str:
        return f"{self.folder}/params_{stage}.json"

    def fitted(self, df: DataFrame) -> DataFrame:
        """The rows that parameters are fitted on."""
        return split.train(df) if self.cfg.fit_on == "train" else df

    # stages: each fits on the training rows, keeps its parameters, and gives the transformed table

    def split(self, df: DataFrame) -> DataFrame:
        if self.cfg.sample_n:
            df = split.head_sample(df, self.cfg.sample_n)
        placed = split.assign(clean.normalise(df), self.cfg)
        sinks.write_meta(placed, f"{self.folder}/meta")
        own = self.fitted(placed)
        columns = [c for c in placed.columns if c not in roles.META]
        rates = stats.missing_rates(own, columns)
        n = own.count()
        self.params["missing_rate"] = rates
        self.params["null_count"] = {c: round(r * n) for c, r in rates.items()}
        self.params["train_n"] = n
        return placed

    def clean(self, df: DataFrame) -> DataFrame:
        self.params["clean"] = clean.fit(self.fitted(df), self.cfg)
        return clean.transform(df, self.params["clean"])

    def engineer(self, df: DataFrame) -> DataFrame:
        return engineer.transform(df, self.cfg)

    def encode(self, df: DataFrame) -> DataFrame:
        columns = encode.plan(df)
        every = [c for own in columns.values() for c in own]
        if every:
            # frequencies are capped, codes aren't
            whole = columns["ordinal"] + columns["true_false"]
            sinks.write_parquet(encode.fit(self.fitted(df), every, self.cfg.freq_top, whole=whole), f"{self.folder}/encoders")
        vocabulary = self.spark.read.parquet(f"{self.folder}/encoders") if every else self.spark.createDataFrame([], "column string, value string, count long, code int")
        coded = [c for c in columns["true_false"] if self.cfg.flags_by_rank and not encode.is_true_false(vocabulary, c)]
        self.params["encode"] = {"plan": columns, "flags_by_code": coded}
        return encode.transform(df, vocabulary, columns, self.cfg, tuple(coded), self.params["train_n"])

    def ordinals(self) -> tuple[str, ...]:
        own = self.params["encode"]
        return (*own["plan"]["ordinal"], *own["plan"]["true_false"])

    def flags(self, df: DataFrame) -> DataFrame:
        rates = {c: r for c, r in self.params["missing_rate"].items() if c in df.columns}
        self.params["flags"] = flags.fit(df, rates, self.cfg, F.col("split") == split.TRAIN if self.cfg.fit_on == "train" else None)
        return flags.transform(df, self.params["flags"])

    def winsor(self, df: DataFrame) -> DataFrame:
        self.params["winsor"] = winsor.fit(self.fitted(df), roles.continuous(df, self.ordinals()), self.cfg)
        return winsor.transform(df, self.params["winsor"])

    def impute(self, df: DataFrame) -> DataFrame:
        own = self.fitted(df)
        columns = roles.continuous(df, self.ordinals())
        rates = stats.missing_rates(own, columns)
        self.params["impute"] = impute.fit(own, columns, rates, self.cfg) | {"rates": rates}
        ref = impute.reference(own, "TransactionID", self.cfg.knn_ref, self.cfg.seed)
        return impute.transform(df, self.params["impute"], self.cfg, ref)

    def scale(self, df: DataFrame) -> DataFrame:
        self.params["scale"] = scale.fit(self.fitted(df), roles.continuous(df, self.ordinals()))
        return scale.transform(df, self.params["scale"])

    def reduce(self, df: DataFrame) -> DataFrame:
        self.params["reduce"] = reduce.fit(df, self.params["null_count"], self.cfg)
        return reduce.transform(df, self.params["reduce"])

    def export(self, df: DataFrame) -> DataFrame:
        own = self.params["reduce"]
        tracks = {"sel": own["track_a"], "pca": own["track_b"]}
        sinks.write_splits(df, tracks, f"{self.folder}/out")
        made = sinks.manifest(self.spark, tracks, own["importance"], own["psi"], self.params["missing_rate"], own["aucs"])
        sinks.write_parquet(made, f"{self.folder}/manifest")
        sinks.save_json(self.spark, [r.asDict() for r in made.orderBy("importance_rank").collect()], f"{self.folder}/feature_manifest.json")
        sinks.save_json(self.spark, asdict(self.cfg), f"{self.folder}/config.json")
        counts = {split.NAMES[r["split"]]: r["n"] for r in split.sizes(df).collect()}
        sinks.save_text(self.spark, sinks.report(self.params | {"config": asdict(self.cfg)}, self.timings, counts), f"{self.folder}/report.md")
        return df

    def check(self, n: int | None = None) -> DataFrame:
        """(check, ok, detail) of the outputs. Nothing is caught: a check that can't run fails the caller."""
        cfg, out = self.cfg, f"{self.folder}/out"
        final = self.spark.read.parquet(self.path("reduce"))
        engineered = checks.with_key(self.spark.read.parquet(self.path("clean")), cfg).join(self.spark.read.parquet(self.path("engineer")).select("TransactionID", "card_prior_txn_count"), "TransactionID")
        names = [s for s in split.NAMES if readers.exists(self.spark, f"{out}/meta/split_name={s}")]
        parts = [sinks.read_split(self.spark, out, "features_sel", s) for s in names]
        found = [
            checks.row_total(final, n if n is not None else self.spark.read.parquet(f"{self.folder}/meta").count()),
            checks.splits_in_order(self.spark.read.parquet(f"{self.folder}/meta"), cfg),
            checks.same_columns(parts),
            checks.all_float(parts[0]),
            checks.no_null_or_inf(self.spark.read.parquet(f"{out}/features_sel").drop("split_name")),
            checks.causal(engineered, ["__card"]),
            checks.uncorrelated(split.train(final), self.params["reduce"]["track_a"], cfg),
            checks.scaled_medians(split.train(self.spark.read.parquet(self.path("scale"))), [c for c, p in self.params["scale"].items() if p["scale"] != 1.0][:30]),
        ]
        return self.spark.createDataFrame(found, "check string, ok boolean, detail string")


def transform(df: DataFrame, params: dict, vocabulary: DataFrame, cfg: Config, ref: DataFrame | None = None) -> DataFrame:
    """New rows by frozen parameters: every stage after the split, nothing fitted. Rows need their card's earlier rows for its history."""
    out = engineer.transform(clean.transform(clean.normalise(df), params["clean"]), cfg)
    own = params["encode"]
    out = encode.transform(out, vocabulary, own["plan"], cfg, tuple(own["flags_by_code"]), params["train_n"])
    out = winsor.transform(flags.transform(out, params["flags"]), params["winsor"])
    out = impute.transform(out, params["impute"], cfg, ref) if ref is not None else impute.fill(out, params["impute"]["medians"])
    return reduce.transform(scale.transform(out, params["scale"]), params["reduce"])


def stateless(df: DataFrame, params: dict) -> DataFrame:
    """The part of the transform that needs no other row, for streams: flags, clipping, medians and scaling of the columns that are there."""
    there = set(df.columns)
    out = flags.transform(df, {f: c for f, c in params["flags"].items() if c in there})
    out = winsor.transform(out, {c: p for c, p in params["winsor"].items() if c in there})
    out = impute.fill(out, {c: v for c, v in params["impute"]["medians"].items() if c in there})
    return scale.transform(out, {c: p for c, p in params["scale"].items() if c in there})


def source(spark: SparkSession, transactions: str, identity: str, folder: str, force: bool = False) -> DataFrame:
    """The joined source table of two CSV files, kept as Parquet."""
    return readers.csv_to_parquet(spark, transactions, identity, f"{folder.rstrip('/')}/source", force)


