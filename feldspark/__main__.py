"""python -m feldspark --transactions T.csv --identity I.csv --out FOLDER [--stage all] [--sample N] [--force] [--check]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import Config
from .plans.pipeline import STAGES, Pipeline, source


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="feldspark")
    parser.add_argument("--transactions", required=True)
    parser.add_argument("--identity", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--stage", default="all", choices=["all", *STAGES])
    parser.add_argument("--sample", type=int, default=0)
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--check", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("feldspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    cfg = Config().sampled(args.sample) if args.sample else Config()
    pipeline = Pipeline(spark, cfg, args.out)
    pipeline.run(source(spark, args.transactions, args.identity, args.out, args.force), args.stage, args.force)
    if not args.check:
        return 0
    rows = pipeline.check().collect()
    for r in rows:
        print("ok  " if r["ok"] else "FAIL", r["check"], r["detail"])
    return int(not all(r["ok"] for r in rows))


if __name__ == "__main__":
    sys.exit(main())
