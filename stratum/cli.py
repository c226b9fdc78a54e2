"""Command line: advise layouts, generate arrival rates, forecast them.

    python -m stratum.cli advise TABLES QUERIES OUT --key orders=o_orderkey [--key ...] [--method greedy]
    python -m stratum.cli generate OUT [--templates 99] [--steps 2016] [--seed 0]
    python -m stratum.cli forecast RATES OUT [--method linear] [--horizon 288]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from stratum.advisor import Advisor
from stratum.functions import arrival
from stratum.operators import forecast
from stratum.sources import corpus


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="stratum")
    sub = out.add_subparsers(dest="command", required=True)
    advise = sub.add_parser("advise", help="lay out tables for a folder of queries")
    for name in ("tables", "queries", "out"):
        advise.add_argument(name)
    advise.add_argument("--key", action="append", required=True, metavar="TABLE=COLUMN[,COLUMN]")
    advise.add_argument("--method", choices=("greedy", "exhaustive", "agent"), default="greedy")
    generate = sub.add_parser("generate", help="write sampled arrival rates as CSV, a column for each template")
    generate.add_argument("out")
    generate.add_argument("--templates", type=int, default=99)
    generate.add_argument("--steps", type=int, default=arrival.WEEK)
    generate.add_argument("--seed", type=int, default=0)
    ahead = sub.add_parser("forecast", help="rolling forecasts of (template_id, t, rate) rows in Parquet")
    ahead.add_argument("rates")
    ahead.add_argument("out")
    ahead.add_argument("--method", choices=sorted(forecast.MODELS), default="linear")
    ahead.add_argument("--horizon", type=int, default=forecast.LOOK_BACK)
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "advise":
        keys = {k: v.split(",") for k, v in (x.split("=", 1) for x in args.key)}
        queries = {r.query_id: r.sql for r in corpus.sql_corpus(spark, args.queries).collect()}  # one row per file
        advisor = Advisor(spark, args.tables, queries, keys)
        advisor.materialize(advisor.recommend(args.method), args.out)
        advisor.compare().show(truncate=False)
    elif args.command == "generate":
        patterns = arrival.sample_patterns(args.templates, args.steps, args.seed)
        rates = arrival.arrival_rates(spark, patterns, args.steps, args.seed)
        corpus.save_csv(arrival.wide(rates, [p.template_id for p in patterns]), args.out)
    else:
        series = spark.read.parquet(args.rates)
        forecast.rolling_forecast(series, {args.method: 1.0}, args.horizon).write.mode("overwrite").parquet(args.out)


def main() -> None:
    run(SparkSession.builder.appName("stratum").getOrCreate(), parser().parse_args())


if __name__ == "__main__":
    main()
