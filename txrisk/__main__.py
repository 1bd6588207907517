"""Command line: ``python -m txrisk train|predict ...`` (thin wrapper over plans.runs)."""

from __future__ import annotations

import argparse
import json

from txrisk.plans.runs import prediction_run, training_run
from txrisk.session import get_spark
from txrisk.sources import io as IO


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="txrisk")
    sub = ap.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train", help="clean, engineer, split, fit and compare; store models and metrics")
    t.add_argument("--input", required=True, help="raw transaction CSV (header, text columns)")
    t.add_argument("--out", required=True, help="output folder for models, metrics and tables")
    t.add_argument("--trees", type=int, default=100)
    p = sub.add_parser("predict", help="score a transaction file with stored models")
    p.add_argument("--input", required=True)
    p.add_argument("--models", required=True, help="folder written by `train`")
    p.add_argument("--output", required=True)
    p.add_argument("--model", default=None, choices=["best", "baseline", "random_forest", "random_forest_tuned"],
                   help="default: the selected model, else the tuned forest, else the forest")
    p.add_argument("--history", default=None, help="Parquet table of earlier clean transactions")
    p.add_argument("--policy", default=None, help="JSON risk policy (thresholds)")
    ap.add_argument("--master", default=None, help="Spark master (default: from the environment)")
    args = ap.parse_args(argv)
    spark = get_spark(args.master)
    if args.cmd == "train":
        raw = IO.scan_transactions(spark, args.input)
        res = training_run(spark, raw, args.out, num_trees=args.trees)
    else:
        res = prediction_run(spark, args.input, args.models, args.output, model_name=args.model,
                             history_path=args.history, policy_path=args.policy)
    for row in res.collect():          # a handful of summary rows
        print(json.dumps(row.asDict(), default=str))


if __name__ == "__main__":
    main()
