"""End-to-end runs: the training run and the batch prediction run.

These compose the operators the way the reference's two entry points do
(clean -> features -> split -> encode -> fit and compare -> store; and
validate -> history-context features -> encode -> predict -> tier -> write).
Every step is a lazy DataFrame plan; the actions are the fits, the writes
and the small metric tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.operators import cleaning as CL
from txrisk.operators import evaluation as EV
from txrisk.operators import features as FE
from txrisk.operators import mlprep as MP
from txrisk.operators import models as MD
from txrisk.operators import risk as RK
from txrisk.sources import io as IO

#: Column that carries the position of an input row through a prediction run.
ROW_ORDER = "_ord"
MODEL_ORDER = ["baseline", "random_forest", "random_forest_tuned"]


def training_run(spark: SparkSession, raw: DataFrame, out_dir: str, ts_col: str = "timestamp",
                 num_trees: int = 100, candidates=None, folds: int = 5) -> DataFrame:
    """Clean, engineer, split, fit logistic / forest / tuned forest, compare, store.

    Writes ``features``, ``split``, ``pipeline``, one folder per model, the selected model once
    more as ``best``, the long metric table ``metrics`` and, for the selected model on the
    test rows, ``test_predictions`` and ``risk_summary``; returns the comparison table with
    the selected model flagged.
    """
    clean = CL.preprocess_transactions(raw, ts_col=ts_col)
    feats = FE.engineer_features(clean, ts_col=ts_col)
    # The feature table is read by several branches (split ranks, bucket counts): write it once.
    feats = IO.read_table(spark, IO.write_table(
        MP.select_features(feats, keys=["transaction_id", "customer_id", ts_col]), os.path.join(out_dir, "features")))
    sp = MP.stratified_split(feats)
    sp = IO.read_table(spark, IO.write_table(sp, os.path.join(out_dir, "split")))   # cut lineage once
    train = sp.where(F.col("split") == "train")
    pipe = MP.feature_pipeline(train)
    enc = MP.apply_pipeline(pipe, sp)
    enc_train = enc.where(F.col("split") == "train")
    test = enc.where(F.col("split") == "test").select("transaction_id", "features", MP.TARGET)
    fitted = {"baseline": MD.train_logistic(enc_train),
              "random_forest": MD.train_forest(enc_train, num_trees=num_trees)}
    cvm, _ = MD.tune_forest(MD.stratified_folds(enc_train.select("transaction_id", "features", MP.TARGET),
                                                k=folds), candidates, num_folds=folds)
    fitted["random_forest_tuned"] = cvm.bestModel
    MD.save_model(pipe, os.path.join(out_dir, "pipeline"))
    scored = None
    for name, model in fitted.items():
        MD.save_model(model, os.path.join(out_dir, name))
        s = MD.score(model, test).withColumn("model", F.lit(name))
        scored = s if scored is None else scored.unionByName(s)
    cmp = EV.compare_models(scored.withColumnRenamed(MP.TARGET, "label"))
    IO.save_metrics(cmp.unpivot(["model"], ["accuracy", "precision", "recall", "f1_score", "roc_auc"],
                                "metric", "value"), os.path.join(out_dir, "metrics"), mode="overwrite")
    best = MD.select_best_model(cmp, MODEL_ORDER).select("model")
    name = best.first()["model"]
    MD.save_model(fitted[name], os.path.join(out_dir, "best"))
    tiers = RK.risk_level(RK.risk_score(MD.score(fitted[name], test)))
    tiers = IO.read_table(spark, IO.write_table(tiers, os.path.join(out_dir, "test_predictions")))
    IO.write_table(RK.risk_summary(tiers), os.path.join(out_dir, "risk_summary"))
    return cmp.join(best.withColumn("selected", F.lit(True)), "model", "left") \
              .withColumn("selected", F.coalesce("selected", F.lit(False)))


def default_model(spark: SparkSession, model_dir: str) -> str:
    """The first stored model of: selected, tuned forest, forest, baseline."""
    for name in ("best", *reversed(MODEL_ORDER)):
        if IO.stored_table(spark, os.path.join(model_dir, name, "metadata"), fmt="text") is not None:
            return name
    raise FileNotFoundError(f"no stored model in {model_dir}")


def prediction_run(spark: SparkSession, input_path: str, model_dir: str, output_path: str,
                   model_name: str | None = None, history_path: str | None = None,
                   policy_path: str | None = None, ts_col: str = "timestamp", fmt: str = "csv") -> DataFrame:
    """Score a transaction file: S1 -> R1 -> S2, in the order of the input; returns the run summary.

    Without ``model_name`` the :func:`default_model` scores."""
    raw = IO.scan_transactions(spark, input_path, fmt=fmt, order_col=ROW_ORDER)
    pipe = MD.load_pipeline(os.path.join(model_dir, "pipeline"))
    model = MD.load_model(spark, os.path.join(model_dir, model_name or default_model(spark, model_dir)))
    history = IO.read_table(spark, history_path) if history_path else None
    policy = IO.risk_policy(spark, policy_path)
    out = MD.score_batch(raw, pipe, model, history=history, ts_col=ts_col, policy=policy, order_col=ROW_ORDER).drop(ROW_ORDER)
    IO.write_table(out, output_path, fmt=fmt)
    return RK.batch_run_summary(IO.read_table(spark, output_path, fmt=fmt, schema=out.schema))
