"""The nested search: shared trees, the out-of-fold table, and the same choice as a search that shares nothing."""
import duckdb
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from txrisk.operators import mlprep as MP
from txrisk.operators import models as MD
from txrisk.plans import queries_ml as QM

CANDIDATES = [{"numTrees": 9, "maxDepth": 6}, {"numTrees": 3, "maxDepth": 1}, {"numTrees": 3, "maxDepth": 6}]


@pytest.fixture(scope="module")
def searched(spark):
    sp = QM.split_table(spark, "/root/testdata/sf0.01").cache()
    enc = MP.apply_pipeline(MP.feature_pipeline(sp.where(F.col("split") == "train")), sp)
    train = MD.stratified_folds(enc.where(F.col("split") == "train").select("transaction_id", "features", "is_anomaly"), k=2).cache()
    return train, MD.tune_forest(train, CANDIDATES, num_folds=2, partitions=2)[0]


def test_groups_grow_their_largest_forest_once():
    assert MD.nested_groups(CANDIDATES) == [({"maxDepth": 6}, [(3, [2]), (6, [0])]), ({"maxDepth": 1}, [(3, [1])])]
    whole = MD.nested_groups(MD.sample_candidates())
    assert sorted(i for _, steps in whole for _, ids in steps for i in ids) == list(range(15))
    grown = sum(n for _, steps in whole for n, _ in steps)
    assert grown < sum(c["numTrees"] for c in MD.sample_candidates())


def test_same_choice_as_an_unshared_search(searched):
    train, found = searched
    ev = MulticlassClassificationEvaluator(labelCol="is_anomaly", metricName="fMeasureByLabel", metricLabel=1.0)
    data = MD._dealt(train, "features", ["is_anomaly", "fold", "transaction_id"], "transaction_id", 2).cache()
    alone = []
    for c in CANDIDATES:
        rf = RandomForestClassifier(featuresCol="features", labelCol="is_anomaly", maxBins=MD.MAX_BINS, seed=MD.RANDOM_STATE, **c)
        alone.append(sum(ev.evaluate(rf.fit(data.where(F.col("fold") != k)).transform(data.where(F.col("fold") == k))) for k in (0, 1)) / 2)
    # the smallest forest of a group is the very forest an unshared search grows
    assert found.avgMetrics[1:] == pytest.approx(alone[1:], abs=1e-12)
    best = max(range(3), key=lambda i: alone[i])
    assert found.bestParams == CANDIDATES[best] and found.bestModel.getNumTrees == CANDIDATES[best]["numTrees"]


def test_results_are_read_off_the_score_table(spark, searched):
    train, found = searched
    assert found.scores.count() == 3 * train.count()
    files = ", ".join(f"'{f.removeprefix('file://')}'" for f in found.scores.inputFiles())
    sql = f"""
      WITH c AS (SELECT candidate, _fold, count(*) FILTER (prediction = 1 AND is_anomaly = 1) AS tp,
                   count(*) FILTER (prediction <> is_anomaly) AS wrong FROM read_parquet([{files}]) GROUP BY ALL),
      f AS (SELECT candidate, CASE WHEN 2 * tp + wrong = 0 THEN 0 ELSE 2 * tp / (2 * tp + wrong) END AS f1 FROM c)
      SELECT candidate, avg(f1), stddev_pop(f1), rank() OVER (ORDER BY avg(f1) DESC) FROM f GROUP BY candidate"""
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    got = MD.cv_results(spark, found).collect()
    assert {r.candidate for r in got} == set(want) == {0, 1, 2}
    for r in got:
        mean, sd, rank = want[r.candidate]
        assert (r.mean_test_score, r.std_test_score) == pytest.approx((mean, sd)) and r.rank_test_score == rank
        assert r.params == str(CANDIDATES[r.candidate]) and len(r.split_test_scores) == 2


def test_partitions_follow_the_rows():
    parts = [MD.fit_partitions(n) for n in (0, 1, 8_000, 80_000, 10**6, 10**8, 10**10)]
    assert parts == [1, 1, 8, 80, 1000, 10_000, 100_000]


def test_forests_take_few_partitions():
    """Every partition sends the statistics of all open nodes, so a forest's input of 480,000 rows is not cut into 480."""
    parts = [MD.forest_partitions(n) for n in (0, 1, 8_000, 80_000, 480_000, 4_800_000, 28_800_000)]
    assert parts == [1, 1, 8, 12, 12, 48, 288]


def test_forest_keeps_node_ids_and_its_model(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("transaction_id"), ((F.col("id") * 37) % 101).cast("double").alias("x"),
                                    ((F.col("id") * 53) % 89).cast("double").alias("y"))
    rows = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(rows).withColumn(
        "is_anomaly", ((F.col("x") * F.col("y")) % 7 < 2).cast("int"))
    a, b = (MD.train_forest(rows, num_trees=4, max_depth=9, **kw) for kw in ({}, {"cacheNodeIds": False}))
    assert a.getCacheNodeIds() and a.toDebugString.split("\n")[1:] == b.toDebugString.split("\n")[1:] and a.totalNumNodes > 100


def test_every_fold_keeps_the_rows_it_trains_on(spark, monkeypatch):
    """Fits of few partitions read from one kept copy would all wait for the executors that hold it."""
    rows = spark.range(600).select(F.col("id").cast("string").alias("transaction_id"), (F.col("id") % 7).cast("double").alias("x"),
                                   (F.col("id") % 2).cast("int").alias("is_anomaly"), (F.col("id") % 3).cast("int").alias("fold"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    seen = []

    def look(rf, rest, added, train, valid, seed):
        seen.append((train, train.storageLevel.useMemory, train.rdd.getNumPartitions(), train.count(), train.columns))
        return valid.drop("features").select("*", F.lit(0).alias("candidate"), F.lit(0.0).alias("prediction"))
    monkeypatch.setattr(MD, "_grown", look)
    scores = MD.search_scores(rows, CANDIDATES, num_folds=3, partitions=2)
    assert len(seen) == 6 and len({id(train) for train, *_ in seen}) == 3
    assert [got[1:] for got in seen] == [(True, 2, 400, ["features", "is_anomaly"])] * 6
    assert not any(train.storageLevel.useMemory for train, *_ in seen)
    assert sorted(scores.columns) == ["candidate", "fold", "is_anomaly", "prediction", "transaction_id"] and scores.count() == 1200
