import os

import pytest
from pyspark.sql import functions as F

from sparkwarden.config import AlertConfig, Config, GraphConfig, ModelConfig
from sparkwarden.operators import evaluation, features, ml
from sparkwarden.plans.pipeline import Pipeline
from sparkwarden.sources import ledger, sinks
from sparkwarden.streaming import velocity


@pytest.fixture(scope="module")
def sample(spark):
    df = ledger.synthetic(spark, 600, 7)
    # labelled rows stand out, so that a model can find them
    return df.withColumn("amount", F.when(F.col("is_laundering") == 1, 60_000.0).otherwise(F.least("amount", F.lit(20_000.0)))).cache()


def test_all_stages(spark, sample, tmp_path):
    p = Pipeline(spark, Config(graph=GraphConfig(max_cycle=3), alerts=AlertConfig(threshold=0.05)), str(tmp_path))
    out = p.run(sample)
    assert set(p.status.values()) == {"completed"} and p.failed is None
    assert out["ml_scores"].count() == 600 and out["alerts"].count() > 0
    assert out["triage"].count() <= 50
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == out["alerts"].count()
    systems = {r["system"]: r for r in p.evaluate()["systems"].collect()}
    assert set(systems) == {"rules", "ml", "hybrid"}
    assert (tmp_path / "report.html").read_text().startswith("<!doctype html>") and "narratives" in out["report_page"]
    assert out["central_accounts"].count() == 5


def test_stage_errors(spark):
    p = Pipeline(spark)
    assert p.run(stages=("nothing",)) == {}
    with pytest.raises(ValueError):
        p.run_target("nothing")
    with pytest.raises(ValueError):
        p.run_stage("nothing")
    with pytest.raises(RuntimeError):
        p.run_stage("rule_engine")
    assert p.failed == "rule_engine" and p.status["rule_engine"] == "failed"


def test_features(spark, sample):
    f = features.engineer(sample).collect()
    assert len(f) == 600 and all(x is not None and x == x for r in f[:50] for x in r)
    groups = features.importance_groups(sample)
    assert len(groups["temporal"]) == 40 and "rule" not in groups


def test_streams(spark, sample, tmp_path):
    sample.select("transaction_id", "timestamp", "from_id", "amount").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    run = velocity.sliding_velocity(stream, hours=24, slide_minutes=720, threshold=1).writeStream.format("memory").queryName("v").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("v").count() >= 0
    run = velocity.stateless(stream).writeStream.format("memory").queryName("s").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("s").count() == 600


def test_no_model_means_review_of_all(spark, sample):
    def broken():
        raise OSError("no route")

    p = Pipeline(spark, connect=broken)
    p.results["alerts"] = spark.createDataFrame(
        [("a1", "B_1", "LOW", ["velocity"], 0.5, 0.4, 0.1, [], None)],
        "alert_id string, entity_id string, severity string, triggered_rules array<string>, ensemble_score double, ml_score double, graph_score double, "
        "transactions array<struct<timestamp:timestamp,from_id:string,to_id:string,amount:double,payment_format:string,is_laundering:int>>, context string",
    )
    row = p.run_stage("llm_triage")["triage"].first()
    assert row["error"] == "no route" and row["recommended_disposition"] == "CONTINUE_MONITORING" and row["confidence_level"] == "LOW"


def test_files_of_a_folder(spark, tmp_path):
    one = spark.createDataFrame([("auc", 0.5)], "metric string, value double")
    assert sinks.latest_alerts(spark, str(tmp_path)) is None
    assert sinks.latest_metrics(spark, str(tmp_path), {"auc": 0.1}).first()["value"] == 0.1
    sinks.export_evaluation(one, str(tmp_path / "evaluation_1.json"))
    assert sinks.latest_metrics(spark, str(tmp_path)).first()["value"] == 0.5
    for name, second in (("b", 1), ("a", 2)):
        path = tmp_path / "alerts" / f"{name}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text(f'[{{"alert_id": "{name}"}}]')
        os.utime(path, (second, second))
    assert sinks.latest_alerts(spark, str(tmp_path)).first()["alert_id"] == "a"
    sinks.log_metrics(one, str(tmp_path / "log"), "r", {"seed": 1})
    assert {(r["kind"], r["name"], r["value"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()} == {("metric", "auc", "0.5"), ("param", "seed", "1")}


def test_summary_text():
    flat = evaluation.flatten({"a": {"b": 1, "c": True}, "d": [1, 2], "e": list(range(30)), "f": None})
    assert flat == {"a.b": 1.0, "a.c": 1.0, "d": "[1, 2]"}
    assert evaluation.summary_text({"ml": {"auc": 0.25}}) == "ml\n  auc: 0.25"


def test_models(spark):
    # label 1 where x is large; a is noise
    rows = [(i, float(i % 100), float(i * 7919 % 101), int(i % 100 >= 95)) for i in range(600)]
    df = spark.createDataFrame(rows, "transaction_id long, x double, a double, label int")
    more = ml.oversample(df, ModelConfig(minority_ratio=0.5)).cache()
    made = more.where("transaction_id < 0")
    # mixtures of rows of the rarer class stay between them; the whole part of the copies is exact
    assert more.where("transaction_id >= 0").count() == 600 and made.where("label <> 1 or x < 95 or x > 99").count() == 0
    assert abs(made.count() - 255) <= 30 and made.select("transaction_id").distinct().count() == made.count()
    again = ml.oversample(df, ModelConfig(minority_ratio=0.5)).where("transaction_id < 0")
    assert again.exceptAll(made).count() == 0
    assert ml.oversample(df.where("label = 0")).count() == 570
    part = F.pmod(F.col("transaction_id"), F.lit(3))
    trained = ml.train(df.where(part > 0), df.where(part == 0), ModelConfig(rounds=8), resample=True)
    assert trained.metrics["average_precision"] > 0.99
    why = trained.explain(df.where("label = 1"), top=1).collect()
    assert len(why) == 30 and all(r["feature"] == "x" and r["value"] >= 95 and r["effect"] > 0 for r in why)
    # where nothing can be learned, boosting stops early
    noise = df.withColumn("label", F.pmod(F.xxhash64("transaction_id"), F.lit(2)).cast("int"))
    found = ml.candidates(noise.where(part > 0), noise.where(part == 0), ModelConfig(rounds=20))
    assert found[0].model.stages[-1].getNumTrees < 20 and len(found[1].model.trees) < 20
