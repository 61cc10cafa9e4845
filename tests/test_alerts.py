from datetime import datetime

import pytest
from helpers import ledger
from pyspark.sql import functions as F

from sparkwarden.operators import alerts, evaluation, ml, report, rules, triage


def scored(spark, rows):
    """rows: (sender, composite, model score)."""
    df = ledger(spark, [(s, f"R{i}", 100.0 * (i + 1), i) for i, (s, _, _) in enumerate(rows)])
    extra = spark.createDataFrame([(i, float(c), float(m)) for i, (_, c, m) in enumerate(rows)], "transaction_id long, rule_composite_score double, ml_score double")
    df = df.join(extra, "transaction_id").withColumns({rules.score_name(r): F.lit(0.0) for r in rules.RULES})
    return df.withColumn("rule_structuring_score", F.col("rule_composite_score")).withColumns({"rule_trigger_count": F.lit(1), "payment_currency": F.lit("USD")})


def generate(spark, rows, **kw):
    df = scored(spark, rows)
    return alerts.generate(df.drop("ml_score"), df.select("transaction_id", "ml_score"), **kw)


def test_threshold_and_severity(spark):
    got = generate(spark, [("A", 0.9, 0.95), ("B", 0.1, 0.05)]).collect()
    assert len(got) == 1 and got[0]["ensemble_score"] == pytest.approx(0.6975) and got[0]["severity"] == "MEDIUM" and got[0]["triggered_rules"] == ["structuring"]
    assert generate(spark, [("A", 0.1, 0.1)]).count() == 0
    got = generate(spark, [("A", 0.8, 0.9)] * 10).collect()
    assert len(got) == 1 and got[0]["transaction_count"] == 10 and len(got[0]["transactions"]) == 10 and got[0]["context"]["n_counterparties"] == 10
    assert (got[0]["sla_deadline"] - got[0]["created_at"]).total_seconds() == 72 * 3600


def test_graph_layer_reaches_high(spark):
    df = scored(spark, [("A", 0.9, 0.95)])
    g = spark.createDataFrame([(0, 1.0, 0.8)], "transaction_id long, graph_sender_in_cycle double, graph_receiver_pagerank double")
    got = alerts.generate(df.drop("ml_score"), df.select("transaction_id", "ml_score"), g).first()
    assert got["graph_score"] == pytest.approx(0.9) and got["severity"] == "HIGH"


def test_queue_find_and_status(spark):
    df = generate(spark, [(s, 0.9, m) for s, m in (("A", 0.99), ("B", 0.7), ("C", 0.8))]).cache()
    order = [r["entity_id"] for r in alerts.queue(df).collect()]
    assert order == ["A", "C", "B"] and alerts.queue(df, severity="HIGH").count() == 0 and alerts.queue(df, limit=1).count() == 1
    one = df.first()["alert_id"]
    assert alerts.find(df, one).count() == 1 and alerts.find(df, "none").count() == 0
    events = spark.createDataFrame([(one, "CLOSED", "SAR_FILED", datetime(2024, 1, 2)), (one, "BAD", None, datetime(2024, 1, 3)), ("none", "CLOSED", None, datetime(2024, 1, 3))], "alert_id string, status string, disposition string, at timestamp")
    after = alerts.update_status(df, events)
    assert after.count() == 3 and alerts.find(after, one).first()["status"] == "CLOSED" and alerts.statistics(after).first()["status_open"] == 2


def test_deduplicate(spark):
    df = generate(spark, [("A", 0.9, 0.95)])
    twice = df.unionByName(df.withColumns({"ensemble_score": F.lit(0.5), "alert_id": F.lit("Z"), "triggered_rules": F.array(F.lit("velocity"))}))
    assert alerts.deduplicate(twice).first()["ensemble_score"] == pytest.approx(0.6975)
    merged = alerts.deduplicate(twice, "sum_score").first()
    assert merged["ensemble_score"] == pytest.approx(0.6975 + 0.15) and merged["triggered_rules"] == ["structuring", "velocity"] and merged["transaction_count"] == 2
    with pytest.raises(ValueError):
        alerts.deduplicate(twice, "other")


def test_triage(spark):
    df = generate(spark, [("BANK_001_1", 0.9, 0.95)]).cache()
    got = triage.triage(df).first()
    assert got["recommended_disposition"] == "CONTINUE_MONITORING" and got["verified"] and got["error"] is None

    def lies(system, text):
        return 'Sure: {"narrative_summary": "BANK_001_1 sent $100.00 and $77,777.00", "recommended_disposition": "close", "confidence_level": "high", "disposition_rationale": "why"} bye'

    got = triage.triage(df, lies).first()
    assert (got["total_facts"], got["verified_facts"]) == (3, 2) and not got["verified"] and got["confidence_level"] == "LOW" and got["recommended_disposition"] == "CLOSE"
    assert got["disposition_rationale"].startswith("[CHECK] why")

    def fails(system, text):
        raise RuntimeError("offline")

    from dataclasses import replace

    got = triage.triage(df, fails, replace(triage.DEFAULT, wait_seconds=0)).first()
    assert "offline" in got["narrative_summary"] and got["confidence_level"] == "LOW" and got["risk_indicators"][0]["indicator"] == "structuring"
    table = triage.prompt(df).first()["prompt"]
    assert "$100.00" in table and "-|-" in table and "2024-01-01 10:00:00" in table


def test_reports(spark):
    df = generate(spark, [("A", 0.9, 0.95), ("B", 0.9, 0.9)]).cache()
    text = report.sar_narrative(df, generated=F.lit("2024-02-01").cast("timestamp")).orderBy("alert_id").first()["narrative"]
    assert "several transactions just below" in text and "DRAFT of 2024-02-01 00:00:00" in text
    s = report.sla(df, F.lit("2024-03-01").cast("timestamp")).first()
    assert s["medium_breached"] == 2 and s["closed_rate_pct"] == 0
    a = report.ageing(df, F.lit("2024-01-02 10:00:00").cast("timestamp")).first()
    assert a["open_alerts"] == 2 and a["max_hours"] == pytest.approx(24) and a["over_24h"] == 0
    assert "<table>" in report.page("t", report.package(df, as_of=F.lit("2024-03-01").cast("timestamp")))


def test_ranking_metrics(spark):
    data = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (0, 0.1)]
    df = spark.createDataFrame(data, "label int, score double")
    r = evaluation.ranking_metrics(df).first()
    assert r["roc_auc"] == pytest.approx((3 + 1 + 0.5 + 0) / 6 + 0, abs=0.01) or r["roc_auc"] == pytest.approx(0.75)
    assert r["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 4)
    c = evaluation.confusion(df, 0.7).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (2, 2, 0, 1) and c["precision"] == 0.5 and c["specificity"] == pytest.approx(1 / 3)
    t = {round(x["threshold"], 6): x for x in evaluation.threshold_table(df).collect()}
    for k, x in t.items():
        assert x["tp"] == sum(1 for y, s in data if y and s >= k - 1e-9) and x["fp"] == sum(1 for y, s in data if not y and s >= k - 1e-9)
    assert evaluation.best_threshold(df, 0.8).first()["recall"] == 1


def test_folds_are_even(spark):
    df = spark.range(1003).select(F.col("id").alias("transaction_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    sizes = {}
    for r in ml.folds(df).groupBy("label", "fold").count().collect():
        sizes.setdefault(r["label"], []).append(r["count"])
    assert all(max(x) - min(x) <= 1 and len(x) == 5 for x in sizes.values())
