"""Compliance reports: SAR narratives, alert statistics, ageing and SLA, and a page of HTML over small results."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, functions as F

from .quantiles import quantiles
from .triage import money

REASONS = {
    "structuring": "several transactions just below the reporting threshold of $10,000",
    "rapid_movement": "received funds that left again within hours",
    "round_tripping": "money that came back to its origin through other accounts",
    "dormant_reactivation": "a dormant account that became active with large amounts",
    "velocity": "far more transactions than usual in a short time",
    "geographic_risk": "transactions with high-risk jurisdictions",
}
GENERAL = "model, network and behaviour scores that ordinary activity does not explain"


def sar_fields(alerts: DataFrame, most: int = 10) -> DataFrame:
    """What a narrative states: number and sum of transactions, period, formats and counterparties, each in order."""
    t = F.col("transactions")
    others = F.array_remove(F.array_distinct(F.flatten(F.transform(t, lambda x: F.array(x["from_id"], x["to_id"])))), F.col("entity_id"))
    return alerts.withColumns(
        {
            "n_transactions": F.size(t), "sum_amount": F.aggregate(t, F.lit(0.0), lambda a, x: a + x["amount"]), "period_start": F.array_min(F.transform(t, lambda x: x["timestamp"])),
            "period_end": F.array_max(F.transform(t, lambda x: x["timestamp"])), "formats": F.array_sort(F.array_distinct(F.transform(t, lambda x: x["payment_format"]))),
            "n_others": F.size(others), "others": F.slice(F.array_sort(others), 1, most),
        }
    )


def sar_narrative(alerts: DataFrame, triage: DataFrame | None = None, generated: Column | None = None, most: int = 20) -> DataFrame:
    """alert_id and narrative: who, what, when, with whom, why, and the first transactions."""
    df = sar_fields(alerts)
    if triage is not None:
        df = df.join(triage.select("alert_id", F.col("narrative_summary").alias("_n"), F.col("disposition_rationale").alias("_r")), "alert_id", "left")
    else:
        df = df.withColumns({"_n": F.lit(None).cast("string"), "_r": F.lit(None).cast("string")})
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    why = F.filter(F.array(*(F.when(F.array_contains("triggered_rules", r), F.lit(text)) for r, text in REASONS.items())), lambda x: x.isNotNull())
    lines = F.transform(
        F.slice("transactions", 1, most),
        lambda t, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), time(t["timestamp"]), F.lit(" | "), t["from_id"], F.lit(" -> "), t["to_id"], F.lit(" | "), money(t["amount"]), F.lit(" | "), F.coalesce(t["payment_format"], F.lit("N/A"))),
    )
    rest = F.when(F.col("n_transactions") > most, F.concat(F.lit("  ... and "), (F.col("n_transactions") - most).cast("string"), F.lit(" more")))
    parts = [
        F.concat(F.lit("Subject: account "), F.col("entity_id"), F.format_string(", risk score %.3f", "ensemble_score"), F.lit(" (severity "), F.col("severity"), F.lit(").")),
        F.concat(F.lit("Activity: "), F.when(F.size("triggered_rules") > 0, F.array_join("triggered_rules", ", ")).otherwise("general pattern analysis"), F.lit("; payment formats: "), F.array_join("formats", ", "), F.lit(".")),
        F.concat(F.lit("Period: "), time("period_start"), F.lit(" to "), time("period_end"), F.lit("; "), F.col("n_transactions").cast("string"), F.lit(" transactions of "), money(F.col("sum_amount")), F.lit(" in all.")),
        F.when(F.col("n_others") > 0, F.concat(F.lit("Counterparties: "), F.col("n_others").cast("string"), F.lit(", among them "), F.array_join("others", ", "), F.lit("."))),
        F.concat(F.lit("Suspicious because of "), F.when(F.size(why) > 0, F.array_join(why, "; ")).otherwise(GENERAL), F.lit(".")),
        F.concat(F.lit("Analysis: "), F.col("_n")), F.concat(F.lit("Assessment: "), F.col("_r")), F.lit("Transactions:"), F.array_join(lines, "\n"), rest,
        F.concat(F.lit("DRAFT of "), time(generated if generated is not None else F.current_timestamp()), F.lit(" UTC for review before filing. Alert "), F.col("alert_id")),
    ]
    return df.select("alert_id", F.concat_ws("\n", *parts).alias("narrative"))


def alert_statistics(alerts: DataFrame, as_of: Column | None = None) -> DataFrame:
    now = as_of if as_of is not None else F.current_timestamp()
    s, late = "ensemble_score", (F.col("status") == "OPEN") & (F.col("sla_deadline") < now)
    marks = quantiles(alerts, s, {"median": 0.5, "p90": 0.9, "p95": 0.95})  # one row
    return alerts.agg(
        F.count("*").alias("total"), F.min("created_at").alias("period_start"), F.max("created_at").alias("period_end"), *[F.count_if(F.col("severity") == v).alias(v.lower()) for v in ("HIGH", "MEDIUM", "LOW")],
        *[F.count_if(F.col("status") == v).alias(v.lower()) for v in ("OPEN", "IN_REVIEW", "ESCALATED", "CLOSED")], F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"),
        F.count_if(late).alias("sla_breached"), (F.try_divide(F.count_if(late), F.count("*")) * 100).alias("breach_rate_pct"),
    ).crossJoin(F.broadcast(marks))


def top_entities(alerts: DataFrame, n: int = 20) -> DataFrame:
    return alerts.groupBy("entity_id").agg(F.count("*").alias("alert_count")).orderBy(F.desc("alert_count"), "entity_id").limit(n)


def ageing(alerts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Age of open alerts in hours, with counts beyond 24, 72 and 168."""
    now = as_of if as_of is not None else F.current_timestamp()
    age = F.when(F.col("status") == "OPEN", (F.unix_micros(now) - F.unix_micros("created_at")) / 3.6e9)
    df = alerts.select(age.alias("age"))
    marks = quantiles(df, "age", {"median_hours": 0.5})  # one row
    out = df.agg(F.count("age").alias("open_alerts"), F.avg("age").alias("mean_hours"), F.max("age").alias("max_hours"), *[F.count_if(F.col("age") > h).alias(f"over_{h}h") for h in (24, 72, 168)])
    return out.crossJoin(F.broadcast(marks))


def sla(alerts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Breaches by severity, and closure and escalation rates."""
    now = as_of if as_of is not None else F.current_timestamp()
    late = (F.col("status") == "OPEN") & (F.col("sla_deadline") < now)
    rate = lambda v: (F.try_divide(F.count_if(F.col("status") == v), F.count("*")) * 100).alias(f"{v.lower()}_rate_pct")
    return alerts.agg(*[F.count_if(late & (F.col("severity") == v)).alias(f"{v.lower()}_breached") for v in ("HIGH", "MEDIUM", "LOW")], F.count("*").alias("total"), rate("CLOSED"), rate("ESCALATED"))


def performance(metrics: dict[str, float]) -> dict[str, float]:
    """The figures of a model report, as evaluated."""
    return {k: round(float(metrics.get(k, 0.0)), 6) for k in ("roc_auc", "average_precision", "recall_at_1_fpr", "recall_at_5_fpr", "precision", "recall", "f1", "threshold")}


def page(title: str, sections: dict[str, DataFrame], most: int = 100) -> str:
    """HTML of small results; of each at most ``most`` rows are shown."""
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        rows = df.limit(most).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(x))}</td>" for x in r) + "</tr>" for r in rows)
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join(out)


def package(alerts: DataFrame, triage: DataFrame | None = None, as_of: Column | None = None, most: int = 50) -> dict[str, DataFrame]:
    """All sections; narratives are drafted for the first HIGH alerts (``most``)."""
    grave = alerts.where("severity = 'HIGH'").orderBy(F.desc("ensemble_score"), "entity_id").limit(most)
    out = {"statistics": alert_statistics(alerts, as_of), "ageing": ageing(alerts, as_of), "sla": sla(alerts, as_of), "top_entities": top_entities(alerts), "narratives": sar_narrative(grave, triage, as_of)}
    return out
