"""Alerts: fusing the layers' scores, grouping by entity, enriching, deduplicating, ranking and following them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import RULES, AlertConfig
from ..functions.columns import clip, num
from .rules import score_name

DEFAULT = AlertConfig()
STATUSES = ("OPEN", "IN_REVIEW", "ESCALATED", "CLOSED")


def severity_rank(column: str = "severity") -> Column:
    return F.when(F.col(column) == "HIGH", 0).when(F.col(column) == "MEDIUM", 1).when(F.col(column) == "LOW", 2).otherwise(3)


def ensemble(scored: DataFrame, ml: DataFrame | None = None, graph: DataFrame | None = None, cfg: AlertConfig = DEFAULT) -> DataFrame:
    """Adds ml_score, graph_score and ensemble_score. A layer that is not given counts as 0; the weights stay as they are."""
    df = scored
    if ml is not None:
        df = df.join(ml.select("transaction_id", "ml_score"), "transaction_id", "left")
    if graph is not None:
        used = [c for c in graph.columns if any(x in c for x in ("betweenness", "pagerank", "in_cycle"))]
        mean = clip(sum((F.coalesce(F.col(c).cast("double"), num(0)) for c in used), num(0)) / max(1, len(used)))
        df = df.join(graph.select("transaction_id", mean.alias("graph_score")), "transaction_id", "left")
    have = lambda c: F.coalesce(c, num(0)) if c in df.columns else num(0)
    df = df.withColumns({"ml_score": have("ml_score"), "graph_score": have("graph_score")})
    score = num(cfg.weight_rule) * have("rule_composite_score") + num(cfg.weight_ml) * F.col("ml_score") + num(cfg.weight_graph) * F.col("graph_score")
    return df.withColumn("ensemble_score", clip(score))


def candidates(df: DataFrame, cfg: AlertConfig = DEFAULT) -> DataFrame:
    return df.where(F.col("ensemble_score") >= num(cfg.threshold))


def by_entity(flagged: DataFrame) -> DataFrame:
    """One row for each sender of the flagged transactions, with the rules that fired on any."""
    fired = F.array_compact(F.array(*(F.when(F.max(score_name(r)) > 0, F.lit(r)) for r in RULES if score_name(r) in flagged.columns)))
    a = "amount"
    return flagged.groupBy(F.col("from_id").alias("entity_id")).agg(
        F.max("ensemble_score").alias("ensemble_score"), F.avg("ensemble_score").alias("mean_score"), F.max("ml_score").alias("ml_score"), F.max("graph_score").alias("graph_score"),
        F.count("*").alias("transaction_count"), F.sum(a).alias("total_amount"), F.avg(a).alias("mean_amount"), F.max(a).alias("max_amount"), F.min(a).alias("min_amount"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), fired.alias("triggered_rules"),
    )


def sides(df: DataFrame) -> DataFrame:
    """Each transaction once for its sender and once for its receiver (once if they are the same): entity_id, counterparty and all columns."""
    ends = F.array_distinct(F.array(F.struct(F.col("from_id").alias("e"), F.col("to_id").alias("c")), F.struct(F.col("to_id").alias("e"), F.col("from_id").alias("c"))))
    return df.withColumn("x", F.explode(ends)).select(F.col("x.e").alias("entity_id"), F.col("x.c").alias("counterparty"), *df.columns)


def last_transactions(df: DataFrame, entities: DataFrame, n: int = 50) -> DataFrame:
    """entity_id and transactions: the last n of either side, in order of time."""
    rows = sides(df).join(entities.select("entity_id"), "entity_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("timestamp"), F.desc("transaction_id")))
    kept = ["timestamp", "transaction_id", "from_id", "to_id", "amount", *[c for c in ("payment_format", "payment_currency", "is_laundering") if c in df.columns]]
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= n)
    return rows.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("transactions"))


def counterparties(df: DataFrame, entities: DataFrame, suspicious: DataFrame | None = None, above: float = 0.3, most: int = 10) -> DataFrame:
    """entity_id, n_counterparties and the suspicious ones among them (by name, ``most`` of them)."""
    pairs = sides(df.select("from_id", "to_id")).join(entities.select("entity_id"), "entity_id", "left_semi").where("counterparty <> entity_id").select("entity_id", "counterparty").distinct()
    if suspicious is None:
        return pairs.groupBy("entity_id").agg(F.count("*").alias("n_counterparties"), F.array().cast("array<string>").alias("suspicious_counterparties"))
    count = pairs.groupBy("entity_id").agg(F.count("*").alias("n_counterparties"))
    bad = pairs.join(suspicious.where(F.col("suspicion_score") > num(above)).select(F.col("account_id").alias("counterparty")), "counterparty")
    # no more than the suspicious accounts for an entity, of which there are top_k
    named = bad.groupBy("entity_id").agg(F.slice(F.sort_array(F.collect_set("counterparty")), 1, most).alias("suspicious_counterparties"))
    empty = F.array().cast("array<string>")
    return count.join(named, "entity_id", "left").withColumn("suspicious_counterparties", F.coalesce("suspicious_counterparties", empty))


def deduplicate(alerts: DataFrame, strategy: str = "max_score") -> DataFrame:
    """One alert for each entity: the highest (``max_score``), or in order of score with 0.3 of each further one added (``sum_score``)."""
    if strategy == "max_score":
        rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("ensemble_score"), "alert_id"))
        return alerts.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    if strategy != "sum_score":
        raise ValueError(f"strategy {strategy!r} is neither max_score nor sum_score")
    first = F.max_by(F.struct(*[c for c in alerts.columns if c not in ("entity_id", "ensemble_score", "transaction_count", "total_amount", "triggered_rules")]), F.struct("ensemble_score", "alert_id"))
    top = F.max("ensemble_score")
    out = alerts.groupBy("entity_id").agg(
        first.alias("_x"), F.least(num(1), top + num(0.3) * (F.sum("ensemble_score") - top)).alias("ensemble_score"), F.sum("transaction_count").alias("transaction_count"), F.sum("total_amount").alias("total_amount"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("triggered_rules")))).alias("triggered_rules"),
    )
    return out.select("*", "_x.*").drop("_x").select(*alerts.columns)


def classify(alerts: DataFrame, cfg: AlertConfig = DEFAULT, created_at: Column | None = None) -> DataFrame:
    """Adds alert_id, severity, created_at, sla_deadline and status. The id is made of the entity and its period, so a rerun gives it again."""
    s = F.col("ensemble_score")
    severity = F.when(s >= num(cfg.high), "HIGH").when(s >= num(cfg.medium), "MEDIUM").otherwise("LOW")
    hours = F.element_at(F.create_map(*(F.lit(x) for pair in cfg.sla_hours for x in pair)), F.col("severity"))
    made = created_at if created_at is not None else F.col("last_seen")
    key = F.concat_ws("|", "entity_id", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))
    df = alerts.withColumns({"alert_id": F.upper(F.substring(F.sha2(key, 256), 1, 12)), "severity": severity, "created_at": made})
    return df.withColumns({"sla_deadline": F.col("created_at") + F.make_dt_interval(hours=hours), "status": F.lit("OPEN"), "disposition": F.lit(None).cast("string")})


def generate(scored: DataFrame, ml: DataFrame | None = None, graph: DataFrame | None = None, suspicious: DataFrame | None = None, communities: DataFrame | None = None, cycle_members: DataFrame | None = None, history: DataFrame | None = None, cfg: AlertConfig = DEFAULT, created_at: Column | None = None) -> DataFrame:
    """Alerts of a scored ledger, the highest first."""
    df = ensemble(scored, ml, graph, cfg)
    found = deduplicate(classify(by_entity(candidates(df, cfg)), cfg, created_at))
    out = found.join(last_transactions(df, found), "entity_id", "left").join(counterparties(df, found, suspicious), "entity_id", "left")
    extra = {"graph_suspicion_score": num(0), "in_cycle": F.lit(False), "community_id": F.lit(None).cast("long"), "prior_alert_count": F.lit(0).cast("long")}
    if suspicious is not None:
        out = out.join(suspicious.select(F.col("account_id").alias("entity_id"), F.col("suspicion_score").alias("_s")), "entity_id", "left")
        extra["graph_suspicion_score"] = F.coalesce("_s", num(0))
    if cycle_members is not None:
        out = out.join(cycle_members.select(F.col("id").alias("entity_id"), F.lit(True).alias("_c")), "entity_id", "left")
        extra["in_cycle"] = F.coalesce("_c", F.lit(False))
    if communities is not None:
        out = out.join(communities.select(F.col("id").alias("entity_id"), F.col("community").alias("_m")), "entity_id", "left")
        extra["community_id"] = F.col("_m")
    if history is not None:
        out = out.join(history.groupBy("entity_id").agg(F.count("*").alias("_p")), "entity_id", "left")
        extra["prior_alert_count"] = F.coalesce("_p", F.lit(0))
    pattern = F.struct("total_amount", "mean_amount", "max_amount", "min_amount", F.col("transaction_count").alias("n_transactions"))
    context = F.struct(F.coalesce("n_counterparties", F.lit(0)).alias("n_counterparties"), F.coalesce("suspicious_counterparties", F.array().cast("array<string>")).alias("suspicious_counterparties"), *[c.alias(n) for n, c in extra.items()], pattern.alias("transaction_pattern"))
    return out.withColumn("context", context).select(
        "alert_id", "entity_id", "severity", "ensemble_score", "triggered_rules", "ml_score", "graph_score", "transactions", "transaction_count", "total_amount", "first_seen", "last_seen", "created_at", "sla_deadline", "status", "disposition", "context",
        F.lit("").alias("llm_summary"), F.lit("").alias("llm_recommendation"),
    ).orderBy(F.desc("ensemble_score"), "entity_id")


def queue(alerts: DataFrame, severity: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    if severity:
        alerts = alerts.where(F.col("severity") == severity)
    if status:
        alerts = alerts.where(F.col("status") == status)
    return alerts.orderBy(severity_rank(), F.desc("ensemble_score"), "entity_id").limit(limit)


def dashboard_queue(alerts: DataFrame, severities: list[str], statuses: list[str], min_score: float = 0.0) -> DataFrame:
    return alerts.where(F.col("severity").isin(*severities) & F.col("status").isin(*statuses) & (F.col("ensemble_score") >= min_score)).orderBy(F.desc("ensemble_score"), "entity_id")


def find(alerts: DataFrame, alert_id: str) -> DataFrame:
    """The alert of that id; rules given as JSON text are read as an array."""
    found = alerts.where(F.col("alert_id") == alert_id)
    if dict(found.dtypes)["triggered_rules"] == "string":
        found = found.withColumn("triggered_rules", F.from_json("triggered_rules", "array<string>"))
    return found


def update_status(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts as the latest event (alert_id, status, disposition, at) of each leaves them. Events with an unknown status or id change nothing."""
    valid = events.where(F.col("status").isin(*STATUSES))
    last = valid.groupBy("alert_id").agg(F.max_by(F.struct("status", "disposition"), "at").alias("_e"))
    out = alerts.join(last, "alert_id", "left")
    return out.withColumns({"status": F.coalesce("_e.status", "status"), "disposition": F.coalesce("_e.disposition", "disposition")}).select(*alerts.columns)


def statistics(alerts: DataFrame) -> DataFrame:
    count = lambda c, v: F.count_if(F.col(c) == v).alias(f"{c}_{v.lower()}")
    s = "ensemble_score"
    return alerts.agg(F.count("*").alias("total"), *[count("severity", v) for v in ("HIGH", "MEDIUM", "LOW")], *[count("status", v) for v in STATUSES], F.avg(s).alias("mean_score"), F.stddev_pop(s).alias("std_score"), F.max(s).alias("max_score"), F.sum("total_amount").alias("total_amount"))


def rule_counts(alerts: DataFrame) -> DataFrame:
    return alerts.select(F.explode("triggered_rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def daily_volume(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.to_date("created_at").alias("date")).agg(F.count("*").alias("n"))


def score_histogram(alerts: DataFrame, bins: int = 30) -> DataFrame:
    place = F.least(F.width_bucket("ensemble_score", num(0), num(1), F.lit(bins)), F.lit(bins))
    return alerts.groupBy("severity", place.alias("bin")).agg(F.count("*").alias("n"))
