"""Evaluation: ranking metrics from score groups, thresholds, rules, systems, alerts and triage. All of it is aggregates and windows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import RULES
from ..functions.columns import num
from .rules import score_name


def curve(scores: DataFrame, by: str | None = None) -> DataFrame:
    """Of scores (label, score): one row for each distinct score, the highest first, with cumulative tp and fp, and totals p and n.

    Counts by score and by range of scores come first, so that the cumulative sum sees a row a range, then a row a score of its range.
    """
    key = [by] if by else []
    groups = scores.groupBy(*key, "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    groups = groups.withColumn("range", F.floor(F.col("score") * 1024))
    ranges = groups.groupBy(*key, "range").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    above = Window.partitionBy(*key).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    zero = lambda c: F.coalesce(c, F.lit(0))
    ranges = ranges.select(*key, "range", zero(F.sum("rp").over(above)).alias("bp"), zero(F.sum("rn").over(above)).alias("bn"), F.sum("rp").over(whole).alias("p"), F.sum("rn").over(whole).alias("n"))
    inside = Window.partitionBy(*key, "range").orderBy(F.desc("score"))
    out = groups.join(ranges, [*key, "range"])
    return out.select(*key, "score", "range", "pos", "neg", (F.sum("pos").over(inside) + F.col("bp")).alias("tp"), (F.sum("neg").over(inside) + F.col("bn")).alias("fp"), "p", "n")


def ranking_metrics(scores: DataFrame, by: str | None = None) -> DataFrame:
    """roc_auc (trapezoids), average_precision (steps), recall at 1, 5 and 10 % false positives (interpolated)."""
    key = [by] if by else []
    c = curve(scores, by)
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    area = F.sum(F.col("neg") * (F.col("tp") + tp0) / 2)
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    out = [F.try_divide(area, F.max("p") * F.max("n")).alias("roc_auc"), F.try_divide(steps, F.max("p")).alias("average_precision")]  # null without both labels
    for share in (0.01, 0.05, 0.10):
        want = num(share) * F.col("n")
        # on the curve's last step that begins at or before the wanted rate
        at = F.when((F.col("neg") > 0) & (F.col("p") > 0), (tp0 + F.col("pos") * (want - fp0) / F.col("neg")) / F.col("p"))
        out.append(F.coalesce(F.max(F.when((fp0 <= want) & (F.col("fp") > want), at)), num(1)).alias(f"recall_at_{int(share * 100)}_fpr"))
    return c.groupBy(*key).agg(*out)


def precision_at_recall(scores: DataFrame, wanted: tuple[float, ...] = (0.80, 0.90), by: str | None = None) -> DataFrame:
    """Precision at the highest score at which the recall is reached; null without a label of 1."""
    key = [by] if by else []
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    at = [F.max_by(precision, F.when(F.col("tp") >= num(w) * F.col("p"), F.col("score"))).alias(f"precision_at_{round(w * 100)}_recall") for w in wanted]
    return curve(scores, by).where("p > 0").groupBy(*key).agg(*at)


def class_report(scores: DataFrame, threshold: float) -> DataFrame:
    """precision, recall, f1 and support of each class, their plain mean (macro) and their mean by support (weighted)."""
    k = confusion(scores, threshold)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(num(0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one = lambda name, hit, wrong, missed: F.struct(F.lit(name).alias("class"), share(hit, hit + wrong).alias("precision"), share(hit, hit + missed).alias("recall"), share(2 * hit, 2 * hit + wrong + missed).alias("f1"), (hit + missed).alias("support"))
    rows = k.select(F.explode(F.array(one("legitimate", tn, fn, fp), one("laundering", tp, fp, fn))).alias("x")).select("x.*")
    n = F.sum("support")
    figures = ("precision", "recall", "f1")
    macro = rows.agg(F.lit("macro").alias("class"), *(F.avg(c).alias(c) for c in figures), n.alias("support"))
    weighted = rows.agg(F.lit("weighted").alias("class"), *(F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), n), num(0)).alias(c) for c in figures), n.alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def confusion(scores: DataFrame, threshold: float | None = None, by: str | None = None) -> DataFrame:
    """Counts and rates at a threshold (a column ``threshold`` if none is given)."""
    hit = (F.col("score") >= (F.col("threshold") if threshold is None else num(threshold))).cast("int")
    n = lambda x: F.sum(x).cast("long")
    y = F.col("label")
    out = scores.groupBy(*([by] if by else [])).agg(n(hit * y).alias("tp"), n(hit * (1 - y)).alias("fp"), n((1 - hit) * y).alias("fn"), n((1 - hit) * (1 - y)).alias("tn"))
    return rates(out)


def rates(out: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(num(0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns(
        {
            "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "accuracy": share(tp + tn, tp + fp + fn + tn),
            "specificity": share(tn, tn + fp), "fpr": share(fp, tn + fp),
        }
    )


def threshold_table(scores: DataFrame, n: int = 100, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rates at n evenly spaced thresholds. Each score is put between two of them, so the data is aggregated to n + 1 rows at once."""
    step = (high - low) / (n - 1)
    spark = scores.sparkSession
    grid = spark.range(n).select(F.col("id").alias("i"), (num(low) + F.col("id") * num(step)).alias("threshold"))
    place = F.floor((F.col("score") - num(low)) / num(step))
    # the division may be off by one step at a threshold itself
    fixed = F.when(F.col("score") >= num(low) + (place + 1) * num(step), place + 1).when(F.col("score") < num(low) + place * num(step), place - 1).otherwise(place)
    bins = scores.groupBy(F.greatest(F.lit(-1), F.least(F.lit(n - 1), fixed)).alias("bin")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    joined = grid.join(F.broadcast(bins))  # n by n + 1 rows
    out = joined.groupBy("i", "threshold").agg(
        F.sum(F.when(F.col("bin") >= F.col("i"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("bin") >= F.col("i"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("bin") < F.col("i"), F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(F.col("bin") < F.col("i"), F.col("neg")).otherwise(0)).alias("tn"),
    )
    return rates(out)


def best_threshold(scores: DataFrame, target_recall: float = 0.8, n: int = 100) -> DataFrame:
    """The first threshold of greatest F1 among those that reach the recall; if none does, the first of greatest recall."""
    t = threshold_table(scores, n).withColumn("reaches", F.col("recall") >= num(target_recall))
    rank = [F.desc("reaches"), F.desc(F.when(F.col("reaches"), F.col("f1")).otherwise(F.col("recall"))), "i"]
    return t.orderBy(*rank).limit(1).drop("reaches", "i")


def rule_report(scored: DataFrame) -> DataFrame:
    """For each rule: hits, hit rate, mean score where it hit, precision, recall and F1."""
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(score_name(r)).alias("score")) for r in RULES)))
    long = scored.select(F.col("is_laundering").alias("label"), rows.alias("x")).select("label", "x.*")
    hit = (F.col("score") > 0).cast("int")
    out = long.groupBy("rule").agg(
        F.sum(hit).alias("n_hits"), F.avg(hit).alias("hit_rate"), F.coalesce(F.avg(F.when(F.col("score") > 0, F.col("score"))), num(0)).alias("mean_when_hit"),
        F.sum(hit * F.col("label")).alias("tp"), F.sum("label").alias("p"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(num(0))
    return out.select(
        "rule", "n_hits", "hit_rate", "mean_when_hit", share(F.col("tp"), F.col("n_hits")).alias("precision"), share(F.col("tp"), F.col("p")).alias("recall"),
        share(2 * F.col("tp"), F.col("n_hits") + F.col("p")).alias("f1"),
    )


def rule_overlap(scored: DataFrame) -> DataFrame:
    """For each pair of rules: transactions that both hit, and the Jaccard similarity of their hits."""
    hit = {r: (F.col(score_name(r)) > 0) for r in RULES}
    pairs = [(a, b) for i, a in enumerate(RULES) for b in RULES[i + 1 :]]
    one = scored.agg(*(F.struct(F.lit(a).alias("rule_a"), F.lit(b).alias("rule_b"), F.count_if(hit[a] & hit[b]).alias("both"), F.count_if(hit[a] | hit[b]).alias("either")).alias(f"{a}|{b}") for a, b in pairs))
    rows = one.select(F.explode(F.array(*[f"`{a}|{b}`" for a, b in pairs])).alias("x")).select("x.*")
    return rows.select("rule_a", "rule_b", "both", F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(num(0)).alias("jaccard"))


def trigger_histogram(scored: DataFrame) -> DataFrame:
    return scored.groupBy("rule_trigger_count").agg(F.count("*").alias("n"))


def compare_systems(scored: DataFrame) -> DataFrame:
    """rules, ml and hybrid (no graph term) at 0.3, 0.5 and 0.5, with ranking metrics, lifts over rules and which is best."""
    rule, ml = F.col("rule_composite_score"), F.col("ml_score")
    raw = (num(0.30) * rule + num(0.45) * ml).alias("raw")
    df = scored.select(F.col("is_laundering").alias("label"), rule.alias("rules"), ml.alias("ml"), raw)
    df = df.crossJoin(F.broadcast(df.agg(F.max("raw").alias("top"))))
    hybrid = F.when(F.col("top") > 0, F.round(F.col("raw") / F.col("top"), 9)).otherwise(num(0))  # ties do not hang on the last bits
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("system"), s.alias("score"), num(t).alias("threshold")) for n, s, t in (("rules", F.col("rules"), 0.3), ("ml", F.col("ml"), 0.5), ("hybrid", hybrid, 0.5)))))
    long = df.select("label", rows.alias("x")).select("label", "x.*")
    out = ranking_metrics(long, "system").join(confusion(long, None, "system").select("system", "precision", "recall", "f1"), "system")
    base = out.where("system = 'rules'").select(F.col("average_precision").alias("base"))
    out = out.crossJoin(F.broadcast(base)).withColumn("lift", F.col("average_precision") - F.col("base")).drop("base")
    best = F.first("system").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("average_precision"), "system"))  # three rows
    return out.withColumn("is_best", F.col("system") == best)


def alert_report(alerts: DataFrame, truth: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """Conversion, false alerts and SLA of alerts; against true entities (entity_id) precision, recall and F1."""
    late = (F.col("status") == "OPEN") & (F.col("sla_deadline") < (as_of if as_of is not None else F.current_timestamp()))
    out = alerts.agg(
        F.count("*").alias("total"), F.avg((F.col("disposition") == "SAR_FILED").cast("int")).alias("conversion_rate"), F.avg((F.col("disposition") == "CLOSED_NO_ACTION").cast("int")).alias("false_alert_rate"),
        F.count_if(late).alias("sla_breached"), *[F.avg(F.when(F.col("severity") == s, F.col("ensemble_score"))).alias(f"mean_score_{s.lower()}") for s in ("HIGH", "MEDIUM", "LOW")],
    )
    if truth is None:
        return out
    ours, real = alerts.select("entity_id").distinct(), truth.select("entity_id").distinct()
    hit = ours.join(real, "entity_id", "left_semi").agg(F.count("*").alias("tp"))
    extra, missed = ours.join(real, "entity_id", "left_anti").agg(F.count("*").alias("fp")), real.join(ours, "entity_id", "left_anti").agg(F.count("*").alias("fn"))
    both = rates(hit.crossJoin(extra).crossJoin(missed).withColumn("tn", F.lit(0).cast("long")))
    return out.crossJoin(both.select("tp", "fp", "fn", "precision", "recall", "f1"))


def triage_report(triage: DataFrame, expert: DataFrame | None = None) -> DataFrame:
    """Distributions and quality of triage results; with an expert's dispositions (alert_id, disposition) the agreement."""
    df = triage
    if expert is not None:
        df = df.join(expert.select("alert_id", F.col("disposition").alias("expert")), "alert_id", "left")
    else:
        df = df.withColumn("expert", F.lit(None).cast("string"))
    d, c = "recommended_disposition", "confidence_level"
    many = df.groupBy("entity_id").agg(F.count("*").alias("n"), F.count_distinct(d).alias("kinds")).where("n > 1").agg(F.avg((F.col("kinds") == 1).cast("int")).alias("consistency"))
    out = df.agg(
        F.count("*").alias("total"), *[F.count_if(F.col(d) == v).alias(v.lower()) for v in ("ESCALATE_TO_SAR", "CONTINUE_MONITORING", "CLOSE")], *[F.count_if(F.col(c) == v).alias(f"confidence_{v.lower()}") for v in ("HIGH", "MEDIUM", "LOW")],
        F.avg("verification_score").alias("mean_verification"), F.avg(F.length("narrative_summary")).alias("mean_length"), F.avg((F.length("disposition_rationale") > 20).cast("int")).alias("rationale_rate"),
        F.avg(F.when(F.col("expert").isNotNull(), (F.col("expert") == F.col(d)).cast("int"))).alias("expert_agreement"),
    )
    return out.crossJoin(many)


def agreement_matrix(triage: DataFrame, expert: DataFrame) -> DataFrame:
    values = ["ESCALATE_TO_SAR", "CONTINUE_MONITORING", "CLOSE"]
    return triage.join(expert.select("alert_id", F.col("disposition").alias("expert")), "alert_id").groupBy("expert").pivot("recommended_disposition", values).count().na.fill(0)


def long_metrics(one_row: DataFrame) -> DataFrame:
    """A one-row report as (metric, value)."""
    numbers = [c for c, t in one_row.dtypes if t in ("double", "bigint", "int")]
    return one_row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers))).alias("x")).select("x.*")


def flatten(results: Mapping, prefix: str = "", most: int = 20) -> dict[str, float | str]:
    """Nested results as dotted names: numbers stay, truth values become 0 and 1, lists below ``most`` entries become text, the rest is left out."""
    out: dict[str, float | str] = {}
    for k, v in results.items():
        name = f"{prefix}{k}"
        if isinstance(v, Mapping):
            out |= flatten(v, f"{name}.", most)
        elif isinstance(v, (int, float)):
            out[name] = float(v)
        elif isinstance(v, str) or (isinstance(v, (list, tuple)) and len(v) < most):
            out[name] = str(v)
    return out


def summary_text(results: Mapping) -> str:
    """The flat results, a line each, under the name of their section."""
    lines: list[str] = []
    for section, part in results.items():
        lines.append(str(section))
        flat = flatten(part if isinstance(part, Mapping) else {"value": part})
        lines += [f"  {k}: {v:.6g}" if isinstance(v, float) else f"  {k}: {v}" for k, v in flat.items()]
    return "\n".join(lines)
