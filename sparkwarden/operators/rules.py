"""Behavioural rules. Each adds one score in [0, 1] to every transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import RULES, RuleConfig
from ..functions.columns import DAY_US, HOUR_US, clip, num, us
from .iterate import cut
from .paths import cycle_lengths
from .windows import hot_keys, with_frames

DEFAULT = RuleConfig()


def score_name(rule: str) -> str:
    return f"rule_{rule}_score"


def _structuring(ahead: Column, cfg: RuleConfig) -> Column:
    a = F.col("amount")
    in_range = _in_range(cfg)
    score = F.when(in_range, num(0.4)).otherwise(num(0))
    score = score + F.when((a >= num(cfg.ctr_threshold * 0.90)) & (a < num(cfg.ctr_threshold)), num(0.2)).otherwise(num(0))
    score = score + F.when(in_range & (ahead >= cfg.structuring_min_count), F.least(num(0.4), num(0.1) * ahead)).otherwise(num(0))
    for t in (10_000.0, 5_000.0, 3_000.0):
        score = score + F.when((a >= num(t * 0.95)) & (a < num(t)) & (a % 100 < 10), num(0.1)).otherwise(num(0))
    return clip(score)


def _in_range(cfg: RuleConfig) -> Column:
    return F.col("amount").between(cfg.structuring_low, cfg.structuring_high)


def _dormant(before: Column, cfg: RuleConfig) -> Column:
    gap = (us() - before) / DAY_US
    score = num(0.3) + num(0.4) * F.least(num(1), gap / 365) + num(0.3) * F.least(num(1), F.col("amount") / 50_000)
    hit = (gap >= cfg.dormant_days) & (F.col("amount") >= num(cfg.dormant_min_amount))
    return F.when(hit, clip(score)).otherwise(num(0))


#: The rules that look at a sender's other transactions.
SENDER_RULES = ("structuring", "dormant_reactivation", "velocity")


def sender_rules(df: DataFrame, cfg: RuleConfig = DEFAULT, rules: tuple[str, ...] = SENDER_RULES) -> DataFrame:
    """The scores of these rules, from windows by sender that share one exchange of the ledger.

    structuring: amounts just below the reporting threshold, alone and in numbers within a day. dormant_reactivation: large
    amounts after a long silence. velocity: too many transactions in any of the windows that end with this one.
    """
    width = cfg.structuring_hours * HOUR_US if "structuring" in rules else 0
    widest = max(hours for hours, _ in cfg.velocity) * HOUR_US if "velocity" in rules else 0

    def score(frame, hours: int, threshold: int) -> Column:
        n = F.count("*").over(frame(-hours * HOUR_US, 0))
        return F.when(n >= threshold, F.least(num(1), num(0.3) + num(0.2) * (n / threshold - 1))).otherwise(num(0))

    def make(frame):
        made = {"_ahead": F.count(F.when(_in_range(cfg), 1)).over(frame(0, width))} if "structuring" in rules else {}
        return made | ({score_name("velocity"): F.greatest(num(0), *(score(frame, *w) for w in cfg.velocity))} if "velocity" in rules else {})

    dormant = "dormant_reactivation" in rules
    df = with_frames(df, "from_id", max(widest, 30 * DAY_US * dormant), width, make, previous="_before" if dormant else None)
    if "structuring" in rules:
        df = df.withColumn(score_name("structuring"), _structuring(F.col("_ahead"), cfg))
    if dormant:
        df = df.withColumn(score_name("dormant_reactivation"), _dormant(F.col("_before"), cfg))
    return df.drop("_ahead", "_before")


def structuring(df: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """Amounts just below the reporting threshold, alone and in numbers within a day from one sender."""
    return sender_rules(df, cfg, ("structuring",))


def dormant(df: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """Large amounts from senders that were silent for long."""
    return sender_rules(df, cfg, ("dormant_reactivation",))


def velocity(df: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """Too many transactions of a sender in any of the windows that end with this one."""
    return sender_rules(df, cfg, ("velocity",))


def _rapid_scores(df: DataFrame, cfg: RuleConfig) -> DataFrame:
    """transaction_id and score above 0, some more than once. Each transaction stands once with its sender and once with its receiver, so two windows do without a join."""
    large = df.where(F.col("amount") >= num(cfg.rapid_min_amount))
    side = lambda key, kind: large.select(F.col(key).alias("account"), "timestamp", "amount", "transaction_id", F.lit(kind).alias("out"))
    both = side("from_id", True).unionByName(side("to_id", False))
    width, hot = cfg.rapid_hours * HOUR_US, hot_keys(both, "account")

    def sent(frame):
        ahead = frame(0, width)
        return {"sent": F.sum(F.when(F.col("out"), F.col("amount"))).over(ahead), "n_sent": F.count(F.when(F.col("out"), 1)).over(ahead)}

    both = with_frames(both, "account", 0, width, sent, hot)
    ratio = F.try_divide("sent", "amount")
    score = F.least(num(1), num(0.3) + num(0.3) * ratio + num(0.2) * (F.col("n_sent") > 1).cast("double"))
    both = both.withColumn("score", F.when(~F.col("out") & (ratio >= num(cfg.rapid_ratio)), score))
    both = with_frames(both, "account", width, 0, lambda frame: {"passed_on": F.max(F.col("score") * 0.8).over(frame(-width, 0))}, hot)
    return both.select("transaction_id", F.when(F.col("out"), F.col("passed_on")).otherwise(F.col("score")).alias("score")).where("score > 0")


def _trip_scores(df: DataFrame, cfg: RuleConfig) -> DataFrame:
    """transaction_id and score above 0, by the longest simple cycle that an edge lies on."""
    newest = df.agg(F.max("timestamp").alias("newest"))
    recent = df.where(F.col("amount") >= num(cfg.trip_min_amount)).crossJoin(F.broadcast(newest)).where(us() >= us("newest") - cfg.trip_days * DAY_US).drop("newest")
    recent = recent.select("transaction_id", F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    longest = cycle_lengths(recent.where("src <> dst").select("src", "dst"), cfg.trip_max_hops)
    hits = recent.join(longest, ["src", "dst"], "left")
    score = F.when(F.col("src") == F.col("dst"), num(0.7)).when(F.col("hops").isNotNull(), F.least(num(1), num(0.5) + num(0.1) * F.col("hops")))
    return hits.select("transaction_id", score.alias("score")).where("score > 0")


#: The rules whose scores are found beside the ledger and joined to it, together, by transaction_id.
JOINED_RULES = {"rapid_movement": _rapid_scores, "round_tripping": _trip_scores}


def joined_rules(df: DataFrame, cfg: RuleConfig = DEFAULT, rules: tuple[str, ...] = tuple(JOINED_RULES)) -> DataFrame:
    """The scores of these rules. rapid_movement: inflows that leave again within hours. round_tripping: money that comes back within ``trip_max_hops`` transfers."""
    found = None
    for rule in rules:
        rows = JOINED_RULES[rule](df, cfg).withColumn("rule", F.lit(rule))
        found = rows if found is None else found.unionByName(rows)
    best = found.groupBy("transaction_id").agg(*[F.max(F.when(F.col("rule") == r, F.col("score"))).alias(score_name(r)) for r in rules])
    return df.join(cut(best), "transaction_id", "left").na.fill(0.0, [score_name(r) for r in rules])


def rapid_movement(df: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """Inflows that leave again within hours."""
    return joined_rules(df, cfg, ("rapid_movement",))


def round_tripping(df: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """Money that comes back: by the longest simple cycle of 2 to ``trip_max_hops`` transfers that an edge lies on."""
    return joined_rules(df, cfg, ("round_tripping",))


def geographic(df: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    side = lambda c: F.when(F.upper(F.substring(c, 1, 2)).isin(*cfg.jurisdictions), num(0.3)).otherwise(num(0))
    score = side("from_bank") + side("to_bank") + F.when(F.col("is_cross_currency") == 1, num(0.1)).otherwise(num(0))
    score = score + F.when((score > 0) & (F.col("amount") > 50_000), num(0.2)).otherwise(num(0))
    return df.withColumn(score_name("geographic_risk"), clip(score))


def combine(df: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """Composite, flag, count and maximum of the six scores; a score that is not there counts as 0."""
    have = [(r, w) for r, w in cfg.weights if score_name(r) in df.columns]
    total = sum(w for _, w in have)
    weighted = sum((F.col(score_name(r)) * num(w) for r, w in have), num(0))
    scores = [F.col(score_name(r)) for r, _ in have]
    df = df.withColumn("rule_composite_score", clip(weighted / num(total)) if total else num(0))
    return df.withColumns(
        {
            "rule_flagged": (F.col("rule_composite_score") > num(cfg.flag_above)).cast("int"),
            "rule_trigger_count": sum(((s > 0).cast("int") for s in scores), F.lit(0)),
            "rule_max_score": F.greatest(num(0), *scores),
        }
    )


def evaluate(df: DataFrame, cfg: RuleConfig = DEFAULT, rules: tuple[str, ...] = RULES) -> DataFrame:
    """These rules (all by default) and what they come to together.

    Scores that are found beside the ledger are joined to it first, then it is moved once, for all windows by sender.
    """
    if some := tuple(r for r in JOINED_RULES if r in rules):
        df = joined_rules(df, cfg, some)
    if some := tuple(r for r in SENDER_RULES if r in rules):
        df = sender_rules(df, cfg, some)
    if "geographic_risk" in rules:
        df = geographic(df, cfg)
    return combine(df, cfg)


def account_history(df: DataFrame) -> DataFrame:
    def side(key: str, p: str, *more: Column) -> DataFrame:
        return df.groupBy(F.col(key).alias("account_id")).agg(F.count("*").alias(f"{p}_count"), F.sum("amount").alias(f"{p}_sum"), F.avg("amount").alias(f"{p}_mean"), F.max("amount").alias(f"{p}_max"), *more)

    out = side("from_id", "out", F.stddev_samp("amount").alias("out_std"), F.min("timestamp").alias("out_first"), F.max("timestamp").alias("out_last"))
    both = out.join(side("to_id", "in"), "account_id", "full_outer")
    return both.na.fill(0, [c for c, t in both.dtypes if t in ("bigint", "double")])


def statistics(scored: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """rule, weight and how many transactions it scored."""
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), num(w).alias("weight"), (F.col(score_name(r)) > 0).cast("long").alias("hit")) for r, w in cfg.weights)))
    return scored.select(rows.alias("x")).select("x.*").groupBy("rule", "weight").agg(F.sum("hit").alias("n_triggered"))


def evaluate_single(spark: SparkSession, transaction: DataFrame, history: DataFrame | None = None, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """Score one transaction (a one-row frame) with its account's history: one row with an array of results."""
    rows = transaction.withColumn("is_new", F.lit(True))
    if history is not None:
        rows = rows.unionByName(history.withColumn("is_new", F.lit(False)), allowMissingColumns=True)
    rows = evaluate(rows, cfg, ("rapid_movement", "structuring", "velocity", "geographic_risk"))
    names = ("structuring", "rapid_movement", "geographic_risk", "velocity")
    results = F.array(*(F.struct(F.lit(i).alias("rule_id"), F.lit(r).alias("rule_name"), F.col(score_name(r)).alias("risk_score"), (F.col(score_name(r)) > 0).alias("triggered")) for i, r in enumerate(names)))
    return rows.where("is_new").select("transaction_id", results.alias("results"))
