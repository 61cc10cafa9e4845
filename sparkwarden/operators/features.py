"""Features of transactions, keyed by transaction_id. Statistics by account are computed once and joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import FeatureConfig
from ..functions.columns import DAY_US, num, us
from .quantiles import quantiles

DEFAULT = FeatureConfig()


def flag(x: Column) -> Column:
    return F.coalesce(x.cast("int"), F.lit(0))


def with_scalars(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Whole-table aggregates beside every row (one row is broadcast)."""
    return df.crossJoin(F.broadcast(df.agg(*(x.alias(n) for n, x in aggregates.items()))))


def transaction(df: DataFrame, cfg: FeatureConfig = DEFAULT) -> DataFrame:
    paid, received = (F.col(c) if c in df.columns else F.col("amount") for c in ("amount_paid", "amount_received"))
    kind = F.col("payment_format_normalized" if "payment_format_normalized" in df.columns else "payment_format")
    hour, day = F.hour("timestamp"), F.weekday("timestamp")
    a, turn = F.col("amount"), 2 * F.pi()
    df = with_scalars(df, _mean=F.avg("amount"), _std=F.stddev_samp("amount"))
    return df.select(
        "transaction_id", a.alias("feat_amount"), F.log1p(a).alias("feat_amount_log"),
        F.when(F.coalesce("_std", num(0)) > 0, (a - F.col("_mean")) / F.col("_std")).otherwise(num(0)).alias("feat_amount_zscore"),
        paid.alias("feat_amount_paid"), received.alias("feat_amount_received"), (received - paid).alias("feat_amount_diff"), F.when(paid > 0, received / paid).otherwise(num(1)).alias("feat_amount_ratio"),
        *([F.col("is_cross_currency").alias("feat_cross_currency")] if "is_cross_currency" in df.columns else []),
        *[flag(kind == f).alias(f"feat_format_{f}") for f in cfg.formats],
        hour.alias("feat_hour"), F.sin(turn * hour / 24).alias("feat_hour_sin"), F.cos(turn * hour / 24).alias("feat_hour_cos"), flag(hour.between(9, 17)).alias("feat_business_hours"),
        flag((hour >= 22) | (hour <= 5)).alias("feat_night"), flag(hour.between(4, 7)).alias("feat_early"), day.alias("feat_dow"), F.sin(turn * day / 7).alias("feat_dow_sin"), F.cos(turn * day / 7).alias("feat_dow_cos"),
        flag(day >= 5).alias("feat_weekend"),
    )


def sender_stats(df: DataFrame) -> DataFrame:
    span = (F.max(us()) - F.min(us())) / DAY_US
    out = df.groupBy("from_id").agg(
        F.count("*").alias("sender_count"), F.sum("amount").alias("sender_sum"), F.avg("amount").alias("sender_mean"), F.stddev_samp("amount").alias("sender_std"), F.max("amount").alias("sender_max"),
        F.min("amount").alias("sender_min"), F.count_distinct("to_id").alias("sender_recipients"), F.greatest(num(1), span).alias("sender_days_active"),
    )
    out = out.join(quantiles(df, "amount", {"sender_median": 0.5}, ["from_id"]), "from_id", "left")
    return out.withColumn("sender_rate", F.col("sender_count") / F.col("sender_days_active"))


def receiver_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("to_id").agg(
        F.count("*").alias("receiver_count"), F.sum("amount").alias("receiver_sum"), F.avg("amount").alias("receiver_mean"), F.stddev_samp("amount").alias("receiver_std"), F.count_distinct("from_id").alias("receiver_senders")
    )


def account(df: DataFrame) -> DataFrame:
    out = df.select("transaction_id", "from_id", "to_id").join(sender_stats(df), "from_id", "left").join(receiver_stats(df), "to_id", "left")
    return out.select("transaction_id", *[F.coalesce(c, F.lit(0)).alias(f"feat_{c}") for c in out.columns if c.startswith(("sender_", "receiver_"))])


def behavioral(df: DataFrame) -> DataFrame:
    a = F.col("amount")
    stats = df.groupBy("from_id").agg(F.avg("amount").alias("m"), F.stddev_samp("amount").alias("s"), F.max("amount").alias("mx"), F.mode(F.hour("timestamp"), deterministic=True).alias("mode_hour"))
    stats = stats.join(quantiles(df, "amount", {"md": 0.5}, ["from_id"]), "from_id", "left")
    daily = df.groupBy("from_id", F.to_date("timestamp").alias("date")).agg(F.count("*").alias("n"))
    spread = daily.groupBy("from_id").agg(F.avg("n").alias("dm"), F.stddev_samp("n").alias("ds"))
    whole = lambda c: F.when(F.coalesce(c, num(0)) == 0, num(1)).otherwise(F.col(c))
    rows = df.select("transaction_id", "from_id", "amount", F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("hour"))
    rows = rows.join(stats, "from_id").join(daily, ["from_id", "date"]).join(spread, "from_id")
    gap = F.abs(F.col("hour") - F.col("mode_hour"))
    return rows.select(
        "transaction_id", ((a - F.col("m")) / whole("s")).alias("feat_amount_dev"), F.when(F.col("md") > 0, a / F.col("md")).otherwise(num(0)).alias("feat_amount_dev_median"),
        flag(a >= F.col("mx") * 0.95).alias("feat_personal_max"), ((F.col("n") - F.col("dm")) / whole("ds")).alias("feat_daily_count_dev"), F.least(gap, 24 - gap).alias("feat_hour_deviation"),
    )


def network(df: DataFrame) -> DataFrame:
    out = df.groupBy("from_id").agg(F.count_distinct("to_id").alias("fan_out"))
    into = df.groupBy("to_id").agg(F.count_distinct("from_id").alias("fan_in"))
    own = into.select(F.col("to_id").alias("from_id"), F.col("fan_in").alias("own_in"))
    pairs = df.groupBy("from_id", "to_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_seen"))
    total = pairs.groupBy("from_id").agg(F.sum("n").alias("t"))
    hhi = pairs.join(total, "from_id").groupBy("from_id").agg(F.sum(F.pow(F.col("n") / F.col("t"), F.lit(2.0))).alias("hhi"))
    rows = df.join(out, "from_id").join(into, "to_id").join(own, "from_id", "left").join(hhi, "from_id").join(pairs.drop("n"), ["from_id", "to_id"])
    banks = {"from_bank", "to_bank"} <= set(df.columns)
    return rows.select(
        "transaction_id", F.col("fan_out").alias("feat_fan_out"), F.col("fan_in").alias("feat_fan_in"),
        F.when(F.coalesce("own_in", F.lit(0)) > 0, F.col("fan_out") / F.col("own_in")).otherwise(F.col("fan_out").cast("double")).alias("feat_fan_ratio"), F.col("hhi").alias("feat_counterparty_hhi"),
        flag(F.col("timestamp") == F.col("first_seen")).alias("feat_new_counterparty"), *([flag(F.col("from_bank") != F.col("to_bank")).alias("feat_cross_bank")] if banks else []),
    )


def _trailing(df: DataFrame, key: str, days: tuple[int, ...]) -> DataFrame:
    """_key, _us and the trailing statistics of the key's amounts at that time, a struct (count, sum, mean, max, std) a width (named by its days).

    A frame that slides is summed anew for every row, in a time by the square of a key's rows. So time is cut into blocks as wide as the
    frame, which then is the end of one block and the start of the next: two sums that only grow. What the end of the block before has
    is asked by a row at the frame's left end.
    """
    width = F.col("d") * F.lit(DAY_US)
    block = lambda at: F.col(at) - F.pmod(F.col(at), width)
    places = F.array(F.struct(F.col("_us").alias("at"), F.col("amount").alias("a"), F.lit(False).alias("asks")), F.struct((F.col("_us") - width + 1).alias("at"), F.lit(None).cast("double").alias("a"), F.lit(True).alias("asks")))
    rows = df.select(F.col(key).alias("_key"), us().alias("_us"), F.col("amount").cast("double").alias("amount")).withColumn("d", F.explode(F.array(*(F.lit(d).cast("long") for d in days))))
    rows = rows.withColumn("p", F.explode(places)).select("_key", "_us", "d", "p.*").where(~F.col("asks") | (block("at") < block("_us"))).withColumn("block", block("at"))
    own = Window.partitionBy("_key", "d", "block")
    grown, left = (own.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("at"), F.desc("at")))
    sums = {"n": F.count("a"), "s": F.sum("a"), "x": F.max("a"), "v": F.var_pop("a")}
    rows = rows.select("_key", "_us", "d", "asks", *[F.when(F.col("asks"), f.over(left)).otherwise(f.over(grown)).alias(c) for c, f in sums.items()])
    pick = lambda d, asks, c: F.max(F.when((F.col("d") == d) & (F.col("asks") == asks), F.col(c))).alias(f"{c}{int(asks)}_{d}")
    both = rows.groupBy("_key", "_us").agg(*[pick(d, asks, c) for d in days for asks in (False, True) for c in sums])

    def merged(d):
        (n0, s0, x0, v0), (n1, s1, x1, v1) = ([F.col(f"{c}{k}_{d}") for c in sums] for k in (0, 1))
        n0, n1 = F.coalesce(n0, F.lit(0)), F.coalesce(n1, F.lit(0))
        n, s, zero = n0 + n1, F.coalesce(s0, num(0)) + F.coalesce(s1, num(0)), num(0)
        apart = F.when((n0 > 0) & (n1 > 0), F.pow(s1 / n1 - s0 / n0, F.lit(2.0)) * n0 * n1 / n).otherwise(zero)
        spread = F.coalesce(v0 * n0, zero) + F.coalesce(v1 * n1, zero) + apart
        std = F.when(n > 1, F.sqrt(spread / (n - 1))).otherwise(zero)
        return F.struct(n.alias("count"), s.alias("sum"), F.when(n > 0, s / n).otherwise(zero).alias("mean"), F.coalesce(F.greatest(x0, x1), zero).alias("max"), std.alias("std")).alias(str(d))

    return both.select("_key", "_us", *[merged(d) for d in days])


def rolling(df: DataFrame, cfg: FeatureConfig = DEFAULT) -> DataFrame:
    """Trailing count, sum, mean, max and standard deviation of amounts by sender and by receiver; a window is open on its left end."""
    df = df.select("transaction_id", "timestamp", "from_id", "to_id", "amount")
    out = df.select("transaction_id", "from_id", "to_id", us().alias("us"))
    for side, key in (("sender", "from_id"), ("receiver", "to_id")):
        found = _trailing(df, key, cfg.windows_days)
        out = out.join(found, out[key].eqNullSafe(found["_key"]) & out["us"].eqNullSafe(found["_us"]), "left")
        made = [F.col(f"`{d}`.{name}").alias(f"feat_{side}_{name}_{d}d") for d in cfg.windows_days for name in ("count", "sum", "mean", "max", "std")]
        out = out.select(*[c for c in out.columns if c not in found.columns], *made)
    return out.drop("from_id", "to_id", "us")


def entropy(df: DataFrame, bins: int = 20) -> DataFrame:
    """from_id and the Shannon entropy (bits) of its amounts in equal-width bins, as many as it has amounts, ``bins`` at most."""
    stats = df.groupBy("from_id").agg(F.count("*").alias("n"), F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    k = F.least(F.lit(bins), F.col("n"))
    place = F.least(F.floor((F.col("amount") - F.col("lo")) / (F.col("hi") - F.col("lo")) * k), k - 1)
    binned = df.select("from_id", "amount").join(stats.where("n > 1 and hi > lo"), "from_id").groupBy("from_id", "n", place.alias("bin")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("n")
    found = binned.groupBy("from_id").agg((-F.sum(p * F.log2(p))).alias("entropy"))
    return stats.select("from_id").join(found, "from_id", "left").na.fill(0.0, ["entropy"])


def risk(df: DataFrame, cfg: FeatureConfig = DEFAULT) -> DataFrame:
    a, hour = F.col("amount"), F.hour("timestamp")
    marks = quantiles(df, "amount", {"_p95": 0.95, "_p99": 0.99, "_half": 0.5})  # one row
    rows = df.crossJoin(F.broadcast(marks)).join(entropy(df), "from_id")
    large = a > F.col("_half")
    return rows.select(
        "transaction_id", *[flag((a % t == 0) & (a >= t)).alias(f"feat_round_{t}") for t in cfg.round_thresholds],
        F.when((a >= 5_000) & (a < 10_000), 1 - (10_000 - a) / 5_000).otherwise(num(0)).alias("feat_structuring_proximity"), flag(a > F.col("_p95")).alias("feat_large"), flag(a > F.col("_p99")).alias("feat_very_large"),
        flag(((hour >= 22) | (hour <= 5)) & large).alias("feat_night_large"), flag((F.weekday("timestamp") >= 5) & large).alias("feat_weekend_large"), F.col("entropy").alias("feat_amount_entropy"),
    )


GROUPS = {"transaction": transaction, "account": account, "behavioral": behavioral, "network": network, "temporal": rolling, "risk": risk}


def engineer(df: DataFrame, scored: DataFrame | None = None, graph_features: DataFrame | None = None) -> DataFrame:
    """All groups by transaction_id; infinite and missing values become 0."""
    parts = [f(df) for f in GROUPS.values()]
    if scored is not None:
        parts.append(scored.select("transaction_id", *[c for c in scored.columns if c.startswith("rule_")]))
    if graph_features is not None:
        parts.append(graph_features.select("transaction_id", *[c for c in graph_features.columns if c.startswith("graph_")]))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "transaction_id", "left")
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    clean = [F.when(bad(c), num(0)).otherwise(F.coalesce(c, num(0))).alias(c) if t == "double" else F.coalesce(c, F.lit(0)).alias(c) if c != "transaction_id" else F.col(c) for c, t in out.dtypes]
    return out.select(*clean)


def importance_groups(df: DataFrame, scored: DataFrame | None = None, graph_features: DataFrame | None = None) -> dict[str, list[str]]:
    """Feature names by group, as each group makes them; empty groups are left out."""
    groups = {name: [c for c in f(df).columns if c != "transaction_id"] for name, f in GROUPS.items()}
    for name, prefix, frame in (("rule", "rule_", scored), ("graph", "graph_", graph_features)):
        groups[name] = [c for c in frame.columns if c.startswith(prefix)] if frame is not None else []
    return {k: v for k, v in groups.items() if v}
