"""Rules on a stream of transactions (an extension: batch is the yardstick)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import RuleConfig
from ..functions.columns import DAY_US, clip, num, us

DEFAULT = RuleConfig()


def sliding_velocity(stream: DataFrame, hours: int = 24, slide_minutes: int = 60, threshold: int = 30, late: str = "24 hours") -> DataFrame:
    """Windows in which a sender reaches the threshold, with the count and the sum."""
    w = F.window("timestamp", f"{hours} hours", f"{slide_minutes} minutes")
    counted = stream.withWatermark("timestamp", late).groupBy("from_id", w).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return counted.where(F.col("n") >= threshold).select("from_id", "window.start", "window.end", "n", "total")


def stateless(stream: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """The part of the structuring score that a transaction shows by itself."""
    a = F.col("amount")
    score = F.when(a.between(cfg.structuring_low, cfg.structuring_high), num(0.4)).otherwise(num(0))
    score = score + F.when((a >= num(cfg.ctr_threshold * 0.9)) & (a < num(cfg.ctr_threshold)), num(0.2)).otherwise(num(0))
    return stream.withColumn("rule_structuring_score", clip(score))


#: Senders are dealt to so many groups: a call to Python and a state row a sender take far longer than its few transactions.
BUCKETS = 8192


def dormant(stream: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """Large transactions of senders that were silent for long: each sender's last time is state, of which a bucket of senders has one row. Rows without a time are passed over."""
    keep = "transaction_id long, from_id string, gap_days double, amount double"
    rows = stream.select("transaction_id", "from_id", "amount", us().alias("us"), F.pmod(F.xxhash64("from_id"), F.lit(BUCKETS)).alias("bucket"))

    def run(key, frames, state):
        known = dict(zip(*state.get)) if state.exists else {}
        frame = pd.concat(list(frames))
        frame = frame[frame["us"].notna()]
        code, names = pd.factorize(frame["from_id"], use_na_sentinel=False)
        names = [None if pd.isna(n) else n for n in names]
        order = np.lexsort((frame["transaction_id"].to_numpy(), frame["us"].to_numpy(), code))
        frame, code = frame.iloc[order], code[order]
        at = frame["us"].to_numpy().astype(float)  # microseconds are exact up to the year 2255
        first = np.append(True, code[1:] != code[:-1])[: len(code)]
        before = np.where(first, np.nan, np.append(np.nan, at[:-1])[: len(at)])
        before = np.fmax(before, np.array([known.get(n, np.nan) for n in names], float)[code])
        hit = (at - before >= cfg.dormant_days * DAY_US) & (frame["amount"].to_numpy() >= cfg.dormant_min_amount)
        for n, t in zip(names, at[np.append(first[1:], True)[: len(at)]]):  # codes are in order of names
            known[n] = max(known.get(n, int(t)), int(t))
        state.update((list(known), list(known.values())))
        if hit.any():
            found = frame[hit]
            yield pd.DataFrame({"transaction_id": found["transaction_id"], "from_id": found["from_id"], "gap_days": (at - before)[hit] / DAY_US, "amount": found["amount"]})

    return rows.groupBy("bucket").applyInPandasWithState(run, keep, "senders array<string>, last array<long>", "append", GroupStateTimeout.NoTimeout)
