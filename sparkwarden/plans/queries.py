"""The queries over the test tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import RuleConfig
from ..functions.columns import num, rounded
from ..operators import alerts as al, evaluation as ev, features as fe, graph as gr, ml, paths, report as rp, rules as ru, triage as tr
from ..operators.iterate import cut, shared_path
from ..sources import ledger

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The test ledger has fewer transactions an hour than real ones, so the thresholds of its four windows are lower here.
RULES = RuleConfig(velocity=((1, 2), (6, 3), (24, 6), (168, 12)))
AS_OF = "2024-02-10 00:00:00"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.events_ledger(table(spark, sf_dir, "events"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.orders_ledger(*(table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "supplier")))


CODES = "[" + ", ".join(f"'{c}'" for c in ledger.NATION_CODES) + "]"
E = """e AS (SELECT event_id AS transaction_id, ts, 'A' || user_id AS from_id, 'A' || json_extract_string(props, '$.k') AS to_id,
  round(value * 100, 2) AS amount, event_type AS payment_format, CAST(event_type = 'error' AS INTEGER) AS is_laundering FROM events)"""
O = f"""o AS (SELECT o_orderkey AS transaction_id, o_orderdate AS ts, 'C' || o_custkey AS from_id, 'S' || s AS to_id, {CODES}[c_nationkey + 1] AS from_bank,
  {CODES}[s_nationkey + 1] AS to_bank, CAST(c_nationkey <> s_nationkey AS INTEGER) AS is_cross_currency, o_totalprice AS amount, o_orderpriority AS payment_format, 0 AS is_laundering
  FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = s)"""
R = lambda *cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# --- cleaning and profiles


@query("ledger_clean", f"WITH {E} SELECT transaction_id, strftime(ts, '%Y-%m-%d') AS date, from_id, to_id, round(amount, 6) AS amount, payment_format, is_laundering, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week FROM e")
def _(spark, d):
    return ledger.calendar(events(spark, d)).select("transaction_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "from_id", "to_id", "amount", "payment_format", "is_laundering", "hour", "day_of_week")


RAW = f"""{O}, w AS (SELECT CASE WHEN transaction_id % 97 = 0 THEN 'not a time' ELSE strftime(ts, '%Y/%m/%d %H:%M') END AS t, ' 0' || from_bank || ' ' AS fb, from_id AS fa, to_bank AS tb, to_id AS ta, CASE WHEN transaction_id % 89 = 0 THEN 'n/a' ELSE CAST(amount AS VARCHAR) END AS rec,
  'usd' AS rc, CAST(amount * 0.5e0 AS VARCHAR) AS paid, CASE WHEN transaction_id % 5 = 0 THEN ' Eur' ELSE 'Usd' END AS pc, ['Cheque', 'ACH', 'Wire', 'Credit Card', 'Cash', 'Reinvestment', 'Bitcoin'][transaction_id % 7 + 1] AS pf, CASE WHEN transaction_id % 83 = 0 THEN '' ELSE CAST(transaction_id % 2 AS VARCHAR) END AS y, ts, amount, transaction_id AS k FROM o),
c AS (SELECT k, CAST(ts AS DATE) AS day, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS day_of_week, trim(fb) AS from_bank, trim(fb) || '_' || fa AS from_id, tb || '_' || ta AS to_id, coalesce(TRY_CAST(rec AS DOUBLE), 0) AS amount_received, TRY_CAST(paid AS DOUBLE) AS amount_paid, upper(trim(pc)) AS payment_currency,
  upper(trim(rc)) AS receiving_currency, pf AS payment_format, CASE pf WHEN 'Cheque' THEN 'check' WHEN 'ACH' THEN 'ach' WHEN 'Wire' THEN 'wire' WHEN 'Credit Card' THEN 'credit_card' WHEN 'Cash' THEN 'cash' WHEN 'Reinvestment' THEN 'reinvestment' ELSE 'other' END AS payment_format_normalized, coalesce(TRY_CAST(y AS INTEGER), 0) AS is_laundering, ts FROM w WHERE t <> 'not a time')"""


@query("ledger_raw", f"""WITH {RAW} SELECT row_number() OVER (ORDER BY ts, from_id, to_id, greatest(amount_paid, amount_received)) - 1 AS transaction_id, strftime(day, '%Y-%m-%d') AS date, hour, day_of_week, from_bank, from_id, to_id, round(amount_paid, 6) AS amount_paid, round(amount_received, 6) AS amount_received,
  round(greatest(amount_paid, amount_received), 6) AS amount, payment_currency, receiving_currency, (payment_currency <> receiving_currency)::INTEGER AS is_cross_currency, payment_format, payment_format_normalized, is_laundering FROM c""")
def _(spark, d):
    """Orders written as a raw ledger, with unreadable times, amounts and labels, spaces, mixed case and an unknown format, and cleaned."""
    o, k = orders(spark, d), F.col("transaction_id")
    kinds = F.array(*map(F.lit, ("Cheque", "ACH", "Wire", "Credit Card", "Cash", "Reinvestment", "Bitcoin")))
    values = (
        F.when(k % 97 == 0, "not a time").otherwise(F.date_format("timestamp", "yyyy/MM/dd HH:mm")), F.concat(F.lit(" 0"), "from_bank", F.lit(" ")), F.col("from_id"), F.col("to_bank"), F.col("to_id"),
        F.when(k % 89 == 0, "n/a").otherwise(F.col("amount").cast("string")), F.lit("usd"), (F.col("amount") * num(0.5)).cast("string"), F.when(k % 5 == 0, " Eur").otherwise("Usd"),
        F.element_at(kinds, (k % 7 + 1).cast("int")), F.when(k % 83 == 0, "").otherwise((k % 2).cast("string")),
    )
    raw = o.select(*(v.alias(c) for v, c in zip(values, ledger.RAW_COLUMNS)))
    out = ledger.clean(raw).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return out.select(
        "transaction_id", "date", "hour", "day_of_week", "from_bank", "from_id", "to_id", "amount_paid", "amount_received", "amount", "payment_currency", "receiving_currency",
        "is_cross_currency", "payment_format", "payment_format_normalized", "is_laundering",
    )


@query("ledger_number", f"WITH {O} SELECT transaction_id AS order_id, row_number() OVER (ORDER BY ts, from_id, to_id, amount, transaction_id) - 1 AS transaction_id FROM o")
def _(spark, d):
    df = orders(spark, d).withColumnRenamed("transaction_id", "order_id")
    return ledger.number(df, ("from_id", "to_id", "amount", "order_id")).select("order_id", "transaction_id")


PCT = ", ".join(f"round(quantile_cont(amount, {p / 100}), 6) AS p{p}" for p in (10, 25, 75, 90, 95, 99))


@query("profile_amounts", f"""WITH {O} SELECT count(*) AS n, CAST(sum(is_laundering) AS BIGINT) AS n_laundering, round(avg(is_laundering), 6) AS rate, CAST(datediff('day', min(ts), max(ts)) AS INTEGER) AS span_days,
  count(DISTINCT from_id) AS senders, count(DISTINCT to_id) AS receivers, round(avg(amount), 6) AS mean, round(quantile_cont(amount, 0.5), 6) AS median, round(stddev_samp(amount), 6) AS std, round(min(amount), 6) AS min, round(max(amount), 6) AS max, {PCT} FROM o""")
def _(spark, d):
    return ledger.profile_amounts(orders(spark, d))


@query("profile_accounts", f"WITH {E} SELECT count(*) AS accounts FROM (SELECT from_id FROM e UNION SELECT to_id FROM e)")
def _(spark, d):
    return ledger.distinct_accounts(events(spark, d))


@query("profile_formats", f"WITH {E} SELECT payment_format, count(*) AS n, CAST(sum(is_laundering) AS BIGINT) AS n_laundering, round(avg(is_laundering), 6) AS rate FROM e GROUP BY 1")
def _(spark, d):
    return ledger.profile_formats(events(spark, d))


@query("profile_daily", f"WITH {E} SELECT round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, max(n) AS max, count(*) AS days FROM (SELECT CAST(ts AS DATE), count(*) AS n FROM e GROUP BY 1)")
def _(spark, d):
    return ledger.profile_daily(events(spark, d))


def _side(key, other, p):
    return f"SELECT {key} AS account_id, count(*) AS {p}_count, sum(amount) AS {p}_total, avg(amount) AS {p}_mean, max(amount) AS {p}_max, sum(is_laundering) AS {p}_laundering, count(DISTINCT {other}) AS {p}_counterparties, min(ts) AS {p}_first, max(ts) AS {p}_last FROM e GROUP BY 1"


_z = lambda c, k="BIGINT": f"CAST(coalesce({c}, 0) AS {k}) AS {c}" if k == "BIGINT" else f"round(coalesce({c}, 0), 6) AS {c}"
_us = lambda c: f"CAST(epoch_us({c}) AS VARCHAR) AS {c}"


@query("account_summary", f"""WITH {E}, a AS ({_side('from_id', 'to_id', 'out')}), b AS ({_side('to_id', 'from_id', 'in')}), j AS (SELECT * FROM a FULL JOIN b USING (account_id))
  SELECT account_id, {', '.join(_z(f'{p}_{c}') for p in ('out', 'in') for c in ('count', 'laundering', 'counterparties'))}, {', '.join(_z(f'{p}_{c}', 'D') for p in ('out', 'in') for c in ('total', 'mean', 'max'))}, {', '.join(_us(f'{p}_{c}') for p in ('out', 'in') for c in ('first', 'last'))},
  coalesce(out_count, 0) + coalesce(in_count, 0) AS total_count, round(coalesce(in_total, 0) - coalesce(out_total, 0), 6) AS net_flow, CAST(coalesce(out_laundering, 0) + coalesce(in_laundering, 0) > 0 AS INTEGER) AS has_laundering FROM j""")
def _(spark, d):
    df = ledger.account_summary(events(spark, d))
    return df.withColumns({c: F.unix_micros(c).cast("string") for c in ("out_first", "out_last", "in_first", "in_last")})


@query("account_history", f"""WITH {E}, a AS (SELECT from_id AS account_id, count(*) AS out_count, sum(amount) AS out_sum, avg(amount) AS out_mean, max(amount) AS out_max, stddev_samp(amount) AS out_std, min(ts) AS out_first, max(ts) AS out_last FROM e GROUP BY 1),
  b AS (SELECT to_id AS account_id, count(*) AS in_count, sum(amount) AS in_sum, avg(amount) AS in_mean, max(amount) AS in_max FROM e GROUP BY 1)
  SELECT account_id, {_z('out_count')}, {', '.join(_z(c, 'D') for c in ('out_sum', 'out_mean', 'out_max', 'out_std', 'in_sum', 'in_mean', 'in_max'))}, {_z('in_count')}, {_us('out_first')}, {_us('out_last')} FROM a FULL JOIN b USING (account_id)""")
def _(spark, d):
    return ru.account_history(events(spark, d)).withColumns({c: F.unix_micros(c).cast("string") for c in ("out_first", "out_last")})


@query("time_split", f"WITH {O} SELECT transaction_id, row_number() OVER (ORDER BY ts, transaction_id) <= floor((SELECT count(*) FROM o) * 0.8e0) AS is_train FROM o")
def _(spark, d):
    return ledger.with_split(orders(spark, d), 0.2).select("transaction_id", "is_train")


# --- rules

W = "OVER (PARTITION BY from_id ORDER BY ts RANGE BETWEEN {} AND {})"
STRUCT = """least(1e0, CASE WHEN inr = 1 THEN 0.4e0 ELSE 0e0 END + CASE WHEN amount >= 9000e0 AND amount < 10000e0 THEN 0.2e0 ELSE 0e0 END + CASE WHEN inr = 1 AND ahead >= 2 THEN least(0.4e0, 0.1e0 * ahead) ELSE 0e0 END
  + CASE WHEN amount >= 9500e0 AND amount < 10000e0 AND amount % 100 < 10 THEN 0.1e0 ELSE 0e0 END + CASE WHEN amount >= 4750e0 AND amount < 5000e0 AND amount % 100 < 10 THEN 0.1e0 ELSE 0e0 END + CASE WHEN amount >= 2850e0 AND amount < 3000e0 AND amount % 100 < 10 THEN 0.1e0 ELSE 0e0 END)"""
VELO = lambda c, t: f"CASE WHEN {c} >= {t} THEN least(1e0, 0.3e0 + 0.2e0 * ({c} / {t}e0 - 1)) ELSE 0e0 END"
TRIP = """tb AS (SELECT * FROM e WHERE amount >= 1000 AND ts >= (SELECT max(ts) FROM e) - INTERVAL 30 DAY), te AS (SELECT DISTINCT from_id AS s, to_id AS d FROM tb WHERE from_id <> to_id),
tk AS (SELECT * FROM te WHERE s IN (SELECT d FROM te) AND d IN (SELECT s FROM te)),
t2 AS (SELECT a.s, a.d FROM tk a JOIN tk b ON b.s = a.d AND b.d = a.s), t3 AS (SELECT DISTINCT a.s, a.d FROM tk a JOIN tk b ON b.s = a.d AND b.d <> a.s JOIN tk c ON c.s = b.d AND c.d = a.s),
tp AS (SELECT a.s, b.d, list(a.d) AS mids FROM tk a JOIN tk b ON b.s = a.d AND b.d <> a.s GROUP BY 1, 2),
t4 AS (SELECT DISTINCT a.s, a.d FROM tk a JOIN tp p ON p.s = a.d AND p.d <> a.s JOIN tk f ON f.s = p.d AND f.d = a.s WHERE len(p.mids) > list_contains(p.mids, a.s)::INTEGER),
t5 AS (SELECT DISTINCT s, d FROM (SELECT a.s, a.d, len(p.mids) - list_contains(p.mids, a.s)::INTEGER AS m, len(q.mids) - list_contains(q.mids, a.d)::INTEGER AS n, len(list_intersect(p.mids, q.mids)) AS both_ FROM tk a JOIN tp p ON p.s = a.d AND p.d <> a.s JOIN tp q ON q.s = p.d AND q.d = a.s)
  WHERE m > 0 AND n > 0 AND NOT (m = 1 AND n = 1 AND both_ = 1)),
tl AS (SELECT s, d, max(h) AS hops FROM (SELECT s, d, 2 AS h FROM t2 UNION ALL SELECT s, d, 3 FROM t3 UNION ALL SELECT s, d, 4 FROM t4 UNION ALL SELECT s, d, 5 FROM t5) GROUP BY 1, 2),
trip AS (SELECT transaction_id, CASE WHEN from_id = to_id THEN 0.7e0 WHEN hops IS NOT NULL THEN least(1e0, 0.5e0 + 0.1e0 * hops) ELSE 0e0 END AS t FROM tb LEFT JOIN tl ON tl.s = from_id AND tl.d = to_id)"""
SCORED = f"""{E}, r0 AS (SELECT *, CASE WHEN amount BETWEEN 8000e0 AND 9999.99e0 THEN 1 ELSE 0 END AS inr FROM e),
r1 AS (SELECT *, sum(inr) {W.format('CURRENT ROW', 'INTERVAL 24 HOUR FOLLOWING')} AS ahead, {', '.join(f"count(*) {W.format(f'INTERVAL {h} HOUR PRECEDING', 'CURRENT ROW')} AS c{h}" for h, _ in RULES.velocity)} FROM r0),
big AS (SELECT * FROM e WHERE amount >= 5000),
infl AS (SELECT i.transaction_id, i.to_id AS acct, i.ts, sum(b.amount) / i.amount AS r, count(*) AS n FROM big i JOIN big b ON b.from_id = i.to_id AND b.ts BETWEEN i.ts AND i.ts + INTERVAL 4 HOUR GROUP BY i.transaction_id, i.to_id, i.ts, i.amount),
hit AS (SELECT *, least(1e0, 0.3e0 + 0.3e0 * r + CASE WHEN n > 1 THEN 0.2e0 ELSE 0e0 END) AS s FROM infl WHERE r >= 0.8e0),
rapid AS (SELECT transaction_id, max(s) AS s FROM (SELECT transaction_id, s FROM hit UNION ALL SELECT b.transaction_id, 0.8e0 * h.s FROM hit h JOIN big b ON b.from_id = h.acct AND b.ts BETWEEN h.ts AND h.ts + INTERVAL 4 HOUR) GROUP BY 1),
{TRIP},
r2 AS (SELECT r1.*, {STRUCT} AS rule_structuring_score, coalesce(rapid.s, 0e0) AS rule_rapid_movement_score, coalesce(trip.t, 0e0) AS rule_round_tripping_score, greatest({', '.join(VELO(f'c{h}', t) for h, t in RULES.velocity)}) AS rule_velocity_score
  FROM r1 LEFT JOIN rapid USING (transaction_id) LEFT JOIN trip USING (transaction_id)),
scored AS (SELECT *, least(1e0, (0.25e0 * rule_structuring_score + 0.20e0 * rule_rapid_movement_score + 0.30e0 * rule_round_tripping_score + 0.10e0 * rule_velocity_score) / 0.85e0) AS rule_composite_score,
  CAST(rule_structuring_score > 0 AS INTEGER) + CAST(rule_rapid_movement_score > 0 AS INTEGER) + CAST(rule_round_tripping_score > 0 AS INTEGER) + CAST(rule_velocity_score > 0 AS INTEGER) AS rule_trigger_count,
  greatest(rule_structuring_score, rule_rapid_movement_score, rule_round_tripping_score, rule_velocity_score) AS rule_max_score FROM r2)"""


def scored(spark, d):
    """The four rules that the events ledger has columns for, written once for all that reads them."""
    return cut(ru.evaluate(events(spark, d), RULES, ("structuring", "rapid_movement", "round_tripping", "velocity")))


def full_scores(spark, d, df=None):
    """With 0 for the two rules that the events ledger has no columns or times for."""
    df = scored(spark, d) if df is None else df
    return df.withColumns({ru.score_name(r): num(0) for r in ru.RULES if ru.score_name(r) not in df.columns})


@query("rule_structuring", f"WITH {SCORED} SELECT transaction_id, round(rule_structuring_score, 6) AS rule_structuring_score FROM scored")
def _(spark, d):
    return ru.structuring(events(spark, d)).select("transaction_id", "rule_structuring_score")


@query("rule_rapid_movement", f"WITH {SCORED} SELECT transaction_id, round(rule_rapid_movement_score, 6) AS rule_rapid_movement_score FROM scored")
def _(spark, d):
    return ru.rapid_movement(events(spark, d)).select("transaction_id", "rule_rapid_movement_score")


@query("rule_velocity", f"WITH {SCORED} SELECT transaction_id, round(rule_velocity_score, 6) AS rule_velocity_score FROM scored")
def _(spark, d):
    return ru.velocity(events(spark, d), RULES).select("transaction_id", "rule_velocity_score")


@query("rule_round_tripping", f"WITH {E}, {TRIP} SELECT transaction_id, round(coalesce(t, 0e0), 6) AS rule_round_tripping_score FROM e LEFT JOIN trip USING (transaction_id)")
def _(spark, d):
    return ru.round_tripping(events(spark, d)).select("transaction_id", "rule_round_tripping_score")


RISKY = ", ".join(f"'{c}'" for c in RULES.jurisdictions)
GEO = f"(CASE WHEN from_bank IN ({RISKY}) THEN 0.3e0 ELSE 0e0 END + CASE WHEN to_bank IN ({RISKY}) THEN 0.3e0 ELSE 0e0 END + 0.1e0 * is_cross_currency)"


@query("rule_geographic", f"WITH {O} SELECT transaction_id, round(least(1e0, {GEO} + CASE WHEN {GEO} > 0 AND amount > 50000 THEN 0.2e0 ELSE 0e0 END), 6) AS rule_geographic_risk_score FROM o")
def _(spark, d):
    return ru.geographic(orders(spark, d)).select("transaction_id", "rule_geographic_risk_score")


@query("rule_dormant", f"""WITH {O}, g AS (SELECT *, datediff('day', lag(ts) OVER (PARTITION BY from_id ORDER BY ts, transaction_id), ts) AS gap FROM o)
  SELECT transaction_id, round(CASE WHEN gap >= 90 AND amount >= 5000 THEN least(1e0, 0.3e0 + 0.4e0 * least(1e0, gap / 365e0) + 0.3e0 * least(1e0, amount / 50000e0)) ELSE 0e0 END, 6) AS rule_dormant_reactivation_score FROM g""")
def _(spark, d):
    return ru.dormant(orders(spark, d)).select("transaction_id", "rule_dormant_reactivation_score")


@query("rule_composite", f"WITH {SCORED} SELECT transaction_id, {R('rule_composite_score', 'rule_max_score')}, CAST(round(rule_composite_score, 12) > 0.3e0 AS INTEGER) AS rule_flagged, rule_trigger_count FROM scored")
def _(spark, d):
    df = scored(spark, d).withColumn("rule_flagged", (F.round("rule_composite_score", 12) > num(0.3)).cast("int"))
    return df.select("transaction_id", "rule_composite_score", "rule_max_score", "rule_flagged", "rule_trigger_count")


_RULE_NAMES = (("structuring", 0.25), ("rapid_movement", 0.20), ("round_tripping", 0.30), ("velocity", 0.10))


@query("rule_stats", f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{r}' AS rule, {w}e0 AS weight, count(*) FILTER (rule_{r}_score > 0) AS n_triggered FROM scored" for r, w in _RULE_NAMES))
def _(spark, d):
    return ru.statistics(scored(spark, d), replace(RULES, weights=_RULE_NAMES))


DORM = """CASE WHEN datediff('day', bf, ts) >= 90 AND amount >= 5000 THEN least(1e0, 0.3e0 + 0.4e0 * least(1e0, datediff('day', bf, ts) / 365e0) + 0.3e0 * least(1e0, amount / 50000e0)) ELSE 0e0 END"""
SIX = f"""{SCORED.replace(E, O + ", e AS (SELECT * FROM o)")}, b6 AS (SELECT *, lag(ts) OVER (PARTITION BY from_id ORDER BY ts, transaction_id) AS bf FROM scored),
  x6 AS (SELECT *, least(1e0, {GEO} + CASE WHEN {GEO} > 0 AND amount > 50000 THEN 0.2e0 ELSE 0e0 END) AS rule_geographic_risk_score, {DORM} AS rule_dormant_reactivation_score FROM b6)"""
_SIX = ru.RULES
_WEIGHTED = " + ".join(f"{w}e0 * rule_{r}_score" for r, w in RULES.weights)


@query("rule_evaluate", f"""WITH {SIX} SELECT transaction_id, {R(*(f'rule_{r}_score' for r in _SIX))}, round(least(1e0, ({_WEIGHTED}) / 1.1e0), 6) AS rule_composite_score, CAST(round(least(1e0, ({_WEIGHTED}) / 1.1e0), 12) > 0.3e0 AS INTEGER) AS rule_flagged,
  {' + '.join(f'CAST(rule_{r}_score > 0 AS INTEGER)' for r in _SIX)} AS rule_trigger_count, round(greatest({', '.join(f'rule_{r}_score' for r in _SIX)}), 6) AS rule_max_score FROM x6""")
def _(spark, d):
    """All six rules over the orders, as the engine applies them."""
    df = ru.evaluate(orders(spark, d), RULES).withColumn("rule_flagged", (F.round("rule_composite_score", 12) > num(0.3)).cast("int"))
    return df.select("transaction_id", *[ru.score_name(r) for r in _SIX], "rule_composite_score", "rule_flagged", "rule_trigger_count", "rule_max_score")


@query("rule_single", f"WITH {SCORED} SELECT transaction_id, {', '.join(f'round(rule_{r}_score, 6) AS {r}' for r in ('structuring', 'rapid_movement', 'velocity'))}, 0e0 AS geographic_risk FROM scored WHERE transaction_id = 77")
def _(spark, d):
    """One transaction beside the whole ledger: what passes an inflow on is sent by others. All four results."""
    df = events(spark, d).withColumns({"from_bank": F.lit("XX"), "to_bank": F.lit("XX"), "is_cross_currency": F.lit(0)})
    one, past = df.where("transaction_id = 77"), df.where("transaction_id <> 77")
    out = ru.evaluate_single(spark, one, past, RULES)
    score = F.map_from_entries(F.transform("results", lambda x: F.struct(x["rule_name"], x["risk_score"])))
    return out.select("transaction_id", *[score[r].alias(r) for r in ("structuring", "rapid_movement", "velocity", "geographic_risk")])


# --- features


@query("feat_transaction", f"""WITH {E}, m AS (SELECT avg(amount) AS mu, stddev_samp(amount) AS sd FROM e) SELECT transaction_id, round(amount, 6) AS feat_amount, round(ln(1 + amount), 6) AS feat_amount_log, round((amount - mu) / sd, 6) AS feat_amount_zscore, hour(ts)::INTEGER AS feat_hour,
  round(sin(2 * pi() * hour(ts) / 24), 6) + 0e0 AS feat_hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0e0 AS feat_hour_cos, (hour(ts) BETWEEN 9 AND 17)::INTEGER AS feat_business_hours, (hour(ts) >= 22 OR hour(ts) <= 5)::INTEGER AS feat_night, (hour(ts) BETWEEN 4 AND 7)::INTEGER AS feat_early,
  (isodow(ts) - 1)::INTEGER AS feat_dow, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0e0 AS feat_dow_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0e0 AS feat_dow_cos, (isodow(ts) >= 6)::INTEGER AS feat_weekend FROM e, m""")
def _(spark, d):
    names = ("amount", "amount_log", "amount_zscore", "hour", "hour_sin", "hour_cos", "business_hours", "night", "early", "dow", "dow_sin", "dow_cos", "weekend")
    return fe.transaction(events(spark, d)).select("transaction_id", *[f"feat_{n}" for n in names])


@query("feat_account", f"""WITH {E}, s AS (SELECT from_id, count(*) AS sc, sum(amount) AS ss, avg(amount) AS sm, coalesce(stddev_samp(amount), 0) AS sd, max(amount) AS sx, min(amount) AS sn, quantile_cont(amount, 0.5) AS md, count(DISTINCT to_id) AS nr,
  greatest(1e0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000e0) AS da FROM e GROUP BY 1), r AS (SELECT to_id, count(*) AS rc, sum(amount) AS rs, avg(amount) AS rm, coalesce(stddev_samp(amount), 0) AS rd, count(DISTINCT from_id) AS ns FROM e GROUP BY 1)
  SELECT transaction_id, sc AS feat_sender_count, round(ss, 6) AS feat_sender_sum, round(sm, 6) AS feat_sender_mean, round(sd, 6) AS feat_sender_std, round(sx, 6) AS feat_sender_max, round(sn, 6) AS feat_sender_min, round(md, 6) AS feat_sender_median, nr AS feat_sender_recipients, round(da, 6) AS feat_sender_days_active,
  round(sc / da, 6) AS feat_sender_rate, rc AS feat_receiver_count, round(rs, 6) AS feat_receiver_sum, round(rm, 6) AS feat_receiver_mean, round(rd, 6) AS feat_receiver_std, ns AS feat_receiver_senders FROM e JOIN s USING (from_id) JOIN r USING (to_id)""")
def _(spark, d):
    return fe.account(events(spark, d))


@query("feat_behavioral", f"""WITH {E}, s AS (SELECT from_id, avg(amount) AS m, stddev_samp(amount) AS sd, quantile_cont(amount, 0.5) AS md, max(amount) AS mx FROM e GROUP BY 1),
  h AS (SELECT from_id, hour(ts) AS hr, row_number() OVER (PARTITION BY from_id ORDER BY count(*) DESC, hour(ts)) AS k FROM e GROUP BY 1, 2), dy AS (SELECT from_id, CAST(ts AS DATE) AS dt, count(*) AS n FROM e GROUP BY 1, 2),
  sp AS (SELECT from_id, avg(n) AS dm, stddev_samp(n) AS ds FROM dy GROUP BY 1)
  SELECT transaction_id, round((amount - m) / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END, 6) AS feat_amount_dev, round(CASE WHEN md > 0 THEN amount / md ELSE 0 END, 6) AS feat_amount_dev_median, (amount >= 0.95e0 * mx)::INTEGER AS feat_personal_max,
  round((n - dm) / CASE WHEN coalesce(ds, 0) = 0 THEN 1 ELSE ds END, 6) AS feat_daily_count_dev, least(abs(hour(ts) - hr), 24 - abs(hour(ts) - hr))::INTEGER AS feat_hour_deviation
  FROM e JOIN s USING (from_id) JOIN h ON h.from_id = e.from_id AND k = 1 JOIN dy ON dy.from_id = e.from_id AND dt = CAST(ts AS DATE) JOIN sp ON sp.from_id = e.from_id""")
def _(spark, d):
    return fe.behavioral(events(spark, d))


@query("feat_network", f"""WITH {E}, o AS (SELECT from_id, count(DISTINCT to_id) AS fo FROM e GROUP BY 1), i AS (SELECT to_id, count(DISTINCT from_id) AS fi FROM e GROUP BY 1), p AS (SELECT from_id, to_id, count(*) AS n, min(ts) AS f FROM e GROUP BY 1, 2),
  h AS (SELECT from_id, sum((n / t) * (n / t)) AS hhi FROM (SELECT from_id, n::DOUBLE AS n, sum(n) OVER (PARTITION BY from_id) AS t FROM p) GROUP BY 1)
  SELECT transaction_id, fo AS feat_fan_out, i.fi AS feat_fan_in, round(CASE WHEN coalesce(own.fi, 0) > 0 THEN fo / own.fi::DOUBLE ELSE fo END, 6) AS feat_fan_ratio, round(hhi, 6) AS feat_counterparty_hhi, (ts = f)::INTEGER AS feat_new_counterparty
  FROM e JOIN o USING (from_id) JOIN i ON i.to_id = e.to_id LEFT JOIN i own ON own.to_id = e.from_id JOIN h ON h.from_id = e.from_id JOIN p ON p.from_id = e.from_id AND p.to_id = e.to_id""")
def _(spark, d):
    return fe.network(events(spark, d))


def _roll(side, key):
    out = []
    for days in (1, 7, 30, 90):
        w = f"OVER (PARTITION BY {key} ORDER BY ts RANGE BETWEEN INTERVAL {days * 86_400_000_000 - 1} MICROSECONDS PRECEDING AND CURRENT ROW)"
        out += [f"count(amount) {w} AS feat_{side}_count_{days}d"] + [f"round(coalesce({f}(amount) {w}, 0), 4) AS feat_{side}_{n}_{days}d" for n, f in (("sum", "sum"), ("mean", "avg"), ("max", "max"), ("std", "stddev_samp"))]
    return ", ".join(out)


@query("feat_rolling", f"WITH {E} SELECT transaction_id, {_roll('sender', 'from_id')}, {_roll('receiver', 'to_id')} FROM e")
def _(spark, d):
    return rounded(fe.rolling(events(spark, d)), 4)


ROUND = ", ".join(f"(amount % {t} = 0 AND amount >= {t})::INTEGER AS feat_round_{t}" for t in (100, 500, 1000, 5000, 10000))
ENT = """st AS (SELECT from_id, count(*) AS n, min(amount) AS lo, max(amount) AS hi FROM e GROUP BY 1), bn AS (SELECT from_id, n, least(floor((amount - lo) / (hi - lo) * least(20, n)), least(20, n) - 1) AS bin, count(*)::DOUBLE AS c FROM e JOIN st USING (from_id) WHERE n > 1 AND hi > lo GROUP BY 1, 2, 3),
  en AS (SELECT from_id, -sum(c / n * log2(c / n)) AS h FROM bn GROUP BY 1)"""


@query("feat_risk", f"""WITH {E}, q AS (SELECT quantile_cont(amount, 0.95) AS p95, quantile_cont(amount, 0.99) AS p99, quantile_cont(amount, 0.5) AS p50 FROM e), {ENT}
  SELECT transaction_id, {ROUND}, round(CASE WHEN amount >= 5000 AND amount < 10000 THEN 1 - (10000 - amount) / 5000 ELSE 0 END, 6) AS feat_structuring_proximity, (amount > p95)::INTEGER AS feat_large, (amount > p99)::INTEGER AS feat_very_large,
  ((hour(ts) >= 22 OR hour(ts) <= 5) AND amount > p50)::INTEGER AS feat_night_large, (isodow(ts) >= 6 AND amount > p50)::INTEGER AS feat_weekend_large, round(coalesce(h, 0), 6) AS feat_amount_entropy FROM e CROSS JOIN q LEFT JOIN en USING (from_id)""")
def _(spark, d):
    return fe.risk(events(spark, d))


@query("feat_entropy", f"WITH {E}, {ENT} SELECT from_id, round(coalesce(h, 0), 6) AS entropy FROM st LEFT JOIN en USING (from_id)")
def _(spark, d):
    return fe.entropy(events(spark, d))


@query("feat_all")
def _(spark, d):
    return fe.engineer(events(spark, d), scored(spark, d))


# --- graph

G = f"{E}, b AS (SELECT * FROM e WHERE amount >= 100 AND ts >= (SELECT max(ts) FROM e) - INTERVAL 30 DAY), g AS (SELECT from_id AS src, to_id AS dst, sum(amount) AS amount, count(*) AS txn_count, avg(amount) AS mean_amount, max(amount) AS max_amount, max(is_laundering) AS is_laundering, min(ts) AS first_seen, max(ts) AS last_seen FROM b GROUP BY 1, 2)"
V = f"{G}, nodes AS (SELECT src AS id FROM g UNION SELECT dst FROM g)"


def edges(spark, d):
    return gr.build_edges(events(spark, d))


@query("graph_edges", f"WITH {G} SELECT src, dst, {R('amount', 'mean_amount', 'max_amount')}, txn_count, is_laundering, {_us('first_seen')}, {_us('last_seen')} FROM g")
def _(spark, d):
    return edges(spark, d).withColumns({c: F.unix_micros(c).cast("string") for c in ("first_seen", "last_seen")})


VERT = "v AS (SELECT id, coalesce(od, 0) AS out_degree, coalesce(f, 0) AS out_flow, coalesce(idg, 0) AS in_degree, coalesce(i, 0) AS in_flow FROM nodes LEFT JOIN (SELECT src AS id, count(*) AS od, sum(amount) AS f FROM g GROUP BY 1) USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS idg, sum(amount) AS i FROM g GROUP BY 1) USING (id))"


@query("graph_nodes", f"WITH {V}, {VERT} SELECT id, out_degree, round(out_flow, 6) AS out_flow, in_degree, round(in_flow, 6) AS in_flow, round(in_flow - out_flow, 6) AS net_flow FROM v")
def _(spark, d):
    return gr.vertices(edges(spark, d))


@query("graph_top_edges", f"WITH {G} SELECT src, dst, round(amount, 6) AS amount FROM g ORDER BY amount DESC, src, dst LIMIT 50")
def _(spark, d):
    return gr.top_edges(edges(spark, d), 50).select("src", "dst", "amount")


@query("graph_degree_centrality", f"WITH {V}, {VERT}, n AS (SELECT count(*) - 1 AS m FROM v) SELECT id, round(in_degree / m::DOUBLE, 6) AS in_degree_centrality, round(out_degree / m::DOUBLE, 6) AS out_degree_centrality FROM v, n")
def _(spark, d):
    return gr.degree_centrality(edges(spark, d))


# Cycles of up to 4; the test graph has so many that none of 5 is among the first 10,000.
LIST = """k AS (SELECT DISTINCT src AS s, dst AS d FROM g WHERE src <> dst), cy AS (SELECT [a.s, a.d] AS c FROM k a JOIN k b ON b.s = a.d AND b.d = a.s WHERE a.s < a.d
  UNION ALL SELECT [a.s, a.d, b.d] FROM k a JOIN k b ON b.s = a.d AND b.d > a.s JOIN k c ON c.s = b.d AND c.d = a.s WHERE a.s < a.d
  UNION ALL SELECT [a.s, a.d, b.d, c.d] FROM k a JOIN k b ON b.s = a.d AND b.d > a.s JOIN k c ON c.s = b.d AND c.d > a.s AND c.d <> a.d JOIN k f ON f.s = c.d AND f.d = a.s WHERE a.s < a.d)"""


@query("graph_cycles", f"WITH {G}, {LIST} SELECT array_to_string(c, '>') AS cycle, len(c)::INTEGER AS length FROM cy ORDER BY len(c), c LIMIT 10000")
def _(spark, d):
    found = gr.AccountGraph().build(events(spark, d)).cycles()
    return found.select(F.array_join("cycle", ">").alias("cycle"), "length")


def _rank_sql(k: int) -> str:
    parts = [f"WITH {V}, t AS (SELECT src, sum(amount) AS t FROM g GROUP BY 1), l AS (SELECT g.src, dst, amount / t AS share FROM g JOIN t USING (src)), n AS (SELECT count(*)::DOUBLE AS n FROM nodes), p0 AS (SELECT id, 1 / n AS r FROM nodes, n)"]
    for i in range(1, k + 1):
        parts.append(f"""d{i} AS (SELECT coalesce(sum(r), 0) AS lost FROM p{i - 1} WHERE id NOT IN (SELECT src FROM t)), p{i} AS (SELECT nodes.id, 0.15e0 / n + 0.85e0 * (coalesce(got, 0) + lost / n) AS r
          FROM nodes CROSS JOIN n CROSS JOIN d{i} LEFT JOIN (SELECT dst AS id, sum(r * share) AS got FROM l JOIN p{i - 1} ON p{i - 1}.id = l.src GROUP BY 1) USING (id))""")
    return ", ".join(parts) + f" SELECT id, round(r, 6) AS pagerank FROM p{k}"


@query("graph_pagerank_k", _rank_sql(5))
def _(spark, d):
    return gr.pagerank(edges(spark, d), iterations=5)


NEAR = "nb AS (SELECT src AS v, dst AS u FROM g UNION SELECT dst, src FROM g), sz AS (SELECT v, count(*) AS n FROM nb GROUP BY 1)"


@query("graph_jaccard", f"""WITH {G}, {NEAR}, pr AS (SELECT DISTINCT from_id, to_id FROM e), bo AS (SELECT from_id, to_id, count(*) AS c FROM pr JOIN nb x ON x.v = from_id JOIN nb y ON y.v = to_id AND y.u = x.u GROUP BY 1, 2)
  SELECT from_id, to_id, round(CASE WHEN a.n IS NULL OR b.n IS NULL THEN 0 ELSE coalesce(c, 0) / (a.n + b.n - coalesce(c, 0))::DOUBLE END, 6) AS neighbor_jaccard FROM pr LEFT JOIN sz a ON a.v = from_id LEFT JOIN sz b ON b.v = to_id LEFT JOIN bo USING (from_id, to_id)""")
def _(spark, d):
    return gr.neighbour_jaccard(events(spark, d), edges(spark, d))


@query("graph_subgraph", f"""WITH {V}, nb AS (SELECT src AS v, dst AS u FROM g UNION SELECT dst, src FROM g), h0 AS (SELECT id AS node, 0 AS hop FROM nodes WHERE id IN ('A1', 'A7')), h1 AS (SELECT DISTINCT u AS node, 1 AS hop FROM nb JOIN h0 ON v = node WHERE u NOT IN (SELECT node FROM h0)),
  h2 AS (SELECT DISTINCT u AS node, 2 AS hop FROM nb JOIN h1 ON v = node WHERE u NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1)), k AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 ORDER BY hop, node LIMIT 60)
  SELECT src, dst, round(amount, 6) AS amount FROM g WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)""")
def _(spark, d):
    e = edges(spark, d)
    seeds = spark.createDataFrame([("A1",), ("A7",)], "node string")
    return paths.induced(e.select("src", "dst", "amount"), paths.neighbourhood(e, seeds, 2, 60))


TRAIL = "(SELECT src, dst, amount FROM g WHERE src <> dst)"


@query("graph_paths", f"""WITH {G}, t AS MATERIALIZED {TRAIL}, p1 AS MATERIALIZED (SELECT src AS a, dst AS b FROM t WHERE src = 'A1'), p2 AS MATERIALIZED (SELECT a, b, t.dst AS c FROM p1 LEFT JOIN t ON t.src = b), p3 AS MATERIALIZED (SELECT a, b, c, t.dst AS d FROM (SELECT * FROM p2 WHERE c IS NOT NULL AND c <> a) LEFT JOIN t ON t.src = c)
  SELECT a || '>' || b AS path FROM (SELECT a, b FROM p1 EXCEPT SELECT a, b FROM p2 WHERE c IS NOT NULL AND c <> a)
  UNION ALL SELECT a || '>' || b || '>' || c FROM p2 WHERE c = a
  UNION ALL SELECT a || '>' || b || '>' || c FROM (SELECT a, b, c FROM p2 WHERE c IS NOT NULL AND c <> a EXCEPT SELECT a, b, c FROM p3 WHERE d IS NOT NULL AND d NOT IN (a, b))
  UNION ALL SELECT a || '>' || b || '>' || c || '>' || d FROM p3 WHERE d IS NOT NULL""")
def _(spark, d):
    found = paths.money_trails(edges(spark, d), "A1", 3)
    return found.select(F.concat_ws(">", F.col("path")[0]["src"], F.transform("path", lambda x: x["dst"])).alias("path"))


@query("graph_wcc", f"""WITH RECURSIVE {V}, nb AS (SELECT src AS v, dst AS u FROM g UNION SELECT dst, src FROM g), reach AS (SELECT id, id AS r FROM nodes UNION SELECT reach.id, nb.u FROM reach JOIN nb ON nb.v = reach.r) SELECT id, min(r) AS component FROM reach GROUP BY 1""")
def _(spark, d):
    return gr.weak_components(edges(spark, d))


SCC = "ah AS (SELECT id, id AS r FROM nodes UNION SELECT ah.id, g.dst FROM ah JOIN g ON g.src = ah.r), sc AS (SELECT x.id, min(x.r) AS component FROM ah x JOIN ah y ON x.id = y.r AND x.r = y.id GROUP BY 1)"


@query("graph_scc", f"WITH RECURSIVE {V}, {SCC}, big AS (SELECT component, count(*) AS n FROM sc GROUP BY 1) SELECT id, n AS component_size FROM sc JOIN big USING (component)")
def _(spark, d):
    c = gr.strong_components(edges(spark, d))
    return c.join(c.groupBy("component").agg(F.count("*").alias("component_size")), "component").select("id", "component_size")


CLUS = """un AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g WHERE src <> dst), bi AS (SELECT a AS v, b AS u FROM un UNION ALL SELECT b, a FROM un), dg AS (SELECT v, count(*) AS d FROM bi GROUP BY 1),
  tr AS (SELECT x.v, count(*) / 2 AS t FROM bi x JOIN bi y ON y.v = x.u JOIN bi z ON z.v = y.u AND z.u = x.v GROUP BY 1), cl AS (SELECT id, CASE WHEN coalesce(d, 0) > 1 THEN 2e0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS clustering FROM nodes LEFT JOIN dg ON dg.v = id LEFT JOIN tr ON tr.v = id)"""


@query("graph_clustering", f"WITH {V}, {CLUS} SELECT id, round(clustering, 6) AS clustering FROM cl")
def _(spark, d):
    return gr.clustering(edges(spark, d))


COUNTS = """k AS MATERIALIZED (SELECT DISTINCT src AS x, dst AS y FROM g WHERE src <> dst), k2 AS MATERIALIZED (SELECT a.x, b.y, count(*)::HUGEINT AS n FROM k a JOIN k b ON b.x = a.y GROUP BY 1, 2),
  k3 AS MATERIALIZED (SELECT a.x, b.y, sum(b.n)::HUGEINT AS n FROM k a JOIN k2 b ON b.x = a.y GROUP BY 1, 2), r AS MATERIALIZED (SELECT a.x, a.y FROM k a JOIN k b ON a.x = b.y AND a.y = b.x), d2 AS (SELECT x, count(*)::HUGEINT AS n FROM r GROUP BY 1),
  t3 AS (SELECT a.x, sum(b.n)::HUGEINT AS n FROM k a JOIN k2 b ON b.x = a.y AND b.y = a.x GROUP BY 1), t4 AS (SELECT a.x, sum(a.n * b.n)::HUGEINT AS n FROM k2 a JOIN k2 b ON a.x = b.y AND a.y = b.x GROUP BY 1), w AS (SELECT
  (SELECT coalesce(sum(n), 0) FROM d2) AS s1, (SELECT coalesce(sum(n * n), 0) FROM d2) AS s2, (SELECT coalesce(sum(n * n * n), 0) FROM d2) AS s3, (SELECT coalesce(sum(n), 0) FROM t3) AS tr3, (SELECT coalesce(sum(n), 0) FROM t4) AS tr4,
  (SELECT coalesce(sum(a.n * b.n), 0) FROM k2 a JOIN k3 b ON a.x = b.y AND a.y = b.x) AS tr5, (SELECT coalesce(sum(a.n * b.n), 0) FROM k3 a JOIN k3 b ON a.x = b.y AND a.y = b.x) AS tr6,
  (SELECT coalesce(sum(d2.n * t3.n), 0) FROM d2 JOIN t3 USING (x)) AS dt3, (SELECT coalesce(sum(d2.n * t4.n), 0) FROM d2 JOIN t4 USING (x)) AS dt4, (SELECT coalesce(sum(n * n), 0) FROM t3) AS tt,
  (SELECT coalesce(sum(b.n), 0) FROM r JOIN k2 b ON b.x = r.y AND b.y = r.x) AS r2, (SELECT coalesce(sum(b.n), 0) FROM r JOIN k3 b ON b.x = r.y AND b.y = r.x) AS r3,
  (SELECT coalesce(sum(p.n * q.n), 0) FROM r JOIN d2 p ON p.x = r.x JOIN d2 q ON q.x = r.y) AS rdd, (SELECT coalesce(sum(p.n * q.n), 0) FROM r JOIN k2 p ON p.x = r.x AND p.y = r.y JOIN k2 q ON q.x = r.y AND q.y = r.x) AS r22,
  (SELECT coalesce(sum(b.n * b.n), 0) FROM k JOIN k2 b ON b.x = k.y AND b.y = k.x) AS e22, (SELECT count(*)::HUGEINT FROM r a JOIN r b ON b.x = a.y JOIN r c ON c.x = b.y AND c.y = a.x) AS rr),
  cc AS (SELECT (s1 // 2 + tr3 // 3 + (tr4 - 2 * s2 + s1) // 4 + (tr5 - 5 * dt3 + 5 * r2) // 5 + (tr6 - 6 * dt4 - 3 * tt + 4 * s3 + 6 * r3 + 3 * rdd + 6 * r22 + 3 * e22 - 3 * rr - tr3 - 12 * s2 + 4 * s1) // 6)::BIGINT AS cycles FROM w)"""


@query("graph_summary", f"""WITH RECURSIVE {V}, nb AS (SELECT src AS v, dst AS u FROM g UNION SELECT dst, src FROM g), reach AS (SELECT id, id AS r FROM nodes UNION SELECT reach.id, nb.u FROM reach JOIN nb ON nb.v = reach.r), wk AS (SELECT id, min(r) AS c FROM reach GROUP BY 1),
  {SCC}, {CLUS}, {COUNTS}, n AS (SELECT count(*) AS nodes, count(DISTINCT c) AS weak_components FROM wk), m AS (SELECT count(*) AS edges FROM g) SELECT nodes, weak_components, edges, (SELECT count(DISTINCT component) FROM sc) AS strong_components,
  (SELECT round(avg(clustering), 6) FROM cl) AS mean_clustering, cycles, round(edges / (nodes * (nodes - 1))::DOUBLE, 6) AS density, (weak_components = 1)::INTEGER AS weakly_connected FROM n, m, cc""")
def _(spark, d):
    """Without communities, which SQL cannot state."""
    return gr.AccountGraph().build(events(spark, d)).summary(with_communities=False)


@query("graph_communities")
def _(spark, d):
    return gr.communities(edges(spark, d))


@query("graph_betweenness")
def _(spark, d):
    return gr.betweenness(edges(spark, d))


@query("graph_suspicious")
def _(spark, d):
    return gr.AccountGraph().build(events(spark, d)).scores()


@query("graph_features")
def _(spark, d):
    return gr.AccountGraph().build(events(spark, d)).features(events(spark, d))


# --- alerts

ML = "(transaction_id * 7919 % 1000) / 1000e0"
ENS = f"{SCORED}, en AS (SELECT *, {ML} AS ml_score, least(1e0, round(0.30e0 * rule_composite_score + 0.45e0 * {ML}, 9)) AS ensemble_score FROM scored), ca AS (SELECT * FROM en WHERE ensemble_score >= 0.5e0)"
ENT_ALERT = """al AS (SELECT from_id AS entity_id, max(ensemble_score) AS ensemble_score, avg(ensemble_score) AS mean_score, max(ml_score) AS ml_score, count(*) AS transaction_count, sum(amount) AS total_amount, max(amount) AS max_amount, min(ts) AS first_seen, max(ts) AS last_seen,
  concat_ws(',', CASE WHEN max(rule_structuring_score) > 0 THEN 'structuring' END, CASE WHEN max(rule_rapid_movement_score) > 0 THEN 'rapid_movement' END, CASE WHEN max(rule_round_tripping_score) > 0 THEN 'round_tripping' END, CASE WHEN max(rule_velocity_score) > 0 THEN 'velocity' END) AS triggered_rules FROM ca GROUP BY 1)"""
SEV = "CASE WHEN ensemble_score >= 0.8e0 THEN 'HIGH' WHEN ensemble_score >= 0.6e0 THEN 'MEDIUM' ELSE 'LOW' END"
CLS = f"""{ENS}, {ENT_ALERT}, cl AS (SELECT *, {SEV} AS severity, upper(substr(sha256(entity_id || '|' || strftime(first_seen, '%Y-%m-%d %H:%M:%S') || '|' || strftime(last_seen, '%Y-%m-%d %H:%M:%S')), 1, 12)) AS alert_id, last_seen AS created_at FROM al),
  st AS (SELECT *, created_at + CASE severity WHEN 'HIGH' THEN INTERVAL 24 HOUR WHEN 'MEDIUM' THEN INTERVAL 72 HOUR ELSE INTERVAL 168 HOUR END AS sla_deadline, CASE ascii(alert_id) % 3 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'ESCALATED' ELSE 'OPEN' END AS status FROM cl)"""


def ensembled(spark, d, df=None):
    df = full_scores(spark, d, df)
    fake = df.select("transaction_id", ((F.col("transaction_id") * 7919 % 1000) / num(1000)).alias("ml_score"))  # a stand-in that SQL can state
    return al.ensemble(df, fake).withColumn("ensemble_score", F.round("ensemble_score", 9))


def entity_alerts(spark, d):
    return al.by_entity(al.candidates(ensembled(spark, d)))


def alert_table(spark, d):
    """Classified alerts, some of them followed up."""
    df = al.classify(entity_alerts(spark, d))
    follow = df.select("alert_id", F.when(F.ascii("alert_id") % 3 == 0, "CLOSED").when(F.ascii("alert_id") % 3 == 1, "ESCALATED").otherwise("nonsense").alias("status"), F.lit(None).cast("string").alias("disposition"), F.col("created_at").alias("at"))
    return al.update_status(df, follow)


@query("alert_ensemble", f"WITH {ENS} SELECT transaction_id, {R('ml_score', 'ensemble_score')} FROM en")
def _(spark, d):
    return ensembled(spark, d).select("transaction_id", "ml_score", "ensemble_score")


@query("alert_entity", f"WITH {ENS}, {ENT_ALERT} SELECT entity_id, {R('ensemble_score', 'mean_score', 'ml_score', 'total_amount', 'max_amount')}, transaction_count, triggered_rules FROM al")
def _(spark, d):
    return entity_alerts(spark, d).select("entity_id", "ensemble_score", "mean_score", "ml_score", "total_amount", "max_amount", "transaction_count", F.array_join("triggered_rules", ",").alias("triggered_rules"))


SIDES = "sd AS (SELECT from_id AS entity_id, to_id AS cp, * FROM e UNION ALL SELECT to_id, from_id, * FROM e WHERE from_id <> to_id)"


@query("alert_enrich", f"WITH {ENS}, {ENT_ALERT}, {SIDES} SELECT entity_id, count(DISTINCT cp) AS n_counterparties FROM sd SEMI JOIN al USING (entity_id) WHERE cp <> entity_id GROUP BY 1")
def _(spark, d):
    return al.counterparties(events(spark, d), entity_alerts(spark, d)).select("entity_id", "n_counterparties")


@query("alert_last_transactions", f"WITH {ENS}, {ENT_ALERT}, {SIDES}, rk AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, transaction_id DESC) AS k FROM sd SEMI JOIN al USING (entity_id)) SELECT entity_id, count(*) AS n, sum(transaction_id)::BIGINT AS ids FROM rk WHERE k <= 50 GROUP BY 1")
def _(spark, d):
    out = al.last_transactions(events(spark, d), entity_alerts(spark, d))
    return out.select("entity_id", F.size("transactions").cast("long").alias("n"), F.aggregate("transactions", F.lit(0).cast("long"), lambda a, t: a + t["transaction_id"]).alias("ids"))


DUP = "two AS (SELECT entity_id, ensemble_score, transaction_count, total_amount FROM al UNION ALL SELECT 'X', ensemble_score, transaction_count, total_amount FROM al)"


@query("alert_dedup", f"WITH {ENS}, {ENT_ALERT}, {DUP} SELECT entity_id, round(least(1e0, max(ensemble_score) + 0.3e0 * (sum(ensemble_score) - max(ensemble_score))), 6) AS ensemble_score, sum(transaction_count)::BIGINT AS transaction_count, round(sum(total_amount), 4) AS total_amount FROM two GROUP BY 1")
def _(spark, d):
    df = al.classify(entity_alerts(spark, d))
    both = df.unionByName(df.withColumn("entity_id", F.lit("X")))
    return al.deduplicate(both, "sum_score").select("entity_id", "ensemble_score", "transaction_count", F.round("total_amount", 4).alias("total_amount"))


@query("alert_severity", f"WITH {CLS} SELECT alert_id, entity_id, severity, status, epoch_us(sla_deadline) AS sla_deadline FROM st")
def _(spark, d):
    return alert_table(spark, d).select("alert_id", "entity_id", "severity", "status", F.unix_micros("sla_deadline").alias("sla_deadline"))


@query("alert_queue", f"WITH {CLS} SELECT alert_id, severity, round(ensemble_score, 6) AS ensemble_score FROM st WHERE status = 'OPEN' ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, ensemble_score DESC, entity_id LIMIT 20")
def _(spark, d):
    return al.queue(alert_table(spark, d), status="OPEN", limit=20).select("alert_id", "severity", "ensemble_score")


@query("alert_dashboard", f"WITH {CLS} SELECT alert_id, severity, status, round(ensemble_score, 6) AS ensemble_score FROM st WHERE severity IN ('MEDIUM', 'LOW') AND status IN ('OPEN', 'ESCALATED') AND ensemble_score >= 0.52e0")
def _(spark, d):
    return al.dashboard_queue(alert_table(spark, d), ["MEDIUM", "LOW"], ["OPEN", "ESCALATED"], 0.52).select("alert_id", "severity", "status", "ensemble_score")


_cnt = lambda c, v: f"count(*) FILTER ({c} = '{v}') AS {c}_{v.lower()}"


@query("alert_stats", f"WITH {CLS} SELECT count(*) AS total, {', '.join(_cnt('severity', v) for v in ('HIGH', 'MEDIUM', 'LOW'))}, {', '.join(_cnt('status', v) for v in al.STATUSES)}, round(avg(ensemble_score), 6) AS mean_score, round(stddev_pop(ensemble_score), 6) AS std_score, round(max(ensemble_score), 6) AS max_score, round(sum(total_amount), 4) AS total_amount FROM st")
def _(spark, d):
    return al.statistics(alert_table(spark, d)).withColumn("total_amount", F.round("total_amount", 4))


@query("alert_rule_counts", f"WITH {CLS} SELECT rule, count(*) AS n FROM (SELECT unnest(string_split(triggered_rules, ',')) AS rule FROM st WHERE triggered_rules <> '') GROUP BY 1")
def _(spark, d):
    return al.rule_counts(alert_table(spark, d))


@query("alert_daily", f"WITH {CLS} SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS n FROM st GROUP BY 1")
def _(spark, d):
    return al.daily_volume(alert_table(spark, d)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("alert_histogram", f"WITH {CLS} SELECT severity, least(30, floor(ensemble_score * 30) + 1)::BIGINT AS bin, count(*) AS n FROM st GROUP BY 1, 2")
def _(spark, d):
    return al.score_histogram(alert_table(spark, d))


# --- evaluation

SC = f"{SCORED}, sc AS (SELECT is_laundering AS label, round(0.6e0 * rule_composite_score + 0.4e0 * ({ML}), 4) AS score FROM scored)"
CURVE = f"{SC}, gp AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sc GROUP BY 1), cv AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM gp)"


def score_table(spark, d):
    s = num(0.6) * F.col("rule_composite_score") + num(0.4) * ((F.col("transaction_id") * 7919 % 1000) / num(1000))
    return scored(spark, d).select(F.col("is_laundering").alias("label"), F.round(s, 4).alias("score"))


@query("eval_roc_auc", f"WITH {CURVE} SELECT round(sum(neg * (tp + tp - pos) / 2e0) / (max(p) * max(n)), 6) AS roc_auc FROM cv")
def _(spark, d):
    return ev.ranking_metrics(score_table(spark, d)).select("roc_auc")


@query("eval_average_precision", f"WITH {CURVE} SELECT round(sum(pos * tp::DOUBLE / (tp + fp)) / max(p), 6) AS average_precision FROM cv")
def _(spark, d):
    return ev.ranking_metrics(score_table(spark, d)).select("average_precision")


_rec = lambda s: f"round(max(CASE WHEN fp - neg <= {s}e0 * n AND fp > {s}e0 * n THEN (tp - pos + pos * ({s}e0 * n - (fp - neg)) / neg) / p END), 6) AS recall_at_{round(s * 100)}_fpr"


@query("eval_recall_at_fpr", f"WITH {CURVE} SELECT {', '.join(_rec(s) for s in (0.01, 0.05, 0.1))} FROM cv")
def _(spark, d):
    return ev.ranking_metrics(score_table(spark, d)).drop("roc_auc", "average_precision")


_share = lambda a, b, n: f"round(CASE WHEN {b} > 0 THEN {a} / ({b})::DOUBLE ELSE 0 END, 6) AS {n}"
RATES = ", ".join((_share("tp", "tp + fp", "precision"), _share("tp", "tp + fn", "recall"), _share("2 * tp", "2 * tp + fp + fn", "f1"), _share("(tp + tn)", "tp + fp + fn + tn", "accuracy"), _share("tn", "tn + fp", "specificity"), _share("fp", "tn + fp", "fpr")))
CONF = "count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp, count(*) FILTER (score < t AND label = 1) AS fn, count(*) FILTER (score < t AND label = 0) AS tn"


@query("eval_confusion", f"WITH {SC}, k AS (SELECT {CONF} FROM (SELECT *, 0.3e0 AS t FROM sc)) SELECT *, {RATES} FROM k")
def _(spark, d):
    return ev.confusion(score_table(spark, d), 0.3)


_par = lambda w: f"round(arg_max(tp::DOUBLE / (tp + fp), score) FILTER (tp >= {w}e0 * p), 6) AS precision_at_{round(w * 100)}_recall"


@query("eval_precision_at_recall", f"WITH {CURVE} SELECT {', '.join(map(_par, (0.8, 0.9)))} FROM cv")
def _(spark, d):
    return ev.precision_at_recall(score_table(spark, d))


_cls = lambda n, hit, wrong, missed: f"SELECT '{n}' AS class, {hit} / nullif({hit} + {wrong}, 0)::DOUBLE AS p, {hit} / nullif({hit} + {missed}, 0)::DOUBLE AS r, 2 * {hit} / nullif(2 * {hit} + {wrong} + {missed}, 0)::DOUBLE AS f, {hit} + {missed} AS support FROM k"


@query("eval_class_report", f"""WITH {SC}, k AS (SELECT {CONF} FROM (SELECT *, 0.3e0 AS t FROM sc)), c AS ({_cls('legitimate', 'tn', 'fn', 'fp')} UNION ALL {_cls('laundering', 'tp', 'fp', 'fn')}),
  z AS (SELECT class, coalesce(p, 0) AS p, coalesce(r, 0) AS r, coalesce(f, 0) AS f, support FROM c), a AS (SELECT * FROM z UNION ALL SELECT 'macro', avg(p), avg(r), avg(f), sum(support)::BIGINT FROM z UNION ALL SELECT 'weighted', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support)::BIGINT FROM z)
  SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support::BIGINT AS support FROM a""")
def _(spark, d):
    return ev.class_report(score_table(spark, d), 0.3)


@query("eval_threshold", f"""WITH {SC}, th AS (SELECT i, 0.01e0 + i * (0.98e0 / 99) AS t FROM range(100) x(i)), k AS (SELECT i, t, {CONF} FROM sc, th GROUP BY 1, 2), r AS (SELECT round(t, 6) AS threshold, i, tp, fp, fn, tn, {RATES} FROM k)
  SELECT * EXCLUDE (i) FROM r ORDER BY recall >= 0.8e0 DESC, CASE WHEN recall >= 0.8e0 THEN f1 ELSE recall END DESC, i LIMIT 1""")
def _(spark, d):
    return ev.best_threshold(score_table(spark, d), 0.8)


@query("eval_rules", f"WITH {SCORED}, l AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, {'rule_' + r + '_score' if r in dict(_RULE_NAMES) else '0e0'} AS s, is_laundering AS y FROM scored" for r in ru.RULES) + """), k AS (SELECT rule, count(*) FILTER (s > 0) AS n_hits, avg((s > 0)::INTEGER) AS hr, coalesce(avg(s) FILTER (s > 0), 0) AS mw, count(*) FILTER (s > 0 AND y = 1) AS tp, sum(y) AS p FROM l GROUP BY 1)
  SELECT rule, n_hits, round(hr, 6) AS hit_rate, round(mw, 6) AS mean_when_hit, round(CASE WHEN n_hits > 0 THEN tp / n_hits::DOUBLE ELSE 0 END, 6) AS precision, round(tp / p::DOUBLE, 6) AS recall, round(2 * tp / (n_hits + p)::DOUBLE, 6) AS f1 FROM k""")
def _(spark, d):
    return ev.rule_report(full_scores(spark, d))


_col = lambda r: f"rule_{r}_score > 0" if r in dict(_RULE_NAMES) else "false"


@query("eval_rule_overlap", f"WITH {SCORED}, k AS (" + " UNION ALL ".join(f"SELECT '{a}' AS rule_a, '{b}' AS rule_b, count(*) FILTER ({_col(a)} AND {_col(b)}) AS both_, count(*) FILTER ({_col(a)} OR {_col(b)}) AS n FROM scored" for i, a in enumerate(ru.RULES) for b in ru.RULES[i + 1 :]) + ") SELECT rule_a, rule_b, both_ AS both, round(CASE WHEN n > 0 THEN both_ / n::DOUBLE ELSE 0 END, 6) AS jaccard FROM k")
def _(spark, d):
    return ev.rule_overlap(full_scores(spark, d))


@query("eval_trigger_histogram", f"WITH {SCORED} SELECT rule_trigger_count, count(*) AS n FROM scored GROUP BY 1")
def _(spark, d):
    return ev.trigger_histogram(scored(spark, d))


SYS = f"""{SCORED}, x AS (SELECT is_laundering AS y, round(rule_composite_score, 4) AS r, {ML} AS m FROM scored), z AS (SELECT *, round((0.30e0 * r + 0.45e0 * m) / (SELECT max(0.30e0 * r + 0.45e0 * m) FROM x), 9) AS h FROM x),
  l AS (SELECT 'rules' AS system, round(r, 9) AS score, 0.3e0 AS t, y AS label FROM z UNION ALL SELECT 'ml', round(m, 9), 0.5e0, y FROM z UNION ALL SELECT 'hybrid', h, 0.5e0, y FROM z),
  gp AS (SELECT system, score, sum(label) AS pos, sum(1 - label) AS neg FROM l GROUP BY 1, 2), cv AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY system) AS p, sum(neg) OVER (PARTITION BY system) AS n FROM gp WINDOW w AS (PARTITION BY system ORDER BY score DESC)),
  a AS (SELECT system, sum(neg * (tp + tp - pos) / 2e0) / (max(p) * max(n)) AS roc_auc, sum(pos * tp::DOUBLE / (tp + fp)) / max(p) AS ap FROM cv GROUP BY 1)"""


@query("eval_systems", f"WITH {SYS} SELECT system, round(roc_auc, 6) AS roc_auc, round(ap, 6) AS average_precision, round(ap - (SELECT ap FROM a WHERE system = 'rules'), 6) AS lift, system = (SELECT system FROM a ORDER BY ap DESC, system LIMIT 1) AS is_best FROM a")
def _(spark, d):
    df = scored(spark, d).select("is_laundering", F.round("rule_composite_score", 4).alias("rule_composite_score"), ((F.col("transaction_id") * 7919 % 1000) / num(1000)).alias("ml_score"))
    return ev.compare_systems(df).select("system", "roc_auc", "average_precision", "lift", "is_best")


@query("eval_alerts", f"""WITH {CLS}, tr AS (SELECT DISTINCT from_id AS entity_id FROM e WHERE is_laundering = 1 AND amount > 15000), k AS (SELECT count(*) FILTER (a.entity_id IS NOT NULL AND t.entity_id IS NOT NULL) AS tp, count(*) FILTER (t.entity_id IS NULL) AS fp, count(*) FILTER (a.entity_id IS NULL) AS fn FROM st a FULL JOIN tr t ON a.entity_id = t.entity_id)
  SELECT (SELECT count(*) FROM st) AS total, (SELECT count(*) FROM st WHERE status = 'OPEN' AND sla_deadline < TIMESTAMP '{AS_OF}') AS sla_breached, tp, fp, fn, {_share('tp', 'tp + fp', 'precision')}, {_share('tp', 'tp + fn', 'recall')} FROM k""")
def _(spark, d):
    truth = events(spark, d).where("is_laundering = 1 and amount > 15000").select(F.col("from_id").alias("entity_id"))
    return ev.alert_report(alert_table(spark, d), truth, F.lit(AS_OF).cast("timestamp")).select("total", "sla_breached", "tp", "fp", "fn", "precision", "recall")


# --- models


def _matrix(spark, d):
    """The features with their label, written once: training, each model's validation and the result all read it."""
    rows = events(spark, d)
    return cut(fe.transaction(rows).join(fe.risk(rows), "transaction_id").join(rows.select("transaction_id", F.col("is_laundering").alias("label")), "transaction_id"))


@query("ml_scores")
def _(spark, d):
    rows = _matrix(spark, d)
    part = F.pmod(F.xxhash64("transaction_id"), F.lit(5))
    trained = ml.train(rows.where(part > 1), rows.where(part == 1))
    return trained.predict(rows.drop("label"))


@query("ml_explain")
def _(spark, d):
    """The five features that move each transaction's score most, by Shapley values of the trees."""
    rows = _matrix(spark, d)
    part = F.pmod(F.xxhash64("transaction_id"), F.lit(5))
    trained = ml.train(rows.where(part > 1), rows.where(part == 1))
    return trained.explain(rows.drop("label"), top=5)


@query("cv_folds", f"WITH {E} SELECT label, fold, count(*) AS n FROM (SELECT is_laundering AS label, ((row_number() OVER (PARTITION BY is_laundering ORDER BY transaction_id) - 1) % 5)::INTEGER AS fold FROM e) GROUP BY 1, 2")
def _(spark, d):
    df = events(spark, d).select("transaction_id", F.col("is_laundering").alias("label"))
    return ml.folds(df).groupBy("label", "fold").agg(F.count("*").alias("n"))


# --- triage and reports

TEXTS = "cv AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)"


INNER = "regexp_extract(response, '(\\{[\\s\\S]*\\})', 1)"


@query("triage_parse", f"""WITH {TEXTS}, w AS (SELECT conv_id, turn, text, 'no json ' || text AS response FROM cv), p AS (SELECT *, turn % 3 = 2 AND NOT ({INNER} <> '' AND json_valid({INNER})) AS bad FROM w)
  SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 THEN text WHEN bad THEN substr(response, 1, 500) ELSE coalesce(json_extract_string({INNER}, '$.narrative_summary'), 'No summary available') END AS narrative_summary,
  CASE WHEN turn % 3 = 0 THEN 'CLOSE' ELSE 'CONTINUE_MONITORING' END AS recommended_disposition, bad AS parse_error FROM p""")
def _(spark, d):
    """Whole texts: plain in one turn of three, as the summary in JSON in the others."""
    said = F.coalesce("text", F.lit(""))
    body = F.to_json(F.struct(said.alias("narrative_summary"), F.when(F.col("turn") % 3 == 0, "close").otherwise("odd").alias("recommended_disposition")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.concat(F.lit("no json "), said)).otherwise(F.concat(F.lit("Result: "), body, F.lit(" end"))).alias("response"))
    return tr.validate(tr.parse(rows)).select("conv_id", "turn", "narrative_summary", "recommended_disposition", "parse_error")


@query("triage_verify", f"""WITH {E}, k AS (SELECT transaction_id, amount FROM e) SELECT transaction_id, 3 AS total_facts, CASE WHEN transaction_id % 2 = 0 THEN 2 ELSE 1 END + CASE WHEN abs(amount - 1000000) < 1 THEN 1 ELSE 0 END AS verified_facts, round(CASE WHEN transaction_id % 2 = 0 THEN 2 ELSE 1 END / 3e0, 3) AS verification_score, false AS verified FROM k""")
def _(spark, d):
    rows = events(spark, d)
    t = F.array(F.struct("amount", F.lit("BANK_001_1").alias("from_id"), F.lit("BANK_002_2").alias("to_id"), "timestamp", "payment_format", "is_laundering"))
    said = F.concat(F.lit("Sent $"), F.format_number("amount", 2), F.lit(" and $1,000,000.00 from "), F.when(F.col("transaction_id") % 2 == 0, "BANK_001_1").otherwise("BANK_009_9"))
    df = rows.select("transaction_id", t.alias("transactions"), said.alias("narrative_summary"), F.lit("HIGH").alias("confidence_level"), F.lit("because").alias("disposition_rationale"))
    return tr.verify(df).select("transaction_id", "total_facts", "verified_facts", "verification_score", "verified")


def full_alerts(spark, d):
    df = scored(spark, d)
    return al.generate(full_scores(spark, d, df), ensembled(spark, d, df).select("transaction_id", "ml_score"))


@query("triage_alerts")
def _(spark, d):
    return tr.triage(tr.chosen(full_alerts(spark, d), 50))


OVER = ", ".join(f"count(*) FILTER (age > {h}) AS over_{h}h" for h in (24, 72, 168))


@query("report_aging", f"WITH {CLS}, g AS (SELECT (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 3.6e9 AS age FROM st WHERE status = 'OPEN') SELECT count(*) AS open_alerts, round(avg(age), 6) AS mean_hours, round(quantile_cont(age, 0.5), 6) AS median_hours, round(max(age), 6) AS max_hours, {OVER} FROM g")
def _(spark, d):
    return rp.ageing(alert_table(spark, d), F.lit(AS_OF).cast("timestamp"))


_late = lambda v: f"count(*) FILTER (status = 'OPEN' AND sla_deadline < TIMESTAMP '{AS_OF}' AND severity = '{v}') AS {v.lower()}_breached"
_pct = lambda v: f"round(count(*) FILTER (status = '{v}') / count(*)::DOUBLE * 100, 6) AS {v.lower()}_rate_pct"


@query("report_sla", f"WITH {CLS} SELECT {', '.join(map(_late, ('HIGH', 'MEDIUM', 'LOW')))}, count(*) AS total, {_pct('CLOSED')}, {_pct('ESCALATED')} FROM st")
def _(spark, d):
    return rp.sla(alert_table(spark, d), F.lit(AS_OF).cast("timestamp"))


@query("report_statistics", f"WITH {CLS} SELECT count(*) AS total, round(avg(ensemble_score), 6) AS mean, round(quantile_cont(ensemble_score, 0.5), 6) AS median, round(stddev_pop(ensemble_score), 6) AS std, round(quantile_cont(ensemble_score, 0.9), 6) AS p90, round(quantile_cont(ensemble_score, 0.95), 6) AS p95 FROM st")
def _(spark, d):
    return rp.alert_statistics(alert_table(spark, d), F.lit(AS_OF).cast("timestamp")).select("total", "mean", "median", "std", "p90", "p95")


@query("report_top_entities", f"WITH {CLS} SELECT entity_id, count(*) AS alert_count FROM st GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, d):
    return rp.top_entities(alert_table(spark, d))


@query("sar_fields", f"""WITH {ENS}, {ENT_ALERT}, {SIDES}, rk AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, transaction_id DESC) AS k FROM sd SEMI JOIN al USING (entity_id))
  SELECT entity_id, count(*)::INTEGER AS n_transactions, round(sum(amount), 4) AS sum_amount, count(DISTINCT CASE WHEN cp <> entity_id THEN cp END)::INTEGER AS n_others, string_agg(DISTINCT payment_format, ',' ORDER BY payment_format) AS formats FROM rk WHERE k <= 50 GROUP BY 1""")
def _(spark, d):
    return rp.sar_fields(full_alerts(spark, d)).select("entity_id", "n_transactions", F.round("sum_amount", 4).alias("sum_amount"), "n_others", F.array_join("formats", ",").alias("formats"))


@query("sar_narratives")
def _(spark, d):
    return rp.sar_narrative(full_alerts(spark, d), generated=F.lit(AS_OF).cast("timestamp"))


@query("dormant_stream", """WITH g AS (SELECT o_orderkey AS transaction_id, 'C' || o_custkey AS from_id, datediff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate)::DOUBLE AS gap_days, o_totalprice AS amount FROM orders)
  SELECT transaction_id, from_id, gap_days, round(amount, 6) AS amount FROM g WHERE gap_days >= 90 AND amount >= 5000""")
def _(spark, d):
    """The stream's dormant rule over the orders ledger, read as a stream and run to its end."""
    from ..streaming import velocity

    schema = table(spark, d, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    rows = stream.select(F.col("o_orderkey").alias("transaction_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.concat(F.lit("C"), "o_custkey").alias("from_id"), F.col("o_totalprice").alias("amount"))
    found, path = velocity.dormant(rows), f"{shared_path(spark)}/dormant-{uuid.uuid4().hex}"  # the memory sink would hold all rows in the driver
    run = found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
