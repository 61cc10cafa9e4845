"""Transaction ledgers: reading, validating and cleaning raw files, a synthetic sample, time splits and profiles."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.numbering import numbered
from ..operators.quantiles import quantiles

# Raw columns in file order, the timestamp format and the payment formats' short names.
RAW_COLUMNS = ("Timestamp", "From Bank", "Account", "To Bank", "Account.1", "Amount Received", "Receiving Currency", "Amount Paid", "Payment Currency", "Payment Format", "Is Laundering")
NAMES = dict(zip(RAW_COLUMNS, ("timestamp", "from_bank", "from_account", "to_bank", "to_account", "amount_received", "receiving_currency", "amount_paid", "payment_currency", "payment_format", "is_laundering")))
TIME_FORMAT = "yyyy/MM/dd HH:mm"
FORMATS = {"Cheque": "check", "ACH": "ach", "Wire": "wire", "Credit Card": "credit_card", "Cash": "cash", "Reinvestment": "reinvestment"}
VARIANTS = {"small": "HI-Small_Trans.csv", "medium": "HI-Medium_Trans.csv", "large": "HI-Large_Trans.csv"}


def read_raw(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A ledger file, every column as text and by position: the two account columns share a name in the header."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return df.limit(limit) if limit is not None else df


def load(spark: SparkSession, folder: str, variant: str = "small", limit: int | None = None) -> DataFrame:
    """The cleaned ledger of a variant. ValueError: no such variant; FileNotFoundError: its file is missing."""
    if variant not in VARIANTS:
        raise ValueError(f"variant {variant!r} is none of {', '.join(VARIANTS)}")
    path = f"{folder}/{VARIANTS[variant]}"
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    return clean(read_raw(spark, path, limit))


def validate(df: DataFrame) -> None:
    if missing := sorted(set(RAW_COLUMNS) - set(df.columns)):
        raise ValueError(f"columns missing: {', '.join(missing)}")


def clean(raw: DataFrame) -> DataFrame:
    """Canonical transactions of a raw ledger; rows whose timestamp cannot be read are dropped."""
    validate(raw)
    df = raw.select(*[F.col(f"`{old}`").alias(new) for old, new in NAMES.items()])
    text = lambda c: F.trim(F.col(c).cast("string"))
    amount = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    short = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    df = df.withColumns(
        {
            "timestamp": F.try_to_timestamp("timestamp", F.lit(TIME_FORMAT)),
            **{c: text(c) for c in ("from_bank", "from_account", "to_bank", "to_account")},
            "amount_paid": amount("amount_paid"),
            "amount_received": amount("amount_received"),
            "payment_currency": F.upper(text("payment_currency")),
            "receiving_currency": F.upper(text("receiving_currency")),
            "payment_format": text("payment_format"),
            "is_laundering": F.coalesce(F.col("is_laundering").try_cast("int"), F.lit(0)),
        }
    ).where("timestamp is not null")
    df = df.withColumns(
        {
            "from_id": F.concat_ws("_", "from_bank", "from_account"),
            "to_id": F.concat_ws("_", "to_bank", "to_account"),
            "amount": F.greatest("amount_paid", "amount_received"),
            "is_cross_currency": (F.col("payment_currency") != F.col("receiving_currency")).cast("int"),
            "payment_format_normalized": F.coalesce(F.element_at(short, F.col("payment_format")), F.lit("other")),
        }
    )
    return number(calendar(df))


def calendar(df: DataFrame) -> DataFrame:
    return df.withColumns({"date": F.to_date("timestamp"), "hour": F.hour("timestamp"), "day_of_week": F.weekday("timestamp")})


def number(df: DataFrame, tie: tuple[str, ...] = ("from_id", "to_id", "amount")) -> DataFrame:
    """transaction_id 0, 1, ... in order of time, then of ``tie``, by ranges of rows however many share a day or a time."""
    return numbered(df.drop("transaction_id"), ["timestamp", *tie], "transaction_id")


def time_split(df: DataFrame, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The first rows by (timestamp, transaction_id), and the rest, which are ``test_share`` of all."""
    marked = with_split(df, test_share)
    return marked.where("is_train").drop("is_train"), marked.where("not is_train").drop("is_train")


def with_split(df: DataFrame, test_share: float = 0.2) -> DataFrame:
    """Adds is_train. Counts by timestamp find the cut; only rows that share its timestamp are ranked."""
    counts = df.groupBy("timestamp").agg(F.count("*").alias("n"))
    day = counts.groupBy(F.to_date("timestamp").alias("day")).agg(F.sum("n").alias("n"))
    before_day = day.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = counts.withColumn("day", F.to_date("timestamp")).withColumn("in_day", F.sum("n").over(Window.partitionBy("day").orderBy("timestamp")))
    bounds = within.join(before_day.select("day", "base"), "day").select("timestamp", (F.col("base") + F.col("in_day") - F.col("n")).alias("before"), "n")
    total = df.agg(F.count("*").alias("total"))
    cut = bounds.crossJoin(F.broadcast(total)).withColumn("keep", F.floor(F.col("total") * F.lit(1 - test_share)))
    whole = F.col("before") + F.col("n") <= F.col("keep")
    none = F.col("before") >= F.col("keep")
    edge = cut.where(~whole & ~none).select("timestamp", (F.col("keep") - F.col("before")).alias("some"))  # one row
    last = cut.where(whole).agg(F.max("timestamp").alias("last"))
    ranked = df.join(F.broadcast(edge), "timestamp", "left")
    tied = ranked.where("some is not null").withColumn("rank", F.row_number().over(Window.partitionBy("timestamp").orderBy("transaction_id"))).select("transaction_id", (F.col("rank") <= F.col("some")).alias("first"))
    out = ranked.crossJoin(F.broadcast(last)).join(tied, "transaction_id", "left")
    return out.withColumn("is_train", F.coalesce("first", F.coalesce(F.col("timestamp") <= F.col("last"), F.lit(False)))).drop("some", "last", "first")


def synthetic(spark: SparkSession, n: int = 10_000, seed: int = 42) -> DataFrame:
    """A ledger for trials: lognormal amounts, 20 banks, an hour a step over a year, 0.2 % (10 at least) labelled, a third of those just below 10 000."""
    accounts = max(100, n // 50)
    pick = lambda salt, most: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(most))
    df = spark.range(n).withColumns({"a": pick(1, accounts), "b": pick(2, accounts - 1), "h": pick(3, 365 * 24)})
    df = df.withColumn("b", F.when(F.col("b") >= F.col("a"), F.col("b") + 1).otherwise(F.col("b")))
    labelled = df.select("id").orderBy(F.xxhash64("id", F.lit(seed), F.lit(4))).limit(max(10, n // 500)).withColumn("is_laundering", F.lit(1))
    df = df.join(F.broadcast(labelled), "id", "left").withColumn("is_laundering", F.coalesce("is_laundering", F.lit(0)))
    bank = lambda c: F.format_string("BANK_%03d", F.pmod(F.col(c), F.lit(20)).cast("int"))
    low = (F.col("is_laundering") == 1) & (pick(5, 3) == 0)
    amount = F.when(low, 8_000 + 1_999 * F.rand(seed)).otherwise(F.exp(7 + 2 * F.randn(seed)))
    df = df.select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("h").cast("int"))).alias("timestamp"),
        bank("a").alias("from_bank"), F.col("a").cast("string").alias("from_account"), bank("b").alias("to_bank"), F.col("b").cast("string").alias("to_account"),
        F.round(amount, 2).alias("amount"), F.element_at(F.array(*map(F.lit, FORMATS)), (pick(6, len(FORMATS)) + 1).cast("int")).alias("payment_format"), "is_laundering",
    )
    short = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    df = df.withColumns(
        {
            "from_id": F.concat_ws("_", "from_bank", "from_account"), "to_id": F.concat_ws("_", "to_bank", "to_account"),
            "amount_paid": F.col("amount"), "amount_received": F.col("amount"), "payment_currency": F.lit("USD"), "receiving_currency": F.lit("USD"),
            "is_cross_currency": F.lit(0), "payment_format_normalized": F.element_at(short, F.col("payment_format")),
        }
    )
    return number(calendar(df))


def account_summary(df: DataFrame) -> DataFrame:
    """One row for each account that sends or receives; times of the missing side stay null."""

    def side(key: str, other: str, p: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("account_id")).agg(
            F.count("*").alias(f"{p}_count"), F.sum("amount").alias(f"{p}_total"), F.avg("amount").alias(f"{p}_mean"), F.max("amount").alias(f"{p}_max"),
            F.sum("is_laundering").alias(f"{p}_laundering"), F.count_distinct(other).alias(f"{p}_counterparties"), F.min("timestamp").alias(f"{p}_first"), F.max("timestamp").alias(f"{p}_last"),
        )

    both = side("from_id", "to_id", "out").join(side("to_id", "from_id", "in"), "account_id", "full_outer")
    both = both.na.fill(0, [c for c in both.columns if c.startswith(("out_", "in_")) and not c.endswith(("_first", "_last"))])
    return both.withColumns(
        {"total_count": F.col("out_count") + F.col("in_count"), "net_flow": F.col("in_total") - F.col("out_total"), "has_laundering": (F.col("out_laundering") + F.col("in_laundering") > 0).cast("int")}
    )


def profile_amounts(df: DataFrame) -> DataFrame:
    marks = quantiles(df, "amount", {"median": 0.5} | {f"p{p}": p / 100 for p in (10, 25, 75, 90, 95, 99)})  # one row
    return df.agg(
        F.count("*").alias("n"), F.sum("is_laundering").alias("n_laundering"), F.avg("is_laundering").alias("rate"), F.datediff(F.max("timestamp"), F.min("timestamp")).alias("span_days"),
        F.count_distinct("from_id").alias("senders"), F.count_distinct("to_id").alias("receivers"), F.avg("amount").alias("mean"), F.stddev_samp("amount").alias("std"),
        F.min("amount").alias("min"), F.max("amount").alias("max"),
    ).crossJoin(F.broadcast(marks))


def distinct_accounts(df: DataFrame) -> DataFrame:
    return df.select("from_id").union(df.select("to_id")).distinct().agg(F.count("*").alias("accounts"))


def profile_formats(df: DataFrame, column: str = "payment_format", top: int = 20) -> DataFrame:
    """The most frequent values with their labels' sum and mean."""
    return df.groupBy(column).agg(F.count("*").alias("n"), F.sum("is_laundering").alias("n_laundering"), F.avg("is_laundering").alias("rate")).orderBy(F.desc("n"), column).limit(top)


def profile_daily(df: DataFrame) -> DataFrame:
    days = df.groupBy(F.to_date("timestamp").alias("date")).agg(F.count("*").alias("n"))
    return days.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.max("n").alias("max"), F.count("*").alias("days"))


def events_ledger(events: DataFrame) -> DataFrame:
    """Events read as transactions between users and the keys in their props."""
    return events.select(
        F.col("event_id").alias("transaction_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.concat(F.lit("A"), "user_id").alias("from_id"),
        F.concat(F.lit("A"), F.get_json_object("props", "$.k")).alias("to_id"), F.round(F.col("value") * 100, 2).alias("amount"), F.col("event_type").alias("payment_format"),
        (F.col("event_type") == "error").cast("int").alias("is_laundering"),
    )


# A two-letter code for each nation key of the test tables.
NATION_CODES = ("AF", "DE", "FR", "IR", "US", "GB", "KP", "CA", "JP", "MM", "AU", "SY", "BR", "YE", "IN", "PA", "IT", "ES", "PK", "SE", "VN", "NO", "UG", "FI", "PH")


def orders_ledger(orders: DataFrame, lineitem: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Orders read as transactions between a customer and the order's least supplier; banks are named by nation."""
    seller = lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"))
    code = lambda c: F.element_at(F.array(*map(F.lit, NATION_CODES)), F.col(c) + 1)
    df = orders.join(seller, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("s") == F.col("s_suppkey"))
    return df.select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.concat(F.lit("C"), "o_custkey").alias("from_id"), F.concat(F.lit("S"), "s").alias("to_id"),
        code("c_nationkey").alias("from_bank"), code("s_nationkey").alias("to_bank"), (F.col("c_nationkey") != F.col("s_nationkey")).cast("int").alias("is_cross_currency"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("payment_format"), F.lit(0).alias("is_laundering"),
    )
