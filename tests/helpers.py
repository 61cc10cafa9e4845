"""Small ledgers for tests."""

from datetime import datetime, timedelta

START = datetime(2024, 1, 1, 10)
SCHEMA = (
    "transaction_id long, timestamp timestamp, from_id string, to_id string, amount double, from_bank string, to_bank string, "
    "is_cross_currency int, payment_format string, payment_format_normalized string, is_laundering int"
)


def ledger(spark, rows):
    """rows: (from, to, amount, minutes after the start[, bank of sender, bank of receiver])."""
    full = []
    for i, r in enumerate(rows):
        s, d, a, m, *banks = r
        fb, tb = banks or ("BANK_001", "BANK_002")
        full.append((i, START + timedelta(minutes=m), s, d, float(a), fb, tb, 0, "Wire", "wire", 0))
    return spark.createDataFrame(full, SCHEMA)


def by_id(df, column):
    return [r[column] for r in df.orderBy("transaction_id").collect()]
