import pytest

from sparkwarden.sources import ledger, sinks

HEAD = ",".join(("Timestamp", "From Bank", "Account", "To Bank", "Account", "Amount Received", "Receiving Currency", "Amount Paid", "Payment Currency", "Payment Format", "Is Laundering"))
ROWS = [
    "2024/01/02 10:00,010,A1,020,B1,100.5,us dollar,100.5,US Dollar,Wire,0",
    "2024/01/01 09:00,010, A1 ,020,B1,oops,Euro,7,US Dollar,Bitcoin,1",
    "nonsense,010,A1,020,B1,1,Euro,1,Euro,Cash,0",
]


def test_read_and_clean(spark, tmp_path):
    path = tmp_path / "HI-Small_Trans.csv"
    path.write_text("\n".join([HEAD, *ROWS]))
    df = ledger.load(spark, str(tmp_path))
    a, b = df.orderBy("transaction_id").collect()
    assert (a["transaction_id"], b["transaction_id"]) == (0, 1)
    assert a["from_id"] == "010_A1" and a["amount"] == 7 and a["amount_received"] == 0 and a["payment_format_normalized"] == "other" and a["is_cross_currency"] == 1 and a["day_of_week"] == 0
    assert b["is_cross_currency"] == 0 and b["payment_format_normalized"] == "wire" and b["hour"] == 10
    assert ledger.load(spark, str(tmp_path), limit=1).count() == 1


def test_load_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        ledger.load(spark, str(tmp_path), "huge")
    with pytest.raises(FileNotFoundError):
        ledger.load(spark, str(tmp_path))
    with pytest.raises(ValueError):
        ledger.validate(spark.range(1))


def test_synthetic(spark):
    df = ledger.synthetic(spark, 1000).cache()
    ids = sorted(r[0] for r in df.select("transaction_id").collect())
    assert ids == list(range(1000)) and df.where("is_laundering = 1").count() == 10 and df.where("from_id = to_id").count() == 0
    train, test = ledger.time_split(df)
    assert (train.count(), test.count()) == (800, 200)
    assert train.agg({"timestamp": "max"}).first()[0] <= test.agg({"timestamp": "min"}).first()[0]
    empty = ledger.with_split(df.limit(0))
    assert empty.count() == 0


def test_summary_keeps_times_null(spark):
    df = spark.createDataFrame([(0, "2024-01-01", "A", "B", 5.0, 1)], "transaction_id long, timestamp string, from_id string, to_id string, amount double, is_laundering int").withColumn("timestamp", __import__("pyspark").sql.functions.to_timestamp("timestamp"))
    rows = {r["account_id"]: r for r in ledger.account_summary(df).collect()}
    assert rows["B"]["out_first"] is None and rows["B"]["net_flow"] == 5 and rows["A"]["net_flow"] == -5 and rows["A"]["has_laundering"] == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("auc", 0.5)], "metric string, value double")
    sinks.export_evaluation(df, str(tmp_path / "e.json"))
    sinks.export_evaluation(df, str(tmp_path / "e.csv"), "csv")
    with pytest.raises(ValueError):
        sinks.export_evaluation(df, str(tmp_path / "x"), "xml")
    sinks.log_metrics(df, str(tmp_path / "log"), "r1")
    sinks.log_metrics(df, str(tmp_path / "log"), "r2")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    sinks.save_stage({"a": 1, "b": object()}, str(tmp_path), "plain", spark)
    assert spark.read.text(str(tmp_path / "plain")).first()[0] == '{"a": 1}'
    sinks.save_stage(df, str(tmp_path), "table", spark)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1
