import pytest

from txrisk.operators import quality as QA

COLS = ["transaction_id", "customer_id", "timestamp", "amount", "merchant_category", "location", "device_type"]
SCHEMA = ", ".join(f"{c} string" for c in COLS)


def _df(spark, rows, cols=COLS):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))


def _good(i):
    return (f"TXN{i:04d}", "CUST1", "2026-06-26 22:40:37", "200.0", "cash_withdrawal", "Chicago, US", "atm")


def test_empty_input(spark):
    with pytest.raises(QA.ValidationError, match="empty_input|empty"):
        QA.validate_transactions(_df(spark, []))


def test_missing_column(spark):
    cols = [c for c in COLS if c != "amount"]
    df = spark.createDataFrame([tuple(v for c, v in zip(COLS, _good(1)) if c != "amount")],
                               ", ".join(f"{c} string" for c in cols))
    with pytest.raises(QA.ValidationError, match=r"\['amount'\]"):
        QA.validate_transactions(df)


def test_bad_type_reports_amount_first(spark):
    rows = [_good(1), ("TXN0002", "CUST1", "not a date", "abc", "pos", "Chicago, US", "pos")]
    with pytest.raises(QA.ValidationError, match="non_numeric_amount"):
        QA.validate_transactions(_df(spark, rows))


def test_invalid_value_names_transaction(spark):
    rows = [_good(1), ("TXN9998", "CUST1", "2026-06-26 22:40:37", "-50.0", "pos", "Chicago, US", "pos")]
    with pytest.raises(QA.ValidationError, match="TXN9998"):
        QA.validate_transactions(_df(spark, rows))


def test_null_key_reports_first_rows(spark):
    rows = [_good(i) for i in range(3)] + [(f"TXN9{i}", None, "2026-06-26 22:40:37", "1", "a", "b", "c")
                                           for i in range(7)]
    rep = {(r.check_no, r.column_name): r for r in QA.dq_report(_df(spark, rows)).collect()}
    r = rep[(3, "customer_id")]
    assert r.n_bad == 7 and r.first_rows == "TXN90,TXN91,TXN92,TXN93,TXN94"
    with pytest.raises(QA.ValidationError, match="customer_id"):
        QA.validate_transactions(_df(spark, rows))


def test_valid_passes(spark):
    QA.validate_transactions(_df(spark, [_good(i) for i in range(20)]))
    assert all(r.passed for r in QA.dq_report(_df(spark, [_good(i) for i in range(20)])).collect())


def test_rows_without_an_id_are_named_by_position(spark):
    rows = [(*_good(1), 0), (None, *_good(2)[1:], 1), (*_good(3), 2), (None, *_good(4)[1:], 3)]
    df = spark.createDataFrame(rows, SCHEMA + ", pos long")
    with pytest.raises(QA.ValidationError, match="first rows: row 1,row 3"):
        QA.validate_transactions(df, order_col="pos")


def test_quoted_line_ends(spark, tmp_path):
    from txrisk.sources import io as IO
    p = tmp_path / "t.csv"
    p.write_text("transaction_id,location\n1,\"Paris,\nFR\"\n2,Oslo\n")
    assert [tuple(r) for r in IO.scan_transactions(spark, str(p), multi_line=True).collect()] == [("1", "Paris,\nFR"), ("2", "Oslo")]
