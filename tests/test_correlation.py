"""Correlations cover every level of the data, not those of the generated tables only."""
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import duck

from txrisk.plans import catalog  # noqa: F401
from txrisk.plans.registry import QUERIES
from txrisk.sources import adapter as A


def test_levels_come_from_the_data(spark, sf_small, tmp_path):
    for f in os.listdir(sf_small):
        if f != "events.parquet":
            os.symlink(f"{sf_small}/{f}", tmp_path / f)
    events = pq.read_table(f"{sf_small}/events.parquet")
    new = ["re.fund x" if i % 11 == 0 else "VIEW" if i % 13 == 0 else v for i, v in enumerate(events["event_type"].to_pylist())]
    pq.write_table(events.set_column(events.schema.get_field_index("event_type"), "event_type", pa.array(new)), tmp_path / "events.parquet")
    got = QUERIES["correlation_matrix"](spark, str(tmp_path)).collect()
    t = duck(str(tmp_path)).execute(A.TRANSACTIONS_SQL).df()
    wide = t[["amount", "is_anomaly"]].astype(float)
    for c in ("merchant_category", "device_type"):
        for v in t[c].dropna().unique():
            wide[f"{c}_{v}"] = (t[c] == v).astype(float)
    want = wide.corr()
    assert {"merchant_category_re.fund x", "merchant_category_VIEW", "merchant_category_view"} <= set(want)
    assert len(got) == len(want) ** 2
    assert all(r["corr"] == pytest.approx(want.loc[r.col_a, r.col_b], abs=1e-8) for r in got)
