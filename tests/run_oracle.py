"""Run every registered query against its oracle: python tests/run_oracle.py [sf_dir] [name ...]"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle import compare, duck  # noqa: E402
from txrisk.session import get_spark  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = get_spark("local[8]", shuffle_partitions=8, driver_memory="8g")
q, o = E.queries(), E.oracle_sql()
con = duck(sf)
bad = 0
for name, fn in q.items():
    if names and name not in names:
        continue
    t = time.time()
    if name not in o:
        try:
            n = fn(spark, sf).count()
            print(json.dumps({"query": name, "rows_only": n, "sec": round(time.time() - t, 2)}))
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(json.dumps({"query": name, "error": str(e)[:400]}))
        continue
    try:
        r = compare(spark, name, fn, o[name], sf, con, digits=int(os.environ.get("ORACLE_DIGITS", "9")))
    except Exception as e:  # noqa: BLE001
        r = {"query": name, "match": False, "error": str(e)[:600]}
    r["sec"] = round(time.time() - t, 2)
    bad += 0 if r.get("match") else 1
    print(json.dumps(r, default=str))
print("FAILED", bad)
