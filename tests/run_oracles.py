"""Run every registered query against its oracle (like the driver's gate)."""
import json
import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from oracle import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from quillstat.session import get_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = sys.argv[2:] 
spark = get_session("local[8]", 8)
con = duck(sf)
qs, os_ = E.queries(), E.oracle_sql()
res = {}
for name, fn in qs.items():
    if only and name not in only:
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        if name in os_:
            r = compare(df, os_[name], con)
        else:
            r = {"rows": df.count(), "ok": None}
    except Exception as e:  # report and continue
        r = {"ok": False, "error": repr(e)[:600]}
    r["sec"] = round(time.time() - t, 2)
    res[name] = r
    print(name, json.dumps({k: v for k, v in r.items() if k not in ("spark_cols", "oracle_cols")}, default=str)[:900], flush=True)
print("SUMMARY", sum(1 for r in res.values() if r.get("ok")), "/", len(res))
