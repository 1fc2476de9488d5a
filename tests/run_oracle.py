"""Run every registered query against its DuckDB oracle (like the driver does).

usage: python tests/run_oracle.py [sf_dir] [name ...]
"""
import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from oracle_check import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from threadlens.session import local_session  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = local_session()
con = duck(sf_dir)
qs, sqls = E.queries(), E.oracle_sql()
results = {}
for name in names or sorted(qs):
    t = time.time()
    try:
        df = qs[name](spark, sf_dir)
        if name in sqls:
            r = compare(df, con, sqls[name])
            ok = r["hash_match"] and r["spark_rows"] == r["oracle_rows"]
        else:
            n = df.count()
            r = {"spark_rows": n}
            ok = True
    except Exception as exc:  # report and continue
        r = {"error": repr(exc)[:800]}
        ok = False
    r["sec"] = round(time.time() - t, 2)
    results[name] = (ok, r)
    brief = {k: v for k, v in r.items() if k not in ("spark_cols", "oracle_cols")}
    if not ok:
        brief = {k: (v if not isinstance(v, list) else [str(x)[:1500] for x in v]) for k, v in r.items()}
    print(("PASS " if ok else "FAIL ") + name, json.dumps(brief, default=str)[:4000], flush=True)
print("passed", sum(1 for ok, _ in results.values() if ok), "of", len(results))
