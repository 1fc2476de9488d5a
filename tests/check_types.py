"""Column types of every query vs its DuckDB oracle (the driver compares schemas)."""
import sys
sys.path.insert(0, '/root/repo'); sys.path.insert(0, '/root/repo/tests')
import __spark_entry__ as E
from oracle_check import duck
from threadlens.session import local_session
spark = local_session()
d = '/root/testdata/sf0.001'
con = duck(d)
M = {'string': 'VARCHAR', 'bigint': 'BIGINT', 'int': 'INTEGER', 'double': 'DOUBLE', 'boolean': 'BOOLEAN'}
qs, sq = E.queries(), E.oracle_sql()
bad = 0
for name in sorted(sq):
    df = qs[name](spark, d)
    st = {c: M.get(t, t) for c, t in df.dtypes}
    rel = con.sql(sq[name])
    ot = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    diff = {c: (st.get(c), ot.get(c)) for c in set(st) | set(ot) if st.get(c) != ot.get(c)}
    if diff:
        bad += 1
        print(name, diff, flush=True)
print("queries with type differences:", bad)
