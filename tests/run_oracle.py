"""python tests/run_oracle.py [sf] [name-prefix …]"""

import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

import __spark_entry__ as entry  # noqa: E402
from conftest import make_session  # noqa: E402
from oracle import compare, connect  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
want = sys.argv[2:]
spark = make_session()
con = connect(sf)
queries, sqls = entry.queries(), entry.oracle_sql()
bad = 0
for name, fn in queries.items():
    if want and not any(name.startswith(w) for w in want):
        continue
    t = time.time()
    try:
        if name in sqls:
            problem = compare(spark, sf, fn, sqls[name], con)
        else:
            n = fn(spark, sf).count()
            problem = None if n else "no rows"
            name += f" (rows only: {n})"
    except Exception as e:  # noqa: BLE001
        problem = f"{type(e).__name__}: {str(e)[:900]}"
    bad += problem is not None
    print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - t:6.2f}s {name} {problem or ''}", flush=True)
print("failed:", bad)
