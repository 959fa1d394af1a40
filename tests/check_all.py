"""Check registered queries against DuckDB: python tests/check_all.py [folder] [name ...]"""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from tests.oracle import compare, connect  # noqa: E402
from wardflow.plans import oracle_sql, queries  # noqa: E402
from wardflow.session import local_session  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, con, bad = local_session(), connect(folder), 0
    for name in names:
        start = time.time()
        try:
            if name in oracle_sql():
                problem = compare(spark, con, name, folder)
            else:
                n = queries()[name](spark, folder).count()
                problem = None
                print(f"     {name}: {n} rows, no oracle")
        except Exception as exc:  # noqa: BLE001
            text = str(exc)
            problem = f"{type(exc).__name__}: {text[:700]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += problem is not None
        print(f"{'OK  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s" + (f": {problem}" if problem else ""), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
