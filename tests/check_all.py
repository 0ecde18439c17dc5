"""Run every query once, compare where SQL exists, and print times.

Usage: python tests/check_all.py [folder] [name ...]
"""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

import __spark_entry__ as entry  # noqa: E402
from cartlens.session import local_session  # noqa: E402
from tests.oracle import connect, difference  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, con = local_session(), connect(folder)
    sqls = entry.oracle_sql()
    failed = []
    for name, make in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = make(spark, folder)
            if name in sqls:
                problem = difference(df, con, sqls[name])
                state = "ok" if problem is None else f"DIFFERS {problem}"
            else:
                state = f"rows {df.count()}"
        except Exception as error:  # report and go on to the next query
            state = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        if state.startswith(("DIFFERS", "FAILED")):
            failed.append(name)
        print(f"{name:32s} {time.time() - start:6.2f}s  {state}", flush=True)
    print("failed:", failed)
