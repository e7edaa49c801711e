"""python tests/check.py [sf_dir] [name ...]: compare queries with their SQL twins and print the times."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, differences  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from labelloom.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1]
    names = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                diff = differences(df, con, oracles[name])
            else:
                diff = []
                print(f"     {name} rows only: {df.count()}")
        except Exception as e:
            diff = [f"{type(e).__name__}: {str(e)[:1500]}"]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - start:.1f}s", *diff, flush=True)
    print(f"{bad} of {len(names or queries)} fail")
