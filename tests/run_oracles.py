"""Run registered queries against their oracles: python tests/run_oracles.py [sf] [name ...]"""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from oracle import connect, mismatch, type_difference  # noqa: E402

from foldwright.plans import ORACLES, QUERIES  # noqa: E402
from foldwright.session import build_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:] or list(QUERIES)
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            got = df.toPandas()
            took = time.time() - start
            if name in ORACLES:
                problem = mismatch(got, con.execute(ORACLES[name]).df())
                types = type_difference(df, con, ORACLES[name])
                status = "ok" if problem is None else f"MISMATCH {problem}"
                if types:
                    status += f" TYPES {types}"
            else:
                status = f"rows only"
        except Exception as error:
            took, got = time.time() - start, []
            status = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        bad += not (status == "ok" or status == "rows only")
        print(f"{name:32s} {took:6.2f}s {len(got):7d} rows  {status}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
