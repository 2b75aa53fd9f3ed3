"""Run registered queries beside their SQL twins and print what differs.

    python tools/check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tools.compare import TABLES, duck, same_rows  # noqa: E402
from labelkit.plans import ORACLES, QUERIES  # noqa: E402
from labelkit.session import build_session  # noqa: E402


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name in args.names or QUERIES:
        began = time.time()
        try:
            got = QUERIES[name](spark, folder).toPandas()
            took = time.time() - began
            if name in ORACLES:
                began = time.time()
                want = con.sql(ORACLES[name]).df()
                problem = same_rows(got, want)
                note = f"sql {time.time() - began:.2f}s"
            else:
                problem, note = (None if len(got) else "no rows"), "rows only"
        except Exception as failure:
            problem, took, note, got = f"{type(failure).__name__}: {str(failure)[:1500]}", time.time() - began, "", []
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:26s} {len(got):7d} rows {took:6.2f}s {note} {problem or ''}", flush=True)
    print(f"{len(TABLES)} tables, {bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
