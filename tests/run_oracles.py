"""``python tests/run_oracles.py [sf_dir] [name ...]``: every query with its SQL, with times."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402

from lamina.queries import ORACLES, QUERIES  # noqa: E402
from lamina.session import build_session  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = build_session("oracles", 8, **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            verdict = compare(df, ORACLES[name], con) if name in ORACLES else f"rows only: {len(df.collect())}"
        except Exception as error:
            verdict = f"ERROR {str(error)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        good = verdict is None or verdict.startswith("rows only")
        bad += not good
        print(f"{'ok  ' if good else 'FAIL'} {name} {time.time() - start:.1f}s {verdict or ''}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
