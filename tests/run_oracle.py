"""Usage: python tests/run_oracle.py [sf_dir] [key ...] — prints one line per query."""

import importlib
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402

from lares.session import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    entry = importlib.import_module("__spark_entry__")
    q, o = entry.queries(), entry.oracle_sql()
    if len(keys) == 1 and keys[0].startswith("@"):
        mod = "lares.plans." + keys[0][1:]
        keys = [k for k in q if q[k].__module__ == mod or getattr(q[k], "_mod", "") == mod]
    keys = keys or list(q)
    spark = build_session("local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, con, k, q[k], o.get(k), sf)
        except Exception as e:  # noqa: BLE001
            r = {"key": k, "ok": False, "why": f"{type(e).__name__}: {str(e)[:700]}"}
        bad += r["ok"] is False
        why = r.pop("why", "")
        print(r, why, flush=True)
    print("bad:", bad, "of", len(keys))


if __name__ == "__main__":
    main()
