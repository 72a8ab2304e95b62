"""Print the formatted physical plan of registered queries (plan review aid).

Usage: python tools/explain_plans.py [--sf DIR] key [key ...]
Note: queries with shared intermediates materialise them (checkpoint) while
their plan is built; the printed plan then starts at the checkpoint scan.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.plans.catalog import QUERIES  # noqa: E402
from tessera.session import get_spark  # noqa: E402


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--mode", default="formatted")
    ap.add_argument("keys", nargs="+")
    a = ap.parse_args()
    spark = get_spark()
    for k in a.keys:
        print(f"===== {k}")
        QUERIES[k](spark, a.sf).explain(a.mode)


if __name__ == "__main__":
    main()
