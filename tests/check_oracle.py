"""Command-line form of the oracle test: python tests/check_oracle.py SF_DIR [names…]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from compare import difference, duck  # noqa: E402

from gridcast.queries import ORACLE, QUERIES  # noqa: E402
from gridcast.session import local_session  # noqa: E402


def main(sf: str, names: list[str]) -> int:
    spark = local_session("check", cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    for name in names or QUERIES:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf)
            found = difference(df, con, ORACLE[name]) if name in ORACLE else f"rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:600]}"
        bad += found is not None and not found.startswith("rows only")
        print(f"{'ok ' if found is None else '-- '}{name} {time.time() - t:.2f}s {found or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
