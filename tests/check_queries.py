"""Compare registered queries with their SQL: ``python tests/check_queries.py [sf] [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from tablegraph import workload  # noqa: E402
from tests.compare import compare, connect  # noqa: E402


def main(sf: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name in names or list(workload.QUERIES):
        start = time.time()
        try:
            df = workload.QUERIES[name](spark, sf_dir)
            sql = workload.ORACLES.get(name)
            if sql is None:
                n, difference = df.count(), None
                verdict = "rows-only"
            else:
                n, difference = compare(df, con, sql)
                verdict = "ok" if difference is None else "DIFF"
        except Exception as error:  # noqa: BLE001
            n, difference, verdict = -1, str(error)[:1500], "ERROR"
        bad += verdict in ("DIFF", "ERROR")
        print(f"{verdict:9} {name:32} rows={n} {time.time() - start:.1f}s", flush=True)
        if difference:
            print("   ", difference[:1500], flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:]) else 0)
