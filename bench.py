"""Times views against recomputation; one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))

from tidemark.engine import ChangeSet, ViewEngine  # noqa: E402
from tidemark.queries import COLUMNS, _split  # noqa: E402

VIEWS = {
    "join": ("orders lineitem", "SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "sum_avg": ("lineitem", "SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q, avg(l_quantity) AS a FROM lineitem GROUP BY l_suppkey"),
    "min_max": ("lineitem", "SELECT l_suppkey, min(l_quantity) AS mi, max(l_extendedprice) AS ma FROM lineitem GROUP BY l_suppkey"),
    "distinct": ("lineitem", "SELECT DISTINCT l_partkey, l_returnflag FROM lineitem"),
    "exists": ("orders lineitem", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)"),
    "outer_join": ("orders lineitem", "SELECT o_orderkey, l_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"),
}
#: Columns of the tables' keys, in whose order files are; a key of each view to read one group or order by.
ORDER = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
POINT = {"join": "o_orderkey = 1000", "sum_avg": "l_suppkey = 42", "min_max": "l_suppkey = 42", "distinct": "l_partkey = 1000", "exists": "o_orderkey = 1000", "outer_join": "o_orderkey = 1000"}
#: Shares of lineitem that a statement inserts once more; of DELETED, as many are deleted again.
SHARES = {"0.01%": 10000, "0.1%": 1000, "1%": 100, "10%": 10}
DELETED = "0.1%"
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    ratios: dict[str, dict[str, float]] = {}
    crossover: dict[str, str] = {}

    def timed(what) -> float:
        t = time.time()
        what()
        return time.time() - t

    for name, (tables, sql) in VIEWS.items():
        engine = ViewEngine(spark, f"file://{tempfile.mkdtemp()}")  # local mode only, see master above
        data = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").selectExpr(*_split(COLUMNS[t])) for t in tables.split()}
        for t, df in data.items():
            engine.create_table(t, df, cluster_by=ORDER[t])
        engine.create_view(name, sql)
        lines = data["lineitem"]
        point = lambda: engine.read(name).where(POINT[name]).collect()
        seen = {"refresh": [timed(lambda: engine.refresh_view(name)) for _ in range(RUNS + 1)], "read_before": [timed(point) for _ in range(RUNS + 1)], "read_after": []}
        for share, n in SHARES.items():
            for run in range(RUNS + (share == "0.01%")):  # the first statement of all is a warm-up
                rows = lines.where(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(n)) == run)
                seen.setdefault(f"insert_{share}", []).append(timed(lambda: engine.insert("lineitem", rows)))
                if share == "0.01%":
                    seen["read_after"].append(timed(point))
                if share == DELETED:
                    seen.setdefault(f"delete_{share}", []).append(timed(lambda: engine.apply({"lineitem": ChangeSet(deleted=rows)})))
        warm = ("refresh", "read_before", "read_after", "insert_0.01%")
        median = {k: statistics.median(v[1:] if k in warm else v) for k, v in seen.items()}
        times |= {f"{name}_{k}": round(v, 3) for k, v in median.items()}
        ratios[name] = {k: round(median["refresh"] / v, 2) for k, v in median.items() if k.startswith(("insert", "delete"))}
        slower = [s for s in SHARES if median[f"insert_{s}"] > median["refresh"]]
        crossover[name] = slower[0] if slower else "over 10%"
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "seconds of refreshes, maintained changes and point reads, medians", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf"), "runs": RUNS, "cores": int(cpus), "refresh_over_maintenance": ratios, "crossover_insert": crossover}))


if __name__ == "__main__":
    main()
