"""Time the registered queries and print one JSON line.

BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated query names (default: all)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from linktm.operators.decode import decode_packets, non_empty  # noqa: E402
from linktm.operators.points import points  # noqa: E402
from linktm.plans.data import message_path, messages  # noqa: E402
from linktm.plans.queries import QUERIES  # noqa: E402
from linktm.scratch import materialize  # noqa: E402

# Copies of every packet in the larger set: at least 863,928 packets at sf0.1.
COPIES = 10


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("linktm-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(QUERIES)
    times: dict[str, float] = {}
    times["build_packets"] = timed(lambda: message_path(spark, sf_dir))
    message_path(spark, sf_dir, "malformed")
    for name in names:
        times[name] = timed(lambda: run(QUERIES[name](spark, sf_dir)))

    packets = messages(spark, sf_dir)
    many = materialize(
        packets.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
        .drop("copy")
        .repartition(4 * int(cpus)),
        "bench-packets",
    )
    count = many.count()
    larger = {
        "decode_all": lambda: run(decode_packets(non_empty(many))),
        "decode_points": lambda: run(points(decode_packets(non_empty(many)))),
    }
    rates = {}
    for name, action in larger.items():
        seconds = timed(action)
        times[f"{name}_x{COPIES}"] = seconds
        rates[name] = round(count / seconds)
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "packets": count,
                "packets_per_sec": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
