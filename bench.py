"""Throughput of headline queries: prints one line of JSON.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the threads. "tones" runs transforms over 4,000 one-second signals at
16 kHz made on the fly (the published baseline's workload); its frames a second are given beside the times.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sonoplan import queries as engine
from sonoplan.params import ErbParams, LogHzParams, LogParams, MelParams, SpectroParams, StftParams
from sonoplan.plans.planner import Planner

SIGNALS, RATE = 4000, 16000
HEADLINE = ("linear_power", "linear_power_fast", "mel_db", "mel_db_fast", "erb_power", "loghz_db", "cqt_power", "mfcc", "chroma_l2", "istft_reconstruct", "mdct", "itd", "ild_histogram", "fft2d", "convolve_2d", "sharpen", "gammatone_iir", "minimum_phase")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, rates = {}, {}

    def timed(name: str, run) -> float:
        run().write.format("noop").mode("overwrite").save()  # the first run compiles
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        return times[name]

    queries = engine.queries()
    for name in HEADLINE:
        timed(name, lambda q=queries[name]: q(spark, sf))

    ids = spark.range(SIGNALS, numPartitions=4 * int(cpus))
    tone = F.transform(F.sequence(F.lit(0), F.lit(RATE - 1)), lambda i: F.sin(i * (F.col("id") + 200) * F.lit(6.283185307179586 / RATE)))
    path = f"/tmp/sonoplan-bench-{os.getpid()}"
    ids.select(F.col("id").alias("signal_id"), tone.alias("samples")).write.mode("overwrite").parquet(path)
    signals = spark.read.parquet(path)
    planner, floor = Planner(), LogParams(-80.0)
    p = SpectroParams(StftParams(512, 256), RATE)
    plans = {
        "power": planner.linear_power(p), "magnitude": planner.linear_magnitude(p), "db": planner.linear_db(p, floor), "mel": planner.mel_power(p, MelParams(80, 0.0, 8000.0)),
        "loghz": planner.log_hz_power(p, LogHzParams(84, 20.0, 8000.0)), "erb": planner.erb_power(p, ErbParams(64, 50.0, 8000.0)),
    }
    for name, plan in plans.items():
        s = timed(f"tones_{name}", lambda plan=plan: plan.compute(signals))
        rates[name] = {"signals_per_s": round(SIGNALS / s), "ms_per_signal": round(1000 * s / SIGNALS, 4), "frames_per_s": round(SIGNALS * p.stft.frame_count(RATE) / s)}
    spark.stop()
    import shutil

    shutil.rmtree(path, ignore_errors=True)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "tones": rates, "cpus": cpus}))


if __name__ == "__main__":
    main()
