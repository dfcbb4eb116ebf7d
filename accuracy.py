"""Accuracy of the sketches on streams of the sizes that published figures use; prints one JSON line.

HyperLogLog: signed error over 20 streams of a million items. Count-Min: over-counts of 200,000 events over 50,000 items with
a Zipf exponent of 1.1, plain and with conservative update. Top-k: recall of candidates ranked by Count-Min estimates.
"""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

import numpy as np  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidewell.functions import codecs  # noqa: E402
from tidewell.functions.bounds import cms_size, hll_error  # noqa: E402
from tidewell.operators import sketches  # noqa: E402
from tidewell.session import configured  # noqa: E402


def zipf(spark, s, events=200_000, items=50_000, seed=7):
    w = 1 / np.arange(1, items + 1) ** s
    n = np.random.default_rng(seed).multinomial(events, w / w.sum())
    return spark.createDataFrame([("k", f"/p/{i}", int(x)) for i, x in enumerate(n) if x], "k string, item string, n long").cache()


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g"}
    spark = configured(SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    out: dict = {"hll": {}, "cms": {}, "topk": {}}
    n, trials = 1_000_000, 20
    stream = spark.range(n * trials).select((F.col("id") % trials).alias("t"), F.concat_ws(":", (F.col("id") % trials).cast("string"), F.floor(F.col("id") / trials).cast("string")).alias("item"))
    for p in (10, 12, 14):
        err = sketches.hll_estimate(sketches.hll_registers(stream, "item", ["t"], p), ["t"], p).select((100 * (F.col("estimate") - n) / n).alias("e"))
        r = err.agg(F.stddev_pop("e"), F.avg("e"), F.avg(F.abs("e"))).first()
        out["hll"][p] = {"sigma_pct": round(r[0], 2), "theory_pct": round(100 * hll_error(p), 2), "bias_pct": round(r[1], 2), "mean_abs_pct": round(r[2], 2)}
    items = zipf(spark, 1.1)
    for eps in (0.01, 0.005, 0.001, 0.0005):
        w, d = cms_size(eps, 0.01)
        plain = sketches.cms_estimate(sketches.cms_cells(items, "item", "n", [], w, d), items, "item", [], w, d)
        kind = {"plain": plain, "conservative": codecs.conservative_cells(items, ["k"], "item", "n", w, d)}
        for name, est in kind.items():
            r = est.select("item", "estimate").join(items, "item").select((F.col("estimate") - F.col("n")).alias("over")).agg(F.avg("over"), F.max("over"), F.avg((F.col("over") <= eps * 200_000).cast("double")), F.min("over")).first()
            out["cms"][f"{eps} {name}"] = {"mean_over": round(r[0], 2), "max_over": r[1], "within_bound": round(r[2], 4), "below_truth": r[3] < 0}
    w, d = cms_size(0.001, 0.01)
    for s in (0.5, 0.6, 0.8, 1.0, 1.2, 1.5):
        items = zipf(spark, s, seed=11)
        est = codecs.conservative_cells(items, ["k"], "item", "n", w, d)
        row = {}
        for k in (10, 50):
            a = est.orderBy(F.desc("estimate"), "item").limit(k).select("item")
            least = items.orderBy(F.desc("n"), "item").limit(k).agg(F.min("n")).first()[0]
            row[f"recall@{k}"] = a.join(items.where(F.col("n") >= least), "item").count() / k  # an item that ties with the last is as good
        out["topk"][s] = row
    n = 5_000_000
    stream = spark.range(n).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("item"), F.concat(F.lit("p"), (F.xxhash64("id") % 50_000).cast("string")).alias("page"), F.lit(1).cast("long").alias("n"))
    out["updates_per_s"] = {}
    for name, df in (("hll 14", sketches.hll_registers(stream, "item", [], 14)), ("cms 0.001", sketches.cms_cells(stream, "page", "n", [], w, d))):
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        out["updates_per_s"][name] = round(n / best)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
