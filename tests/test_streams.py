"""Keyed state of streams: the same decisions however the input is cut, and crawls that go on where they stopped."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from weftline.streaming import crawl as C
from weftline.streaming import events as V
from weftline.streaming import quota as Q


def plain_quota(rows, limit, window, cooldown):
    state, out = {}, {}
    for call, key, at, failed in sorted(rows, key=lambda r: (r[2], r[0])):
        calls, until = state.get(key, ([], 0))
        calls = [t for t in calls if at - t < window]
        free = max(until, calls[0] + window if len(calls) >= limit else 0)
        out[call] = (at >= free, max(at, free))
        if at >= free:
            calls.append(at)
            if failed:
                until = max(until, at + cooldown)
        state[key] = (calls, until)
    return out


@pytest.mark.parametrize("files", [1, 10])
def test_quota_does_not_depend_on_micro_batches(spark, tmp_path, files):
    r = random.Random(5)
    # One key has a third of all calls.
    rows = [(k, r.choice(["hot", f"k{r.randrange(8)}", f"k{r.randrange(8)}"]), k * 2_000_000 + r.randrange(1000), r.random() < 0.1) for k in range(300)]
    df = spark.createDataFrame(rows, "event_id long, user_id string, at long, failed boolean").select("event_id", "user_id", "failed", F.timestamp_micros("at").alias("ts"))
    for k in range(files):
        df.where(F.floor(F.col("event_id") / (300 / files)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        time.sleep(0.01)
    # Files are taken in the order in which they were written.
    names = sorted((os.path.join(d, n) for d, _, ns in os.walk(tmp_path) for n in ns if n.endswith(".parquet")), key=os.path.getmtime)
    for k, name in enumerate(names):
        os.utime(name, (1_700_000_000 + k * 10,) * 2)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events.parquet")
    decided = Q.quota(stream, F.col("user_id"), F.col("event_id"), F.col("failed"), limit=3, window=60, cooldown=45, late="30 seconds")
    got = {x.call: (x.allowed, x.release) for x in V.run_once(decided, "quota-test", "update").collect()}
    assert got == plain_quota(rows, 3, 60_000_000, 45_000_000)
    assert 0 < sum(a for a, _ in got.values()) < 300


def test_crawl_goes_on_and_never_asks_twice(spark, tmp_path):
    asked = []

    def fetch(low, high):
        asked.append((low, high))
        return spark.range(low, high + 1).where("id % 3 = 0").withColumn("found", F.concat(F.lit("page "), "id"))

    folder = f"file://{tmp_path}"
    C.crawl(spark, folder, fetch, end=24, step=10)
    C.crawl(spark, folder, fetch, end=24, step=10)
    got = C.crawl(spark, folder, fetch, end=61, start=0, step=10).collect()
    assert asked == [(0, 9), (10, 19), (20, 24), (25, 34), (35, 44), (45, 54), (55, 61)]
    assert sorted((r.id, r.alive, r.found) for r in got) == [(k, k % 3 == 0, f"page {k}" if k % 3 == 0 else None) for k in range(62)]


def test_crawl_asks_a_failed_batch_again(spark, tmp_path):
    asked, broken = [], [True]

    def fetch(low, high):
        asked.append((low, high))
        if low == 10 and broken.pop():
            broken.append(False)
            raise RuntimeError("the site is down")
        return spark.range(low, high + 1)

    folder = f"file://{tmp_path}"
    with pytest.raises(Exception, match="the site is down"):
        C.crawl(spark, folder, fetch, end=39, step=10)
    got = C.crawl(spark, folder, fetch, end=39, step=10)
    assert asked == [(0, 9), (10, 19), (10, 19), (20, 29), (30, 39)]
    assert sorted(r.id for r in got.collect()) == list(range(40))
