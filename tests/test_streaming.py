import random
import time

from pyspark.sql import functions as F

from strandline.operators import signal as G
from strandline.streaming import jobs as J
from tests.test_blocks_edges import segments


def drain(df, name, spark, mode="append", **conf):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def events(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "src")
    e.orderBy("ts").coalesce(1).write.parquet(src)
    return e, spark.readStream.schema(e.schema).parquet(src)


def test_filter_counts_and_windows(spark, sf_dir, tmp_path):
    e, s = events(spark, sf_dir, tmp_path)
    rules = [("low", F.col("value") < 5), ("error", F.col("event_type") == "error")]
    got = drain(J.filter_reasons(s, rules), "reasons", spark, "complete")
    want = e.groupBy(F.when(F.col("value") < 5, "low").when(F.col("event_type") == "error", "error").otherwise("pass").alias("reason")).count()
    assert {r.reason: r.n for r in got.groupBy("reason").agg(F.sum("n").alias("n")).collect()} == {r.reason: r["count"] for r in want.collect()}
    n = drain(J.passing(s, rules), "passing", spark).count()
    assert n == e.where("value >= 5 and event_type <> 'error'").count()
    cov = drain(J.coverage(s, ["event_type"], width="2 hours", slide="1 hour"), "cov", spark, "complete")
    assert cov.agg(F.sum("depth")).first()[0] == 2 * e.count()
    tumbling = drain(J.coverage(s, ["event_type"], width="1 hour"), "cov1", spark, "complete")
    assert tumbling.agg(F.sum("depth")).first()[0] == e.count()
    isl = drain(J.session_islands(s, ["event_type"], gap="2 hours"), "isl", spark, "complete")
    assert isl.agg(F.sum("n")).first()[0] == e.count()
    d = drain(J.dedupe_first_wins(s.unionByName(s), ["event_id"]), "ded", spark)
    assert d.count() == e.count()


def test_incremental_segmentation_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rnd = random.Random(11)
    sig = {p: rnd.random() if rnd.random() < 0.8 else 0.0 for p in range(1, 400)}
    src = tmp_path / "sig"
    rows = sorted(sig.items())
    for i in range(0, len(rows), 150):
        spark.createDataFrame([("k", p, v) for p, v in rows[i : i + 150]], "k string, pos long, prob double").coalesce(1).write.mode("append").parquet(str(src))
    s = spark.readStream.schema("k string, pos long, prob double").option("maxFilesPerTrigger", 1).parquet(str(src))
    # Processing-time timers ask for empty batches without end: stop once every row has been through.
    q = J.segment_stream(s, "k", 0.3, 5, 20, lookahead=10).writeStream.format("memory").queryName("segs").outputMode("append").start()
    seen, deadline = 0, time.time() + 60
    while seen < len(rows) and time.time() < deadline and q.isActive:
        time.sleep(0.5)
        seen = sum(p.numInputRows for p in q.recentProgress)
    q.stop()
    assert seen == len(rows), q.exception()
    got = spark.table("segs").collect()
    want = segments(sig, 0.3, 5, 20)
    mine = sorted((r.start, r.end, r.kind == "active") for r in got if r.kind != "late")
    assert mine == want[: len(mine)]
    assert len(mine) > 0 and want[len(mine)][0] >= 400 - 60
