import pytest
from pyspark.sql import functions as F

from formline.operators.classify import with_identity
from formline.sources import files
from formline.streaming import coldlane, discovery, limits, relay, settle

VALUES = ['{"a":1}', '{"b":"x"}', "{", None, '{"a":2}']


def write(spark, path, offset):
    rows = [(None, v, None, "t", 0, offset + i, "events.geo.x") for i, v in enumerate(VALUES)]
    df = spark.createDataFrame(rows, "key string, value string, headers array<struct<key:string,value:binary>>, topic string, partition int, offset bigint, source string")
    df.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), *df.columns[2:]).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def index(spark):
    def read():
        known = spark.createDataFrame([('{"a":1}',)], "value string")
        return with_identity(known).select("bucket", "fp", F.lit("sch-a").alias("schema_id"))

    return read


def test_relay_and_restart(spark, tmp_path, index):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    write(spark, src, 0)
    relay.start(spark, files.stream(spark, src), index, out, cp).awaitTermination()
    # A crash after the writes and before the commit: the batch runs again into the same folders.
    relay.write_batch(spark.read.schema(files.RECORD).parquet(src), 0, index(), out)
    write(spark, src, 5)
    relay.start(spark, files.stream(spark, src), index, out, cp).awaitTermination()
    tagged = relay.read(spark, out, "tagged")
    assert tagged.count() == 8 and tagged.select("topic", "partition", "offset").distinct().count() == 8
    assert {r["fate"]: r["count"] for r in tagged.groupBy("fate").count().collect()} == {"known": 4, "provisional": 2, "tombstone": 2}
    assert relay.read(spark, out, "quarantine").select("reason").distinct().collect()[0][0] == "parse_error"
    assert relay.read(spark, out, "discovery").select("candidate").distinct().count() == 1
    heads = {h["key"] for r in tagged.select("headers").collect() for h in r["headers"]}
    assert heads == {"x-formline-schema", "x-formline-origin"}


def test_clusters_keep_their_state(spark, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    schema = "source string, seq long, id string, fps array<string>"

    def run(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        got = []
        q = coldlane.cluster_stream(spark.readStream.schema(schema).parquet(src)).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
        return {(r["source"], r["seq"]): r["cluster"] for r in got}

    assert run([("s", 1, "c1", ["ab", "a", "b"]), ("s", 2, "c2", ["z"]), ("o", 1, "c9", ["ab"])], "x") == {("s", 1): "c1", ("s", 2): "c2", ("o", 1): "c9"}
    assert run([("s", 3, "c3", ["ac", "a", "c"]), ("s", 4, "c4", ["c"])], "y") == {("s", 3): "c1", ("s", 4): "c1"}


def test_an_oversized_record_goes_to_quarantine_alone(spark, tmp_path, index):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, src, 0)
    big = spark.read.schema(files.RECORD).parquet(src).where("offset = 0").withColumn("value", F.encode(F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 4_000), F.lit('"}')), "utf-8")).withColumn("offset", F.lit(9).cast("long"))
    relay.write_batch(spark.read.schema(files.RECORD).parquet(src).unionByName(big), 0, index(), out, max_message_bytes=(16 << 10) + 1_000)
    held = relay.read(spark, out, "quarantine").where("offset = 9").collect()
    assert [(r["reason"], r["value"]) for r in held] == [("size_exceeded", None)]
    assert all(relay.read(spark, out, n).where("offset = 9").count() == 0 for n in ("tagged", "discovery"))
    assert not (tmp_path / "out" / "_staged" / "batch=0").exists()


def _through(spark, tmp_path, schema, make, columns):
    """Runs each list of rows as a batch of a stream that keeps its state, and gives what came out."""
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        got = []
        make(spark.readStream.schema(schema).parquet(src)).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r[c] for c in columns) for r in got)

    return run


def test_novelty_has_a_limit_over_batches(spark, tmp_path):
    run = _through(spark, tmp_path, "source string, candidate string, first_seen long", lambda s: limits.novelty_stream(s, 2), ("source", "candidate", "admitted"))
    assert run([("s", "a", 1), ("s", "b", 2), ("s", "c", 3), ("t", "d", 4)]) == [("s", "a", True), ("s", "b", True), ("s", "c", False), ("t", "d", True)]
    assert run([("s", "e", 59_999), ("s", "f", 60_000)]) == [("s", "e", False), ("s", "f", True)]


def test_settling_goes_on_over_batches(spark, tmp_path):
    run = _through(spark, tmp_path, "source string, seq long, fate string, schema_id string", lambda s: limits.settled_stream(s, 2, 3), ("seq", "full"))
    fates = ["known"] * 6 + ["malformed"] + ["known"] * 4
    rows = [("s", i, f, "a") for i, f in enumerate(fates)]
    whole = settle.fold(fates, ["a"] * 11, 2, 3)
    assert [x for _, x in run(rows[:5])] + [x for _, x in run(rows[5:])] == whole


def test_discovery_is_counted_once(spark, tmp_path, index):
    src, out, found, cp = (str(tmp_path / x) for x in ("in", "out", "found", "cp"))
    write(spark, src, 0)
    relay.write_batch(spark.read.schema(files.RECORD).parquet(src), 0, index(), out)
    discovery.start(spark, f"{out}/discovery", found, cp).awaitTermination()
    discovery.absorb(relay.read(spark, out, "discovery"), 0, found)  # the batch runs again
    relay.write_batch(spark.read.schema(files.RECORD).parquet(src), 1, index(), out)
    discovery.start(spark, f"{out}/discovery", found, cp).awaitTermination()
    assert [(r["samples"], r["n_shapes"]) for r in discovery.candidates(spark, found).collect()] == [(2, 1)]


def test_writes_are_tried_again():
    waits, left = [], [3]

    def write_():
        left[0] -= 1
        if left[0]:
            raise OSError

    assert discovery.persistent(write_, sleep=waits.append) == 2 and waits == [0.25, 0.5]
    assert [discovery.pause_ms(n) for n in (0, 5, 6, 60)] == [250, 8_000, 10_000, 10_000]
    with pytest.raises(OSError):
        discovery.persistent(lambda: (_ for _ in ()).throw(OSError()), tries=2, sleep=waits.append)
    assert [discovery.stop_reason(*x) for x in ((5, 5, 0, 9, 0, 9), (1, 5, 9, 9, 0, 9), (1, 5, 0, 9, 9, 9), (1, 5, 0, 9, 0, 9))] == ["reached", "idle", "deadline", None]
