"""Readers, writers and streams."""

import json
import os
import random
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.sources import tables
from corpuscle.streaming import ingest, limits


def test_raw_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"text": "", "content": "from content", "metadata": {"k": "own"}, "k": "top", "n": 3, "list": [1]}))
    (tmp_path / "b.TXT").write_text("plain é\ntext")
    (tmp_path / "c.json").write_text('"just a string"')
    (tmp_path / "d.json").write_text("[1, 2]")
    (tmp_path / "e.csv").write_text("no")
    (tmp_path / ".f.txt").write_text("hidden")
    rows = tables.raw_documents(spark, str(tmp_path)).collect()
    assert [r.stem for r in rows] == ["a", "b", "c", "d"]
    assert [r.text for r in rows] == ["from content", "plain é\ntext", "just a string", None]
    assert rows[0].metadata == {"k": "own", "n": "3"} and rows[3].error and not rows[0].error
    (tmp_path / "a.json").write_text(json.dumps({"text": "t", "a": "[draft] hello", "b": "{x", "c": {"d": 1}, "e": [1], "f": None, "g": True}))
    got = tables.raw_documents(spark, str(tmp_path)).where("stem = 'a'").head().metadata
    assert {k: v for k, v in got.items() if v is not None} == {"a": "[draft] hello", "b": "{x", "g": "true"}


def test_typed_array_and_questions(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"chunk_id": "a", "token_count": 3}, {"chunk_id": "b", "token_count": 0}, {"chunk_id": "c"}]))
    schema = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("token_count", T.IntegerType())])
    good, bad = tables.typed_array(spark, str(tmp_path / "x.json"), schema, F.col("token_count") >= 1)
    assert [r.chunk_id for r in good.collect()] == ["a"] and bad.count() == 2
    (tmp_path / "y.json").write_text(' {"chunk_id": "a"}')
    with pytest.raises(ValueError, match="no JSON array"):
        tables.typed_array(spark, str(tmp_path / "y.json"), schema, F.lit(True))
    assert tables.by_id(good, "chunk_id", "a")["token_count"] == 3 and tables.by_id(good, "chunk_id", "z") is None
    (tmp_path / "q.json").write_text(json.dumps(["one", {"question": "two"}, {"text": "three"}, {}]))
    assert [r.question for r in tables.questions(spark, str(tmp_path / "q.json")).orderBy("question_id").collect()] == ["one", "two", "three", ""]


def test_files_of_one_stem_have_ids_of_their_own(spark, tmp_path):
    for name in ("a.json", "a.txt", "b.v1.txt", "b.v2.txt", "c.md"):
        (tmp_path / name).write_text('"text"')
    rows = tables.raw_documents(spark, str(tmp_path)).collect()
    assert [r.stem for r in rows] == ["a.json", "a.txt", "b.v1", "b.v2", "c"]


def test_save_append_delete(spark, tmp_path):
    path, df = f"{tmp_path}/out", spark.range(3).selectExpr("id", "'c1' as level")
    assert not tables.exists(spark, path) and tables.size(spark, path) == 0
    tables.save(df, path, ("level",))
    tables.save(df, path, ("level",), append=True)
    assert tables.load(spark, path).where("level = 'c1'").count() == 6 and tables.size(spark, path) > 0
    tables.save(df, path)
    assert tables.load(spark, path).count() == 3
    assert tables.delete(spark, path) and not tables.exists(spark, path)


def test_failed_write_leaves_the_old_table(spark, tmp_path):
    path, df = f"{tmp_path}/out", spark.range(5)
    first = tables.save(df, path, key="a", inputs={"x": 1})
    for append in (False, True):
        with pytest.raises(Exception, match="broken"):
            tables.save(df.select(F.when(F.col("id") == 4, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id")), path, append=append)
        assert [r.id for r in tables.load(spark, path).orderBy("id").collect()] == list(range(5))
    found = tables.manifest(spark, path)
    assert (found["version"], found["key"], found["inputs"]) == (first, "a", {"x": 1})
    assert sorted(x for x in os.listdir(path) if not x.startswith(".")) == [f"_manifest-{first:010d}", found["parts"][0]["folder"]]


def test_readers_keep_the_version_they_opened(spark, tmp_path):
    path = f"{tmp_path}/out"
    tables.save(spark.range(5), path)
    opened = tables.load(spark, path)
    tables.save(opened.selectExpr("id + 10 as id"), path)  # from the table itself
    tables.save(spark.range(1), path, append=True)
    assert opened.count() == 5 and sorted(r.id for r in tables.load(spark, path).collect()) == [0, *range(10, 15)]
    assert tables.load(spark, path, 1).count() == 5 and tables.load(spark, path, 2).count() == 5
    with pytest.raises(ValueError):
        tables.load(spark, path, 9)
    assert tables.vacuum(spark, path) == 0  # too young
    assert tables.vacuum(spark, path, age=-1) == 1 and tables.load(spark, path).count() == 6 and tables.artifact_size(spark, path) > 0
    tables.clear(spark, path)
    assert not tables.saved(spark, path) and tables.load(spark, path).count() == 0 and tables.load(spark, path, 3).count() == 6


def test_appends_at_a_time_all_count(spark, tmp_path):
    path = f"{tmp_path}/out"
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: tables.save(spark.range(k, k + 1), path, append=True), range(12)))
    assert sorted(r.id for r in tables.load(spark, path).collect()) == list(range(12)) and tables.manifest(spark, path)["version"] == 12
    for k in range(12, 20):
        tables.save(spark.range(k, k + 1).withColumn("more", F.lit("x")), path, append=True)
    # small parts are rewritten as one now and then
    assert len(tables.manifest(spark, path)["parts"]) <= tables.MANY_SMALL
    rows = tables.load(spark, path).collect()
    assert sorted(r.id for r in rows) == list(range(20)) and {r.more for r in rows if r.id > 12} == {"x"}


def test_a_write_counts_once(spark, tmp_path):
    path = f"{tmp_path}/out"
    for k in (0, 0, 1, 0):
        tables.save(spark.range(k, k + 1), path, append=True, once=("a", k))
    tables.save(spark.range(5, 6), path, append=True, once=("b", 0))
    assert sorted(r.id for r in tables.load(spark, path).collect()) == [0, 1, 5]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: tables.save(spark.range(7, 8), path, append=True, once=("a", 2)), range(4)))
    tables.save(spark.range(8, 9), path, append=True)
    assert sorted(r.id for r in tables.load(spark, path).collect()) == [0, 1, 5, 7, 8]
    assert tables.written(spark, path, ("a", 2)) and not tables.written(spark, path, ("a", 3)) and not tables.written(spark, path, ("c", 0))
    assert len([x for x in os.listdir(path) if x.startswith("v-")]) == len(tables.manifest(spark, path)["parts"]) == 5


def test_plain_folders_are_read_and_taken_over(spark, tmp_path):
    path = f"{tmp_path}/out"
    spark.range(3).write.parquet(path)
    assert tables.saved(spark, path) and tables.load(spark, path).count() == 3
    tables.save(spark.range(2), path, append=True)
    assert tables.load(spark, path).count() == 5


def test_threads_have_their_own_scratch(spark):
    def run(k):
        with tables.scratch(spark):
            kept = tables.stored(spark.range(k), "x")
            time.sleep(0.5)
            return kept.count()

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(run, range(4))) == [0, 1, 2, 3]


def slow_limit(rows, limit, window):
    kept, out = {}, {}
    for u, e, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        now = [x for x in kept.get(u, []) if x > t - window]
        out[e] = len(now) < limit
        kept[u] = [*now, t] if out[e] else now
    return out


def test_rate_limit(spark):
    rows = [(k % 3, k, float((k * 37) % 200)) for k in range(300)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, t double").select("user_id", "event_id", F.timestamp_seconds("t").alias("ts"))
    got = {r.event_id: r.allowed for r in ingest.rate_limited(df, 4, 20.0).collect()}
    assert got == slow_limit(rows, 4, 20.0)


def test_rate_limit_stream(spark, tmp_path):
    rows = [(k % 2, k, float(k)) for k in range(60)]
    pd.DataFrame(rows, columns=["user_id", "event_id", "t"]).assign(ts=lambda d: pd.to_datetime(d["t"], unit="s").astype("datetime64[us]")).drop(columns="t").to_parquet(tmp_path / "e.parquet")
    schema = "user_id long, event_id long, ts timestamp_ntz"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path)).withColumn("ts", F.col("ts").cast("timestamp"))
    q = ingest.rate_limited_stream(stream, 3, 20.0).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: r.allowed for r in spark.sql("select * from limited").collect()}
    assert got == slow_limit(rows, 3, 20.0)


START = datetime(2024, 1, 1)


def test_rate_limit_of_unordered_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(4), k, START + timedelta(seconds=rng.randrange(3000) / 10)) for k in range(400)] + [(9, 1000, None), (9, 1001, START)]
    df = spark.createDataFrame(rows, limits.EVENT)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    batch = F.coalesce(F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(START))) / 150_000_000) + F.col("event_id") % 2, F.lit(0))
    parts = [df.where(batch == k) for k in range(3)] + [limits.closing(spark, START + timedelta(seconds=300), "151 seconds", 20.0)]
    for part in parts:
        part.write.mode("append").parquet(source)
        done = limits.decide(spark, source, out, check, 4, 20.0, "151 seconds")
    got, want = spark.read.schema(limits.DECIDED).parquet(out), ingest.rate_limited(df.where("ts is not null"), 4, 20.0)
    assert got.count() == 401 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # nothing waits, and times out of the window are forgotten
    assert done.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    assert spark.conf.get(limits.STORE) != limits.ROCKS


def test_state_of_a_rate_limit_grows_with_shards_not_clients(spark, tmp_path):
    rng, far = random.Random(5), datetime(3000, 1, 1)
    # many clients, one of very many events, large ids, no client, and events of one time of which some have no id
    rows = [(u, 2 * u + k, START + timedelta(seconds=rng.randrange(300))) for u in range(2000) for k in range(2)]
    rows += [(5000, 10_000 + k, START + timedelta(seconds=rng.randrange(300))) for k in range(limits.PART + 500)]
    rows += [(2**62 + 1, 2**62 + 3, START), (None, 60_000, START)]
    unnamed = [(6000 + k % 3, 50_000 - k if k % 4 else None, START + timedelta(seconds=k // 12)) for k in range(60)]
    df, others = spark.createDataFrame(rows, limits.EVENT), spark.createDataFrame(unnamed, limits.EVENT)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    states = []
    for part in (df.union(others).union(spark.createDataFrame([(7, 60_001, far)], limits.EVENT)), limits.closing(spark, far, "301 seconds", 20.0)):
        part.write.mode("append").parquet(source)
        done = limits.decide(spark, source, out, check, 4, 20.0, "301 seconds")
        states += [p["stateOperators"][0]["numRowsTotal"] for p in done.recentProgress if p["stateOperators"]]
    assert 500 < max(states) <= limits.SHARDS + 2 and states[-1] == 0
    got = spark.read.schema(limits.DECIDED).parquet(out)
    assert [tuple(r) for r in got.where(F.year("ts") == 3000).collect()] == [(7, 60_001, far, True, 0)]
    got = got.where(F.year("ts") < 3000)
    want = ingest.rate_limited(df.where("user_id is not null"), 4, 20.0).union(ingest.rate_limited(others, 4, 20.0))
    assert got.count() == len(rows) - 1 + len(unnamed) and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_late_events_get_no_decision(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    at = lambda s: START + timedelta(seconds=s)
    dropped = 0
    for rows in ([(1, 1, at(0)), (1, 2, at(1)), (1, 3, at(100))], [(1, 4, at(2)), (1, 5, at(95))], [(1, 6, at(300))]):
        spark.createDataFrame(rows, limits.EVENT).write.mode("append").parquet(source)
        done = limits.decide(spark, source, out, check, 2, 10.0, "10 seconds")
        dropped += sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in done.recentProgress if p["stateOperators"])
    got = {r.event_id: r.allowed for r in spark.read.schema(limits.DECIDED).parquet(out).collect()}
    assert got == {1: True, 2: True, 5: True, 3: True} and dropped == 1


def test_chunk_stream_resumes(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    for k in range(2):
        spark.createDataFrame([(k, "a b c d e")], schema).write.mode("append").parquet(source)
        ingest.chunk_stream(spark, source, schema, F.lit("d"), out, check, 3, 1)
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(out).collect()) == [(0, "a b c"), (0, "c d e"), (1, "a b c"), (1, "c d e")]
