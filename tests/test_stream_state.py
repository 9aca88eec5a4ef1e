"""Streams that hold state: order by event time, restarts, late rows, expiry, bounded buffers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import conversations as cv
from threadloom.streaming import jobs as sj
from threadloom.streaming import segments as sg

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "message_id long, platform string, ts timestamp_ntz, topic string, embedding array<double>"


def feed(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, **how):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    stream = sj.file_stream(spark, src, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    with sg.keyed_state(spark):
        return sj.run_to_table(sg.segment_stream(stream, **how), "seg", path=out, checkpoint=cp)


def talk(seed, n, keys):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        vector = r.choice([[1.0, 0.0], [0.8, 0.6], [0.0, 1.0], [0.0, 0.0], None])
        rows.append((i, r.choice(keys), T0 + dt.timedelta(seconds=i * 1_500 + r.randint(0, 900)), r.choice("aaab"), vector))
    return rows


def shown(rows):
    return {r.message_id: (r.platform, r.segment_no, r.is_new, r.reason, round(r.similarity, 9)) for r in rows}


def test_shuffled_batches_give_the_batch_result(spark, tmp_path):
    rows = talk(1, 240, ["p", "p", "q", None])
    third = len(rows) // 3
    for part in (rows[:third + 3], rows[third + 3 : 2 * third + 3], rows[2 * third + 3 :]):
        part = list(part)
        random.Random(len(part)).shuffle(part)
        feed(spark, str(tmp_path / "src"), part)
        run(spark, tmp_path, least_similarity=0.7, delay="3 hours")
    # a batch whose times lie between those of earlier ones, still within the delay, then the closing tick
    late = (900, "p", rows[-1][2] - dt.timedelta(hours=2), "b", [1.0, 0.0])
    feed(spark, str(tmp_path / "src"), [late])
    feed(spark, str(tmp_path / "src"), [(-1, "tick", T0 + dt.timedelta(days=20), None, None)])
    got = run(spark, tmp_path, least_similarity=0.7, delay="3 hours").collect()
    whole = spark.createDataFrame([*rows, late], SCHEMA)
    want = cv.segment_messages(whole, ["platform"], embedding="embedding", min_similarity=0.7).collect()
    assert len(got) == len(want) == 241 and shown(got) == shown(want)
    assert {r.reason for r in got} == {"first_message", "time_gap", "topic_change", "entity_change", None}


def test_rows_wait_for_the_watermark(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    feed(spark, str(tmp_path / "src"), [(1, "p", at(0), "a", None), (2, "p", at(100), "a", None)])
    assert {r.message_id for r in run(spark, tmp_path, delay="60 minutes").collect()} == {1}
    feed(spark, str(tmp_path / "src"), [(3, "p", at(50), "b", None), (4, "p", at(10), "a", None)])  # 4 comes too late
    feed(spark, str(tmp_path / "src"), [(5, "p", at(300), "a", None)])
    got = shown(run(spark, tmp_path, delay="60 minutes").collect())
    assert {i: (g[1], g[3]) for i, g in got.items()} == {1: (1, "first_message"), 3: (2, "entity_change"), 2: (3, "entity_change")}


def test_quiet_keys_are_forgotten(spark, tmp_path):
    at = lambda h: T0 + dt.timedelta(hours=h)
    for h, i in ((0, 1), (5, 2), (40, 3), (41, 4), (200, 5)):
        feed(spark, str(tmp_path / "src"), [(i, "p" if i < 5 else "q", at(h), "a", None)])
    got = shown(run(spark, tmp_path, delay="1 hour", ttl_ms=10 * 3_600_000).collect())
    # 40 hours is past 5 hours and the time to live, so the key starts again
    assert {i: (g[1], g[3]) for i, g in got.items()} == {1: (1, "first_message"), 2: (2, "time_gap"), 3: (1, "first_message"), 4: (1, None)}


def test_messages_of_many_keys_wait_in_few_pieces(spark, tmp_path):
    rows = [(i, f"k{i * 7919 % 3_000}", T0 + dt.timedelta(seconds=i * 5), "ab"[i % 5 == 0], [1.0, float(i % 3), 0.5]) for i in range(24_000)]
    random.Random(4).shuffle(rows)
    feed(spark, str(tmp_path / "src"), rows)
    assert not run(spark, tmp_path, least_similarity=0.7).collect()
    pieces = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "cp")).count()
    assert 0 < pieces < len(rows) / 10
    feed(spark, str(tmp_path / "src"), [(-1, "tick", T0 + dt.timedelta(days=20), None, None)])
    got = run(spark, tmp_path, least_similarity=0.7).collect()
    want = cv.segment_messages(spark.createDataFrame(rows, SCHEMA), ["platform"], embedding="embedding", min_similarity=0.7).collect()
    assert len(got) == len(want) and shown(got) == shown(want)


def test_odd_messages_of_a_long_key(spark, tmp_path):
    """Ids beside a null one and past 2^53, null topics, vectors of other lengths, more messages than a piece takes, quiet times."""
    r = random.Random(5)
    vectors = [[1.0, 0.2], [0.1, 1.0], [1.0, 0.2, 0.3], [], [0.0, 0.0], None]
    rows = [(2**60 + 2 * i + 1, r.choice(["p"] * 12 + ["q", None]), T0 + dt.timedelta(seconds=i * 60 + r.randint(0, 30)), r.choice(["a", "a", "b", None]), r.choice(vectors)) for i in range(15_000)]
    rows.append((None, "p", rows[7_000][2], "a", [1.0, 0.2]))
    third = len(rows) // 3
    for part in (rows[:third], rows[third : 2 * third], rows[2 * third :]):
        feed(spark, str(tmp_path / "src"), r.sample(part, len(part)))
    feed(spark, str(tmp_path / "src"), [(-1, "tick", T0 + dt.timedelta(days=40), None, None)])
    got = run(spark, tmp_path, least_similarity=0.7, delay="144 hours").collect()
    want = cv.segment_messages(spark.createDataFrame(rows, SCHEMA), ["platform"], embedding="embedding", min_similarity=0.7).collect()
    assert len(got) == len(want) == len(rows) and shown(got) == shown(want)


def test_repeated_content_expires(spark, tmp_path):
    schema = "doc_id long, text string, ts timestamp_ntz"
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for i, (text, h) in enumerate([("same", 0), ("same", 1), ("other", 150), ("same", 160), ("same", 161)]):
        spark.createDataFrame([(i, text, T0 + dt.timedelta(hours=h))], schema).coalesce(1).write.mode("append").parquet(src)
        stream = sj.file_stream(spark, src, spark.createDataFrame([], schema).schema, files_per_trigger=1)
        got = sj.run_to_table(sj.first_copies(stream, delay="72 hours"), "dedup", path=out, checkpoint=cp)
    # the watermark of the third batch is past the first copy's 72 hours
    assert sorted(r.doc_id for r in got.collect()) == [0, 2, 3]


def test_buffer_keeps_the_newest(spark, tmp_path):
    path = str(tmp_path / "recent")
    write = sj.newest_batches(path, [F.desc("id")], 5)
    for k, ids in enumerate(([1, 9, 3], [4, 5, 6, 7], [2, 8])):
        batch = spark.createDataFrame([(i,) for i in ids], "id long")
        write(batch, k)
        write(batch, k)  # a replay changes nothing
    assert sorted(r.id for r in sj.latest_version(spark, path).collect()) == [5, 6, 7, 8, 9]
    assert len(sj.versions(spark, path)) == 2


@pytest.mark.parametrize("n", [1, 3])
def test_closed_windows_do_not_depend_on_batches(spark, tmp_path, n):
    schema = "ts timestamp_ntz, duration double, success boolean"
    rows = [(T0 + dt.timedelta(minutes=20 * i), float(i), i % 3 > 0) for i in range(30)]
    src = str(tmp_path / "src")
    for i in range(n):
        spark.createDataFrame(rows[i::n], schema).coalesce(1).write.mode("append").parquet(src)
    stream = sj.file_stream(spark, src, spark.createDataFrame([], schema).schema)
    got = sj.run_closed(stream, sj.hourly_stats, "hours", F.lit(T0 + dt.timedelta(days=3))).collect()
    assert sorted((r.calls, r.total_duration) for r in got) == [(3, float(9 * h + 3)) for h in range(10)]


def test_averages_of_a_long_batch_hold_few_rows(spark, tmp_path):
    """30,000 rows in any order, with successes in the oldest only: what is held gives the plain fold."""
    import random

    rows = [(i, i, "p" if i % 2 else "q", i < 2_000 or (i % 2 == 0 and i % 3 == 0), float(i % 17 - 2)) for i in range(30_000)]
    want = {}
    for i, _, p, s, d in rows:
        n, ok, latency = want.get(p, (0, 1.0, 0.0))
        want[p] = (n + 1, 0.1 * s + 0.9 * ok, 0.1 * d + 0.9 * latency if s and d > 0 else latency)
    random.Random(3).shuffle(rows)
    made = spark.createDataFrame(rows, "event_id long, s long, provider string, success boolean, duration double")
    made.selectExpr("provider", "event_id", "timestamp_seconds(s + 1000000) AS ts", "success", "duration").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    sj.averages_stream(stream).writeStream.outputMode("update").format("memory").queryName("long_averages").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {r.provider: (r.calls, r.success_rate, r.avg_latency) for r in spark.table("long_averages").collect()}
    assert got.keys() == want.keys()
    for p, found in got.items():
        assert found == pytest.approx(want[p], rel=1e-12, abs=1e-12)
