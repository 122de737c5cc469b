"""Streams, providers and files."""

from __future__ import annotations

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from montage.operators import control, deliver, politeness
from montage.sources import files, providers
from montage.streaming import watch


def test_watched_names_count_once_over_restarts(spark, tmp_path):
    inbox, ledger, check = tmp_path / "in", str(tmp_path / "ledger"), str(tmp_path / "check")
    inbox.mkdir()

    def go():
        arrived = watch.first_arrivals(watch.watch_folder(spark, str(inbox), ("wav",))).select("key", "bytes")
        watch.deliver(arrived, check, lambda b, _: b.write.mode("append").parquet(ledger)).awaitTermination()

    (inbox / "a.wav").write_bytes(b"one")
    (inbox / "empty.wav").write_bytes(b"")
    (inbox / "note.txt").write_bytes(b"x")
    go()
    (inbox / "A.WAV".replace("WAV", "wav")).write_bytes(b"two")
    (inbox / "b.wav").write_bytes(b"three")
    go()
    assert sorted(r.key for r in spark.read.parquet(ledger).collect()) == ["a.wav", "b.wav"]


def test_rate_limit_stream_equals_the_batch(spark, tmp_path):
    rows = [("h", 0, False), ("h", 100, True), ("h", 200, False), ("h", 3000, False), ("g", 50, False)]
    schema = "host string, at_ms long, refused boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = watch.limit_hosts(stream).writeStream.format("memory").queryName("waits").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = politeness.host_waits(spark.createDataFrame([(h, t, i, r) for i, (h, t, r) in enumerate(rows)], "host string, at_ms long, seq int, refused boolean"))
    assert sorted((r.host, r.at_ms, r.wait_ms) for r in spark.table("waits").collect()) == sorted((r.host, r.at_ms, r.wait_ms) for r in batch.collect())


POLLS = "path string, bytes long, seen_at timestamp"


def _plain_stable(polls, quiet_s=3.0):
    out = {}
    for path in {p for p, _, _ in polls} - {None}:
        mine = [(at, size) for p, size, at in polls if p == path]
        size = max(((at, size) for at, size in mine if size is not None), default=(None, None))[1]
        changed = max((at for at, other in mine if other is not None and other != size), default=None)
        after = [at for at, _ in mine if changed is None or at > changed]
        if size and after and (max(at for at, _ in mine) - min(after)).total_seconds() >= quiet_s:
            out[path] = (size, min(after))
    return out


def _polls(n=600):
    """Files that grow, shrink, stay and are empty; polls out of order and repeated, two sizes at one time, unknown sizes and a file without a name."""
    draw, start = random.Random(7), datetime.datetime(2024, 1, 1)
    polls = [(f"f{k % 20}", k // 20 // (k % 20 + 1) % 3, start + datetime.timedelta(milliseconds=500 * (k // 20) + k % 7)) for k in range(n)]
    at = lambda s: start + datetime.timedelta(seconds=s)
    polls += [("tie", 1, at(0)), ("tie", 2, at(0)), ("tie", 2, at(4)), ("tie", 2, at(7)), ("end", 5, at(0)), ("end", 5, at(9)), ("end", 6, at(9)), ("unknown", 3, at(0)), ("unknown", None, at(5)), ("one", 3, at(0)), (None, 4, at(0)), (None, 4, at(9)), ("zero", 0, at(0)), ("zero", 0, at(9))]
    polls += [("gap", 1, at(0)), ("gap", None, at(1)), ("gap", 2, at(2)), ("gap", 2, at(4)), ("short", 2, at(0)), ("short", 2, at(2.999))]
    draw.shuffle(polls)
    return polls + polls[:50]


def test_stable_files_equal_a_plain_count(spark):
    want = _plain_stable(_polls())
    got = {r.path: (r.bytes, r.since) for r in watch.stable(spark.createDataFrame(_polls(), POLLS).repartition(3)).collect()}
    assert got == want and {"tie", "unknown", "gap"} < set(got) and not {"end", "one", "zero", "short"} & set(got)


def test_stable_files_of_a_stream_equal_a_plain_count(spark, tmp_path):
    polls = _polls()
    for part in (polls[:300], polls[300:]):
        spark.createDataFrame(part, POLLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = watch.stable(spark.readStream.schema(POLLS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    seen = {}
    stream.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.update({r.path: (r.bytes, r.since) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    want = _plain_stable(polls)
    assert {p: seen.get(p) for p in want} == want


@pytest.mark.parametrize("streaming", [False, True])
def test_stable_files_take_time_in_proportion_to_polls(spark, tmp_path, streaming):
    at = F.timestamp_micros(F.col("id") * 1000)
    spark.range(20_000).select(F.lit("a").alias("path"), F.when(F.col("id") < 100, 1).otherwise(2).cast("long").alias("bytes"), at.alias("seen_at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    reader = spark.readStream if streaming else spark.read
    found, got, began = watch.stable(reader.schema(POLLS).parquet(str(tmp_path / "in"))).withColumn("since", F.unix_millis("since")), [], time.time()
    if streaming:
        found.writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    else:
        got = found.collect()
    assert [tuple(r) for r in got] == [("a", 2, 100)] and time.time() - began < 60


def test_candidate_source(spark):
    got = providers.read_candidates(spark, ["x", "y"], limit=7).collect()
    assert len(got) == 14 and {r["query"] for r in got} == {"x", "y"}
    assert providers.resolve("images", "nowhere") == "fake"
    with pytest.raises(LookupError):
        providers.resolve("video", "nowhere")


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text('{"project": "p", "segments": [{"id": 1, "words": [{"word": "hi", "start": 0.0, "end": 0.5}]}]}')
    assert files.read_transcripts(spark, str(tmp_path / "t")).first().segments[0].words[0].word == "hi"
    assert [r.name for r in files.list_files(spark, str(tmp_path / "t")).collect()] == ["a.json"]
    table = spark.createDataFrame([("p", 1), ("q", 2)], "project string, v int")
    files.write_stage(table, str(tmp_path / "stage"))
    files.write_stage(table.where("project = 'p'").withColumn("v", F.lit(9)), str(tmp_path / "stage"))
    assert {(r.project, r.v) for r in spark.read.parquet(str(tmp_path / "stage")).collect()} == {("p", 9), ("q", 2)}


def test_replacing_a_segment_keeps_clips(spark):
    schema = "project string, index int, kind string, path string"
    old = spark.createDataFrame([("p", 1, "clip", "c"), ("p", 1, "image", "a"), ("p", 2, "image", "b")], schema)
    new = spark.createDataFrame([("p", 1, "image", "z")], schema)
    assert sorted(r.path for r in control.replace_segment(old, new).collect()) == ["b", "c", "z"]


@pytest.mark.parametrize(("c", "band"), [(0.95, "high"), (0.85, "high"), (0.849, "medium"), (0.60, "medium"), (0.59, "low"), (0.0, "low")])
def test_bands(spark, c, band):
    assert spark.range(1).select(deliver.confidence_band(F.lit(c)).alias("b")).first().b == band


def test_heartbeat_hears_of_progress_and_end(spark, tmp_path):
    beats = []
    listener = watch.Heartbeat(lambda name, batch, rows: beats.append((name, batch, rows)))
    spark.streams.addListener(listener)
    try:
        spark.range(3).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        stream.writeStream.queryName("pulse").format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        import time

        for _ in range(50):
            if ("pulse", None, None) in beats:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert ("pulse", 0, 3) in beats and ("pulse", None, None) in beats


def test_overrides(spark):
    from montage.operators import lexicon

    fixed, never = lexicon.overrides_from_mapping(spark, {"corrections": [{"original": " Val  RON", "resolved": "Vowrawn"}, {"original": "x"}, "odd"], "never_correct": ["Baras"]})
    assert [tuple(r) for r in fixed.collect()] == [("val ron", "Vowrawn")] and [r.key for r in never.collect()] == ["baras"]
    assert lexicon.overrides_from_mapping(spark, None)[0].count() == 0
