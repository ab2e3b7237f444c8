import json
import itertools
import os
import random
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirework.operators import audit, catalog, intake, quality, timeline
from quirework.plans.queries import ORACLES, QUERIES
from quirework.schemas import MANIFEST, TABLES
from quirework.sources import files, sinks
from quirework.streaming import jobs

GIB = 1024**3


def test_snapshot_diff_is_null_safe(spark):
    old = spark.createDataFrame([(1, 5, None), (2, 5, 1), (3, 5, 1)], "doc_id long, size long, inode long")
    new = spark.createDataFrame([(1, 5, None), (2, 5, None), (4, 1, 1)], "doc_id long, size long, inode long")
    got = {r.doc_id: r.status for r in audit.snapshot_diff(old, new, ["doc_id"], ["size", "inode"]).collect()}
    assert got == {2: "changed", 3: "missing", 4: "extra"}
    assert audit.same_sources(old, old).head().same and not audit.same_sources(old, new).head().same


def test_preflight_first_rule_wins(spark):
    rows = [
        (1, "/a.PDF", 10, 5, 3, True, False, True, 10, 5), (2, "/b.pdf", None, 5, 3, False, False, True, None, 5),
        (3, "/c.txt", 10, 5, 3, False, True, True, 10, 5), (4, "/d.pdf", 4 * GIB + 1, 5, 3, False, True, True, 1, 5),
        (5, "/e.pdf", 4 * GIB, 5, 3, False, True, False, 4 * GIB, 5), (6, "/f.pdf", 10, 5, 0, False, False, True, 10, 5), (7, "/g.pdf", 10, 5, 2, True, False, True, 10, 6)]
    df = spark.createDataFrame(rows, "doc_id long, path string, size_bytes long, modified_ns long, pages int, has_forms boolean, needs_pass boolean, is_pdf boolean, size_after long, modified_after long")
    got = [(r.reason, r.pages, r.has_forms) for r in intake.preflight(df).orderBy("doc_id").collect()]
    assert got == [("", 3, True), ("missing", 0, False), ("not_a_pdf_name", 0, False), ("too_large", 0, False), ("password", 0, False), ("no_pages", 0, False), ("changed", 0, False)]


def admission(spark, queue, incoming, **more):
    q = spark.createDataFrame([(1, p) for p in queue], "queue_id int, path string")
    i = spark.createDataFrame([(1, n, p, ok) for n, (p, ok) in enumerate(incoming)], "queue_id int, ord int, path string, is_valid boolean")
    return intake.admission_counts(intake.admit(q, i, **more)).head().asDict()


def test_queue_admission(spark):
    got = admission(spark, ["/a.pdf"], [("/A.pdf", True), ("/b.pdf", True), ("/missing.pdf", False), ("/dir", False)])
    assert (got["added"], got["duplicate"], got["invalid"], got["overflow"]) == (1, 1, 2, 0)
    got = admission(spark, ["/x.pdf"], [(f"/{i}.pdf", True) for i in range(100)] + [("/0.pdf", True), ("/99.pdf", True)])
    assert (got["added"], got["duplicate"], got["overflow"]) == (99, 1, 2)


def task(i=0, page=0, box=(0.0, 0.0, 10.0, 10.0), dpi=300, quality=80, group=0, batch=1):
    return (batch, i, page, *box, dpi, quality, group)


@pytest.mark.parametrize("tasks,reasons", [
    ([task(), task(1)], ["", ""]),
    ([task(dpi=1201), task(1, quality=34)], ["dpi", "quality"]),
    ([task(), task()], ["duplicate_id"] * 2),
    ([task(box=(0.0, 0.0, float("nan"), 1.0)), task(1, box=(0.0, 5.0, 1.0, 5.0)), task(1_000_001)], ["coordinates", "no_area", "task_id"]),
    ([task(i, box=(0.0, 0.0, 720.0, 720.0), dpi=720) for i in range(40)], ["batch_pixels"] * 40),
    ([task(box=(0.0, 0.0, 2000.0, 2000.0), dpi=400)], ["task_pixels"]),
    ([task(i, box=(0.0, 0.0, 1.0, 1.0)) for i in range(4097)], ["batch_tasks"] * 4097),
])
def test_task_rules(spark, tasks, reasons):
    df = spark.createDataFrame(tasks, TABLES["render_task"])
    assert sorted(r.reason for r in intake.validate_tasks(df).collect()) == sorted(reasons)


def test_payloads(spark):
    rows = [(1, bytearray(b"\xff\xd8xx\xff\xd9")), (2, bytearray(b"\xff\xd8x")), (3, bytearray(b"\xff\xd8xx\xff\xd8"))]
    df = spark.createDataFrame(rows, "id int, content binary").withColumn("length", F.octet_length("content"))
    assert [r.reason for r in intake.check_payloads(df).orderBy("id").collect()] == ["", "size", "format"]


def test_free_names(spark):
    wanted = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", 7), ("c (2)", 1)], "base string, ord int")
    taken = spark.createDataFrame([("a",), ("a (3)",), ("a (1)",), ("b (2)",), ("c (2)",)], "name string")
    got = {(r.base, r.ord): r["name"] for r in audit.free_names(wanted, taken).collect()}
    assert got == {("a", 1): "a (2)", ("a", 3): "a (4)", ("a", 7): "a (5)", ("b", 2): "b", ("c (2)", 1): "c (2) (2)"}


def test_free_names_against_counting(spark):
    rng = random.Random(6)
    wanted, taken, want = [], [], {}
    for base in "pqrs":
        held = {rng.randint(1, 40) for _ in range(rng.choice([0, 5, 25]))}
        asked = sorted(rng.sample(range(500), 30))
        taken += [(base if n == 1 else f"{base} ({n})",) for n in held] + [(f"{base} (x)",), (f"{base} (0)",)]
        wanted += [(base, o) for o in asked]
        free = (n for n in itertools.count(1) if n not in held)
        want |= {(base, o): base if (n := next(free)) == 1 else f"{base} ({n})" for o in asked}
    got = audit.free_names(spark.createDataFrame(wanted, "base string, ord int"), spark.createDataFrame(taken, "name string"))
    assert {(r.base, r.ord): r["name"] for r in got.collect()} == want and got.schema["ord"].dataType.simpleString() == "int"


def test_ten_million_requests_for_one_name(spark):
    n = 10_000_000
    wanted = spark.range(n).select(F.lit("a").alias("base"), F.col("id").alias("ord"))
    taken = spark.range(2, 1_000_001).select(F.concat(F.lit("a ("), F.col("id") * 3, F.lit(")")).alias("name"))
    last = audit.free_names(wanted, taken).agg(F.count(F.lit(1)), F.max_by("name", "ord"), F.max_by("name", F.col("ord") == 2), F.max_by("name", F.col("ord") == 4)).first()
    # 999 999 numbers are taken below the last one; 6 is the first of them.
    assert tuple(last) == (n, f"a ({n + 999_999})", "a (3)", "a (5)")


def test_fixture_match(spark):
    schema = "fixture string, sha256 string"
    old = spark.createDataFrame([("source", "AB"), ("stress", "CD")], schema)
    assert audit.fixtures_match(spark.createDataFrame([("source", "ab"), ("stress", None)], schema), old).head().match
    assert not audit.fixtures_match(spark.createDataFrame([("source", "ab"), ("new", "EF")], schema), old).head().match


def manifests(spark):
    assets = spark.createDataFrame(
        [(1, 2, "image:4", "image", [0, 2], ""), (1, 1, "figure:0:1", "figure", [0], "Fig. 1"), (2, 1, "image:9", "image", [1], None)],
        "doc_id long, index int, key string, kind string, page_numbers array<int>, title string")
    written = spark.createDataFrame(
        [(1, "image:4", "png", "b.png", 10), (1, "figure:0:1", "svg", "a.svg", 20), (1, "figure:0:1", "png", "a.png", 30), (2, "image:9", "png", "../c.png", 5)],
        "doc_id long, key string, format string, name string, bytes long")
    return assets, written


def test_manifest_round_trip_and_audit(spark, tmp_path):
    assets, written = manifests(spark)
    path = str(tmp_path / "manifest")
    sinks.write_manifest(assets, written, path)
    back = spark.read.schema(MANIFEST).json(path)
    one = back.where("doc_id = 1").head()
    assert (one.item_count, one.figure_count, one.svg_count, one.png_count, one.payload_bytes) == (2, 1, 1, 2, 60)
    assert one.requested_formats == ["png", "svg"] and [i["index"] for i in one["items"]] == [1, 2]
    assert one["items"][0].files == {"png": "a.png", "svg": "a.svg"} and one["items"][1].source_pages == [1, 3]
    assert one["items"][1].title is None
    with pytest.raises(Exception, match="already exists"):
        sinks.write_manifest(assets, written, path)
    stock = spark.createDataFrame([(1, "b.png", 10), (1, "a.svg", 20), (1, "a.png", 30), (2, "../c.png", 5)], "doc_id long, name string, size_bytes long")
    check = lambda m, s: {r.doc_id: r.reason for r in audit.audit_manifest(m, s).collect()}
    assert check(back, stock) == {1: "", 2: "unsafe_name"}
    assert check(back, stock.where("name <> 'a.svg'"))[1] == "file_missing"
    assert check(back, stock.withColumn("size_bytes", F.lit(0)))[1] == "file_empty"
    assert check(back.withColumn("item_count", F.lit(9)), stock)[1] == "item_count"


def test_oversized_exports_are_refused(spark, tmp_path):
    assets = spark.range(20_001).select(
        F.lit(1).cast("long").alias("doc_id"), (F.col("id") + 1).cast("int").alias("index"), F.concat(F.lit("image:"), "id").alias("key"),
        F.lit("image").alias("kind"), F.array(F.lit(0)).alias("page_numbers"), F.lit("").alias("title"))
    small, written = manifests(spark)
    both = assets.unionByName(small.where("doc_id = 2"))
    assert [tuple(r) for r in sinks.refused_manifests(both).collect()] == [(1, 20_001, "too_many_items")]
    assert [r.doc_id for r in sinks.build_manifests(both, written).collect()] == [2]
    refused = sinks.write_manifest(both, written, str(tmp_path / "m"))
    assert [(r.doc_id, r.reason) for r in refused.collect()] == [(1, "too_many_items")]
    assert [r.doc_id for r in spark.read.schema(MANIFEST).json(str(tmp_path / "m")).collect()] == [2]


def test_publish_keeps_the_old_result_on_failure(spark, tmp_path):
    dest = str(tmp_path / "current")
    shown = lambda: spark.read.parquet(sinks.published_path(spark, dest)).count()
    none_bad = lambda d: d.where("id < 0")
    with pytest.raises(FileNotFoundError):
        sinks.published_path(spark, dest)
    first = sinks.publish(spark.range(3), dest, [none_bad])
    assert shown() == 3
    changed = lambda: spark.range(1)
    for checks, limit, moved in (([lambda d: d.where("id > 3")], None, None), ([none_bad], 1, None), ([none_bad], None, changed)):
        with pytest.raises(sinks.PublishRefused):
            sinks.publish(spark.range(5), dest, checks, max_bytes=limit, unchanged=moved)
        assert shown() == 3
    second = sinks.publish(spark.range(5), dest, [none_bad], unchanged=lambda: spark.range(0))
    assert shown() == 5
    third = sinks.publish(spark.range(6), dest, [none_bad])
    assert shown() == 6
    versions = sorted(n for n in os.listdir(dest) if n.startswith("v-"))
    assert versions == sorted([second, third]) and first not in versions


def test_two_publishers_at_once(spark, tmp_path):
    dest = str(tmp_path / "shared")
    shown = lambda: spark.read.parquet(sinks.published_path(spark, dest)).count()
    folders = lambda: {n for n in os.listdir(dest) if n.startswith("v-")}
    first = sinks.publish(spark.range(2), dest, [])
    inner = {}

    def meanwhile():
        """Others publish three times while this one has written its version and not yet committed it."""
        mine = folders() - {first}
        assert len(mine) == 1
        for k in (3, 4, 5):
            inner[k] = sinks.publish(spark.range(k), dest, [])
        # Their clean-up deleted what their commits replaced, and not the folder that no commit names.
        assert folders() == {inner[4], inner[5]} | mine
        return spark.range(0)

    with pytest.raises(sinks.PublishConflict):
        sinks.publish(spark.range(9), dest, [], unchanged=meanwhile)
    assert shown() == 5 and folders() == {inner[4], inner[5]}
    # The loser begins again and succeeds.
    again = sinks.publish(spark.range(9), dest, [])
    assert shown() == 9 and folders() == {inner[5], again}


def test_a_commit_that_is_not_wholly_written(spark, tmp_path):
    dest = str(tmp_path / "shared")
    sinks.publish(spark.range(2), dest, [])
    assert not sinks._commit(spark, dest, 1, "v-other")
    (tmp_path / "shared" / "_log" / f"{2:020d}").write_text("v-hal")
    assert spark.read.parquet(sinks.published_path(spark, dest)).count() == 2
    sinks.publish(spark.range(7), dest, [])
    assert spark.read.parquet(sinks.published_path(spark, dest)).count() == 7
    assert sinks._commits(spark, dest) == [1, 2, 3]


def test_inventory_and_tables(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_bytes(b"x" * 1024)
    (tmp_path / "in" / "sub" / "b.pdf").write_bytes(b"y")
    (tmp_path / "in" / "c.txt").write_bytes(b"no")
    rows = files.file_inventory(spark, str(tmp_path / "in"), with_hash=True).orderBy("name").collect()
    assert [(r.name, r.size_bytes, r.size_mib) for r in rows] == [("a.pdf", 1024, 0.001), ("b.pdf", 1, 0.0)]
    assert len(rows[0].sha256) == 64 and rows[0].sha256 == rows[0].sha256.upper()
    spark.createDataFrame([(1, 2, 3)], TABLES["stream_size"]).write.json(str(tmp_path / "t" / "stream_size"))
    assert files.load_tables(spark, str(tmp_path / "t"), "json", ["stream_size"])["stream_size"].head().bytes == 3


def test_reports(spark, tmp_path):
    report = {
        "label": "old", "fixtures": {"source": {"name": "a.pdf", "bytes": 5, "pages": 2, "sha256": "AB"}, "stress": {"sha256": "CD"}},
        "runs": [
            {"case": "scan", "label": "baseline", "seconds": 5.0, "pages": 48}, {"case": "scan", "label": "current", "seconds": 2.0},
            {"case": "scan", "label": "baseline", "seconds": 6.0}, {"case": "scan", "label": "baseline", "seconds": 9.0},
            {"case": "merge", "label": "baseline", "seconds": 1.0, "bytes": 7, "native": True}]}
    (tmp_path / "r.json").write_text(json.dumps(report, indent=1))
    runs = files.load_runs(spark, str(tmp_path / "r.json"))
    assert runs.count() == 5
    medians = {r.case_name: (r.baseline, r.current, r.speedup) for r in quality.bench_medians(runs).collect()}
    assert medians == {"scan": (6.0, 2.0, 3.0), "merge": (1.0, None, None)}
    assert sorted(r.fixture for r in files.load_fixtures(spark, str(tmp_path / "r.json")).collect()) == ["source", "stress"]


def test_image_needs_every_page_allowed(spark):
    place = spark.createDataFrame(
        [(1, 0, 0, 5, 0, 10, 10, 0.0, 0.0, 1.0, 1.0), (1, 1, 0, 5, 0, 10, 10, 0.0, 0.0, 1.0, 1.0), (1, 1, 1, 6, 8, 9, 9, 0.0, 0.0, 1.0, 1.0)], TABLES["image_placement"])
    allowed = spark.createDataFrame([(1, 1)], "doc_id long, page_no int")
    assert [r.xref for r in catalog.images_within(place, allowed).collect()] == [6]


def test_selection_none_and_empty(spark):
    assets = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, key string")
    assert catalog.apply_selection(assets, None).count() == 2
    assert catalog.apply_selection(assets, assets.where("false")).count() == 0


def ticks(spark, rows):
    return spark.createDataFrame(rows, "job_id long, seq long, us long").select("job_id", "seq", F.timestamp_micros("us").alias("ts"))


def test_heartbeat_gap_and_progress(spark):
    df = ticks(spark, [(1, 0, 0), (1, 1, 16_000), (1, 2, 266_000), (1, 3, 270_000), (2, 0, 5)]).withColumn("status", F.concat(F.lit("s"), F.col("seq")))
    got = {r.job_id: r for r in timeline.heartbeat_gaps(df, ["job_id"], "ts", "status", "seq").collect()}
    assert (got[1].ticks, got[1].max_gap_ms, got[1].max_gap_context, got[1].responsive) == (4, 250.0, "s2", False)
    assert (got[2].max_gap_ms, got[2].responsive) == (None, True)
    events = spark.createDataFrame([(1, 0, -5), (1, 1, 40), (1, 2, 30), (1, 3, 150)], "job_id long, seq long, progress int")
    run = timeline.monotonic_progress(events, ["job_id"])
    assert [(r.reported, r.rises) for r in run.orderBy("seq").collect()] == [(0, True), (40, True), (40, False), (99, True)]
    assert timeline.progress_summary(run, ["job_id"]).head().monotonic is False


def test_growth_curve(spark):
    day = 86_400_000_000
    df = ticks(spark, [(1, i, i * day // 2) for i in range(3)])
    curve = timeline.growth_curve(df, "ts", F.timestamp_micros(F.lit(day)), "seq", ["job_id"])
    rows = [(r.us, r.point, r.value) for r in curve.select(F.unix_micros("at").alias("us"), "point", "value").collect()]
    assert (2 * day - 1_000_000 - 6 * day, "start", 0) in rows and (2 * day - 1_000_000, "end", 3) in rows
    assert sorted(v for _, p, v in rows if p == "before") == [0, 1, 2]


# Streams ---------------------------------------------------------------------------

def event_stream(spark, path, batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "job_id long, seq long, us long, kind string, progress int").select(
            "job_id", "seq", F.timestamp_micros(F.col("us") + 10**12).alias("ts"), F.lit(0).alias("generation"), "kind", "progress"
        ).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(TABLES["job_event"]).option("maxFilesPerTrigger", 1).parquet(path)


def test_terminal_states_with_silence(spark, tmp_path):
    second = 1_000_000
    batches = [
        [(1, 0, 0, "progress", 5), (2, 0, 0, "progress", 5), (3, 0, 0, "cancel_requested", 0), (4, 0, 0, "cancel_requested", 0)],
        [(1, 1, second, "completed", 0), (1, 2, 2 * second, "failed", 0), (4, 1, second, "completed", 0), (5, 0, second, "failed", 0)],
        [(6, 0, 500 * second, "progress", 1)], [(6, 1, 501 * second, "progress", 2)], [(6, 2, 502 * second, "progress", 2)]]
    stream = jobs.terminal_state_stream(event_stream(spark, str(tmp_path / "in"), batches), "1 second", 10_000)
    jobs.run_available(stream, str(tmp_path / "ck"), str(tmp_path / "out"))
    got = {r.job_id: r.state for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "completed", 2: "failed", 3: "cancelled", 4: "cancelled", 5: "failed"}


def test_silence_late_messages_and_retention(spark, tmp_path):
    second = 1_000_000
    batches = [
        # 1 ends twice, 2 falls silent, 3 after a cancel request, 4 between two messages, 5 has only a cancel request and an end.
        [(1, 0, 0, "completed", 0), (2, 0, 0, "progress", 1), (3, 0, second, "cancel_requested", 0), (4, 0, 0, "progress", 0), (4, 1, 9 * second, "progress", 0)],
        [(1, 1, 5 * second, "failed", 0), (4, 2, 20 * second, "completed", 0), (5, 0, 20 * second, "cancel_requested", 0), (5, 1, 21 * second, "completed", 0)],
        # 2 comes back when it is settled, 6 is too late to be heard, 1 opens anew long after its retention.
        [(2, 1, 60 * second, "completed", 0), (6, 0, 2 * second, "failed", 0), (7, 0, 60 * second, "progress", 0)],
        [(8, 0, 500 * second, "progress", 0)], [(6, 1, 2 * second, "failed", 0), (1, 2, 501 * second, "failed", 0)], [(8, 1, 502 * second, "progress", 0)],
    ]
    stream = jobs.terminal_state_stream(event_stream(spark, str(tmp_path / "in"), batches), "1 second", 10_000, 100_000)
    jobs.run_available(stream, str(tmp_path / "ck"), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).selectExpr("job_id", "state", "unix_micros(ended_at) - 1000000000000 AS us").collect()
    assert sorted(tuple(r) for r in rows) == [
        (1, "completed", 0), (1, "failed", 501 * second), (2, "failed", 0), (3, "cancelled", second), (4, "failed", 9 * second),
        (5, "cancelled", 21 * second), (7, "failed", 60 * second)]


def test_state_of_idle_keys_is_deleted(spark, tmp_path):
    second = 1_000_000
    batches = [
        [(k, 0, 0, "progress", 7) for k in range(40)], [(100, 0, 60 * second, "progress", 1)],
        # The rows of the forty are gone, their marks are not: an older report does not come back, a newer one counts.
        [(1, 1, 61 * second, "progress", 3), (2, 1, 61 * second, "progress", 9), (100, 1, 62 * second, "progress", 1)],
        [(100, 2, 900 * second, "progress", 2)], [(100, 3, 901 * second, "progress", 3)], [(100, 4, 902 * second, "progress", 4)],
    ]
    events = event_stream(spark, str(tmp_path / "in"), batches).select("job_id", "progress", "ts")
    stream = jobs.newest_stream(events, ["job_id"], ["progress"], "1 second", 50_000)
    sizes = []

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch_id={batch_id}"))

    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).outputMode("update").foreachBatch(keep).start()
    query.awaitTermination()
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(sizes) >= 80 and sizes[-1] < 20
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.job_id, r.progress) for r in rows.where("job_id IN (1, 2, 3)").collect()) == [(1, 7), (2, 7), (2, 9), (3, 7)]
    assert jobs.latest_generation(rows, ["job_id"], "batch_id").where("job_id = 100").head().progress == 4


def test_new_files_are_seen_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.pdf").write_bytes(b"x")
    (source / "b.txt").write_bytes(b"x")
    run = lambda: jobs.run_available(jobs.preflight_stream(spark, str(source)), str(tmp_path / "ck"), str(tmp_path / "out"))
    run()
    (source / "c.pdf").write_bytes(b"y")
    run()
    rows = sorted((r.path.rsplit("/", 1)[1], r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [("a.pdf", ""), ("c.pdf", "")]


def test_stalls_start_new_sessions(spark, tmp_path):
    rows = [(1, 0, 0), (1, 1, 249_999), (1, 2, 499_999), (1, 3, 800_000)]
    stream = event_stream(spark, str(tmp_path / "in"), [[(*r, "progress", 0) for r in rows]])
    jobs.run_available(jobs.heartbeat_stream(stream), str(tmp_path / "ck"), str(tmp_path / "out"), "complete")
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("first_tick").collect()
    assert [r.ticks for r in got] == [2, 1, 1]


def test_payload_sql_knows_the_sizes(spark, tmp_path):
    rows = [(1, "abc", "fr"), (2, "abc", "en"), (3, None, "en"), (4, "abcdef", "fr"), (5, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    mine = sorted(tuple(r) for r in QUERIES["b21_check_payloads"](spark, str(tmp_path)).collect())
    assert mine == [(1, "size"), (2, ""), (3, "size"), (4, "format"), (5, "size")]
    assert sorted(con.execute(ORACLES["b21_check_payloads"]).fetchall()) == mine


def test_payload_of_marks_alone_is_sound(spark, tmp_path):
    """An empty marked text is four bytes, which are no characters."""
    texts = ["", "a", "é", "日本", "a\0b", None]
    rows = [(k, text, lang) for k, (text, lang) in enumerate((t, m) for t in texts for m in ("en", "fr"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    mine = sorted(tuple(r) for r in QUERIES["b21_check_payloads"](spark, str(tmp_path)).collect())
    assert mine[:4] == [(0, ""), (1, "size"), (2, ""), (3, "size")]
    assert sorted(con.execute(ORACLES["b21_check_payloads"]).fetchall()) == mine


def test_stream_handlers_ask_for_few_state_calls(monkeypatch):
    """A message leaves an early timer alone; that one asks for the next, and settles when it is due."""
    calls = []

    class State:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value
            calls.append("update")

        def clear(self):
            self.value = None

    class Handle:
        timers = set()

        def getValueState(self, name, schema):
            return State()

        def registerTimer(self, at):
            self.timers.add(at)
            calls.append("register")

        def deleteTimer(self, at):
            self.timers.discard(at)
            calls.append("delete")

    class Times:
        def __init__(self, watermark):
            self.watermark = watermark

        def getCurrentWatermarkInMs(self):
            return self.watermark

    def rows(*seconds):
        return iter([pd.DataFrame({"kind": ["progress"], "seq": [s], "ts": [pd.Timestamp(s, unit="s")]}) for s in seconds])

    states = jobs._TerminalStates(10_000, 100_000)
    states.init(Handle())
    for k in range(4):
        assert not list(states.handleInputRows((1,), rows(3 * k + 1, 3 * k + 2), Times(0)))
    assert calls == ["update", "register", "update", "update", "update"] or calls == ["register", "update", "update", "update", "update"]
    assert Handle.timers == {12_000}
    assert not list(states.handleExpiredTimer((1,), Times(13_000), None)) and 21_000 in Handle.timers
    assert [tuple(f.iloc[0]) for f in states.handleExpiredTimer((1,), Times(21_000), None)] == [(1, "failed", pd.Timestamp(11, unit="s"))]
