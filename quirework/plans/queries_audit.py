"""Queries for audits, quality, benchmark statistics, time series and streams."""

from __future__ import annotations

from pyspark.sql import functions as F


from quirework.operators import audit, quality, timeline
from quirework.plans.registry import Tables, query
from quirework.session import fresh_dir
from quirework.sources import sinks
from quirework.streaming import jobs


@query("c1_snapshot_diff", """
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS status
    FROM (SELECT doc_id, n_chars % 2 AS state FROM documents) d FULL JOIN labels l ON d.doc_id = l.doc_id
    WHERE d.doc_id IS NULL OR l.doc_id IS NULL OR state IS DISTINCT FROM quality""")
def _(t: Tables):
    expected = t("documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("state"))
    actual = t("labels").select("doc_id", F.col("quality").alias("state"))
    return audit.snapshot_diff(expected, actual, ["doc_id"], ["state"])


@query("g3_same_sources", """
    SELECT count(*) = 0 AS same, count(*) AS differences FROM (SELECT doc_id FROM documents) d FULL JOIN (SELECT doc_id FROM labels) l
    ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def _(t: Tables):
    return audit.same_sources(t("documents").select("doc_id"), t("labels").select("doc_id"))


@query("g4_rows_minus", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t: Tables):
    return audit.rows_minus(t("documents").select("doc_id", "lang"), t("labels"), ["doc_id"])


@query("c12_audit_manifest", """
    WITH f AS (SELECT DISTINCT doc_id, key, format, name FROM export_file),
    s AS (SELECT doc_id, name, max(bytes) AS bytes FROM export_file WHERE bytes <> 7 AND format <> 'pdf' OR bytes % 10 <> 0 GROUP BY ALL)
    SELECT f.doc_id, count(*) AS files, CASE WHEN count(*) FILTER (s.name IS NULL) > 0 THEN 'file_missing'
           WHEN count(*) FILTER (bytes <= 0) > 0 THEN 'file_empty' ELSE '' END AS reason
    FROM f LEFT JOIN s ON s.doc_id = f.doc_id AND s.name = f.name GROUP BY f.doc_id""", ("export_file",))
def _(t: Tables):
    files = t("export_file")
    assets = t("asset").select(
        "doc_id", (F.col("page_no") + 1).alias("index"), "key", "kind", F.array("page_no").alias("page_numbers"), F.lit("").alias("title"),
    )
    stored = files.where("bytes <> 7 AND format <> 'pdf' OR bytes % 10 <> 0").groupBy("doc_id", "name").agg(F.max("bytes").alias("size_bytes"))
    return audit.audit_manifest(sinks.build_manifests(assets, files), stored)


@query("c14_fixtures_match", """
    WITH c AS (SELECT lang AS fixture, CASE WHEN count(*) > 60 THEN sha256(min(text)) END AS sha FROM documents GROUP BY lang),
    b AS (SELECT lang AS fixture, sha256(min(text)) AS old FROM documents GROUP BY lang)
    SELECT coalesce(bool_and(sha = old), true) AS match, count(*) AS compared FROM c LEFT JOIN b USING (fixture) WHERE sha IS NOT NULL""")
def _(t: Tables):
    digests = t("documents").groupBy(F.col("lang").alias("fixture")).agg(
        F.sha2(F.min("text"), 256).alias("sha256"), F.count(F.lit(1)).alias("n")
    )
    current = digests.select("fixture", F.when(F.col("n") > 60, F.upper("sha256")).alias("sha256"))
    return audit.fixtures_match(current, digests)


@query("c14_all_texts_match", """
    WITH c AS (SELECT doc_id AS fixture, CASE WHEN n_chars > 60 THEN sha256(CASE WHEN lang = 'de' THEN text ELSE concat(text, '') END) END AS sha FROM documents),
    b AS (SELECT doc_id AS fixture, sha256(text) AS old FROM documents WHERE n_chars % 7 <> 0)
    SELECT coalesce(bool_and(coalesce(sha = old, false)), true) AS match, count(*) AS compared FROM c LEFT JOIN b USING (fixture) WHERE sha IS NOT NULL""")
def _(t: Tables):
    digests = t("documents").select(F.col("doc_id").alias("fixture"), F.sha2("text", 256).alias("sha256"), "n_chars")
    current = digests.select("fixture", F.when(F.col("n_chars") > 60, F.upper("sha256")).alias("sha256"))
    return audit.fixtures_match(current, digests.where("n_chars % 7 <> 0").select("fixture", "sha256"))


EXISTING = """SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN concat(p_name, ' (', CAST(p_size AS STRING), ')')
    ELSE concat(p_name, ' copy') END AS name FROM """


@query("c15_free_names", rf"""
    WITH e AS ({EXISTING} part),
    taken AS (SELECT name AS base, 1 AS k FROM e UNION SELECT regexp_extract(name, '^(.*) \(([0-9]+)\)$', 1), CAST(regexp_extract(name, '^(.*) \(([0-9]+)\)$', 2) AS INT)
              FROM e WHERE regexp_matches(name, ' \([0-9]+\)$') AND NOT regexp_matches(name, ' \(1\)$')),
    w AS (SELECT p_name AS base, p_partkey AS ord, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part),
    k AS (SELECT base, unnest(range(1, n + h + 1)) AS k FROM (SELECT base, count(*) AS n, (SELECT count(*) FROM taken x WHERE x.base = w.base) AS h FROM w GROUP BY base)),
    free AS (SELECT base, k, row_number() OVER (PARTITION BY base ORDER BY k) AS r FROM k WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.base = k.base AND t.k = k.k))
    SELECT w.base, ord, CASE WHEN k = 1 THEN w.base ELSE concat(w.base, ' (', k, ')') END AS name FROM w JOIN free USING (base, r)""")
def _(t: Tables):
    wanted = t("part").select(F.col("p_name").alias("base"), F.col("p_partkey").alias("ord"))
    return audit.free_names(wanted, t.spark.sql(EXISTING + "{part}", part=t("part")))


@query("d24_batch_complete", """
    SELECT r.batch_id, count(*) AS tasks, count(DISTINCT group_id) AS groups,
           count(*) = any_value(completed) AND count(*) = any_value(variants) AND count(DISTINCT group_id) = any_value(masters) AS complete
    FROM render_task r LEFT JOIN produced USING (batch_id) GROUP BY r.batch_id""", ("render_task", "produced"))
def _(t: Tables):
    return audit.batch_complete(t("render_task"), t("produced"))


# Quality --------------------------------------------------------------------------

PIXELS = """
pixel_pages AS (
  SELECT CAST(floor(vec_id / 8) AS BIGINT) AS doc_id, CAST(floor(vec_id / 2) AS BIGINT) % 4 AS page_no, vec_id % 2 AS side,
         list_transform(embedding, lambda x: greatest(0, least(255, CAST(floor(128 + 256 * CAST(x AS DOUBLE)) AS INT)))) AS px
  FROM embeddings),
sized_pages AS (SELECT doc_id, page_no, side, CASE WHEN side = 1 AND page_no = 1 AND doc_id % 10 = 3 THEN px[1:56] ELSE px END AS px FROM pixel_pages),
pixel_pairs AS (SELECT doc_id, page_no, a.px AS a, b.px AS b FROM (SELECT * FROM sized_pages WHERE side = 0) a
                FULL JOIN (SELECT * FROM sized_pages WHERE side = 1) b USING (doc_id, page_no)),
pixels AS (SELECT doc_id, page_no, i % 8 AS x, i // 8 AS y, a[i + 1] AS a, b[i + 1] AS b FROM pixel_pairs CROSS JOIN (SELECT unnest(range(64)) AS i)
           WHERE len(a) = len(b)),
sizes AS (SELECT doc_id, count(*) FILTER (len(a) <> len(b)) AS size_mismatch FROM pixel_pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY doc_id)"""


def _sides(t: Tables):
    pixel = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.lit(128) + x.cast("double") * 256).cast("int"))))
    pages = t("embeddings").select(
        F.floor(F.col("vec_id") / 8).alias("doc_id"), (F.floor(F.col("vec_id") / 2) % 4).alias("page_no"),
        (F.col("vec_id") % 2).alias("side"), pixel.alias("pixels"), F.lit(8).alias("width"),
    )
    # Some candidates lost a row of pixels.
    short = (F.col("side") == 1) & (F.col("page_no") == 1) & (F.col("doc_id") % 10 == 3)
    pages = pages.withColumn("pixels", F.when(short, F.slice("pixels", 1, 56)).otherwise(F.col("pixels")))
    return pages.where("side = 0").drop("side"), pages.where("side = 1").drop("side")


def _pages(t: Tables):
    return quality.pair_pages(*_sides(t))


def _tiled(t: Tables):
    """Both sides come in tiles of their own size and are compared in cells of a third."""
    reference, candidate = map(quality.whole_pages, _sides(t))
    return quality.page_sums(quality.cut_pages(reference, 3, 5), quality.cut_pages(candidate, 8, 3), cell=6)


@query("c13_pair_pages", """
    SELECT doc_id, count(a) AS reference_pages, count(b) AS candidate_pages, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS pages_compared,
           count(a) = count(b) AS page_count_preserved FROM pixel_pairs GROUP BY doc_id""", extra=PIXELS)
def _(t: Tables):
    return quality.page_counts(_pages(t))


@query("d13_fidelity", """
    SELECT doc_id, mse, CASE WHEN mse = 0 THEN 99 ELSE round(20 * log10(255 / sqrt(nullif(mse, 0))), 3) END AS psnr_db, size_mismatch
    FROM (SELECT s.doc_id, size_mismatch, CASE WHEN size_mismatch = 0 THEN m END AS mse
          FROM sizes s LEFT JOIN (SELECT doc_id, sum((a - b) * (a - b)) / count(*) AS m FROM pixels GROUP BY doc_id) p USING (doc_id))""", extra=PIXELS)
def _(t: Tables):
    return quality.fidelity_of_sums(_tiled(t))


@query("d14_edge_similarity", """
    WITH box AS (SELECT p.doc_id, p.page_no, p.x, p.y, any_value(p.a) AS va, any_value(p.b) AS vb, sum(q.a) AS sa, sum(q.b) AS sb
      FROM pixels p JOIN pixels q ON q.doc_id = p.doc_id AND q.page_no = p.page_no AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1
      GROUP BY p.doc_id, p.page_no, p.x, p.y),
    e AS (SELECT doc_id, CASE WHEN x IN (0, 7) OR y IN (0, 7) THEN va ELSE least(255, greatest(0, 9 * va - sa)) END AS a,
                 CASE WHEN x IN (0, 7) OR y IN (0, 7) THEN vb ELSE least(255, greatest(0, 9 * vb - sb)) END AS b FROM box),
    r AS (SELECT doc_id, round(greatest(0, 1 - sqrt(sum((a - b) * (a - b)) / count(*)) / 255), 6) AS v FROM e GROUP BY doc_id)
    SELECT doc_id, CASE WHEN size_mismatch = 0 THEN v END AS edge_similarity, size_mismatch FROM sizes LEFT JOIN r USING (doc_id)""", extra=PIXELS)
def _(t: Tables):
    return quality.edge_similarity_of_sums(_tiled(t))


@query("d15_dark_regression", """
    WITH m AS (SELECT doc_id, max(r) AS r FROM (
      SELECT doc_id, page_no, (count(*) FILTER (b < 18) - count(*) FILTER (a < 18)) / count(*) AS r FROM pixels GROUP BY ALL) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN size_mismatch = 0 THEN round(r, 6) END AS max_dark_increase,
           CASE WHEN size_mismatch = 0 THEN r > 0.01::DOUBLE END AS dark_regression, size_mismatch FROM sizes LEFT JOIN m USING (doc_id)""", extra=PIXELS)
def _(t: Tables):
    return quality.dark_regression_of_sums(_tiled(t), limit=0.01)


@query("d16_text_preservation", r"""
    WITH c AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN concat(text, ' x') WHEN doc_id % 7 = 0 THEN lower(text) ELSE text END AS cand FROM documents),
    n AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS a, regexp_replace(cand, '\s+', '', 'g') AS b FROM c)
    SELECT doc_id, doc_id % 11 <> 0 AS page_count_preserved, a = b AS text_exact, round(length(b) / greatest(1, length(a)), 6) AS length_ratio FROM n""")
def _(t: Tables):
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" x"))).when(F.col("doc_id") % 7 == 0, F.lower("text")).otherwise(F.col("text"))

    def lines(text, sep, per_page):
        split = t("documents").select("doc_id", F.posexplode(F.split(text, sep)).alias("line_no", "text"))
        return split.withColumn("page_no", F.least(F.floor(F.col("line_no") / per_page), F.lit(2)))

    def pages(less):
        # The last page holds no text.
        last = 2 + F.col("doc_id") % 2 + 1 - less
        return t("documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("page_no"))

    # The candidate breaks its lines and pages elsewhere; only the text as a whole counts.
    return quality.text_preservation(
        lines(F.col("text"), "\n", 10), lines(changed, "[\n ]", 100), pages(F.lit(0)), pages((F.col("doc_id") % 11 == 0).cast("int"))
    )


@query("d17_bench_medians", """
    SELECT case_name, baseline, current, CASE WHEN baseline > 0 AND current > 0 THEN round(baseline / current, 3) END AS speedup FROM (
      SELECT case_name, median(seconds) FILTER (label = 'baseline') AS baseline, median(seconds) FILTER (label = 'current') AS current
      FROM bench_run GROUP BY case_name)""", ("bench_run",))
def _(t: Tables):
    return quality.bench_medians(t("bench_run"))


@query("d18_bench_gates", """
    SELECT case_name, count(DISTINCT comparable) <= 1 AS identical, bool_and(coalesce(link_count = expected_links, true)) AS links_complete,
           bool_and(bytes <= target_bytes) AS target_met, bool_and(text_preserved) AS text_kept FROM bench_run GROUP BY case_name""", ("bench_run",))
def _(t: Tables):
    return quality.bench_gates(t("bench_run"))


# Time series ------------------------------------------------------------------------

@query("e10_growth_curve", """
    WITH n AS (SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS c FROM events),
    b AS (SELECT event_type, min(ts) AS first, date_trunc('day', max(ts)) + INTERVAL '86399 seconds' AS last, count(*) AS n FROM events GROUP BY 1)
    SELECT event_type, epoch_us(ts) AS at, 'before' AS point, c - 1 AS value FROM n UNION ALL SELECT event_type, epoch_us(ts), 'after', c FROM n
    UNION ALL SELECT event_type, epoch_us(last), 'end', n FROM b
    UNION ALL SELECT event_type, epoch_us(least(TIMESTAMP '2024-01-03 00:00:00', first, last - INTERVAL '6 days')), 'start', 0 FROM b""")
def _(t: Tables):
    created = F.lit("2024-01-03").cast("timestamp")
    events = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    curve = timeline.growth_curve(events, "ts", created, "event_id", ["event_type"])
    return curve.withColumn("at", F.unix_micros("at"))


@query("e10_growth_until", """
    WITH n AS (SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS c FROM events),
    b AS (SELECT event_type, min(ts) AS first, TIMESTAMP '2024-01-20 23:59:59' AS last, count(*) AS n FROM events GROUP BY 1)
    SELECT event_type, epoch_us(least(ts, TIMESTAMP '2024-01-20 23:59:59')) AS at, 'before' AS point, c - 1 AS value FROM n
    UNION ALL SELECT event_type, epoch_us(least(ts, TIMESTAMP '2024-01-20 23:59:59')), 'after', c FROM n
    UNION ALL SELECT event_type, epoch_us(last), 'end', n FROM b
    UNION ALL SELECT event_type, epoch_us(least(TIMESTAMP '2024-01-16 00:00:00', first, last - INTERVAL '6 days')), 'start', 0 FROM b""")
def _(t: Tables):
    day = lambda text: F.lit(text).cast("timestamp")
    events = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    curve = timeline.growth_curve(events, "ts", day("2024-01-16"), "event_id", ["event_type"], day("2024-01-20 08:00:00"))
    return curve.withColumn("at", F.unix_micros("at"))


@query("e11_heartbeat_gaps", """
    WITH g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000 AS gap FROM events)
    SELECT user_id, count(*) AS ticks, max(gap) AS max_gap_ms, arg_max(event_type, (gap, -epoch_us(ts), -event_id)) FILTER (gap IS NOT NULL) AS max_gap_context,
           coalesce(max(gap) < 40000000, true) AS responsive FROM g GROUP BY user_id""")
def _(t: Tables):
    ticks = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return timeline.heartbeat_gaps(ticks, ["user_id"], "ts", "event_type", "event_id", limit_ms=40_000_000)


@query("e12_monotonic_progress", """
    WITH c AS (SELECT job_id, seq, least(greatest(progress, 0), 100) AS v FROM job_event)
    SELECT job_id, seq, max(least(v, 99)) OVER w AS reported, coalesce(v >= lag(v) OVER (PARTITION BY job_id ORDER BY seq), true) AS rises
    FROM c WINDOW w AS (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""", ("job_event",))
def _(t: Tables):
    return timeline.monotonic_progress(t("job_event"), ["job_id"]).select("job_id", "seq", "reported", "rises")


@query("e12_progress_summary", """
    WITH c AS (SELECT job_id, seq, least(greatest(progress, 0), 100) AS v FROM job_event),
    r AS (SELECT *, coalesce(v >= lag(v) OVER (PARTITION BY job_id ORDER BY seq), true) AS rises FROM c)
    SELECT job_id, count(*) AS updates, max(least(v, 99)) AS reported, bool_and(rises) AS monotonic FROM r GROUP BY job_id""", ("job_event",))
def _(t: Tables):
    return timeline.progress_summary(timeline.monotonic_progress(t("job_event"), ["job_id"]), ["job_id"])


# Streams ------------------------------------------------------------------------------

def _event_stream(t: Tables):
    """The job events as a stream over the event files, with the projection of the batch table."""
    stored = t("events")
    stream = (
        t.spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1)
        .option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    )
    kind = (
        F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "signup", "cancelled").when(F.col("event_type") == "view", "cancel_requested").otherwise("progress")
    )
    return stream.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % 4).cast("int").alias("generation"), kind.alias("kind"), F.floor("value").cast("int").alias("progress"),
    )


def _run(t: Tables, label: str, stream, mode: str = "append"):
    base = fresh_dir(t.spark, label)
    jobs.run_available(stream, f"{base}/checkpoint", f"{base}/out", mode)
    return t.spark.read.parquet(f"{base}/out")


@query("j1_preflight_stream")
def _(t: Tables):
    files = jobs.preflight_stream(t.spark, t.sf_dir, "*.parquet")
    return _run(t, "arrivals", files).select("path", "size_bytes", "reason")


@query("j2_latest_generation", """
    SELECT job_id, generation, seq, kind FROM job_event
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY generation DESC, seq DESC) = 1""", ("job_event",))
def _(t: Tables):
    newest = jobs.latest_generation(_event_stream(t).select("job_id", "generation", "seq", "kind"), ["job_id"])
    return jobs.latest_generation(_run(t, "generation", newest, "update"), ["job_id"], "batch_id").drop("batch_id")


@query("j3_progress_stream", """
    SELECT job_id, max(least(greatest(progress, 0), 99)) AS progress FROM job_event WHERE kind = 'progress' GROUP BY job_id""", ("job_event",))
def _(t: Tables):
    updates = _run(t, "progress", jobs.progress_stream(_event_stream(t)), "update")
    return jobs.latest_generation(updates, ["job_id"], "batch_id").drop("batch_id")


FIRST_END = """
    WITH e AS (SELECT * FROM job_event WHERE kind IN ('completed', 'failed', 'cancelled') QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) = 1),
    a AS (SELECT job_id, min(ts) AS asked FROM job_event WHERE kind = 'cancel_requested' GROUP BY 1)
    SELECT job_id, CASE WHEN kind = 'completed' AND asked < ts THEN 'cancelled' ELSE kind END AS state, epoch_us(ts) AS ended_at
    FROM e LEFT JOIN a USING (job_id)"""


@query("j4_first_terminal", FIRST_END, ("job_event",))
def _(t: Tables):
    events = t("job_event").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.first_terminal(events).withColumn("ended_at", F.unix_micros("ended_at"))


@query("j4_terminal_state_stream", FIRST_END, ("job_event",))
def _(t: Tables):
    states = _run(t, "terminal", jobs.terminal_state_stream(_event_stream(t), "1 day", 10**12))
    return states.withColumn("ended_at", F.unix_micros("ended_at"))


SLICES, FILES = 4, 2
SILENT_HOURS = 6


def _sliced_stream(t: Tables):
    """The job events in files by time, a few a trigger; some early messages arrive with the last files."""
    events = t("job_event").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.floor((F.unix_micros("ts") - F.lit(low)) * SLICES / F.lit(high - low + 1))
    late = (part == 0) & (F.col("seq") % 20 == 3)
    sliced = events.withColumn("part", F.when(late, SLICES - 1).otherwise(part))
    path = fresh_dir(t.spark, "job-events")
    for k in range(SLICES):
        sliced.where(F.col("part") == k).drop("part").repartition(FILES).write.mode("append").parquet(path)
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(path)


ON_TIME = f"""
on_time AS (SELECT job_id, seq, ts, generation, kind, progress FROM (
  SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS low, max(epoch_us(ts)) OVER () AS high FROM job_event)
  WHERE NOT (floor((us - low) * {SLICES} / (high - low + 1)) = 0 AND seq % 20 = 3))"""


@query("j4_silent_jobs_stream", f"""
    WITH n AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, seq) AS following, bool_or(kind = 'cancel_requested') OVER w AS asked,
                      (SELECT max(ts) FROM job_event) - INTERVAL '1 day' AS certain
               FROM on_time WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT * FROM n WHERE kind IN ('completed', 'failed', 'cancelled') OR coalesce(following, certain) - ts >= INTERVAL '{SILENT_HOURS} hours'
          QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) = 1)
    SELECT job_id, CASE WHEN kind IN ('failed', 'cancelled') THEN kind WHEN asked THEN 'cancelled' WHEN kind = 'completed' THEN kind ELSE 'failed' END AS state,
           epoch_us(ts) AS ended_at FROM e""", ("job_event",), ON_TIME)
def _(t: Tables):
    states = _run(t, "silent", jobs.terminal_state_stream(_sliced_stream(t), "1 day", SILENT_HOURS * 3_600_000, 10**12))
    return states.withColumn("ended_at", F.unix_micros("ended_at"))


@query("j2_bounded_generation", """
    SELECT job_id, generation, seq, kind FROM on_time
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY generation DESC, seq DESC) = 1""", ("job_event",), ON_TIME)
def _(t: Tables):
    events = _sliced_stream(t).select("job_id", "generation", "seq", "kind", "ts")
    updates = _run(t, "bounded", jobs.newest_stream(events, ["job_id"], ["generation", "seq"], "1 day", 20 * 86_400_000), "update")
    return jobs.latest_generation(updates, ["job_id"], "batch_id").drop("batch_id")


@query("j3_bounded_progress", """
    SELECT job_id, max(least(greatest(progress, 0), 99)) AS progress FROM on_time WHERE kind = 'progress' GROUP BY job_id""", ("job_event",), ON_TIME)
def _(t: Tables):
    capped = F.least(F.greatest(F.col("progress"), F.lit(0)), F.lit(99)).alias("progress")
    events = _sliced_stream(t).where("kind = 'progress'").select("job_id", capped, "ts")
    updates = _run(t, "bounded", jobs.newest_stream(events, ["job_id"], ["progress"], "1 day", 40 * 86_400_000), "update")
    return jobs.latest_generation(updates, ["job_id"], "batch_id").drop("batch_id")


@query("j5_heartbeat_sessions", """
    WITH g AS (SELECT job_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts) >= INTERVAL '6 hours', true) AS starts FROM job_event),
    s AS (SELECT *, sum(starts::INT) OVER (PARTITION BY job_id ORDER BY ts) AS n FROM g)
    SELECT job_id, epoch_us(min(ts)) AS first_tick, count(*) AS ticks FROM s GROUP BY job_id, n""", ("job_event",))
def _(t: Tables):
    # Without a later event the last sessions stay open, so the check uses complete mode.
    sessions = _run(t, "heartbeat", jobs.heartbeat_stream(_event_stream(t), 6 * 3_600_000, "1 hour"), "complete")
    return sessions.select("job_id", F.unix_micros("first_tick").alias("first_tick"), "ticks")
