"""Sessions, attempts and job events, from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attempts as at
from ..operators import bundles, jobs
from ..operators import sessions as ss
from .base import query

_S = """l AS (SELECT user_id AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS pos, concat('https://e.example/', event_id % 700) AS url FROM events),
sv0 AS (SELECT user_id + 3 AS session_id, concat('https://e.example/', event_id % 500) AS url, max(event_id) AS e FROM events GROUP BY ALL),
sv AS (SELECT session_id, url, concat('Title ', e) AS title FROM sv0)"""


def meta(t):
    urls = F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.concat(F.lit("https://e.example/"), F.col("event_id") % 700).alias("url")))), lambda x: x["url"])
    return t.events.groupBy(F.col("user_id").alias("session_id")).agg(urls.alias("urls"), F.max("event_type").alias("status"), F.max("ts").alias("updated_at"))


def saved(t):
    # of other sessions than the listed ones in part, and of other links
    return t.events.groupBy((F.col("user_id") + 3).alias("session_id"), F.concat(F.lit("https://e.example/"), F.col("event_id") % 500).alias("url")).agg(F.concat(F.lit("Title "), F.max("event_id")).alias("title"))


@query("session_urls", f"WITH {_S} SELECT session_id, pos, url FROM l")
def _(t):
    return ss.session_urls(meta(t))


@query("remaining_urls", f"WITH {_S} SELECT session_id, url, pos FROM l WHERE (session_id, url) NOT IN (SELECT (session_id, url) FROM sv)")
def _(t):
    return ss.remaining_urls(ss.session_urls(meta(t)), saved(t))


@query("resumed_urls", f"WITH {_S} SELECT session_id, url, pos, title, 'success' AS status, true AS resumed FROM l JOIN sv USING (session_id, url)")
def _(t):
    return ss.resumed_urls(ss.session_urls(meta(t)), saved(t))


@query("title_lookup", f"WITH {_S} SELECT session_id, url, pos, coalesce(title, '') AS title FROM l LEFT JOIN sv USING (session_id, url)")
def _(t):
    return ss.title_lookup(ss.session_urls(meta(t)), saved(t))


@query("session_list", f"""WITH {_S}, m AS (SELECT user_id AS session_id, count(*) AS total, max(event_type) AS status, max(ts) AS updated_at FROM events GROUP BY 1), n AS (SELECT session_id, count(*) AS saved FROM sv GROUP BY 1)
SELECT session_id, CAST(coalesce(total, 0) AS INTEGER) AS total, coalesce(saved, 0) AS saved, coalesce(status, 'unknown') AS status, updated_at FROM m FULL JOIN n USING (session_id)""")
def _(t):
    return ss.session_list(meta(t), saved(t))


@query("session_detail", f"""WITH {_S}, j AS (SELECT coalesce(l.session_id, sv.session_id) AS session_id, l.pos, coalesce(l.url, sv.url) AS url, sv.url IS NOT NULL AS have FROM l FULL JOIN sv ON l.session_id = sv.session_id AND l.url = sv.url)
SELECT session_id, CASE WHEN count(pos) > 0 THEN count(pos) ELSE count_if(have) END AS total, coalesce(list(url ORDER BY pos) FILTER (have AND pos IS NOT NULL), []) AS saved_urls, coalesce(list(url ORDER BY pos) FILTER (NOT have), []) AS remaining FROM j GROUP BY session_id""")
def _(t):
    return ss.session_detail(meta(t), saved(t))


@query("session_bundle", f"""WITH {_S}, o AS (SELECT session_id, url, min(pos) AS pos FROM l GROUP BY ALL), r AS (SELECT session_id, url, pos, title, 'ok' AS status FROM o JOIN sv USING (session_id, url))
SELECT session_id AS bundle, url, pos, title, status FROM r UNION ALL SELECT DISTINCT session_id, NULL, NULL, NULL, 'empty' FROM l WHERE session_id NOT IN (SELECT session_id FROM r)""")
def _(t):
    return ss.session_bundle(ss.session_urls(meta(t)), saved(t))


@query("session_status", "SELECT user_id AS session_id, arg_max(event_type, event_id) AS status, max(ts) AS updated_at FROM events GROUP BY 1")
def _(t):
    return ss.session_status(t.events.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq")))


_UPD = "CASE event_id % 4 WHEN 0 THEN 'not a time' WHEN 1 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END"


@query("stale_sessions", "SELECT event_id AS session_id FROM events WHERE event_id % 4 <> 0 AND date_trunc('second', ts) < TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 7 DAY")
def _(t):
    text = F.when(F.col("event_id") % 4 == 0, "not a time").when(F.col("event_id") % 4 == 1, "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = t.events.select(F.col("event_id").alias("session_id"), text.alias("updated_at"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("dir_mtime"))
    return ss.stale_sessions(rows, F.lit("2024-01-25 00:00:00").cast("timestamp")).select("session_id")


@query("purge_expired", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 7 HOUR)")
def _(t):
    old = t.events.groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last")).where(F.col("last") < F.lit("2024-01-30 20:00:00").cast("timestamp") - F.expr("interval 7 hours"))
    return ss.purge_expired(t.events.select("event_id", "user_id"), old, "user_id")


@query("upsert_articles", """WITH o AS (SELECT DISTINCT ON (session_id, url) user_id AS session_id, concat('https://e.example/', event_id % 90) AS url, event_id AS version FROM events ORDER BY session_id, url, event_id DESC)
SELECT session_id, url, version, substr(sha256(url), 1, 16) AS url_key FROM o""")
def _(t):
    rows = t.events.select(F.col("user_id").alias("session_id"), F.concat(F.lit("https://e.example/"), F.col("event_id") % 90).alias("url"), F.col("event_id").alias("version"))
    store = ss.latest(rows.where("version < 5000"), ["session_id", "url"], [F.desc("version")])
    return ss.upsert_articles(store, rows.where("version >= 5000"), ["version"])


@query("upsert_session_status", """WITH m AS (SELECT user_id AS session_id, count(*) AS n, max(event_id) AS u FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), c AS (SELECT user_id + 2 AS session_id, arg_max(event_type, event_id) AS status, max(event_id) AS u FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT session_id, n, CASE WHEN c.status IS NOT NULL THEN c.status ELSE 'running' END AS status, coalesce(c.u, m.u) AS updated_at FROM m FULL JOIN c USING (session_id)""")
def _(t):
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    old = t.events.where(early).groupBy(F.col("user_id").alias("session_id")).agg(F.array_sort(F.collect_list("event_id")).alias("urls"), F.lit("running").alias("status"), F.max("event_id").alias("updated_at"))
    new = t.events.where(~early).groupBy((F.col("user_id") + 2).alias("session_id")).agg(F.lit(None).cast("array<bigint>").alias("urls"), F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("updated_at"))
    return ss.upsert_session_status(old, new).select("session_id", F.when(F.col("urls").isNotNull(), F.size("urls")).alias("n"), "status", "updated_at")


@query("write_archive_manifest", """WITH f AS (SELECT o_custkey AS batch, o_orderkey AS pos, concat('youtube_video_', o_orderkey, '.mp4') AS filename, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes FROM orders)
SELECT batch, CASE WHEN count(*) > 1 THEN concat('youtube_video_batch_', substr(sha256(string_agg(filename, chr(10) ORDER BY pos)), 1, 12), '.zip') END AS archive, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM f GROUP BY batch""")
def _(t):
    files = t.orders.select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("youtube_video_"), "o_orderkey", F.lit(".mp4")).alias("filename"), F.floor("o_totalprice").cast("long").alias("size_bytes"))
    return bundles.archive_manifest(files, "video")


@query("read_session_meta", """SELECT user_id AS session_id, CASE WHEN user_id % 7 <> 0 THEN count(*) END AS total, CASE WHEN user_id % 7 <> 0 THEN max(event_type) END AS status FROM events GROUP BY user_id""")
def _(t):
    from ..sources.readers import read_session_meta

    g = t.events.groupBy("user_id").agg(F.to_json(F.struct(F.count("*").alias("total"), F.max("event_type").alias("status"))).alias("body"))
    broken = F.when(F.col("user_id") % 7 == 0, "{oops").otherwise(F.col("body"))
    return read_session_meta(g.withColumn("body", broken), "user_id", "body").select("session_id", F.col("total").cast("long").alias("total"), "status")


@query("read_article_store", "SELECT url, html AS content, CASE WHEN page_id % 3 <> 0 THEN TIMESTAMP '2024-01-02 03:04:05' END AS published_at FROM pages")
def _(t):
    from ..sources.readers import read_article_store
    from ..sources.sinks import scratch

    at = F.when(F.col("page_id") % 3 == 0, "some day").otherwise("2024-01-02T03:04:05")
    t.pages.select("url", F.col("html").alias("content"), at.alias("published_at")).write.json(folder := scratch(t.spark, "store"))
    return read_article_store(t.spark, folder, lines=True).select("url", "content", "published_at")


# --- attempts ---

_I = """i AS (SELECT user_id AS batch, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN 'thread' ELSE 'web' END AS kind, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'unsupported' ELSE 'ok' END AS outcome,
concat('https://e.example/', event_id % 500) AS url, CASE event_type WHEN 'error' THEN concat('boom ', event_id % 7) WHEN 'signup' THEN 'Unsupported URL' END AS error, event_id % 3 + 1 AS files FROM events)"""
_STREAK = f"""{_I}, lo AS (SELECT *, max(CASE WHEN outcome = 'ok' THEN pos END) OVER (PARTITION BY batch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ok FROM i),
s AS (SELECT lo.*, CAST((SELECT count(*) FROM i f WHERE f.batch = lo.batch AND f.outcome = 'failed' AND f.pos < lo.pos AND f.pos > coalesce(lo.last_ok, -1)) AS INTEGER) AS streak FROM lo)"""


def items(t):
    e = F.col("event_type")
    return t.events.select(
        F.col("user_id").alias("batch"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 == 0, "thread").otherwise("web").alias("kind"), F.when(e == "error", "failed").when(e == "signup", "unsupported").otherwise("ok").alias("outcome"),
        F.concat(F.lit("https://e.example/"), F.col("event_id") % 500).alias("url"), F.when(e == "error", F.concat(F.lit("boom "), F.col("event_id") % 7)).when(e == "signup", "Unsupported URL").alias("error"), (F.col("event_id") % 3 + 1).alias("files"),
    )


@query("progress_rows", f"WITH {_I}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY batch ORDER BY pos) AS INTEGER) AS current, count(*) OVER (PARTITION BY batch) AS total FROM i) SELECT batch, pos, current, total, CAST(floor(current * 100 / total + 0.5) AS INTEGER) AS percent FROM n")
def _(t):
    return at.progress_rows(items(t)).select("batch", "pos", "current", "total", "percent")


@query("failure_streaks", f"WITH {_STREAK} SELECT batch, pos, streak FROM s")
def _(t):
    return at.failure_streaks(items(t)).select("batch", "pos", "streak")


@query("pacing_delay", f"""WITH {_STREAK}, f AS (SELECT *, pos = min(pos) OVER (PARTITION BY batch) AS first FROM s)
SELECT batch, pos, CASE WHEN first THEN 0.0 ELSE CAST(2 + CASE WHEN kind = 'thread' THEN 3 ELSE 0 END + least(10 * streak, 120) AS DOUBLE) END AS article, CASE WHEN first THEN 0.0 ELSE CAST(3 + 15 * streak AS DOUBLE) END AS media, CAST(CASE WHEN first OR kind = 'web' THEN 0 ELSE 2 END AS DOUBLE) AS simple FROM f""")
def _(t):
    rows = at.failure_streaks(items(t))
    for path in ("article", "media", "simple"):
        rows = at.pacing_delay(rows, path).withColumnRenamed("delay", path)
    return rows.select("batch", "pos", "article", "media", "simple")


@query("batch_summary", f"WITH {_I} SELECT batch, count(*) AS total, count_if(outcome = 'ok') AS succeeded, count(DISTINCT CASE WHEN outcome = 'ok' THEN url END) AS succeeded_urls, CAST(coalesce(sum(CASE WHEN outcome = 'ok' THEN files END), 0) AS BIGINT) AS succeeded_files, count_if(outcome <> 'ok') AS failed FROM i GROUP BY batch")
def _(t):
    return at.batch_summary(items(t))


@query("error_report", f"WITH {_I} SELECT batch, string_agg(concat('- ', url, ': ', error), chr(10) ORDER BY pos) AS report FROM i WHERE outcome <> 'ok' GROUP BY batch")
def _(t):
    return at.error_report(items(t))


@query("convert_report", f"WITH {_I} SELECT batch, count(*) AS total, count_if(outcome = 'ok') AS succeeded, count_if(outcome <> 'ok') AS failed, string_agg(CASE WHEN outcome <> 'ok' THEN concat('- ', url, ': ', error) END, chr(10) ORDER BY pos) AS errors FROM i GROUP BY batch")
def _(t):
    return bundles.convert_report(items(t).withColumn("ok", F.col("outcome") == "ok"))


@query("all_failed_batches", f"WITH {_I} SELECT batch * 10000 + pos // 40 AS batch, count(*) AS errors FROM i GROUP BY 1 HAVING count_if(outcome = 'ok') = 0")
def _(t):
    return at.all_failed_batches(items(t).withColumn("batch", F.expr("batch * 10000 + pos div 40")))


_A = """a AS (SELECT user_id AS batch, event_id // 700 AS item, row_number() OVER (PARTITION BY user_id, event_id // 700 ORDER BY event_id) AS attempt, event_type <> 'error' AND event_type <> 'view' AS ok, concat(event_type, ' ', event_id) AS error, event_id, value FROM events)"""


def tries(t):
    from pyspark.sql import Window

    item = F.expr("event_id div 700")
    w = Window.partitionBy("user_id", item).orderBy("event_id")
    return t.events.select(F.col("user_id").alias("batch"), item.alias("item"), F.row_number().over(w).alias("attempt"), (~F.col("event_type").isin("error", "view")).alias("ok"), F.concat("event_type", F.lit(" "), "event_id").alias("error"), "event_id", "value")


@query("fold_attempts", f"WITH {_A}, u AS (SELECT * FROM a WHERE attempt <= 4) SELECT batch, item, bool_or(ok) AS succeeded, CAST(coalesce(min(CASE WHEN ok THEN attempt END), max(attempt)) AS INTEGER) AS tries, CASE WHEN NOT bool_or(ok) THEN arg_max(error, attempt) END AS error FROM u GROUP BY batch, item")
def _(t):
    return at.fold_attempts(tries(t).where("attempt <= 4"), ["batch", "item"])


@query("retry_schedule", f"WITH {_A} SELECT event_id, CASE WHEN NOT ok THEN CAST(CASE attempt WHEN 1 THEN 15 WHEN 2 THEN 30 WHEN 3 THEN 60 END AS DOUBLE) END AS wait FROM a")
def _(t):
    return at.retry_schedule(tries(t)).select("event_id", "wait")


@query("timed_out_attempts", "SELECT event_id, value * 20 AS seconds, concat('Fetch timed out after ', CASE WHEN event_id % 2 = 0 THEN 120 ELSE 300 END, 's') AS error FROM events WHERE value * 20 > CASE WHEN event_id % 2 = 0 THEN 120 ELSE 300 END")
def _(t):
    kinds = t.events.select("event_id", "value", F.when(F.col("event_id") % 2 == 0, "article").otherwise("post_video").alias("kind"))
    return at.timed_out_attempts(kinds, F.col("value") * 20).select("event_id", "seconds", "error")


@query("log_event_counts", "SELECT event_type AS event, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    from ..sources.readers import read_json_logs

    line = F.to_json(F.struct(F.col("event_type").alias("event"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"), F.col("event_id").alias("n")))
    return at.log_event_counts(read_json_logs(t.events.select(line.alias("line")), "line"))


@query("read_json_logs", "SELECT event_id, event_type AS event, 'info' AS level, CAST(event_id AS VARCHAR) AS free FROM events")
def _(t):
    from ..sources.readers import read_json_logs

    line = F.to_json(F.struct(F.col("event_type").alias("event"), F.lit("info").alias("level"), F.col("event_id").alias("free")))
    return read_json_logs(t.events.select("event_id", line.alias("line")), "line").select("event_id", "event", "level", F.col("rest")["free"].alias("free"))


# --- job events ---

_J = """e AS (SELECT user_id AS job, ts, event_id AS id, CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 50 = 0 THEN 'complete' ELSE 'progress' END WHEN 'signup' THEN CASE WHEN event_id % 90 = 1 THEN 'error' ELSE 'progress' END ELSE 'progress' END AS type,
CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'success' END AS status, event_id % 4 AS file_count, user_id AS total FROM events)"""


def job_events(t):
    e, n = F.col("event_type"), F.col("event_id")
    kind = F.when((e == "purchase") & (n % 50 == 0), "complete").when((e == "signup") & (n % 90 == 1), "error").otherwise("progress")
    return t.events.select(F.col("user_id").alias("job"), "ts", n.alias("id"), kind.alias("type"), F.when(e == "error", "failed").when(e == "view", "success").alias("status"), (n % 4).alias("file_count"), F.col("user_id").alias("total"))


@query("sequence_events", f"WITH {_J} SELECT job, id, CAST(row_number() OVER (PARTITION BY job ORDER BY ts, id) - 1 AS INTEGER) AS sequence FROM e")
def _(t):
    return jobs.sequence_events(job_events(t)).select("job", "id", "sequence")


@query("replay_events", f"WITH {_J}, q AS (SELECT job, id, CAST(row_number() OVER (PARTITION BY job ORDER BY ts, id) - 1 AS INTEGER) AS sequence FROM e) SELECT * FROM q WHERE sequence >= 40")
def _(t):
    return jobs.replay_events(jobs.sequence_events(job_events(t)), "40").select("job", "id", "sequence")


@query("job_snapshot", f"""WITH {_J} SELECT job, bool_or(type IN ('complete', 'error')) AS done, arg_max(CASE type WHEN 'complete' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'running' END, id) AS state, max(total) AS total,
CAST(coalesce(sum(CASE WHEN status = 'success' THEN file_count END), 0) AS BIGINT) AS completed, count_if(status = 'failed') AS failed, min(ts) AS created_at, max(ts) AS updated_at FROM e GROUP BY job""")
def _(t):
    return jobs.job_snapshot(job_events(t))


@query("terminal_jobs", f"WITH {_J} SELECT job, CASE WHEN bool_or(type = 'complete') THEN 'complete' ELSE 'failed' END AS state FROM e GROUP BY job HAVING bool_or(type IN ('complete', 'error'))")
def _(t):
    return jobs.terminal_jobs(job_events(t))


@query("silent_gaps", f"WITH {_J}, g AS (SELECT job, id, date_diff('microsecond', lag(ts) OVER (PARTITION BY job ORDER BY ts, id), ts) / 1e6 AS gap FROM e) SELECT job, id, round(gap, 1) AS gap FROM g WHERE gap > 20000")
def _(t):
    return jobs.silent_gaps(job_events(t), 20000).withColumn("gap", F.round("gap", 1))


@query("idle_timeouts", f"""WITH {_J}, g AS (SELECT job, ts, id, CASE WHEN ts - lag(ts) OVER (PARTITION BY job ORDER BY ts, id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY job ORDER BY ts, id) AS k FROM g)
SELECT job, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY job, k""")
def _(t):
    return jobs.idle_timeouts(job_events(t), "6 hours")


@query("expired_jobs", f"WITH {_J} SELECT job FROM e GROUP BY job HAVING bool_or(type IN ('complete', 'error')) AND max(ts) < TIMESTAMP '2024-01-31 10:00:00' - INTERVAL 24 HOUR")
def _(t):
    return jobs.expired_jobs(jobs.job_snapshot(job_events(t)), F.lit("2024-01-31 10:00:00").cast("timestamp")).select("job")


@query("empty_poll_stop", """WITH s AS (SELECT user_id AS feed, event_id AS poll, CASE WHEN event_type <> 'error' THEN event_id % 17 END AS id FROM events), f AS (SELECT *, id IS NOT NULL AND poll = min(poll) OVER (PARTITION BY feed, id) AS new FROM s),
r AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY feed ORDER BY poll) AS run FROM f), c AS (SELECT *, count_if(NOT new) OVER (PARTITION BY feed, run ORDER BY poll) AS empty FROM r) SELECT feed, min(poll) AS stop_poll FROM c WHERE empty = 15 GROUP BY feed""")
def _(t):
    seen = t.events.select(F.col("user_id").alias("feed"), F.col("event_id").alias("poll"), F.when(F.col("event_type") != "error", F.col("event_id") % 17).alias("id"))
    return jobs.empty_poll_stop(seen)


@query("emit_progress_events", f"""WITH {_J} SELECT job, id, concat('data: {{"type":"', type, '","file_count":', file_count, '}}', chr(10), chr(10)) AS payload FROM e""")
def _(t):
    return jobs.emit_progress_events(job_events(t), ["type", "file_count"])
