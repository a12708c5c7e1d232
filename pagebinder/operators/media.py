"""Media results and their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import media_kind

# What is cut from the end of titles, in brackets and after a dash.
_NOISE = r"(?:official\s*)?(?:music\s*)?(?:video|audio|lyric(?:s)?|hd|4k|visualizer)"
TITLE_PATTERNS = [(rf"(?i)\s*[\[(]{_NOISE}[^\])]*[\])]\s*$", ""), (rf"(?i)\s*-\s*{_NOISE}\s*$", ""), (r"\s{2,}", " ")]
ERROR_SCOPED = r"^ERROR:\s+\[youtube[^\]]*\]\s+[\w-]+:"


def playlist_counts(df: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """n_items of playlist links: the list of entries, else a count of 0 or more that the body gives, else the other; null for other links."""
    entries = F.json_array_length(F.get_json_object(F.col(body), "$.entries"))
    number = lambda k: F.when(F.get_json_object(F.col(body), k).rlike(r"^\d+$"), F.get_json_object(F.col(body), k).cast("int"))
    n = F.coalesce(entries, number("$.playlist_count"), number("$.n_entries"))
    return df.withColumn("n_items", F.when(media_kind(F.col(url)) == "playlist", n))


def clean_media_titles(title: Column) -> Column:
    for pattern, to in TITLE_PATTERNS:
        title = F.regexp_replace(title, pattern, to)
    return title


def split_artist_title(df: DataFrame, title: str = "title", uploader: str = "uploader", own_track: str | None = None, playlist: tuple[str, str] | None = None) -> DataFrame:
    """artist and track of "Artist - Title"; else the uploader and the whole title. own_track: a column whose track, if it has one, comes first.
    playlist: columns of its title and of the place there, which become album and track_number."""
    t = F.col(title)
    pair = t.contains(" - ")
    artist = F.when(pair, F.regexp_extract(t, r"^(.*?) - ", 1))
    parts = [F.nullif(F.col(own_track), F.lit(""))] if own_track else []
    track = F.coalesce(*parts, F.nullif(F.when(pair, F.regexp_extract(t, r"^.*? - (.*)$", 1)), F.lit("")), t)
    more = {"album": F.col(playlist[0]), "track_number": F.col(playlist[1])} if playlist else {}
    return df.withColumns({"artist": F.coalesce(F.nullif(artist, F.lit("")), F.col(uploader)), "track": track, **more})


def media_file_names(df: DataFrame, mode: str) -> DataFrame:
    """file_name from url, idx (or null), artist, track, id."""
    idx = F.col("idx").cast("string")
    if mode == "mp3":
        name = F.concat(F.coalesce(F.concat(idx, F.lit(" - ")), F.lit("")), F.left(F.coalesce("artist", F.lit("Unknown Artist")), F.lit(80)), F.lit(" - "), F.left("track", F.lit(140)), F.lit(" ["), F.col("id").cast("string"), F.lit("].mp3"))
    else:
        name = F.concat(F.lit("youtube_video_"), F.substring(F.sha2("url", 256), 1, 12), F.lit("_"), F.coalesce(F.concat(idx, F.lit("_")), F.lit("")), F.col("id").cast("string"), F.lit(".mp4"))
    return df.withColumn("file_name", name)


def changed_artifacts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names that are new or differ in mtime or size; name, mtime, size. Deletions don't count."""
    b = before.select("name", F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.lit(True).alias("there"))
    return after.join(b, "name", "left").where(F.col("there").isNull() | ~F.col("mtime").eqNullSafe(F.col("m0")) | ~F.col("size").eqNullSafe(F.col("s0"))).select("name", "mtime", "size").orderBy("name")


def artifacts_by_prefix(wanted: DataFrame, files: DataFrame, unseen: bool = True) -> DataFrame:
    """wanted (key, prefix, extension) with the names that fit, sorted; without any, an error row. A prefix ends at a known length, so that files
    are joined by equality. unseen: keys without a file of any extension are errors too, else their error is null."""
    f = files.select("name", F.substring_index("name", "_", 3).alias("prefix"))
    rows = wanted.join(f, "prefix", "left").withColumn("fits", F.when(F.col("name").endswith(F.col("extension")), F.col("name")))
    g = rows.groupBy("key", "prefix").agg(F.array_sort(F.collect_list("fits")).alias("names"), F.count("name").alias("_seen"))
    wrong = (F.size("names") == 0) & (F.lit(unseen) | (F.col("_seen") > 0))
    return g.select("key", "prefix", "names", F.when(wrong, "completed but no output was found").alias("error"))


def classify_tool_errors(runs: DataFrame, stderr: str = "stderr") -> DataFrame:
    """skippable: there are error lines and every one is scoped to an item."""
    lines = F.filter(F.split(F.coalesce(F.col(stderr), F.lit("")), "\n"), lambda x: x.startswith("ERROR:"))
    return runs.withColumn("skippable", (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(ERROR_SCOPED)))


def accept_partial_runs(runs: DataFrame) -> DataFrame:
    """verdict and message of runs (exit_code, playlist, outputs, stderr, stdout): a failed run counts only for a playlist with outputs and
    skippable errors."""
    rows = classify_tool_errors(runs)
    ok = (F.col("exit_code") == 0) | (F.col("playlist") & (F.col("outputs") > 0) & F.col("skippable"))
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return rows.withColumns({"verdict": F.when(ok, "accepted").otherwise("failed"), "message": F.when(~ok, F.coalesce(some("stderr"), some("stdout"), F.lit("unknown error")))})


def media_results(links: DataFrame, files: DataFrame) -> DataFrame:
    """Per link: files, bytes and a label; links (key, url), files (key, pos, filename, size_bytes)."""
    g = files.groupBy("key").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("size_bytes"), F.min_by("filename", "pos").alias("first"))
    rows = links.join(g, "key", "left")
    label = F.when(F.col("n_files") > 1, F.concat(F.col("n_files").cast("string"), F.lit(" files from playlist"))).otherwise(F.col("first"))
    return rows.select("key", "url", F.coalesce("n_files", F.lit(0)).alias("n_files"), "size_bytes", label.alias("label"), F.when(F.col("n_files").isNull(), "failed").otherwise("success").alias("status"))


def liked_items(pages: DataFrame, limit: int, most: int = 1000, feed: str = "feed") -> DataFrame:
    """Items of feeds' pages (feed, page, body JSON with items[]) in order: feed, rank, id, url, title, channel; blank and repeated ids are passed over;
    limit items (at least 1, `most` at most) of each feed."""
    item = "items array<struct<id:string,snippet:struct<title:string,channelTitle:string>>>"
    rows = pages.select(feed, "page", F.posexplode(F.from_json("body", item)["items"]).alias("pos", "i")).where("coalesce(i.id, '') <> ''")
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy(feed, F.col("i.id")).orderBy("page", "pos"))).where("_n = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(feed).orderBy("page", "pos"))).where(F.col("rank") <= max(1, min(limit, most)))
    return ranked.select(feed, "rank", F.col("i.id").alias("id"), F.concat(F.lit("https://www.youtube.com/watch?v="), "i.id").alias("url"), F.coalesce("i.snippet.title", F.lit("")).alias("title"), F.coalesce("i.snippet.channelTitle", F.lit("")).alias("channel"))


def probe_has_formats(output: Column) -> Column:
    """Whether a probe's output lists formats."""
    line = lambda x: (F.trim(x).startswith("ID ") & F.trim(x).contains("EXT")) | F.trim(x).rlike(r"^[\w-]+\s+(mp4|webm|m4a|mp3)\b")
    return F.exists(F.split(output, "\n"), line)
