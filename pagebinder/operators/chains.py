"""Pages of a feed put in order by the token that each gives for the next."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import remove, scratch


#: Feeds of more pages than this aren't walked in one task.
WALKED = 1_000_000


def _walk(feed: pd.DataFrame) -> pd.DataFrame:
    """Places of a feed's pages, by walking from its first page until a page that was met or none. feed: _node, _jump, _at (0: first), -1 for none, of one
    feed or several."""
    feed = feed.sort_values("_node", ignore_index=True)
    node, jump = feed["_node"].to_numpy(), feed["_jump"].to_numpy()
    then, at = np.where(jump < 0, -1, np.searchsorted(node, jump)).tolist(), [-1] * len(node)
    for k in np.flatnonzero(feed["_at"].to_numpy() == 0).tolist():
        n = 0
        while k >= 0 and at[k] < 0:
            at[k] = n
            k, n = then[k], n + 1
    return pd.DataFrame({"_node": node, "page": at})


def follow_pages(pages: DataFrame, feed: str = "feed", token: str = "token", body: str = "body") -> DataFrame:
    """All columns of pages, next (the token in the body), page (from 0, as a walk from the page without a token finds it) and error: `repeated` (a token's other
    pages than the smallest body's; they have no page), `lost` (no walk finds it; no page), `cycle` (its next is itself or a page before it),
    `next is missing`. Null and empty tokens are equal. Feeds of up to WALKED pages are walked, each in a task, by numbers of pages; in larger ones pointers jump: round k doubles how far each page's pointer reaches, and
    pages found so far hand their place to what their pointers reach, so a feed of n pages takes about log2(n) rounds of two joins,
    whatever its share of all pages. Tokens are joined once; walks and rounds hold numbers of pages. Rounds are written to the shared folder. Added columns replace those of the same name; an empty table
    gives none."""
    spark, key = pages.sparkSession, ["_feed", "_token"]
    none = lambda c: F.coalesce(c, F.lit(""))
    own = [c for c in pages.columns if c not in ("next", "page", "error")]
    rows = pages.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{feed}`").alias("_feed"), none(F.col(f"`{token}`")).alias("_token"), F.nullif(F.get_json_object(F.col(f"`{body}`"), "$.nextPageToken"), F.lit("")).alias("next"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(f"`{body}`").asc_nulls_last()))).withColumn("_node", F.monotonically_increasing_id())
    base = scratch(spark, "chains")
    rows.write.parquet(f"{base}/pages")
    rows = spark.read.schema(rows.schema).parquet(f"{base}/pages")

    nodes = rows.where("_n = 1").select("_node", *key, "next")
    same = F.col("a._feed").eqNullSafe(F.col("b._feed")) & (F.col("a.next") == F.col("b._token"))
    there = nodes.alias("a").join(nodes.alias("b"), same, "left")
    start = F.when(F.col("a._token") == "", F.lit(0).cast("long")).alias("_at")
    there.select("a._node", F.col("b._node").alias("_jump"), start, F.xxhash64("a._feed").alias("_of")).write.parquet(f"{base}/first")
    first = spark.read.schema("_node long, _jump long, _at long, _of long").parquet(f"{base}/first")
    long = first.groupBy("_of").count().where(F.col("count") > WALKED).select("_of")
    many = not long.isEmpty()
    short = first.join(long, "_of", "left_anti") if many else first
    none_below = [F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("_jump", "_at")]  # nulls would make numbers floats
    short.select("_node", *none_below, "_of").groupBy("_of").applyInPandas(_walk, "_node long, page long").write.parquet(f"{base}/1")
    placed = spark.read.schema("_node long, page long").parquet(f"{base}/1").select("_node", F.when(F.col("page") >= 0, F.col("page")).alias("page"))
    if many:
        placed = placed.unionByName(_jumped(first.join(long, "_of", "left_semi").select("_node", "_jump", "_at"), f"{base}/long"))

    then = placed.select(F.col("_node").alias("_jump"), F.col("page").alias("_then"))
    of = first.select("_node", "_jump").join(placed, "_node").join(then, "_jump", "left").select("_node", "page", F.col("_jump").isNotNull().alias("_there"), "_then")
    out = rows.join(of, "_node", "left")
    error = F.when(F.col("_n") > 1, "repeated").when(F.col("page").isNull(), "lost").when(F.col("next").isNull(), None).when(~F.col("_there"), "next is missing").when(F.col("_then") <= F.col("page"), "cycle")
    return out.select(*[F.col(f"`{c}`") for c in own], "next", "page", error.alias("error"))


def _jumped(state: DataFrame, base: str) -> DataFrame:
    """_node, page of the pages of state (_node, _jump, _at), by rounds that are written to base."""
    spark, schema, found, k = state.sparkSession, state.schema, -1, 0
    while True:
        state.write.parquet(f"{base}/{k}")
        state = spark.read.schema(schema).parquet(f"{base}/{k}")
        if k:
            remove(spark, f"{base}/{k - 1}")
        counts = state.agg(F.count("_at").alias("found"), F.count_if(F.col("_at").isNotNull() & F.col("_jump").isNotNull()).alias("going")).first()
        if counts.found == found or not counts.going:
            return state.select("_node", F.col("_at").alias("page"))
        found = counts.found
        reached = state.where("_at is not null and _jump is not null").groupBy(F.col("_jump").alias("_node")).agg((F.min("_at") + F.lit(2**k)).alias("_new"))
        beyond = state.where("_jump is not null").select(F.col("_node").alias("_jump"), F.col("_jump").alias("_beyond"))
        state = state.join(reached, "_node", "left").join(beyond, "_jump", "left").select("_node", F.col("_beyond").alias("_jump"), F.least("_at", "_new").alias("_at"))
        k += 1
