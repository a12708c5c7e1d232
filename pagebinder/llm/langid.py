"""Languages of web pages by Bayesian fusion of evidence.

The evidence: the page's text (a naive Bayes model of hashed byte trigrams, counted over all documents of known language), the
language that its markup declares, the suffix of its address and its host. What a declaration, a suffix or a host says is learnt
from the other pages: the text's posteriors are summed in groups, without the page's own, and each level is smoothed towards the
one above it (host, suffix, all pages, labelled documents), so a host with few pages speaks like its suffix. The log of each
source is added, and the sum is normalised.

Trigrams of one text depend on each other, so a text's evidence counts as that of at most `WEIGHT` trigrams.

Defined results: null html has no text and declares nothing; a null url has the host and suffix "", a numeric host the suffix "". Pages without any evidence
get the languages' shares. Repeated rows count as pages of their own. Without labelled documents lang is null. Labels that are null
or empty aren't learnt.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, let, stored, text_bytes

SLOTS = 1 << 13
WEIGHT = 40.0
#: Pages' worth of the level above that a group gets.
SMOOTH = 10.0
#: Languages that are allowed for, as a guard against labels that aren't languages: the model, which is broadcast, has 64 KB for each. A
#: parameter of identify(); with more it raises and leaves none out.
LANGUAGES = 500
BROADCAST_GROUPS = 500_000


def _slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the byte trigrams of all texts (ASCII letters in lower case, digits left out), and where each text's begin."""
    data, at = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    x = _FOLD[data]
    h = np.zeros(len(x), np.uint32)
    h[:-2] = (x[:-2] * np.uint32(961) + x[1:-1]) * np.uint32(961) + x[2:]
    h = ((h * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64) & (SLOTS - 1)
    use = x > 0
    use[:-2] &= (x[1:-1] > 0) & (x[2:] > 0)
    ends = np.concatenate([at[1:] - 1, at[1:] - 2])
    use[ends[(ends >= 0) & (ends < len(x))]] = False  # not across texts
    begins = np.concatenate([[0], np.cumsum(use)])[at]
    return h[use], begins


_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] += 32
_FOLD[:0x20] = 0x20
_FOLD[0x30:0x3A] = 0


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their shares of documents, and the logs of each language's share of each slot, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            slots, at = _slots(batch.column(1))
            names = np.array(batch.column(0).to_pylist(), object)
            owner = np.repeat(np.arange(len(names)), np.diff(at))
            for name in set(names.tolist()):
                mine = names == name
                n = np.bincount(slots[mine[owner]], minlength=SLOTS)
                total[name] = total.get(name, 0) + np.append(n, mine.sum())
        for name, n in total.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(k, pa.int32()), pa.array(n[k], pa.int64())], names=["lang", "slot", "n"])

    known = docs.where(F.col(lang).isNotNull() & (F.col(lang) != "")).select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("t"))
    with arrow_rows(docs.sparkSession):
        counts = stored(known.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")), "trigrams")
    langs = [r.lang for r in counts.where(f"slot = {SLOTS}").orderBy("lang").limit(most + 1).collect()]
    if len(langs) > most:
        raise ValueError(f"more than {most} languages; allow for more of them by `most`")
    table = np.zeros((len(langs), SLOTS + 1))
    place = {name: k for k, name in enumerate(langs)}
    for r in counts.toLocalIterator():  # most * (SLOTS + 1) numbers at most
        table[place[r.lang], r.slot] = r.n
    shares = table[:, SLOTS] / max(table[:, SLOTS].sum(), 1)
    of = table[:, :SLOTS] + 0.5
    return langs, shares, np.log(of / of.sum(1, keepdims=True)) if langs else of


def visible_text(html: Column) -> Column:
    html = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    return F.regexp_replace(html, r"(?s)<[^>]*>", " ")


def _decoded(texts: pa.Array) -> pa.Array:
    """Texts with their entities as characters."""
    return pa.array([entities.unescape(t) if t and "&" in t else t for t in texts.to_pylist()], pa.string())


def suffix_of(host: Column) -> Column:
    return F.when(host.rlike(r"^[0-9.]*$") | host.startswith("["), "").otherwise(F.substring_index(host, ".", -1))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def declared_of(html: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]+)""", 1))


def _softmax(scores: Column) -> Column:
    """Of an array of logs."""
    top = F.array_max(scores)
    e = let(top, lambda t: F.transform(scores, lambda x: F.exp(x - t)))
    return let(e, lambda e: let(_sum(e), lambda total: F.transform(e, lambda x: x / total)))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def identify(pages: DataFrame, docs: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", text: str = "text", lang: str = "lang", most: int = LANGUAGES) -> DataFrame:
    """Per row of pages: page_id, host, suffix, declared, text_lang (by the text alone), lang, probability."""
    spark = pages.sparkSession
    langs, shares, logs = fit(docs, text, lang, most)
    base = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), declared_of(F.col(html)).alias("declared"), visible_text(F.col(html)).alias("t"))
    base = base.withColumn("suffix", suffix_of(F.col("host")))
    if not langs:
        return base.select("page_id", "host", "suffix", "declared", *[F.lit(None).cast(k).alias(c) for c, k in (("text_lang", "string"), ("lang", "string"), ("probability", "double"))])
    model, n = spark.sparkContext.broadcast(logs), len(langs)
    prior = F.array(*[F.lit(float(np.log(max(s, 1e-9)))) for s in shares])
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            slots, at = _slots(_decoded(batch.column(4)))
            count = np.diff(at)
            sums = np.zeros((len(count), n))
            for k in range(n):
                total = np.concatenate([[0.0], np.cumsum(model.value[k][slots])])
                sums[:, k] = total[at[1:]] - total[at[:-1]]
            sums *= np.minimum(1.0, WEIGHT / np.maximum(count, 1))[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(list(sums), pa.list_(pa.float64()))], names=["page_id", "host", "suffix", "declared", "by_text"])

    kind = pages.schema[page_id].dataType.simpleString()
    judged = base.select("page_id", "host", "suffix", "declared", "t").mapInArrow(judge, f"page_id {kind}, host string, suffix string, declared string, by_text array<double>")
    with arrow_rows(spark):
        judged = stored(judged.withColumn("p", _softmax(plus("by_text", prior))), "by-text")

    def summed(df: DataFrame, *by: str) -> DataFrame:
        """The text's posteriors summed in groups."""
        return df.groupBy(*by).agg(F.array(*[F.sum(F.get("p", F.lit(k))) for k in range(n)]).alias("c"))

    def joined(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
        return df.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, by, "left")

    def others(c: Column) -> Column:
        """A group's sums without the page's own part."""
        return F.zip_with(c, "p", lambda x, y: F.greatest(x - y, F.lit(0.0)))

    def smoothed(c: Column, above: Column) -> Column:
        return let(_sum(c) + SMOOTH, lambda total: F.zip_with(c, above, lambda x, y: (x + SMOOTH * y) / total))

    def summed_up(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.array(*[F.sum(F.get("c", F.lit(k))) for k in range(n)]).alias("c"))

    hosts = stored(summed(judged, "suffix", "host"), "hosts")
    suffixes = stored(summed_up(hosts, "suffix"), "suffixes")
    pages_of = summed_up(suffixes).first()["c"]
    everywhere = F.array(*[F.lit(float(x or 0.0)) for x in pages_of])
    labelled = F.array(*[F.lit(float(max(s, 1e-9))) for s in shares])
    hosts = stored(joined(hosts.withColumnRenamed("c", "of_host"), suffixes.withColumnRenamed("c", "of_suffix"), ["suffix"]), "host-sums")
    # what a language's pages declare: the share of each declaration among its pages
    said = stored(summed(judged, "declared").withColumnRenamed("c", "of_declared"), "declared")
    kinds = said.count() or 1
    fused = joined(joined(judged, hosts, ["suffix", "host"]), said, ["declared"])
    by_host = smoothed(others(F.col("of_host")), smoothed(others(F.col("of_suffix")), smoothed(others(everywhere), labelled)))
    likelihood = F.zip_with(others(F.col("of_declared")), others(everywhere), lambda x, t: F.log((x + 0.5) / (t + 0.5 * kinds)))
    by_declared = F.when(F.col("declared") != "", likelihood).otherwise(F.array_repeat(F.lit(0.0), n))
    fused = fused.select("page_id", "host", "suffix", "declared", "p", "by_text", by_host.alias("by_host"), by_declared.alias("by_declared"))
    names = F.array(*[F.lit(x) for x in langs])
    fused = fused.withColumn("q", _softmax(plus(plus("by_text", "by_declared"), F.transform("by_host", lambda x: F.log(x)))))
    best = lambda p: F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    return fused.select("page_id", "host", "suffix", "declared", best(F.col("p")).alias("text_lang"), best(F.col("q")).alias("lang"), F.array_max("q").alias("probability"))
