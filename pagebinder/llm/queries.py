"""The registered queries of this subpackage (spark, sf_dir) -> DataFrame, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fim, jaccard, langid, lexical, licenses, packing, quality, secrets, tokenfile, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce("longest.length", F.lit(0).cast("long")).alias("longest"), F.col("longest.word").alias("longest_word"), F.col("longest.item_id").alias("longest_item"), F.col("longest.item_word").alias("longest_item_word"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(spark, _table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(_table(spark, sf_dir, "documents"))).drop("n_live")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.scored(docs.select("doc_id", "text"), model).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.decoded(bpe.encoded(_table(spark, sf_dir, "documents"), tokenizer_path()), tokenizer_path())
    return both.select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transformed(_table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


QUERIES = {"op1_topk": op1_topk, "op2_token_ids": op2_token_ids, "op3_best_fit_packing": op3_best_fit_packing, "op4_license_scan": op4_license_scan, "op5_warc": op5_warc, "op6_secret_scan": op6_secret_scan, "op7_quality": op7_quality, "op8_ngram_jaccard": op8_ngram_jaccard, "op9_language_id": op9_language_id, "op10_decontamination": op10_decontamination, "op11_bpe": op11_bpe, "op12_lexical_search": op12_lexical_search, "op13_fill_in_middle": op13_fill_in_middle}

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

ORACLE_SQL = {
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT row_number() OVER () AS bid, item_id, w FROM (SELECT DISTINCT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL)),
pw AS (SELECT bid, item_id, q, CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END AS k, array_to_string(w[q:q + 9], ' ') AS g
  FROM (SELECT bid, item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS q FROM b WHERE len(w) > 0)),
win AS (SELECT DISTINCT item_id, k, g FROM pw),
ks AS (SELECT DISTINCT k FROM win),
p AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT DISTINCT p.r, p.i, p.k, win.item_id FROM p JOIN win USING (k, g)),
hw AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM h GROUP BY r),
al AS (SELECT p.r, p.i, p.k, pw.bid, CAST(pw.item_id AS VARCHAR) AS item, pw.q, p.i - row_number() OVER (PARTITION BY p.r, pw.bid, p.i - pw.q ORDER BY p.i) AS run FROM p JOIN pw USING (k, g)),
rn AS (SELECT r, item, min(i) AS i, min(q) AS q, max(k) + count(*) - 1 AS n FROM al GROUP BY r, bid, item, i - q, run),
lo AS (SELECT r, n AS longest, i - 1 AS longest_word, item AS longest_item, q - 1 AS longest_item_word FROM rn QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC, i, item, q) = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest, longest_word, longest_item, longest_item_word
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r) LEFT JOIN lo USING (r)""",
    "op8_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e2.b FROM r JOIN e2 ON r.y = e2.a),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.x = doc_id""",
    "op1_topk": """
WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM f q JOIN f c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_license_scan": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
p AS (SELECT * FROM (VALUES {", ".join(f"({p.split()!r}, {x!r})" for p, x in licenses.PHRASES.items())}) v(ph, label)),
b AS (SELECT r, label, i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN p ON w[i:i + len(ph) - 1] = ph),
bb AS (SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word FROM b GROUP BY r),
t AS (SELECT * FROM (VALUES {", ".join(f"({k}, {x!r}, {t.split()!r})" for k, (x, t) in enumerate(licenses.TEMPLATES))}) v(tid, label, tw)),
tg AS (SELECT tid, label, tw, j, tw[j:j + {licenses.K - 1}] AS g FROM (SELECT *, unnest(range(1, len(tw) - {licenses.K} + 2)) AS j FROM t)),
h AS (SELECT r, tid, label, len(tw) AS n, i - j AS diag, j FROM (SELECT r, w, unnest(range(1, len(w) - {licenses.K} + 2)) AS i FROM d WHERE len(w) >= {licenses.K}) JOIN tg ON w[i:i + {licenses.K - 1}] = g),
v AS (SELECT DISTINCT r, tid, diag FROM h),
s AS (SELECT *, CASE WHEN diag - lag(diag) OVER x <= {licenses.GAP} THEN 0 ELSE 1 END AS new FROM v WINDOW x AS (PARTITION BY r, tid ORDER BY diag)),
i AS (SELECT *, sum(new) OVER (PARTITION BY r, tid ORDER BY diag) AS island FROM s),
tp AS (SELECT r, tid, label, n, island, j, unnest(range(j, j + {licenses.K})) AS place FROM h JOIN i USING (r, tid, diag)),
c AS (SELECT r, label, count(DISTINCT place) / CAST(n AS DOUBLE) AS cover, (count(DISTINCT j) + {licenses.K - 1}) / CAST(n AS DOUBLE) AS score FROM tp GROUP BY r, tid, label, n, island),
l AS (SELECT r, label, score FROM c WHERE cover >= {licenses.COVER}),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM l UNION ALL SELECT r, label FROM b) GROUP BY r),
bl AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
sc AS (SELECT r, max(score) AS score FROM l GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(sc.score, 0.0) END AS score
FROM d LEFT JOIN bb USING (r) LEFT JOIN al USING (r) LEFT JOIN bl USING (r) LEFT JOIN sc USING (r)""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (h)""",
    "op12_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT r, unnest(w) AS term FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM t GROUP BY ALL),
z AS (SELECT count(*) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest({_WORDS.format('text')}) AS term FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, z GROUP BY term, N),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(w) * N) // L AS m FROM d, z WHERE len(w) > 0),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, len(u) AS n, list_transform([0, 1, 2, 3], lambda k: CAST('0x' || h[8 * k + 1:8 * k + 8] AS BIGINT)) AS hs FROM d),
c AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 100 THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
}
