"""Quality classifier: a sparse rule ensemble over text statistics.

1. Statistics are Spark expressions over the whole text (`STATISTICS`).
2. Shallow trees are grown on draws of labelled rows; each path from a root is a rule, a conjunction of comparisons.
3. A logistic model with a lasso penalty weighs rules and (clipped, scaled) statistics; most weights become 0.
4. What is left compiles to one Spark expression that scores every row where it is read; nothing is shuffled.

Fitting uses a bounded sample: at most `SAMPLE` labelled rows, those of the smallest hashes of doc_id, so any size is treated
alike. All of it takes place on the driver with numpy, on numbers only (SAMPLE rows of len(STATISTICS) doubles).

Defined results: of rows that share a doc_id the text with the smallest hash is learnt from; null texts count as empty; empty texts have all statistics 0 and a score like any other; documents with several
labels count by the smallest; without labels of both kinds every score is the share of good labels (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

SAMPLE = 20_000
TREES, DEPTH, DRAW = 40, 3, 2_000
PENALTY = 0.002
THRESHOLD = 0.7


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Of a text that is not null and its words. Lengths are in code points."""
    length = F.char_length(text)
    n = F.greatest(length, F.lit(1))
    count = F.greatest(F.size(words), F.lit(1))

    def share(pattern: str) -> Column:
        """Part of the text's characters that the pattern takes."""
        return 1 - F.char_length(F.regexp_replace(text, pattern, "")) / n

    distinct = F.size(F.array_distinct(words))
    return {
        "log_chars": F.log1p(length.cast("double")),
        "upper": share(r"[A-Z]+"),
        "digits": share(r"[0-9]+"),
        "symbols": share(r"[#$%&*=<>@^_|~+\\]+"),
        "marks": share(r"[!?]+"),
        "stops": share(r"[.,;:]+"),
        "distinct_words": distinct / count,
        "distinct_few": distinct / F.sqrt(count.cast("double")),
        "word_length": length / count,
        "lines": F.regexp_count(text, F.lit("\n")) / count,
    }


NAMES = ["log_chars", "upper", "digits", "symbols", "marks", "stops", "distinct_words", "distinct_few", "word_length", "lines"]


def with_words(text: Column, use) -> Column:
    """use(a struct of the text's statistics); all are 0 for null and empty texts."""
    t = F.coalesce(text, F.lit(""))

    def bound(words: Column) -> Column:
        of = {k: F.when(F.char_length(t) > 0, c.cast("double")).otherwise(0.0) for k, c in statistics(t, words).items()}
        return let(F.struct(*[c.alias(k) for k, c in of.items()]), use)

    return let(F.split(t, r"\s+"), bound)


@dataclass
class Model:
    """Score: 1 / (1 + exp(-(bias + sum of weights))). rules: conjunctions of (statistic, above, value), with their weight; linear:
    statistic, low, high, weight, of the statistic clipped to low..high and scaled to 0..1."""

    bias: float = 0.0
    rules: list[tuple[list[tuple[str, bool, float]], float]] = field(default_factory=list)
    linear: list[tuple[str, float, float, float]] = field(default_factory=list)

    def score(self, s: Column) -> Column:
        """Of a struct of statistics."""
        total = F.lit(float(self.bias))
        for terms, w in self.rules:
            holds = F.lit(True)
            for name, above, value in terms:
                holds = holds & (s[name] > value if above else s[name] <= value)
            total = total + F.when(holds, float(w)).otherwise(0.0)
        for name, low, high, w in self.linear:
            total = total + (F.least(F.greatest(s[name], F.lit(low)), F.lit(high)) - low) / (high - low) * float(w)
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, columns: np.ndarray, depth: int, path: list, out: list) -> None:
    """Adds to `out` the path to each node below the root."""
    if depth == 0 or len(rows) < 20 or y[rows].min() == y[rows].max():
        return
    best = (1e-9, None)
    p = y[rows].mean()
    for c in columns:
        v = x[rows, c]
        order = np.argsort(v, kind="stable")
        s, good = v[order], np.cumsum(y[rows][order])
        n = np.arange(1, len(rows))
        left, right = good[:-1] / n, (good[-1] - good[:-1]) / (len(rows) - n)
        gain = p * (1 - p) - (n * left * (1 - left) + (len(rows) - n) * right * (1 - right)) / len(rows)
        gain[(s[1:] == s[:-1]) | (n < 5) | (len(rows) - n < 5)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), (int(c), float((s[k] + s[k + 1]) / 2)))
    if best[1] is None:
        return
    c, cut = best[1]
    for above in (False, True):
        inside = rows[(x[rows, c] > cut) == above]
        out.append([*path, (c, above, cut)])
        _grow(x, y, inside, columns, depth - 1, out[-1], out)


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with weights of a small absolute sum, by accelerated proximal gradient steps."""
    n, m = a.shape
    w, bias = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rate = 4.0 / (np.linalg.norm(a, 2) ** 2 / n + 1)
    z, zb, t = w, bias, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(a @ z + zb, -30, 30))) - y
        new = z - rate * (a.T @ e) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = zb - rate * float(e.mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - bias)
        w, bias, t = new, new_b, t2
    return bias, w


def fit_arrays(x: np.ndarray, y: np.ndarray, names: list[str] = NAMES, trees: int = TREES, depth: int = DEPTH, draw: int = DRAW, penalty: float = PENALTY, seed: int = 7) -> Model:
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    paths: list[list] = []
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for _ in range(trees):  # as many of either kind
        half = min(draw // 2, max(len(good), len(bad)))
        rows = np.concatenate([rng.choice(good, half), rng.choice(bad, half)])
        columns = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        _grow(x, y, rows, columns, depth, [], paths)
    holds, rules = [], []
    seen = set()
    for path in paths:
        h = np.ones(len(y), bool)
        for c, above, cut in path:
            h &= (x[:, c] > cut) == above
        key = h.tobytes()
        if key not in seen and 0.002 < h.mean() < 0.998:
            seen.add(key)
            holds.append(h)
            rules.append(path)
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    use = np.flatnonzero(high > low)
    scaled = (np.clip(x[:, use], low[use], high[use]) - low[use]) / (high[use] - low[use])
    a = np.concatenate([np.array(holds, float).T.reshape(len(y), len(holds)), scaled], axis=1)
    bias, w = _lasso(a, y, penalty)
    k = len(rules)
    return Model(
        bias,
        [([(names[c], above, cut) for c, above, cut in r], float(v)) for r, v in zip(rules, w[:k], strict=True) if abs(v) > 1e-6],
        [(names[c], float(low[c]), float(high[c]), float(v)) for c, v in zip(use.tolist(), w[k:], strict=True) if abs(v) > 1e-6],
    )


def held_out(doc_id: str | Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, **kw) -> Model:
    """A model of labels (doc_id, label 0 or 1) that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_y"))
    known = stored(known.orderBy(F.xxhash64("_id"), "_id").limit(sample), "labels")  # of bounded size
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(f"`{text}`").alias("_t")).join(F.broadcast(known), "_id")
    rows = rows.select("_id", "_y", F.xxhash64("_t").alias("h"), with_words(F.col("_t"), lambda s: s).alias("s"))
    got = rows.groupBy("_id", "_y").agg(F.min_by("s", "h").alias("s")).orderBy("_id").select("_id", "_y", "s.*").collect()
    data = np.array([[*r[1:]] for r in got], float).reshape(len(got), 1 + len(NAMES))
    return fit_arrays(data[:, 1:], data[:, 0], **kw)


def score(text: Column, model: Model) -> Column:
    return with_words(text, model.score)


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with score and predicted; columns of these names are replaced."""
    codes = [f"c{k}" for k in range(len(docs.columns))]
    both = let(score(F.col(codes[docs.columns.index(text)]), model), lambda x: F.struct(x.alias("score"), (x >= threshold).cast("int").alias("predicted")))
    kept = [(code, c) for code, c in zip(codes, docs.columns, strict=True) if c.lower() not in ("score", "predicted")]
    out = docs.toDF(*codes).withColumn("s", both).select(*[code for code, _ in kept], "s.score", "s.predicted")
    return out.toDF(*[c for _, c in kept], "score", "predicted")


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score the threshold or more."""
    return docs.where(score(F.col(f"`{text}`"), model) >= threshold)
