"""Secret scans by corpus-wide ownership frequency, in DataFrame operations only.

Patterns find candidates in every text: the fixed kinds `assign`, `access` and `hex`, and wider ones (`WIDE`: provider tokens,
bearer headers, credentials in addresses, long mixed strings). Hashes of the candidates' values are counted over the whole
corpus, by distinct repositories and distinct owners. A value that `COPIED_FROM` owners and repositories have, or more, is an
example that was copied widely; one of fewer, however often it repeats there, looks live. So a key that one other source mirrors
stays live. Fixed kinds are reported either way, with their class; wide ones only where they look live. redacted() masks them all, each by its class.

Places of matches come from the parts between them (split) and the matches (regexp_extract_all), which use the same engine, in
code points. A text has one stored row with its matches, then a row for each match. scan() shuffles matches, never texts; the
columns `keep` are shuffled for rows with matches only.

Defined results: null texts count as empty (and redacted() keeps them null); repeated rows get repeated results; a row whose owner is null has an owner of its own
kind, null. Wide matches stand beside fixed ones that they overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

# The base patterns, the group that holds the value and the least length of it.
KINDS = {
    "assign": (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]+)", 1, 24),
}
_HEX = r"([0-9a-f]{24,})"  # the same matches as hex with its least length
WIDE = {
    "bearer": (r"(?i:bearer)\x20+([A-Za-z0-9._~+/-]{20,})", 1, 20),
    "provider": (r"\b((?:ghp|gho|glpat|sk|xox[abp])[-_][A-Za-z0-9_-]{16,})", 1, 20),
    "address": (r"://[^\s:/@]+:([^\s:/@]{6,})@", 1, 6),
    "mixed": (r"(?<![A-Za-z0-9_-])((?=[A-Za-z0-9_-]*[0-9])(?=[A-Za-z0-9_-]*[a-z])(?=[A-Za-z0-9_-]*[A-Z])[A-Za-z0-9_-]{32,})", 1, 32),
}
ORDER = [*KINDS, *WIDE]
#: Values of this many owners, in as many repositories, are copied examples.
COPIED_FROM = 3


#: Elements that _before folds into one growing list.
_FOLD = 64


def _before(x: Column, zero: Column, op) -> Column:
    """Of each element of an array (not empty) op over zero and all before it, op being associative and zero neutral. A fold copies
    its list at every step, so lists of `_FOLD` elements are folded, then their results."""

    def grown(xs: Column) -> Column:
        return F.aggregate(xs, F.array(zero), lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), v))))

    def joined(parts: Column) -> Column:
        ends = grown(F.transform(parts, lambda part: F.element_at(part, -1)))
        shifted = F.zip_with(parts, F.slice(ends, 1, F.size(parts)), lambda part, base: F.transform(F.slice(part, 1, F.size(part) - 1), lambda v: op(base, v)))
        return F.flatten(shifted)

    def parts_of(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _FOLD).cast("int"))
        return F.transform(starts, lambda b: grown(F.slice(xs, b * _FOLD + 1, F.lit(_FOLD))))

    return let(x, lambda xs: let(parts_of(xs), joined))


_MATCHES = "array<struct<start:int,rank:int,end:int,value:string>>"


def matches(text: Column, kind: str) -> Column:
    """array of (start, rank of kind, end, value): leftmost, non-overlapping, in code points, end exclusive; those whose value is
    too short are dropped."""
    pattern, group, least = {**KINDS, **WIDE}[kind]
    pattern = _HEX if kind == "hex" else pattern
    found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m, v: F.struct(F.length(m).alias("length"), v.alias("value")))

    def placed(parts: Column) -> Column:
        """parts: of each match the length of what is between it and the one before, its own length, its value."""
        at = _before(F.transform(parts, lambda x: x["gap"] + x["length"]), F.lit(0), lambda a, b: a + b)
        rows = F.zip_with(parts, at, lambda x, a: F.struct((a + x["gap"]).alias("start"), F.lit(ORDER.index(kind)).alias("rank"), (a + x["gap"] + x["length"]).alias("end"), x["value"].alias("value")))
        return F.filter(rows, lambda r: F.length(r["value"]) >= least)

    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    parts = let(found, lambda m: F.zip_with(m, F.slice(gaps, 1, F.size(m)), lambda x, g: F.struct(g.alias("gap"), x["length"].alias("length"), x["value"].alias("value"))))
    return F.when(F.regexp_like(text, F.lit(pattern)), let(parts, placed)).otherwise(F.array().cast(_MATCHES))


def _is(value: int):
    return lambda x: x == value


def _spans(rows: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: list[str] | None = None, copied_from: int = COPIED_FROM, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, base (matches of the fixed kinds), found (all matches, with `live`), then the columns `keep` as k0,
    k1 and so on. repository: what tells repositories apart; by default each document is one."""
    of = lambda c: F.col(f"`{c}`")
    t = F.coalesce(of(text), F.lit(""))
    repo = F.xxhash64(*[of(c) for c in repository or [doc_id]])
    kept = [of(c).alias(f"k{k}") for k, c in enumerate(keep)]
    rows = docs.select(of(doc_id).alias("doc_id"), of(owner).alias("owner"), repo.alias("repo"), *kept, *[matches(t, k).alias(f"m_{k}") for k in ORDER])
    kept = [f"k{k}" for k in range(len(keep))]
    base = F.array_sort(F.concat(*[f"m_{k}" for k in KINDS]))
    rows = rows.select("doc_id", "owner", "repo", *kept, base.alias("base"), F.concat(*[f"m_{k}" for k in WIDE]).alias("wide"))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", *kept, "base", F.concat("base", "wide").alias("all")), "candidates")
    each = rows.select("row", "owner", "repo", F.explode("all").alias("m")).withColumn("h", F.xxhash64("m.value"))
    # distinct repositories first by owner, so that a value that all have is counted in parts
    by_owner = each.select("h", "owner", "repo").distinct().groupBy("h", "owner").agg(F.count("*").alias("repos"))
    counted = by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    # the few values that are copied widely; what isn't there looks live
    shared = stored(counted.where((F.col("owners") >= copied_from) & (F.col("repos") >= copied_from)), "shared")
    judged = each.join(F.broadcast(shared) if shared.count() <= BROADCAST_VALUES else shared, "h", "left").withColumn("live", F.col("owners").isNull())
    marked = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("m.start", "m.rank", "m.end", "live", "m.value"))).alias("found"))
    # only rows with matches meet their marks; the others, most of them, stay where they are
    out = rows.where(F.size("all") > 0).join(marked, "row").select("doc_id", "base", "found", *kept)
    none = F.array().cast(marked.schema["found"].dataType).alias("found")
    return out.unionByName(rows.where(F.size("all") == 0).select("doc_id", "base", none, *kept))


#: Hashes with their counts that are broadcast; beyond, both sides are shuffled.
BROADCAST_VALUES = 1_000_000


def report(scanned: DataFrame) -> DataFrame:
    """Per row of a scan: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end; of wide kinds those that look
    live), n_live."""
    spans = F.filter("found", lambda m: m["live"] | (m["rank"] < len(KINDS)))
    count = [F.size(F.filter(F.transform("base", lambda m: m["rank"]), _is(r))).cast("long").alias(f"n_{k}") for r, k in enumerate(KINDS)]
    live = F.size(F.filter("found", lambda m: m["live"])).cast("long").alias("n_live")
    return scanned.select("doc_id", *count, F.sha2(_spans(F.col("base")), 256).alias("base_sha256"), _spans(spans).alias("spans"), live)


#: Code points of the parts that a text is cut into for _cut.
_PART = 4096


def _cut(parts: Column, begin: Column, end: Column) -> Column:
    """The code points begin to end (exclusive) of the text that parts of `_PART` code points make. substring() counts from its
    text's start, so it is given no more than it needs."""
    first = F.floor(begin / _PART).cast("int")
    some = F.array_join(F.slice(parts, first + 1, F.floor(end / _PART).cast("int") - first + 1), "")
    return F.substring(some, begin - first * _PART + 1, end - begin)


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", mark: str = "[secret]", copied: str = "[example secret]", **kw) -> DataFrame:
    """docs, all columns, with every match in the text replaced as a whole: by `mark` where it looks live, by `copied` where its value
    is copied widely. Of matches that overlap the later one replaces what the earlier ones left. Texts without matches stay as they are."""
    codes = [f"c{k}" for k in range(len(docs.columns))]
    place = {c: codes[k] for k, c in reversed(list(enumerate(docs.columns)))}
    found = scan(docs.toDF(*codes), place[doc_id], place[text], place[owner], keep=tuple(codes), **kw)
    whole = F.col(f"k{codes.index(place[text])}")

    def masked(parts: Column) -> Column:
        done = _before(F.transform("found", lambda m: m["end"]), F.lit(0), lambda a, b: F.greatest(a, b))

        def piece(m: Column, at: Column) -> Column:
            begin = F.greatest(at, m["start"])
            return F.when(m["end"] > at, F.concat(F.when(begin > at, _cut(parts, at, begin)).otherwise(""), F.when(m["live"], F.lit(mark)).otherwise(F.lit(copied)))).otherwise("")

        last = F.array_max(F.transform("found", lambda m: m["end"]))
        return F.concat(F.array_join(F.zip_with("found", done, piece), ""), _cut(parts, last, F.length(whole)))

    clean = let(F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0)), masked)
    new = F.when(F.size("found") > 0, clean).otherwise(whole)
    return found.select(*[new.alias(c) if c == place[text] else F.col(f"k{k}").alias(c) for k, c in enumerate(codes)]).toDF(*docs.columns)
