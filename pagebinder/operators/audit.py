"""Audit and redaction of delimited credential exports; values never leave these jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
HEADER = "# Netscape HTTP Cookie File"
SITE_DOMAINS = ["youtube.com", "youtube-nocookie.com"]
ALLOWED_DOMAINS = ["youtube.com", "youtube-nocookie.com", "google.com", "accounts.google.com", "googleusercontent.com", "ytimg.com"]
SESSION_NAMES = ["SID", "HSID", "SSID", "APISID", "SAPISID", "LOGIN_INFO", "__Secure-1PSID", "__Secure-3PSID", "__Secure-1PAPISID", "__Secure-3PAPISID", "__Secure-1PSIDTS", "__Secure-3PSIDTS"]
SOON_S = 14 * 24 * 3600
FIELDS = ["domain", "include_subdomains", "path", "secure", "expires", "name", "value"]
KNOWN_KEYS = ["auth_token", "ct0", "twid", "guest_id"]
REQUIRED_KEYS = ["auth_token", "ct0"]
SAFE = {"configured": "boolean", "encrypted": "boolean", "cookie_count": "int", "youtube_cookie_count": "int", "expired_count": "int", "soon_expiring_count": "int", "session_cookie_count": "int", "updated_at": "string", "last_verified_at": "string", "last_verify_ok": "boolean", "last_verify_message": "string"}


def canonical_domain(domain: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(domain, "^#HttpOnly_", "")), r"^\.+", "")


def _within(domain: Column, allowed: list[str]) -> Column:
    out = F.lit(False)
    for a in allowed:
        out = out | (domain == a) | domain.endswith(f".{a}")
    return out


def canonical_domains(df: DataFrame, domain: str = "domain") -> DataFrame:
    """With canonical, allowed and site."""
    d = canonical_domain(F.col(domain))
    return df.withColumns({"canonical": d, "allowed": _within(d, ALLOWED_DOMAINS), "site": _within(d, SITE_DOMAINS)})


def read_delimited_exports(files: DataFrame) -> DataFrame:
    """files (file, text) -> file, line_no (from 1), line (trimmed), kind (blank, comment, header, data), fields."""
    rows = files.select("file", F.posexplode(F.split(F.trim(F.coalesce("text", F.lit(""))), "\r?\n")).alias("n", "line"))
    return export_lines(rows.select("file", (F.col("n") + 1).alias("line_no"), "line"))


def export_lines(rows: DataFrame) -> DataFrame:
    """rows (file, line_no, line) as read_delimited_exports gives them; with sources.lines.read_lines a file needn't fit a row."""
    line = F.regexp_replace("line", r"^[ \r]+|[ \r]+$", "")
    kind = F.when(line == "", "blank").when(line == HEADER, "header").when(line.startswith("#") & ~line.startswith("#HttpOnly_"), "comment").otherwise("data")
    return rows.select("file", "line_no", line.alias("line"), kind.alias("kind"), F.when(kind == "data", F.split(line, "\t")).alias("fields"))


def match_suffix_rules(df: DataFrame, rules: DataFrame, domain: str = "domain") -> DataFrame:
    """df with canonical and the columns of the rule (suffix, ...) that fits: the longest suffix that is the domain or stands behind a dot in it; nulls
    where none does. Each distinct domain is cut into its suffixes once, which makes the match an equality. Of rules with equal suffixes
    the smallest counts; suffixes are brought to the form of domains, null ones never fit. The rules' columns mustn't be named as df's."""
    others = [c for c in rules.columns if c != "suffix"]
    of_rule = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).alias("_none"))
    one = rules.select(canonical_domain(F.col("suffix")).alias("suffix"), of_rule.alias("_rule")).groupBy("suffix").agg(F.min("_rule").alias("_rule"))
    rows = df.withColumn("canonical", canonical_domain(F.col(f"`{domain}`")))
    labels = F.split("canonical", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    cut = rows.where("canonical is not null").select("canonical").distinct().select("canonical", F.explode(suffixes).alias("suffix"))
    found = cut.join(one, "suffix").groupBy("canonical").agg(F.max_by(F.struct("suffix", "_rule"), F.length("suffix")).alias("_found"))
    return rows.join(found, "canonical", "left").select(*[F.col(f"`{c}`") for c in df.columns], "canonical", F.col("_found.suffix").alias("suffix"), *[F.col(f"_found._rule.`{c}`").alias(c) for c in others])


def audit_line_rules(lines: DataFrame) -> DataFrame:
    """Data lines with the first rule that each breaks (null: none) and its columns but the value."""
    rows = lines.where("kind = 'data'")
    f = lambda k: F.coalesce(F.get("fields", F.lit(k)), F.lit(""))
    rows = canonical_domains(rows.withColumn("domain", f(0)))
    flag = lambda c: F.upper(c).isin("TRUE", "FALSE")
    rule = (
        F.when(F.size("fields") != 7, "expected 7 tab-separated fields").when(~F.col("allowed"), "unsupported domain").when(~flag(f(1)), "invalid include-subdomains flag").when(~flag(f(3)), "invalid secure flag")
        .when(f(2) == "", "empty path").when(f(5) == "", "empty name").when(f(6) == "", "empty value").when(~f(4).rlike(r"^\s*[+-]?\d+\s*$"), "expiry is not an integer")
    )
    name = f(5)
    session = name.isin(SESSION_NAMES) | name.endswith("SID") | (name.startswith("__Secure-") & name.contains("SID"))
    return rows.select("file", "line_no", "canonical", "site", rule.alias("rule"), F.trim(f(4)).try_cast("bigint").alias("expires"), name.alias("name"), session.alias("session"))


def audit_file_counts(audited: DataFrame, now: int) -> DataFrame:
    """Per file: rows, site_rows, expired, soon_expiring, session_rows; of rows that break no rule. An expiry of 0 never comes."""
    return _by_file(audited, now).drop("bad").where("rows > 0")


def _by_file(audited: DataFrame, now: int) -> DataFrame:
    """Per file with data lines the counts and bad, the first line that breaks a rule and that rule. Rules are conditions of the sums: a filter by them would
    be moved down to the texts and would work them out anew at each mention."""
    e, ok = F.col("expires"), F.col("rule").isNull()
    counts = {"rows": ok, "site_rows": ok & F.col("site"), "expired": ok & (e > 0) & (e < now), "soon_expiring": ok & (e > 0) & (e >= now) & (e <= now + SOON_S), "session_rows": ok & F.col("session")}
    return audited.groupBy("file").agg(*[F.count_if(c).alias(k) for k, c in counts.items()], F.min(F.when(~ok, F.struct("line_no", "rule"))).alias("bad"))


def audit_file_verdict(files: DataFrame, max_bytes: int, now: int) -> DataFrame:
    """Per file the first reason to reject it, or ok: empty, too large, a line that breaks a rule, no rows, no site rows, all expired, no session rows."""
    audited = _by_file(audit_line_rules(read_delimited_exports(files)), now)
    sized = files.select("file", F.octet_length(F.trim(F.coalesce("text", F.lit("")))).alias("bytes"))
    rows = sized.join(audited, "file", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    verdict = (
        F.when(F.col("bytes") == 0, "empty").when(F.col("bytes") > max_bytes, "too large").when(F.col("bad").isNotNull(), F.concat(F.lit("line "), F.col("bad.line_no"), F.lit(": "), F.col("bad.rule")))
        .when(n("rows") == 0, "no rows").when(n("site_rows") == 0, "no site rows").when(n("expired") == n("rows"), "all expired").when(n("session_rows") == 0, "no session rows").otherwise("ok")
    )
    return rows.select("file", "bytes", verdict.alias("verdict"))


def normalize_exports(lines: DataFrame) -> DataFrame:
    """Per file: the header once, then comments and data lines in order, as one text: an export of one browser must fit a row."""
    kept = lines.where("kind in ('comment', 'data')")
    g = kept.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return g.select("file", F.concat(F.lit(HEADER + "\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"))


def parse_key_value_exports(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, name, value) of "name=value; ..." texts or of pasted tables; of tables only known names; the last value of a name wins."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    table = (t.contains("\t") | t.contains("    ")) & (t.rlike(r"(?m)^\s*(ct0|auth_token|twid|guest_id)") | (t.contains("\n") & ~F.split_part(t, F.lit("\n"), F.lit(1)).contains("=")))
    plain = F.transform(F.split(t, ";"), lambda p: F.when(p.contains("="), F.struct(F.trim(F.substring_index(p, "=", 1)).alias("name"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("value"))))
    cells = F.transform(F.split(t, "\n"), lambda x: F.filter(F.transform(F.split(F.trim(x), r"\t|  +"), lambda c: F.trim(c)), lambda c: c != ""))
    pasted = F.transform(cells, lambda c: F.when((F.size(c) >= 2) & F.get(c, F.lit(0)).isin(KNOWN_KEYS), F.struct(F.get(c, F.lit(0)).alias("name"), F.get(c, F.lit(1)).alias("value"))))
    rows = df.select(key, F.posexplode(F.when(table, pasted).otherwise(plain)).alias("pos", "p")).where("p is not null")
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, F.col("p.name")).orderBy(F.desc("pos")))).where("_n = 1")
    return last.select(key, "p.name", "p.value")


def required_key_verdict(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per text: valid, invalid with what is missing, or not_configured."""
    good = parse_key_value_exports(df, key, text).where(F.col("name").isin(REQUIRED_KEYS) & (F.length("value") > 20))
    have = good.groupBy(key).agg(F.collect_set("name").alias("have"))
    rows = df.select(key, F.trim(F.coalesce(F.col(text), F.lit(""))).alias("_t")).join(have, key, "left")
    missing = F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), F.coalesce("have", F.array().cast("array<string>")))
    return rows.select(key, F.when(F.col("_t") == "", "not_configured").when(F.size(missing) == 0, "valid").otherwise("invalid").alias("status"), F.array_join(missing, ", ").alias("missing"))


def safe_projection(df: DataFrame) -> DataFrame:
    """Allowed columns only, with defaults for those that are missing or null."""
    default = {"boolean": False, "int": 0}
    return df.select(*[(F.coalesce(F.col(c).cast(k), F.lit(default[k])) if c in df.columns and k in default else F.col(c) if c in df.columns else F.lit(default.get(k)).cast(k)).alias(c) for c, k in SAFE.items()])


def redact_messages(message: Column, length: int = 500) -> Column:
    out = F.regexp_replace(message, r"/(?:private/)?tmp/[^\s]+", "[temp-file]")
    out = F.regexp_replace(out, r"[\w.-]+/youtube-cookies[^\s]*", "[cookie-file]")
    return F.left(F.translate(out, "\r\n", "  "), F.lit(length))


def api_error_messages(df: DataFrame, body: str = "body", status: str = "status") -> DataFrame:
    """message: the description, else the nested message, else the error of a JSON body."""
    g = lambda p: F.nullif(F.get_json_object(F.col(body), p), F.lit(""))
    said = F.coalesce(g("$.error_description"), g("$.error.message"), g("$.error"))
    head = F.concat(F.lit("Google API error ("), F.col(status).cast("string"), F.lit(")"))
    return df.withColumn("message", F.when(said.isNotNull(), F.concat(head, F.lit(": "), F.left(F.translate(said, "\r\n", "  "), F.lit(300)))).otherwise(head))


PREFIX = "aes:v1:"


def encrypt_columns(df: DataFrame, columns: list[str], key: Column, required: bool = True) -> DataFrame:
    """Columns as a versioned prefix and AES-GCM text. Without a key: an error if encryption is required, else as they are."""
    if key is None:
        if required:
            raise ValueError("encryption is required and no key is given")
        return df
    return df.withColumns({c: F.concat(F.lit(PREFIX), F.base64(F.aes_encrypt(F.col(c), key, F.lit("GCM")))) for c in columns})


def decrypt_columns(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    """The reverse; `error` says which rows can't be read."""
    plain = {c: F.when(F.col(c).startswith(PREFIX), F.try_aes_decrypt(F.unbase64(F.substr(c, F.lit(len(PREFIX) + 1))), key, F.lit("GCM")).cast("string")).otherwise(F.col(c)) for c in columns}
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c).isNotNull() & plain[c].isNull())
    return df.withColumns(plain | {"error": F.when(bad, "cannot be decrypted")})
