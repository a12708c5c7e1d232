"""Markup as text: attributes, entities, escaping, dates, slugs."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is dropped before tokens are cut: bodies of scripts and styles can hold what looks like tags. One pattern for each.
HIDDEN = [r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?s)<!--.*?-->"]
#: A tag, in which quoted values of attributes may hold ">"; else text.
TOKEN = r"""<[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>|<[^>]*>|[^<]+"""


def visible(html: Column) -> Column:
    for pattern in HIDDEN:
        html = F.regexp_replace(html, pattern, "")
    return html


def has_attribute(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?is)\s{name}\s*=")


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value as it is written, "" without one; with double, single or no quotes."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])
    return F.when(F.lower(tag).contains(name), value).otherwise("")  # most tags don't have it


def classes(tag: Column) -> Column:
    """A tag's classes, with a blank before and behind each."""
    return F.concat(F.lit(" "), F.regexp_replace(attribute(tag, "class"), r"\s+", " "), F.lit(" "))


def substituted(text: Column, pattern: str, to) -> Column:
    """text with each match of the pattern (one that isn't empty) replaced by to(match), a column."""

    def joined(found: Column) -> Column:
        return F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda part, m: F.concat(part, F.when(m.isNotNull(), to(m)).otherwise(""))), "")

    found = F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.when(text.rlike(pattern), F.get(F.transform(found, joined), F.lit(0))).otherwise(text)


#: What follows "&": a number, or a name of the HTML standard, as Python has them, longest first: some need no semicolon, and the longest that fits
#: counts.
_ENTITY = "^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|" + "|".join(sorted(html5, key=lambda name: (-len(name), name))) + ")"
#: The same, of those that a semicolon ends.
_CLOSED = "^(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|" + "|".join(sorted((name for name in html5 if name.endswith(";")), key=lambda name: (-len(name), name))) + ")"


def _literal_map(of: dict[str, str]) -> Column:
    """One literal for the optimizer to fold, not one for each entry."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in of.items())), F.lit("\x02"), F.lit("\x01"))


def _numbered(digits: Column) -> Column:
    """The character of a number, or of x and a hexadecimal number. 128 to 159 are Windows-1252, as in browsers; what can't be a character is the
    replacement character."""
    hexadecimal = F.lower(F.substring(digits, 1, 1)) == "x"
    n = F.when(F.length(digits) > 9, F.lit(1 << 30)).when(hexadecimal, F.conv(F.substring(digits, 2, 8), 16, 10).cast("long")).otherwise(digits.cast("long"))
    windows = "".join(chr(k) if k in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([k]).decode("cp1252") for k in range(128, 160))
    n = F.when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(n)
    return F.when(n.between(128, 159), F.substring(F.lit(windows), (n - 127).cast("int"), F.lit(1))).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Entities that are looked for before all others, since most are these.
_COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "#39;")


def decoded(text: Column, bare: bool = True) -> Column:
    """Entities as characters: numbers, and all names of the HTML standard. text should be a column: it is named several times. bare: also those
    that no semicolon ends, where the standard allows it; else they are text."""

    def shown(part: Column, k: Column) -> Column:
        def general(entity: Column) -> Column:
            char = F.when(entity.startswith("#"), _numbered(F.rtrim(F.substring(entity, 2, 40), F.lit(";")))).otherwise(F.try_element_at(_literal_map(html5), entity))
            return F.when(entity == "", F.concat(F.lit("&"), part)).otherwise(F.concat(char, F.substring(part, F.length(entity) + 1, F.length(part))))

        out = F.when(k == 0, part)
        for name in _COMMON:
            out = out.when(part.startswith(name), F.concat(F.lit(unescape("&" + name)), F.substring(part, F.lit(len(name) + 1), F.length(part))))
        return out.otherwise(once(F.regexp_extract(part, _ENTITY if bare else _CLOSED, 0), general))

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "&", -1), shown), "")).otherwise(text)


def escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def without_namespaced_tags(html: Column) -> Column:
    """Tags such as <x:y ...> go, what they hold stays."""
    return F.regexp_replace(html, r"</?[a-zA-Z][a-zA-Z0-9]*:[^>]*>", "")


def collapsed(html: Column) -> Column:
    """White space collapsed, and dropped between tags."""
    html = F.regexp_replace(html, r"\s+", " ")
    return F.trim(F.regexp_replace(html, r">\s+<", "><"))


# Date formats in the order they are tried; single digits are taken too.
DATE_FORMATS = ["yyyy-M-d'T'H:m:sXXX", "yyyy-M-d'T'H:m:sXX", "yyyy-M-d'T'H:m:s", "yyyy-M-d", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"]


def parsed_date(text: Column) -> Column:
    """The first format that reads the trimmed text, else null."""
    text = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition (NFKD) leaves of characters in ASCII: of those with one character left, and of others."""
    one, more = {}, {}
    for k in range(128, sys.maxunicode + 1):
        plain = unicodedata.normalize("NFKD", chr(k))
        if plain != chr(k) and (plain := plain.encode("ascii", "ignore").decode()):
            (one if len(plain) == 1 else more)[chr(k)] = plain
    return one, more


SLUG_LENGTH = 80


def slug(title: Column) -> Column:
    """Lower-case words of a title joined by hyphens, 80 characters at most; "article" if nothing is left. Letters are decomposed (NFKD), and
    what isn't ASCII then is dropped."""
    one, more = _folds()
    folded = F.translate(title, "".join(one), "".join(one.values()))
    several = F.exists(F.split(F.regexp_replace(title, r"[\x00-\x7f]+", ""), ""), lambda c: c.isin(*more))
    folded = F.when(several, substituted(folded, r"[^\x00-\x7f]", lambda c: F.coalesce(F.try_element_at(_literal_map(more), c), F.lit("")))).otherwise(folded)
    folded = F.when(F.octet_length(title) == F.char_length(title), title).otherwise(folded)
    s = F.regexp_replace(F.lower(F.regexp_replace(folded, r"[^a-zA-Z0-9\s-]+", "")), r"[\s-]+", "-")
    s = F.trim(s, F.lit("-"))
    s = F.when(F.length(s) > SLUG_LENGTH, F.rtrim(F.substring(s, 1, SLUG_LENGTH), F.lit("-"))).otherwise(s)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("article"))
