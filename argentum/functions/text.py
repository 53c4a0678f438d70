"""Scalar functions over text, dates and sizes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decimal(n: Column, unit: int, digits: int) -> Column:
    """n / unit with so many decimals, ties to the even digit: in whole numbers, so that every engine gives the same."""
    k = 10**digits
    q, r = F.floor(n * k / F.lit(unit)).cast("bigint"), F.pmod(n * k, F.lit(unit))
    q = q + F.when((r > unit // 2) | ((r == unit // 2) & (q % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(q / k).cast("bigint").cast("string"), F.lit("."), F.lpad((q % k).cast("string"), digits, "0"))


def file_size(n: Column) -> Column:
    """Bytes as B, KB, MB (one decimal) or GB (two), by powers of 1024."""
    n = n.cast("bigint")
    return (
        F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, F.concat(_decimal(n, 1 << 10, 1), F.lit(" KB")))
        .when(n < 1 << 30, F.concat(_decimal(n, 1 << 20, 1), F.lit(" MB")))
        .otherwise(F.concat(_decimal(n, 1 << 30, 2), F.lit(" GB")))
    )


def subsequence(text: Column, wanted: str) -> Column:
    """Do the characters of wanted come in text in that order, in any case? An empty wanted always fits."""
    import re

    return F.lower(text).rlike("(?s)" + ".*".join(re.escape(c) for c in wanted.lower()))


def fuzzy_file(name: Column, wanted: str) -> Column:
    """subsequence() of a file's name or of its extension."""
    return subsequence(name, wanted) | subsequence(F.regexp_extract(name, r"\.([^.]*)$", 1), wanted)


def contains_any(columns: list[Column], wanted: str) -> Column:
    """Is wanted, in any case, in any of the columns?"""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(wanted.lower()), F.lit(False))
    return found


def xml_escape(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def xml_unescape(c: Column) -> Column:
    """The inverse of xml_escape: the ampersand comes last."""
    for old, new in (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def entity_decode(c: Column) -> Column:
    """As the parameter files' parser does it: the ampersand first, so that what was escaped twice is decoded twice."""
    from argentum.sources.presets import ENTITIES

    for old, new in ENTITIES:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def tag_text(c: Column, tag: str) -> Column:
    """The text of the first <tag>...</tag>."""
    return F.nullif(F.regexp_extract(c, f"(?s)<{tag}>(.*?)</{tag}>", 1), F.lit(""))


def attribute(c: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(c, f'{name}="([^"]*)"', 1), F.lit(""))


def attribute_number(c: Column, name: str) -> Column:
    """An attribute as a 32-bit number; null if it is missing or no number."""
    return attribute(c, name).try_cast("float")


def short_folder(name: Column, prefix: str = "", longest: int = 40) -> Column:
    """A folder's name for display: without a vendor's prefix, e-mail addresses as ***, at most so many characters."""
    bare = F.when(F.startswith(name, F.lit(prefix)), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name) if prefix else name
    hidden = F.regexp_replace(bare, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "***")
    return F.when(F.length(hidden) > longest, F.concat(F.substr(hidden, F.lit(1), F.lit(longest - 1)), F.lit("…"))).otherwise(hidden)


def date_parts(parts: Column) -> Column:
    """A map of texts as (year, month, day, hour, minute, second); what is missing or no whole number is 0."""
    one = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)).try_cast("int"), F.lit(0)).alias(k.lower())
    return F.struct(*[one(k) for k in ("Year", "Month", "Day", "Hour", "Minute", "Second")])


def filled_template(template: Column, name: Column, n: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{name}"), name), F.lit("{n}"), n.cast("string"))


def shown_date(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """YYYY-MM-DD hh:mm:ss, or a dash without a year. Months and days of 0 occur, so it's no timestamp."""
    return F.when(year > 0, F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, month, day, hour, minute, second)).otherwise(F.lit("—"))


def height(count: Column, top: Column, kind: str) -> Column:
    """A bar's part of the full height: linear, sqrt, log or cbrt; 0 without a largest count."""
    f = {"linear": lambda x: x.cast("double"), "sqrt": F.sqrt, "log": F.log1p, "cbrt": F.cbrt}[kind]
    return F.when(top > 0, f(count) / F.nullif(f(top), F.lit(0.0))).otherwise(F.lit(0.0))


def patch_scalar(xml: Column, key: str, value: str) -> Column:
    """The number after the first such key replaced; without the key nothing changes."""
    return F.regexp_replace(xml, f"(?s)^(.*?<key>{key}</key>\\s*<(?:integer|real)>)[^<]*(</.*)$", f"$1{value}$2")


def patch_array(xml: Column, key: str, values: list[int]) -> Column:
    """The first array after the first such key filled with whole numbers; without the key nothing changes."""
    body = "".join(f"<integer>{v}</integer>" for v in values)
    return F.regexp_replace(xml, f"(?s)^(.*?<key>{key}</key>.*?<array>).*?(</array>.*)$", f"$1{body}$2")


def insert_after(xml: Column, anchor: str, key: str, value: str, kind: str = "integer") -> Column:
    """A key and its number put behind the number of another key."""
    return F.regexp_replace(xml, f"(?s)^(.*?<key>{anchor}</key>\\s*<(?:integer|real)>[^<]*</(?:integer|real)>)(.*)$", f"$1<key>{key}</key><{kind}>{value}</{kind}>$2")


def patch_nested_array(xml: Column, key: str, body: str) -> Column:
    """The whole array after the first such key, with arrays in it, replaced; without the key or its end nothing changes.

    The end is where as many arrays have closed as opened: the depth is summed along the tags behind the key.
    """
    at = F.instr(xml, f"<key>{key}</key>")
    behind = F.substr(xml, at + len(f"<key>{key}</key>"))
    lead = F.instr(behind, "<array>")
    parts = F.split(F.substr(behind, lead), r"(?<=</?array>)")
    opens = F.transform(parts, lambda x: F.when(F.endswith(x, F.lit("</array>")), -1).when(F.endswith(x, F.lit("<array>")), 1).otherwise(0))
    walked = F.aggregate(opens, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, d: F.struct((a["depth"] + d).alias("depth"), (a["n"] + 1).alias("n"), F.when((a["end"] == 0) & (a["depth"] + d == 0), a["n"] + 1).otherwise(a["end"]).alias("end")))["end"]
    rest = F.array_join(F.slice(parts, walked + 1, F.size(parts)), "")
    done = F.concat(F.substr(xml, F.lit(1), at + len(f"<key>{key}</key>") - 1), F.substr(behind, F.lit(1), lead - 1), F.lit(body), rest)
    return F.when((at > 0) & (lead > 0) & (walked > 0), done).otherwise(xml)


def ints_of(text: Column, separator: str = ",") -> Column:
    """The whole numbers among the parts of a text; other parts go."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x).try_cast("bigint")), lambda x: x.isNotNull())


def classify_preset(name: Column) -> Column:
    """tone, color or adv by a preset name's beginning."""
    starts = lambda *words: name.rlike("^(" + "|".join(words) + ")")
    return F.when(starts("contrast", "brightness", "lightness", "gamma", "ev"), "tone").when(starts("saturation", "temperature", "tint"), "color").otherwise("adv")
