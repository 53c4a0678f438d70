"""ICC colour profiles: header, description and tag table, all by columns over the file's bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the profile format.
CLASSES = {"scnr": "Scanner", "mntr": "Monitor", "prtr": "Printer", "link": "Device Link", "spac": "Color Space", "abst": "Abstract", "nmcl": "Named Color"}
INTENTS = ["Perceptual", "Relative Colorimetric", "Saturation", "Absolute Colorimetric"]


def number(data: Column, at: Column | int, size: int = 4) -> Column:
    """An unsigned big-endian number; at counts from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(data.substr((at + 1).cast("int"), F.lit(size))), 16, 10).cast("bigint")


def mark(data: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.trim(F.decode(data.substr((at + 1).cast("int"), F.lit(4)), "UTF-8"))


def fixed(data: Column, at: int) -> Column:
    """A signed number with 16 bits after the point."""
    n = number(data, at)
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n) / 65536.0


def tag_table(data: Column) -> Column:
    """The tags (sig, off, size) as far as they lie in the file."""
    n = F.least(number(data, 128), F.floor((F.length(data) - 132) / 12))
    spots = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), lambda i: i < n)
    return F.transform(spots, lambda i: F.struct(mark(data, 132 + i * 12).alias("sig"), number(data, 136 + i * 12).alias("off"), number(data, 140 + i * 12).alias("size")))


def description(data: Column, table: Column) -> Column:
    """The first usable description: version 2 as ASCII with its count, version 4 as the first UTF-16 record."""
    good = F.filter(table, lambda t: (t["sig"] == "desc") & (t["size"] > 12) & (t["off"] + t["size"] <= F.length(data)))

    def read(t: Column) -> Column:
        kind, n = mark(data, t["off"]), number(data, t["off"] + 8)
        ascii_ = F.when((n > 0) & (t["off"] + 12 + n <= F.length(data)), F.decode(data.substr((t["off"] + 13).cast("int"), (n - 1).cast("int")), "UTF-8"))
        size, off = number(data, t["off"] + 20), number(data, t["off"] + 24)
        wide = F.when((t["size"] >= 28) & (size >= 2) & (off + size <= t["size"]), F.decode(data.substr((t["off"] + off + 1).cast("int"), size.cast("int")), "UTF-16BE"))
        return F.when(kind == "desc", ascii_).when(kind == "mluc", wide)

    return F.get(F.filter(F.transform(good, read), lambda x: x.isNotNull()), F.lit(0))


def catalogue(files: DataFrame) -> DataFrame:
    """(path, name, class, color_space), by name. Files under 128 bytes aren't profiles; a file's stem stands in for its description."""
    d = F.col("content")
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    named = files.filter(F.length(d) >= 128).withColumn("_name", F.when(F.length(d) >= 132, description(d, tag_table(d))))
    return named.select("path", F.coalesce("_name", stem).alias("name"), mark(d, 12).alias("class"), mark(d, 16).alias("color_space")).orderBy("name", "path")


def details(files: DataFrame) -> DataFrame:
    """Everything in the headers of files of 132 bytes or more."""
    d = F.col("content")
    two = lambda at: number(d, at, 2)
    version = F.format_string("%d.%d.%d", number(d, 8, 1), F.shiftright(number(d, 9, 1), 4), number(d, 9, 1).bitwiseAND(F.lit(15).cast("bigint")))
    intent = F.coalesce(F.get(F.array(*map(F.lit, INTENTS)), number(d, 64).cast("int")), F.lit("Unknown"))
    class_name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv]), mark(d, 12)), F.lit("Unknown"))
    return files.filter(F.length(d) >= 132).select(
        "path", number(d, 0).alias("size"), mark(d, 4).alias("cmm"), version.alias("version"), mark(d, 12).alias("class"), class_name.alias("class_name"), mark(d, 16).alias("color_space"), mark(d, 20).alias("pcs"),
        F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *[two(24 + 2 * i) for i in range(6)]).alias("date_time"), mark(d, 48).alias("manufacturer"), mark(d, 52).alias("model"), intent.alias("intent"),
        F.format_string("X=%.4f Y=%.4f Z=%.4f", fixed(d, 68), fixed(d, 72), fixed(d, 76)).alias("illuminant"), F.coalesce(description(d, tag_table(d)), F.lit("")).alias("description"), number(d, 128).alias("tag_count"), tag_table(d).alias("tags"),
    )
