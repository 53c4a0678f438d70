"""Queries over files. The driver's tables hold none, so small files are made from them or from literal rows."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.sources import pixels, presets, profiles, tagfiles

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sample_bytes(order: str, number: int) -> bytes:
    """A scan-like file: full image, marked thumbnail, camera facts."""
    text = lambda s: [s.encode() + b"\0"]
    size = lambda w, h, bits: [(0x0100, 4, [w]), (0x0101, 3, [h]), (0x0102, 3, [bits] * 3), (0x0103, 3, [1]), (0x0106, 3, [2]), (0x0115, 3, [3])]
    full = size(4, 3, 16) + [(0x010F, 2, text("Maker")), (0x0110, 2, text(f"Model {number}")), (0x0112, 3, [1 + number % 8]), (0x011A, 5, [(number * 100, 1)]), (0x011B, 5, [(3, 0)]), (0x0128, 3, [1 + number % 3]), (0x829A, 5, [(1, 60 + number)]), (0x829D, 5, [(56, 10)]), (0x8827, 3, [100 * number]), (0xC000, 9, [-1, -2]), (0xC001, 12, [0.5])]
    thumb = size(2, 2, 8) + [(0x00FE, 4, [1])]
    samples = struct.pack(order + "36H", *[(i * 1000 + number) % 65536 for i in range(36)])
    return tagfiles.build([full, thumb], [samples, bytes(range(12))], order, 0x55 if number % 2 else 0x2A)


def sample_files(spark: SparkSession) -> DataFrame:
    rows = [(f"/scans/roll{i % 2}/scan{i}.tif", bytearray(sample_bytes("<" if i % 2 else ">", i))) for i in range(1, 9)]
    rows += [("/scans/roll1/short.tif", bytearray(b"II*")), ("/scans/roll1/other.tif", bytearray(b"PK\3\4 not an image"))]
    return spark.createDataFrame(rows, "path string, content binary")


SCANS = "s AS (SELECT i.range AS i, '/scans/roll' || (i.range % 2) || '/scan' || i.range || '.tif' AS path FROM range(1, 9) i)"
UNIT = "['', ' dpi', ' dpcm'][i % 3 + 1]"
#: What each scan's facts are, worked out from how sample_bytes() makes it; the keys' places as the summary has them.
FACTS = [
    (0, "Format", "CASE WHEN i % 2 = 1 THEN 'magic 0x55' ELSE 'magic 0x2A' END"),
    (1, "Byte Order", "CASE WHEN i % 2 = 1 THEN 'Little-Endian (Intel)' ELSE 'Big-Endian (Motorola)' END"),
    (2, "File Size", "'514 B'"), (3, "IFD Count", "'2'"), (4, "Make", "'Maker'"), (5, "Model", "'Model ' || i"), (9, "Dimensions", "'4 × 3'"), (10, "BitsPerSample", "'[16, 16, 16]'"), (11, "Compression", "'Uncompressed'"), (12, "Photometric", "'RGB'"),
    (13, "Orientation", "['Normal', 'Flip Horizontal', 'Rotate 180', 'Flip Vertical', 'Transpose', 'Rotate 90 CW', 'Transverse', 'Rotate 270 CW'][i % 8 + 1]"),
    (14, "XResolution", f"(i * 100) || {UNIT}"), (15, "YResolution", f"'0' || {UNIT}"), (16, "ExposureTime", "'1/' || (60 + i)"), (17, "FNumber", "'f/5.6'"), (18, "ISO", "(100 * i)::VARCHAR"),
]


@query()
def tag_rows(spark, sf_dir):
    found = tagfiles.tags(sample_files(spark))
    return found.select("path", "byte_order", "magic", "ifd_idx", "ifd_name", "tag", "type", "cnt", tagfiles.shown().alias("shown"), "error")


@query()
def tag_names(spark, sf_dir):
    return tagfiles.all_tags(tagfiles.tags(sample_files(spark)))


@query(f"WITH {SCANS} " + " UNION ALL ".join(f"SELECT path, {n} AS ord, '{k}' AS key, {v} AS value FROM s" for n, k, v in FACTS))
def metadata_summary(spark, sf_dir):
    return tagfiles.summary(tagfiles.tags(sample_files(spark)))


@query(f"WITH {SCANS} SELECT path, 4::BIGINT AS width, 3::BIGINT AS height, 0 AS ifd_idx FROM s")
def best_dimensions(spark, sf_dir):
    return tagfiles.dimensions(tagfiles.tags(sample_files(spark)))


@query(f"WITH {SCANS} SELECT path, 1 AS ifd_idx, p.range // 2 AS y, p.range % 2 AS x, p.range * 3 AS r, p.range * 3 + 1 AS g, p.range * 3 + 2 AS b FROM s, range(4) p")
def thumbnail_pixels(spark, sf_dir):
    return tagfiles.pixels(sample_files(spark), thumbnail=True)


@query(f"WITH {pixels.TILES_SQL} SELECT image_id, y, x, v AS r, v AS g, v AS b FROM tile")
def image_round_trip(spark, sf_dir):
    """Tiles are exported as image files; the files' tags are parsed and their strips decoded again."""
    samples = F.flatten(F.transform("px", lambda v: F.array_repeat(v.cast("bigint"), 3)))
    images = pixels.images(spark, sf_dir).select(F.col("image_id").cast("string").alias("path"), "width", "height", samples.alias("samples"))
    px = tagfiles.pixels(tagfiles.export(images))
    return px.select(F.col("path").cast("bigint").alias("image_id"), *[F.col(c).cast("bigint").alias(c) for c in ("y", "x", "r", "g", "b")])


def profile_bytes(name: str, kind: str, wide: bool) -> bytes:
    raw = name.encode("utf-16-be")
    body = b"mluc\0\0\0\0" + struct.pack(">II2s2sII", 1, 12, b"en", b"US", len(raw), 28) + raw if wide else b"desc\0\0\0\0" + struct.pack(">I", len(name) + 1) + name.encode() + b"\0"
    head = struct.pack(">I4sBB2s4s4s4s6H4s", 144 + len(body), b"none", 4 if wide else 2, 0x21, b"\0\0", kind.encode(), b"RGB ", b"Lab ", 2001, 2, 3, 4, 5, 6, b"acsp")
    head = head.ljust(48, b"\0") + b"mftrmodl" + b"\0" * 8 + struct.pack(">Iiii", 1, 63190, 65536, 54061)
    return head.ljust(128, b"\0") + struct.pack(">I4sII", 1, b"desc", 144, len(body)) + body


def sample_profiles(spark: SparkSession) -> DataFrame:
    rows = [(f"/icc/p{i}.icc", bytearray(profile_bytes(f"Profile {9 - i}", ("scnr", "mntr", "prtr")[i % 3], i % 2 == 0))) for i in range(6)]
    return spark.createDataFrame([*rows, ("/icc/small.icc", bytearray(b"x" * 100)), ("/icc/bare name.icc", bytearray(profile_bytes("x", "mntr", False)[:128]))], "path string, content binary")


@query("SELECT '/icc/p' || i.range || '.icc' AS path, 'Profile ' || (9 - i.range) AS name, ['scnr', 'mntr', 'prtr'][i.range % 3 + 1] AS class, 'RGB' AS color_space FROM range(6) i UNION ALL SELECT '/icc/bare name.icc', 'bare name', 'mntr', 'RGB'")
def icc_catalogue(spark, sf_dir):
    return profiles.catalogue(sample_profiles(spark))


@query()
def icc_details(spark, sf_dir):
    return profiles.details(sample_profiles(spark))


def preset_text(i: int) -> str:
    curve = f"<array><dict><key>Points</key><array><dict><key>X</key><integer>0</integer><key>Y</key><integer>{i}</integer></dict><dict><key>X</key><integer>255</integer></dict></array></dict></array>"
    body = f"<key>Contrast</key><integer>{i}</integer><key>Gamma</key><real>1.{i}</real><key>ApplyCC</key><true/><key>Saturation</key><string>many</string><key>Shadow</key><array><integer>{i}</integer><string>x</string><integer>7</integer></array><key>Gradations</key>{curve}<key>InputProfile</key><dict><key>Name</key><string>In &amp;lt;{i}&amp;gt;</string></dict>"
    return f'<?xml version="1.0"?><!DOCTYPE plist><plist version="1.0"><dict><key>ImageSetting</key><dict><key>Name</key><string>Preset {i}</string><key>ImageCorrection</key><dict>{body}</dict></dict></dict></plist>'


def sample_presets(spark: SparkSession) -> DataFrame:
    rows = [(f"/presets/kind{i % 2}/p{i}.xml", preset_text(i)) for i in range(6)]
    return spark.createDataFrame([*rows, ("/presets/broken.xml", preset_text(7)[:420]), ("/presets/empty.xml", "")], "path string, xml string")


PRESETS = "p AS (SELECT i.range AS i, '/presets/kind' || (i.range % 2) || '/p' || i.range || '.xml' AS path FROM range(6) i)"
PARAMETERS = [("Contrast", "integer", "i::VARCHAR"), ("Gamma", "real", "'1.' || i"), ("ApplyCC", "true", "'true'"), ("Saturation", "string", "'many'"), ("Shadow", "array", "NULL"), ("Gradations", "array", "NULL"), ("InputProfile", "dict", "'In <' || i || '>'")]


#: The text that breaks off after its fifth parameter is the seventh preset's.
@query(f"WITH {PRESETS}, p8 AS (SELECT * FROM p UNION ALL SELECT 7, '/presets/broken.xml') " + " UNION ALL ".join(f"SELECT path, 0 AS setting, 'Preset ' || i AS name, {n} AS ord, '{k}' AS key, '{kind}' AS kind, {v} AS value FROM {'p' if n > 4 else 'p8'}" for n, (k, kind, v) in enumerate(PARAMETERS)))
def plist_params(spark, sf_dir):
    return presets.parameters(sample_presets(spark)).select("path", "setting", "name", "ord", "key", "kind", "value")


@query()
def preset_corrections(spark, sf_dir):
    return presets.corrections(presets.parameters(sample_presets(spark))).select("path", "name", "Contrast", "Gamma", "EV", "Saturation", "ApplyCC", "Shadow", "InputProfile")


@query(f"WITH {PRESETS} SELECT path, 'kind' || (i % 2) AS category, 'p' || i AS name FROM p UNION ALL VALUES ('/presets/broken.xml', '', 'broken'), ('/presets/empty.xml', '', 'empty')")
def preset_catalogue(spark, sf_dir):
    return presets.catalogue(sample_presets(spark), "/presets")
