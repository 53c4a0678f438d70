"""Tagged image files (TIFF 6.0 directories): files, tags, and what is derived from tags.

A file is one row of Spark's binaryFile source; a parser turns it into one row for each tag. Everything
after that is columns. For files of 100 MB set spark.sql.execution.arrow.maxRecordsPerBatch to a few rows.
"""

from __future__ import annotations

import os
import re
import struct
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fixed values of the file format: type code to (letter for struct, bytes of one value).
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("s", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8)}
SUB, EXIF, NOTE = 0x014A, 0x8769, 0x927C
MAX_DIRECTORIES, MAX_ENTRIES, MAX_NOTE_ENTRIES, MAX_NOTE_VALUE = 20, 1000, 500, 65536

# Names of codes.
ORIENTATION = {1: "Normal", 2: "Flip Horizontal", 3: "Rotate 180", 4: "Flip Vertical", 5: "Transpose", 6: "Rotate 90 CW", 7: "Transverse", 8: "Rotate 270 CW"}
COMPRESSION = {1: "Uncompressed", 2: "CCITT 1D", 3: "Group 3 Fax", 4: "Group 4 Fax", 5: "LZW", 6: "JPEG (old)", 7: "JPEG", 8: "Deflate", 32773: "PackBits", 34713: "Nikon NEF", 65535: "Hasselblad Lossless"}
PHOTOMETRIC = {0: "WhiteIsZero", 1: "BlackIsZero", 2: "RGB", 3: "Palette", 4: "Transparency Mask", 5: "CMYK", 6: "YCbCr", 8: "CIELab", 32803: "CFA (Color Filter Array)", 34892: "LinearRaw"}
METERING = {0: "Unknown", 1: "Average", 2: "Center Weighted", 3: "Spot", 4: "Multi-Spot", 5: "Multi-Segment", 6: "Partial", 255: "Other"}
WHITE_BALANCE = {1: "Auto", 2: "Daylight", 3: "Tungsten", 4: "Fluorescent", 5: "Flash", 6: "Manual", 10: "Cloudy", 11: "Shade"}
# Names of tags.
TAG_NAMES = {
    0x00FE: "NewSubfileType", 0x00FF: "SubfileType", 0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterpretation", 0x010E: "ImageDescription", 0x010F: "Make",
    0x0110: "Model", 0x0111: "StripOffsets", 0x0112: "Orientation", 0x0115: "SamplesPerPixel", 0x0116: "RowsPerStrip", 0x0117: "StripByteCounts", 0x011A: "XResolution", 0x011B: "YResolution", 0x011C: "PlanarConfiguration",
    0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x013D: "Predictor", 0x014A: "SubIFDs", 0x0153: "SampleFormat", 0x0201: "JPEGInterchangeFormat", 0x0202: "JPEGInterchangeFormatLength",
    0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8769: "ExifIFD", 0x8773: "ICCProfile", 0x8822: "ExposureProgram", 0x8827: "ISOSpeedRatings", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal",
    0x9004: "DateTimeDigitized", 0x9207: "MeteringMode", 0x9209: "Flash", 0x920A: "FocalLength", 0x927C: "MakerNote", 0xA001: "ColorSpace", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA431: "BodySerialNumber",
}
NOTE_NAMES = {0x0005: "WhiteBalance", 0x0013: "Quality", 0x0015: "Model", 0x0017: "CameraInfo", 0x0018: "LensInfo", 0x0028: "PhocusVersion", 0x002A: "ColorMatrix", 0x0046: "Gain", 0x0047: "FocusPoint", 0x004A: "ShutterType", 0x0059: "CropMode", 0x005B: "DriveMode", 0x005C: "ReleaseCount", 0x0061: "LensSerialNumber", 0x0063: "ExactExposureTime"}

VALUE = "struct<bytes: binary, s: string, ints: array<bigint>, rats: array<struct<n: bigint, d: bigint>>, floats: array<double>>"
SCHEMA = f"path string, size bigint, byte_order string, magic int, ifd_idx int, ifd_name string, tag int, type int, cnt bigint, value {VALUE}, error string"


def list_files(spark: SparkSession, path: str, extensions: list[str], depth: int | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of files below path by extension in any case, none in hidden folders.

    depth: folders below path that are looked into, all if None. Columns that aren't used are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:/*"
    base = re.sub(scheme, "/", path) if re.match(scheme, path) else os.path.abspath(path)
    base = base.rstrip("/") + "/"
    named = F.regexp_replace("path", scheme, "/")
    # what follows the first place of the root; names in it are no patterns
    below = F.substr(named, F.instr(named, base) + len(base))
    files = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower() for e in extensions]) & ~below.rlike(r"(^|/)\.[^/]+/"))
    return files if depth is None else files.filter(F.size(F.split(below, "/")) <= depth + 1)


class TagError(ValueError):
    pass


class Ranges:
    """A file of which only the blocks are read that slices ask for; read counts the bytes."""

    def __init__(self, file, size: int, block: int = 1 << 14, most_blocks: int = 64):
        self.file, self.size, self.block, self.most_blocks, self.blocks, self.read = file, size, block, most_blocks, {}, 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, end, _ = part.indices(self.size)
        got = []
        for k in range(start // self.block, -(-end // self.block) if end > start else start // self.block):
            if k not in self.blocks:
                if len(self.blocks) >= self.most_blocks:
                    self.blocks.clear()
                self.file.seek(k * self.block)
                self.blocks[k] = self.file.read(min(self.block, self.size - k * self.block))
                self.read += len(self.blocks[k])
            got.append(self.blocks[k][max(start - k * self.block, 0) : end - k * self.block])
        return b"".join(got)


class Reader:
    """Reads values and directories from bytes, or a file's ranges, in one byte order. All places are checked."""

    def __init__(self, data: "bytes | Ranges", order: str):
        self.data, self.order = data, order

    def take(self, at: int, letters: str, size: int) -> tuple:
        if at < 0 or at + size > len(self.data):
            raise TagError(f"{size} bytes at {at} lie outside the file")
        return struct.unpack(self.order + letters, self.data[at : at + size])

    def value(self, kind: int, count: int, at: int) -> dict:
        letter, size = TYPES[kind]
        if kind in (2, 7, 1):
            raw = self.take(at, f"{count}s", count)[0]
            if kind == 2:
                return {"s": raw.decode("utf-8", "replace").rstrip("\0")}
            return {"bytes": raw, "ints": list(raw) if kind == 1 else None}
        got = self.take(at, letter * count, size * count)
        if kind in (5, 10):
            return {"rats": [{"n": n, "d": d} for n, d in zip(got[::2], got[1::2])]}
        return {"floats": list(got)} if kind in (11, 12) else {"ints": list(got)}

    def directory(self, at: int, most_entries: int = MAX_ENTRIES, shift: int = 0, most_bytes: int | None = None) -> tuple[dict[int, tuple], int]:
        """({tag: (type, count, value)}, place of the next). Of a tag's entries the last stands; unreadable ones go."""
        (n,) = self.take(at, "H", 2)
        if n > most_entries:
            raise TagError(f"{n} entries in a directory")
        found: dict[int, tuple] = {}
        for place in range(at + 2, at + 2 + 12 * n, 12):
            if most_bytes is not None and place + 12 > len(self.data):
                break
            tag, kind, count, where = self.take(place, "HHII", 12)
            if kind not in TYPES:
                continue
            size = TYPES[kind][1] * count
            if most_bytes is not None and size > most_bytes:
                continue
            try:
                found[tag] = (kind, count, self.value(kind, count, place + 8 if size <= 4 else where - shift))
            except TagError:
                continue
        try:
            (following,) = self.take(at + 2 + 12 * n, "I", 4)
        except TagError:
            following = 0
        return dict(sorted(found.items())), following


def _numbers(entry: tuple | None) -> list[int]:
    return (entry[2].get("ints") or []) if entry and entry[0] in (1, 3, 4) else []


def _note(data: bytes, order: str) -> dict[int, tuple]:
    """A maker's note: a directory of its own, after a name that ends with a zero byte, if there is one."""
    at = 0
    if len(data) > 12 and data[:10].isalpha():
        at = data.find(b"\0") + 1
        at += at % 2
    reader = Reader(data[at:], order)
    (n,) = reader.take(0, "H", 2)
    if not n:
        raise TagError("an empty note")
    return reader.directory(0, MAX_NOTE_ENTRIES, at, MAX_NOTE_VALUE)[0]


def parse(data: "bytes | Ranges") -> tuple[str, int, list[tuple[str, dict[int, tuple]]]]:
    """(byte order, magic number, [(name, directory)]). A faulty main directory raises; faulty further ones are left out."""
    if len(data) < 8:
        raise TagError("the file is too small")
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise TagError("no byte order mark")
    reader = Reader(data, order)
    magic, at = reader.take(2, "HI", 6)
    if magic not in (0x2A, 0x55):
        raise TagError(f"magic number {magic}")
    found: list[tuple[str, dict[int, tuple]]] = []
    number = 0
    while 0 < at < len(data) and number <= MAX_DIRECTORIES:
        main, at_next = reader.directory(at)
        found.append((f"IFD#{number}", main))
        more = [(f"IFD#{number}:Sub#{k}", p) for k, p in enumerate(_numbers(main.get(SUB)))]
        more += [("EXIF", p) for p in _numbers(main.get(EXIF))[:1]]
        for name, place in more:
            if not 0 < place < len(data):
                continue
            try:
                below, _ = reader.directory(place)
            except TagError:
                continue
            found.append((name, below))
            note = below.get(NOTE) if name == "EXIF" else None
            if note and note[0] == 7:
                try:
                    found.append(("MakerNote", _note(note[2]["bytes"], order)))
                except TagError:
                    pass
        at, number = at_next, number + 1
    return ("LE" if order == "<" else "BE"), magic, found


def _opened(path: str) -> tuple:
    """(file, size) of a path in any file system that Arrow knows."""
    from pyarrow import fs

    local = re.sub(r"^file:/*", "/", path)
    system, name = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
    return system.open_input_file(name), system.get_file_info(name).size


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of paths as batches of (path, ranges of the file)."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            file, size = _opened(path)
            with file:
                yield from _rows_of(path, Ranges(file, size))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield from _rows_of(path, content.as_buffer().to_pybytes() if content.is_valid else b"")


def _rows_of(path: str, data: "bytes | Ranges") -> Iterator[pa.RecordBatch]:
    kinds = pa.schema(
        [
            ("path", pa.string()), ("size", pa.int64()), ("byte_order", pa.string()), ("magic", pa.int32()), ("ifd_idx", pa.int32()), ("ifd_name", pa.string()), ("tag", pa.int32()), ("type", pa.int32()), ("cnt", pa.int64()),
            ("value", pa.struct([("bytes", pa.binary()), ("s", pa.string()), ("ints", pa.list_(pa.int64())), ("rats", pa.list_(pa.struct([("n", pa.int64()), ("d", pa.int64())]))), ("floats", pa.list_(pa.float64()))])),
            ("error", pa.string()),
        ]
    )
    head = {"path": path, "size": len(data)}
    try:
        order, magic, found = parse(data)
    except TagError as e:
        yield pa.RecordBatch.from_pylist([head | {"error": str(e)}], kinds)
        return
    rows = [head | {"byte_order": order, "magic": magic, "ifd_idx": i, "ifd_name": name, "tag": tag, "type": kind, "cnt": count, "value": value} for i, (name, directory) in enumerate(found) for tag, (kind, count, value) in directory.items()]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, kinds)


def tags(files: DataFrame) -> DataFrame:
    """One row for each tag of each file; a file that can't be parsed gives one row with its error."""
    return files.select("path", "content").mapInArrow(_rows, SCHEMA)


def scan_tags(paths: DataFrame) -> DataFrame:
    """tags() of the files at (path), of which only the blocks with directories and tags' values are read.

    A scan of 100 MB has its directories within some blocks of 16 KB; its samples stay where they are.
    """
    return paths.select("path").mapInArrow(_scanned, SCHEMA)


def as_number(value: str = "value", kind: str = "type") -> Column:
    """The first value of an unsigned whole-number tag, else null."""
    return F.when(F.col(kind).isin(1, 3, 4), F.get(F.col(value)["ints"], F.lit(0)))


def as_numbers(value: str = "value", kind: str = "type") -> Column:
    return F.coalesce(F.when(F.col(kind).isin(1, 3, 4), F.col(value)["ints"]), F.array().cast("array<bigint>"))


def as_text(value: str = "value", kind: str = "type") -> Column:
    return F.when(F.col(kind) == 2, F.col(value)["s"])


def as_double(value: str = "value", kind: str = "type") -> Column:
    """The first value as a number; a ratio over 0 is 0; signed whole numbers, texts and raw bytes have none."""
    r = F.get(F.col(value)["rats"], F.lit(0))
    ratio = F.when(r["d"] == 0, F.lit(0.0)).otherwise(r["n"] / F.nullif(r["d"], F.lit(0)))
    return F.when(F.col(kind).isin(1, 3, 4), F.get(F.col(value)["ints"], F.lit(0)).cast("double")).when(F.col(kind).isin(5, 10), ratio).when(F.col(kind).isin(11, 12), F.get(F.col(value)["floats"], F.lit(0)))


def shown(value: str = "value", kind: str = "type", count: str = "cnt") -> Column:
    """A tag's value as text: single values bare, at most eight of an array, sizes of raw bytes."""
    v, k, n = F.col(value), F.col(kind), F.col(count)
    listed = lambda items: F.concat(F.lit("["), F.array_join(F.slice(items, 1, 8), ", "))
    closed = lambda items: F.concat(listed(items), F.lit("]"))
    told = lambda items: F.when(F.size(items) > 8, F.concat(listed(items), F.format_string(", ... (%d total)]", F.size(items)))).otherwise(closed(items))
    ints = F.transform(v["ints"], lambda x: x.cast("string"))
    rats = F.transform(v["rats"], lambda x: F.concat_ws("/", x["n"].cast("string"), x["d"].cast("string")))
    floats = F.transform(v["floats"], lambda x: F.format_string("%.4f", x))
    one = F.get(v["rats"], F.lit(0))
    whole = (k == 5) & (F.try_mod(one["n"], one["d"]) == 0)
    single = F.when(one["d"] == 0, F.lit("0")).when(whole, (one["n"] / F.nullif(one["d"], F.lit(0))).cast("bigint").cast("string")).otherwise(F.get(rats, F.lit(0)))
    return (
        F.when(k == 2, v["s"])
        .when(k == 6, F.format_string("[%d sbytes]", n))
        .when((k == 7) | ((k == 1) & (n != 1)), F.format_string("[%d bytes]", n))
        .when(k.isin(1, 3, 4) & (n == 1), F.get(ints, F.lit(0)))
        .when(k.isin(5, 10) & (n == 1), single)
        .when(k.isin(11, 12) & (n == 1), F.get(floats, F.lit(0)))
        .when(k.isin(3, 4), told(ints))
        .when(k.isin(5, 10), told(rats))
        .when(k.isin(8, 9), closed(ints))
        .otherwise(closed(floats))
    )


def name_of(code: Column, names: dict[int, str], other: str = "Unknown") -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code.cast("int")), F.lit(other))


def all_tags(found: DataFrame) -> DataFrame:
    """(path, ifd_idx, ifd_name, hex, name, shown), in the order of directories and tags."""
    named = F.when(F.col("ifd_name") == "MakerNote", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NOTE_NAMES.items() for x in kv]), F.col("tag")), name_of(F.col("tag"), TAG_NAMES))).otherwise(name_of(F.col("tag"), TAG_NAMES))
    return found.filter("error IS NULL").select("path", "ifd_idx", "ifd_name", "tag", F.format_string("0x%04X", "tag").alias("hex"), named.alias("name"), shown().alias("shown"))


def first_values(found: DataFrame) -> DataFrame:
    """Of each tag of a file the entry in the first directory that has it."""
    w = W.partitionBy("path", "tag").orderBy("ifd_idx")
    return found.filter("error IS NULL").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dimensions(found: DataFrame) -> DataFrame:
    """(path, width, height, ifd_idx) of the directory with the most pixels; of equals the first."""
    n = lambda tag: F.max(F.when(F.col("tag") == tag, as_number()))
    sizes = found.filter("error IS NULL").groupBy("path", "ifd_idx").agg(F.coalesce(n(0x0100), F.lit(0)).alias("width"), F.coalesce(n(0x0101), F.lit(0)).alias("height"))
    best = sizes.filter("width * height > 0").groupBy("path").agg(F.max_by(F.struct("width", "height", "ifd_idx"), F.struct((F.col("width") * F.col("height")).alias("px"), (-F.col("ifd_idx")).alias("i"))).alias("b"))
    return best.select("path", "b.*")


def rgb_directories(found: DataFrame) -> DataFrame:
    """(path, ifd_idx, width, height, bits, thumbnail, offsets, lengths): directories whose strips are plain RGB samples."""
    first = lambda tag: F.max(F.when(F.col("tag") == tag, as_number()))
    array = lambda tag: F.first(F.when(F.col("tag") == tag, as_numbers()), True)
    d = found.filter("error IS NULL").groupBy("path", "ifd_idx").agg(
        F.coalesce(first(0x0100), F.lit(0)).alias("width"),
        F.coalesce(first(0x0101), F.lit(0)).alias("height"),
        F.coalesce(first(0x0102), F.lit(8)).alias("bits"),
        F.coalesce(first(0x0103), F.lit(1)).alias("compression"),
        F.coalesce(first(0x0106), F.lit(0)).alias("photometric"),
        F.coalesce(first(0x0115), F.lit(1)).alias("samples"),
        (F.coalesce(first(0x00FE), F.lit(0)) == 1).alias("thumbnail"),
        array(0x0111).alias("offsets"),
        array(0x0117).alias("lengths"),
    )
    return d.filter("compression = 1 AND photometric = 2 AND samples >= 3 AND width > 0 AND height > 0").drop("compression", "photometric", "samples")


def choose(directories: DataFrame, thumbnail: bool) -> DataFrame:
    """One directory for each file: the largest, or the best thumbnail (marked ones first, then the smallest)."""
    px = F.col("width") * F.col("height")
    order = [F.col("thumbnail").desc(), px, F.col("ifd_idx")] if thumbnail else [px.desc(), F.col("ifd_idx")]
    return directories.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy(*order))).filter("_n = 1").drop("_n")


PIXELS = "path string, ifd_idx int, y int, x int, r int, g int, b int"


def _plain_rgb(found: list[tuple[str, dict[int, tuple]]]) -> list[dict]:
    """The directories that rgb_directories() finds, from a file's parsed ones."""
    out = []
    for i, (_, d) in enumerate(found):
        one = lambda tag, other: (_numbers(d.get(tag)) or [other])[0]
        width, height = one(0x0100, 0), one(0x0101, 0)
        if one(0x0103, 1) == 1 and one(0x0106, 0) == 2 and one(0x0115, 1) >= 3 and width > 0 and height > 0:
            out.append({"ifd": i, "width": width, "height": height, "bits": one(0x0102, 8), "kind": one(0x00FE, 0), "offsets": _numbers(d.get(0x0111)), "lengths": _numbers(d.get(0x0117))})
    return out


def _chosen(directories: list[dict], thumbnail: bool) -> dict | None:
    px = lambda d: d["width"] * d["height"]
    order = (lambda d: (d["kind"] != 1, px(d), d["ifd"])) if thumbnail else (lambda d: (-px(d), d["ifd"]))
    return min(directories, key=order, default=None)


def _image(data: bytes, d: dict):
    """The samples (height, width, 3) of a directory; strips outside the file are left out; None if there are too few bytes."""
    import numpy as np

    raw = b"".join(data[o : o + n] for o, n in zip(d["offsets"], d["lengths"]) if o + n <= len(data))
    if d["bits"] not in (8, 16) or len(raw) < d["width"] * d["height"] * 3 * d["bits"] // 8:
        return None
    kind = np.uint8 if d["bits"] == 8 else np.dtype("<u2" if data[:2] == b"II" else ">u2")
    return np.frombuffer(raw, kind, d["width"] * d["height"] * 3).reshape(d["height"], d["width"], 3)


def _pixel_batches(path: str, ifd: int, image, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of an image (height, width, channels), in bands of bounded size."""
    import numpy as np

    band = max(1, (1 << 18) // image.shape[1])
    for top in range(0, image.shape[0], band):
        part = image[top : top + band].astype(np.int32)
        y, x = np.mgrid[top : top + part.shape[0], 0 : part.shape[1]].astype(np.int32)
        same = pa.DictionaryArray.from_arrays(pa.array(np.zeros(y.size, np.int32)), pa.array([path])).dictionary_decode()
        yield pa.RecordBatch.from_arrays([same, pa.array(np.full(y.size, ifd, np.int32)), pa.array(y.ravel()), pa.array(x.ravel()), *[pa.array(part[:, :, c].ravel()) for c in range(len(names))]], names=["path", "ifd_idx", "y", "x", *names])


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, list[dict]]]:
    """(path, bytes, plain RGB directories) of each file that can be parsed."""
    for batch in batches:
        for i, path in enumerate(batch.column(0).to_pylist()):
            content = batch.column(1)[i]
            data = content.as_buffer().to_pybytes() if content.is_valid else b""
            try:
                yield path, data, _plain_rgb(parse(data)[2])
            except TagError:
                continue


def pixels(files: DataFrame, thumbnail: bool = False, factor: int = 1) -> DataFrame:
    """(path, ifd_idx, y, x, r, g, b) of each file's largest image, or its best thumbnail; every factor-th row and column.

    A file is parsed, chosen from and decoded in one pass: its bytes are read once and never shuffled. Files that can't
    be parsed, and directories with too few bytes or other than 8 or 16 bits, have no pixels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, data, found in _files(batches):
            d = _chosen(found, thumbnail)
            image = _image(data, d) if d else None
            if image is not None:
                yield from _pixel_batches(path, d["ifd"], image[::factor, ::factor], ["r", "g", "b"])

    return files.select("path", "content").mapInArrow(run, PIXELS)


def image_tiles(files: DataFrame, size: int = 512, halo: int = 16, thumbnail: bool = False) -> DataFrame:
    """Each file's largest image, or its best thumbnail, as tiles (see operators/tiles) with r, g, b; the path is their image_id."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, data, found in _files(batches):
            d = _chosen(found, thumbnail)
            image = _image(data, d) if d else None
            if image is None:
                continue
            height, width = image.shape[:2]
            for y in range(0, height, size):
                for x in range(0, width, size):
                    part = image[max(0, y - halo) : y + size + halo, max(0, x - halo) : x + size + halo].astype(np.float64)
                    place = [height, width, y, x, min(size, height - y), min(size, width - x), halo]
                    yield pa.RecordBatch.from_arrays([pa.array([path]), *[pa.array([v], pa.int32()) for v in place], *[pa.array([part[:, :, c].ravel()]) for c in range(3)]], names=["image_id", "height", "width", "y0", "x0", "h", "w", "halo", "r", "g", "b"])

    return files.select("path", "content").mapInArrow(run, "image_id string, height int, width int, y0 int, x0 int, h int, w int, halo int, r array<double>, g array<double>, b array<double>")


def pixel_pairs(files: DataFrame) -> DataFrame:
    """(path, ifd_idx, y, x, r, g, b, r16, g16, b16): the first marked 8-bit thumbnail beside the first 16-bit image of its size.

    That image is neither marked nor the largest of its file; files without such a pair have no rows.
    """
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, data, found in _files(batches):
            most = max((d["width"] * d["height"] for d in found), default=0)
            small = next((d for d in found if d["kind"] == 1 and d["bits"] == 8), None)
            wide = small and next((d for d in found if d["bits"] == 16 and d["kind"] == 0 and d["width"] * d["height"] < most and (d["width"], d["height"]) == (small["width"], small["height"])), None)
            a, b = (_image(data, small), _image(data, wide)) if wide else (None, None)
            if a is not None and b is not None:
                yield from _pixel_batches(path, small["ifd"], np.concatenate([a.astype(np.int32), b.astype(np.int32)], axis=2), ["r", "g", "b", "r16", "g16", "b16"])

    return files.select("path", "content").mapInArrow(run, PIXELS + ", r16 int, g16 int, b16 int")


def build(directories: list[list[tuple[int, int, list]]], strips: list[bytes], order: str = "<", magic: int = 0x2A) -> bytes:
    """A file with the given directories [(tag, type, values)], one after another, each before its strip of samples.

    Strip places and lengths (0x0111, 0x0117) are added for directories whose strip isn't empty.
    """
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", magic, 8))
    for k, (entries, strip) in enumerate(zip(directories, strips, strict=True)):
        entries = list(entries)
        if strip:
            entries += [(0x0111, 4, [0]), (0x0117, 4, [len(strip)])]
        entries.sort(key=lambda e: e[0])
        at = len(out)
        beyond = at + 2 + 12 * len(entries) + 4
        head, tail, strip_at = bytearray(struct.pack(order + "H", len(entries))), bytearray(), 0
        for tag, kind, values in entries:
            letter = TYPES[kind][0]
            raw = bytes(values[0]) if kind in (2, 7) else struct.pack(order + letter * len(values), *(x for v in values for x in (v if isinstance(v, tuple) else (v,))))
            head += struct.pack(order + "HHI", tag, kind, len(raw) if kind in (2, 7) else len(values))
            if tag == 0x0111 and strip:
                strip_at = at + len(head)
            if len(raw) <= 4:
                head += raw.ljust(4, b"\0")
            else:
                head += struct.pack(order + "I", beyond + len(tail))
                tail += raw + b"\0" * (len(raw) % 2)
        place = beyond + len(tail)
        after = place + len(strip) + len(strip) % 2
        out += head + struct.pack(order + "I", after if k + 1 < len(directories) else 0) + tail + strip + b"\0" * (len(strip) % 2)
        if strip:
            struct.pack_into(order + "I", out, strip_at, place)
    return bytes(out)


def export(images: DataFrame) -> DataFrame:
    """(path, content): each image (path, width, height, samples) as a file with 16-bit samples.

    samples: red, green, blue of each pixel, by rows; an image is one row, so its size bounds a row's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            made = []
            for width, height, samples in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                tags_ = [(0x0100, 4, [width]), (0x0101, 4, [height]), (0x0102, 3, [16, 16, 16]), (0x0103, 3, [1]), (0x0106, 3, [2]), (0x0115, 3, [3]), (0x0116, 4, [height])]
                made.append(build([tags_], [np.array(samples, "<u2").tobytes()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return images.select("path", "width", "height", "samples").mapInArrow(run, "path string, content binary")


def settings_text(found: DataFrame) -> DataFrame:
    """(path, xml): the text in tag 0xC519 of the first directory, which begins with its length in four bytes."""
    raw = F.col("value.bytes")
    n = F.conv(F.hex(F.substring(raw, 1, 4)), 16, 10).cast("bigint")
    n = F.least(n, F.length(raw) - 4)
    t = found.filter((F.col("tag") == 0xC519) & (F.col("ifd_idx") == 0) & F.col("type").isin(1, 7) & (F.length(raw) > 4))
    return t.select("path", F.when(n > 0, F.try_to_binary(F.hex(raw.substr(F.lit(5), n.cast("int"))), F.lit("hex"))).cast("string").alias("xml")).filter("xml IS NOT NULL")


def find_settings(data: bytes) -> str | None:
    """The first XML property list in a file's bytes, from its declaration to its end; None without one or if it isn't UTF-8."""
    start = data.find(b"<?xml")
    end = data.find(b"</plist>", start) if start >= 0 else -1
    if end < 0:
        return None
    try:
        return data[start : end + 8].decode("utf-8")
    except UnicodeDecodeError:
        return None


def history(files: DataFrame) -> DataFrame:
    """(path, xml, scanned): the settings that tag 0xC519 holds; only files without that tag are searched through for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, path in enumerate(batch.column(0).to_pylist()):
                content = batch.column(1)[i]
                data = content.as_buffer().to_pybytes() if content.is_valid else b""
                xml = None
                try:
                    found = parse(data)[2]
                    entry = found[0][1].get(0xC519) if found else None
                    raw = entry[2]["bytes"] if entry and entry[0] in (1, 7) else b""
                    n = int.from_bytes(raw[:4], "big")
                    xml = raw[4 : 4 + n].decode("utf-8") if n and len(raw) > 4 else None
                except (TagError, UnicodeDecodeError):
                    pass
                text = xml if xml is not None else find_settings(data)
                if text is not None:
                    rows.append((path, text, xml is None))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_())], names=["path", "xml", "scanned"])

    return files.select("path", "content").mapInArrow(run, "path string, xml string, scanned boolean")


def embedded_profile(found: DataFrame) -> DataFrame:
    """(path, profile): tag 0x8773, else 0xC51A, if it is a colour profile by its mark at byte 36."""
    b = F.col("value.bytes")
    fits = (F.length(b) > 40) & (F.substring(b, 37, 4) == F.lit(b"acsp"))
    t = found.filter(F.col("tag").isin(0x8773, 0xC51A) & fits).withColumn("_k", F.struct((F.col("tag") != 0x8773).alias("later"), "ifd_idx"))
    return t.groupBy("path").agg(F.min_by(b, "_k").alias("profile"))


def jpeg_spans(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of each embedded JPEG: a start mark before an APP0, APP1 or DQT mark, up to the first end mark."""
    found, at = [], data.find(b"\xff\xd8\xff")
    while at >= 0:
        if data[at + 3 : at + 4] in (b"\xe0", b"\xe1", b"\xdb"):
            end = data.find(b"\xff\xd9", at + 2)
            if end >= 0:
                found.append((at, end + 2))
                at = data.find(b"\xff\xd8\xff", end + 2)
                continue
        at = data.find(b"\xff\xd8\xff", at + 1)
    return found


def largest_jpeg(data: bytes) -> bytes | None:
    """The largest embedded JPEG; of equals the first."""
    best = max(jpeg_spans(data), key=lambda s: s[1] - s[0], default=None)
    return None if best is None else data[best[0] : best[1]]


def summary(found: DataFrame) -> DataFrame:
    """(path, ord, key, value): what is worth knowing of a file, in a fixed order; keys without a value are left out."""
    one = first_values(found)
    f = lambda tag, what: F.first(F.when(F.col("tag") == tag, what), True)
    text = lambda tag: f(tag, as_text())
    number = lambda tag: f(tag, as_number())
    double = lambda tag: f(tag, as_double())
    unit = F.when(number(0x0128) == 1, "").when(number(0x0128) == 3, " dpcm").when(F.coalesce(number(0x0128), F.lit(2)) == 2, " dpi").otherwise("")
    rat = f(0x829A, F.get(F.col("value.rats"), F.lit(0)))
    exposure = F.when(rat["d"] != 0, F.when(rat["n"] == 1, F.concat(F.lit("1/"), rat["d"].cast("string"))).otherwise(F.format_string("%.4fs", rat["n"] / F.nullif(rat["d"], F.lit(0)))))
    coded = lambda tag, names: F.when(number(tag).isNotNull(), name_of(number(tag), names))
    from argentum.functions.text import file_size

    facts = one.groupBy("path").agg(
        F.when(F.first("magic") == 0x55, "magic 0x55").otherwise("magic 0x2A").alias("Format"),
        F.when(F.first("byte_order") == "LE", "Little-Endian (Intel)").otherwise("Big-Endian (Motorola)").alias("Byte Order"),
        file_size(F.first("size")).alias("File Size"),
        text(0x010F).alias("Make"), text(0x0110).alias("Model"), text(0x0131).alias("Software"), text(0x0132).alias("DateTime"), text(0x9003).alias("DateTimeOriginal"),
        f(0x0102, shown()).alias("BitsPerSample"), coded(0x0103, COMPRESSION).alias("Compression"), coded(0x0106, PHOTOMETRIC).alias("Photometric"), coded(0x0112, ORIENTATION).alias("Orientation"),
        F.when(double(0x011A).isNotNull(), F.concat(F.format_string("%.0f", double(0x011A)), unit)).alias("XResolution"),
        F.when(double(0x011B).isNotNull(), F.concat(F.format_string("%.0f", double(0x011B)), unit)).alias("YResolution"),
        exposure.alias("ExposureTime"), F.when(double(0x829D).isNotNull(), F.format_string("f/%.1f", double(0x829D))).alias("FNumber"), number(0x8827).cast("string").alias("ISO"),
        F.when(double(0x920A).isNotNull(), F.format_string("%.1f mm", double(0x920A))).alias("FocalLength"), coded(0x9207, METERING).alias("MeteringMode"), text(0xA431).alias("BodySerialNumber"), text(0xC62F).alias("CameraSerialNumber"),
    )
    counts = found.filter("error IS NULL").groupBy("path").agg((F.max("ifd_idx") + 1).cast("string").alias("IFD Count"))
    size = dimensions(found).select("path", F.format_string("%d × %d", "width", "height").alias("Dimensions"))
    note = found.filter("ifd_name = 'MakerNote'").groupBy("path").agg(F.first(F.when(F.col("tag") == 5, name_of(as_number(), WHITE_BALANCE)), True).alias("WhiteBalance"))
    facts = facts.join(counts, "path").join(size, "path", "left").join(note, "path", "left")
    order = ["Format", "Byte Order", "File Size", "IFD Count", "Make", "Model", "Software", "DateTime", "DateTimeOriginal", "Dimensions", "BitsPerSample", "Compression", "Photometric", "Orientation", "XResolution", "YResolution", "ExposureTime", "FNumber", "ISO", "FocalLength", "MeteringMode", "BodySerialNumber", "CameraSerialNumber", "WhiteBalance"]
    pairs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), F.col(f"`{k}`").alias("value")) for i, k in enumerate(order)])
    return facts.select("path", F.inline(pairs)).filter("value IS NOT NULL")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
