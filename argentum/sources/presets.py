"""Parameter files (XML property lists): a lenient parser, its rows, and the typed record made from them.

The parser never fails. It gives what could be read up to the first fault. Entities are decoded with the
ampersand first, so `&amp;lt;` becomes `<`.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The record's keys by kind.
INTS = ["Contrast", "Brightness", "Lightness", "Saturation", "ColorTemperature", "Tint", "FilmCurve", "FilmType", "ColorModel", "USMAmount", "USMRadius", "USMDarkLimit", "USMNoiseLimit", "Threshold", "DustLevel", "ColorNoiseRadius", "NoiseFilterBias", "LensCorrection", "VignetteAmount", "AutoHighlight", "AutoShadow", "Mode"]
DOUBLES = {"Gamma": 2.0, "EV": 1.0}
BOOLEANS = ["ApplySliders", "ApplyCurves", "ApplyHistogram", "ApplyUSM", "ApplyDust", "ApplyCC", "ApplyCNFilter", "EnhancedShadow", "RemoveCastHighlight", "RemoveCastShadow", "EmbedProfile", "Convert", "SoftProof"]
FOURS = ["Shadow", "Gray", "Highlight"]
ARRAYS = ["ColorCorr", "DotColor", "USMColFactor", "GradationSliders"]
PROFILES = ["InputProfile", "RGBProfile"]

# Names of codes.
FILM_CURVES = {0: "Linear", 1: "Film Std", 2: "Film High", 3: "Film Low", 4: "Film Auto"}
FILM_TYPES = {0: "Positive E-6", 1: "Negative C-41", 2: "B&W"}
COLOR_MODELS = {0: "RGB", 1: "CMYK", 2: "Grayscale"}

ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]
POINTS = "array<array<struct<x: bigint, y: bigint, dy: bigint>>>"
SCHEMA = f"path string, setting int, name string, is_current boolean, ord int, key string, kind string, value string, ints array<bigint>, curves {POINTS}"


class Node:
    __slots__ = ("name", "children", "text")

    def __init__(self, name: str):
        self.name, self.children, self.text = name, [], None

    def value(self) -> str:
        """true and false are their own text; an element without text has an empty one."""
        return self.name if self.name in ("true", "false") else self.text or ""

    def pairs(self) -> list[tuple[str, Node]]:
        """Keys and values of a dict: they take turns; a key without a value is left out."""
        return [(k.value(), v) for k, v in zip(self.children[::2], self.children[1::2])]

    def get(self, key: str) -> Node | None:
        return next((v for k, v in self.pairs() if k == key), None)

    def find(self, name: str) -> Node | None:
        """The first element of that name, in the order of the text."""
        for c in self.children:
            if c.name == name:
                return c
            if (found := c.find(name)) is not None:
                return found
        return None


def decode(text: str) -> str:
    for old, new in ENTITIES:
        text = text.replace(old, new)
    return text


def parse(xml: str) -> Node:
    """The elements below a root. A closing tag ends the elements inside it, and the reading if it fits none."""
    xml = xml[max(xml.find("<plist"), 0) :]
    root = Node("")
    path: list[tuple[Node, int]] = [(root, 0)]
    for tag in re.finditer(r"<([^>]*)>", xml):
        inner = tag[1]
        if inner[:1] in ("?", "!"):
            continue
        if inner.startswith("/"):
            fits = [i for i in range(len(path) - 1, 0, -1) if path[i][0].name == inner[1:]]
            if not fits:
                break
            node, start = path[fits[0]]
            if fits[0] == len(path) - 1 and not node.children and "<" not in (own := xml[start : tag.start()]):
                node.text = decode(own.strip()) or None
            del path[fits[0] :]
            continue
        alone = inner.endswith("/")
        node = Node(inner.rstrip("/").strip() if alone else (inner.split() or [""])[0])
        path[-1][0].children.append(node)
        if not alone:
            path.append((node, tag.end()))
    return root


def whole(text: str) -> int | None:
    return int(text) if re.fullmatch(r"[+-]?[0-9]+", text) else None


def ints(node: Node) -> list[int]:
    """The whole numbers among an array's elements."""
    return [n for c in node.children if (n := whole(c.value())) is not None]


def curves(node: Node) -> list[list[dict]]:
    """The points of each channel's curve; x and y are 0, dy is 1 where they are missing."""
    out = []
    for channel in node.children:
        for key, points in channel.pairs() if channel.name == "dict" else []:
            if key == "Points":
                rows = [{k: (whole(v.value()) or 0) for k, v in p.pairs()} for p in points.children if p.name == "dict"]
                out.append([{"x": r.get("X", 0), "y": r.get("Y", 0), "dy": r.get("DY", 1)} for r in rows])
    return out


def settings(xml: str) -> tuple[list[tuple[str, Node]], int]:
    """([(name, correction)], number of the current one) of an edit history or of a single preset."""
    top = parse(xml).find("dict")
    if top is None:
        return [], 0
    listed, single = top.get("ImageSettings"), top.get("ImageSetting")
    found = [d for d in listed.children if d.name == "dict"] if listed is not None else [single] if single is not None else []
    rows = [((n.value() if (n := d.get("Name")) is not None else ""), c) for d in found if (c := d.get("ImageCorrection")) is not None]
    at = whole(i.value()) if (i := top.get("CurrentIx")) is not None else 0
    return rows, min(max(at or 0, 0), max(len(rows) - 1, 0))


def rows_of(path: str, xml: str) -> list[dict]:
    rows = []
    found, current = settings(xml)
    for n, (name, correction) in enumerate(found):
        for i, (key, v) in enumerate(correction.pairs()):
            text = (p.value() if (p := v.get("Name")) is not None else None) if key in PROFILES else None if v.name in ("array", "dict") else v.value()
            rows.append({"path": path, "setting": n, "name": name, "is_current": n == current, "ord": i, "key": key, "kind": v.name, "value": text, "ints": ints(v) if v.name == "array" else None, "curves": curves(v) if key == "Gradations" else None})
    return rows


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    point = pa.struct([("x", pa.int64()), ("y", pa.int64()), ("dy", pa.int64())])
    kinds = pa.schema([("path", pa.string()), ("setting", pa.int32()), ("name", pa.string()), ("is_current", pa.bool_()), ("ord", pa.int32()), ("key", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("ints", pa.list_(pa.int64())), ("curves", pa.list_(pa.list_(point)))])
    for batch in batches:
        rows = [r for path, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if xml for r in rows_of(path, xml)]
        yield pa.RecordBatch.from_pylist(rows, kinds)


def parameters(texts: DataFrame) -> DataFrame:
    """One row for each parameter of each setting of each text (path, xml)."""
    return texts.select("path", "xml").mapInArrow(_run, SCHEMA)


def corrections(params: DataFrame) -> DataFrame:
    """(path, setting, name, is_current, one typed column for each parameter).

    A missing number is its default; one that can't be read is 0. Of a repeated key the last stands.
    """
    last = lambda key, what: F.max_by(F.when(F.col("key") == key, what), F.when(F.col("key") == key, F.col("ord")))
    there = lambda key: F.max(F.when(F.col("key") == key, F.lit(1))).isNotNull()
    columns = [F.coalesce(F.expr("try_cast(value AS bigint)"), F.lit(0)).alias("_int"), F.coalesce(F.expr("try_cast(value AS double)"), F.lit(0.0)).alias("_double")]
    p = params.select("*", *columns)
    agg = [F.coalesce(last(k, F.col("_int")), F.lit(0)).alias(k) for k in INTS]
    agg += [F.when(there(k), last(k, F.col("_double"))).otherwise(F.lit(d)).alias(k) for k, d in DOUBLES.items()]
    agg += [F.coalesce(last(k, (F.col("kind") == "true") | (F.col("value") == "true")), F.lit(False)).alias(k) for k in BOOLEANS]
    four = lambda ints_: F.array(*[F.coalesce(F.get(ints_, F.lit(i)), F.lit(0)) for i in range(4)])
    agg += [four(last(k, F.col("ints"))).alias(k) for k in FOURS]
    agg += [F.coalesce(last(k, F.col("ints")), F.array().cast("array<bigint>")).alias(k) for k in ARRAYS]
    agg += [last(k, F.col("value")).alias(k) for k in PROFILES] + [last("Gradations", F.col("curves")).alias("Gradations")]
    return p.groupBy("path", "setting", "name", "is_current").agg(*agg)


def with_file_defaults(found: DataFrame) -> DataFrame:
    """Corrections from preset files: no film curve means the automatic one, and the file's name tells the colour model."""
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    model = F.when(name.contains("cmyk"), 1).when(name.contains("b&w") | name.contains("bw") | name.contains("gray"), 2).otherwise(0)
    return found.withColumns({"FilmCurve": F.when(F.col("FilmCurve") == 0, 4).otherwise(F.col("FilmCurve")).cast("bigint"), "ColorModel": model.cast("bigint")})


def clean(found: DataFrame) -> DataFrame:
    """Corrections without tone, exposure, matrix, curve or dot adjustments."""
    straight = F.forall("Gradations", lambda c: (F.size(c) == 2) & (c[0]["x"] == 0) & (c[0]["y"] == 0) & (c[1]["x"] == 255) & (c[1]["y"] == 255))
    dot = lambda i: F.get("DotColor", F.lit(i))
    dots = (F.size("DotColor") < 14) | ((F.greatest(*[F.abs(dot(i)) for i in range(3)]) == 0) & (F.least(*[dot(i) for i in (7, 8, 9)]) == 255) & (F.greatest(*[dot(i) for i in (7, 8, 9)]) == 255))
    tone = ~F.col("ApplySliders") | ((F.col("Contrast") == 0) & (F.col("Brightness") == 0) & (F.col("Lightness") == 0) & (F.abs(F.col("EV") - 1) < 0.01))
    return found.filter(tone & (~F.col("ApplyCC") | F.forall("ColorCorr", lambda x: x == 0)) & (~F.col("ApplyCurves") | F.coalesce(straight, F.lit(True))) & dots)


def catalogue(files: DataFrame, root: str) -> DataFrame:
    """(path, category, name) of preset files, by category and name. The category is the folder below root."""
    below = F.element_at(F.split("path", re.escape(root.rstrip("/").split("/")[-1]) + "/"), -1)
    cut = F.regexp_extract(below, r"^(.*)/[^/]*$", 1)
    return files.filter(F.col("path").endswith(".xml")).select("path", cut.alias("category"), F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("name")).orderBy("category", "name")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
