"""Joins and overlays: where two relations meet. Pixels of two images meet as tiles (see tiles.pair)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def file_pairs(files: DataFrame, one: str, two: str, shown: str = "path") -> DataFrame:
    """(stem, path_one, path_two): files with extension one that have a neighbour of the same stem with extension two; of each the column shown."""
    named = files.select(F.col(shown).alias("shown"), F.regexp_extract("path", r"^(.*)\.[^./]*$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("ext"))
    left = named.filter(F.col("ext") == one).select("stem", F.col("shown").alias("path_one"))
    return left.join(named.filter(F.col("ext") == two).select("stem", F.col("shown").alias("path_two")), "stem")


def baseline_diff(now: DataFrame, base: DataFrame, key: list[str], value: str) -> DataFrame:
    """Each value with its baseline and a mark: "=" within 0.05, "↓" lower, "↑" higher, none without a baseline."""
    old = base.select(*key, F.col(value).alias("old"))
    d = F.col(value) - F.col("old")
    mark = F.when(F.col("old").isNull(), F.lit("")).when(F.abs(d) < 0.05, F.lit("=")).when(d < 0, F.lit("↓")).otherwise(F.lit("↑"))
    return now.join(old, key, "left").withColumn("mark", mark)


def select_profile(files: DataFrame, profiles: DataFrame, keywords: list[str]) -> DataFrame:
    """(path, profile): by the profile's name, with or without ".icc"; else by a keyword that model and name share; else null.

    Of several the first in the catalogue's order (ord) stands. So a keyword only needs its first profile, and a name
    its first: at most one row for each keyword and name meets the files.
    """
    words = F.array(*map(F.lit, keywords))
    held = lambda c: F.filter(words, lambda k: F.contains(F.lower(c), k))
    names = profiles.select(F.regexp_replace("name", r"\.icc$", "").alias("_stem"), "name", "ord").unionByName(profiles.select(F.col("name").alias("_stem"), "name", "ord"))
    exact = names.groupBy("_stem").agg(F.min_by("name", "ord").alias("_exact"))
    first = profiles.select(F.explode(held(F.col("name"))).alias("k"), "ord", "name").groupBy("k").agg(F.min(F.struct("ord", "name")).alias("p"))
    # one row that holds the first profile of each keyword
    table = first.agg(F.map_from_entries(F.collect_list(F.struct("k", "p"))).alias("_table"))
    near = F.array_sort(F.array_compact(F.transform(held(F.col("model")), lambda k: F.try_element_at(F.col("_table"), k))))
    found = files.select("path", "wanted", "model").join(exact, F.col("wanted") == F.col("_stem"), "left").join(F.broadcast(table), F.lit(True), "left")
    return found.select("path", F.coalesce("_exact", F.get(near, F.lit(0))["name"]).alias("profile"))


def resolve(settings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, setting): the setting that each file asks for: the current one, one by number (held in range), or the first of a name."""
    s = settings.join(wanted, "path")
    last = F.max("setting").over(W.partitionBy("path"))
    fits = F.when(F.col("source") == "current", F.col("is_current")).when(F.col("source") == "index", F.col("setting") == F.least(F.col("n"), last)).otherwise(F.col("name") == F.col("wanted_name"))
    return s.withColumn("_fits", fits).filter("_fits").groupBy("path").agg(F.min("setting").alias("setting"))


def longest_root(dirs: DataFrame, roots: DataFrame) -> DataFrame:
    """(dir, root): the longest root that a folder lies in. A folder is joined with roots by each of its own prefixes."""
    parts = F.split("dir", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    met = dirs.select("dir", F.explode(prefixes).alias("root")).join(roots.select("root").distinct(), "root")
    return dirs.join(met.groupBy("dir").agg(F.max_by("root", F.length("root")).alias("root")), "dir", "left")


def overlay_diff(current: DataFrame, base: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Of each column the current value where it differs from the base, else null."""
    b = base.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return current.join(b, key).select(key, *[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.col(c)).alias(c) for c in columns])


def overlay_apply(base: DataFrame, overlay: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The base with every value that the overlay names."""
    o = overlay.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(o, key, "left").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def looked_up(df: DataFrame, name: str, catalogue: DataFrame) -> DataFrame:
    """The rows with index: the first place (ord) of their name in a catalogue (ord, name), null if it isn't there."""
    first = catalogue.groupBy(F.col("name").alias("_name")).agg(F.min("ord").alias("index"))
    return df.join(first, F.col(name) == F.col("_name"), "left").drop("_name")


#: When a set of parameters leaves an image as it is: each step is switched off or near its neutral value. A film curve
#: that is switched on never does. Columns: apply_<step>, and the values; arrays for levels, output and matrix.
NEUTRAL = {
    "levels": "forall(black, v -> v < 0.5) AND forall(gamma, v -> abs(v - 1) < 0.01) AND forall(white, v -> v > 254.5) AND forall(out_low, v -> v < 0.5) AND forall(out_high, v -> v > 254.5)",
    "film_curve": "false",
    "exposure": "abs(exposure) < 0.001",
    "brightness": "abs(brightness) < 0.1",
    "shadow_depth": "abs(lightness) < 0.1",
    "midtone": "abs(midtone - 1) < 0.01",
    "contrast": "abs(contrast) < 0.1",
    "highlights": "abs(highlights) < 0.1",
    "shadows": "abs(shadows) < 0.1",
    "saturation": "abs(saturation) < 0.1",
    "color_balance": "abs(r_shift) < 0.1 AND abs(g_shift) < 0.1 AND abs(b_shift) < 0.1",
    "color_temp": "abs(temperature) < 0.1 AND abs(tint) < 0.1",
    "color_corr": "forall(matrix, v -> v = 0)",
}


def neutral() -> Column:
    return F.expr(" AND ".join(f"(NOT apply_{step} OR ({test}))" for step, test in NEUTRAL.items()))


def any_set(columns: list[str]) -> Column:
    return F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in columns], F.lit(False))
