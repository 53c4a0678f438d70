"""Case manifests (TOML), baselines (one JSON object a line) and tab-separated summaries."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "name string, raw string, ref string, source string, preset string"
BASELINE = "case string, tests array<struct<id: string, name: string, mae_16: double, mean_signed: double, p50_16: bigint, p95_16: bigint, p99_16: bigint, p999_16: bigint, max_16: bigint, mae_shadow: double, mae_mid: double, mae_high: double, grade: string>>"
SOURCES = ("embedded_current", "embedded_index", "embedded_name", "external_xml")


def resolved(base: str, path: str) -> str:
    return path if path.startswith("/") else f"{base.rstrip('/')}/{path}"


def cases(spark: SparkSession, text: str, folder: str, raw_key: str) -> DataFrame:
    """The manifest's cases with full paths. Every case needs name, raw_key and ref, and a preset unless it takes the current one."""
    manifest = tomllib.loads(text)
    if "data_dir" not in manifest:
        raise ValueError("the manifest has no data_dir")
    data = resolved(folder, manifest["data_dir"])
    presets = resolved(folder, manifest.get("preset_dir", folder))
    rows = []
    for c in manifest.get("case", []):
        source = c.get("source", SOURCES[0])
        if missing := [k for k in ("name", raw_key, "ref") if k not in c]:
            raise ValueError(f"a case has no {missing[0]}")
        if source not in SOURCES or (source != SOURCES[0] and "preset" not in c):
            raise ValueError(f"case {c['name']}: no such source, or no preset for it")
        preset = c.get("preset")
        rows.append((c["name"], resolved(data, c[raw_key]), resolved(data, c["ref"]), source, resolved(presets, preset) if source == SOURCES[3] else None if preset is None else str(preset)))
    return spark.createDataFrame(rows, CASES)


def write_baseline(stats: DataFrame, path: str) -> None:
    """stats has case, id, name and error metrics; one JSON object for each case."""
    fields = [x.split(":")[0].strip() for x in BASELINE.split("struct<")[1].rstrip(">").split(", ")]
    stats.groupBy("case").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("tests")).write.json(path)  # a case has a handful of tests


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(case, id, mae_16); lines that can't be read are left out."""
    return spark.read.schema(BASELINE).option("mode", "PERMISSIVE").json(path).select("case", F.inline("tests")).select("case", "id", "mae_16").filter("id IS NOT NULL")


def write_summary(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)
