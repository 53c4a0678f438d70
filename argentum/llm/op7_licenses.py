"""License scans: normalised text compared with licence templates by the Dice coefficient over word bigrams.

A whole text is normalised (lower case, one space for whatever isn't a letter or digit, line ends too) and taken as
its word bigrams in order. Dice of two sets is 2 |A and B| / (|A| + |B|): to reach a limit t, a window must hold more
than t / (2 - t) of the template's bigrams, and its size may differ by that factor at most. So a template has a few
anchors, the longest third of its bigrams and one more: where none of them stands, the template can't be. At each
anchor the template is laid over the text so that the two meet, and the window below it, of the template's length, is
compared if its size allows it. Of fits that overlap that with the most bigrams in common counts (a whole licence
rather than a notice in it), then that with the higher Dice; first among the fits of one template, then of all.

So a notice is found inside a line, over several lines, and beside others. No row meets another: nothing is shuffled.

Cases: a null text has no licence; texts of any length are looked at whole; a text of one word has no bigram and fits
nothing; of fits that are as good the first by name counts, then the first in the text; repeated rows
come back as often as they came, null ids too; only the two named columns are read; an empty table gives an empty
result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.llm import common
from argentum.llm.licence_texts import RESTRICTED, TEMPLATES

LIMIT = 0.8


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def template_bigrams(text: str) -> list[tuple[str, str]]:
    w = re.findall(r"[^\W_]+", text.lower())
    return list(zip(w, w[1:]))


def anchors(bigrams: list[tuple[str, str]], limit: float = LIMIT) -> list[tuple[str, str]]:
    """Bigrams of which a window must hold one to reach the limit: so many that the others are too few. Long words are rare."""
    different = sorted(set(bigrams), key=lambda b: (-len(b[0]) - len(b[1]), b))
    return different[: int(len(different) * (2 - 2 * limit) / (2 - limit) + 1e-9) + 1]


def _hashes(spark: SparkSession, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """The bigrams' numbers, by the same expression as the texts'."""
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h"))
    return {(r.a, r.b): r.h for r in rows.collect()}


def scan(df: DataFrame, key: str, text: str, templates: list[tuple[str, str]] = TEMPLATES, limit: float = LIMIT) -> DataFrame:
    """key, n_hits (places that fit a template), license (the best fit's), dice, licenses (all found), restricted."""
    known = sorted((n, b) for n, t in templates if (b := template_bigrams(t)))
    number = _hashes(df.sparkSession, sorted({p for _, b in known for p in b}))
    longs = lambda xs: F.array(*map(F.lit, xs))
    table = F.array(*[F.struct(F.lit(n).alias("name"), longs(sorted({number[p] for p in b})).alias("set"), F.lit(len(set(b))).alias("size"), F.lit(len(b)).alias("places")) for n, b in known])
    places = [(number[p], t, j) for t, (_, b) in enumerate(known) for p in anchors(b, limit) for j, q in enumerate(b) if q == p]
    entries = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(t).alias("t"), F.lit(j).alias("j")) for h, t, j in places])
    rows = df.select(F.col(key).alias("_key"), words(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_w"))
    rows = rows.withColumn("_b", F.transform("_w", lambda x, i: F.xxhash64(x, F.get(F.col("_w"), i + 1))))
    rows = rows.select("_key", F.slice("_b", F.lit(1), F.size("_b") - 1).alias("_b"))
    at = F.array_compact(F.transform("_b", lambda h, i: F.when(h.isin(sorted({h for h, _, _ in places})), F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("_at", at)
    laid = F.transform("_at", lambda a: F.transform(F.filter(entries, lambda e: e["h"] == a["h"]), lambda e: F.struct(e["t"].alias("t"), (a["i"] - e["j"]).alias("s"))))
    rows = rows.withColumn("_laid", F.array_distinct(F.flatten(laid)))
    ratio = limit / (2 - limit)

    def fit(c: Column) -> Column:
        of = F.element_at(table, c["t"] + 1)
        window = F.array_distinct(F.slice(F.col("_b"), F.greatest(c["s"], F.lit(0)) + 1, F.least(c["s"], F.lit(0)) + of["places"]))
        allowed = (of["size"] >= F.size(window) * ratio) & (of["size"] * ratio <= F.size(window))
        met = F.when(allowed, F.size(F.array_intersect(of["set"], window))).otherwise(0)
        dice = 2.0 * met / (of["size"] + F.size(window))
        # in this order a better fit is a smaller struct
        return F.struct((-met).alias("less"), (-dice).alias("worse"), of["name"].alias("name"), c["s"].alias("s"), (c["s"] + of["places"]).alias("e"), c["t"].alias("t"))

    rows = rows.withColumn("_fits", F.filter(F.transform("_laid", fit), lambda x: x["worse"] <= -limit)).select("_key", "_fits")
    beats = lambda o, x: (o["s"] < x["e"]) & (x["s"] < o["e"]) & (o < x)
    rows = rows.withColumn("_fits", F.filter("_fits", lambda x: ~F.exists(F.col("_fits"), lambda o: (o["t"] == x["t"]) & beats(o, x))))
    rows = rows.withColumn("_hits", F.array_sort(F.filter("_fits", lambda x: ~F.exists(F.col("_fits"), lambda o: beats(o, x)))))
    names = F.array_sort(F.array_distinct(F.transform("_hits", lambda x: x["name"])))
    top = F.get(F.col("_hits"), F.lit(0))
    return rows.select(F.col("_key").alias(key), F.size("_hits").cast("bigint").alias("n_hits"), top["name"].alias("license"), F.coalesce(-top["worse"], F.lit(0.0)).alias("dice"), F.array_join(names, ",").alias("licenses"), F.arrays_overlap(names, F.array(*map(F.lit, RESTRICTED))).alias("restricted"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def oracle(templates: list[tuple[str, str]] = TEMPLATES, limit: float = LIMIT) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = sorted((n, b) for n, t in templates if (b := template_bigrams(t)))
    listed = lambda b: "[" + ", ".join(quoted(" ".join(p)) for p in b) + "]"
    rows = ", ".join(f"({t}, {quoted(n)}, {listed(sorted(set(b)))}, {len(b)})" for t, (n, b) in enumerate(known))
    places = ", ".join(f"({quoted(' '.join(p))}, {t}, {j})" for t, (_, b) in enumerate(known) for p in anchors(b, limit) for j, q in enumerate(b) if q == p)
    ratio = f"({limit} / (2 - {limit}))::DOUBLE"
    return rf"""
WITH tpl(t, name, bag, places) AS (VALUES {rows}),
anchor(g, t, j) AS (VALUES {places}),
w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
b AS (SELECT doc_id, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS b FROM w),
spot AS (SELECT doc_id, unnest(b) AS g, unnest(range(len(b))) AS i FROM b),
laid AS (SELECT DISTINCT doc_id, t, i - j AS s FROM spot JOIN anchor USING (g)),
win AS (SELECT doc_id, tpl.*, s, list_distinct(b[greatest(s, 0) + 1:s + places]) AS win FROM laid JOIN tpl USING (t) JOIN b USING (doc_id)),
fit AS (SELECT doc_id, t, name, s, s + places AS e, len(list_intersect(bag, win)) AS met, 2.0::DOUBLE * met / (len(bag) + len(win)) AS dice FROM win WHERE len(bag) >= len(win) * {ratio} AND len(bag) * {ratio} <= len(win)),
good AS (SELECT * FROM fit WHERE dice >= {limit}::DOUBLE),
lone AS (SELECT * FROM good x WHERE NOT EXISTS (SELECT 1 FROM good o WHERE o.doc_id = x.doc_id AND o.t = x.t AND o.s < x.e AND x.s < o.e AND struct_pack(a := -o.met, b := -o.dice, c := o.name, d := o.s, e := o.e, f := o.t) < struct_pack(a := -x.met, b := -x.dice, c := x.name, d := x.s, e := x.e, f := x.t))),
hit AS (SELECT * FROM lone x WHERE NOT EXISTS (SELECT 1 FROM lone o WHERE o.doc_id = x.doc_id AND o.s < x.e AND x.s < o.e AND struct_pack(a := -o.met, b := -o.dice, c := o.name, d := o.s, e := o.e, f := o.t) < struct_pack(a := -x.met, b := -x.dice, c := x.name, d := x.s, e := x.e, f := x.t))),
per AS (SELECT doc_id, count(*) AS n_hits, arg_min(name, struct_pack(a := -met, b := -dice, c := name, d := s)) AS license, arg_min(dice, struct_pack(a := -met, b := -dice, c := name, d := s)) AS dice, list_sort(list_distinct(list(name))) AS names FROM hit GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_hits, 0)::BIGINT AS n_hits, license, coalesce(dice, 0.0::DOUBLE) AS dice, coalesce(array_to_string(names, ','), '') AS licenses,
       coalesce(list_has_any(names, [{", ".join(map(quoted, RESTRICTED))}]), false) AS restricted
FROM documents d LEFT JOIN per USING (doc_id)
"""
