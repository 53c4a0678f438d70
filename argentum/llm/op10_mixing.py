"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws u from a hash of its key and gets -ln(u) / weight; by rising values this is a
weighted sample without replacement. The values are sorted within each source and the sizes summed in
that order: a source that may be used e whole times takes every document e times, and what is left of
its target goes to the documents that come first.

A document's quality weight is that of its label, where it has one, else it falls with the number of symbols
that prose doesn't use.

The running sums are made in two levels: a source's values are dealt into ranges, whose sums are added
up first; so one source that holds most rows is spread over as many tasks as it needs. The ranges are equal
in the logarithm of the value: there an exponential value's density is at most 1/e, whatever its weight, and
so is that of any mixture of weights; no range can hold more rows than it should.

Cases: a null text has size 0, and texts of any length are counted whole; null is a source of its own, the last;
rows without a key are drawn by their text and have no label; of several labels of a key the lowest counts; a source of size 0 has target 0;
rows that are equal in key are drawn by size, repeated rows one after the other; the caller's columns keep names of any
kind; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from argentum.llm import common

#: Weights of the sources in their order, the share of all sizes to be dealt out, and the most a source gives.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Rows of a range at least; sources up to which their table is broadcast.
RANGE_ROWS, BROADCAST_SOURCES = 2000, 50_000
SYMBOLS = r"[#*$%&|<>]"
#: Weights of documents that are labelled bad and good.
BAD, GOOD = 0.1, 1.0


def uniform(key: Column, seed: str = "mix") -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of a hash of the key."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("-")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS))


def quality(size: Column, n_symbols: Column, label: Column) -> Column:
    """A document's weight, 0.1 to 1: by its label (0 is bad), without one by the number of symbols that prose doesn't use."""
    guess = BAD + (GOOD - BAD) * (size + 1.0) / (size + 1.0 + 4.0 * n_symbols)
    return F.when(label == 0, BAD).when(label.isNotNull(), GOOD).otherwise(guess)


def identity(key: Column, text: Column) -> Column:
    """What a row is drawn by: its key or, without one, its text, so that rows without a key don't all draw alike."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("-"), F.xxhash64(text).cast("string")))


def labelled(slim: DataFrame, key: str, labels: DataFrame | None) -> DataFrame:
    """The rows with their quality label beside them (_label), null where there is none. labels: (doc_id, quality)."""
    if labels is None:
        return slim.withColumn("_label", F.lit(None).cast("int"))
    least = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("_of")).agg(F.min(F.col("quality").cast("int")).alias("_label"))
    known = F.col(key).isNotNull()
    found = slim.filter(known).join(least, F.col(key).cast("bigint") == F.col("_of"), "left").drop("_of")
    return found.unionByName(slim.filter(~known).withColumn("_label", F.lit(None).cast("int")))


def targets(sources: DataFrame) -> DataFrame:
    """(source, n, source_size) with the target of each source.

    Sources by code point, null last, weigh 3, 1, 2, repeating. A source is full when the common level
    reaches MOST times its size over its weight; the level is where the full ones and the others' shares
    add up. Sorted by that ratio, it is found by running sums.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    s = s.withColumn("full", MOST * F.col("source_size"))
    rising = W.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({"_given": F.coalesce(F.sum("full").over(before), F.lit(0.0)), "_w_left": F.sum("w").over(rising.rowsBetween(0, W.unboundedFollowing)), "_all": SHARE * F.sum("source_size").over(whole)})
    s = s.withColumn("_level", (F.col("_all") - F.col("_given")) / F.col("_w_left"))
    s = s.withColumn("_level", F.max(F.when(F.col("_level") * F.col("w") <= F.col("full"), F.col("_level"))).over(whole))
    target = F.least(F.col("full"), F.coalesce(F.col("_level") * F.col("w"), F.col("full")))
    return s.select("source", "n", "source_size", target.cast("double").alias("target"))


def mix(df: DataFrame, key: str, source: str, size: Column, weight: Column, carry: dict[str, Column] | None = None, drawn_by: Column | None = None) -> DataFrame:
    """key, source, size, source_size, target, copies, taken (and the carried columns) of each row.

    drawn_by: what the random number comes from, if not the key alone.
    copies: how often the whole document is taken. Past the complete epochs a document is taken while at
    least half of it lies within what is left of the target, so a source misses its target by half of one
    document at most.
    """
    slim = df.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("source"), size.cast("bigint").alias("size"), (-F.log(uniform(F.col(key) if drawn_by is None else drawn_by)) / weight).alias("_draw"), *[c.alias(k) for k, c in (carry or {}).items()])
    slim = common.cut(slim)
    sources = common.cut(targets(slim.groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))))
    small = sources.count() <= BROADCAST_SOURCES
    # the width of a range in the logarithm of the draw: 1/e of it is the most that a range can hold of a source
    width = math.e * F.greatest(F.lit(float(RANGE_ROWS)), F.sqrt("n")) / F.col("n")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = sources.select(F.col("source").alias("_s"), "source_size", "target", width.alias("_width"), whole.cast("bigint").alias("_epochs"))
    rows = slim.join(F.broadcast(sources) if small else sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # a source of up to RANGE_ROWS rows is one range
    rows = rows.withColumn("_range", F.when(F.col("_width") >= math.e, 0).otherwise(F.floor(F.log("_draw") / F.col("_width"))).cast("bigint"))
    sums = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    earlier = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).drop("_s", "_r")
    inside = W.partitionBy("source", "_range").orderBy("_draw", "_key", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    more = (F.col("size") > 0) & (F.col("_before") + F.col("size") / 2.0 <= rest)
    rows = rows.withColumn("copies", F.col("_epochs") + more.cast("bigint"))
    return rows.select(F.col("_key").alias(key), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(carry or {}))


def mixed(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """mix() of a table like documents, by words and by quality()."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").alias("source"), F.col("text").cast("string").alias("text"))
    slim = slim.select("doc_id", "source", F.size(common.words(F.col("text"))).cast("bigint").alias("size"), symbols(F.col("text")).alias("_symbols"), identity(F.col("doc_id"), F.col("text")).alias("_by"))
    return mix(labelled(slim, "doc_id", labels), "doc_id", "source", F.col("size"), quality(F.col("size"), F.col("_symbols"), F.col("_label")), drawn_by=F.col("_by"))


def repeat(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows, all their columns as they were, each as often as the mix takes it. Equal rows are taken alike."""
    # The caller's columns travel in a struct, where no name can clash.
    names = docs.columns
    marked = docs.select(F.struct(F.col("doc_id").alias("k"), F.xxhash64(*names).alias("h")).alias("_row"), F.struct(*names).alias("_all"))
    text = F.col("_all")["text"].cast("string")
    slim = marked.select("_row", F.col("_row.k").alias("key"), F.col("_all")["source"].alias("source"), F.size(common.words(text)).cast("bigint").alias("size"), symbols(text).alias("_symbols"), identity(F.col("_row.k"), text).alias("_by"))
    drawn = mix(labelled(slim, "key", labels), "key", "source", F.col("size"), quality(F.col("size"), F.col("_symbols"), F.col("_label")), {"_row": F.col("_row")}, F.col("_by"))
    copies = common.cut(drawn.filter("copies > 0").groupBy("_row").agg(F.max("copies").alias("_copies")))
    taken = marked.join(copies.withColumnRenamed("_row", "_r"), F.col("_row").eqNullSafe(F.col("_r")))
    return taken.select("_all", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies"))).select("_all.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
WITH w AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS symbols FROM documents),
d AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5('mix' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
             / CASE WHEN label = 0 THEN 0.1 WHEN label IS NOT NULL THEN 1.0 ELSE 0.1 + 0.9 * (size + 1.0) / (size + 1.0 + 4.0 * symbols) END AS draw
      FROM w LEFT JOIN (SELECT doc_id, min(quality) AS label FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0 * sum(size)::DOUBLE AS full_,
             [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM s) - coalesce(sum(full_) OVER (ORDER BY full_ / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
             / sum(w) OVER (ORDER BY full_ / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, least(full_, (SELECT max(level) FROM r WHERE level * w <= full_) * w) AS target FROM r),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (epochs + CASE WHEN size > 0 AND before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END)::BIGINT AS copies FROM e)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM c
"""
