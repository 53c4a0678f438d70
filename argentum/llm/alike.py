"""Near copies by the Jaccard coefficient of word shingles: all pairs from a limit on, by prefix filtering.

Two sets of which the larger has n shingles can only reach 4/5 if they share one of the first n - ceil(4n/5) + 1
in any order that holds for all sets. So each text goes into the lists of so many shingles, by order of their hashes;
shingles with long lists come last in that order. Pairs of a list whose sizes allow it are verified exactly. The first
round compares a list's smallest member with the others; once the links found join most of a family, the second round
compares all pairs that aren't joined yet, so that no pair is lost.

Cases: a text of fewer words than a shingle is one shingle; texts without words have none, and no list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.llm import common

#: Words of a shingle; the least coefficient is FIFTHS / 5.
SHINGLE, FIFTHS = 5, 4
#: Members of a list beyond which its shingle comes last, and how many such shingles are broadcast.
LONG_LIST, LONG_LISTS = 64, 2000


def shingles(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of the different shingles of lower-case words, sorted."""
    words = common.words(F.lower(text))
    at = lambda w, i, k: F.get(w, i + k)
    hashed = F.transform(words, lambda x: F.xxhash64(x))
    joined = F.transform(F.array(hashed), lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *[at(h, i, k) for k in range(1, shingle)])))
    first = F.transform(joined, lambda s: F.slice(s, F.lit(1), F.when(F.size(s) == 0, 0).otherwise(F.greatest(F.size(s) - (shingle - 1), F.lit(1)))))
    return F.sort_array(F.array_distinct(F.get(first, F.lit(0))))


def index(docs: DataFrame, long: list[int]) -> DataFrame:
    """(s, doc, n): each document in the lists of its first shingles; n is the number of all its shingles."""
    sets = docs.select("doc", shingles(F.col("_t")).alias("_set"))
    n = F.size("_set")
    first = n - F.floor((FIFTHS * n + 4) / 5).cast("int") + 1
    order = F.col("_set")
    if long:
        some = docs.sparkSession.createDataFrame([(long,)], "_long array<bigint>")
        sets = sets.join(F.broadcast(some))
        last = F.concat(F.array_except("_set", "_long"), F.sort_array(F.array_intersect("_set", "_long")))
        order = F.when(F.arrays_overlap(F.slice("_set", F.lit(1), first), F.col("_long")), last).otherwise(F.col("_set"))
    return sets.filter(n > 0).select(F.explode(F.slice(order, F.lit(1), first)).alias("s"), "doc", n.alias("n")).dropDuplicates(["s", "doc"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose coefficient reaches the limit."""
    pairs = common.cut(pairs)
    wanted = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    sets = common.cut(docs.join(wanted, "doc", "left_semi").dropDuplicates(["doc"]).select("doc", shingles(F.col("_t")).alias("set")))
    both = pairs.join(sets.toDF("a", "_a"), "a").join(sets.toDF("b", "_b"), "b")
    met = F.size(F.array_intersect("_a", "_b"))
    return common.cut(both.filter(5 * met >= FIFTHS * (F.size("_a") + F.size("_b") - met)).select("a", "b"))


def links(docs: DataFrame, known: DataFrame, components) -> DataFrame:
    """(a, b), a < b: links of (doc, _t) that join, together with the known ones, what all links join."""
    rows = common.cut(index(docs, []))
    sizes = rows.groupBy("s").agg(F.count("*").alias("_m"))
    long = [r[0] for r in sizes.filter(F.col("_m") > LONG_LIST).orderBy(F.desc("_m"), "s").limit(LONG_LISTS).collect()]
    if long:
        rows = common.cut(index(docs, long))
    shared = rows.groupBy("s").agg(F.count("*").alias("_m")).filter("_m > 1").select("s")
    rows = common.cut(rows.join(shared, "s"))
    found = known
    for star in (True, False):
        roots = components(found).select(F.col("node").alias("doc"), "root").distinct()
        now = rows.join(roots, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
        if star:
            x = now.groupBy("s").agg(F.min(F.struct("doc", "n", "root")).alias("x")).select("s", "x.*")
        else:
            # Lists that are joined already have nothing to compare.
            split = now.groupBy("s").agg(F.min("root").alias("_l"), F.max("root").alias("_h")).filter("_l <> _h").select("s")
            now = common.cut(now.join(split, "s"))
            x = now
        pairs = x.toDF("s", "a", "an", "ar") if star else x.select("s", F.col("doc").alias("a"), F.col("n").alias("an"), F.col("root").alias("ar"))
        pairs = now.join(pairs, "s").filter("a < doc AND ar <> root").filter(5 * F.least("n", "an") >= FIFTHS * F.greatest("n", "an"))
        found = common.cut(found.unionByName(verified(pairs.select("a", F.col("doc").alias("b")).distinct(), docs)))
    return found
