"""Line dedup: a suffix array over sequences of line ids, by distributed prefix doubling.

The suffixes of all documents' line sequences are ranked by their first line, then by their first 2, 4, 8
... lines: the rank at twice the length comes from the pair of ranks at a position and as many lines
further on. A suffix whose prefix is found nowhere else has its final place; it leaves the work, and so
the doubling ends when no repeated prefix is left. Ranks keep the order of what they stand for. The
suffixes of one rank at length L are an interval of the suffix array with a common prefix of L lines.

Later copies of repeated runs go: a line is deleted if an interval of the suffix array with a common
prefix of at least MIN_RUN lines covers it with a suffix that isn't the interval's first in the order of
(doc_id, position). Runs inside one document count as well. With single lines asked for (the pipeline does;
the query follows its SQL), a later copy of one line goes too, if the line has LONG_LINE words at least or is
its document's only one.

Cases: only lines with a word are part of a sequence, so blank lines never make a run and always stay;
a null text has no lines and stays null; texts of any length are split whole; columns of any name are kept, but
those of COUNTS are replaced; equal rows (id and text) are judged alike, as one; rows with
the same id and another text come in the order of a hash of their text; null ids come first. A document
of which every line goes keeps its blank lines, or an empty text. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from argentum.llm import common

#: Lines of a run at least.
MIN_RUN = 2
#: Words of a line that is a run by itself.
LONG_LINE = 20
LONG = rf"\A[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{LONG_LINE - 1}}}[^\x20\x09-\x0D]"
ROW = ["_doc", "_text"]
AT = [*ROW, "pos"]


def _row_key(key: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("_doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text")]


def line_ids(df: DataFrame, key: str, text: str, single: bool = False) -> DataFrame:
    """(_doc, _text, pos, line, a, b): each line with a word; pos counts these, line counts all; a and b are its hashes; if single, long: has it LONG_LINE words?"""
    rows = df.select(*_row_key(key, text), F.posexplode(F.split(F.col(text), "\n")).alias("line", "_l"))
    return rows.filter(F.col("_l").rlike(r"[^\x20\x09-\x0D]")).select(*ROW, "line", F.xxhash64("_l").alias("a"), F.crc32(F.col("_l").cast("binary")).alias("b"), *([F.col("_l").rlike(LONG).alias("long")] if single else []))


def _ranked(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose values of by occur at two places or more, with rank (in the order of by) and first (their first place).

    The ranks are ids handed out along a range-partitioned sort of the distinct values: they keep the
    order, and no task sees more than its range.
    """
    groups = df.groupBy(*by).agg(F.min(F.struct(*AT)).alias("first"), F.count("*").alias("_n"))
    groups = groups.filter("_n > 1").orderBy(*by).withColumn("rank", F.monotonically_increasing_id())
    # A very common line is one key; its rows meet a broadcast.
    return common.meet(df, common.cut(groups), by, "_n")


def doubling(lines: DataFrame, least_levels: int = 0) -> list[DataFrame]:
    """The levels 1, 2, 4 ... : (_doc, _text, pos, rank, first) of the suffixes whose prefix of that length is repeated."""
    place = W.partitionBy(*ROW).orderBy("line")
    # Equal rows give each line more than once; they are one.
    seq = lines.dropDuplicates([*ROW, "line"]).withColumn("pos", F.row_number().over(place) - 1)
    alone = ["alone"] if "long" in seq.columns else []
    if alone:
        seq = seq.withColumn("alone", F.col("long") | ((F.col("pos") == 0) & F.lead("line").over(place).isNull())).drop("long")
    now = common.cut(_ranked(common.cut(seq), ["a", "b"]).select(*AT, "line", "rank", "first", *alone))
    levels, length = [], 1
    while now.limit(1).count():
        levels.append(now)
        ahead = W.partitionBy(*ROW).orderBy("pos").rangeBetween(length, length)
        pairs = now.select(*AT, "line", F.col("rank").alias("r1"), F.max("rank").over(ahead).alias("r2")).filter("r2 IS NOT NULL")
        now = common.cut(_ranked(common.cut(pairs), ["r1", "r2"]).select(*AT, "line", "rank", "first"))
        length *= 2
    return levels


def repeated_runs(levels: list[DataFrame], min_run: int = MIN_RUN) -> DataFrame | None:
    """(_doc, _text, pos, lines, first): the maximal runs that are later copies, with the first place of each; None if there are none.

    The suffixes whose prefix of min_run lines is repeated are intervals of the level min_run, a power of
    two; each has the interval's first place. Where positions follow each other and their first places do
    too, the prefixes are one longer run.
    """
    k = min_run.bit_length() - 1
    if min_run != 1 << k:
        raise ValueError("min_run must be a power of two")
    if len(levels) <= k:
        return None
    later = levels[k].filter(F.col("first") < F.struct(*AT))
    order = W.partitionBy(*ROW).orderBy("pos")
    before = F.lag(F.struct("pos", "first")).over(order)
    follows = (F.col("_b.pos") + 1 == F.col("pos")) & (F.col("_b.first._doc") == F.col("first._doc")) & (F.col("_b.first._text") == F.col("first._text")) & (F.col("_b.first.pos") + 1 == F.col("first.pos"))
    later = later.withColumn("_b", before).withColumn("_new", F.coalesce(~follows, F.lit(True)).cast("int"))
    later = later.withColumn("_run", F.sum("_new").over(order))
    return later.groupBy(*ROW, "_run").agg(F.min("pos").alias("pos"), (F.count("*") + (min_run - 1)).alias("lines"), F.min("first").alias("first")).drop("_run")


def later_copies(levels: list[DataFrame], min_run: int = MIN_RUN, single: bool = False) -> DataFrame | None:
    """(_doc, _text, _gone, longest, power): numbers of the lines that go, the longest later copy, and the longest repeated 2^k lines.

    single: also lines that are runs by themselves (long, or their document's only one), as line_ids marked them.
    """
    if not levels:
        return None
    power = levels[0].select(*ROW, F.lit(1).alias("power"))
    for k, level in enumerate(levels[1:], 1):
        power = power.unionByName(level.select(*ROW, F.lit(1 << k).alias("power")))
    power = power.groupBy(*ROW).agg(F.max("power").alias("power"))
    runs = repeated_runs(levels, min_run)
    if single:
        alone = levels[0].filter(F.col("alone") & (F.col("first") < F.struct(*AT))).select(*ROW, "pos", F.lit(1).cast("bigint").alias("lines"), "first")
        runs = alone if runs is None else runs.unionByName(alone)
    if runs is None:
        return power.select(*ROW, F.lit(None).cast("array<int>").alias("_gone"), F.lit(0).cast("bigint").alias("longest"), "power")
    runs = common.cut(runs)
    places = runs.select(*ROW, F.explode(F.sequence(F.col("pos"), (F.col("pos") + F.col("lines") - 1).cast("int"))).alias("pos")).distinct()
    gone = places.join(levels[0].select(*AT, "line"), AT).groupBy(*ROW).agg(F.collect_list("line").alias("_gone"))
    longest = runs.groupBy(*ROW).agg(F.max("lines").alias("longest"))
    return power.join(gone.join(longest, ROW), ROW, "left").select(*ROW, "_gone", "longest", "power")


COUNTS = ["n_lines", "n_removed", "longest_run", "longest_power"]


def remove_repeated_lines(df: DataFrame, key: str, text: str, min_run: int = MIN_RUN, single: bool = False) -> DataFrame:
    """The rows with the text cleaned, and COUNTS (in lines with a word) behind them.

    n_lines, n_removed; longest_run: the longest run that is a later copy; longest_power: the largest 2^k
    such that a run of so many lines is repeated at all. Columns of those names are replaced; all others
    stay as they are.
    """
    gone = later_copies(doubling(line_ids(df, key, text, single)), min_run, single)
    if gone is None:
        gone = df.sparkSession.createDataFrame([], "_doc bigint, _text bigint, _gone array<int>, longest bigint, power int")
    gone = gone.select(F.col("_doc").alias("_d"), F.col("_text").alias("_t"), "_gone", "longest", "power")
    # The caller's columns travel in a struct, where no name can clash.
    names = [c for c in df.columns if c not in COUNTS]
    rows = df.select(F.struct(*[c for c in names if c != text]).alias("_others"), F.col(text).alias("_old"), *_row_key(key, text))
    # Texts are split after the join, so that they're shuffled once.
    out = rows.join(gone, (F.col("_doc") == F.col("_d")) & (F.col("_text") == F.col("_t")), "left").withColumn("_lines", F.split(F.col("_old"), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    n = F.size(F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    cleaned = F.when(F.col("_gone").isNotNull(), kept).otherwise(F.col("_old"))
    counts = [F.when(F.col("_old").isNull(), 0).otherwise(n).cast("bigint"), F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint"), F.coalesce("longest", F.lit(0)).cast("bigint"), F.coalesce("power", F.lit(0)).cast("bigint")]
    return out.select(*[cleaned.alias(c) if c == text else F.col("_others")[c].alias(c) for c in names], *[c.alias(k) for k, c in zip(COUNTS, counts, strict=True)])


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, longest_run, longest_power, kept_sha256 (of the text that stays; null for a null text)."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_lines(docs, "doc_id", "text").select("doc_id", "n_lines", "n_removed", "longest_run", "longest_power", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def _common(a: str, b: str) -> str:
    """Length of the common prefix of two lists in DuckDB's SQL."""
    n = f"least(len({a}), len({b}))"
    return f"coalesce(list_min([i FOR i IN range(1, {n} + 1) IF {a}[i] <> {b}[i]]) - 1, {n}, 0)"


ORACLE = rf"""
WITH lines AS (SELECT doc_id, i, ls[i] AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM lines WHERE regexp_matches(t, '[^\x20\x09-\x0D]')),
pairs AS (SELECT doc_id, pos, t || chr(10) || lead(t) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM w),
f AS (SELECT s, min(struct_pack(a := doc_id, b := pos)) AS f FROM pairs WHERE s IS NOT NULL GROUP BY s),
later AS (SELECT doc_id, pos, f.f.a AS fa, f.f.b AS fb FROM pairs JOIN f USING (s) WHERE struct_pack(a := doc_id, b := pos) > f.f),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1]) AS pos FROM later),
island AS (SELECT doc_id, fa, fb - pos AS diagonal, pos - row_number() OVER (PARTITION BY doc_id, fa, fb - pos ORDER BY pos) AS k FROM later),
long AS (SELECT doc_id, max(n) + 1 AS longest FROM (SELECT doc_id, count(*) AS n FROM island GROUP BY doc_id, fa, diagonal, k) GROUP BY doc_id),
goneline AS (SELECT doc_id, i FROM w JOIN gone USING (doc_id, pos)),
kept AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY i) AS t FROM lines ANTI JOIN goneline USING (doc_id, i) GROUP BY doc_id),
seq AS (SELECT doc_id, list(hash(t) ORDER BY pos) AS s FROM w GROUP BY doc_id),
suffix AS (SELECT doc_id, s[p:] AS s FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS p FROM seq)),
near AS (SELECT doc_id, s, lag(s) OVER o AS a, lead(s) OVER o AS b FROM suffix WINDOW o AS (ORDER BY s)),
run AS (SELECT doc_id, max(greatest(CASE WHEN a IS NULL THEN 0 ELSE {_common("s", "a")} END, CASE WHEN b IS NULL THEN 0 ELSE {_common("s", "b")} END)) AS lcp FROM near GROUP BY doc_id)
SELECT d.doc_id, (SELECT count(*) FROM w WHERE w.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM goneline g WHERE g.doc_id = d.doc_id) AS n_removed,
       coalesce(longest, 0)::BIGINT AS longest_run, CASE WHEN coalesce(lcp, 0) > 0 THEN (2 ** floor(log2(lcp)))::BIGINT ELSE 0 END AS longest_power, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.t, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN run USING (doc_id) LEFT JOIN long USING (doc_id)
"""
