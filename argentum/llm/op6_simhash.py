"""SimHash near-dedup with a byte-position inverted index and count filtering.

A fingerprint has 64 bits in 8 bytes. If two differ in at most 4 bits, at least 8 - 4 = 4 of their bytes
agree in place and value: that is the guaranteed minimum of matches. Lists of single bytes would hold
1/256 of all fingerprints each, so the index is keyed by triples of byte positions with their values:
20 triples are enough that every set of 4 positions contains one. Within a list the shared positional
bytes of a pair are tallied, pairs under the minimum go, and the rest are verified by their bits.

Exact copies have one fingerprint, so the index is over different fingerprints only. Of a list only a
spanning forest of its links is passed on: a search from an unvisited fingerprint takes in all that it
reaches, and these aren't compared again; near copies by the thousand cost little more than one another's
first comparison. Lists over HOT_LIST go another exact way: two fingerprints within 4 bits have a point
within 2 bits of both, so each is sent to all points within 2 bits (in the bytes that the list leaves
free), and who meets at a point is linked; that spreads a list over all tasks. The links' components are
found by alternating large-star and small-star steps. Joins on a fingerprint, a node or a root that many rows
share send these rows to a broadcast of the hot keys, not to one task.

Four bits of 64 are the contract's measure: of near copies that differ in some words it finds those whose
fingerprints stay that close (see the README), of exact copies all.

Cases: a null text, or one without words, has fingerprint 0 and is linked like any other; texts of any length are
hashed whole; the query reads key and text only, and keep_first keeps columns of any name; a text of fewer
than 4 words is one shingle; repeated rows come back as often as they came; null ids have no number to
give, so a component of only such has a null id; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.llm import alike, common

SHINGLE, SEED, MOST_BITS, MIN_BYTES = 4, 42, 4, 4
#: Fingerprints of a list beyond which it's spread over tasks by points.
HOT_LIST = 50_000
#: Fingerprints that are handled together in a block of an index task.
BLOCK = 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: n - 1].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 1 << 16):
        bits += np.unpackbits(raw[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(raw), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], names=[key, "fp"])
            del batch
        common.give_back()

    common.small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def triples() -> list[tuple[int, ...]]:
    """20 triples of 8 positions such that any 4 positions contain one of them.

    Turan's construction: in three groups A, B, C take the triples within a group and those with two in
    one group and one in the next.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    found = []
    for t in combinations(range(8), 3):
        g = sorted(group[i] for i in t)
        two = max(g, key=g.count)
        one = [x for x in g if x != two]
        if not one or (len(one) == 1 and one[0] == (two + 1) % 3):
            found.append(t)
    return found


def lists(fps: DataFrame) -> DataFrame:
    """(list, fp): each fingerprint under its 20 triples. list is the triple's number and its three bytes."""
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    keys = [F.lit(k << 24).cast("bigint") + byte(a) * (1 << 16) + byte(b) * (1 << 8) + byte(c) for k, (a, b, c) in enumerate(triples())]
    return fps.select(F.explode(F.array(*keys)).alias("list"), "fp")


def _linked(x: np.uint64, others: np.ndarray) -> np.ndarray:
    """Tallies equal bytes in place, drops those under the minimum, and verifies the bits of the rest."""
    d = others ^ x
    d_bytes = d.view(np.uint8).reshape(-1, 8)
    near = np.flatnonzero(np.count_nonzero(d_bytes == 0, axis=1) >= MIN_BYTES)
    ok = np.zeros(len(others), bool)
    ok[near] = np.bitwise_count(d[near]) <= MOST_BITS
    return ok


def forest(x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (from, to) that join what all links among x join, and no more of them than x has members."""
    a, b = [], []
    left = x
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            ok = _linked(at, left)
            if ok.any():
                met = left[ok]
                a.append(np.full(len(met), at))
                b.append(met)
                left = left[~ok]
                queue += list(met)
    return a, b


def _links_of(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the lists; keys are sorted. Short lists are compared all at once, by distance in the order."""
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(edge, len(keys)))
    a, b = [], []
    short = np.repeat((size > 1) & (size <= 32), size)
    k, v = keys[short], x[short]
    for d in range(1, 32):
        if len(k) <= d:
            break
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        diff = v[same + d] ^ v[same]
        tally = np.count_nonzero(diff.view(np.uint8).reshape(-1, 8) == 0, axis=1) >= MIN_BYTES
        ok = same[tally & (np.bitwise_count(diff) <= MOST_BITS)]
        a.append(v[ok])
        b.append(v[ok + d])
    for s, n in zip(edge[size > 32].tolist(), size[size > 32].tolist(), strict=True):
        p, q = forest(x[s : s + n])
        a += p
        b += q
    none = np.array([], np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _index_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by list; a list that goes on in the next batch waits for its end."""
    keys, x = np.array([], np.int64), np.array([], np.uint64)

    def out(k: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        a, b = _links_of(k, v)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        x = np.concatenate([x, batch.column(1).to_numpy().view(np.uint64)])
        if len(keys) >= BLOCK and (whole := int(np.searchsorted(keys, keys[-1]))):
            yield out(keys[:whole], x[:whole])
            keys, x = keys[whole:], x[whole:]
    if len(keys):
        yield out(keys, x)
    del keys, x
    common.give_back()


def _points(rows: DataFrame) -> DataFrame:
    """Links of hot lists: members that share a point within 2 bits in the 5 free bytes are linked through the smallest."""
    masks = []
    for t in triples():
        free = [8 * i + j for i in range(8) if i not in t for j in range(8)]
        flips = [0, *[1 << i for i in free], *[1 << i | 1 << j for i, j in combinations(free, 2)]]
        masks.append(np.array(flips, np.uint64).view(np.int64).tolist())
    table = rows.sparkSession.createDataFrame([(k, m) for k, m in enumerate(masks)], "triple int, masks array<bigint>")
    sent = rows.withColumn("triple", F.shiftright("list", 24).cast("int")).join(F.broadcast(table), "triple").select("list", "fp", F.explode("masks").alias("m"))
    sent = sent.select("list", "fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
    least = sent.groupBy("list", "point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a <> z").drop("z")
    return sent.join(least, ["list", "point"]).filter("a <> fp").select("a", F.col("fp").alias("b"))


def links(fps: DataFrame, hot_list: int = HOT_LIST) -> DataFrame:
    """(a, b): links between different fingerprints that join what all links join."""
    rows = lists(fps)
    sizes = rows.groupBy("list").agg(F.count("*").alias("n"))
    hot = common.cut(sizes.filter(F.col("n") > hot_list).select("list"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cool = rows
    if some := hot.limit(1).count():
        cool = rows.join(hot, "list", "left_anti")
    found = cool.repartition(n, "list").sortWithinPartitions("list").mapInArrow(_index_task, "a bigint, b bigint")
    if some:
        found = found.unionByName(_points(rows.join(hot, "list")))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of an edge with the smallest node that it reaches.

    Large-star: every larger neighbour of a node is hung on the node's smallest neighbour. Small-star: the
    same with the smaller neighbours and the node itself. Both keep components as they are; when nothing
    changes any more, every component is a star around its smallest node.
    """

    def step(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            e = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = common.cut(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")))
        hung = common.meet(e, least, ["u"], "n")
        if large:
            hung = hung.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            hung = hung.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return hung.filter("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = common.cut(edges)
    before = mark(edges)
    while before[0]:
        edges = common.cut(step(common.cut(step(edges, True)), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(df: DataFrame, key: str, text: str, shingle: int = SHINGLE, hot_list: int = HOT_LIST) -> DataFrame:
    """key, fp (signed), component_id: the smallest key among the documents that links reach."""
    rows = common.cut(fingerprints(df, key, text, shingle))
    distinct = common.cut(rows.groupBy("fp").agg(F.min(key).alias("_least"), F.count("*").alias("_rows")))
    found = components(links(distinct.select("fp"), hot_list))
    groups = common.cut(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "_least", "_rows", F.coalesce("root", "fp").alias("root")))
    ids = common.cut(groups.groupBy("root").agg(F.min("_least").alias("component_id"), F.count("*").alias("_members")))
    named = common.cut(common.meet(groups, ids, ["root"], "_members").select("fp", "component_id", "_rows"))
    return common.meet(rows, named, ["fp"], "_rows").select(key, "fp", "component_id")


def keep_first(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows, all their columns as they were, of which each component keeps one: that with the smallest key.

    Of rows with the same key the one whose columns hash smallest stays; rows without a key follow all others.
    """
    names = df.columns
    row = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.xxhash64(*names).alias("h"))
    # The caller's columns travel in a struct, where no name can clash.
    marked = df.select(row.alias("_row"), F.struct(*names).alias("_all"), F.col(text).alias("_t"))
    rows = common.cut(fingerprints(marked.select("_row", "_t"), "_row", "_t"))
    distinct = common.cut(rows.groupBy("fp").agg(F.min("_row").alias("_least")))
    found = components(links(distinct.select("fp")))
    groups = distinct.join(found, distinct["fp"] == found["node"], "left").select("_least", F.coalesce("root", "fp").alias("root"))
    stay = common.cut(groups.groupBy("root").agg(F.min("_least").alias("_stay")).select("_stay"))
    kept = marked.select("_row", "_all").join(stay, F.col("_row").eqNullSafe(F.col("_stay")), "left_semi")
    # Rows that are equal in every column have one hash; they are one.
    return kept.dropDuplicates(["_row"]).select("_all.*")


def keep_first_alike(df: DataFrame, key: str, text: str) -> DataFrame:
    """Like keep_first, where texts are linked by 4/5 of their five-word shingles too (see alike), not by fingerprints only."""
    names = df.columns
    row = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.xxhash64(*names).alias("h"))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = df.select(row.alias("_row"), F.struct(*names).alias("_all"), t.alias("_t"), F.xxhash64(t).alias("doc"))
    rows = common.cut(fingerprints(marked.select(F.struct("_row", "doc").alias("_id"), "_t"), "_id", "_t").select("_id.*", "fp"))
    docs = common.cut(rows.groupBy("doc").agg(F.min("_row").alias("_least"), F.min("fp").alias("fp")))
    one = common.cut(docs.groupBy("fp").agg(F.min("doc").alias("one")))
    found = links(one.select("fp")).join(one.toDF("a", "x"), "a").join(one.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = docs.join(one, "fp").filter("doc <> one").select(F.col("one").alias("a"), F.col("doc").alias("b"))
    edges = alike.links(marked.select("doc", "_t"), common.cut(found.unionByName(same)), components)
    groups = docs.join(components(edges).select(F.col("node").alias("doc"), "root"), "doc", "left").select("_least", F.coalesce("root", "doc").alias("root"))
    stay = common.cut(groups.groupBy("root").agg(F.min("_least").alias("_stay")).select("_stay"))
    kept = marked.select("_row", "_all").join(stay, F.col("_row").eqNullSafe(F.col("_stay")), "left_semi")
    return kept.dropDuplicates(["_row"]).select("_all.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = near_duplicates(docs, "doc_id", "text")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


common.ship(common)
common.ship(sys.modules[__name__])
