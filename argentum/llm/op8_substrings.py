"""Substring dedup: repeated word windows by level-wise doubling.

Level 1 asks which windows of BASE words occur more than once. Only where two such windows follow each
other can a window of twice the length be repeated; those go on to the next level, and so on until no
candidates survive or the wanted length is reached. Every word covered by a repeated window that isn't
the first of its kind, in the order of (doc_id, start), is removed.

How a level is asked: the texts are written once as a bucketed table of slots of some MB, with a code for each word and
the hashes of a slot's different words, from which the levels work. A slot hashes its windows and sends each different hash once, packed by hash range, so a passage that all documents
share costs a slot one hash. A range finds the hashes that several slots sent and answers with one bit
for each. The answers meet the slots at their buckets: no text is shuffled at any level. The low levels
only filter and use 32 bits within a range; the last one decides by 96 bits. All come from a keyed hash of
each word with a key that is drawn for the run, so that no text can be written to collide; by chance, 10^13
windows hold a collision with a probability under 0.002.

Cases: a null text has no words; texts of any length are taken whole; a text under a window's length has
no window; null ids come first, like the smallest number; rows with the same id and the same text are as
early as each other, so neither is removed for the other's sake; other columns aren't read, so their names
don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.llm import common

WINDOW, BASE = 20, 5
#: Bytes of texts in a slot, of a block that is hashed at once, and windows in a range.
SLOT_BYTES, BLOCK, RANGE_WINDOWS = 3 << 20, 4 << 20, 1_500_000
SPACE = re.compile(rb"[\x09-\x0d ]")
#: Buckets of the table of slots at most (Spark allows 100 000); beyond that a bucket holds several tasks' files.
MOST_BUCKETS = 50_000
U = np.uint64
_R = 0x9E3779B97F4A7C15
FILTER, FULL = np.dtype("<u4"), np.dtype([("a", "<u8"), ("b", "<u4")])


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _pair(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    return _scramble(x * U(_R + 2 * seed) + (y ^ (y >> U(32))) * U(0xD6E8FEB86659FD93))


class Codes(dict):
    """Words to their numbers, given out as words are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def encoded(texts: list[bytes], secret: bytes) -> tuple[list[int], np.ndarray, bytes]:
    """(number of words of each text, a code for each word of all texts, the digests of the coded words).

    A digest is a keyed BLAKE2b: who writes texts can't make words, or windows of words, that collide. Texts are cut
    into blocks at white space, so a long text is never a list of all its words.
    """
    codes = Codes()
    code = codes.__getitem__
    parts, counts = [np.array([], np.uint32)], []
    for text in texts:
        at = n = 0
        while at < len(text):
            cut = SPACE.search(text, at + BLOCK) if len(text) > at + BLOCK else None
            end = cut.start() if cut else len(text)
            parts.append(np.fromiter(map(code, text[at:end].split()), np.uint32))
            n += len(parts[-1])
            at = end
        counts.append(n)
    return counts, np.concatenate(parts), b"".join(hashlib.blake2b(w, digest_size=16, key=secret).digest() for w in codes)


def spark_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket, of n, in which Spark puts a bigint (Murmur3, seed 42)."""
    u = np.uint32
    rot = lambda x, r: (x << u(r)) | (x >> u(32 - r))
    h = np.full(len(keys), 42, u)
    k = keys.astype(U)
    for part in (k & U(0xFFFFFFFF), k >> U(32)):
        x = rot(part.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593)
        h = rot(h ^ x, 13) * u(5) + u(0xE6546B64)
    h ^= u(8)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).astype(np.int32).astype(np.int64) % n


class Slot:
    """The words of some documents, and the windows of each level that are still in question."""

    def __init__(self, ids: list[int], counts: list[int], codes: np.ndarray, digests: bytes):
        self.ids = np.array(ids, np.int64)
        self.hashes = np.frombuffer(digests, "<u8").reshape(-1, 2)[codes]
        self.doc = np.repeat(np.arange(len(ids)), counts)
        self.first = np.cumsum(counts) - counts
        self.places = np.arange(len(self.hashes))
        self.length = 0
        self.chains: dict[int, np.ndarray] = {}

    def begin(self, base: int) -> None:
        """All windows of base words."""
        m = max(len(self.hashes) - base + 1, 0)
        places = np.arange(m)
        self.places, self.length = places[self.doc[:m] == self.doc[base - 1 : base - 1 + m]], base
        for seed in (1, 2):
            word = np.ascontiguousarray(self.hashes[:, seed - 1])
            h = word[:m]
            for k in range(1, base):
                h = _pair(h, word[k : k + m], seed)
            self.chains[seed] = h

    def extend(self, repeated: np.ndarray) -> None:
        """Keeps the windows of twice the length whose halves are both repeated; repeated: by window in question."""
        n, size = self.length, len(self.chains[1])
        good = np.zeros(size + n, bool)
        good[self.places[repeated]] = True
        keep = self.places[good[self.places] & good[self.places + n]]
        keep = keep[self.doc[keep] == self.doc[np.minimum(keep + 2 * n - 1, len(self.doc) - 1)]]
        for seed, h in self.chains.items():
            wide = np.zeros(size, U)
            wide[keep] = _pair(h[keep], h[keep + n], seed + n)
            self.chains[seed] = wide
        self.places, self.length = keep, 2 * n

    def ask(self, ranges: int, full: bool) -> "Question":
        return Question(self, ranges, full)


class Question:
    """A slot's different hashes in a fixed order, by range; of each the first place."""

    def __init__(self, slot: Slot, ranges: int, full: bool):
        a = slot.chains[1][slot.places]
        range_ = ((a >> U(32)) * U(ranges)) >> U(32)
        if full:
            key = np.empty(len(a), FULL)
            key["a"], key["b"] = a, slot.chains[2][slot.places].astype(np.uint32)
            order = np.lexsort((slot.places, key["b"], a))
        else:
            # within a range the hash's low bits tell its windows apart
            key = a.astype(FILTER)
            order = np.lexsort((slot.places, key, range_))
        key, range_ = key[order], range_[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (range_[1:] != range_[:-1])
        self.slot, self.order = slot, order
        self.group = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.key, self.range, self.count = key[at], range_[at], np.diff(np.append(at, len(key)))
        self.cut = np.flatnonzero(np.append(True, self.range[1:] != self.range[:-1])) if len(self.range) else np.array([], int)
        places = slot.places[order]
        # the earliest (doc_id, start) of each hash: documents of a slot come in any order
        ids, start = slot.ids[slot.doc[places]], places - slot.first[slot.doc[places]]
        if full:
            by = np.lexsort((start, ids, self.group))
            lead = by[np.flatnonzero(np.diff(self.group[by], prepend=-1))]
            self.first_id, self.first_start = ids[lead], start[lead]
            self.is_first = (ids == self.first_id[self.group]) & (start == self.first_start[self.group])

    def rows(self) -> Iterator[tuple[int, int, int]]:
        """(range, from, to) of the packed hashes."""
        ends = np.append(self.cut[1:], len(self.key))[: len(self.cut)]  # none, if no window is in question
        for s, e in zip(self.cut.tolist(), ends.tolist(), strict=True):
            yield int(self.range[s]), s, e

    def answered(self, bits: dict[int, bytes]) -> np.ndarray:
        """One truth value for each different hash."""
        out = np.zeros(len(self.key), bool)
        for r, s, e in self.rows():
            out[s:e] = np.unpackbits(np.frombuffer(bits[r], np.uint8), count=e - s).astype(bool)
        return out

    def by_window(self, of_hash: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.order), bool)
        out[self.order] = of_hash[self.group]
        return out


def _planes(x: np.ndarray, kind: str = "<i8") -> bytes:
    """The bytes of whole numbers, all lowest bytes first: high zero bytes then compress away."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""


def _from_planes(b: bytes, kind: str = "<i8") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


ASK = "range bigint, slot bigint, hashes binary, ids binary, starts binary"
ANSWER = "level int, slot bigint, range bigint, bits binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
KEPT = "doc_id bigint, _at bigint, _words binary"


SLOTS = "slot bigint, seq bigint, size bigint, doc_id bigint, text string, n_words bigint, codes binary, digests binary"


def _slots(n: int, secret: bytes):
    """Rows get slots; all of a task's slots lie in one bucket of n, so that each task writes one file.

    A slot's first row also has the codes and digests of all its words, so that the levels needn't read the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get().partitionId()
        tries = np.arange(32 * n, dtype=np.int64)
        found: list[int] = []
        tried = 0
        number = 0
        for piece in common.pieces(batches, "text", SLOT_BYTES):
            while not found:
                c = (me << 32) + tried + tries
                found, tried = c[spark_bucket(c, n) == me % n].tolist(), tried + len(tries)
            slot = found.pop(0)
            text = piece.column(1)
            size = pa.compute.cast(pa.compute.binary_length(text), pa.int64()).fill_null(0)
            counts, codes, digests = encoded([x.as_buffer().to_pybytes() if x.is_valid else b"" for x in text], secret)
            none = [None] * (len(text) - 1)
            columns = [pa.array([slot] * len(text), pa.int64()), pa.array(range(number, number + len(text)), pa.int64()), size, piece.column(0), text, pa.array(counts, pa.int64()), pa.array([_planes(codes, "<u4"), *none], pa.binary()), pa.array([digests, *none], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SLOTS.split(", ")])
            number += len(text)

    return run


def _open(table: pa.Table) -> tuple[Slot, list, np.ndarray]:
    """The slot, its ids as they are, and the order of its rows."""
    order = np.argsort(table.column("seq").to_numpy(), kind="stable")
    ids, counts = (table.column(c).to_pylist() for c in ("doc_id", "n_words"))
    codes, digests = (next(x for x in table.column(c).to_pylist() if x is not None) for c in ("codes", "digests"))
    ids = [ids[i] for i in order]
    return Slot([-(1 << 63) if d is None else d for d in ids], [counts[i] for i in order], _from_planes(codes, "<u4"), digests), ids, order


def _replayed(slot: Slot, answers: pa.Table | None, lengths: list[int], ranges: int, last: int) -> list[Question]:
    """Goes through the levels that have been answered; the last question still stands open unless answered."""
    got: dict[int, dict[int, bytes]] = {}
    if answers is not None:
        for level, r, bits in zip(answers.column("level").to_pylist(), answers.column("range").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            got.setdefault(level, {})[r] = bits
    slot.begin(lengths[0])
    q = slot.ask(ranges, last == 0 and len(lengths) == 1)
    for level in range(last):
        slot.extend(q.by_window(q.answered(got.get(level, {})) | (q.count > 1)))
        q = slot.ask(ranges, level + 1 == len(lengths) - 1)
    return [q, got.get(last, {})]


def _asking(lengths: list[int], ranges: int, level: int):
    full = level == len(lengths) - 1

    def run(key, table: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        slot, _, _ = _open(table)
        q, _ = _replayed(slot, answers, lengths, ranges, level)
        rows = list(q.rows())
        none = [None] * len(rows)
        return pa.table(
            {
                "range": pa.array([r for r, _, _ in rows], pa.int64()),
                "slot": pa.array([table.column("slot")[0].as_py()] * len(rows), pa.int64()),
                "hashes": pa.array([q.key[s:e].tobytes() for _, s, e in rows], pa.binary()),
                "ids": pa.array([_planes(q.first_id[s:e]) for _, s, e in rows] if full else none, pa.binary()),
                "starts": pa.array([_planes(q.first_start[s:e]) for _, s, e in rows] if full else none, pa.binary()),
            }
        )

    return run


def _answering(level: int, full: bool):
    """For each slot's hashes of a range, one bit: also sent by another slot or, at the last level, first found here."""

    def run(table: pa.Table) -> pa.Table:
        packed = table.column("hashes").to_pylist()
        keys = np.concatenate([np.frombuffer(x, FULL if full else FILTER) for x in packed])
        bounds = np.cumsum([0] + [len(x) // (FULL if full else FILTER).itemsize for x in packed])
        if full:
            ids = np.concatenate([_from_planes(x) for x in table.column("ids").to_pylist()])
            starts = np.concatenate([_from_planes(x) for x in table.column("starts").to_pylist()])
            order = np.lexsort((starts, ids, keys["b"], keys["a"]))
            sorted_ = keys[order]
            new = np.append(True, sorted_[1:] != sorted_[:-1])
            lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            bit = np.empty(len(keys), bool)
            bit[order] = (ids[order] == ids[lead]) & (starts[order] == starts[lead])
        else:
            order = np.argsort(keys, kind="stable")
            sorted_ = keys[order]
            same = sorted_[1:] == sorted_[:-1]
            bit = np.empty(len(keys), bool)
            bit[order] = np.append(False, same) | np.append(same, False)
        return pa.table(
            {
                "level": pa.array([level] * len(packed), pa.int32()),
                "slot": table.column("slot").combine_chunks(),
                "range": table.column("range").combine_chunks(),
                "bits": pa.array([np.packbits(bit[s:e]).tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
            }
        )

    return run


def _removing(lengths: list[int], ranges: int, texts: bool):
    window = lengths[-1]

    def run(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([[]] * 4, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()) if texts else ("kept_sha256", pa.string())]))
        slot, ids, order = _open(table)
        texts_ = [x for c in table.column("text").chunks for x in c]
        raw = (texts_[i].as_buffer().to_pybytes() if texts_[i].is_valid else b"" for i in order)
        q, bits = _replayed(slot, answers, lengths, ranges, len(lengths) - 1)
        later = ~(q.answered(bits)[q.group] & q.is_first)
        starts = slot.places[q.order[later]]
        cover = np.zeros(len(slot.hashes) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        ends = np.append(slot.first[1:], len(slot.hashes))
        rows = []
        for doc_id, text, s, e in zip(ids, raw, slot.first.tolist(), ends.tolist(), strict=True):
            words = text.split()
            n = int(np.count_nonzero(gone[s:e]))
            if n:
                words = [words[i] for i in np.flatnonzero(~gone[s:e])]
            kept = b" ".join(words)
            rows.append((doc_id, e - s, n, kept if texts else hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary() if texts else pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept" if texts else "kept_sha256"])

    return run


def remove_repeats(df: DataFrame, key: str, text: str, window: int = WINDOW, base: int = BASE, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (joined by one space; texts: as bytes, else their SHA-256).

    window must be base times a power of two. The levels are base, 2 base, 4 base ... window.
    """
    spark = df.sparkSession
    lengths = [base]
    while lengths[-1] < window:
        lengths.append(2 * lengths[-1])
    if lengths[-1] != window:
        raise ValueError("window must be base times a power of two")
    common.small_batches(spark)
    secret = secrets.token_bytes(32)
    slim = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = min(max(1, slim.rdd.getNumPartitions()), MOST_BUCKETS)
    name, path = f"argentum_slots_{uuid.uuid4().hex}", common.shared_path(spark, "slots")
    slots = slim.mapInArrow(_slots(n, secret), SLOTS)
    slots.write.bucketBy(n, "slot").option("compression", "zstd").option("path", path).saveAsTable(name)
    try:
        slots = spark.table(name)
        size = slots.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * RANGE_WINDOWS)))
        answers = spark.createDataFrame([], ANSWER)
        coded = slots.select("slot", "seq", "doc_id", "n_words", "codes", "digests")
        for level in range(len(lengths)):
            full = level == len(lengths) - 1
            if level:
                asked = coded.groupBy("slot").cogroup(answers.groupBy("slot")).applyInArrow(_with_answers(_asking(lengths, ranges, level)), ASK)
            else:
                asked = coded.groupBy("slot").applyInArrow(_alone(_asking(lengths, ranges, level)), ASK)
            answers = answers.unionByName(common.cut(asked.groupBy("range").applyInArrow(_answering(level, full), ANSWER)))
        schema = "doc_id bigint, n_words bigint, n_removed bigint, " + ("kept binary" if texts else "kept_sha256 string")
        return common.cut(slots.groupBy("slot").cogroup(answers.groupBy("slot")).applyInArrow(_removing(lengths, ranges, texts), schema))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        common.remove_path(spark, path)


def _with_answers(run):
    return lambda key, table, answers: run(key, table, answers)


def _alone(run):
    return lambda key, table: run(key, table)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), "doc_id", "text")


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
later AS (SELECT win.doc_id, win.i FROM win JOIN (SELECT s, min(struct_pack(a := doc_id, b := i)) AS f FROM win GROUP BY s) USING (s) WHERE struct_pack(a := doc_id, b := i) > f),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM later),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

common.ship(common)
common.ship(sys.modules[__name__])
