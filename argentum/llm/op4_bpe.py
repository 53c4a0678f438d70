"""Byte-level BPE by corpus-level merge replay.

The distinct words of a block of texts are turned into symbols once. An inverted index from a pair's rank
to the places where it stands is then replayed in rank order: a merge is applied at all its places in all
words, and only the pairs with the touched neighbours are taken up anew. Words that were met before come
from a bounded store. Texts are joined together from their words' ids, and decoded again from the ids.

Cases: a null text is an empty one and has no ids; a text of any length, and a word of any length, is one of
a block's; of equal ranks in a word the leftmost merges first; rows and their ids may repeat; other columns
aren't read, and the pipeline's form replaces those of its own names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.llm import common

#: Bytes of texts whose new words are replayed together, and words that a worker keeps.
BLOCK_BYTES, KEPT_WORDS = 4 << 20, 500_000


def parse_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


#: Bits of a token id, and the id that stands between words (no byte 255 occurs in UTF-8).
ID_BITS = 20
GAP, GAP_BYTE = (1 << ID_BITS) - 1, 255


class Merges:
    """All pairs of tokens that make a token: (left << ID_BITS | right) to its rank; and tables for single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        self.ranks = ranks
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None:
                    self.pairs[a << ID_BITS | b] = rank
        self.byte_id = np.full(256, GAP, np.int32)
        self.byte_pair = np.full(1 << 16, -1, np.int32)
        for x in range(255):
            self.byte_id[x] = ranks[bytes([x])]
            for y in range(255):
                self.byte_pair[x << 8 | y] = get(bytes([x, y]), -1)


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """The ids of each word, little-endian unsigned 32-bit: its bytes, with all merges applied in rank order.

    Within a word the lowest rank comes first and, of equals, the leftmost; words don't depend on each
    other, so one pass over the ranks serves them all. A merge may give rise to a pair of a lower rank
    in its word: the word's later places then wait until that rank has been done.
    """
    whole = [merges.ranks.get(w) for w in words]
    data = b"".join(w + b"\xff" for w, id_ in zip(words, whole, strict=True) if id_ is None)
    raw = np.frombuffer(data, np.uint8)
    # The index: places of each rank, at first for pairs of bytes.
    first = merges.byte_pair[raw[:-1].astype(np.int32) << 8 | raw[1:]] if len(raw) else np.array([], np.int32)
    places = np.flatnonzero(first >= 0)
    places = places[np.argsort(first[places], kind="stable")]
    found, at = np.unique(first[places], return_index=True)
    index: dict[int, list[int]] = {r: p.tolist() for r, p in zip(found.tolist(), np.split(places, at[1:]), strict=True)} if len(found) else {}
    heap = list(index)
    heapq.heapify(heap)
    symbols = merges.byte_id[raw].tolist()
    follow = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    get, listed = merges.pairs.get, index.get
    while heap:
        rank = heapq.heappop(heap)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        wait = -1  # the end of the word whose remaining places wait
        for i in places:
            if i < wait:
                index.setdefault(rank, []).append(i)
                continue
            left = symbols[i]
            if left < 0:
                continue
            j = follow[i]
            if get(left << ID_BITS | symbols[j]) != rank:
                continue
            symbols[i], symbols[j] = rank, -1
            k = follow[i] = follow[j]
            before[k] = i
            lower = False
            if (r := get(rank << ID_BITS | symbols[k])) is not None:
                if (more := listed(r)) is not None:
                    more.append(i)
                else:
                    index[r] = [i]
                    heapq.heappush(heap, r)
                lower = r < rank
            h = before[i]
            if (r := get(symbols[h] << ID_BITS | rank)) is not None:
                if (more := listed(r)) is not None:
                    more.append(h)
                else:
                    index[r] = [h]
                    heapq.heappush(heap, r)
                lower |= r < rank
            if lower:
                wait = data.index(GAP_BYTE, i)
        if rank in index:
            heapq.heappush(heap, rank)
    ids = np.array(symbols, np.int32)
    ids = ids[ids >= 0]
    gaps = np.flatnonzero(ids == GAP).tolist()
    packed = ids.astype("<u4").tobytes()
    out, start, gap = [], 0, iter(gaps)
    for id_ in whole:
        if id_ is None:
            end = next(gap)
            out.append(packed[4 * start : 4 * end])
            start = end + 1
        else:
            out.append(id_.to_bytes(4, "little"))
    return out


class Coder:
    """Encodes and decodes by a table of ranks; a bounded store keeps the ids of words as little-endian bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT_WORDS):
        import regex

        self.merges, self.split, self.kept, self.store = Merges(ranks), regex.compile(pattern).findall, kept, {}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.split(t) for t in texts]
        met = set().union(*cut)
        if len(self.store) > self.kept:  # the words of this block are the likeliest to come again
            self.store = {w: self.store[w] for w in met & self.store.keys()}
        fresh = list(met - self.store.keys())
        self.store.update(zip(fresh, replay([w.encode("utf-8") for w in fresh], self.merges), strict=True))
        get = self.store.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _coder(path: str, pattern: str) -> Coder:
    """The worker's coder; tasks of one worker share its store."""
    held = common.worker_store()
    if (path, pattern) not in held:
        held.clear()
        with open(path, "rb") as f:
            held[path, pattern] = Coder(parse_ranks(f), pattern)
    return held[path, pattern]


def encode(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """(key, ids, n_tokens, decoded): ids are little-endian unsigned 32-bit integers, decoded the bytes they stand for.

    path: the tokenizer's ranks, a file that is installed on every machine. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for piece in common.pieces(batches, text, BLOCK_BYTES):
            ids = coder.encode([x or "" for x in piece.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([coder.decode(x) for x in ids], pa.binary())], names=[key, "ids", "n_tokens", "decoded"])

    common.small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids binary, n_tokens bigint, decoded binary")


def vocabulary() -> tuple[str, str]:
    """The public ranks that production uses, and their pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = encode(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id", "text", *vocabulary())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def tokenised(docs: DataFrame) -> DataFrame:
    """The rows with n_tokens, ids, ids_sha256 and decoded_sha256. Columns of those names are replaced; all others stay."""
    path, pattern = vocabulary()
    names = [c for c in docs.columns if c not in ("n_tokens", "ids", "ids_sha256", "decoded_sha256")]
    docs = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for piece in common.pieces(batches, "text", BLOCK_BYTES):
            ids = coder.encode([x or "" for x in piece.column(names.index("text")).to_pylist()])
            added = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids])]
            yield pa.RecordBatch.from_arrays([*piece.columns, *added], names=[*names, "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    common.small_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))


common.ship(common)
common.ship(sys.modules[__name__])
