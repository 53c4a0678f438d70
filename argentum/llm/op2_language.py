"""Language ID by compression: a text's language is that whose dictionary compresses it best.

For each language a zstandard raw-content dictionary is made from a bounded sample of labelled texts.
Every piece of a text is encoded with each dictionary and the sizes are summed over the whole text; the
smallest sum names the language. Where the runner-up comes close, the text is rejected.

The sample is a piece from anywhere in each drawn text. A dictionary is as long as its language's sample, up to
DICTIONARY_BYTES: a language with little labelled text is told less surely, and takes nothing from the others.
Bounds of the learning, not of the prediction: SAMPLE_TEXTS pieces of TEXT_LETTERS for each of the MOST_LANGUAGES
that have most labelled texts (a table of dirty labels may hold any number of them).

Cases: a null text, or one without a letter, is `und` with score 0 and rejected; null languages, and those
whose labelled texts have no letter, are never learned; without any labelled text every prediction is
`und`; with one language only it is always that one; equal sums go to the language that comes first by
code point; a text of any length is encoded whole; repeated rows are predicted alike; only the named columns are
read, and filtering keeps columns of any name; an empty table gives an empty result. Where no language was learned,
filtering keeps every row that has a letter: nothing speaks against them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.llm import common

#: The sample: labelled texts drawn for a language, letters of each that enter, bytes of a dictionary, languages.
SAMPLE_TEXTS, TEXT_LETTERS, DICTIONARY_BYTES, MOST_LANGUAGES = 400, 1200, 96 << 10, 200
#: Bytes of a text that are encoded at once, level, and the margin below which a text is rejected.
PIECE, LEVEL, MARGIN = 4096, 11, 0.01
UNKNOWN = "und"


def sample(labelled: DataFrame, key: str, text: str, lang: str, texts: int = SAMPLE_TEXTS) -> list[tuple[str, str]]:
    """(language, plain piece) of at most about 1.5 times `texts` rows for each language, drawn by a hash of the key.

    Where a piece begins in its text's letters is drawn as well.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), lang).limit(MOST_LANGUAGES).collect()}
    if not counts:
        return []
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, 1.25 * texts / n)]), F.col(lang))
    letters = plain(F.col(text))
    start = F.pmod(F.xxhash64(F.lit("start"), F.col(key)), F.greatest(F.length(letters) - TEXT_LETTERS, F.lit(0)) + 1).cast("int") + 1
    drawn = rows.filter(draw < share).select(F.col(lang), F.substr(letters, start, F.lit(TEXT_LETTERS)), draw.alias("d"), F.xxhash64(text).alias("t"))
    return [(r[0], r[1]) for r in sorted(drawn.collect(), key=lambda r: (r[0], r[2], r[3]))]


def dictionaries(drawn: list[tuple[str, str]], size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A raw dictionary for each language that has letters: different texts in plain letters, as far as they fit."""
    found: dict[str, dict[bytes, None]] = {}
    used: dict[str, int] = {}
    for lang, text in drawn:
        raw = text.encode("utf-8")
        mine = found.setdefault(lang, {})
        if raw.strip() and raw not in mine and used.get(lang, 0) + len(raw) <= size:
            mine[raw] = None
            used[lang] = used.get(lang, 0) + len(raw)
    return {lang: b"".join(mine) for lang, mine in sorted(found.items()) if mine}


def plain(text: Column) -> Column:
    """Lower-case letters, with one space for whatever lies between them and at the ends; without a letter, a space."""
    letters = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}]+", " "))
    return F.concat(F.lit(" "), letters, F.lit(" "))


class Classifier:
    def __init__(self, raw: dict[str, bytes]):
        import zstandard

        self.langs = list(raw)
        self.encode = []
        for d in raw.values():
            d = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.encode.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def __call__(self, raw: bytes) -> tuple[str, float, float]:
        """(language, score, margin) of a plain text. The margin is the part by which the runner-up's size is larger."""
        if not self.langs or not raw.strip():
            return UNKNOWN, 0.0, 0.0
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        sums = [sum(len(encode(p)) for p in pieces) for encode in self.encode]
        if len(sums) == 1:
            return self.langs[0], 1.0, 1.0
        best = int(np.argmin(sums))
        second = min(s for i, s in enumerate(sums) if i != best)
        margin = (second - sums[best]) / second
        return self.langs[best], 1.0 - float(np.exp(-margin / 0.05)), margin


def predict(df: DataFrame, key: str, text: str, raw: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """key, lang_pred, score (0 to 1, rising with the margin), rejected (margin too narrow, or no letter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(raw)
        for batch in batches:
            got = [classify(x.as_buffer().to_pybytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] < margin for g in got], pa.bool_())], names=[key, "lang_pred", "score", "rejected"])

    kind = df.schema[key].dataType.simpleString()
    common.small_batches(df.sparkSession)
    return df.select(F.col(key), plain(F.col(text))).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, rejected boolean")


def keep(df: DataFrame, text: str, raw: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows, all their columns as they were, whose language isn't rejected; all with a letter if none was learned."""
    if not raw:
        return df.filter(F.trim(plain(F.col(text))) != "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_kept()
        classify = Classifier(raw)
        for batch in batches:
            stay = pa.array([classify(x.as_buffer().to_pybytes())[2] >= margin for x in batch.columns[-1]], pa.bool_())
            yield batch.select(range(batch.num_columns - 1)).filter(stay)
            del batch, stay
        del classify
        common.give_back()

    common.small_batches(df.sparkSession)
    last = "_".join(["plain", *df.columns])  # longer than any name there is, so it can't clash
    return df.select("*", plain(F.col(text)).alias(last)).mapInArrow(run, df.schema)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries from the documents that aren't held out; ids only draw the sample."""
    return dictionaries(sample(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))), "doc_id", "text", "lang"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = predict(docs, "doc_id", "text", learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


common.ship(common)
common.ship(sys.modules[__name__])
