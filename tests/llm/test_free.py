"""Operators 2, 4, 5, 6 and 8, and the pipeline, against brute force, round trips and held-out rows."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken

from argentum.llm import op2_language, op4_bpe, op5_ogg, op6_simhash, op8_substrings
from tests.llm.fixtures import documents, frame, prose


def test_language_on_held_out_rows(spark):
    rows = [(i, prose("de" if i % 3 == 0 else "en", 40, 1000 + i), "de" if i % 3 == 0 else "en", "s", None) for i in range(200)]
    docs = frame(spark, rows)
    got = op2_language.predict(docs, "doc_id", "text", op2_language.learn(docs)).collect()
    right = {r[0]: r[2] for r in rows}
    assert sum(r.lang_pred == right[r.doc_id] for r in got) >= 199
    assert all(0 <= r.score <= 1 for r in got)


def test_language_on_odd_rows(spark):
    docs = frame(spark)
    raw = op2_language.learn(docs)
    got = op2_language.predict(docs, "doc_id", "text", raw).collect()
    assert len(got) == len(documents())
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in got if r.doc_id in (200, 201, 202, 203))
    assert op2_language.learn(frame(spark, [])) == {}
    assert {r.lang_pred for r in op2_language.predict(docs, "doc_id", "text", {}).collect()} == {"und"}
    kept = op2_language.keep(docs, "text", raw)
    assert kept.columns == docs.columns and {200, 201} & {r.doc_id for r in kept.collect()} == set()


def test_a_rare_language_takes_nothing_from_the_others(spark):
    rows = [(i, prose("de" if i % 3 == 0 else "en", 40, 1000 + i), "de" if i % 3 == 0 else "en", "s", None) for i in range(200)]
    rare = [(1000 + i, "12 34 !!", "xx", "s", None) for i in range(10)] + [(2000 + i, "Ωμέγα", "el", "s", None) for i in range(10)]
    raw, alone = op2_language.learn(frame(spark, rows + rare)), op2_language.learn(frame(spark, rows))
    assert set(raw) == {"de", "en", "el"} and all(raw[k] == alone[k] for k in alone)
    got = op2_language.predict(frame(spark, rows), "doc_id", "text", raw).collect()
    right = {r[0]: r[2] for r in rows}
    assert sum(r.lang_pred == right[r.doc_id] and not r.rejected for r in got) >= 199


def test_language_by_a_plain_loop(spark):
    import math

    import zstandard

    rows = [(i, prose("de" if i % 3 == 0 else "en", 30 + 60 * i, 50 + i), "de" if i % 3 == 0 else "en", "s", None) for i in range(24)]
    raw = op2_language.learn(frame(spark, rows))
    got = {r.doc_id: r for r in op2_language.predict(frame(spark, rows), "doc_id", "text", raw).collect()}
    for doc_id, text, *_ in rows:
        plain = (" " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " ").encode()
        sizes = {}
        for lang in sorted(raw):
            d = zstandard.ZstdCompressionDict(raw[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=op2_language.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(plain[i : i + op2_language.PIECE])) for i in range(0, len(plain), op2_language.PIECE))
        first, second = sorted(sizes.values())
        assert got[doc_id].lang_pred == min(sizes, key=sizes.get)
        margin = (second - first) / second
        assert math.isclose(got[doc_id].score, 1 - math.exp(-margin / 0.05)) and got[doc_id].rejected == (margin < op2_language.MARGIN)


def test_nothing_learned_keeps_what_has_letters(spark):
    rows = [(i, prose("en", 40, i), None, "s", "x") for i in range(50)] + [(90, "12 34", "en", "s", "x"), (91, None, "en", "s", "x")]
    raw = op2_language.learn(frame(spark, rows))
    assert raw == {}
    assert {r.doc_id for r in op2_language.keep(frame(spark, rows), "text", raw).collect()} == set(range(50))
    one = op2_language.keep(frame(spark, rows), "text", {"en": b" some words of one language "})
    assert {r.doc_id for r in one.collect()} == set(range(50))


def test_the_sample_comes_from_all_of_a_text(spark):
    rows = [(i, "anfang " * 400 + "mitte " * 400 + "ende " * 400, "de", "s", None) for i in range(60)]
    raw = op2_language.learn(frame(spark, rows))["de"]
    assert b"anfang" in raw and b"mitte" in raw and b"ende" in raw


def odd_texts():
    r = random.Random(3)
    pick = lambda: chr(r.choice([r.randrange(32, 127), r.randrange(0x20, 0x3000), 97, 98, 0x1F600]))
    return ["".join(pick() for _ in range(r.randrange(60))) for _ in range(800)] + ["a" * 5000, "ab" * 900, " " * 500, "", "<|endoftext|>", "\x00\x01", "don't we'll"]


def test_bpe_gives_tiktokens_ids_and_round_trips():
    path, pattern = op4_bpe.vocabulary()
    with open(path, "rb") as f:
        ranks = op4_bpe.parse_ranks(f)
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    coder = op4_bpe.Coder(ranks, pattern, kept=100)
    for texts in (odd_texts(), [t or "" for _, t, *_ in documents()]):
        for text, ids in zip(texts, coder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)
            assert coder.decode(ids) == text.encode()


def test_bpe_where_a_merge_makes_a_lower_rank():
    # "abc" has a lower rank than "bc", which comes first; tiktoken then takes it before the next "bc".
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 257, b"abcb": 258, b"ca": 259}
    known = tiktoken.Encoding("x", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 14))) for _ in range(500)]
    for word, ids in zip(words, op4_bpe.replay([w.encode() for w in words], op4_bpe.Merges(ranks)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(word)


def test_bpe_digests(spark):
    got = op4_bpe.digests(frame(spark)).collect()
    texts = {(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in documents()}
    assert len(got) == len(documents()) and {(r.doc_id, r.decoded_sha256) for r in got} == texts
    path, pattern = op4_bpe.vocabulary()
    with open(path, "rb") as f:
        known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=op4_bpe.parse_ranks(f), special_tokens={})
    ids = {(d, (t or "")): np.array(known.encode_ordinary(t or ""), "<u4") for d, t, *_ in documents()}
    want = {(d, len(x), hashlib.sha256(x.tobytes()).hexdigest()) for (d, _), x in ids.items()}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in got} == want
    assert op4_bpe.digests(frame(spark, [])).count() == 0
    assert op4_bpe.tokenised(frame(spark)).count() == len(documents())


def test_bpe_of_many_blocks_and_of_long_words():
    path, pattern = op4_bpe.vocabulary()
    with open(path, "rb") as f:
        ranks = op4_bpe.parse_ranks(f)
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    coder = op4_bpe.Coder(ranks, pattern, kept=10)
    r = random.Random(9)
    long = "".join(r.choice("abcdefghij") for _ in range(100_000))
    texts = [prose("en", 3000, i) for i in range(6)] + [long + " " + long[:500], "x" * 100_001]
    for text, ids in zip(texts, [coder.encode([t])[0] for t in texts], strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)


def slow_checksum(data):
    crc = 0
    for x in data:
        crc ^= x << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_round_trips():
    for size in (0, 1, 575, 576, 577, 5000, 70_000, 300_000):
        payload = op5_ogg.pad(random.Random(size).randbytes(size))
        media = op5_ogg.write_ogg(payload)
        back, streams = op5_ogg.read_ogg(media)
        assert back == payload and len(payload) % 576 == 0 and payload and len(streams) == 2
        assert max(s["last_granule"] for s in streams) == len(payload)
    assert op5_ogg.page_checksum(b"some bytes \xff\x00") == slow_checksum(b"some bytes \xff\x00")


def test_ogg_packets_over_page_borders():
    stream = op5_ogg._Stream(9)
    packets = [b"head", bytes(range(256)) * 600, b"", b"x" * 255, b"y" * 510, b"z" * 65_025]
    pages = b"".join([*stream.put(packets[0], 0), stream.flush(op5_ogg.FIRST), *[p for i, x in enumerate(packets[1:]) for p in stream.put(x, i)], stream.flush(op5_ogg.LAST)])
    assert [p for _, p, _ in op5_ogg.demultiplex(pages)[9]] == packets


def test_ogg_finds_damage():
    media = bytearray(op5_ogg.write_ogg(op5_ogg.pad(b"x" * 9000)))
    for at in range(0, len(media), 97):
        media[at] ^= 1
        with pytest.raises(op5_ogg.OggError):
            op5_ogg.read_ogg(bytes(media))
        media[at] ^= 1
    pages = [i for i in range(len(media)) if media[i : i + 4] == b"OggS"]
    with pytest.raises(op5_ogg.OggError):
        op5_ogg.read_ogg(bytes(media[: pages[4]] + media[pages[5] :]))  # a page is missing
    with pytest.raises(op5_ogg.OggError):
        op5_ogg.read_ogg(bytes(media[: pages[-1]]))  # the end is missing


def foreign(packets, kind, channels, per_page, start=0, extra=0):
    """An Ogg file of one raw PCM stream, paged in its own way."""
    unit = op5_ogg.WIDTHS[kind] * channels
    stream, out, at = op5_ogg._Stream(77), [], start
    head = bytearray(op5_ogg.header(kind, 44_100, channels))
    head[-4:] = extra.to_bytes(4, "big")
    out += [*stream.put(bytes(head), 0), stream.flush(op5_ogg.FIRST), *stream.put(op5_ogg.comment(), 0)]
    for _ in range(extra):
        out += stream.put(b"further header", 0)
    out.append(stream.flush())
    for n, p in enumerate(packets):
        at += len(p) // unit
        out += stream.put(p, at)
        if n % per_page == per_page - 1:
            out.append(stream.flush())
    return b"".join(out + [stream.flush(op5_ogg.LAST)])


@pytest.mark.parametrize("kind,channels,per_page,start,extra", [(1, 1, 1, 0, 0), (1, 1, 5, 0, 0), (2, 2, 3, 0, 1), (5, 1, 2, 960, 0), (35, 6, 4, 0, 2)])
def test_ogg_of_other_writers(kind, channels, per_page, start, extra):
    r = random.Random(kind)
    unit = op5_ogg.WIDTHS[kind] * channels
    packets = [r.randbytes(unit * r.choice([1, 7, 300, 30_000])) for _ in range(23)]
    back, (known,) = op5_ogg.read_ogg(foreign(packets, kind, channels, per_page, start, extra))
    assert back == b"".join(packets)
    assert (known["packets"], known["channels"], known["samples"], known["last_granule"]) == (23, channels, len(back) // unit, start + len(back) // unit)


def test_ogg_streams_that_overlap_are_read_but_not_merged():
    one, two = foreign([b"a" * 100] * 4, 1, 1, 2), foreign([b"b" * 100] * 4, 1, 1, 2)
    renamed = b""
    for _, number, flags, granule, lacing, body in list(op5_ogg.read_pages(two)):
        size = sum(lacing)
        renamed += op5_ogg._page(78, number, flags, granule, lacing, two[body : body + size])
    assert [b"".join(p for _, _, p in s["audio"]) for s in op5_ogg.read_streams(one + renamed)] == [b"a" * 400, b"b" * 400]
    with pytest.raises(op5_ogg.OggError):
        op5_ogg.read_ogg(one + renamed)


def test_ogg_query_rows(spark):
    got = frame(spark).select("doc_id", "text").mapInArrow(op5_ogg._digests, op5_ogg.SCHEMA).collect()
    assert sorted((r.n_bytes, r.payload_sha256) for r in got) == sorted((len((t or "").encode()), hashlib.sha256(op5_ogg.pad((t or "").encode())).hexdigest()) for _, t, *_ in documents())
    import zlib

    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.payload_sha256), r)
    for d, t, *_ in documents():
        payload = op5_ogg.pad((t or "").encode())
        media = op5_ogg.write_ogg(payload)
        r = by[d, hashlib.sha256(payload).hexdigest()]
        assert (r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(payload), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
        x = np.frombuffer(payload, np.uint8).astype(int)
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:]))
        assert r.feature == f"streams=2;packets={len(payload) // 576};samples={len(x)};end_s={len(x) / 8000:.4f};mean={x.mean():.4f};rms={(x * x).mean() ** 0.5:.4f};crossings={crossings};peak={x.max()}"
    assert frame(spark, []).select("doc_id", "text").mapInArrow(op5_ogg._digests, op5_ogg.SCHEMA).count() == 0
    media = {(r.doc_id, bytes(r.media)) for r in op5_ogg.to_ogg(frame(spark), "doc_id", "text").collect()}
    assert len(media) == len({(d, t or "") for d, t, *_ in documents()})


def slow_fingerprint(text, shingle=4):
    import xxhash

    w = text.lower().split() if text else []
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs, linked):
    """[(id, value)] -> smallest id by value, by union of all linked pairs."""
    values = list({v for _, v in pairs})
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if linked(a, b):
                parent[find(a)] = find(b)
    least = {}
    for d, v in pairs:
        if d is not None:
            least[find(v)] = min(least.get(find(v), d), d)
    return {v: least.get(find(v)) for v in values}


def test_simhash_by_brute_force(spark):
    rows = documents() + [(400 + i, prose("en", 300, 77) + f" tail{i}", "en", "s", None) for i in range(40)]
    want = slow_components([(d, slow_fingerprint((t or "").encode())) for d, t, *_ in rows], lambda a, b: (a ^ b).bit_count() <= 4)
    got = op6_simhash.near_duplicates(frame(spark, rows), "doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[r.fp & (1 << 64) - 1]
    assert op6_simhash.near_duplicates(frame(spark, []), "doc_id", "text").count() == 0
    kept = op6_simhash.keep_first(frame(spark, rows), "doc_id", "text")
    assert kept.count() == len({c for c in want.values()}) and kept.columns == frame(spark).columns


@pytest.mark.parametrize("hot_list", [50_000, 40])
def test_links_of_chains_and_families(spark, hot_list):
    """Chains of four-bit steps, a family around one centre, and strangers: the same components as all pairs give."""
    r = random.Random(5)
    values = set()
    x = r.getrandbits(64)
    for _ in range(60):
        values.add(x)
        for b in r.sample(range(64), 4):
            x ^= 1 << b
    centre = r.getrandbits(64)
    for _ in range(150):
        values.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    values |= {r.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1}
    signed = [int(v) for v in np.array(sorted(values), np.uint64).view(np.int64)]
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = {r.node: r.root for r in op6_simhash.components(op6_simhash.links(fps, hot_list)).collect()}
    want = slow_components([(v, v & (1 << 64) - 1) for v in signed], lambda a, b: (a ^ b).bit_count() <= 4)
    assert {v: found.get(v, v) for v in signed} == {v: want[v & (1 << 64) - 1] for v in signed}


def five_word_sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}


@pytest.mark.parametrize("long_list", [64, 3])
def test_near_copies_by_shingles_by_brute_force(spark, monkeypatch, long_list):
    from argentum.llm import alike

    monkeypatch.setattr(alike, "LONG_LIST", long_list)
    r = random.Random(8)
    rows, passage = [], prose("en", 30, 5)
    for f in range(12):
        base = prose("en", r.randint(60, 200), 3000 + f).split()
        for i in range(8):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = f"new{r.random()}"
            rows.append((100 * f + i, " ".join(w) + (" " + passage if f % 2 else ""), "en", "s", 1))
    rows += [(5000 + i, t, "en", "s", 1) for i, t in enumerate(["", " ", "a b", "A  b", "c"])]

    def near(x, y):
        a, b = five_word_sets(x), five_word_sets(y)
        return a == b or 5 * len(a & b) >= 4 * len(a | b) or (slow_fingerprint(x.encode()) ^ slow_fingerprint(y.encode())).bit_count() <= 4

    want = set(slow_components([(d, t) for d, t, *_ in rows], near).values())
    assert len(want) < len(set(slow_components([(d, slow_fingerprint(t.encode())) for d, t, *_ in rows], lambda x, y: (x ^ y).bit_count() <= 4).values()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    assert {x.doc_id for x in op6_simhash.keep_first_alike(docs, "doc_id", "text").collect()} == want


def test_triples_meet_every_four_positions():
    from itertools import combinations

    t = op6_simhash.triples()
    assert len(t) == 20 and all(any(set(x) <= set(q) for x in t) for q in combinations(range(8), 4))


def slow_removal(rows, window=20):
    docs = sorted({(-(1 << 63) if d is None else d, t or "") for d, t, *_ in rows})
    first = {}
    for d, t in docs:
        w = t.encode().split()
        for i in range(len(w) - window + 1):
            first[tuple(w[i : i + window])] = min(first.get(tuple(w[i : i + window]), (d, i)), (d, i))
    out = {}
    for d, t in docs:
        w = t.encode().split()
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < (d, i) for j in range(i, i + window)}
        out[d, t] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("window,base", [(20, 5), (8, 8), (4, 1)])
def test_substrings_by_brute_force(spark, window, base):
    # one row for each id, as the result names rows by id
    rows = list({d: (d, t, *x) for d, t, *x in documents()}.values())
    want = {d: v for (d, _), v in slow_removal(rows, window).items()}
    got = op8_substrings.remove_repeats(frame(spark, rows).repartition(5), "doc_id", "text", window, base, texts=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, bytes(r.kept)) == want[-(1 << 63) if r.doc_id is None else r.doc_id]


def test_substrings_repeated_rows_and_no_rows(spark):
    text = prose("en", 60, 4)
    got = op8_substrings.remove_repeats(frame(spark, [(5, text, None, None, None), (5, text, None, None, None), (6, text, None, None, None)]), "doc_id", "text").collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(5, 0), (5, 0), (6, 60)]
    assert op8_substrings.remove_repeats(frame(spark, []), "doc_id", "text").count() == 0


def test_word_hashes_depend_on_words_only(monkeypatch):
    monkeypatch.setattr(op8_substrings, "BLOCK", 64)

    def hashes(texts, secret=b"k"):
        counts, codes, digests = op8_substrings.encoded(texts, secret)
        return np.frombuffer(digests, "<u8").reshape(-1, 2)[codes], counts

    words = [b"a", b"bb", "wörter".encode(), b"x" * 63, b"y" * 65, b"z" * 1000, b"\x00", b"a\x00"]
    alone = [hashes([w])[0][0].tolist() for w in words]
    together, counts = hashes([b" \n" + b"\t ".join(words * 3) + b" ", b"", b" ", b"a"])
    assert together.tolist() == alone * 3 + alone[:1] and counts == [24, 0, 0, 1]
    assert len({h for pair in alone for h in pair}) == 2 * len(words)
    assert hashes([b"a"], b"other")[0].tolist() != alone[:1]
    assert hashes([])[0].shape == (0, 2) and hashes([b"", b" "])[1] == [0, 0]


def thue_morse(n, flip):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_polynomial_hashes_mix_up(spark, n):
    same = " ".join(f"w{i}" for i in range(19))
    rows = [(i, f"{same} {thue_morse(n, i)}", None, None, None) for i in (0, 1)]
    got = op8_substrings.remove_repeats(frame(spark, rows), "doc_id", "text").collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_buckets_are_sparks(spark):
    keys = [0, 1, -5, 2**40 + 7, (3 << 32) + 11]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k bigint").selectExpr("pmod(hash(k), 13)").collect()]
    assert op8_substrings.spark_bucket(np.array(keys), 13).tolist() == got


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_native import cleaned

    docs = spark.createDataFrame([(d, t, x, s, len(t) if t else None) for d, t, x, s, _ in documents()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append((before, after))
        before = after
    (a, b), (_, c), (_, d), (_, e), (_, f) = kept
    assert all(x.columns == corpus_pipeline.COLUMNS for x in (b, c, d, e))
    ids = {r.doc_id for r in b.collect()}
    assert not ids & {200, 201, 202, 203} and set(range(3, 60)) <= ids
    want = cleaned([(r.doc_id, r.text) for r in b.collect()])
    assert sorted(r.text for r in c.collect()) == sorted(want[-(1 << 63) if r.doc_id is None else r.doc_id, r.text] for r in b.collect())
    groups = slow_components([(r.doc_id, slow_fingerprint(r.text.encode())) for r in c.collect()], lambda x, y: (x ^ y).bit_count() <= 4)
    assert {r.doc_id for r in d.collect()} == set(groups.values())
    assert {r.doc_id for r in e.collect()} <= {r.doc_id for r in d.collect()}
    assert f.count() == e.count() and all(hashlib.sha256(r.text.encode()).hexdigest() == r.decoded_sha256 for r in f.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == f.count()


def test_stages_keep_columns_of_any_name(spark):
    from argentum.llm import op9_lines, op10_mixing

    odd = "_row _all _t _doc _text _d _gone longest _lines _plain fp ids n_lines size _key list node root".split()
    docs = frame(spark).drop("kept").selectExpr("*", *[f"'{c}' AS `{c}`" for c in odd])
    raw = op2_language.learn(docs)
    for out, names in (
        (op2_language.keep(docs, "text", raw), docs.columns),
        (op9_lines.remove_repeated_lines(docs, "doc_id", "text"), [c for c in docs.columns if c != "n_lines"] + op9_lines.COUNTS),
        (op6_simhash.keep_first(docs, "doc_id", "text"), docs.columns),
        (op10_mixing.repeat(docs), docs.columns),
        (op4_bpe.tokenised(docs), [c for c in docs.columns if c != "ids"] + ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]),
    ):
        rows = out.collect()
        assert out.columns == names and rows
        assert all(r[c] == c for r in rows for c in odd if c not in ("ids", "n_lines"))
