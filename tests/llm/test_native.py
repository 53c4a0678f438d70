"""Operators 1, 3, 7, 9 and 10 against brute force and on the cases that their docstrings define."""

import math
import re

import pytest

from argentum.llm import common, op1_outliers, op3_urls, op7_licenses, op9_lines, op10_mixing
from tests.llm.fixtures import SCHEMA, documents, frame

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def test_counts_by_brute_force(spark):
    got = {(r.doc_id, r.text): r for r in op1_outliers.counts(frame(spark).select("doc_id", "text"), "text").collect()}
    for doc_id, text, *_ in documents():
        w = words(text)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)} if len(w) < 1500 else set(range(len(w)))
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = got[doc_id, text]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))


def test_outliers_are_rejected_and_prose_stays(spark):
    rows = [(i, "plain words in a row that say little more " * 1 + " ".join(f"w{i}x{j}" for j in range(60 + i % 40)), "en", "s", None) for i in range(300)]
    rows += [(1000 + i, " ".join(f"v{i}x{j}###" for j in range(80)), "en", "s", None) for i in range(12)]
    kept = {r.doc_id: r.kept for r in op1_outliers.judge(frame(spark, rows), "doc_id", "text", ["lang", "source"]).collect()}
    assert not any(kept[1000 + i] for i in range(12))
    assert sum(kept[i] for i in range(300)) >= 297


def test_outliers_in_groups_of_any_size(spark):
    text = lambda i: " ".join(f"w{i}x{j}" + ("\n" if j % 10 == 9 else "") for j in range(60 + i % 40))
    junk = lambda i: " ".join(f"v{i}x{j}###" for j in range(80))
    lines = "\n".join(["all of this line is said over"] * 5 + [" ".join(f"n{k}x{j}" for j in range(30)) for k in range(3)])
    rows = [(i, text(i), "en", f"s{i % 3}", None) for i in range(240)] + [(300 + i, text(i), None, None, None) for i in range(3)]
    rows += [(400, junk(0), "xx", "s0", None), (401, junk(1), None, None, None), (402, junk(2), "en", "alone", None), (403, text(7), "yy", "z", None)]
    rows += [(500, text(1), "en", "s0", None), (500, text(1), "en", "s0", None), (600, "\n".join(["one line"] * 19 + ["x"] + [text(3)]), "en", "s1", None), (601, lines, "en", "s1", None)]
    got = op1_outliers.judge(frame(spark, rows), "doc_id", "text", ["lang", "source"]).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows) and {d for d, k in kept.items() if not k} == {400, 401, 402, 600, 601}  # 601 by repeats and lines together
    assert all(r.distance is not None for r in got if not r.base_failed)


def test_outliers_on_odd_rows_and_no_rows(spark):
    got = op1_outliers.judge(frame(spark), "doc_id", "text", ["lang", "source"]).collect()
    assert len(got) == len(documents())
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (200, 201, 202, 203))
    assert op1_outliers.judge(frame(spark, []), "doc_id", "text", ["lang", "source"]).count() == 0


URLS = [
    ("http://A.com/x", "a.com", "/x", "com/", "allow"),
    ("https://www.example.com/en/1?q", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://m.example.com/en/1#f", "m.example.com", "/en/1", "example.com/en/", "block"),
    ("http://a.net/es/3", "a.net", "/es/3", "net/es/", "block"),
    ("http://a.net/es", "a.net", "/es", None, None),
    ("http://a.com", "a.com", "", None, "allow"),
    ("http://a.com?x://y/z", "a.com", "", None, "allow"),
    ("nothing", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://notcom/x", "notcom", "/x", None, "allow"),
    ("://COM/", "com", "/", "com/", "allow"),
]


def test_url_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    got = {r.page_id: r for r in op3_urls.judge(df, "page_id", "url").collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert verdict is None or got[i].verdict == verdict
    assert op3_urls.judge(df.limit(0), "page_id", "url").count() == 0


def test_templates_reject_by_purity_only_where_labels_say_so(spark):
    rules = [("x.net/bad/", False), ("x.net/good/", True)]
    urls = [f"http://x.net/bad/{i}" for i in range(40)] + [f"http://x.net/good/{i}" for i in range(40)] + [f"http://x.net/new/{i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r for r in op3_urls.judge(df, "page_id", "url", rules).collect()}
    assert got[0].template != got[40].template and got[0].purity < 0.5 < got[40].purity
    assert all(got[i].verdict == "allow" for i in range(80, 120))


def test_branches_without_labels_go_where_all_that_is_known_is_bad(spark):
    rules = [("x.net/bad/", False), ("y.net/good/", True), ("y.net/bad/", False)]
    urls = [f"http://x.net/bad/{i}" for i in range(40)] + [f"http://x.net/new/{i}" for i in range(10)] + ["http://x.net/" + "/".join("abcdefghijklmnop")] * 3
    urls += [f"http://y.net/{k}/{i}" for k in ("bad", "good", "new") for i in range(20)]
    df = spark.createDataFrame([*enumerate(urls), (None, urls[0]), (None, urls[0]), (7, urls[7])], "page_id bigint, url string")
    got = op3_urls.judge(df, "page_id", "url", rules).collect()
    verdict = {r.page_id: r.verdict for r in got}
    assert len(got) == len(urls) + 3 and sum(r.page_id is None for r in got) == 2
    assert all(verdict[i] == "block" and next(r.rule for r in got if r.page_id == i) is None for i in range(40, 50))
    assert [r.template for r in got if r.page_id == 50] == ["/" + "/".join("abcdefghijklmnop")]
    assert all(verdict[i] == "allow" for i in range(73, 113))


def test_alike_branches_are_merged(spark):
    rows = [("h", "", seg, n, lab, good, 0.7) for seg, n, lab, good in [("a", 50, 40, 2), ("b", 50, 40, 3), ("c", 50, 40, 30), ("d", 50, 40, 33), ("e", 50, 40, 40)]]
    told = spark.createDataFrame(rows, "host string, template string, segment string, n long, n_labelled long, n_good long, purity double")
    got = {r.segment: r._name for r in op3_urls.merged(told).collect()}
    # neighbours by purity: 0.05, 0.075 | 0.75, 0.825 | 1.0
    assert got == {"a": "a|b", "b": "a|b", "c": "c|d", "d": "c|d", "e": "e"}


def test_licenses_by_brute_force(spark):
    def grams(text):
        w = re.sub(r"[^\w]+|_", " ", text.lower()).strip().split(" ")
        return set(zip(w, w[1:]))

    texts = ["Released under the MIT license", "x\nLicensed under the Apache License, version 2.0!\ny", "nothing to see here at all", "", None, "MIT", "word " * 5000, "This work is licensed under the GNU General Public License, version 3."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in op7_licenses.scan(df, "doc_id", "text").collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        parts = (text or "").split("\n") + ([text] if text and "\n" in text else [])
        best = max(((2 * len(grams(p) & grams(t)) / (len(grams(p)) + len(grams(t))), n) for p in parts for n, t in op7_licenses.TEMPLATES if grams(p)), default=(0, ""), key=lambda x: x[0])
        if best[0] >= op7_licenses.LIMIT:
            assert math.isclose(got[i].dice, best[0]) and got[i].license == best[1]
        else:
            assert got[i].license is None and got[i].n_hits == 0
    assert op7_licenses.scan(df.limit(0), "doc_id", "text").count() == 0


def slow_fits(text, limit=0.8):
    """Licences in a text: every template laid over it where one of its anchors meets, the best of overlapping fits."""
    w = re.findall(r"[^\W_]+", (text or "").lower())
    b = list(zip(w, w[1:]))
    fits = set()
    for k, (name, of) in enumerate(sorted((n, op7_licenses.template_bigrams(t)) for n, t in op7_licenses.TEMPLATES)):
        for s in {i - j for i, x in enumerate(b) for j, y in enumerate(of) if x == y and x in op7_licenses.anchors(of)}:
            win = set(b[max(s, 0) : s + len(of)])
            dice = 2 * len(win & set(of)) / (len(win) + len(set(of)))
            if dice >= limit:
                fits.add((-len(win & set(of)), -dice, name, s, s + len(of), k))
    beaten = lambda x, by: any(o[3] < x[4] and x[3] < o[4] and o < x for o in by)
    lone = [x for x in fits if not beaten(x, [o for o in fits if o[5] == x[5]])]
    return sorted(x for x in lone if not beaten(x, lone))


def test_licenses_in_lines_and_over_lines(spark):
    import textwrap

    full = {n: max((t for m, t in op7_licenses.TEMPLATES if m == n), key=len) for n, _ in op7_licenses.TEMPLATES}
    texts = [f"Copyright (c) 2020 Somebody\n\n{textwrap.fill(t, 72)}\n" for t in full.values()]
    inside = "Some notes. This work is licensed under the GNU General Public License, version 3. See the file COPYING for details of what it means."
    texts += [inside, inside.replace("GNU General", "GNU Lesser General"), "x " * 3000 + full["mit"].replace("sell copies", "sell") + " y" * 3000, textwrap.fill(full["isc"], 40) + "\n" + full["zlib"]]
    texts += ["to deal in the software without", "the terms of the gnu general public", "all rights", "All rights reserved. " * 50, None, "", "mit", full["apache-2.0"][:200]]
    rows = [*enumerate(texts), (None, inside), (0, texts[0])]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id bigint, text string, _w string")
    got = op7_licenses.scan(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    first = {r.doc_id: r for r in got}
    for d, t in rows:
        want = slow_fits(t)
        r = first[d]
        assert (r.n_hits, r.license, r.licenses) == (len(want), want[0][2] if want else None, ",".join(sorted({x[2] for x in want})))
        assert math.isclose(r.dice, -want[0][1] if want else 0.0)
    assert [first[i].license for i in range(len(full))] == list(full) and first[len(full)].restricted
    assert first[len(full) + 1].license == "lgpl-3.0" and first[len(full) + 2].license == "mit" and first[len(full) + 3].licenses == "isc,zlib"
    assert first[len(full) + 7].n_hits == 50


def cleaned(rows, min_run=2):
    """Line dedup by brute force: (doc_id, text) -> text."""
    docs = sorted({(-(1 << 63) if d is None else d, t) for d, t, *_ in rows if t is not None}, key=lambda x: x[0])
    first = {}
    for d, t in docs:
        s = [x for x in t.split("\n") if words(x)]
        for p in range(len(s) - min_run + 1):
            first.setdefault(tuple(s[p : p + min_run]), (d, p))
    out = {}
    for d, t in docs:
        lines = t.split("\n")
        at = [i for i, x in enumerate(lines) if words(x)]
        gone = {at[p + k] for p in range(len(at) - min_run + 1) if first[tuple(lines[at[p + k]] for k in range(min_run))] < (d, p) for k in range(min_run)}
        out[d, t] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize("min_run", [1, 2, 4])
def test_line_dedup_by_brute_force(spark, min_run):
    want = cleaned(documents(), min_run)
    df = frame(spark).withColumnRenamed("kept", "_gone")
    keyed = df.selectExpr("*", "text AS before")
    got = op9_lines.remove_repeated_lines(keyed.drop("_gone"), "doc_id", "text", min_run).collect()
    assert len(got) == len(documents())
    for r in got:
        assert r.text == (None if r.before is None else want[-(1 << 63) if r.doc_id is None else r.doc_id, r.before])


def test_maximal_runs(spark):
    rows = [(1, "a x\nb x\nc x\nd x", "en", "s", None), (2, "q\na x\nb x\nc x\nz", "en", "s", None), (3, "b x\nc x\nd x\nq\na x", "en", "s", None)]
    levels = op9_lines.doubling(op9_lines.line_ids(frame(spark, rows), "doc_id", "text"))
    assert [lv.count() for lv in levels] == [13, 9]
    runs = {(r._doc, r.pos, r.lines, r.first._doc, r.first.pos) for r in op9_lines.repeated_runs(levels).collect()}
    # the run that begins with "q" was first in document 2, and goes on another way there than in document 1
    assert runs == {(2, 1, 3, 1, 0), (3, 0, 3, 1, 1), (3, 3, 2, 2, 0)}
    assert op9_lines.doubling(op9_lines.line_ids(frame(spark, []), "doc_id", "text")) == []
    assert op9_lines.remove_repeated_lines(frame(spark, []), "doc_id", "text").count() == 0


def test_single_lines_in_the_pipeline(spark):
    import corpus_pipeline

    long = " ".join(f"word{i}" for i in range(20))
    short = " ".join(f"word{i}" for i in range(19))
    rows = [(1, f"a\n{long}\nb\n{short}\nc"), (2, f"d\n{long}\ne\n{short}\nf"), (3, f"\n{short}"), (4, "only"), (5, "only"), (6, f"only\n\n{long}\n{long}"), (7, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, "").collect()}
    want = {1: rows[0][1], 2: f"d\ne\n{short}\nf", 3: "", 4: "only", 5: "", 6: "only\n", 7: None}
    assert got == {d: (t, len(t or "")) for d, t in want.items()}


def level(sizes, weights, share=1.5, most=2.0):
    """Targets by sharing out the excess again and again."""
    total = share * sum(sizes)
    target = [0.0] * len(sizes)
    full = set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        target = [most * sizes[i] if i in full else left * weights[i] / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if target[i] > most * sizes[i] + 1e-9} - full
        if not over:
            return target
        full |= over


def test_mixing_targets_and_takes(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), "en", [None, "a", "b", "c", "d", "z"][i % 6 if i % 5 else 1], None) for i in range(600)] + [(900, None, None, "empty", None)]
    got = op10_mixing.mixed(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
    order = sorted((s for s in by if s is not None)) + [None]
    sizes = [sum(r.size for r in by[s]) for s in order]
    for s, want, size in zip(order, level(sizes, [[3, 1, 2][i % 3] for i in range(len(order))]), sizes):
        assert all(r.source_size == size and math.isclose(r.target, want, abs_tol=1e-6) for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - want) <= max(r.size for r in by[s])
    again = op10_mixing.mixed(frame(spark, rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_heavier_documents_are_drawn_more_often(spark):
    # of three equal sources the second has a target of 5/6 of its size
    rows = [(i + 10_000 * k, "w " * 10, "en", source, None) for k, source in enumerate("tsu") for i in range(3000)]
    rows = [(d, t, x, {"t": "b", "s": "a", "u": "c"}[s], k) for d, t, x, s, k in rows]
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)] + [(4, None), (0, 1)], "doc_id bigint, quality int")
    got = op10_mixing.mixed(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    taken = {q: sum(r.copies for r in got if r.source == "b" and r.doc_id % 2 == q) / 1500 for q in (0, 1)}
    # weights 1.0 and 0.1: nearly all of the good ones come before the last of the bad ones
    assert taken[1] > 0.98 and 0.6 < taken[0] < 0.72


def test_mixing_odd_tables(spark):
    assert op10_mixing.mixed(frame(spark, [])).count() == 0
    assert op10_mixing.mixed(frame(spark)).count() == len(documents())
    copies = op10_mixing.repeat(frame(spark))
    assert copies.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    want = {r.doc_id: r.copies for r in op10_mixing.mixed(frame(spark).dropDuplicates()).collect()}
    counted = {r.doc_id: r.n for r in copies.dropDuplicates().join(copies.groupBy("doc_id").count().withColumnRenamed("count", "n"), "doc_id").collect()}
    assert all(counted.get(d, 0) == n for d, n in want.items() if d not in (None, 101))


def test_words_split_at_ascii_space_only(spark):
    df = spark.createDataFrame([("a\u00a0b c\x0bd\x1fe",), (None,), ("  ",)], "t string")
    assert [r[0] for r in df.select(common.words(df.t)).collect()] == [["a\u00a0b", "c", "d\x1fe"], [], []]
