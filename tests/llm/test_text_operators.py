"""Decontamination, licenses, quality rules, HTML and WARC."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopix.llm import decontaminate, dom, html_extract, licenses, quality_rules, warc
from chronopix.llm.queries import ORACLE_SQL, op2_html, op6_decontamination, op8_licenses, op9_quality_rules, op10_warc


# -- decontamination
def brute_tiles(a, b, least):
    """Greedy string tiling by its definition: (length, place in a, place in b)."""
    ma, mb, out = set(), set(), []
    while True:
        top, best = least - 1, None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in ma and j + k not in mb:
                    k += 1
                if k > top:
                    top, best = k, (k, i, j)
        if not best:
            return out
        out.append(best)
        ma.update(range(best[1], best[1] + best[0]))
        mb.update(range(best[2], best[2] + best[0]))


def tiles_of(item, doc, least):
    a, b = (decontaminate.seeds(decontaminate.word_hashes(x), least) for x in (item, doc))
    return decontaminate.tile(a, b, np.arange(len(b)), least)


def test_tiling_is_the_definition():
    r = np.random.default_rng(8)
    for _ in range(150):
        item = [f"w{k}" for k in r.integers(0, r.integers(1, 7), r.integers(3, 25))]
        doc = [f"w{k}" for k in r.integers(0, r.integers(1, 8), r.integers(0, 60))]
        if r.random() < 0.5:
            doc[5:5] = item[10:] + item[:10]
        assert tiles_of(item, doc, 3) == brute_tiles(item, doc, 3)


def test_running_hashes_are_those_of_each_run():
    ids = np.random.default_rng(1).integers(0, 2**63, 40, np.uint64)
    for size in (1, 2, 3, 5, 8, 13, 40, 41):
        expected = []
        for i in range(len(ids) - size + 1):
            h = 0
            for v in ids[i : i + size].tolist():
                h = (h * int(decontaminate._BASE) + v + 1) % 2**64
            expected.append(h)
        assert decontaminate.running_hashes(ids, size).tolist() == expected


def test_one_word_over_and_over_is_tiled_at_once():
    import time

    start = time.perf_counter()
    assert tiles_of(["a"] * 300, ["a"] * 200_000, 5) == [(300, 0, 0)]
    assert sum(t[0] for t in tiles_of((["a"] * 30 + ["b"]) * 10, (["a"] * 29 + ["c"]) * 4000, 5)) == 290
    assert time.perf_counter() - start < 10


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_reordered_passages_count_and_others_do_not(spark):
    words = ITEM.split()
    docs = [(1, ITEM.upper()), (2, " ".join(words[10:]) + " filler words " + " ".join(words[:10])), (3, " ".join(words[:6])), (4, " ".join(reversed(words))), (5, None), (6, ""), (7, "x " * 50_000 + ITEM + " y" * 50_000), (7, ITEM)]
    bench = [(1, ITEM), (2, None), (3, "Too, short"), (4, ITEM), (5, "nowhere at all")]
    d, b = spark.createDataFrame([*docs, (8, "this one is too short?"), (9, "too much, short")], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((r["id"], r["item"]) for r in decontaminate.matches(d, b).collect())
    assert got == sorted([(k, i) for k in (1, 2, 7, 7) for i in (1, 4)] + [(8, 3)])
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(d, b).collect()) == [3, 4, 5, 6, 9]
    assert decontaminate.matches(d, b.limit(0)).count() == 0 and decontaminate.matches(d.limit(0), b).count() == 0


def brute_matches(docs, items, least=5, coverage=0.5):
    """Tiling of every document with every item, by the definition; whole runs for short items."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = []
    for key, text in docs:
        words = split(text)
        for item, own in items:
            own = split(own)
            grams = lambda x, k: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
            k = min(least, len(own))
            if not own or not grams(own, k) & grams(words, k):
                continue
            tiles = brute_tiles(own, words, k)
            share = sum(t[0] for t in tiles) / len(own)
            if share >= coverage:
                out.append((key, item, share, len(tiles), tiles[0][0]))
    return sorted(out)


def test_matches_equal_brute_force(spark):
    r = np.random.default_rng(12)
    words = [f"v{k}" for k in range(40)]
    text = lambda n: [words[k] for k in r.integers(0, 40, n)]
    shared = text(7)  # a phrase of very many items and documents
    items = [(k, " ".join((shared if k % 2 else []) + text(int(r.integers(1, 30))))) for k in range(25)]
    docs = []
    for k in range(120):
        body = text(int(r.integers(0, 50)))
        for _ in range(int(r.integers(0, 3))):
            own = items[int(r.integers(0, 25))][1].split()
            cut = int(r.integers(0, len(own)))
            body[3:3] = own[cut:] + text(2) + own[:cut]
        docs.append((k, " ".join(body + (shared if k % 3 else []))))
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x["id"], x["item"], x["coverage"], x["tiles"], x["longest"]) for x in decontaminate.matches(d, b).collect())
    assert got == brute_matches(docs, items) and len(got) > 50


def test_reordered_items_in_real_documents_are_all_found(spark, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 400").limit(len(items)).collect()]
    docs = []
    for (key, item), text in zip(items, texts, strict=False):
        own, at = item.split(), len(item.split()) // 2
        docs.append((key, f"{text[:200]} {' '.join(own[at:])} {text[200:400]} {' '.join(own[:at])} {text[400:]}"))
    got = {(r["id"], r["item"]) for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {(k, k) for k, _ in docs} <= got


def test_decontamination_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((r["doc_id"], r["item_id"], r["coverage"], r["tiles"], r["longest"]) for r in op6_decontamination(spark, sf).collect())
    assert got == brute_matches(docs, items) and got


def test_decontamination_odd_rows(odd, empty, spark):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog"), (2, None), (3, "?")], "item_id long, text string")
    assert decontaminate.matches(odd, bench).count() == 4
    kept = decontaminate.keep_clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 9 and decontaminate.keep_clean(empty, bench).count() == 0


# -- licenses
def brute_license(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_query_equals_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op8_licenses(spark, sf).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(texts[r["doc_id"]])
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""}


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0 (the License)", {"apache-2.0"}),
        ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0-or-later"}),
        ("released under CC BY-SA 4.0 International", {"cc-by-sa-4.0"}),
        ("https://creativecommons.org/licenses/by-nc-nd/3.0/", {"cc-by-nc-nd-3.0"}),
        ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
        ("the MIT License", {"mit"}),
        ("BSD 3-Clause License", {"bsd-3-clause"}),
        ("Mozilla Public License 2.0 and the MIT licence", {"mpl-2.0", "mit"}),
        ("no license here at all", set()),
    ],
)
def test_license_rules(text, labels):
    assert {d[2] for d in licenses.Scanner().scan(text).detections} == labels


def test_license_rules_are_many_and_gated():
    rules = licenses.rules()
    assert len(rules) > 300
    scan = licenses.Scanner().scan("cc by " * 3000 + "ACC BY")
    assert len(scan.base) == 3000 and scan.n_words == 6002


def spellings(parsed):
    """Texts that a parsed expression matches: every branch, and each optional part both in and out."""
    out = [""]
    for op, value in parsed:
        kind = str(op)
        if kind == "LITERAL":
            own = [chr(value)]
        elif kind == "IN":
            own = [chr(v if str(o) == "LITERAL" else v[0]) for o, v in value]
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            own = spellings(value[2]) + ([""] if value[0] == 0 else [])
        elif kind in ("SUBPATTERN", "BRANCH"):
            own = [t for part in (value[1] if kind == "BRANCH" else [value[-1]]) for t in spellings(part)]
        else:
            own = {"ANY": ["x"], "ASSERT": [""]}[kind]
        out = [a + b for a in out for b in own]
    return out


def test_license_keywords_hide_no_match():
    from re import _parser

    scanner = licenses.Scanner()
    for k, rule in enumerate(scanner.rules):
        for text in spellings(_parser.parse(rule.pattern.pattern)):
            line = f" {text} "
            assert rule.pattern.search(line) and any(k in own for _, own in scanner.gate.iter(line)), (rule.label, text)


@pytest.mark.parametrize(
    "text, label",
    [
        ("For noncommercial use only.", "non-commercial"), ("SPDX-License-Identifier: PSF-2.0", "python-2.0"),
        ("To the extent possible under law, Jane Roe has waived all copyright and related or neighboring rights.", "cc0-1.0"),
        ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed", "wtfpl"),
        ("Except as contained in this notice, the name of a copyright holder shall not be used in advertising", "curl"),
    ],
)
def test_license_spellings_without_the_name(text, label):
    assert {d[2] for d in licenses.Scanner().scan(text).detections} == {label}


def test_license_places_in_linear_time():
    import time

    start = time.perf_counter()
    got = licenses.Scanner().scan("cc by the mit license " * 40_000)
    assert [w for w, _ in got.base[:3]] == [0, 5, 10] and got.base[-1][0] == 199_995 and time.perf_counter() - start < 8
    assert [d[:3] for d in got.detections[:2]] == [(0, 2, "cc-by"), (2, 3, "mit")]


def test_expat_in_brackets_is_mit():
    assert {d[2] for d in licenses.Scanner().scan("The MIT (Expat) License").detections} == {"mit"}


def test_license_odd_rows(odd, empty, odd_rows):
    rows = licenses.scan(odd).collect()
    assert len(rows) == 13 and {r["id"]: r["n_words"] for r in rows}[1] == 0
    assert licenses.scan(empty).count() == 0


# -- quality rules
def brute_signals(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_signals_equal_brute_force(odd, odd_rows):
    got = sorted(tuple(r)[1:4] + tuple(r)[5:7] for r in quality_rules.signals(odd).collect())
    assert got == sorted(brute_signals(r[1]) for r in odd_rows)


def test_most_rejected_is_exact(spark):
    from fractions import Fraction
    from math import comb

    rows = [(n, p, level) for n in (0, 1, 40, 59, 80, 300, 1000) for p in (0.03, 0.05) for level in (0.0025, 0.05)]
    for n, p, level in rows:
        got = spark.range(1).select(quality_rules.most_rejected(F.lit(n), p, level).alias("k")).first()["k"]
        q, total, k = Fraction(p), Fraction(0), -1
        while (total := total + comb(n, k + 1) * q ** (k + 1) * (1 - q) ** (n - k - 1)) <= level:
            k += 1
        assert got == k


def test_cutoffs_equal_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(int(s), int(x), int(g)) for s, n in ((0, 30), (1, 400), (2, 1500)) for x, g in zip(r.integers(0, 900, n), r.random(n) < 0.8, strict=True)]
    got = {x["stratum"]: (x["n"], x["cutoff"]) for x in quality_rules.cutoffs(spark.createDataFrame(rows, "stratum int, score long, good long").repartition(3), 0.05, 0.06).collect()}
    expected = {}
    for s in range(3):
        good, bad = ([x for t, x, g in rows if t == s and g == want] for want in (1, 0))
        k = spark.range(1).select(quality_rules.most_rejected(F.lit(len(good)), 0.05, 0.02).alias("k")).first()["k"]
        fine = [c for c in set(good + bad) if sum(x > c for x in good) <= k]
        if fine:
            c = min(fine)
            expected[s] = (len(good), min((x for x in bad if x > c), default=c + 1) - 1)
    assert got == expected and set(got) == {1, 2}


def test_cutoffs_are_certified_and_reject_junk(spark):
    good = [(k, " ".join(f"w{k}x{j}" for j in range(60)), 1) for k in range(400)]
    junk = [(10_000 + k, " ".join(f"w{k}x{j} $$$$" for j in range(60)), 0) for k in range(50)]
    t = spark.createDataFrame(good + junk, "doc_id long, text string, quality int").repartition(4)
    rows = {r["id"]: r for r in quality_rules.judge(t.select("doc_id", "text"), t.select("doc_id", "quality")).collect()}
    assert all(rows[k]["kept"] for k in range(400)) and not any(rows[10_000 + k]["kept"] for k in range(50))
    assert rows[10_000]["failed"] == ["symbols"]
    few = {r["id"]: r for r in quality_rules.judge(t.select("doc_id", "text"), t.where("doc_id < 20").select("doc_id", "quality")).collect()}
    assert all(r["kept"] for r in few.values())  # twenty documents certify nothing
    copies = t.where("doc_id = 1").select(F.explode(F.sequence(F.lit(1), F.lit(500))).alias("doc_id"), "text").unionByName(t.where("doc_id >= 10000").select("doc_id", "text"))
    again = quality_rules.judge(copies, copies.select("doc_id", (F.col("doc_id") < 10_000).cast("int").alias("quality")))
    assert again.where("not kept").isEmpty()  # nor does one text five hundred times


def test_the_verdict_keeps_its_bound(spark):
    """Drawn many times from known scores, more than alpha of all good documents are over the cutoff at most delta of the time."""
    r, broken, runs = np.random.default_rng(5), 0, 12
    for _ in range(runs):
        rows = [(s, int(x), 1) for s in range(3) for x in r.integers(0, 1000, 300)]
        broken += any(x["cutoff"] is not None and (999 - x["cutoff"]) / 1000 > 0.05 for x in quality_rules.cutoffs(spark.createDataFrame(rows, "stratum int, score long, good long"), 0.05, 0.05).collect())
    assert broken <= 3


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_quality_rules_query_equals_sql(spark, sf, scale):
    sf = sf.replace("sf0.001", scale)
    got = op9_quality_rules(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    expected = con.sql(ORACLE_SQL["op9_quality_rules"]).df().sort_values("doc_id").reset_index(drop=True)
    assert (got[sorted(got)].astype(str) == expected[sorted(expected)].astype(str)).all().all()
    labels = con.sql("SELECT doc_id, quality FROM labels WHERE quality IN (0, 1)").df()
    judged = got[~got.base_failed].merge(labels, on="doc_id")
    assert (~judged[judged.quality == 0].kept).mean() > 0.8 and judged[judged.quality == 1].kept.mean() > 0.95


def test_quality_rules_odd_rows(odd, empty):
    labels = odd.select("doc_id", F.lit(1).alias("quality"))
    assert quality_rules.judge(odd, labels).count() == 13
    assert quality_rules.judge(empty, labels).count() == 0 and quality_rules.judge(odd, labels.limit(0)).count() == 13


# -- HTML
PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="ad">Buy now, cheap things.</div><article><h1>A &amp; B</h1><p>First   paragraph, with <b>bold</b> text<br>and more of it to read here.<p>Second one &copy; follows it, also long enough to be read.</p></article>
<div class="comments"><p>I think that this is wrong, said a reader of the page.</p></div><footer>All rights, contact us.</footer></body>"""


def test_page():
    got = html_extract.blocks_of([PAGE, None, "", "plain", "<p>cut off <a href='x"], html_extract.train())
    assert got[0] == ["A & B", "First paragraph, with bold text and more of it to read here.", "Second one © follows it, also long enough to be read."]
    assert got[1] == got[2] == []


def test_composed_pages_are_read_right():
    forest, hits, n = html_extract.train(), 0, 60
    for k in range(n):
        nodes = dom.parse(html_extract._Page(555_000 + k).build())
        y = html_extract.labels(nodes) > 0
        kept = html_extract.decode(nodes, forest.predict(html_extract.features(nodes)))
        leaf = np.array([bool(x.text) for x in nodes])
        hits += (kept[leaf] == y[leaf]).all()
    assert hits >= 0.9 * n


def test_decoding_is_the_best_consistent_labelling():
    r = np.random.default_rng(6)
    for _ in range(30):
        n = 9
        nodes = [dom.Node("div", -1 if k == 0 else int(r.integers(0, k)), 0) for k in range(n)]
        odds = r.normal(size=n)
        best = 0.0
        for code in range(2**n):
            keep = [code >> k & 1 for k in range(n)]
            if all(not keep[k] or k == 0 or keep[nodes[k].parent] for k in range(n)):
                best = max(best, sum(o for o, k in zip(odds, keep, strict=True) if k))
        got = html_extract.decode(nodes, odds)
        assert odds[got].sum() == pytest.approx(best)
        assert all(not got[k] or k == 0 or got[nodes[k].parent] for k in range(n))


def test_html_query_gives_the_articles(spark, sf):
    import html as h

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op2_html(spark, sf).collect():
        source = pages[r["page_id"]]
        a = source.index("<article>") + 9
        inner = source[a : source.find("</article>") if "</article>" in source else len(source)]
        parts = [" ".join(h.unescape(re.sub(r"<br[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        parts = [re.sub(r"<[^>]*>", "", p).strip() for p in parts]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_formulas_stay_in_the_text():
    texts = [dom.clean(x.text) for x in dom.parse("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be.</p>") if x.text]
    assert " ".join(texts).replace(" ", "") == "Letx=2be."


def test_html_odd_rows(odd, empty):
    assert html_extract.extract(odd, "doc_id", "text").count() == 13
    assert html_extract.extract(empty, "doc_id", "text").count() == 0


def test_dom_survives_broken_markup():
    for bad in ("<", "<<<>>>", "</p></div>", "<p <p>x", "<!-- open", "<script>x", "<a><a><a>x", "<ul><li>a<li>b</ul>c", "<table><td>x<tr><td>y", "<b>" * 3000 + "x", "<div>" * 3000 + "x", "&#xZZ; &amp &#99999999;", "<p class='a>b\">x</p>"):
        dom.parse(bad)
    texts = [dom.clean(x.text) for x in dom.parse("<ul><li>a<li>b</ul>c<p>d<div>e</div>") if x.text]
    assert texts == ["a", "b", "c", "d", "e"]


# -- WARC
def test_record_round_trip():
    source = warc.page_response(1, "http://x/é", "<title>Hi &amp; ho</title><p>Söme <b>text</b></p><a href='/a?b&amp;c'>l</a>")
    back = list(warc.records(source.bytes()))
    assert len(back) == 1 and back[0].block == source.block and back[0].complete and [f for f in back[0].fields if f[0] != "Content-Length"] == source.fields
    meta, text, fits = warc.derive(back[0])
    assert fits and text.block.decode() == "Söme text\nl" and text.get("WARC-Refers-To") == meta.get("WARC-Refers-To") == source.get("WARC-Record-ID")
    body = meta.block.decode()
    assert "title: Hi & ho" in body and "outlink: /a?b&c a/@href" in body and "http-header: Content-Type: text/html; charset=utf-8" in body
    for r in (meta, text):
        again = next(warc.records(r.bytes()))
        assert again.get("WARC-Block-Digest") == warc.digest(again.block) and again.get("WARC-Target-URI") == "http://x/é"
    assert text.get("WARC-Source-Payload-Digest") == source.get("WARC-Payload-Digest")
    assert warc.derive(back[0])[0].bytes() == meta.bytes()


def test_encodings_cut_offs_and_other_types():
    import gzip

    page = gzip.compress("<p>çhünk</p>".encode("latin-1"))
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in (page[:7], page[7:])) + b"0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\nContent-Type: text/html; charset=iso-8859-1\r\nX-Folded: a\r\n b\r\n\r\n" + chunked
    r = warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Payload-Digest", "sha1:WRONG")], block)
    meta, text, fits = warc.derive(r)
    assert text.block.decode() == "çhünk" and fits is False and "http-header: X-Folded: a b" in meta.block.decode()
    assert warc.derive(warc.Record([("WARC-Type", "request")], b"GET /")) is None
    cut = list(warc.records(r.bytes()[:-40]))
    assert len(cut) == 1 and not cut[0].complete and warc.derive(cut[0]) is not None
    assert list(warc.records(b"")) == [] and list(warc.records(b"junk")) == []


def test_files_are_read(spark, tmp_path):
    import gzip

    all_ = [warc.page_response(k, f"http://x/{k}", f"<p>page {k}</p>").bytes() for k in range(5)]
    (tmp_path / "a.warc").write_bytes(b"".join(all_))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, all_)))
    got = warc.derivatives(warc.read_warc(spark, f"file://{tmp_path}")).collect()
    assert len(got) == 20 and len({r["record_id"] for r in got}) == 10 and all(r["digest_ok"] for r in got)


def test_warc_query_links_and_digests(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = op10_warc(spark, sf).collect()
    assert len(rows) == 2 * pages.count() and len({r["record_id"] for r in rows}) == len(rows)
    for p in pages.limit(20).collect():
        source = warc.page_response(p["page_id"], p["url"], p["html"])
        own = [r for r in rows if r["page_id"] == p["page_id"]]
        assert {r["type"] for r in own} == {"metadata", "conversion"} and all(r["refers_to"] == source.get("WARC-Record-ID") and r["digest_ok"] for r in own)


def test_warc_query_equals_an_own_derivation(spark, sf):
    """Text, digests and links of the records, by other means."""
    import base64
    import hashlib
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.words, self.off, self.raw, self.links, self.title, self.in_title = [], 0, 0, [], "", False

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title", "textarea", "noscript", "select", "svg", "iframe", "template")
            self.in_title = tag == "title"
            if tag in ("a", "area", "link", "img", "script", "iframe", "form"):
                self.links += [v for k, v in attrs if k in ("href", "src", "action") and v is not None][:1]

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title", "textarea", "noscript", "select", "svg", "iframe", "template")
            self.in_title = False

        def handle_data(self, data):
            if self.in_title:
                self.title += data
            elif not self.off:
                self.words += data.split()

    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    rows = {(r["page_id"], r["type"]): r for r in op10_warc(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    same = 0
    for p in pages:
        payload = (p["html"] or "").encode()
        for kind in ("metadata", "conversion"):
            r = rows[p["page_id"], kind]
            head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            assert block == r["block"].encode() + b"\r\n\r\n" and int(fields["Content-Length"]) == len(r["block"].encode()) == r["content_length"]
            assert fields["WARC-Block-Digest"] == sha1(r["block"].encode()) == r["block_digest"] and r["source_digest"] == sha1(payload)
            assert fields["WARC-Type"] == kind and fields["WARC-Refers-To"] == r["refers_to"] != fields["WARC-Record-ID"] and fields["WARC-Target-URI"] == p["url"]
        own = Text()
        own.feed(p["html"] or "")
        own.close()
        assert sorted(rows[p["page_id"], "conversion"]["block"].replace(" ", "").replace("\n", "")) == sorted("".join(own.words)) or "<br" in p["html"]
        same += rows[p["page_id"], "conversion"]["block"].split() == own.words
        meta = rows[p["page_id"], "metadata"]["block"].split("\r\n")
        assert f"title: {' '.join(own.title.split())}" in meta or not own.title
        assert [x.split(" ")[1] for x in meta if x.startswith("outlink: ")] == own.links
    assert same >= 0.5 * len(pages)


def test_members_are_read_in_linear_time():
    import gzip
    import time

    one = gzip.compress(warc.page_response(1, "http://x/1", "<p>page</p>" + "x y " * 300).bytes())
    start = time.perf_counter()
    assert sum(1 for _ in warc.records(one * 40_000)) == 40_000
    assert time.perf_counter() - start < 20


def test_one_pass_gives_what_two_give(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(30)
    two = warc.derivatives(warc.responses(pages))
    assert sorted(map(str, warc.page_derivatives(pages).collect())) == sorted(map(str, two.collect()))


def test_warc_odd_rows(odd, empty):
    assert warc.derivatives(warc.responses(odd, "doc_id", "source", "text")).count() == 26
    assert warc.derivatives(warc.responses(empty, "doc_id", "source", "text")).count() == 0


def test_broken_gzip_members_lose_only_what_is_broken():
    import gzip
    import random

    noise = "".join(random.Random(3).choices("abcdefghijklmnop ", k=4000))
    blocks = [warc.page_response(k, f"http://x/{k}", f"<p>page {k}</p>{noise}").bytes() for k in range(5)]
    parts = [bytearray(gzip.compress(b)) for b in blocks]
    parts[1][-8] ^= 1  # the checksum
    parts[3][len(parts[3]) // 2 :] = b"\xff" * (len(parts[3]) - len(parts[3]) // 2)
    got = list(warc.records(b"".join(map(bytes, parts))))
    assert [r.get("WARC-Target-URI") for r in got] == [f"http://x/{k}" for k in range(5)]
    assert all(r.bytes() == b for k, (r, b) in enumerate(zip(got, blocks, strict=True)) if k != 3)
    assert got[3].block[:500] == next(warc.records(blocks[3])).block[:500]
    head, page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: gzip\r\n\r\n", noise.encode()
    assert warc.http_response(head + gzip.compress(page) + gzip.compress(b"the end")).payload == page + b"the end"
    cut = warc.http_response(head + bytes(parts[1])[:-8] + b"\x00" * 8).payload
    assert cut == blocks[1]
    assert warc.http_response(head + page).payload == page
