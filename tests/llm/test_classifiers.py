"""Language, toxicity and quality: held-out accuracy and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopix.llm import langid, quality_crf, toxicity
from chronopix.llm.common import fold
from chronopix.llm.queries import op4_toxicity, op5_language_id, op7_quality


def test_fold_is_crc32_of_the_id(spark):
    rows = spark.range(50).withColumn("doc_id", F.col("id")).select("doc_id", fold("doc_id", 4).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in rows)


# -- language
def test_subwords_lie_in_words_and_slices_lose_none(monkeypatch):
    text = "Größe und Länge, 3 mal: " * 40
    whole = np.sort(np.concatenate(langid.subwords(text)))
    monkeypatch.setattr(langid, "_SLICE", 37)
    assert (np.sort(np.concatenate(langid.subwords(text))) == whole).all()
    words = [np.concatenate(langid.subwords(w)) for w in "Größe und Länge mal".split()]
    assert len(whole) == 40 * sum(map(len, words))
    assert langid.subwords("12 ?? _") == [] and langid.subwords(None) == []


def test_number_characters_are_no_letters():
    assert all(langid.subwords(t) == [] for t in ("²", "½ ①", "Ⅷ ³", "一"[:0])) and langid.letters("x² und ½ L") == "x und l" and langid.letters("日本²") == "日本"


def brute_language(model, text):
    """Prediction from the definitions: substrings of the words with a space around, one by one."""
    words, word = [], ""
    for c in (text or "").lower():
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    words += [word] * bool(word)
    if not words or not model.languages:
        return "und", 0.0
    multipliers = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)
    total, n = [0.0] * len(model.languages), 0
    for w in words:
        w = f" {w} "
        for size in (1, 2, 3, 4):
            for i in range(len(w) - size + 1):
                gram = w[i : i + size]
                if gram == " ":
                    continue
                h = 0
                for k, c in enumerate(gram):
                    h ^= (ord(c) + k + 1) * multipliers[k] % 2**32
                h = h * 0x2C1B3C6D % 2**32
                row = model.table[(h ^ h >> 15) % langid.BUCKETS]
                total = [a + float(b) for a, b in zip(total, row, strict=True)]
                n += 1
    z = [(a / n + float(b)) / model.temperature for a, b in zip(total, model.bias, strict=True)]
    e = [np.exp(v - max(z)) for v in z]
    k = max(range(len(e)), key=lambda i: e[i])
    return model.languages[k], e[k] / sum(e)


def test_predictions_equal_brute_force(langs, odd_rows):
    model = langid.train(*langs, epochs=2)
    for text in [*langs[0][::20], *(r[1] for r in odd_rows if r[1] is None or len(r[1]) < 5000), "a", "Ünd² x", "ka lo_mi9str"]:
        name, score, _ = model.predict(text)
        expected, p = brute_language(model, text)
        assert name == expected and score == pytest.approx(p, abs=1e-4)


def test_every_row_is_seen_in_every_epoch(monkeypatch):
    seen = []
    monkeypatch.setattr(langid.np, "concatenate", lambda x, f=np.concatenate: seen.append(len(x)) or f(x))
    langid.train([f"wort{k} satz" for k in range(200)], ["a", "b"] * 100, epochs=3)
    assert sum(n for n in seen if n > 4) == 2 * 3 * 160  # subwords and shares of each batch


@pytest.fixture(scope="module")
def langs():
    r = np.random.default_rng(1)
    sets = {"aa": ["ka", "lo", "mi"], "bb": ["str", "en", "ung"], "cc": ["éa", "ou", "x"]}
    rows = [(" ".join("".join(r.choice(s, r.integers(1, 4))) for _ in range(r.integers(2, 40))), k) for k, s in sets.items() for _ in range(150)]
    return [x[0] for x in rows], [x[1] for x in rows]


def test_language_is_learnt_and_junk_is_und(langs):
    texts, names = langs
    model = langid.train(texts[::2], names[::2], epochs=8)
    right = [model.predict(t)[0] == n for t, n in zip(texts[1::2], names[1::2], strict=True)]
    assert np.mean(right) > 0.97
    assert model.predict(None) == ("und", 0.0, True) and model.predict("123 !")[0] == "und"
    assert not any(model.predict(t)[2] for t in texts[1::2][:20])
    none = langid.train([], [])
    assert none.predict("abc") == ("und", 0.0, True)


def test_language_query_on_held_out_rows(spark, sf):
    rows = op5_language_id(spark, sf.replace("sf0.001", "sf0.01")).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet").collect()}
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_language_odd_rows(odd, empty):
    model = langid.fit(odd)
    rows = {r["id"]: r for r in langid.identify(odd, model).collect()}
    assert len(rows) == 12 and all(rows[k]["lang_pred"] == "und" and rows[k]["rejected"] for k in (1, 2, 3, 7))
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2, 3, 7)").isEmpty()


# -- toxicity
def test_folding():
    assert toxicity.fold("ID1OT!") == " idiot " and toxicity.fold("l0ser") == toxicity.fold("LOSER") == " ioser "
    assert toxicity.fold("іdіоt") == " idiot " and toxicity.fold("mo​ron") == " moron " and toxicity.fold(None) == "" and toxicity.fold("?!") == ""


def test_accents_and_styled_letters_fold():
    assert toxicity.fold("ídïòt") == toxicity.fold("𝓲𝓭𝓲𝓸𝓽") == toxicity.fold("ｉｄｉｏｔ") == toxicity.fold("ⓘⓓⓘⓞⓣ") == " idiot "


def naive_matches(model, folded):
    """Every term tried at every place; the heaviest of a place; none inside an exception phrase."""
    spans = [(i, i + len(e)) for p in model.exceptions for e in [f" {toxicity.fold(p).strip()} "] for i in range(len(folded)) if folded.startswith(e, i)]
    out = []
    for i in range(len(folded)):
        own = [(w, i + len(t)) for t, w in model.terms.items() if folded.startswith(t, i)]
        if own:
            weight = max(w for w, _ in own)
            ends = [e for w, e in own if w == weight]
            if not any(a <= i and max(ends) <= b for a, b in spans):
                out.append((i, weight))
    return out


def test_matches_equal_a_naive_matcher():
    r = np.random.default_rng(6)
    words = ["idiot", "trash", "can", "trash", "bag", "clown", "fish", "a", "scum", "pond", "m0ron", "morons", "zorg", "zorgling", "sore", "loser", "l0ser", "IDIOT!", "ïdiot"]
    model = toxicity.ToxicityModel(toxicity.train([], []).terms | {" zorg": 1.5, " zorgli": 3.0, " moron": 2.5})
    for _ in range(300):
        folded = toxicity.fold(" ".join(words[k] for k in r.integers(0, len(words), r.integers(0, 15))))
        expected = naive_matches(model, folded)
        assert [(s, w) for s, _, w in model.matches(folded)] == expected
        total, n = sum(w for _, w in expected), max(0, len(folded.split()))
        got = model.features(folded)
        assert got == pytest.approx((np.log1p(total), np.log1p(100 * total / (n + 10)) if total else 0.0, np.log1p(len(expected))))


def test_the_setting_is_chosen_inside_the_rows(monkeypatch):
    seen = []
    fitted = toxicity._fitted
    monkeypatch.setattr(toxicity, "_fitted", lambda folded, docs, s, n: seen.append((len(folded), s)) or fitted(folded, docs, s, n))
    clean = [f"all is well {k} in this town of ours" for k in range(200)]
    toxicity.train(clean + [f"all is well {k} zorgling{k % 7} in this town" for k in range(60)], [0] * 200 + [1] * 60)
    assert len(seen) == len(toxicity.SETTINGS) * toxicity.CHOOSING_PARTS + 1 and seen[-1][0] == 260 and all(n < 200 for n, _ in seen[:-1])


def test_lexicon_exceptions_and_length():
    m = toxicity.train([], [])
    assert m.score("you idiot") > m.score("you idiot " + "fine words here " * 400) > m.score("fine words")
    assert m.score("put it in the trash can") == m.score("put it in the box now") == m.score("") == m.score(None)
    assert m.score("you trash") > m.score("a trash can and you")
    assert m.score("the idiotic") == m.score("the other")  # whole words only


def test_toxic_terms_are_learnt():
    clean = [f"all is well {k} in this town of ours" for k in range(200)]
    bad = [f"all is well {k} zorgling{k % 7} in this town" for k in range(60)]
    m = toxicity.train(clean + bad, [0] * 200 + [1] * 60)
    assert any(t.startswith(" zor") for t in m.terms)
    assert m.score("what a zorgling9 you are") > 0.5 > m.score("what a town")


def test_terms_that_only_repeat_in_toxic_texts_are_learnt():
    clean = [f"all is well {k} in this town of ours" + f" quaddle{k % 9}" * (k % 5 == 0) for k in range(300)]
    bad = [f"all is well {k} quaddle{k % 9} in this quaddle{k % 7} town quaddle{k % 5}" for k in range(60)]
    m = toxicity.train(clean + bad, [0] * 300 + [1] * 60)
    assert " quad" in m.terms
    assert m.score("a quaddle3 in this quaddle1 of a quaddle4 town") > 0.5 > 0.3 > m.score("all is well 7 in this town of ours quaddle2")


def test_toxicity_query_on_held_out_rows(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    rows = op4_toxicity(spark, d).collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_toxicity_odd_rows(odd, empty):
    labels = odd.select("doc_id", F.lit(0).alias("toxic"))
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


# -- quality
def brute_marginals(unary, trans):
    n, total, good = len(unary), 0.0, np.zeros(len(unary))
    for code in range(2**n):
        s = [code >> k & 1 for k in range(n)]
        w = np.exp(sum(unary[k] * s[k] for k in range(n)) + sum(trans[s[k], s[k + 1]] for k in range(n - 1)))
        total += w
        good += w * np.array(s)
    return good / total, np.log(total)


def test_forward_backward_equals_brute_force():
    r = np.random.default_rng(4)
    unary, keep, trans = r.normal(size=(3, 6)), np.ones((3, 6)), r.normal(size=(2, 2))
    keep[1, 4:] = 0
    keep[2, 1:] = 0
    norm, good, _ = quality_crf.forward_backward(unary * keep, keep, trans)
    for k, n in enumerate((6, 4, 1)):
        expected, z = brute_marginals(unary[k, :n], trans)
        assert np.allclose(good[k, :n], expected) and np.isclose(norm[k], z)


def test_model_marginals_equal_brute_force():
    r = np.random.default_rng(5)
    m = quality_crf.QualityModel(r.normal(size=quality_crf.WIDTH), r.normal(size=(2, 2)))
    text = "First line here.\nSECOND!! LINE!!\n\nlast | line | of | this"
    own, length = quality_crf.line_features(text)
    expected, _ = brute_marginals(quality_crf.with_neighbours(own) @ m.weights, m.trans)
    got, n = m.lines(text)
    assert np.allclose(got, expected) and (n == length).all() and list(length) == [17, 16, 1, 24]


def test_scores_are_weighted_marginals_through_the_calibration():
    r = np.random.default_rng(7)
    m = quality_crf.QualityModel(r.normal(size=quality_crf.WIDTH) / 3, r.normal(size=(2, 2)), (0.3, 1.7))
    for text in ("One line.", "First line here.\nSECOND!! LINE!!\n\nlast | line", "", None):
        own, length = quality_crf.line_features(text)
        good, _ = brute_marginals(quality_crf.with_neighbours(own) @ m.weights, m.trans)
        share = float((good * length).sum() / length.sum())
        z = 0.3 + 1.7 * np.log(share / (1 - share))
        assert m.score(text) == pytest.approx(1 / (1 + np.exp(-z)))


def test_few_labels_and_a_very_long_text_can_be_fitted():
    for n in (2, 3, 4, 5, 9):
        m = quality_crf.train([f"text {k}\nline" for k in range(n)], [k % 2 for k in range(n)], epochs=2)
        assert 0 <= m.score("text 1") <= 1
    long_one = "a line of a very long text\n" * 300_000
    sizes = [x.shape[0] * x.shape[1] for x, _, _ in quality_crf._batches([np.zeros((300_000, quality_crf.WIDTH), np.float32), *[np.zeros((3, quality_crf.WIDTH))] * 200], [np.ones(300_000), *[np.ones(3)] * 200])]
    assert max(sizes) <= quality_crf._CELLS and sum(sizes) >= 300_600
    assert 0 <= quality_crf.train([long_one, "b", "c !!"], [1, 0, 1], epochs=1).score("b") <= 1


def test_quality_query_on_held_out_rows(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    rows = op7_quality(spark, d).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9


def test_quality_odd_rows(odd, empty):
    labels = odd.select("doc_id", (F.coalesce(F.col("doc_id"), F.lit(0)) % 2).cast("int").alias("quality"))
    model = quality_crf.fit(odd, labels)
    assert quality_crf.score(odd, model).count() == 13
    assert quality_crf.score(empty, model).count() == 0
    one = quality_crf.train(["a"], [1])
    assert one.score(None) == 1.0 and quality_crf.train([], []).score("x") == 0.5
    assert quality_crf.keep_good(odd, one).count() == 13


def test_an_id_of_many_rows_does_not_fill_the_sample(spark):
    from chronopix.llm.common import labelled_texts

    docs = spark.range(3000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).unionByName(spark.range(400).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text")))
    texts, y = labelled_texts(docs, spark.createDataFrame([(1, 1)], "doc_id int, quality int"), "doc_id", "text", "quality", 100)
    assert len(texts) == len(set(texts)) == len(y) < 400
