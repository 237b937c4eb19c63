import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from rangewarden.llm import toxicity
from rangewarden.llm.boosting import Boosted
from rangewarden.llm.html_dom import Dom
from rangewarden.llm.html_text import DROP, MIXED, STYLES, decode, extract_all, extract_pages, fit_pages, labels, made_page, main_text
from rangewarden.llm.language_id import Letters, fit, identify, letter_codes, predict_languages


@pytest.fixture(scope="module")
def trees():
    return fit_pages()


def test_pages(trees):
    page = """<!DOCTYPE html><html><head><title>No</title><script>var x="<p>no</p>";</script></head><body><nav><ul><li><a href=/a>Menu</a></li><li><a href=/b>More</a></li></ul></nav>
    <!-- <p>no</p> --><div class="ad">Buy this now.</div><article><h1>Title &amp; more</h1><p>First <b>bo</b>ld&nbsp;text.
      On   two lines.<br>Third.<p>Unclosed paragraph, with some more text to read.<ul><li>One item</li><li>Two</ul></article>
    <div class="cookie-notice">We use cookies. <button>Ok</button></div><section id="comments"><h3>Comments</h3><div class="comment"><p>First!</p></div></section><footer>&copy; us</footer></body></html>"""
    assert extract_all([page], trees) == ["Title & more First bold text. On two lines. Third. Unclosed paragraph, with some more text to read. One item Two"]


def unmarked(page):
    return re.sub(r' data-k="\d"', "", page)


@pytest.mark.parametrize("style", list(STYLES))
def test_made_pages_that_training_has_not_seen(trees, style):
    rng, right = random.Random(77), 0
    for _ in range(40):
        page, whole = made_page(rng, style)
        dom = Dom(page)
        right += extract_all([unmarked(page)], trees) == [main_text(dom, [x == 1 for x in labels(dom, whole)])]
    assert right >= 32


def article(page):
    dom = Dom(page)
    inside = [False] * len(dom.tag)
    for i in range(1, len(inside)):
        inside[i] = inside[dom.parent[i]] or dom.tag[i] == "article"
    return main_text(dom, inside)


def test_pages_without_telling_tags_or_attributes(trees):
    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    want = list(map(article, pages))
    assert sum(a == b for a, b in zip(extract_all(pages, trees), want, strict=True)) >= 0.95 * len(pages)
    bare = [re.sub(r' (class|id)="[^"]*"', "", re.sub("<(/?)article", r"<\1div", p)) for p in pages]
    assert sum(a == b for a, b in zip(extract_all(bare, trees), want, strict=True)) >= 0.9 * len(pages)
    divs = [re.sub("<(/?)(?:nav|footer)", r"<\1div", p) for p in bare]
    assert sum(a == b for a, b in zip(extract_all(divs, trees), want, strict=True)) >= 0.9 * len(pages)


def test_pieces_of_pages(trees):
    long, other = "Long words are here in a row, and more. " * 10, "Another one of these long ones. " * 9
    cases = {
        "Just some text without any tags at all.": "Just some text without any tags at all.",
        "Text\n  with <br> breaks &amp; more.": "Text with breaks & more.",
        "<p>First paragraph here.</p><p>Second one.</p>": "First paragraph here. Second one.",
        f'<html><body><div id="c1"><p>{long}</p><p>{other}</p></div></body></html>': f"{long}{other}".strip(),
        f'<table><tr><td><a href="/">Home</a> <a href="/n">News</a></td><td><h1>Title</h1><p>{long}</p><p>{other}</p></td></tr></table>': f"Title {long}{other}".strip(),
    }
    assert extract_all(list(cases), trees) == list(cases.values())


def brute_decode(dom, odds):
    """The best value of all assignments of boilerplate, main and mixed that agree with the tree."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best, place = -np.inf, None
    for states in itertools.product((0, 1, 2), repeat=len(dom.tag)):
        value = 0.0
        for i, s in enumerate(states):
            above = states[dom.parent[i]] if i else 2
            if s == 2 and (dom.tag[i] in ("#text", "script") or above != 2) or s == 1 and (dom.tag[i] == "script" or above == 0):
                break
            value += (no[i], yes[i], MIXED)[s] + (DROP if above == 1 and s == 0 else 0)
        else:
            if value > best:
                best, place = value, states
    return best, place


def test_decoding_is_the_best_assignment():
    rng = np.random.default_rng(5)
    for page in ("<div><p>a</p>b</div>", "<p>a</p><script>x</script>b", "a<div><b>c</b></div>", "<ul><li>a<li>b</ul>"):
        dom = Dom(page)
        for _ in range(40):
            odds = rng.normal(size=len(dom.tag)) * 4
            _, states = brute_decode(dom, odds)
            assert decode(dom, odds) == [s == 1 for s in states], page


def test_decoding_never_contradicts_the_tree():
    rng = np.random.default_rng(1)
    dom = Dom("<div><p>a<b>c</b></p><div><p>d</p>e</div></div><script>x</script>f")
    for _ in range(50):
        kept = decode(dom, rng.normal(size=len(dom.tag)) * 4)
        for i in range(1, len(kept)):
            p = dom.parent[i]
            if dom.tag[p] == "script":
                assert not kept[i]
            if kept[p] and not kept[i]:
                below = [k for k in range(len(kept)) if dom.parent[k] == i]
                assert not any(kept[k] for k in below)


def test_page_frames(spark, trees):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (3, "v", "<article><p>" + "word and more. " * 5000 + "</p></article>"), (4, "w", "<p"), (5, "x", "&#0;&bogus;<>< a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in extract_pages(df, trees).collect()}
    assert got[1]["text"] == got[2]["text"] == "" and got[3]["n_chars"] == len("word and more. " * 5000) - 1
    assert extract_pages(df, trees).count() == 6 and extract_pages(df.limit(0), trees).count() == 0


def test_boosting_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = Boosted.fit(x[:1500], y[:1500])
    assert ((model.scores(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95


def prose(lang, rng, n):
    bits = {"en": "th and of ing tion er", "de": "ung sch ein der ück ö", "fr": "eau que é oi ent ç"}[lang].split()
    return " ".join("".join(rng.choice(bits) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(1)
    rows = [(i, prose(lang, rng, rng.randint(3, 60)), lang if i % 9 else None, "s") for i in range(240) for lang in [["en", "de", "fr"][i % 3]]]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "123 !!", "en", "s"), (903, "𝕬 中文", None, "s"), (None, "the and of", None, "s"), (5, rows[5][1], "fr", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    got = predict_languages(df).collect()
    assert len(got) == len(rows)
    truth = {i: ["en", "de", "fr"][i % 3] for i in range(240)}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth and r["held_out"]]) > 0.95
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if r["doc_id"] in (900, 901, 902):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    langs, protos = fit(df)
    assert identify(df.withColumn("lang_pred", df.lang), langs, protos).columns.count("lang_pred") == 1
    assert predict_languages(df.limit(0)).count() == 0


def test_severity(spark):
    rng = random.Random(2)
    bad = ["vaxo", "vaxib", "grumpo"]
    rows, labels = [], []
    for i in range(500):
        ws = prose(rng.choice(["en", "de", "fr"]), rng, 40).split()
        k = rng.choice([0] * 9 + [1, 3, 6])
        ws += [rng.choice(bad) + rng.choice(["", "s", "en"]) for _ in range(k)]
        rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
        if i < 400:
            labels.append((i, int(k > 0)))
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([*labels, (None, 1), (3, None), (7777, 1)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    truth = {i: any(w.startswith(tuple(b[:4] for b in bad)) for w in t.split()) for i, t in rows}
    assert np.mean([got[i]["toxic"] == truth[i] for i in range(400, 500)]) >= 0.95
    assert (np.diff(model.thresholds) >= 0).all() and all(0 <= r["severity"] <= 3 for r in got.values())
    assert not got[900]["toxic"] and got[900]["severity"] == got[901]["severity"]
    heavy, light = (np.mean([got[i]["severity"] for i, t in rows if f(sum(w.startswith(("vaxo", "vaxi", "grum")) for w in t.split()))]) for f in (lambda n: n >= 5, lambda n: n == 1))
    assert heavy > light
    assert toxicity.score(df.limit(0), model).count() == 0
    held = [(got[i]["severity"], sum(w.startswith(("vaxo", "vaxi", "grum")) for w in t.split())) for i, t in rows if i >= 400 and truth[i]]
    pairs = [(a, b) for a in held for b in held if a[1] > b[1]]
    assert np.mean([a[0] > b[0] for a, b in pairs]) > 0.8  # severity follows insults that no label counts
    empty = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not any(r["toxic"] for r in toxicity.score(df, empty).collect())


def test_likelihood_and_its_gradient():
    rng = np.random.default_rng(3)
    n, features, top = 40, 6, 3
    ones = rng.random((n, features)) < 0.4
    row, col = np.nonzero(ones)
    y, weigh = rng.integers(0, top + 1, n), rng.random(n) + 0.5
    w, theta = rng.normal(size=features), np.sort(rng.normal(size=top))

    def value(w, theta):
        below = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-(theta[None] - (ones @ w)[:, None]))), np.ones((n, 1))], axis=1)
        return -(weigh * np.log(below[np.arange(n), y + 1] - below[np.arange(n), y])).mean()

    got, by_weight, by_threshold = toxicity.loss(w, theta, row, col, y, weigh)
    assert np.isclose(got, value(w, theta))
    step = 1e-6
    assert np.allclose(by_weight, [(value(w + step * e, theta) - value(w - step * e, theta)) / 2 / step for e in np.eye(features)], atol=1e-6)
    assert np.allclose(by_threshold, [(value(w, theta + step * e) - value(w, theta - step * e)) / 2 / step for e in np.eye(top)], atol=1e-6)


def test_language_vectors_by_hand():
    letters_ = Letters(dim=64)
    text, codes = "Ab cab!", [0, 97, 98, 0, 99, 97, 98, 0]
    assert letter_codes(text).tolist() == codes
    want = np.zeros(64)
    for i in range(len(codes) - 2):
        bound = np.ones(64)
        for p in range(3):
            bound *= np.roll(letters_.letters[codes[i + p]].astype(float), p)
        want += bound
    assert np.allclose(letters_.bundle(text), want)
    protos = np.stack([want / np.linalg.norm(want), -want / np.linalg.norm(want)])
    assert np.isclose((protos @ letters_.bundle(text) / np.linalg.norm(want)).max(), 1)


def test_very_long_texts(spark):
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30_000))  # more n-grams than a worker keeps, more words than any block
    df = spark.createDataFrame([(1, long, "en"), (2, "the and", "en"), (3, None, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in predict_languages(df).collect()}
    assert got[1]["lang_pred"] == "en" and got[3]["lang_pred"] == "und"
    assert toxicity.score(df, toxicity.fit(df, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))).count() == 3
