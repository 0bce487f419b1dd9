from __future__ import annotations

import html
import itertools
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tabvet.llm.html_blocks import blocks, labelled_page
from tabvet.llm.html_crf import Field, default_field, extracted, features, label_blocks, likelihood, main_text, viterbi


def path_score(labels, e, field):
    s = field.first[labels[0]] + field.last[labels[-1]] + sum(x for x, y in zip(e, labels, strict=True) if y)
    return s + sum(field.pairs[a, b] for a, b in itertools.pairwise(labels))


def random_field(rng):
    return Field({}, rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=2))


def test_viterbi_and_likelihood_against_all_paths():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 6):
        field, e = random_field(rng), rng.normal(size=n)
        paths = list(itertools.product((0, 1), repeat=n))
        scores = [path_score(p, e, field) for p in paths]
        assert tuple(viterbi(e.tolist(), field)) == paths[int(np.argmax(scores))]
        own = paths[rng.integers(len(paths))]
        padded = np.zeros((2, 7))
        padded[0, :n] = padded[1, :n] = e
        mask = np.zeros((2, 7), dtype=bool)
        mask[:, :n] = True
        labels = np.zeros((2, 7), dtype=int)
        labels[:, :n] = own
        value, de, dp, df, dl = likelihood(padded, labels, mask, field.pairs, field.first, field.last)
        z = math.log(sum(math.exp(s) for s in scores))
        assert math.isclose(value, 2 * (path_score(own, e, field) - z), abs_tol=1e-9)
        probability = [math.exp(s - z) for s in scores]
        for i in range(n):
            want = own[i] - sum(q for p, q in zip(paths, probability, strict=True) if p[i])
            assert math.isclose(de[0, i], want, abs_tol=1e-9)
        for a, b in itertools.product((0, 1), repeat=2):
            held = lambda p, a=a, b=b: sum(x == (a, b) for x in itertools.pairwise(p))
            want = held(own) - sum(q * held(p) for p, q in zip(paths, probability, strict=True))
            assert math.isclose(dp[a, b], 2 * want, abs_tol=1e-9)
        assert math.isclose(df.sum(), 0, abs_tol=1e-9) and math.isclose(dl.sum(), 0, abs_tol=1e-9)
    assert viterbi([], random_field(rng)) == []


def test_held_out_labelled_pages():
    rng, field = random.Random(2024), default_field()
    right = total = 0
    for _ in range(300):
        page, texts = labelled_page(rng)
        read = blocks(page)
        want = label_blocks(read, texts)
        assert sum(want) == len(texts)
        got = viterbi(field.emissions(read), field)
        right += sum(x == y for x, y in zip(want, got, strict=True))
        total += len(want)
    assert right / total >= 0.99


def test_blocks():
    got = [(b.text, b.leaf, b.tags) for b in blocks("<body>a&amp;b <b>c\n d</b><p>x<p>y<br>z<script>var p='<p>no</p>'</script><ul><li>1<li>2</ul>&#233;&nbsp;!")]
    assert [t for t, _, _ in got] == ["a&b c d", "x", "y", "z", "1", "2", "é !"]
    assert got[1][1:] == got[2][1:] == ("p", {"body", "p"}) and got[4][1:] == got[5][1:] == ("li", {"body", "ul", "li"})
    for broken in ("<", "<p", "</p></div>", "<p>a</b>b", "<!-- <p>x", "<![CDATA[x]]>", "&#xffffffff;", "<a href='x>y", "plain"):
        assert isinstance(blocks(broken), list)
    deep = blocks("<div>" * 3000 + "text")
    assert deep[0].text == "text" and len(features(deep)[0]) < 20


def test_text_of_formulas_and_fallbacks_stays():
    page = ("<article><p>Let <math><mi>alpha</mi></math> be <svg><text>drawn</text><style>gone</style></svg></p>"
            "<p><object data=x>fallback text</object></p><script>gone</script><template>gone</template></article>")
    text = " ".join(b.text for b in blocks(page))
    assert all(w in text for w in ("alpha", "drawn", "fallback text")) and "gone" not in text


def test_mixed_layouts():
    field = default_field()
    page = ("<html><head><title>T</title></head><body><div id=nav><a href=/>Home</a> <a href=/b>Blog</a></div><div class='cookie-notice'>"
            "We use cookies.</div><div class='post-content'><h1>A title here</h1><p>First paragraph of the story, long enough.</p>"
            "<p>Second paragraph &amp; more of it.</p></div><div class='sidebar'><ul><li><a href=x>Other story</a></li></ul></div>"
            "<div class=comments><p>Great read, thank you very much for this one!</p></div><footer>&copy; site</footer></body></html>")
    assert main_text(page, field) == "A title here First paragraph of the story, long enough. Second paragraph & more of it."


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "v", "<html></html>"), (3, "w", "<p>" + "word " * 40_000), (3, "w", "<p>" + "word " * 40_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = extracted(pages).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out)
    assert sorted((r.page_id or 0, r.n_chars == 0) for r in out)[:3] == [(0, True), (1, True), (2, True)]
    assert extracted(pages.where(F.lit(False))).count() == 0


def test_query_table(spark, sf):
    """On pages with an article element, against its blocks by plain patterns."""
    from tabvet.llm.q_pages import op6_html_crf

    raw = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op6_html_crf(spark, sf).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", raw[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<(?:/?(?:p|h1|br)[^>]*)>", inner)]
        assert r.text == " ".join(x for x in parts if x) and r.n_chars == len(r.text)
