import hashlib
import html as entities
import random
import re
import zlib

import numpy as np
import pytest

from driftwell.llm import html_text, periodic_runs, ranked_search
from driftwell.llm._util import Scratch

SF = "/root/testdata/sf0.01"
ODD = "doc_id long, text string, words string, owner string, shard string, term string, row string"


@pytest.fixture(scope="module")
def weights(spark):
    return html_text.fit_pages(spark.read.parquet(f"{SF}/pages.parquet"))


def article_of(page):
    """The table's pages by another route: what stands between the article's tags, cut at its block tags."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
    return " ".join(x for x in (" ".join(entities.unescape(y).split()) for y in parts) if x)


def test_whole_table_of_pages(spark):
    rows = html_text.op11_main_text(spark, SF).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text) == (pages[r.page_id].url, article_of(pages[r.page_id].html)) and r.n_chars == len(r.text)


@pytest.mark.parametrize("wrap", [("<div>", "</div>"), ("", ""), ('<div class="post-content">', "</div>")])
def test_articles_without_an_element_of_their_own(spark, weights, wrap):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        page = r.html.replace("<article>", wrap[0]).replace("</article>", wrap[1])
        page = page.replace("<footer>", '<div class="site-footer">').replace("</footer>", "</div>")
        assert html_text.main_text(page, weights) == article_of(r.html)


LAYOUTS = [
    (
        '<body><header><a href="/">Site</a><p>Welcome to the site</p></header><div class="cookie-banner">We use cookies. <button>OK</button></div>'
        '<main><h1>Title here</h1><p class="byline">By Someone</p><p>First &lt;para&gt; with <a href="x">a link</a> and&nbsp;space.</p>'
        "<aside>Related: other stories you may like</aside><p>Second para.</p><ul><li>One</li><li>Two</li></ul>"
        '<form action="/s"><label>Mail</label><input name=q><p>Sign up now</p></form></main>'
        '<section id="comments"><h2>3 comments</h2><p>Great article, I liked it very much indeed.</p></section><footer>(c) 2020</footer></body>',
        "Title here First <para> with a link and space. Second para. One Two",
    ),
    (
        '<div id="wrapper"><div class="sidebar"><p>Popular posts of this week and many more words</p></div><div class="post-body"><h2>Head</h2>'
        'Text one<br>line two<p>Para<table><tr><td>A<td>B</table></div><div class="notice">Please note that this site closes</div>'
        '<div class="advert">Buy now the best product</div></div>',
        "Head Text one line two Para A B",
    ),
    (
        '<form id="f"><table><tr><td><div>Home | <a href=a>About</a></div></td></tr><tr><td><h1>The heading</h1><p>Some long text.</p>'
        "<p>And more of it.</p></td></tr></table></form>",
        "The heading Some long text. And more of it.",
    ),
    ("<article><header><h1>Head</h1><p>12 May</p></header><p>a<b>b</b>c <script>x<y</script>d</p><p hidden>no</p></article>", "Head abc d"),
    ("<p>Just a paragraph.", "Just a paragraph."),
    ("plain text, no tags &amp; all &#x41;", "plain text, no tags & all A"),
    ("<html><head><title>x</title></head><body></body></html>", ""),
    ("<article><p>cut <b>short</p><p>by a tag <a href='", "cut short by a tag"),
    ("<!-- never closed <p>x</p>", ""),
    ("<p>a < b and c > d</p>", "a < b and c > d"),
]


@pytest.mark.parametrize("page, text", LAYOUTS)
def test_layouts(weights, page, text):
    assert html_text.main_text(page, weights) == text


def test_examples_that_were_not_learnt_from(weights):
    words = [(html_text.main_text(page, weights).split(), text.split()) for page, text in html_text.example_pages(2, seed=99)]
    assert np.mean([a == b for a, b in words]) > 0.9


def test_best_region_against_all_regions():
    r = random.Random(4)
    for _ in range(300):
        kinds = [r.randrange(5) for _ in range(r.randrange(12))]
        counts = [r.randrange(1, 4) for _ in kinds]
        scores = [r.choice([-3, -1, 0, 1, 2]) for _ in range(5)]
        total = lambda a, b: sum(scores[k] * c for k, c in zip(kinds[a:b], counts[a:b], strict=True))  # noqa: E731, B023
        spans = [(total(a, b), b - a) for a in range(len(kinds)) for b in range(a + 1, len(kinds) + 1)]
        a, b = html_text.best_region(kinds, counts, scores)
        assert (total(a, b), b - a) == max([x for x in spans if x[0] > 0], default=(0, 0))


def test_labelled_pages_teach_new_names(spark):
    page = "<div class='zork'><p>{}</p></div><div class='flim'><p>{}</p><p>{}</p></div>"
    prose = [html_text.example_pages(1, seed=k)[0][1].split() for k in range(12)]
    made = [(page.format(" ".join(w[:8]), " ".join(w[8:14]), " ".join(w[14:20])), " ".join(w[8:20])) for w in prose]
    labelled = spark.createDataFrame([*made[:10], ("<p>x</p>", "not its text"), (None, None)], "html string, text string")
    learnt = html_text.fit_pages(labelled, labelled)
    assert "zork" in learnt.furniture and [html_text.main_text(p, learnt) for p, _ in made[10:]] == [t for _, t in made[10:]]


def test_odd_pages(spark, weights):
    long = "<article>" + "<p>word <b>and</b> more</p>" * 60_000 + "</article>"
    deep = "<div>" * 20_000 + "<b>" * 20_000 + "deep" + "</i>" * 20_000
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>x"), (3, "u", long), (4, "u", deep), (5, "u", "<a " * 50_000), (5, "u", "<a " * 50_000)]
    pages = spark.createDataFrame([(*x, "t", 7) for x in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {(r.page_id, r.url): r for r in html_text.extract(pages, weights).collect()}
    assert got[1, None].text == got[2, "u"].text == "" and got[None, "u"].text == "x" and got[4, "u"].text == "deep"
    assert got[3, "u"].text == " ".join(["word and more"] * 60_000) and got[3, "u"].n_chars == len(got[3, "u"].text)
    assert html_text.extract(pages, weights).count() == 7
    none = pages.limit(0)
    assert html_text.extract(none, html_text.fit_pages(none)).count() == 0


def brute_runs(words, least):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            smaller = any(all(words[k] == words[k + p] for k in range(s, s + length - p)) for p in range(1, q))
            if i > s and length >= max(least, 2 * q) and not smaller:
                out.append((s, length, q))
            i += i == s
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_against_all_periods():
    r = random.Random(1)
    for _ in range(800):
        n, k, least = r.randrange(0, 110), r.choice([1, 2, 2, 3, 5, 20]), r.choice([12, 12, 7, 2])
        words = [r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.5:
            a, p = r.randrange(n), r.randrange(1, 1 + max(1, n // 2))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert periodic_runs.runs_of(np.array(words, np.int64), least) == brute_runs(words, least)


def want_runs(doc_id, text):
    """The contract, by definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 12)
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_periodic_runs_by_definition(spark, tmp_path):
    r = random.Random(5)
    known = [f"é{k}" for k in range(30)]
    rows = [(i, " ".join(r.choice(known[: r.choice([2, 30])]) for _ in range(r.randrange(1, 90)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\t \n"), (None, "a b " * 30), (63, "a\x0bb\x0ca\x0db " * 9), (64, "x y x y " * 8), (64, "x y x y " * 8), (65, "\x00 \x1f " * 8)]
    docs = spark.createDataFrame([(i, t, "w", "o", "s", "t", "r") for i, t in rows], ODD)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(want_runs(*x)) for x in rows)
    long = periodic_runs.find_runs(spark.createDataFrame([(1, "to be or not " * 60_000), (2, " ".join(map(str, range(200_000))))], "doc_id long, text string"))
    assert [[tuple(x) for x in r.runs] for r in long.orderBy("doc_id").collect()] == [[(0, 240_000, 4)], []]
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def brute_search(docs, items, k):
    held = [(i, ranked_search.terms_of(t)) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = {t: sum(t in c for _, c, _ in held) for _, q in items for t in ranked_search.terms_of(q)}
    out = []
    for item, q in items:
        scored = []
        for i, c, n in held:
            m = 75 + (25 * n * n_docs) // total
            s = sum(r * ranked_search.weight(n_docs, df[t]) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in ranked_search.terms_of(q).items() if c[t])
            if s > 0:
                scored.append((-s, 1 << 63 if i is None else i))
        out += [(item, rank, None if i == 1 << 63 else i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes, limited", [(16 << 20, True), (3000, True), (3000, False)])
def test_search_against_scoring_every_document(spark, monkeypatch, shard_bytes, limited):
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", shard_bytes)
    r = random.Random(6)
    known = [f"t{min(int(r.expovariate(0.05)), 400)}" for _ in range(2000)] + ["é", "Straße", "a-b"]
    docs = [(i, " ".join(r.choices(known, k=r.choice([1, 5, 40, 300])))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "-- ..."), (None, "t1 t2"), (None, "t1 t2"), (7, docs[8][1]), (9, docs[8][1]), (303, "T1 t1 É")]
    items = [(k, " ".join(r.choices(known, k=n))) for k, n in enumerate([1, 1, 2, 5, 30, 120])] + [(90, None), (91, "nowhere"), (92, "t1 t1 t2"), (92, "t1 t1 t2"), (None, "É é T1")]
    frame = spark.createDataFrame([(i, t, "w", "o", "s", "t", "r") for i, t in docs], ODD).repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, number long")
    index = ranked_search.build_index(frame, Scratch(), ranked_search.query_terms(asked) if limited else None)
    got = ranked_search.search(index, asked, Scratch(), 20)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 20)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(ranked_search.build_index(docs.limit(0), Scratch(), {"a"}), items, Scratch()).count() == 0
    assert ranked_search.search(ranked_search.build_index(docs, Scratch()), items.limit(0), Scratch()).count() == 0
    assert ranked_search.search(ranked_search.build_index(docs, Scratch(), set()), items, Scratch()).count() == 0


def test_block_ends_cost_least():
    r = np.random.default_rng(2)
    unit, price = ranked_search.UNIT, ranked_search.PRICE
    lists = [np.sort(r.integers(1, 1000, n))[:: r.choice([-1, 1])] if n % 2 else r.integers(1, 1000, n) for n in (0, 1, 16, 17, 60, 95, 130, 160)]
    for x, ends in zip(lists, ranked_search.block_ends(lists), strict=True):
        cost = lambda cuts: sum(price * x.max() + (x[a:b].max() * (b - a) - x[a:b].sum()) for a, b in zip([0, *cuts[:-1]], cuts, strict=True))  # noqa: B023, E731
        borders = list(range(unit, len(x), unit))
        if len(x) > unit:
            ways = [[b for k, b in enumerate(borders) if mask >> k & 1] + [len(x)] for mask in range(1 << len(borders))]
            assert cost(ends.tolist()) == pytest.approx(min(map(cost, ways)))
        else:
            assert ends.tolist() == [len(x)]


def test_blocks_are_skipped():
    r = np.random.default_rng(3)
    n = 20_000
    rare, common = np.arange(500, 520), np.arange(n)
    lists = []
    for name, docs in (("rare", rare), ("common", common)):
        values = r.integers(1, 50, len(docs)) + (docs % 5000 == 7) * 900
        lists.append((name, docs, values, ranked_search.block_ends([values])[0]))
    shard = ranked_search.Shard(np.arange(n), lists)
    ids, scores = shard.best({"rare": 10_000, "common": 10}, 10)
    every = np.zeros(n, np.int64)
    for (_, docs, values, _), w in zip(lists, (10_000, 10), strict=True):
        every[docs] += w * values
    order = np.lexsort((np.arange(n), -every))[:10]
    assert ids.tolist() == order.tolist() and scores.tolist() == every[order].tolist()
    assert shard.blocks_read < len(shard.stop) / 4
