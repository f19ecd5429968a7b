"""HTML extraction: markup of all kinds, planted pages, and the whole cut by brute force."""

import html
import re
import time

import numpy as np
import pytest

from skylattice.llm import html_extract


def test_html_extraction(spark):
    article = "<article><h1>Title &amp; more</h1><p>First  paragraph\n with <b>bold</b> words, and some more of them here.<p>Second paragraph, which is also long enough to be content.</article>"
    page = f"<html><head><title>x</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a>About us</a></li></ul></nav><!-- <p>gone</p> --><div class='cookie-notice'>We use cookies.</div>{article}<aside>Related things</aside><div id='comments'><p>First comment, a long one, by a reader of the page.</p></div><form><label>Mail</label><input></form><footer>&copy; us</footer></body></html>"
    t = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (3, "u", ""), (4, "u", "<nav>only</nav>"), (5, "u", "<p>unclosed <b>text")], "page_id long, url string, html string")
    w = html_extract.train(t)
    got = {r.page_id: r.text for r in html_extract.main_text(t, w).collect()}
    assert got[1] == "Title & more\n\nFirst paragraph with bold words, and some more of them here.\n\nSecond paragraph, which is also long enough to be content."
    assert got[2] == got[3] == got[4] == ""
    assert html_extract.main_text(t, w).count() == 6
    assert html_extract.main_text(t.limit(0), w).count() == 0


def test_minimum_cut_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(2, 8))
        source, sink = rng.random(n) * 2, rng.random(n) * 2
        edges = {(a, b): float(rng.random()) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}

        def cost(side):
            return sum(sink[k] if side[k] else source[k] for k in range(n)) + sum(c for (a, b), c in edges.items() if side[a] != side[b])

        best = min(cost([m >> k & 1 for k in range(n)]) for m in range(1 << n))
        assert cost(html_extract.min_cut(source.tolist(), sink.tolist(), edges)) == pytest.approx(best)


PROSE = "Plain words of an article that go on for a while, so that nobody takes them for a menu or a notice, and end in a stop."


def texts(page):
    return [b.text for b in html_extract.extract(page, html_extract.prior())]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p title=it's>Hello world text.</p><p>don't drop this</p>", ["Hello world text.", "don't drop this"]),
        ('<p>one</p><p data-x="open>Second para</p><p>third</p>', ["one", "Second para", "third"]),
        ('<p>one</p><p data-x="open>Second para</p><p class="y">third</p>', ["one", "Second para", "third"]),
        ('<p data-x="a > b <i>">quoted</p>', ["quoted"]),
        ("<p>3 < 4 &lt;b&gt; &am<b>p;</b> &#233;&eacute;</p>", ["3 < 4 <b> &amp; \u00e9\u00e9"]),
        ("<p>a<br>b<br/>c<!-- x > y -->d<!-->e<?x?>f<!DOCTYPE x></p>", ["a b cdef"]),
        ("<script>var a = '<p>no</p>';</script foo><p>yes</p><style>p{}</style >", ["yes"]),
        ("<a href=/x/>link one</a> <p>text after</p>", ["link one", "text after"]),
        ("<textarea>never closed <p>gone</p>", []),
        ("<p>trailing <", ["trailing <"]),
    ],
)
def test_markup(page, want):
    assert [b.text for b in html_extract.blocks(page)] == want


@pytest.mark.parametrize("piece", ['<a href="x ', "<a href='x \"", "<b>", "<div>", "<div></b>", "<b><div>", "<", "<a \"", "</", '<a href="x>', "<td><tr>", '<p a="b', "<!--", "</i>", "<script>"])
def test_broken_pages_take_linear_time(piece):
    took = []
    for size in (50_000, 400_000):
        page = piece * (size // len(piece))
        began = time.process_time()
        html_extract.extract(page, html_extract.prior())
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.02)


@pytest.mark.parametrize("words", [3, 60])
@pytest.mark.parametrize("box", ["<div class='comments'>{}</div>", "<section id=comment-list><article>{}</article></section>", "<aside>{}</aside>", "<footer>{}</footer>", "<div role=complementary>{}</div>", "<form>{}</form>", "<div class='ad-slot'>{}</div>"])
def test_boxes_within_an_article_go_whatever_their_length(box, words):
    inner = box.format("<p>" + " ".join(["reader"] * words) + ".</p>")
    assert texts(f"<article><h1>Title</h1><p>{PROSE}</p>{inner}<p>Short end.</p></article>") == ["Title", PROSE, "Short end."]


def test_wrappers_with_misleading_names_lose_nothing():
    assert texts(f"<div id='legal'><article><p>{PROSE}</p></article></div>") == [PROSE]
    assert texts(f"<form id=page class='with-sidebar'><div class='page-sidebar'><h1>Title</h1><p>{PROSE}</p><div id=sidebar><p>{PROSE}</p></div></div></form>") == ["Title", PROSE]
    assert texts(f"<article><header><h1>Title</h1><div class=share>Share this</div></header><p>{PROSE}</p></article>") == ["Title", PROSE]


def test_articles_with_words_of_their_own():
    page = f'<article class="post-1 post type-post hentry category-x tag-legal"><h1>T</h1><p>{PROSE}</p><p>Short.</p><ul><li>one item</li></ul></article><article class="related"><a href=x>Other</a></article>'
    assert texts(page) == ["T", PROSE, "Short.", "one item"]
    wrapped = f"<div class='menu-open page'><div class='sidebar widget'><article><p>A short teaser of another page.</p></article></div><article><p>{PROSE}</p><p>{PROSE}</p></article><div class=comments><article><p>{PROSE} {PROSE} {PROSE}</p></article></div></div>"
    assert texts(wrapped) == [PROSE, PROSE]
    assert texts(f"<article class='post share social'><p>{PROSE}</p><div class=share>Share this</div></article>") == [PROSE]


def test_planted_pages():
    """Pages drawn from known parts; what was planted as the article comes out, and nothing else."""
    rng = np.random.default_rng(1)

    def prose(n):
        return " ".join("".join(rng.choice(list("aeiorstlné&<"), rng.integers(2, 8))) for _ in range(n)) + "."

    for _ in range(60):
        want, body = [], []
        for _ in range(rng.integers(1, 6)):
            kind = rng.integers(0, 4)
            text = prose(int(rng.integers(1, 80)))
            escaped = html.escape(text)
            if kind == 0:
                body.append(f"<p class='x{rng.integers(9)}'>{escaped}" + ("</p>" if rng.random() < 0.5 else ""))
            elif kind == 1:
                body.append(f"<h2>{escaped}</h2>")
            elif kind == 2:
                body.append(f"<ul><li>{escaped}</li></ul>")
            else:
                body.append(f"<blockquote><p>{escaped}</p></blockquote>")
            want.append(text)
            if rng.random() < 0.4:
                box = rng.choice(["<aside>{}</aside>", "<div class='related sidebar'>{}</div>", "<nav><a href='/'>{}</a></nav>", "<div class=newsletter><form>{}</form></div>", "<!-- {} -->", "<script>{}</script>"])
                body.append(box.format(html.escape(prose(int(rng.integers(1, 60))))))
        page = f"<html><head><title>t</title></head><body class='has-sidebar'><header><a href=/>{html.escape(prose(3))}</a></header><article>{''.join(body)}</article><section class=comments><article><p>{html.escape(prose(50))}</p></article></section><footer>&copy; {html.escape(prose(30))}</footer></body></html>"
        assert texts(page) == want


def test_rows_by_brute_force():
    """The whole labelling of small pages: the cheapest of all, by trying all."""
    rng = np.random.default_rng(2)
    w = html_extract.prior()
    for _ in range(40):
        parts = []
        for _ in range(rng.integers(1, 9)):
            text = " ".join(["word"] * int(rng.choice([1, 2, 5, 15, 40]))) + str(rng.choice(["", ".", " |"]))
            parts.append(rng.choice(["<p>{}</p>", "<div>{}</div>", "<ul><li><a href=x>{}</a></li></ul>", "<div class='story'><p>{}</p></div>", "<div id=legal>{}</div>", "<td>{}", "<article>{}</article>", "<nav>{}</nav>"]).format(text))
        found = html_extract.blocks("".join(parts))
        source, sink, edges = html_extract.costs(found, w)
        n = len(source)

        def cost(m):
            side = [m >> k & 1 for k in range(n)]
            return sum(sink[k] if side[k] else source[k] for k in range(n)) + sum(c for (a, b), c in edges.items() if side[a] != side[b])

        if n > 14:
            continue
        got = html_extract.min_cut(source, sink, edges)
        assert cost(sum(1 << k for k in range(n) if got[k])) == pytest.approx(min(map(cost, range(1 << n))))
        assert [b.text for b, keep in zip(found, got) if keep] == texts("".join(parts))


def plain_cost(page, w):
    """A block's own cost, written out once more for pages of nav, div and article elements with one word each."""
    out = []
    for m in re.finditer(r"<(nav|div|article)(?: class=(\w+))?>([^<]*)</", page):
        out.append((m[1], m[2], m[3]))
    has = any(tag == "article" for tag, _, _ in out)
    costs_ = []
    for k, (tag, word, text) in enumerate(out):
        n = len(text.split(" "))
        around = [min(len(out[j][2].split(" ")), 100) for j in (k - 1, k + 1) if 0 <= j < len(out)]
        marks = sum(text.count(c) for c in ".,;:!?")
        x = [1, 0, min(n, 100) / 50, n < 4, n < 12, n >= 25, min(1, marks / n), "\u00a9" in text, text.count("|") / n, sum(around) / max(1, len(around)) / 50, (k + 0.5) / len(out) < 0.1, (k + 0.5) / len(out) > 0.9, len(out) == 1]
        own = min(3, max(-3, sum(a * b for a, b in zip(x, w[:13]))))
        own += html_extract.PRIOR.get(tag, 0) if tag == "nav" else 0
        own += html_extract.PRIOR.get(f".{word}", 0) if word else 0
        costs_.append(own + (html_extract.PRIOR["outside"] if has and tag != "article" else 0))
    return costs_


def test_costs_by_a_plain_version():
    rng = np.random.default_rng(5)
    w = html_extract.prior()
    for _ in range(50):
        parts = []
        for _ in range(rng.integers(2, 9)):
            text = " ".join(["word"] * int(rng.choice([1, 2, 5, 15, 40]))) + str(rng.choice(["", ".", " |", " \u00a9"]))
            tag = rng.choice(["<nav>{}</nav>", "<div>{}</div>", "<article>{}</article>", "<div class=sponsor>{}</div>", "<div class=legal>{}</div>"])
            parts.append(str(tag).format(text))
        page = "<p></p>".join(parts)
        found = html_extract.blocks(page)
        longest = max((len(b.text) for b in found if b.path[-1].meaning == "article"), default=0)
        if longest and sum(len(b.text) == longest for b in found if b.path[-1].meaning == "article") > 1:
            continue
        if not longest and max(len(b.text) for b in found) * 2 > sum(len(b.text) for b in found):
            continue  # a box of more than half of the text may be a wrapper
        assert html_extract.logits(found, w) == pytest.approx(plain_cost(page, w))


def test_no_block_is_settled_and_the_cut_decides(spark):
    """On the given pages: every cost is finite and small, and the cut changes labels that the classifier alone would give."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    w = html_extract.train(pages)
    changed = total = 0
    for row in pages.select("html").collect():
        found = html_extract.blocks(row.html)
        source, sink, edges = html_extract.costs(found, w)
        assert max(*source[: len(found)], *sink[: len(found)], 0) < 30
        side = html_extract.min_cut(source, sink, edges)
        changed += sum((own > 0) != kept for own, kept in zip(html_extract.logits(found, w), side))
        total += len(found)
    assert 0 < changed < total / 2


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><p>{PROSE}</p><div class='comments'><h1>Comments</h1><p>{PROSE} {PROSE}</p></div></article>", [PROSE]),
        (f"<article><header><h1>T</h1><p>A short lede.</p></header><p>{PROSE}</p></article>", ["T", "A short lede.", PROSE]),
        (f"<article><p>{PROSE}</p><address>12 Main Street, Town</address><p>{PROSE}</p></article>", [PROSE, "12 Main Street, Town", PROSE]),
        (f"<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds here.</p><p>{PROSE}</p></article>", ["So x=2 holds here.", PROSE]),
        (f"<div class='widget'><p>{PROSE}</p><p>{PROSE}</p></div>", [PROSE, PROSE]),
        (f"<nav><a href=x>Home</a></nav><div id='notice-board-article'><p>{PROSE}</p><p>{PROSE}</p></div>", [PROSE, PROSE]),
        (f"<article><p>{PROSE}</p><div class='share-holder'><p>{PROSE}</p></div></article>", [PROSE, PROSE]),
        (f"<article><p>One<script>x</script> two <button>b</button>three words here.</p><p>{PROSE}</p></article>", ["One two three words here.", PROSE]),
        (f"<article><p>Short.</p></article><div class=comments><p>{PROSE} {PROSE}</p></div>", ["Short."]),
        (f"<div class=comments><h1>Comments</h1><p>{PROSE}</p></div><div><p>{PROSE}</p><p>{PROSE}</p></div>", [PROSE, PROSE]),
    ],
)
def test_names_are_outvoted_and_articles_keep_their_parts(page, want):
    assert texts(page) == want


def test_extra_columns_and_labels_of_other_words(spark):
    t = spark.createDataFrame([(k, "u", f"<div class=zqx><p>{PROSE} {PROSE}</p></div><nav><a href=x>home</a></nav><div class=kwv><a href=y>a | b | c</a></div>", "clash") for k in range(40)], "page_id long, url string, html string, text string")
    w = html_extract.train(t)
    assert w[html_extract._feature("zqx")] > 0 > w[html_extract._feature("kwv")]
    assert {r.text for r in html_extract.main_text(t, w).collect()} == {f"{PROSE} {PROSE}"}
    with pytest.raises(ValueError):
        html_extract.main_text(t, w, keep=("text",))
