import re
from collections import defaultdict

import pytest

from plantlens.llm import html_text, url_filter
from plantlens.llm.common import table

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies. Please agree to all of them.</div>
<div class="ad">Buy now, this is a long advert with many words that reads like text.</div><aside class="sidebar"><p>More to read here, in quite some words.</p></aside>
<article><header><h1>Head&shy;line</h1></header><p>First &amp; <b>second</b>
 line &eacute;&#233;&#x41;.<p>Short<ul><li>One<li>Two</ul><!-- <p>gone</p> --><form><input><label>Name</label></form><p>See <a href="/x">this</a>.</p>
<section id="comments"><p>A reader writes a long comment about all of this, in words.</p></section></article><footer>&copy; 2024 us</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "Head\u00adline\nFirst & second line ééA.\nShort\nOne\nTwo\nSee this."


@pytest.mark.parametrize("page", ["", "<", "<p", "<p>unclosed <b>bold", "&am", "<!-- open", "<script>open", "<a href='x", "</div></p>", "text only, of some words to read here.", "<p>" * 2000 + "x"])
def test_broken_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_without_article_long_text_stays():
    text = "This is a paragraph of text which goes on for quite a number of words. It ends here."
    page = f"<div><a href='/'>Home</a> <a href='/b'>About</a></div><div><p>{text}</p><p>{text}</p></div><div><a href='/c'>Contact</a></div>"
    assert html_text.main_text(page) == f"{text}\n{text}"


def test_cut_is_minimal():
    g = html_text.Cut(5)
    for a, b, c in ((0, 1, 3), (0, 2, 1), (1, 2, 2), (1, 3, 1), (2, 3, 4), (3, 4, 9)):
        g.join(a, b, c)
    assert g.source_side(0, 4) == [True, False, False, False, False]


def test_pages_of_the_table(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rows = html_text.extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    for r in rows:
        article = r.html.split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0]
        want = [" ".join(html_text.html.unescape(re.sub(r"<[^>]*>?", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/71?x", "https://example.com/en/8", "x://a.net/de/1", "x://example.net/de/81#a", "x://b.org/es/", "x://b.org/es", "x://com/en/", "x://acom/en/", "x://blog.b.org/en/1", "a://b://c/d"]


def plain_rule(host, path):
    fit = [(len(r.text), r) for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit)[1] if fit else None


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_ranks(rows):
    edges, seeds = defaultdict(float), {"trust": defaultdict(float), "distrust": defaultdict(float)}
    hosts = set()
    for _, url, html in rows:
        host, path = parse(url)
        found = plain_rule(host, path)
        if found:
            seeds["trust" if found.action == "allow" else "distrust"][host] += 1
        links = set(re.findall(r"""href="[a-z]+://([^/"]+)""", html or ""))
        hosts |= {host, *links} - {""}
        for x in links:
            if host and x != host:
                edges[host, x] += 1
    for h in hosts:
        if h.count(".") >= 2:
            edges[h, h.split(".", 1)[1]] += 1
    out = {}
    for kind, seed in seeds.items():
        total = sum(seed.values())
        start = {h: v / total for h, v in seed.items()}
        e = edges if kind == "trust" else {(b, a): w for (a, b), w in edges.items()}
        sums = defaultdict(float)
        for (a, _), w in e.items():
            sums[a] += w
        rank = start
        for _ in range(url_filter.ROUNDS):
            new = defaultdict(float, {h: v * (1 - url_filter.DAMPING) for h, v in start.items()})
            for (a, b), w in e.items():
                new[b] += rank.get(a, 0) * w / sums[a] * url_filter.DAMPING
            rank = new
        out[kind] = rank
    return out


@pytest.mark.parametrize("inline", [64, 0])
def test_verdicts_against_plain_ranks(spark, monkeypatch, inline):
    monkeypatch.setattr(url_filter, "INLINE", inline)
    rows = [(i, u, None) for i, u in enumerate(URLS)]
    links = ["c.example.net", "d.org", "e.example.com", "b.org", "d.org"]
    rows += [(100 + i, f"http://h{i % 7}.example.{'com' if i % 3 else 'net'}/{'de' if i % 2 else 'en'}/{i}", "".join(f'<a href="http://{x}/">' for x in links[: i % 6])) for i in range(40)]
    ranks = plain_ranks(rows)
    got = url_filter.judge_urls(spark.createDataFrame([(*r, "host") for r in rows], "page_id long, url string, html string, path string").repartition(3)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        host, path = parse(text[r.page_id])
        found = plain_rule(host, path)
        t, d = ranks["trust"].get(host, 0), ranks["distrust"].get(host, 0)
        assert (r.host, r.path, r.rule) == (host, path, found and found.text)
        assert abs(r.trust - t) < 1e-9 and abs(r.distrust - d) < 1e-9
        assert r.verdict == (found.action if found else "block" if d > 0.5 * (t + d) else "allow")
    assert {r.verdict for r in got if not r.rule} == {"allow", "block"}


def test_ranks_reach_the_end_of_long_chains_and_settle_in_rings(spark):
    """Thirteen hosts in a chain to a blocked one; a ring of two that a seed feeds."""
    link = lambda x: f'<a href="http://{x}/">'
    rows = [(i, f"http://n{i}.test/", link(f"n{i + 1}.test")) for i in range(13)] + [(13, "http://n13.test/bad", None)]
    rows += [(20, "http://a.ring/good", link("b.ring")), (21, "http://b.ring/", link("a.ring"))]
    rules = [url_filter.rule("block", "n13.test/bad"), url_filter.rule("allow", "a.ring/good")]
    got = {r.host: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules, tolerance=1e-3).collect()}
    d = url_filter.DAMPING
    for i in range(14):
        assert got[f"n{i}.test"].verdict == "block"
        assert abs(got[f"n{i}.test"].distrust - (1 - d) * d ** (13 - i)) < 1e-9
    assert abs(got["a.ring"].trust - 1 / (1 + d)) < 6e-3 and abs(got["b.ring"].trust - d / (1 + d)) < 6e-3


def test_empty_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge_urls(df).count() == 0 and html_text.extract_text(df).count() == 0
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "x", "")], df.schema)
    assert [r.verdict for r in url_filter.judge_urls(odd).collect()] == ["allow"] * 3
    assert [(r.text, r.n_chars) for r in html_text.extract_text(odd).collect()] == [("", 0)] * 3


LONG = "This is a paragraph of text which goes on for quite a number of words. It ends here."


@pytest.mark.parametrize("name", ["has-sidebar", "layout with-sidebar", "page-header", "no-nav", "main-content share-enabled", "sidebar", "comments"])
def test_an_article_stays_whatever_its_wrapper_is_called(name):
    page = f'<nav><a href="/">Home</a></nav><div class="{name}"><article><h1>Head</h1><p>{LONG}</p><p>Of.</p></article></div><footer>A footer of some words. Quite long.</footer>'
    assert html_text.main_text(page) == f"Head\n{LONG}\nOf."


def test_names_of_paragraphs_are_weaker_than_their_text():
    page = f'<article class="post has-comments"><p>{LONG}</p><p class="share-price">The price of a share rose by two.</p></article>'
    assert html_text.main_text(page) == f"{LONG}\nThe price of a share rose by two."


def test_comments_and_teasers_go_though_they_are_articles():
    page = f'<main><article><p>{LONG}</p></article><div class="comments"><article class="comment"><p>{LONG}</p></article><article><p>Reply. {LONG}</p></article></div><aside><article><p>Teaser. {LONG}</p></article></aside></main>'
    assert html_text.main_text(page) == LONG


def test_the_cut_differs_from_the_score_where_neighbours_decide():
    """A short line among long paragraphs stays, and goes among links; a
    sentence between lists of links goes, though its own score is of content."""
    links = "".join(f'<p><a href="/{i}">Link {i}</a></p>' for i in range(6))
    for page, text, score_says in (
        (f"<div><p>{LONG}</p><p>Of</p><p>{LONG}</p></div>", "Of", False),
        (f"<div>{links}<p>See all our offers.</p>{links}</div><section><p>{LONG}</p><p>{LONG}</p></section>", "See all our offers.", True),
    ):
        p = html_text.page_of(page)
        i = next(i for i, b in enumerate(p.blocks) if b.text == text)
        assert (html_text.costs(p.blocks[i], False) > 0) == score_says
        assert html_text.label(p)[i] != score_says
    assert html_text.main_text(f"<div>{links}<p>Of</p>{links}</div><section><p>{LONG}</p></section>") == LONG


def test_labels_cost_least_of_all():
    """The cut against all labellings of small pages."""
    import itertools

    page = html_text.page_of(f'<div><p>{LONG}</p><p>Of</p><p><a href="/">To it</a></p></div><ul class="menu"><li>One</li><li><a href="/">Two</a></li></ul><p>Some words here.</p>')
    got, n = html_text.label(page), len(page.blocks)
    names = list(page.outside)

    def cost(labels):
        x, c = labels[:n], dict(zip(names, labels[n:]))
        total = 0.0
        for i, b in enumerate(page.blocks):
            s = html_text.costs(b, False)
            total += max(s, 0) * (not x[i]) + max(-s, 0) * x[i] + html_text.CONTAINER * (x[i] != c[b.container])
            if i:
                a = page.blocks[i - 1]
                near = html_text.NEIGHBOURS if a.container == b.container else html_text.NEIGHBOURS / (1 + abs(a.depth - b.depth) + (a.place != b.place))
                total += near * (x[i] != x[i - 1])
        return total + sum(html_text.OUTER * (c[k] != c[o]) for k, o in page.outside.items() if o in c)

    every = list(itertools.product([False, True], repeat=n + len(names)))
    least = min(map(cost, every))
    assert min(cost((*got, *rest)) for rest in itertools.product([False, True], repeat=len(names))) == pytest.approx(least)


def test_deep_pages_take_linear_time():
    import time

    began = time.process_time()
    for page in ("<div>" * 100_000 + LONG, "<div><p>a b c. " * 50_000, "<div>" * 50_000 + "</i></b></p>" * 50_000, f"<p>{LONG}</p><p><a>x</a></p>" * 5000):
        assert isinstance(html_text.main_text(page), str)
    assert time.process_time() - began < 60


def test_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", f"<article>{LONG}</article>", 5, "x")] * 2, "page_id long, url string, html string, n_chars long, text string")
    assert [(r.text, r.n_chars) for r in html_text.extract_text(df).collect()] == [(LONG, len(LONG))] * 2
