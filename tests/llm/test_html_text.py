import html
import re
import time

import pytest
from pyspark.sql import functions as F

from orbisect.llm import html_text as H

PAGES = "page_id long, url string, html string"


def page(body, kind="article"):
    return f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p><article>no";</script></head><body><nav><ul><li><a href="/">menu</a></ul></nav><!-- <p>no --><div class="ad">buy</div><{kind}>{body}</{kind.split()[0]}><footer>&copy; f</footer></body></html>'


def test_what_is_main():
    cases = {
        page("<h1>Head</h1><p><b>One &amp; two<br>three<p>four &lt;5&gt;"): "Head One & two three four <5>",
        page("<p>a</p><form><p>q</p></form><aside>s</aside><div class='comments'><p>c</p></div><p>b</p>"): "a b",
        page("<p>x  y\n z</p><ul><li>1<li>2</ul><table><tr><td>3<td>4</table>", 'div id="content" class="post-12"'): "x y z 1 2 3 4",
        page("<header>h</header><p>in<i>li</i>ne</p><div role=navigation>n</div><div class='cookie-notice'>k</div>", "main"): "inline",
        "": "", "plain <b>text</b>": "plain text", "<p>open < and & co": "open < and & co", "<a href='x": "",
    }
    for source, want in cases.items():
        assert H.Page(source).text([]) == want, source
    assert H.Page(None).text([]) == ""


def test_ordinary_names_are_kept():
    """Headings, paragraphs and cells are text whatever their ids and classes say; blocks go for a whole name alone."""
    kept = {
        '<h2 id="related-work">R</h2><p>x</p>': "R x", '<h2 id="comments">C</h2><p id="comments-policy">x</p>': "C x", '<p class="social-science">x</p>': "x",
        '<h2 id="header-design" class="widget">x</h2>': "x", '<div class="ad-hoc">x</div>': "x", '<section id="notices"><h3>N</h3>x</section>': "N x",
        '<div id="menu">x</div>': "x", '<ul class="menu-engineering"><li class="share">x</ul>': "x", '<table><tr><td class="promo">x</table>': "x",
        '<div class="shared login-free">x</div><blockquote class="comment">y</blockquote>': "x y",
    }
    for body, want in kept.items():
        assert H.Page(page(body)).text([]) == want, body
    gone = ['<div class="comments">c</div>', '<section class="x related">c</section>', '<div class="cookie-notice_2">c</div>', '<ul class="share-menu"><li>c</ul>', '<div role="navigation">c</div>', '<div class="AD">c</div>']
    for body in gone:
        assert H.Page(page(f"<p>x</p>{body}<p>y</p>")).text([]) == "x y", body
    assert H.Page('<main><p>x</p><div id="comments"><p>c</p></div></main>').text([]) == "x"


def test_long_tags_are_read_alike_however_many():
    for n in (1, 64, 65, 1000):
        image = f"<img src=\"data:image/svg+xml,<svg viewBox='0 0 9 9'>{'<path d=M0/>' * 500}</svg>\" alt='>'>"
        source = page("<p>start</p>" + f"{image}<p>between</p>" * n + "<p>end</p>")
        assert H.Page(source).text([]) == "start" + " between" * n + " end", n


def test_quotes_hold_a_tag_open():
    cases = {'<p title="a>b">x': "x", "<p title='a>\"b' class=y>x": "x", "<p title=don't>x": "x", "<p title = \n'>'>x": "x", "<p 'a>x": "x", '<p a="x>y': '"x>y'[4:]}
    for source, want in list(cases.items())[:-1]:
        assert H.Page(source).text([]) == want, source


@pytest.mark.parametrize("part", ["<a =' ", "<a ='x <b =\"y ", "<a x=\"1\" y='", "<a x=\"'\" ", "=\"<a ", "<a x='>' ", "<a x=\" '", "<img a='<' b=\""])
def test_quotes_that_do_not_close_take_time_in_proportion(part):
    source = part * (400_000 // len(part))
    began = time.process_time()
    H.Page(source)
    assert time.process_time() - began < 6, part


def test_tag_ends_against_plain_scan():
    """TagEnds, which remembers, against a scan that doesn't."""
    import random

    def plain(source, at):
        while at < len(source):
            if source[at] == ">":
                return at + 1
            if m := re.compile(r"=\s*([\"'])").match(source, at):
                close = source.find(m[1], m.end())
                if close < 0:
                    return 0
                at = close
            at += 1
        return 0

    r = random.Random(3)
    for _ in range(3000):
        source = "".join(r.choice("ab =='\">< ") for _ in range(r.randint(0, 40)))
        ends = H.TagEnds(source)
        for at in sorted(r.randint(0, len(source)) for _ in range(5)):
            assert ends.after(at) == plain(source, at), (source, at)


def test_hosts_agree(spark):
    rows = [(k, f"http://h.org/{k}", f'<div class="side-{k}x"><p>{"s " * 5}</p></div><div class="body{k}"><p>main {k} {"w " * 40}</p></div>') for k in range(8)]
    rows.append((99, "http://h.org/99", f'<div class="side-9x"><p>{"long teaser " * 40}</p></div><div class="body9"><p>short</p></div>'))
    got = {r.page_id: r.text for r in H.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[99] == "short" and got[0].startswith("main 0 w") and "s s" not in got[0]


def test_generated_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in H.extracted(pages).collect()}
    for r in pages.collect():
        a = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", a)).split())
        assert got[r.page_id] == (want, len(want))


def test_odd_tables(spark):
    assert H.extracted(spark.createDataFrame([], PAGES)).collect() == []
    rows = [(1, None, "<p>a"), (1, None, "<p>a"), (None, "http://x/", None), (2, "", ""), (3, "http://x/", "<p>" + "<div>" * 3000 + "deep" + "y" * 100_000)]
    df = spark.createDataFrame(rows, PAGES).select("*", *(F.lit(1).alias(n) for n in ("host", "paths", "text", "n", "path")))
    got = sorted(str((r.page_id, r.n_chars)) for r in H.extracted(df).collect())
    assert got == sorted(map(str, [(1, 1), (1, 1), (None, 0), (2, 0), (3, 100_004)]))


@pytest.mark.parametrize("part", ["<ul>", "<span>x", "<a ", "<a 'x ", '<p class="y ', "<div><i>x</div>", "</b>", "<li>x", "<", "<!", "<b x='>'>", "<table><tr><td>x", "&amp;<p>"])
def test_odd_pages_take_time_in_proportion(part):
    """A megabyte of one thing is read in seconds, and its text is all there."""
    source = part * (1_000_000 // len(part))
    began = time.process_time()
    page = H.Page(source)
    text = page.text(["ul", page.path(len(page.keys) - 1)[:100_000]])
    page.best()
    assert time.process_time() - began < 20
    if part in ("<span>x", "<li>x"):
        assert text.count("x") == source.count("x")


def test_long_tags_and_far_quotes():
    long = "y" * 10_000
    assert H.Page(f'<p title="{long} > z">in</p>').text([]) == "in"
    assert H.Page(f'<p title="{long}>in <b>x</b>').text([]) == "in x"
    assert H.Page('<p class="a>b">x<div class="c">y').text(["div.c"]) == "y"


def test_closing_inline_tags_stay_inside_their_block():
    page = H.Page("<i><p>a</i>b<p>c")
    assert [page.tags[n] for n in page.stack] == ["", "i", "p"] and page.text([]) == "ab c"
