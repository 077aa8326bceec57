import html
import re

import pytest

from findinglake.llm.html_text import extract, host_paths, main_text, votes

SCHEMA = "page_id long, url string, html string, text string, host string, path int, winners string"
ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;words.<p>Second<br>line.</article>"
WANT = "Title & more\nFirst bold words.\nSecond line."
LONG = " ".join(f"word{i}" for i in range(300))


def _text(page, winners=()):
    return extract(page, list(winners))[0]


@pytest.mark.parametrize("around", [
    "<nav><ul><li><a href=/a>Menu</a></ul></nav>{}<footer>&copy; host</footer>",
    "<header><h1>Site</h1>Slogan</header><main>{}</main><aside>Side words here</aside>",
    "<div class='wrap has-sidebar'><div id=sidebar>Side words</div>{}<div class='cookie-notice'>We use cookies</div></div>",
    "<body class='ad-free menu'><div class=page-header><div class='main-menu'>Menu</div></div>{}<form>Name <input> <button>Go</button></form>",
    "<div class='menu-layout'>{}<section id=comments><h2>2 comments</h2><article class=comment><p>" + LONG + "</p></article></section></div>",
    "<script>var t = '</p><article>no</article>';</script><style>p > b {{}}</style>{}<!-- <article>gone</article> --><noscript>Turn it on</noscript>",
    "<div hidden>Hidden words</div><div style='display: none'>None</div>{}<div role=dialog>Box</div><template><p>t</p></template>",
    "<head><title>T</title></head><body>{}<div class=AdSlot>Buy</div><p class=newsletter>Sign up</p>",
])
def test_what_is_around_goes(around):
    page = "<!DOCTYPE html><html lang=en>" + around.format(ARTICLE)
    assert _text(page) == WANT
    assert _text(page + "</html>") == WANT


@pytest.mark.parametrize("body,want", [
    ("<article><header><h1>T</h1><div class=share>Share</div></header><p>a<aside>side</aside><div class=ad>Buy</div><p>b<footer>f</footer></article>", "T\na\nb"),
    ("<article><p>a<b>b</b>c <i>d</i>\n\t e&#x41;&lt;p&gt;</article>", "abc d eA<p>"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y<tr><td>z</table><pre>a\n  b</pre></article>", "one\ntwo\nx y\nz\na b"),
    ("<article><h2 class=header>Named</h2><p>1 < 2 & 3 > 2<p>x<a href='/a'>link</a>y</article>", "Named\n1 < 2 & 3 > 2\nxlinky"),
    ("<article><p>a<div class=comments><p>c</div><p>b<p><b>x<br><p>y</article>", "a\nb\nx\ny"),
    ("<p>only words, no container", "only words, no container"),
    ("plain text", "plain text"),
    ("<article><p>cut off <b>in", "cut off in"),
    ("<article><p>a</p></div></span></p><p>b</p></article></article>", "a\nb"),
    ("<article><p title='a > b' data-x=\"</article>\">kept</p></article>", "kept"),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
    ("", ""), ("   ", ""), ("<html><head><title>x</title></head></html>", ""), ("<nav>menu only</nav>", ""),
    ("<div class=content><h1>H</h1><div class=text><p>one</p><p>two</p></div></div><div class=x1><a href=/>l</a></div>", "H\none\ntwo"),
])
def test_blocks(body, want):
    assert _text(body) == want


def test_consensus_of_a_host(spark):
    """A page whose container is small is extracted where the others of its host are; a page alone isn't."""
    page = "<div class=q7><a href=/>x</a></div><div class='k0 p-{}'><p>{}</p></div><div class=z3><p>{}</p></div>"
    rows = [(i, f"http://a.example/{i}", page.format(i, LONG, f"other {i}")) for i in range(9)]
    odd = [(20, "HTTP://A.example:80/x", page.format(20, "short", LONG)), (21, "http://b.example", page.format(21, "short", LONG))]
    none = [(22, None, page.format(22, "short", LONG)), (23, "no url", page.format(23, "short", LONG)), (24, "http://a.example/y", "<div class=new><p>another</div>")]
    df = spark.createDataFrame([(*r, "t", "h", 1, "w") for r in rows + odd + none], SCHEMA)
    got = {r.page_id: r for r in main_text(df).collect()}
    assert all(got[i].text == LONG and got[i].path == "body>div.k0.p-0" for i in range(9))
    assert got[20].text == "short" and got[21].text == got[22].text == got[23].text == LONG and got[24].text == "another"
    won = {r.host: [w.path for w in r.winners] for r in host_paths(df).collect()}
    assert won["a.example"] == ["body>div.k0.p-0"] and won["b.example"][0] == "body>div.z0"


def test_odd_rows(spark):
    long = "<article>" + "<p>" + "x &amp; y " * 200_000 + "</article>"
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    rows = [(1, "http://a.example", None), (None, "http://a.example", ""), (2, None, None), (3, "http://c.example", long), (3, "http://c.example", long), (4, "http://d.example", deep), (5, "", "<" * 50_000), (6, "http://e", "<a b='" * 20_000)]
    df = spark.createDataFrame([(*r, "t", "h", 1, "w") for r in rows], SCHEMA)
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in main_text(df).collect()), key=str)
    text = ("x & y " * 200_000).strip()
    want = [(0, "http://a.example", "", 0), (1, "http://a.example", "", 0), (2, None, "", 0), (3, "http://c.example", text, len(text)), (3, "http://c.example", text, len(text)), (4, "http://d.example", "deep", 4), (5, "", "<" * 50_000, 50_000)]
    assert got[:7] == sorted(want, key=str) and got[7][0] == 6
    assert main_text(df.limit(0)).count() == 0 and host_paths(df.limit(0)).count() == 0


def test_pages_by_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r, got in zip(sorted(pages.collect()), sorted(main_text(pages).collect())):
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        lines = re.sub("<[^>]*>", "", re.sub(r"</?(?:p|h1)>", "\n", inner).replace("<br>", " ")).split("\n")
        want = "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in lines) if x)
        assert (got.page_id, got.url, got.text, got.n_chars, got.path) == (r.page_id, r.url, want, len(want), "body>article")


def test_votes_are_few():
    assert [v[1] for v in votes(ARTICLE)] == ["body>article"] and votes("<nav>x</nav>") == []
