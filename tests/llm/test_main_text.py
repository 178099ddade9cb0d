"""Main texts of pages of many layouts; consensus of hosts; odd rows."""

import random

import pytest

SCHEMA = "page_id long, url string, html string, host string, paths string, text string"


def alone(source):
    from lodestone.llm.htmltree import Page
    from lodestone.llm.main_text import best_container, container_scores, text_of

    page = Page(source)
    return text_of(page, best_container(container_scores(page)))


PAGES = {
    "layout": (
        '<body class="has-sidebar"><div class="site-header"><a href=/>Home</a> Site</div><div id="wrap"><div class="content-with-sidebar"><h1>Title &amp; more</h1><div class="entry"><p>First, long enough.<br>Second line'
        '<p>Second&nbsp;para <a href=x>link</a> more.</p><div class="ad-slot">Buy!</div><ul><li>one<li>two</ul></div></div><div class="sidebar"><p>side text, longer than all else on the page, really long indeed, so that it wins by length</p></div>'
        '<section id="comments"><h2>Comments</h2><article class="comment"><p>Nice article with a long comment that goes on and on.</p></article></section></div><footer>&copy; x</footer>',
        "Title & more\nFirst, long enough. Second line\nSecond para link more.\none\ntwo",
    ),
    "bare": ('<p>bare <b>text</b><p>more<script>if (a<b) "</p>"</script> end', "bare text\nmore end"),
    "form": ("<form action=x><main><article><header><h1>T</h1><span>by me</span></header><p>Body one.</p><aside>pull</aside><p>Two</p><footer>tags</footer></article></main><input><label>Name</label></form>", "T\nBody one.\nTwo"),
    "sections": ('<div class=x><section><p>part one</p></section><section><p>part two</p></section></div><div class="y"><p>other</p></div><div class="cookie-notice">We use cookies, and this is a very long notice of it.</div>', "part one\npart two"),
    "table": ("<table><tr><td><a href=a>a</a> <a href=b>b</a></td><td><p>Main text in a cell.</p><p>Second.</p></td></tr></table>", "Main text in a cell.\nSecond."),
    "references": ("<article><h1>A</h1><div class=b><p>t &lt;b&gt; &#65;&#x42; &copy q &am</p></div></article>", "A\nt <b> AB © q &am"),
    "broken": ('<article><p title="a>b" class=x>one <!-- <p>no</p> --> two</i></div><p>three <a href="', "one two\nthree"),
    "hidden": ('<article><p>shown</p><p style="display: none">hidden</p><p hidden>also</p><span class="share">Share</span></article><noscript>Turn on scripts</noscript>', "shown"),
    "menus": ("<nav>only</nav><header>a head</header>", ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    source, text = PAGES[name]
    assert alone(source) == text


def test_any_markup_is_read():
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<div class='a b'>", "</div>", "<a href=x", ">", "<!--", "-->", "<script>", "</script>", "&amp;", "&", "<", '"', "text ", "<td>", "</table>", "<b>", "</b>", "<ul><li>", "=", "\x00", "<article>"]
    for _ in range(500):
        alone("".join(rng.choices(bits, k=rng.randrange(40))))
    assert alone("<div>" * 30_000 + "deep") == "deep"
    assert len(alone("<p>" + "word " * 300_000)) == 1_499_999


def test_host_consensus_and_odd_rows(spark):
    from lodestone.llm.main_text import host_paths, main_text

    usual = '<div class="c-%d"><p>the article itself, of some length</p></div><div class="k"><p>%s</p></div>'
    rows = [(i, f"https://Host.example/{i}", usual % (i, "short"), "h", "p", "t") for i in range(8)]
    rows.append((8, "http://host.example/8", usual % (8, "a long talk of readers that outweighs it " * 9), "h", "p", "t"))
    rows += [(9, None, "<p>alone</p>", "h", "p", "t"), (10, "http://other.example", None, "h", "p", "t"), (10, "http://other.example", "", "h", "p", "t"), (None, "no url", "<p>x</p>", "h", "p", "t")]
    table = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in host_paths(table).collect()] == [("host.example", "div.c-#", 8)]
    got = main_text(table).collect()
    article = "the article itself, of some length"
    assert sorted(((r["page_id"] is None, r["page_id"], r["text"]) for r in got), key=str) == sorted([*[(False, i, article) for i in range(9)], (False, 9, "alone"), (False, 10, ""), (False, 10, ""), (True, None, "x")], key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert main_text(table.limit(0)).count() == 0
