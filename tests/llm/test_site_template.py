"""The page walker on odd markup, and templates by count, by both ways of handing them to the pages."""

import pytest

from quarryline.llm import site_template

CASES = [
    ("", ""),
    ("plain & simple", "plain & simple"),
    ("<p>a<b>b</b>c</p> d <a title=\"x>y\">z</a> <div", "abc d z"),
    ("<p>one<br>two<p>three&nbsp;four<ul><li>a<li>b</ul>", "one two three four a b"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ("<article><h1>T &lt; x</h1><p>text</article><p>after", "T < x text"),
    ("<main><p>m</main><p>after", "m"),
    ("<div role=main><p>m</div><p>after", "m"),
    ("<nav><p>menu</nav><header>H</header><p>a</p><footer>f</footer><aside>s</aside>", "a"),
    ("<article><header><h1>T</h1></header><p>a<div class=share-buttons>s</div><section id=comments><article class=comment><p>c</article></section></article>", "T a"),
    ("<body class='has-sidebar no-ads'><div class='cookie-banner'>c</div><div id=header>H</div><p>a", "a"),
    ("<div class=ad>x<article><p>kept</article>", "kept"),
    ("<aside>rel <article><p>teaser</p></article></aside><article>a</article><article>b</article>", "a b"),
    ("<script>var t='</p>';if(a<b){}</script><style>p{}</style><noscript>n</noscript><p>a<!-- c --><!-- open <p>b", "a"),
    ("<head><title>t</title><p>a", "a"),
    ("<p>x</div></b></p>y<b>z", "x yz"),
    ("<form><label>l</label><select><option>o</select></form><button>b</button>a &amp b &#x41; &am", "a & b A &am"),
    ("<svg><path/><text>s</text></svg><p title='a\">b", "b"),
    ("<article><p>a <span class='ad'>x</span>b <a class='share-link' href=y>s</a><em class=key>c</em></p><ul class='social-links'><li>t</ul></article>", "a b c"),
    ("<a class=skip-link>skip</a><div class=notices><p>n</div><p>a", "a"),
    ("<div>" * 3000 + "deep", "deep"),
    ("<b>" * 3000 + "deep" + "</i>" * 3000, "deep"),
]


@pytest.mark.parametrize("page,text", CASES, ids=range(len(CASES)))
def test_extract(page, text):
    assert site_template.extract(page) == (text, 0)
    site_template.subtrees(page)


def test_hashes_cover_text_and_names_only():
    a, b, c = (site_template.subtrees_of(x) for x in ("<div class=a><p>x y</div>", "<div id=b><p> x\ny </p></div>", "<div><p>x z</div>"))
    assert a == b and not a & c


def pages_of_two_sites():
    """Menus without any mark, in boxes: known by count alone. A passage and copies within articles stay."""
    menu = "<div><span>Start</span><span>Contact us</span></div>"
    box = "<div>Read our other site</div>"
    shared = "<p>A passage that very many articles share, word for word.</p>"
    pages = []
    for i in range(40):
        pages.append((i, f"https://one.example/{i}", f"<body>{menu}<article><h1>Title {i}</h1>{shared}<p>Own words {i}</p>{box}<div>Copy of a list</div></article></body>" if i < 30 else f"<body>{menu}<article><h1>Same</h1><p>Same text</p><div>Not a box</div></article></body>", "x"))
    pages += [(100 + i, f"http://user@TWO.example:80/{i}?q", f"<div>{menu}<p>Text number {i} of the second site</p></div>", "x") for i in range(5)]
    pages += [(200, "http://three.example/", f"<div>{menu}<p>Only page</p></div>", "x"), (201, None, f"{menu}<p>no url</p>", "x"), (202, "http://one.example/", None, "x"), (None, "nonsense", "<p>a", "x"), (202, "http://one.example/", None, "x")]
    return pages


@pytest.mark.parametrize("at_once", [site_template.AT_ONCE, 0])
def test_templates_by_count(spark, at_once):
    docs = spark.createDataFrame(pages_of_two_sites(), "page_id long, url string, html string, host string").repartition(5)
    got = {(r["page_id"], r["url"]): (r["text"], r["n_recurring"]) for r in site_template.main_texts(docs, at_once=at_once).collect()}
    # the menu stands beside 31 different main texts of the first site; so does the box in 30 of 40 articles, and the list
    assert got[3, "https://one.example/3"] == ("Title 3 A passage that very many articles share, word for word. Own words 3", 3)
    # copies are one main text, so nothing of theirs but the menu is a template
    assert got[35, "https://one.example/35"] == ("Same Same text Not a box", 1)
    assert got[102, "http://user@TWO.example:80/2?q"] == ("Text number 2 of the second site", 1)
    assert got[200, "http://three.example/"] == ("StartContact us Only page", 0) and got[201, None] == ("StartContact us no url", 0)
    assert got[202, "http://one.example/"] == ("", 0) and got[None, "nonsense"] == ("a", 0)
    assert site_template.main_texts(docs, at_once=at_once).count() == docs.count()
