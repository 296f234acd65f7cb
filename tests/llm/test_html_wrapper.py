"""Wrapper induction: the alignment against brute force, and what the wrapper and the template decide."""

import random
from functools import cache

from ruleloom.llm import html_extract
from ruleloom.llm.html_extract import Node


def tree(rng, depth):
    n = Node(rng.choice("ab"))
    n.kids = [tree(rng, depth - 1) for _ in range(rng.randrange(4))] if depth else []
    return n


def naive(a, b):
    """Size of the largest match, straight from the definition."""
    if a.tag != b.tag:
        return 0

    @cache
    def best(i, j):
        if not i or not j:
            return 0
        return max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + naive(a.kids[i - 1], b.kids[j - 1]))

    return 1 + best(len(a.kids), len(b.kids))


def parents(n):
    return {id(k): n for k in n.kids} | {x: y for k in n.kids for x, y in parents(k).items()}


def test_match_is_the_largest_one(monkeypatch):
    rng = random.Random(5)
    for cells in (1 << 22, 4):
        monkeypatch.setattr(html_extract, "CELLS", cells)
        for _ in range(150):
            a, b = tree(rng, 4), tree(rng, 4)
            size, pairs = html_extract.match(a, b)
            assert size == len(pairs) == naive(a, b)
            up_a, up_b = parents(a), parents(b)
            partner = {id(x): y for x, y in pairs}
            assert len({id(y) for _, y in pairs}) == size
            for x, y in pairs:
                assert x.tag == y.tag
                assert x is a or partner[id(up_a[id(x)])] is up_b[id(y)]


def texts(spark, pages):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    return [r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_slots_decide_and_template_goes_with_or_without_an_article(spark):
    page = "<body><div><p>Site of things</p></div><{0}><div>Share this</div><h1>Title {1}</h1><p>Text number {1} of the page.</p><p>More {1}</p><div>Read on, all of you</div></{0}><div><p>Made by us</p></div></body>"
    pages = [(f"http://{tag}.org/{i}", page.format(tag, i)) for tag in ("div", "article") for i in range(24)]
    for i, text in enumerate(texts(spark, pages)):
        assert text == "Title {0}\nText number {0} of the page.\nMore {0}".format(i % 24)


def test_an_article_with_little_of_the_varying_text_is_not_the_wrapper(spark):
    page = "<body><article>n {0}</article><div><p>{1}</p><p>{2}</p></div></body>"
    pages = [("http://x.org/", page.format(i, f"long text {i} " * 9, f"other text {i} " * 9)) for i in range(8)]
    for i, text in enumerate(texts(spark, pages)):
        assert text == f"long text {i} " * 8 + f"long text {i}\n" + f"other text {i} " * 8 + f"other text {i}"


def test_no_width_or_depth_is_out_of_reach(spark):
    wide = "<body>" + "".join(f"<div><p>fixed {i}</p></div>" for i in range(90)) + "<div><div><p>main {0}</p><p>text {0}</p></div></div></body>"
    deep = "<body><p>fixed</p>" + "<div><p>fixed</p>" * 40 + "<div><p>main {0}</p><p>text {0}</p></div>" + "</div>" * 40 + "<p>end</p></body>"
    pages = [(f"http://{h}.org/{i}", html.format(i)) for h, html in (("wide", wide), ("deep", deep)) for i in range(22)]
    assert texts(spark, pages) == [f"main {i}\ntext {i}" for _ in range(2) for i in range(22)]


def test_nothing_else_goes_from_an_article(spark):
    inside = '<p id="share">a{0}</p><p class="side-note">b{0}</p><p class="related">c{0}</p><p>d <math><mi>x{0}</mi></math> <button>e{0}</button></p><div class="comments">no</div><form>no</form><aside>no</aside>'
    pages = [("http://x.org/", f"<body><nav>m{i}</nav><article>{inside.format(i)}</article></body>") for i in range(24)]
    assert texts(spark, pages) == ["a{0}\nb{0}\nc{0}\nd x{0} e{0}".format(i) for i in range(24)]


def test_a_marked_container_of_the_article_is_no_boilerplate(spark):
    pages = [("http://x.org/", f'<body><div class="has-sidebar"><div class="nav">menu</div><article><p>text {i}</p></article></div></body>') for i in range(3)]
    assert texts(spark, pages) == [f"text {i}" for i in range(3)]


def test_copies_of_a_page_keep_their_text(spark):
    page = "<body><nav>menu {1}</nav><article><h1>Same</h1><p>The same long text on every page {0}.</p></article></body>"
    assert texts(spark, [("http://y.org/", page.format("", i)) for i in range(20)]) == ["Same\nThe same long text on every page ."] * 20
    few = [("http://x.org/", page.format(i, i)) for i in range(20)]
    assert texts(spark, few) == [f"Same\nThe same long text on every page {i}." for i in range(20)]


def test_no_markup_raises_or_stays_as_text():
    import random

    from ruleloom.llm import html_extract

    said = {"a<![foo[bar]]>b": "ab", "<p>x</p><!foo": "x", "<p>x</p><![": "x", "a<?b": "a", '<p>a</p><div class="x': "a", "<!-->x": "x", "<!--->y<!-- z --!>w": "yw", "<![CDATA[q]]>r": "r", "a<!-- b": "a", "</ >d": "d"}
    assert {h: "|".join(html_extract.blocks(html_extract.parse(h))) for h in said} == said
    rng = random.Random(1)
    parts = ["<", "<!", "<![", "]]>", "-->", "<!--", ">", "</", "p", "div", "&", "#", "x41;", "=", '"', "'", " ", "a", "<?", "/", "<script>", "</p>", "<p>", "\x00", "é", "[", "]", "!", "-", "class", "article"]
    for _ in range(5000):
        h = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        html_extract.votes(h, "<p>a</p>")
        assert isinstance(html_extract.extract(h, h, 0), str)


def test_a_class_names_a_part_as_a_whole_only():
    from ruleloom.llm.html_extract import blocks, parse

    page = '<article><div class="comments-on-law"><p>Essay text</p></div><p class="header-note">note</p><p class="big notice">n</p><div class="comments">no</div><div class="site-footer">no</div></article>'
    assert blocks(parse(page)) == ["Essay text", "note"]
