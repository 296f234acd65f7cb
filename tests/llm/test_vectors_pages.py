import random
from collections import Counter

import cases
import numpy as np

from ruleloom.llm import embedding_dedup, html_extract, url_filter


def planted(n=900, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for i in range(0, n, 3):  # near copies, some far enough, some exact
        x[i] = x[i // 7] + rng.standard_normal(d) * rng.choice([0.0, 0.05, 0.1, 0.2])
    x[100:160] = x[5] + rng.standard_normal((60, d)) * 0.05
    return x


def test_near_duplicates_recall_and_exactness(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "STORED", 40)
    monkeypatch.setattr(embedding_dedup, "VISITING", 150)
    x = planted()
    labels = [i % 3 if i % 11 else None for i in range(len(x))]
    rows = [(i, x[i].astype("f4").tolist(), labels[i], "x") for i in range(len(x))]
    odd = [(1000, None, 1, ""), (1001, [], 1, ""), (1002, [0.0] * 16, 1, ""), (1003, [float("nan")] * 16, 1, ""), (1004, [None] * 16, 1, ""), (1005, [1.0, 2.0], 1, ""), (1006, [1.0, 2.0], 1, ""), (None, rows[4][1], 1, ""), (1007, rows[4][1], None, "")]
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int, id string")).collect()}
    unit = np.array([r[1] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    same = np.array([[a is not None and a == b for b in labels] for a in labels])
    link = (unit @ unit.T >= 0.93) & same
    np.fill_diagonal(link, False)
    total = sum(out[i]["n_links"] for i in range(len(x)))
    assert 0.97 * link.sum() <= total <= link.sum()
    assert all(out[i]["n_links"] <= link[i].sum() for i in range(len(x)))
    g = cases.Groups()
    for a, b in np.argwhere(link).tolist():
        g.link(a, b)
    whole = {i: g.find(i) for i in range(len(x))}
    assert sum(out[i]["component_id"] == whole[i] for i in range(len(x))) >= 0.97 * len(x)
    assert all(out[i]["kept"] == (out[i]["component_id"] == i) for i in range(len(x)))
    for i in (1000, 1001, 1002, 1003, 1004, 1007):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)
    assert (out[1005]["n_links"], out[1006]["component_id"]) == (1, 1005)
    assert (out[None]["n_links"], out[None]["component_id"], out[None]["kept"]) == (0, None, False)


def test_near_duplicates_of_nothing(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_multi_sequence_visits_nearest_cells_first():
    rng = random.Random(0)
    a, b = sorted(rng.random() for _ in range(6)), sorted(rng.random() for _ in range(6))
    order = embedding_dedup.multi_sequence(a, b, list(range(6)), list(range(6)), 6, 36)
    assert sorted(order) == list(range(36))
    cost = [a[c // 6] + b[c % 6] for c in order]
    assert cost == sorted(cost)


def test_rank_is_the_place_in_the_traversal():
    rng = random.Random(1)
    a, b = (np.array([rng.random() for _ in range(7)]) for _ in "ab")
    ia, ib = np.argsort(a), np.argsort(b)
    order = embedding_dedup.multi_sequence(a[ia].tolist(), b[ib].tolist(), ia.tolist(), ib.tolist(), 7, 49)
    assert [embedding_dedup.rank(a, b, c // 7, c % 7) for c in order] == list(range(49))


def test_labels_take_codebooks_of_their_own_size(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAST", 500)
    rng = np.random.default_rng(2)
    sizes = {1: 3_000, 2: 300, 3: 2}
    rows, n = [], 0
    for label, size in sizes.items():
        x = rng.standard_normal((size, 16))
        half = size // 2
        x[half : 2 * half] = x[:half] + rng.standard_normal((half, 16)) * 0.12
        rows += [(n + i, v.tolist(), label) for i, v in enumerate(x)]
        n += size
    made = []
    fit = embedding_dedup.fit
    monkeypatch.setattr(embedding_dedup, "fit", lambda x, k, *a: made.append((k, len(x))) or fit(x, k, *a))
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sorted(k for k, _ in made) == [4, 8] and all(len_ < 3_000 for _, len_ in made)
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    queries = np.arange(0, len(rows), 20)
    link = (unit[queries] @ unit.T >= 0.93) & (label[queries][:, None] == label[None, :])
    link[np.arange(len(queries)), queries] = False
    found = sum(out[int(q)]["n_links"] for q in queries)
    assert 0.9 * link.sum() <= found <= link.sum() and link.sum() > 50


URLS = [
    ("http://A.b.NET/x?y#z", "a.b.net", "/x", "net/", "block"),
    ("https://example.net/en/1", "example.net", "/en/1", "example.net/en/", "allow"),
    ("https://m.example.net/en", "m.example.net", "/en", "net/", "block"),
    ("https://xexample.net/en/", "xexample.net", "/en/", "net/", "block"),
    ("ftp://example.com/de/a://b", "example.com", "/de/a://b", "example.com/de/", "block"),
    ("https://www.x.org/fr/", "www.x.org", "/fr/", "org/fr/", "allow"),
    ("https://net", "net", "", None, None),
    ("https://net?/", "net", "", None, None),
    ("HTTPS://É.ORG#/fr/", "É.org", "", None, None),
    ("no scheme", "", "", None, None),
    (":///path", "", "/path", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
]


def test_url_parts_and_rules(spark):
    rows = [(i, u, 1) for i, (u, *_) in enumerate(URLS)]
    rows += [(None, URLS[0][0], 2), rows[0]]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host int")).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["page_id"] is not None:
            _, host, path, rule, verdict = URLS[r["page_id"]]
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_impure_templates_are_rejected(spark):
    rules = (url_filter.Rule("block", "h.com", "/bad/1"), url_filter.Rule("allow", "h.com", "/good/1"))
    urls = [f"http://h.com/bad/{i}" for i in range(1000, 1999)] + [f"http://h.com/bad/{i}" for i in range(2000, 2100)] + [f"http://h.com/good/{i}" for i in range(1000, 1999)] + ["http://h.com/good/2", "http://other.com/x/3"]
    out = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert out[1050]["rule"] is None and out[1050]["verdict"] == "block" and out[1050]["template"] == "/bad/*"
    assert out[len(urls) - 2]["verdict"] == out[len(urls) - 1]["verdict"] == "allow"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu {0}</a></li></ul></nav>
<div class="ad">Buy {0}</div><div class="cookie-notice">We use cookies</div><{1}><h1>Title {0}</h1><p><b>First &amp; {0}<br>line<p>Second&nbsp;  {0}
more<ul><li>item</li><li>thing</li></ul><form><p>Sign up</p></form><section class="comments"><p>nice</p></section></{2}><aside>See also</aside><footer>&copy; me</footer></body></html>"""


def test_main_text_of_marked_and_unmarked_pages(spark):
    want = "Title {0}\nFirst & {0} line\nSecond {0} more\nitem\nthing"
    rows = [(i, f"http://a.org/{i}", PAGE.format(i, "article", "article")) for i in range(5)]
    rows += [(10 + i, f"http://b.org/{i}", PAGE.format(i, 'div class="post"', "div")) for i in range(5)]
    rows += [(20, "http://c.org/", None), (21, None, "<p>plain"), (22, "x", ""), (23, "http://c.org/2", "<nav>only menu</nav>"), rows[0]]
    out = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter(r["page_id"] for r in out) == Counter(r[0] for r in rows)
    text = {r["page_id"]: r["text"] for r in out}
    for i in range(5):
        assert text[i] == text[10 + i] == want.format(i)
    assert (text[20], text[21], text[22], text[23]) == ("", "plain", "", "")
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_same_article_on_several_pages_of_a_host_stays(spark):
    rows = [(i, "http://a.org/", PAGE.format(7, "article", "article")) for i in range(4)]
    out = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"].startswith("Title 7\nFirst & 7") for r in out)


def test_matching_aligns_inserted_siblings():
    a, b = html_extract.parse("<div><p>a</p><ul><li>x</li></ul></div>"), html_extract.parse("<div><h1>n</h1><p>b</p><p>c</p><ul><li>y</li><li>z</li></ul></div>")
    size, pairs = html_extract.match(a, b)
    assert size == 5 and [(x.tag, y.tag) for x, y in pairs] == [("#root", "#root"), ("div", "div"), ("p", "p"), ("ul", "ul"), ("li", "li")]


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 10
    rows = [(1, "http://d.org/1", deep), (2, "http://d.org/2", deep.replace("deep", "other")), (3, "http://d.org/3", "<p>a<b>b</p></i></div>c<!-- x --><![CDATA[y]]><"), (4, "http://d.org/4", "&#x41;&unknown;&lt;p&gt;")]
    text = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (text[1], text[2]) == ("deep text", "other text")
    assert text[3].startswith("ab\nc") and text[4] == "A&unknown;<p>"
