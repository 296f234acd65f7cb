import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ruleloom.functions import keys, providers, salvage, text
from ruleloom.operators import constraints, ranking


def natural(s):
    return [(1, int(p)) if p[0].isdigit() else (0, p) for p in re.findall(r"[0-9]+|[^0-9]+", s.lower())]


def test_natural_order(spark):
    words = ["a10", "a2", "a", "10", "2", "b1x20", "b1x3", "B01", "a002", "", "x9y", "x10y"]
    rows = spark.createDataFrame([(w,) for w in words], "s string").orderBy(keys.natural_key("s"), "s").collect()
    assert [r["s"] for r in rows] == sorted(words, key=lambda w: (natural(w), w))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("ab", min_size=1, max_size=3), st.integers(), max_size=3), st.text("x y\n", max_size=8), st.text("x y\n", max_size=8))
def test_readers_find_one_object_in_prose(value, before, after):
    raw = json.dumps(value)
    for answer in (before + raw + after, f"{before}\n```json\n{raw}\n```\n{after}"):
        assert salvage.first_fenced(answer) == value
        assert salvage.last_object(answer) == value
        assert salvage.greedy(answer) == value


def test_readers_differ():
    two = '{"a": 1} and {"b": 2}'
    assert (salvage.first_fenced(two), salvage.last_object(two), salvage.greedy(two)) == (None, {"b": 2}, None)
    assert salvage.last_object('```json\n{"a": 1}\n``` then {"b": 2}') == {"b": 2}  # the whole text's objects come after the fences'
    assert salvage.first_fenced("```\nno\n```\n```\n{\"c\": 3}\n```") == {"c": 3}
    assert salvage.first_fenced(None) is salvage.last_object(None) is salvage.greedy(None) is None


def test_endpoint_and_template():
    assert text.endpoint("http://x/v1/", "/embeddings") == "http://x/v1/embeddings" == text.endpoint("http://x/v1/embeddings", "/embeddings")
    for bad in ("no", "{p} {p}"):
        try:
            text.fill_template(bad, "{p}", None)
            raise AssertionError
        except ValueError:
            pass


def test_soft_floor_against_python(spark):
    rows = [(q, r, s / 10) for q in range(6) for r, s in enumerate(sorted((q * 7 + i * 3) % 10 for i in range(q)), 1)]
    df = spark.createDataFrame(rows, "q int, rank int, score double")
    found = {(r["q"], r["rank"]) for r in ranking.soft_floor(df, ["q"], "score", "rank", 0.5, 2).collect()}
    want = set()
    for q in range(6):
        mine = [(r, s) for k, r, s in rows if k == q]
        passed = [r for r, s in mine if s >= 0.5]
        want |= {(q, r) for r in (passed if len(passed) >= 2 else [r for r, _ in mine if r <= 2])}
    assert found == want


def test_enforce(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    try:
        constraints.enforce(constraints.unique(df, "id"))
        raise AssertionError
    except ValueError as e:
        assert "unique: 1 (2)" in str(e)
    constraints.enforce(constraints.unique(df.distinct(), "id"))


def test_retries():
    import urllib.error

    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise urllib.error.HTTPError("u", 503, "busy", {}, None)
        return {"ok": 1}

    assert providers.with_retries(call, 3, sleep=waits.append) == {"ok": 1} and waits == [1.0, 2.0]
    calls.clear()

    def fatal():
        calls.append(1)
        raise urllib.error.HTTPError("u", 401, "no", {}, None)

    try:
        providers.with_retries(fatal, 3, sleep=waits.append)
        raise AssertionError
    except urllib.error.HTTPError:
        assert len(calls) == 1


def test_embedder_is_deterministic_and_unit():
    e = providers.HashEmbedder()
    a, b = e.embed(["some words", ""]), e.embed(["some words", ""])
    assert a == b and all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in a)


def test_last_object_prefers_the_whole_text_to_its_fences():
    from ruleloom.functions.salvage import greedy, last_object

    assert last_object('```json\n{"a":1}\n```\nthen {"b":2}') == {"b": 2}
    assert last_object('{"b":2} then ```json\n{"a":1}\n```') == {"a": 1}
    assert last_object("nothing {") is None and last_object(None) is None
    assert greedy('x {"a":1} y') == {"a": 1}
