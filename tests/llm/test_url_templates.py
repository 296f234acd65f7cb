"""The path-template tree against a plain-Python version and against its SQL."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from oracle import expected, got

from ruleloom.llm import queries, url_filter
from ruleloom.llm.url_filter import LEAST, LEAST_HOSTS, PART, PRIOR, REJECT, UNIT, Rule, Z


def brute(urls, rules):
    """[(template, purity, verdict)] of (host, path) pairs, by loops over dictionaries."""
    hosts = {h for h, _ in urls}
    segs = [[s for s in p.split("/") if s] for _, p in urls]

    def literal(keys):
        n = Counter(keys)
        every, on = Counter(), defaultdict(set)
        for (h, b, k, _), c in n.items():
            every[h, b, k] += c
        for h, _, k, s in n:
            on[k, s].add(h)
        return {(h, b, k, s) for (h, b, k, s), c in n.items() if (c >= LEAST and c * PART >= every[h, b, k]) or (len(on[k, s]) >= LEAST_HOSTS and len(on[k, s]) * PART >= len(hosts))}

    first = literal([(h, "", 0, s[0]) for (h, _), s in zip(urls, segs) if s])
    branch = [(s[0] if (h, "", 0, s[0]) in first else "*") if s else "" for (h, _), s in zip(urls, segs)]
    below = literal([(h, b, k, x) for (h, _), b, s in zip(urls, branch, segs) for k, x in enumerate(s) if k])
    template = ["".join("/" + x for x in [b, *(x if (h, b, k, x) in below else "*" for k, x in enumerate(s) if k)]) if s else "" for (h, _), b, s in zip(urls, branch, segs)]

    def given(h, p):
        fit = [r for r in rules if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        return max(fit, key=lambda r: len(r.host + r.path)).verdict if fit else None

    told, bad, all_ = Counter(), Counter(), Counter()
    for (h, p), t in zip(urls, template):
        all_[h, t] += 1
        told[h, t] += given(h, p) is not None
        bad[h, t] += given(h, p) == "block"
    ups = lambda t: ["/".join(t.split("/")[: i + 1]) for i in range(t.count("/") + 1)]
    it, ib, iu = Counter(), Counter(), Counter()
    for h, t in all_:
        for x in ups(t):
            it[h, x] += told[h, t]
            ib[h, x] += bad[h, t]
            iu[h, x] += all_[h, t]
    votes = defaultdict(list)
    for h, x in iu:
        if it[h, x] and 2 * it[h, x] >= iu[h, x]:
            votes[x].append(ib[h, x] * UNIT // it[h, x])
    overall = sum(bad.values()) / sum(told.values()) if sum(told.values()) else 0.0

    def prior(t):
        p = overall
        for x in ups(t):
            if votes[x]:
                p = (sum(votes[x]) / UNIT + PRIOR * p) / (len(votes[x]) + PRIOR)
        return p

    heard = [k for k in all_ if told[k] and 2 * told[k] >= all_[k]]
    shape = lambda t: re.sub("/[^/]+", "/*", t)
    sums = defaultdict(lambda: [0, 0])
    for h, t in heard:
        sums[h, shape(t)][0] += bad[h, t]
        sums[h, shape(t)][1] += told[h, t]
    group = {}
    for h, t in heard:
        b, n = sums[h, shape(t)]
        p = b / n
        near = abs(bad[h, t] / told[h, t] - p) <= Z * math.sqrt(max(p * (1 - p), 1e-4) / told[h, t])
        group[h, t] = (h, shape(t), "" if near else t)
    pool = defaultdict(lambda: [0, 0])
    for k in heard:
        pool[group[k]][0] += bad[k]
        pool[group[k]][1] += told[k]
    out = []
    for (h, p), t in zip(urls, template):
        b, n = pool[group[h, t]] if (h, t) in group else (0, 0)
        purity = (b + PRIOR * prior(t)) / (n + PRIOR)
        out.append((t, purity, given(h, p) or ("block" if round(purity, 6) >= REJECT else "allow")))
    return out


def random_urls(rng):
    names, out = ["news", "shop", "user", "tag"], []
    for h in range(14):
        host = f"h{h}.{'bad' if h % 3 else 'free'}.org"
        for _ in range(rng.randrange(1, 40)):
            path = "/" + rng.choice(names + [str(rng.randrange(99))]) if rng.random() < 0.95 else ""
            for _ in range(rng.choice([0, 1, 2, 7])):
                path += "/" + rng.choice(["", "list", "item", str(rng.randrange(9)), str(rng.randrange(9999))])
            out.append((host, path))
    return out


def test_templates_purities_and_verdicts_equal_plain_python(spark):
    rng, free = random.Random(3), Counter()
    rules = (Rule("block", "bad.org", "/shop/"), Rule("allow", "bad.org"), Rule("block", "h0.free.org", "/user/1"))
    for _ in range(3):
        urls = random_urls(rng)
        rows = [(i, f"http://{h}{p}?q") for i, (h, p) in enumerate(urls)]
        found = sorted(url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect(), key=lambda r: r["page_id"])
        want = brute(urls, rules)
        assert [(r["template"], r["verdict"]) for r in found] == [(t, v) for t, _, v in want]
        assert all(abs(r["purity"] - p) < 2e-6 for r, (_, p, _) in zip(found, want))
        free.update(r["verdict"] for r in found if r["rule"] is None)
    assert free["block"] and free["allow"]


def test_segments_at_any_depth_tell_templates_apart(spark):
    deep = "/a/b/c/d/e/f/g/"
    urls = [f"http://h{h}.org{deep}{kind}/{h}x{i}" for h in range(9) for kind in ("ads", "news") for i in range(40)]
    rules = tuple(Rule(v, f"h{h}.org", deep + k) for h in range(8) for k, v in (("ads", "block"), ("news", "allow")))
    out = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).where("rule is null").collect()
    assert {(r["host"], r["template"], r["verdict"]) for r in out} == {("h8.org", deep + "ads/*", "block"), ("h8.org", deep + "news/*", "allow")}
    very = spark.createDataFrame([(i, "http://x.org" + "/s" * 3000 + f"/{i}") for i in range(5)], "page_id long, url string")
    assert {r["template"] for r in url_filter.judge(very).collect()} == {"/s" * 3000 + "/*"}


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_query_equals_sql_and_decides_both_ways(spark, scale):
    sf = f"/root/testdata/sf{scale}"
    out = queries.op3_url_templates(spark, sf)
    assert got(out) == expected(queries.OP3_SQL, sf)
    if scale == "0.01":
        assert {r["verdict"] for r in out.where("rule is null").select("verdict").distinct().collect()} == {"allow", "block"}
