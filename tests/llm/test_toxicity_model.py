"""The Kneser-Ney tables and the evidence of a text against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest

from ruleloom.llm import toxicity
from ruleloom.llm.toxicity import CONTEXT, DISCOUNT, POWER, SHARE, WORD


def letters(texts):
    out = Counter()
    for text in texts:
        for word in WORD.findall((text or "").lower()):
            s = f"^{word}$"
            for i in range(1, len(s)):
                out[s[max(0, i - CONTEXT) : i], s[i]] += 1
    return out


class Plain:
    """Interpolated Kneser-Ney by recursion: own counts of the longest context, shared continuation counts below."""

    def __init__(self, ordinary, toxic):
        self.own = [letters(ordinary), letters(toxic)]
        self.after = defaultdict(lambda: defaultdict(set))  # shorter context -> letter -> the longer contexts before it
        for context, letter in {*self.own[0], *self.own[1]}:
            for m in range(len(context)):
                self.after[context[len(context) - m :]][letter].add(context)
        self.n_letters = len(self.after[""]) + 1

    def shared(self, context, letter):
        lower = self.shared(context[1:], letter) if context else 1 / self.n_letters
        here = self.after.get(context)
        if not here:
            return lower
        total = sum(map(len, here.values()))
        return (max(len(here.get(letter, ())) - DISCOUNT, 0) + DISCOUNT * len(here) * lower) / total

    def p(self, k, context, letter):
        here = {x: n for (c, x), n in self.own[k].items() if c == context}
        lower = self.shared(context[1:], letter)
        if not here:
            return lower
        total = sum(here.values())
        return max(here.get(letter, 0) - DISCOUNT, 0) / total + DISCOUNT * len(here) / total * lower

    def ratio(self, word):
        s, total = f"^{word}$", 0.0
        for i in range(1, len(s)):
            context = s[max(0, i - CONTEXT) : i]
            total += math.log(self.p(1, context, s[i]) / self.p(0, context, s[i]))
        return total

    def evidence(self, text):
        words = WORD.findall((text or "").lower())
        if not words:
            return 0.0
        toxic = [math.log((1 - SHARE) + SHARE * math.exp(self.ratio(w))) for w in words]  # against 1, the ordinary likelihood
        return sum(toxic) / len(words) ** POWER


def corpus(rng, n=60):
    plain, bad = ["thing", "house", "there", "oth\u00e9r", "and", "of"], ["grubby", "grubbier", "vile"]
    rows = [(i, " ".join(rng.choice(bad if i % 4 == 0 and rng.random() < 0.3 else plain) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(1, 30))), int(i % 4 == 0)) for i in range(n)]
    return [*rows, (n, None, 0), (n + 1, "", 1), (n + 2, "123 !?", 0)]


def test_tables_equal_plain_python(spark):
    rows = corpus(random.Random(4))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    want = Plain([t for _, t, y in rows if not y], [t for _, t, y in rows if y])
    words = ["grubby", "grubs", "house", "housing", "vile", "th\u00e9", "zebra", "andofand", "x"]
    assert model.expressions(words) == pytest.approx([want.ratio(w) for w in words], abs=1e-4)
    for text in ["the house of things", "a grubby house, vile", "grubbier grubbiest " * 9, "", None, "12"]:
        assert model.evidence(text, {}) == pytest.approx(want.evidence(text), abs=1e-3)


def test_every_labelled_text_is_counted_whatever_the_sample(spark):
    rows = corpus(random.Random(5), 80)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    whole, few = toxicity.train(df), toxicity.train(df, sample=3)
    assert few.expressions(["grubby", "vile"]) == whole.expressions(["grubby", "vile"])
    assert few.weights != whole.weights


def test_repeated_rows_do_not_swell_the_sample(spark):
    rows = [(1, f"text {i % 3}", 0) for i in range(50)] + [(2, "grub", 1)] * 50
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), sample=2)
    assert model.expressions(["grub"])[0] > 0 > model.expressions(["text"])[0]


def test_memory_is_bounded_and_changes_nothing(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 2)
    memory = {}
    model = toxicity.Model()
    for text in ("a b c d e", "f g", "a b"):
        assert model.evidence(text, memory) == pytest.approx(0.0)
    assert len(memory) <= 5


def test_a_full_cell_keeps_its_commonest_row(spark, monkeypatch):
    rows = spark.createDataFrame([(0, "a", 1.0, 3), (0, "b", 2.0, 9), (1, "a", 3.0, 1)], "model int, s string, ratio double, n long")
    monkeypatch.setattr(toxicity, "CELLS", 1)
    found = toxicity._fetched(rows, "s")
    assert {m: t.values.tolist() for m, t in found.items()} == {0: [2.0], 1: [3.0]}


@pytest.mark.parametrize("cells", [0, 40])
def test_rows_that_are_not_sent_are_joined(spark, monkeypatch, cells):
    """Every text has the same score however few rows of the tables are sent."""
    df = spark.createDataFrame(corpus(random.Random(7)), "doc_id long, text string, toxic int")
    asked = spark.createDataFrame([(1, "grubbiest houses of the vile zebra"), (1, "grubby grubby andofand"), (None, None), (3, ""), (4, "12"), (None, "the oth\u00e9r thing"), (None, "the oth\u00e9r thing")], "doc_id long, text string")
    found = lambda model: sorted((r.doc_id or 0, r.score, r.predicted) for r in toxicity.score(asked, model).collect())
    whole = toxicity.train(df)
    want = found(whole)
    monkeypatch.setattr(toxicity, "CELLS", cells)
    few = toxicity.train(df)
    got = found(few)
    assert len(few.seen.keys) <= cells < len(whole.seen.keys)
    assert few.weights == pytest.approx(whole.weights, rel=1e-3)
    assert [(i, p) for i, _, p in got] == [(i, p) for i, _, p in want] and [s for _, s, _ in got] == pytest.approx([s for _, s, _ in want], abs=1e-4)


def test_rows_of_one_cell_are_both_sent_below_the_bound(spark, monkeypatch):
    rows = spark.createDataFrame([(0, f"s{i}", float(i), 1) for i in range(60)], "model int, s string, ratio double, n long")
    monkeypatch.setattr(toxicity, "CELLS", 64)
    found = toxicity._fetched(rows, "s")[0]
    assert found.whole and sorted(found.values.tolist()) == [float(i) for i in range(60)]


def test_the_likelihoods_decide_alone(spark):
    rng = random.Random(6)
    plain = [" ".join(rng.choice(["house", "tree", "river", "stone", "field"]) for _ in range(60)) for _ in range(40)]
    toxic = [t + " grubby " + t + " vilest" for t in plain[:20]]
    df = spark.createDataFrame([(i, t, int(i >= 40)) for i, t in enumerate(plain + toxic)], "doc_id long, text string, toxic int")
    model = toxicity.train(df)
    assert len(model.weights) == 2 and model.weights[0] > 0  # a slope and a bias: nothing but the likelihoods
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert sum(got[i] for i in range(40)) <= 1 and sum(got[i] for i in range(40, 60)) >= 19
