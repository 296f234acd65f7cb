"""The maximum-entropy model against plain loops: counts, base scores, probabilities, gradients."""

import math
import random
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import pytest
from oracle import SF
from pyspark.sql import functions as F

from ruleloom.llm import lm_scoring as lm
from ruleloom.llm import queries


def words(text):
    return [w.lower() for w in cases.WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))] if text is None else cases.WORD.findall(text.translate({i: i + 32 for i in range(65, 91)}))


def base(rows, train):
    """[(id, n_tokens, n_known, train_tokens, base_score)] by the rule."""
    tokens = [[*words(r[1]), " end"] for r in rows]
    c = Counter(t for ts, yes in zip(tokens, train, strict=True) if yes for t in ts)
    n, v = sum(c.values()), len(c)
    return [(r[0], len(ts), sum(t in c for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 6)) for r, ts in zip(rows, tokens, strict=True)]


@pytest.mark.parametrize(("head", "piece"), [(1 << 18, 1 << 20), (8, 64), (0, 1 << 20)])
def test_base_scores_and_counts_equal_plain_python(spark, monkeypatch, head, piece):
    monkeypatch.setattr(lm, "PIECE", piece)
    rows = cases.documents(3)
    df = cases.frame(spark, rows)
    out = lm.score(df, F.col("key") % 3 != 1, rounds=1, head=head).collect()
    want = Counter(base(rows, [r[7] is not None and r[7] % 3 != 1 for r in rows]))
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)


def test_without_training_texts_and_rows(spark):
    rows = cases.documents(3)[:10]
    out = lm.score(cases.frame(spark, rows), F.lit(False), rounds=1).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in out} == {(0, 0, 0.0)} and len(out) == 10
    assert lm.score(cases.empty(spark), F.lit(True), rounds=1).count() == 0


def test_pieces_cut_at_white_space_only(monkeypatch):
    rng = random.Random(4)
    texts = pa.array(["".join(rng.choice("abA \n\t.") for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", "x" * 300, "é" * 40 + " a"], pa.string())
    whole = [np.concatenate(x).tolist() for x in zip(*lm.tokens(texts), strict=True)]
    monkeypatch.setattr(lm, "PIECE", 7)
    parts = [np.concatenate(x).tolist() for x in zip(*lm.tokens(texts), strict=True)]
    assert parts == whole
    assert Counter(whole[1]) == Counter(i for i, t in enumerate(texts.to_pylist()) for _ in words(t))
    # one word, one key, wherever it stands
    a, b = (next(lm.tokens(pa.array([t])))[0].tolist() for t in ("a Be\na", "be a"))
    assert a[0] == a[2] == b[1] and a[1] == b[0]


def small_model(seed=1, n=30):
    rng = np.random.default_rng(seed)
    symbols = [rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint16).tobytes() for _ in range(n)]
    pairs = np.zeros((lm.SYMBOLS + 1, lm.SYMBOLS))
    for x in symbols:
        s, a, *_ = lm._contexts([x])
        np.add.at(pairs, (a, s), 1)
    place = lm.classes(pairs)
    counts = lm.counted(place, iter([symbols])).astype(float)
    return symbols, place, counts, lm.Model(lm.first_weights(counts).astype(np.float32), place)


def test_probabilities_sum_to_one_and_equal_loops():
    symbols, place, counts, model = small_model()
    assert sorted(place[: lm.SYMBOLS]) == list(range(lm.SYMBOLS))
    history = [3, 17, 5]
    texts = [np.array([*history, s], np.uint16).tobytes() for s in range(lm.SYMBOLS)]
    given = model.logs([np.array(history, np.uint16).tobytes()])[0]
    assert sum(10 ** (x - given) for x in model.logs(texts)) == pytest.approx(1, abs=1e-4)

    def plain(x):
        total, seen = 0.0, [lm.START] * 3 + np.frombuffer(x, np.uint16).tolist()
        for i in range(3, len(seen)):
            cls, slot = divmod(int(place[seen[i]]), lm.WIDTH)
            for rows, target in zip(lm.features(*(np.array([seen[i - k]]) for k in (1, 2, 3)), np.array([cls])), (cls, slot), strict=True):
                sums = sum(model.weights[int(r[0])].astype(float) for r in rows)
                total += sums[target] - math.log(np.exp(sums).sum())
        return total / math.log(10)

    assert model.logs(symbols[:4]) == pytest.approx([plain(x) for x in symbols[:4]], rel=1e-4)


def test_gradient_is_the_derivative_of_the_log_likelihood():
    symbols, place, counts, model = small_model(2, 6)
    grad = lm.gradient(model, iter([symbols[:3], symbols[3:]]))
    value = lambda m: m.logs(symbols).sum() * math.log(10)
    for row, k in [(0, int(place[3]) // lm.WIDTH), (1, 2), *np.argwhere(np.abs(grad) > 0.5)[-4:].tolist()]:
        up, down = model.weights.copy(), model.weights.copy()
        up[row, k] += 0.05
        down[row, k] -= 0.05
        assert grad[row, k] == pytest.approx((value(lm.Model(up, place)) - value(lm.Model(down, place))) / 0.1, abs=0.05)


def test_updates_raise_the_likelihood():
    symbols, place, counts, model = small_model(3)
    before = model.logs(symbols).sum()
    for _ in range(3):
        model = lm.Model(lm.update(model.weights.astype(float), counts, lm.gradient(model, iter([symbols])), 1.0).astype(np.float32), place)
    assert model.logs(symbols).sum() > before


def test_unknown_words_share_what_their_class_leaves(spark):
    df = spark.createDataFrame([(1, "red house red"), (2, "blue horse")], "doc_id long, text string")
    lex = lm.lexicon(df)
    assert (lex.total, lex.distinct) == (7, 5)  # four words, an end each
    rare = lm.Lexicon(lex.counts, lex.total, lex.distinct, lex.least, lex.keys[:0], lex.n[:0], lex.mass)
    assert rare.words == 0 and lex.words == 5
    assert lex.mass.tolist() == [1.0] * lm.ENDINGS  # all words are symbols: only the unknown is left


def test_held_out_texts_are_likelier_than_by_counts(spark):
    rows = queries.op11_lm_scoring(spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and held
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and sum(r["score"] > r["base_score"] for r in held) > 0.8 * len(held)
