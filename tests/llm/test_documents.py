"""The document operators against brute force, on odd cases and on the small table."""

import hashlib
import random
import zlib
from collections import Counter

import cases
import numpy as np
import public_tokenizers
import pytest
from oracle import SF, expected, got
from pyspark.sql import functions as F

from ruleloom.llm import bpe, mixing, ngram_join, quality, queries, sharding, toxicity
from ruleloom.llm import line_dedup as lines_module
from ruleloom.llm.line_dedup import line_dedup, rest_keys, shorter_ones, within

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 60), (2, 100)])
def test_ngram_join_equals_all_pairs(spark, width, percent):
    rows = cases.documents(width)
    out = ngram_join.ngram_jaccard_components(cases.frame(spark, rows), width=width, percent=percent).collect()
    want, texts = cases.jaccard_groups(rows, width, percent), {r[0]: r[1] for r in rows if r[0] is not None}
    assert len(out) == len(rows)
    for r in out:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        if r["doc_id"] is not None:
            assert r["n_shingles"] == len(cases.shingles(texts[r["doc_id"]], width))


def test_ngram_join_of_sets_near_the_threshold(spark):
    rng, rows = random.Random(9), []
    for n in (9, 10, 11, 18, 19, 20, 37, 60, 120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for cut in range(0, n // 5):
            rows.append((len(rows), " ".join(base[cut:])))
            rows.append((len(rows), " ".join([*base[: n - cut], *(f"v{rng.randrange(10**6)}" for _ in range(cut // 2))])))
    out = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=1, percent=90).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == cases.jaccard_groups(rows, 1, 90)


def test_ngram_join_links_through_members_far_from_the_first(spark):
    # a chain: each text links with the next only
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[i * 4 : 100 + i * 4])) for i in range(60)]
    out = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=1, percent=90).collect()
    assert {r["component_id"] for r in out} == {0}


@pytest.mark.parametrize("options", [{}, {"chunk": 50, "overlap": 10}, {"chunk": 7, "overlap": 2}])
def test_bpe_equals_whole_encoding_and_decodes(spark, options):
    rows = [*cases.documents(4), (900, "a" * 300 + " " * 120 + "\n\n\n" + "b'll " * 30 + "\x1c\u00a0 \u3000x", *[None] * 9), (901, "it's we're 12345 " * 9 + "\n " * 40, *[None] * 9)]
    enc = bpe.encoding(PATH, PATTERN)
    digest = bpe.encode(cases.frame(spark, rows), PATH, PATTERN, digests=True, **options).collect()
    key = lambda t: (hashlib.sha256(np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in digest) == Counter((r[0], *key(r[1])) for r in rows)
    ids = bpe.encode(cases.frame(spark, rows), PATH, PATTERN, **options).collect()
    assert all(len(r["ids"]) == r["n_tokens"] for r in ids)
    assert Counter(bpe.decode(r["ids"], PATH, PATTERN) for r in ids) == Counter((r[1] or "").encode() for r in rows)


@pytest.mark.parametrize(("threshold", "small", "short"), [(1, 128, 12), (2, 128, 12), (1, 1, 4), (2, 1, 12), (2, 2, 5)])
def test_line_dedup_equals_all_pairs(spark, monkeypatch, threshold, small, short):
    monkeypatch.setattr(lines_module, "SMALL", small)
    monkeypatch.setattr(lines_module, "SHORT", short)
    rng = random.Random(threshold)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(4, 26))) for _ in range(18)]

    def edited(s):
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(s) + 1)
            s = rng.choice([s[:i] + "z" + s[i:], s[:i] + s[i + 1 :], s[:i] + "y" + s[i + 1 :]])
        return s

    # and lines that share all but a word in one place, of which few are near each other
    base += [f"the same long beginning of a line {w} and its end" for w in ("aaa", "aab", "bcd", "xyz", "xyzw", "qq", "rrrr", "aacb")]
    rows = [(i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randrange(6))), *[None] * 9) for i in range(50)]
    rows += [(60, None, *[None] * 9), (None, base[0], *[None] * 9), (None, base[0], *[None] * 9), rows[7], (61, "", *[None] * 9), (62, base[-1] * 60, *[None] * 9)]
    out = line_dedup(cases.frame(spark, rows), threshold=threshold, min_chars=6).collect()
    gone, texts = cases.lines_gone(rows, threshold, 6), Counter()
    for r in rows:
        keep = r[1] if r[0] is None or r[1] is None else "\n".join(x for p, x in enumerate(r[1].split("\n")) if p not in gone.get(r[0], ()))
        texts[r[0], keep, len(gone.get(r[0], ()))] += 1
    assert Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in out) == texts


def test_within_equals_edit_distance(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abé") for _ in range(rng.randrange(9))), "".join(rng.choice("abé") for _ in range(rng.randrange(9)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for t in range(5):
        assert all(r["w"] == (cases.edits(r["a"], r["b"]) <= t) for r in df.select("a", "b", within(F.col("a"), F.col("b"), t).alias("w")).collect())


def test_near_lines_share_a_key_and_a_shorter_one(spark):
    rng = random.Random(8)

    def edited(s, k):
        for _ in range(k):
            i = rng.randrange(len(s) + 1)
            s = rng.choice([s[:i] + "z" + s[i:], s[:i] + s[i + 1 :], s[:i] + "y" + s[i + 1 :]])
        return s

    for t in (1, 2):
        pairs = [(s, edited(s, t)) for s in ("".join(rng.choice("abcd") for _ in range(rng.randrange(8, 30))) for _ in range(100))]
        df = spark.createDataFrame(pairs, "a string, b string")
        rests = [F.explode(rest_keys(F.col(c), t)).alias(f"k{c}") for c in "ab"]
        met = df.select("a", "b", rests[0]).select("*", rests[1]).where("ka.key = kb.key").where(within(F.col("ka.rest"), F.col("kb.rest"), t))
        assert met.select("a", "b").distinct().count() == len(set(pairs))
        assert df.where(~F.arrays_overlap(shorter_ones(F.col("a"), t), shorter_ones(F.col("b"), t))).count() == 0


def test_a_shared_segment_is_no_block_of_all_pairs(spark):
    rng = random.Random(3)
    lines = ["common start of " + "".join(rng.choice("abcdefghij") for _ in range(26)) for _ in range(3000)]
    rows = [(i, x) for i, x in enumerate([*lines, lines[7][:-2] + "zz", lines[2999].replace("start", "stark")])]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in out.where("n_dropped > 0").collect()} == {3000, 3001}


def test_quality_equals_python_and_sql(spark):
    rows = cases.documents(6)
    book = quality.ledger(cases.frame(spark, rows)).collect()
    want = Counter()
    for r in rows:
        t = r[1] or ""
        w = cases.WORD.findall(t)
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(win)
        lines = [x for x in t.split("\n") if cases.WORD.search(x)]
        want[r[0], len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len({j for i, x in enumerate(win) if n[x] > 1 for j in (i, i + 1, i + 2)})] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in book) == want
    assert got(queries.op7_quality_rules(spark, SF)) == expected(queries.SQL["op7_quality_rules"])


def test_quality_ablations_count_the_ledger(spark):
    book = quality.ledger(cases.frame(spark, cases.documents(6)))
    bits = [r["failures"] & quality.mask("v1") for r in book.collect()]
    for r in quality.ablations(book, "v1").collect():
        bit = next(1 << x.bit for x in quality.RULES if x.name == r["rule"])
        assert r["failed"] == sum(bool(b & bit) for b in bits) and r["only"] == sum(b == bit for b in bits)
        assert r["kept"] == bits.count(0) and r["kept_without"] == sum(not b & ~bit for b in bits)


def fill(sizes, weights, limit):
    """Targets by repeated cutting, {source: target}."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    out, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > limit * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = limit * sizes[s]
            left -= out[s]
        free -= set(over)
    return out


def test_mixing_meets_targets(spark):
    rows = cases.documents(3, 240)
    planned = mixing.plan(cases.frame(spark, rows)).collect()
    count = lambda t: len(cases.WORD.findall(t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += count(r[1])
    want, taken, largest = fill(sizes, (5, 2, 1), 3), Counter(), Counter()
    assert len(planned) == len(rows)
    for r in planned:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) <= 1e-9 * want[r["source"]]
        assert r["copies"] <= 3 and len(r["shards"]) == r["copies"] and all(0 <= s < 16 for s in r["shards"])
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sum(r["copies"] for r in planned) == mixing.mix(cases.frame(spark, rows)).count()
    again = mixing.plan(cases.frame(spark, rows[::-1])).select("doc_id", "copies", "shards").collect()
    key = lambda x: Counter((r["doc_id"], r["copies"], tuple(r["shards"])) for r in x)
    assert key(planned) == key(again)


def test_dealing_halves_every_node(spark):
    units = spark.createDataFrame([(f"s{i % 3}", 0, i) for i in range(96)], "source string, pass int, block int")
    for levels in (1, 2, 4):
        sizes = [r["count"] for r in mixing.dealt(units, levels).groupBy("shard").count().collect()]
        assert len(sizes) == 2**levels and max(sizes) - min(sizes) <= 1


def test_sharding(spark):
    rows = cases.documents(5, 200)
    out = sharding.shard(cases.frame(spark, rows), [1.0] * 16, [1.0] * 17).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert all(r["grown_shard"] in (r["shard"], 16) for r in out)
    for s in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_weights_share_the_rows_and_growth_moves_few(spark):
    rows = spark.range(20_000).select("id", sharding.rendezvous("id", [1, 2, 1]).alias("a"), sharding.rendezvous("id", [1, 2, 1, 1]).alias("b"), sharding.rendezvous("id", [1, 3, 1]).alias("c"))
    n = Counter(r["a"] for r in rows.collect())
    assert abs(n[1] / 20_000 - 0.5) < 0.02
    assert rows.where("a <> b and b <> 3").count() == 0 and abs(rows.where("b = 3").count() / 20_000 - 0.2) < 0.02
    assert rows.where("a <> c and c <> 1").count() == 0


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(1)
    plain = ["thing", "house", "there", "other", "reading", "andor", "ition", "erent", "onhing"]
    bad = [f"grub{x}" for x in ("an", "ox", "eth", "il", "orm", "ust")]
    rows = []
    for i in range(600):
        w = ["".join(rng.choice(plain)[: rng.randrange(2, 7)] for _ in range(2)) for _ in range(rng.randrange(20, 200))]
        if y := i % 5 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice("aeiou")
        rows.append((i, " ".join(w), int(y)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.where("doc_id % 3 <> 0"))
    out = {r["doc_id"]: r for r in toxicity.score(df.where("doc_id % 3 = 0"), model).collect()}
    assert sum(out[i]["predicted"] == y for i, _, y in rows if i % 3 == 0) >= 0.97 * len(out)
    odd = toxicity.score(cases.frame(spark, cases.documents()), model).collect()
    assert len(odd) == len(cases.documents()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in odd)


def test_empty_tables(spark):
    none = cases.empty(spark)
    assert ngram_join.ngram_jaccard_components(none).count() == 0
    assert bpe.encode(none, PATH, PATTERN).count() == 0
    assert line_dedup(none).count() == 0
    assert quality.ledger(none).count() == 0 == quality.ablations(quality.ledger(none)).count()
    assert mixing.plan(none).count() == 0
    assert sharding.shard(none, [1.0] * 2, [1.0] * 3).count() == 0
    model = toxicity.train(none.withColumn("toxic", F.lit(1)))
    assert toxicity.score(none, model).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query_runs_and_reruns_agree(spark, name):
    assert got(queries.QUERIES[name](spark, SF)) == got(queries.QUERIES[name](spark, SF))
