"""Toxicity by class-conditional Kneser-Ney models of expressions.

The models spell words letter by letter. A letter after its longest context is
counted per class over all labelled texts; every shorter context is shared by
both classes and holds continuation counts (how many longer contexts a letter
follows), so that expressions too rare for either class's own counts are judged
alike by both. The estimates are made by joins and sums of the count tables;
since both classes share the backed-off part, a letter seen in neither class
after a context has a ratio that depends on the context alone, and the model is
two tables of log ratios (toxic over ordinary).

A text is scored by one figure alone: the difference of its two log-likelihoods,
normalised by its length. An ordinary text's words come from the ordinary
spellings; a toxic text's words come from the toxic spellings one time in fifty
(SHARE) and from the ordinary ones otherwise, as toxic texts are ordinary ones
but for a few expressions. The normalisation is the number of words to the power
of three quarters: what ordinary words add by chance grows as its root, what
toxic ones add as itself. A slope and a threshold turn the figure into a
probability; they are fitted on a bounded sample of one half of the labelled
texts, judged by the counts of the other half.

Estimates are made from all counts. Of each of the two tables the CELLS commonest
rows at most are sent to the workers, whatever the size of the input; the whole
tables stay where they are. A word with a letter that the sent rows don't have is
spelt by a join with the whole tables, so every text has the same figure however
few rows are sent.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.plans.durable import materialize, release

WORD = re.compile(r"[^\W\d_]+")
CONTEXT, DISCOUNT = 5, 0.75
#: A toxic text's share of toxic words, and the power of the number of words that normalises a text's likelihoods.
SHARE, POWER = 0.02, 0.75
#: The bounded sample for the slope and the threshold: so many labelled texts of each class. All labelled texts are counted.
SAMPLE = 1_500
#: Rows of each of a model's tables that are sent to the workers.
CELLS = 1 << 22
#: Words whose ratios a worker remembers.
REMEMBERED = 300_000
#: Evidence and words' ratios are clipped here.
CLIP = 30.0


@dataclass
class Table:
    """Log ratios by the 64-bit hash of a string, sorted; whether they are all there are."""

    keys: np.ndarray
    values: np.ndarray
    whole: bool = True

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray, whole: bool = True) -> Table:
        order = np.argsort(keys)
        return cls(keys[order], values[order].astype(np.float32), whole)

    def get(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The values, 0 where there is none, and whether there is one."""
        keys = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in strings], np.uint64).view(np.int64)
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        return np.where(there, self.values[at], 0.0).astype(float), there


_NONE = Table(np.zeros(0, np.int64), np.zeros(0, np.float32))


@dataclass
class Model:
    """Log ratios of seen letters (by context and letter) and of contexts' backoff weights; the slope and the bias of the logistic function.

    ``rest``: the two tables (string, ratio) in whole, where one of those sent is not.
    """

    seen: Table = field(default_factory=lambda: _NONE)
    backoff: Table = field(default_factory=lambda: _NONE)
    weights: tuple[float, ...] = (1.0, -3.0)
    name: str = ""
    rest: tuple[DataFrame, DataFrame] | None = None

    def expressions(self, words: list[str]) -> list[float]:
        """The log ratio of each word's spelling; not a number where only the whole tables can tell."""
        grams, contexts, ends = [], [], []
        for word in words:
            s = f"^{word}$"
            for i in range(1, len(s)):
                context = s[max(0, i - CONTEXT) : i]
                grams.append(context + s[i])
                contexts.append(context)
            ends.append(len(grams))
        values, there = self.seen.get(grams)
        missing = np.flatnonzero(~there)
        values[missing], known = self.backoff.get([contexts[i] for i in missing])
        values[missing[~(known | self.backoff.whole) if self.seen.whole else slice(None)]] = np.nan
        return np.add.reduceat(values, [0, *ends[:-1]]).tolist() if ends else []

    def parts(self, text: str | None, memory: dict[str, float]) -> tuple[float, int, list[tuple[str, int]]]:
        """The sum over the text's words of their log-likelihoods' difference, the number of words, and those words that the sum lacks, with their numbers."""
        words = Counter(WORD.findall((text or "").lower()))
        new = [w for w in words if w not in memory]
        if new:
            if len(memory) + len(new) > REMEMBERED:
                memory.clear()
                new = list(words)
            ratios = np.clip(self.expressions(new), -CLIP, CLIP)
            memory.update(zip(new, np.log1p(SHARE * np.expm1(ratios)).tolist(), strict=True))
        found = [(w, n, memory[w]) for w, n in words.items()]
        return sum(x * n for _, n, x in found if x == x), words.total(), [(w, n) for w, n, x in found if x != x]

    def evidence(self, text: str | None, memory: dict[str, float]) -> float:
        """The length-normalised log-likelihood of the text as a toxic one, less that as an ordinary one; 0 without any word."""
        total, n, lacking = self.parts(text, memory)
        return float("nan") if lacking else total / n**POWER if n else 0.0

    def score(self, evidence: np.ndarray) -> np.ndarray:
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(np.clip(evidence, -CLIP, CLIP) * w[0] + w[1], -500, 500)))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(half, class, word, n): the words of a batch's texts."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            b = whole.slice(at, 2048)
            words: dict[tuple[int, int], Counter] = {}
            for half, cls, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words.setdefault((half, cls), Counter()).update(WORD.findall((text or "").lower()))
            for (half, cls), found in words.items():
                n = len(found)
                cols = [pa.array([half] * n, pa.int32()), pa.array([cls] * n, pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["half", "class", "word", "n"])


def letters(words: DataFrame) -> DataFrame:
    """(half, class, context, letter, n): the letters of the words, each under its longest context; a word is spelt once."""
    s = F.concat(F.lit("^"), "word", F.lit("$"))
    spelt = words.groupBy("half", "class", "word").agg(F.sum("n").alias("n")).select("half", "class", "n", s.alias("s"))
    each = spelt.select("half", "class", "n", F.explode(F.expr(f"transform(sequence(2, length(s)), i -> struct(substring(s, greatest(1, i - {CONTEXT}), least(i - 1, {CONTEXT})) as context, substring(s, i, 1) as letter))")).alias("x"))
    return each.groupBy("half", "class", "x.context", "x.letter").agg(F.sum("n").alias("n"))


def estimates(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model, context, letter, ratio, n) and (model, context, ratio, n) from (model, context, letter, n0, n1), a row each; n: occurrences.

    Interpolated Kneser-Ney: the longest context discounts its class's counts
    and backs off to the shared continuation estimate of the context without
    its first letter, that one to the next shorter, the shortest to the uniform
    distribution over the letters seen and one more.
    """
    d = DISCOUNT
    # the shared counts of every shorter context, whose sum and number of letters smooth it
    shorter = counts.select("model", "letter", F.explode(F.expr("transform(sequence(0, length(context) - 1), m -> right(context, m))")).alias("suffix"))
    types = shorter.groupBy("model", "suffix", "letter").agg(F.count("*").alias("t"))
    types = materialize(types, "op2-types")
    sums = types.groupBy("model", "suffix").agg(F.sum("t").alias("sum"), F.count("*").alias("kinds"))
    known = materialize(types.join(sums, ["model", "suffix"]), "op2-shared")
    release(types)
    letters = known.where("suffix = ''").groupBy("model").agg((F.count("*") + 1).alias("letters"))
    # from the shortest up, each length's estimates smooth the next one's
    share = lambda p: (F.greatest(F.col("t") - d, F.lit(0.0)) + d * F.col("kinds") * p) / F.col("sum")
    p = known.where("suffix = ''").join(F.broadcast(letters), "model").select("model", "suffix", "letter", share(1 / F.col("letters")).alias("lower"))  # a row a model
    every = [p := materialize(p, "op2-lower")]
    for m in range(1, CONTEXT):
        above = p.withColumnRenamed("suffix", "end")
        p = known.where(F.length("suffix") == m).withColumn("end", F.expr(f"right(suffix, {m - 1})")).join(above, ["model", "end", "letter"])
        every.append(p := materialize(p.select("model", "suffix", "letter", share(F.col("lower")).alias("lower")), "op2-lower"))
    lower = reduce(DataFrame.unionAll, every)
    totals = counts.groupBy("model", "context").agg(*(F.sum(f"n{k}").alias(f"total{k}") for k in "01"), *(F.count_if(F.col(f"n{k}") > 0).alias(f"kinds{k}") for k in "01"))
    rest = lambda k: F.when(F.col(f"total{k}") > 0, d * F.col(f"kinds{k}") / F.col(f"total{k}")).otherwise(1.0)
    totals = totals.select("model", "context", *(F.col(f"total{k}") for k in "01"), *(rest(k).alias(f"rest{k}") for k in "01"))
    both = counts.withColumn("suffix", F.expr("right(context, length(context) - 1)")).join(lower, ["model", "suffix", "letter"]).join(totals, ["model", "context"])
    p = [F.when(F.col(f"total{k}") > 0, F.greatest(F.col(f"n{k}") - d, F.lit(0.0)) / F.col(f"total{k}")).otherwise(0.0) + F.col(f"rest{k}") * F.col("lower") for k in "01"]
    return both.select("model", "context", "letter", F.ln(p[1] / p[0]).alias("ratio"), (F.col("n0") + F.col("n1")).alias("n")), totals.select("model", "context", F.ln(F.col("rest1") / F.col("rest0")).alias("ratio"), (F.col("total0") + F.col("total1")).alias("n"))


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 0.1, steps: int = 60) -> tuple[float, ...]:
    """Weights of the features and a bias, both classes weighing the same; Newton's method with a ridge."""
    x = np.column_stack([features, np.ones(len(features))])
    share = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1)) * len(labels)
    w, hold = np.zeros(x.shape[1]), np.array([ridge] * features.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (share * (labels - p)) - hold * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _fetched(ratios: DataFrame, string) -> dict[int, Table]:
    """The tables by model: the commonest rows, CELLS at most, 12 bytes a row; rows as common as one that is too many stay behind."""
    rows = ratios.select("model", F.xxhash64(string).alias("h"), F.col("ratio").cast("float").alias("ratio"), "n")
    total, least = Counter(), {}
    for r in rows.groupBy("model", "n").agg(F.count("*").alias("rows")).orderBy("model", F.desc("n")).collect():  # a row for each number of occurrences
        total[r["model"]] += r["rows"]
        if total[r["model"]] <= CELLS:
            least[r["model"]] = r["n"]
    sent = reduce(lambda a, b: a | b, ((F.col("model") == m) & (F.col("n") >= n) for m, n in least.items()), F.lit(False))
    rows = rows.where(sent).select("model", "h", "ratio").toArrow()
    model, keys, values = (rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("model", "h", "ratio"))
    return {m: Table.of(keys[model == m], values[model == m], n <= CELLS) for m, n in total.items()}


def _by_join(words: DataFrame, rest: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(word, term): what a word adds to its text's sum, from the whole tables of (string, ratio)."""
    seen, backoff = rest
    s = words.select("word", F.concat(F.lit("^"), "word", F.lit("$")).alias("s"))
    each = s.select("word", F.explode(F.expr(f"transform(sequence(2, length(s)), i -> struct(substring(s, greatest(1, i - {CONTEXT}), least(i - 1, {CONTEXT})) as context, substring(s, i, 1) as letter))")).alias("x")).select("word", "x.*")
    # a word may have a letter after the same context more than once, and all words share theirs
    each = each.groupBy("word", "context", "letter").agg(F.count("*").alias("times")).withColumn("string", F.concat("context", "letter"))
    each = each.join(seen.withColumnRenamed("ratio", "own"), "string", "left").drop("string").join(backoff.withColumnRenamed("string", "context"), "context", "left")
    ratio = F.sum(F.coalesce("own", "ratio", F.lit(0.0)).cast("float").cast("double") * F.col("times"))
    return each.groupBy("word").agg(F.log1p(SHARE * F.expm1(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), ratio)))).alias("term"))


_MEMORY: dict[str, dict[str, float]] = {}


def _evidence(rows: DataFrame, model: Model) -> DataFrame:
    """(key, evidence) of every row (key, text)."""
    sent = rows.sparkSession.sparkContext.broadcast(replace(model, name=uuid.uuid4().hex, rest=None))
    kind, partly = rows.schema["key"].dataType.simpleString(), model.rest is not None
    listed = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        if model.name not in _MEMORY:  # a worker's tasks share what they have spelt
            _MEMORY.clear()
            _MEMORY[model.name] = {}
        memory = _MEMORY[model.name]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                if not partly:
                    found = pa.array([model.evidence(t, memory) for t in b.column(1).to_pylist()], pa.float64())
                    yield pa.RecordBatch.from_arrays([b.column(0), found], ["key", "evidence"])
                    continue
                total, n, lacking = zip(*(model.parts(t, memory) for t in b.column(1).to_pylist()), strict=True)
                lacking = pa.array([[{"word": w, "n": k} for w, k in x] for x in lacking], listed)
                names = pa.array([uuid.uuid4().hex for _ in n])  # keys may be null or repeated
                yield pa.RecordBatch.from_arrays([b.column(0), names, pa.array(total, pa.float64()), pa.array(n, pa.int64()), lacking], ["key", "row", "total", "n", "lacking"])

    if not partly:
        return rows.select("key", "text").mapInArrow(run, f"key {kind}, evidence double")
    found = materialize(rows.select("key", "text").mapInArrow(run, f"key {kind}, row string, total double, n long, lacking array<struct<word: string, n: bigint>>"), "op2-known")
    each = found.select("row", F.explode("lacking").alias("x")).select("row", "x.word", F.col("x.n").alias("times"))
    terms = materialize(_by_join(each.select("word").distinct(), model.rest), "op2-terms")
    more = each.join(terms, "word").groupBy("row").agg(F.sum(F.col("term") * F.col("times")).alias("more"))
    total = F.col("total") + F.coalesce("more", F.lit(0.0))
    return found.select("key", "row", "total", "n").join(more, "row", "left").select("key", F.when(F.col("n") > 0, total / F.pow("n", F.lit(POWER))).otherwise(0.0).alias("evidence"))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from labelled texts; rows without a 0/1 label are ignored.

    Letters are counted over all of them, on the executors; the commonest rows
    of the tables of ratios, CELLS at most, go through the driver to the workers,
    the others are joined. The weights come
    from the ``sample`` texts of each class with the smallest hashes of key and
    text; reruns agree. With one class or none there is no evidence to weigh,
    and the default weights stay.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(1)).alias("h"), F.col(label_col).cast("int").alias("y"), F.col(text_col).alias("text"))
    rows = rows.withColumn("half", F.pmod(F.shiftright("h", 8), F.lit(2)).cast("int"))
    counts = materialize(letters(rows.select("half", "y", "text").mapInArrow(_words, "half int, class int, word string, n long")), "op2-counts")
    # model 0 has the counts of one half and judges the sample, of the other; model 1 has all
    each = counts.withColumn("model", F.explode(F.when(F.col("half") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    each = each.groupBy("model", "context", "letter").agg(*(F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)))
    each = materialize(each, "op2-grams")
    release(counts)
    seen, backoff = (materialize(t, "op2-ratios") for t in estimates(each))
    release(each)
    whole = seen.withColumn("string", F.concat("context", "letter")), backoff.withColumn("string", F.col("context"))
    tables = [_fetched(t, F.col("string")) for t in whole]

    def made(m: int) -> Model:
        sent = [t.get(m, _NONE) for t in tables]
        return Model(*sent, rest=None if all(t.whole for t in sent) else tuple(t.where(F.col("model") == m).select("string", "ratio") for t in whole))

    judging, model = made(0), made(1)
    # no more than sample rows of a class: equal hashes, those of repeated rows, are counted once
    chosen = [rows.where((F.col("y") == y) & (F.col("half") == 1)).groupBy("h").agg(F.first("y").alias("y"), F.first("text").alias("text")).orderBy("h").limit(sample) for y in (0, 1)]
    if judging.rest is None and model.rest is None:
        release(seen)
        release(backoff)
    known = _evidence(chosen[0].unionAll(chosen[1]).select(F.col("y").alias("key"), "text"), judging).toPandas().sort_values(["key", "evidence"])
    if known["key"].nunique() == 2:
        evidence = np.clip(known[["evidence"]].to_numpy(float), -CLIP, CLIP)
        unit = evidence.std() or 1.0  # the ridge is one of the figure's spread, whatever its size
        slope, bias = logistic(evidence / unit, known["key"].to_numpy(float))
        model.weights = slope / unit, bias
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id_col, score, predicted) for every row of ``docs``, from the whole text alone.

    Empty and null texts, and texts without letters, have no evidence and get
    the score of evidence 0. Rows with null or repeated ids stay as they are.
    """
    w = model.weights
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.col("evidence"))) * w[0] + w[1]))))
    found = _evidence(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), model)
    return found.select(F.col("key").alias(id_col), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
