"""The pipeline and each of its stages against plain Python."""

from collections import Counter, defaultdict

import cases
import public_tokenizers
from oracle import SF

import corpus_pipeline as pipeline
from ruleloom.llm import bpe, mixing, quality

COLUMNS = list(pipeline.COLUMNS)


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def kept_by_quality(text):
    w = cases.WORD.findall(text or "")
    n, win = len(w), [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(win)
    repeat = len({j for i, x in enumerate(win) if c[x] > 1 for j in (i, i + 1, i + 2)})
    lines = [x for x in (text or "").split("\n") if cases.WORD.search(x)]
    chars = sum(map(len, w))
    return not (n < 50 or 100 * repeat > 50 * n or 10 * sum(x in quality.SYMBOLS for x in text or "") > n or len(lines) > 3 and 100 * (len(lines) - len(set(lines))) > 30 * len(lines) or chars < 2 * n or chars > 15 * n)


class EarlierLines:
    """Whether a line has no equal one before it, nor, from 20 characters, one within two edits."""

    def __init__(self):
        self.equal, self.long = set(), defaultdict(list)

    def new(self, x):
        if x in self.equal:
            return False
        self.equal.add(x)
        letters = Counter(x)
        near = len(x) >= 20 and any(
            sum(((letters - c) + (c - letters)).values()) <= 4 and cases.edits(x, y) <= 2 for n in range(len(x) - 2, len(x) + 3) for y, c in self.long[n]
        )
        if len(x) >= 20:
            self.long[len(x)].append((x, letters))
        return not near


def test_pipeline_equals_plain_python(spark):
    docs = rows_of(spark.read.parquet(f"{SF}/documents.parquet"))
    docs = [r for r in docs if kept_by_quality(r[1])]
    seen, out = EarlierLines(), []
    for r in sorted(docs):
        lines = r[1].split("\n")
        final = [x for x in lines if not cases.WORD.search(x) and len(x) < 20 or seen.new(x)]
        if len(final) == len(lines):
            out.append(r)
        elif cases.WORD.search("\n".join(final)):
            out.append((r[0], "\n".join(final), r[2], r[3], len("\n".join(final))))
    groups = cases.jaccard_groups(out, 5, 80)
    out = [r for r in out if groups[r[0]] == r[0]]
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    copies = {r["doc_id"]: r["copies"] for r in mixing.plan(spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long")).select("doc_id", "copies").collect()}
    want = Counter({(r[0], tuple(enc.encode_ordinary(r[1]))): copies[r[0]] for r in out if copies[r[0]]})
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in pipeline.run(spark, SF).collect()) == want


def test_stages_take_odd_documents(spark):
    docs = cases.frame(spark, [r if r[1] is None or i % 2 else (r[0], r[1] + "\n" + " ".join(f"v{i}x{j}" for j in range(60)), *r[2:]) for i, r in enumerate(cases.documents(2))])
    empty = cases.empty(spark)
    for name, stage in pipeline.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, empty, SF)
        assert none.count() == 0, name
        if name == pipeline.STAGES[-1][0]:
            assert out.count() == docs.count()
        else:
            assert out.columns == COLUMNS and 0 < out.count()


def test_one_of_each_group_stays(spark):
    rows = cases.documents(11)
    df = cases.frame(spark, rows)
    left = Counter(r["doc_id"] for r in pipeline.near_duplicates(spark, df, SF).collect())
    groups = cases.jaccard_groups(rows, 5, 80)
    assert left == Counter({d: 1 for d, g in groups.items() if d == g}) + Counter([None, None])
