"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once a document; the ledger keeps its measurements and
one bit a failed rule. Policies are versioned masks over the bits: a document is
kept by a policy if none of the policy's bits is set. Ablations (what a policy
would keep without one of its rules) come from the masks alone, without another
look at the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.names import fresh

#: Fixed values of the contract: words, counted symbols.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails`` (SQL over the measurements) is true."""

    bit: int
    name: str
    fails: str


#: Bits never change their meaning; a new version of a rule takes a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_lines > 3 and 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "repeated_windows_strict", "100 * n_repeat_words > 20 * n_words"),
)

#: Rules of each policy version.
POLICIES: dict[str, tuple[int, ...]] = {"base": (0, 1), "v1": (0, 1, 2, 3, 4, 5), "v2": (0, 1, 2, 3, 4, 5, 6)}
CURRENT = "v1"


def mask(policy: str) -> int:
    return sum(1 << b for b in POLICIES[policy])


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long).

    n_lines counts the lines with a word, n_dup_lines those equal to an earlier
    one; n_repeat_words the words inside 3-word windows found twice or more.
    A null text counts as empty. Windows are compared by 64-bit hashes within
    their document, in one sort, so a long text costs little more than its
    length. Columns of these names are replaced, all others stay.
    """
    own = fresh(docs.columns, "_text", "_words", "_lines", "_windows", "_sorted", "_at")
    text, words, lines, windows, ordered, at = own
    plain = F.coalesce(F.col(text_col), F.lit(""))
    found = F.filter(F.split(plain, WORD_SPLIT), lambda w: w != "")
    filled = F.filter(F.split(plain, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({text: plain, words: F.transform(found, lambda w: F.xxhash64(w)), lines: F.transform(filled, lambda x: F.xxhash64(x))})
    out = out.withColumn("n_words", F.size(words).cast("long"))
    solid = F.translate(text, " \t\n\x0b\x0c\r", "")
    clean = F.translate(text, SYMBOLS, "")
    tail = lambda k: F.slice(words, k, F.size(words))
    pairs = F.zip_with(words, tail(2), lambda a, b: F.xxhash64(a, b))
    threes = F.zip_with(pairs, tail(3), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    out = out.withColumns(
        {
            "word_chars": F.length(solid).cast("long"),
            "n_symbols": (F.length(text) - F.length(clean)).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            windows: F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(threes),
        }
    )
    out = out.withColumn(windows, F.slice(windows, 1, F.greatest(F.lit(0), F.col("n_words").cast("int") - 2)))
    # windows found twice or more stand beside an equal one when sorted; all with their places, if there are any
    placed = F.when(F.size(windows) != F.size(F.array_distinct(windows)), F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    out = out.withColumn(ordered, F.coalesce(placed, F.array().cast("array<struct<w:bigint,i:int>>")))
    beside = lambda x, i, by: F.coalesce(F.get(F.col(ordered), i + by)["w"] == x["w"], F.lit(False))
    twice = F.filter(ordered, lambda x, i: beside(x, i, -1) | beside(x, i, 1))
    out = out.withColumn(at, F.sort_array(F.transform(twice, lambda x: x["i"])))
    # each repeated window covers its three words; a word counts once
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(at, start, lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    out = out.withColumn("n_repeat_words", covered)
    return out.drop(*own)


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """One long with a bit for each failed rule."""
    out = F.lit(0).cast("long")
    for r in rules:
        out = out.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failures``, the bitmask of failed rules.

    Rows stay as they are, repeated and null ones too; columns of the ledger's
    names are replaced.
    """
    # a filter on the bits must read the ledger, not repeat the measuring inside its condition: it stops at a row number
    here = F.monotonically_increasing_id().bitwiseAND(F.lit(0).cast("long"))
    return measure(docs, text_col).withColumn("failures", failure_bits().bitwiseOR(here))


def passes(policy: str, failures: str | Column = "failures") -> Column:
    failures = F.col(failures) if isinstance(failures, str) else failures
    return failures.bitwiseAND(F.lit(mask(policy))) == 0


def ablations(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, failed, only, kept, kept_without): one row a rule of the policy.

    failed: documents that fail it; only: those that fail nothing else of the
    policy; kept and kept_without: documents the policy keeps with and without
    it. The ledger is first summed by its masked bits, at most 2^rules rows.
    """
    sums = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if r.bit in POLICIES[policy]]
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules)))
    one = sums.withColumn("r", each).select("bits", "n", "r.rule", "r.bit")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    out = one.groupBy("rule").agg(count(hit).alias("failed"), count(F.col("bits") == F.col("bit")).alias("only"), count(F.col("bits") == 0).alias("kept"))
    return out.withColumn("kept_without", F.col("kept") + F.col("only"))
