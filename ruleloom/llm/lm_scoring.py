"""Language-model scores by a hashed maximum-entropy model.

Tokens are the lower-cased (A-Z) words of a text and one end. The words that
occur most often in the training texts, and classes of all other words by their
last letters, are the model's symbols; they are dealt to classes of equal size
by their neighbours' counts. A symbol's probability is factored,
P(class | context) * P(symbol | class, context), and both factors are softmaxes
over sums of weight rows: a bias, and the rows to which n-grams (the last word,
the last two) and skips (the word before the last, the one before that) are
hashed. Within a class of rare words a word has its share of the class's
training counts plus one, and one more stands for every unknown word, so that a
text's probability is a proper one.

Training: word counts, neighbour counts and feature counts come from all
training texts. The counts give the first update of every weight; then follow
rounds of distributed gradient updates, each over its own slice of the training
texts. The gradient of a row is the observed less the expected counts, summed
over all tasks by row, and each coordinate's step is scaled by its counts.
Tables that reach the driver and the workers have fixed sizes: ROWS x WIDTH
weights, HEAD word counts. The counts of rarer words, however many there are,
meet their texts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.hashing import mix, word_hashes
from ruleloom.plans.durable import materialize

_U = np.uint64
#: Symbols of a class, classes, and symbols: the first ENDINGS are classes of rare words, the others words.
WIDTH = 32
SYMBOLS, ENDINGS = WIDTH * WIDTH, 256
START = SYMBOLS
#: Weight rows: the classes' bias, the symbols' biases by class, then hashed features of the class, then hashed features of the symbols of each class.
FIXED, SYMBOL_ROWS = 1 + WIDTH, 512
CLASS_ROWS = (1 << 14) - FIXED
ROWS = FIXED + CLASS_ROWS + WIDTH * SYMBOL_ROWS
#: Words whose counts are sent to every worker, at most; rarer ones are joined.
HEAD = 1 << 18
#: Slices of the training texts, one for each round of updates; the smoothing of counts, and the steps.
ROUNDS, PRIOR, FIRST, RATE, TAU, MOST = 3, 10.0, 0.5, 0.3, 10.0, 8.0
#: Bytes of text that are hashed at once, and tokens that are scored at once.
PIECE, BATCH = 1 << 20, 1 << 13
#: The end of a text: the key of no word, as a word holds no space.
END = np.uint64(0x5EED0F7E57000000)


# --- texts to tokens -------------------------------------------------------


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, texts' starts in them, number of the first text) of about PIECE bytes, cut at white space only."""
    at, n, text = int(offsets[0]), int(offsets[-1]), 0
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            solid = np.flatnonzero((data[at:end] == 0x20) | ((data[at:end] >= 0x09) & (data[at:end] <= 0x0D)))
            last = int(np.searchsorted(offsets, end, "right")) - 1  # a text's start is as good as white space
            best = max(int(offsets[last]) if offsets[last] > at else -1, at + int(solid[-1]) + 1 if len(solid) else -1)
            while best <= at:  # a word longer than a piece
                end = min(n, end + PIECE)
                more = np.flatnonzero((data[at:end] == 0x20) | ((data[at:end] >= 0x09) & (data[at:end] <= 0x0D)))
                last = int(np.searchsorted(offsets, end, "right")) - 1
                best = n if end == n else max(int(offsets[last]) if offsets[last] > at else -1, at + int(more[-1]) + 1 if len(more) else -1)
            end = best
        text = int(np.searchsorted(offsets, at, "right")) - 1
        stop = int(np.searchsorted(offsets, end, "left"))
        yield data[at:end], np.maximum(offsets[text:stop], at) - at, text
        at = end


def tokens(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, text number) of the words, piece by piece: a 64-bit hash whose last 8 bits tell the word's ending; the texts' ends are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    with np.errstate(over="ignore"):
        for part, starts, first in _pieces(data, offsets):
            words, text = word_hashes(part, starts, starts)
            solid = ~((part == 0x20) | ((part >= 0x09) & (part <= 0x0D)))
            begins = np.zeros(len(part) + 1, bool)
            begins[starts] = True
            at = np.flatnonzero(solid & np.append(~solid[1:] | begins[1:-1], True))  # the words' last bytes
            one = begins[at] | (at == 0) | ~solid[np.maximum(at - 1, 0)]
            a, b = part[at].astype(np.uint64), np.where(one, 0, part[np.maximum(at - 1, 0)]).astype(np.uint64)
            lower = lambda x: np.where((x >= 65) & (x <= 90), x + _U(32), x)
            ending = mix(lower(a) * _U(263) + lower(b) + _U(1)) >> _U(56)
            yield (words & ~_U(0xFF)) | ending, text + first


def _sorted_counts(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts, or the sums of their ``n``."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n, first) if len(n) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of the tokens, ends included; what a task holds is bounded."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        keys, n = _sorted_counts(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    for b in batches:
        if b.num_rows:
            held.append((np.array([END]), np.array([b.num_rows])))
        for keys, _ in tokens(b.column(0)):
            held.append(_sorted_counts(keys))
            size += len(held[-1][0])
            if size > 1 << 21:
                keys, n = _sorted_counts(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
                held[:] = [(keys, n)]
                if len(keys) > 1 << 20:
                    yield out()
                    held.clear()
                size = sum(len(k) for k, _ in held)
    if held:
        yield out()


@dataclass
class Lexicon:
    """Training counts: ``counts`` (key, n) of all words, ``total`` tokens, ``distinct`` ones, and the head on the driver, by falling count."""

    counts: DataFrame
    total: int
    distinct: int
    least: int
    keys: np.ndarray
    n: np.ndarray
    mass: np.ndarray  # of each class of rare words: the sum of (count + 1), and 1 for the unknown

    @property
    def words(self) -> int:
        """How many of the head's words are symbols."""
        return min(len(self.keys), SYMBOLS - ENDINGS)


def lexicon(docs: DataFrame, text_col: str = "text", head: int = HEAD) -> Lexicon:
    """Counts over every text of ``docs``; the head takes at most ``head`` words, those of whole classes of counts (eighths of powers of two)."""
    counts = docs.select(F.col(text_col)).mapInArrow(_count, "key long, n long")
    counts = materialize(counts.groupBy("key").agg(F.sum("n").alias("n")), "op11-counts")
    bucket = F.floor(F.log2("n") * 8).cast("int")
    by = counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("b")).collect()  # at most 512 rows
    total, distinct, least, seen = sum(r["n"] for r in by), sum(r["words"] for r in by), 1 << 62, 0
    for r in by:
        seen += r["words"]
        if seen > head:
            break
        least = r["least"]
    top = counts.where(F.col("n") >= least).toArrow()
    keys, n = top["key"].combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64), top["n"].combine_chunks().to_numpy(zero_copy_only=False)
    order = np.lexsort((keys, -n))
    keys, n = keys[order], n[order]
    mass = np.ones(ENDINGS)
    for e, m in counts.groupBy(F.col("key").bitwiseAND(F.lit(0xFF)).alias("e")).agg((F.sum("n") + F.count("*")).alias("m")).collect():  # ENDINGS rows
        mass[e] += m
    words = min(len(keys), SYMBOLS - ENDINGS)
    np.subtract.at(mass, (keys[:words] & _U(0xFF)).astype(np.int64), n[:words] + 1.0)  # symbols of their own
    return Lexicon(counts, int(total), int(distinct), int(least), keys, n, mass)


class Finder:
    """Places of 64-bit keys in a list: a direct table, and a sorted rest for the keys whose slot is taken."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, (4 * len(keys)).bit_length())
        self.mask, self.shift = _U((1 << bits) - 1), _U(8)
        slot = ((keys >> self.shift) & self.mask).astype(np.int64)
        self.place = np.full(1 << bits, -1, np.int32)
        self.place[slot[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]  # the first of a slot stays
        self.keys = np.append(keys, _U(0))
        rest = np.flatnonzero(self.place[slot] != np.arange(len(keys)))
        self.shared = np.zeros(1 << bits, bool)
        self.shared[slot[rest]] = True
        order = np.argsort(keys[rest])
        self.rest, self.rest_at = keys[rest][order], rest[order].astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        slot = ((keys >> self.shift) & self.mask).astype(np.int64)
        at = self.place[slot]
        at = np.where(self.keys[at] == keys, at, np.int32(-1))
        open_ = np.flatnonzero((at < 0) & self.shared[slot])
        if len(open_):
            i = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            at[open_] = np.where(self.rest[i] == keys[open_], self.rest_at[i], -1)
        return at


def encode(docs: DataFrame, lex: Lexicon, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and, for each row: rid (a number of its own), n_tokens, known (tokens of the head), logs (their sum of log10(count + 1)), rare (the part of logs, less the
    log10 of their class's mass, of tokens that are no symbols of their own), symbols (16 bits a token), tail (keys of the tokens outside the head).
    """
    sent = docs.sparkSession.sparkContext.broadcast((lex.keys, lex.n, lex.mass, lex.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, mass, words = sent.value
        find, log, share = Finder(keys), np.append(np.log10(n + 1.0), 0.0), np.log10(mass)
        end, ending_of_end = int(find(np.array([END]))[0]), int(END & _U(0xFF))
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                size = b.num_rows
                n_tokens, known, logs, rare = np.ones(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
                parts: list[list[bytes]] = [[] for _ in range(size)]
                tails: list[list[bytes]] = [[] for _ in range(size)]
                for key, text in tokens(b.column(b.num_columns - 1)):
                    at = find(key)
                    there = at >= 0
                    ending = (key & _U(0xFF)).astype(np.int64)
                    own = there & (at < words)
                    symbol = np.where(own, at + ENDINGS, ending).astype(np.uint16)
                    value = log[at]
                    n_tokens += np.bincount(text, minlength=size)
                    known += np.bincount(text[there], minlength=size)
                    logs += np.bincount(text, value, size)
                    rare += np.bincount(text, np.where(own, 0.0, value - share[ending]), size)
                    for found, values, where in ((parts, symbol, text), (tails, key[~there], text[~there])):
                        cut = np.searchsorted(where, np.arange(size + 1)).tolist()
                        for i, (first, last) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                            if last > first:
                                found[i].append(values[first:last].tobytes())
                # the end is a token as any other
                ends, more = np.uint16(end + ENDINGS if 0 <= end < words else ending_of_end).tobytes(), b"" if end >= 0 else END.tobytes()
                known += int(end >= 0)
                logs += log[end]
                rare += 0.0 if 0 <= end < words else log[end] - share[ending_of_end]
                cols = [*(b.column(i) for i in range(b.num_columns - 1)), pa.array(n_tokens), pa.array(known), pa.array(logs), pa.array(rare), pa.array([b"".join(p) + ends for p in parts], pa.binary()), pa.array([b"".join(t) + more for t in tails], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*names, "n_tokens", "known", "logs", "rare", "symbols", "tail"])

    names = [*keep, "rid"]
    given = docs.select(*keep, F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]]
    return materialize(given.mapInArrow(run, ", ".join([*kinds, "n_tokens long, known long, logs double, rare double, symbols binary, tail binary"])), "op11-encoded")


# --- features and probabilities --------------------------------------------


def _contexts(symbols: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, the three before it, text number) of the tokens of several texts."""
    s = np.frombuffer(b"".join(symbols), np.uint16).astype(np.int64)
    sizes = np.array([len(x) // 2 for x in symbols])
    text = np.repeat(np.arange(len(symbols)), sizes)
    place = np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = []
    for k in (1, 2, 3):
        x = np.full(len(s), START, np.int64)
        x[k:] = s[:-k] if k <= len(s) else s[:0]
        x[place < k] = START
        before.append(x)
    return s, *before, text


def _hashed(kind: int, rows: int, *parts: np.ndarray) -> np.ndarray:
    """Numbers under ``rows`` of contexts."""
    h = np.full(len(parts[0]), _U(kind + 1))
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return ((h >> _U(11)) % _U(rows)).astype(np.int64)


def features(a: np.ndarray, b: np.ndarray, c: np.ndarray, cls: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Weight rows of the class's features, and of the symbol's features within its class; biases come first."""
    of_class = lambda kind, *x: FIXED + _hashed(kind, CLASS_ROWS, *x)
    of_symbol = lambda kind, *x: FIXED + CLASS_ROWS + cls * SYMBOL_ROWS + _hashed(kind, SYMBOL_ROWS, *x)
    return [np.zeros(len(a), np.int64), of_class(0, a), of_class(1, a, b), of_class(2, b), of_class(3, c)], [1 + cls, of_symbol(4, a)]


def _sums(weights: np.ndarray, rows: list[np.ndarray], out: np.ndarray, more: np.ndarray) -> np.ndarray:
    n = len(rows[0])
    s, t = out[:n], more[:n]
    np.take(weights, rows[0], axis=0, out=s, mode="clip")
    for r in rows[1:]:
        np.take(weights, r, axis=0, out=t, mode="clip")
        np.add(s, t, out=s)
    return s


@dataclass
class Model:
    """Weights, and each symbol's class and place in it."""

    weights: np.ndarray
    place: np.ndarray  # class * WIDTH + slot

    @cached_property
    def _space(self) -> tuple[np.ndarray, np.ndarray]:
        return np.empty((BATCH, WIDTH), np.float32), np.empty((BATCH, WIDTH), np.float32)

    def steps(self, symbols: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]]]:
        """For runs of BATCH tokens: (text number, log10 probability, [(rows, target, exponentials, their sums)] of both factors)."""
        s, a, b, c, text = _contexts(symbols)
        place = self.place[s]
        for lo in range(0, len(s), BATCH):
            at = slice(lo, lo + BATCH)
            cls, slot = np.divmod(place[at], WIDTH)
            logp, found = np.zeros(len(cls)), []
            for rows, target in zip(features(a[at], b[at], c[at], cls), (cls, slot), strict=True):
                x = _sums(self.weights, rows, *self._space)
                logp += x[np.arange(len(x)), target]
                np.exp(x, out=x)
                z = x.sum(axis=1)
                logp -= np.log(z)
                found.append((rows, target, x, z))
                yield text[at], logp, found
            # the exponentials are overwritten by the next factor, so each factor is yielded as it is made

    def logs(self, symbols: list[bytes]) -> np.ndarray:
        """The log10 probability of each text's symbols."""
        out = np.zeros(len(symbols))
        for text, logp, found in self.steps(symbols):
            if len(found) == 2:
                out += np.bincount(text, logp, len(symbols))
        return out / np.log(10.0)


def counted(place: np.ndarray, batches: Iterator[list[bytes]]) -> np.ndarray:
    """Counts of (weight row, target) of the texts' tokens."""
    out = np.zeros(ROWS * WIDTH, np.float32)
    for symbols in batches:
        s, a, b, c, _ = _contexts(symbols)
        for lo in range(0, len(s), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            cls, slot = np.divmod(place[s[at]], WIDTH)
            for rows, target in zip(features(a[at], b[at], c[at], cls), (cls, slot), strict=True):
                for r in rows:
                    cell = r * WIDTH + target
                    kinds, n = _sorted_counts(cell.astype(np.int32))
                    out[kinds] += n
    return out.reshape(ROWS, WIDTH)


def gradient(model: Model, batches: Iterator[list[bytes]]) -> np.ndarray:
    """Observed less expected counts of (weight row, target)."""
    out = np.zeros((ROWS, WIDTH), np.float32)
    for symbols in batches:
        for _, _, found in model.steps(symbols):
            rows, target, x, z = found[-1]
            np.divide(x, -z[:, None], out=x)
            x[np.arange(len(x)), target] += 1
            for r in rows:
                if len(found) == 1 and r is rows[0]:
                    out[0] += x.sum(axis=0)
                    continue
                order = np.argsort(r.astype(np.uint16), kind="stable")
                key = r[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                out[key[first]] += np.add.reduceat(np.take(x, order, axis=0), first, axis=0)
    return out


def classes(pairs: np.ndarray) -> np.ndarray:
    """Places of symbols: WIDTH classes of WIDTH, from counts of (symbol before, symbol).

    The symbols' shares of neighbours on both sides, as square roots, are
    halved again and again along their main direction, so that symbols which
    follow and precede the same ones share a class.
    """
    x = np.concatenate([pairs[:SYMBOLS, :SYMBOLS], pairs[:, :SYMBOLS].T], axis=1).astype(float)
    x = np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1.0))
    groups = [np.arange(SYMBOLS)]
    while len(groups) < WIDTH:
        halves = []
        for g in groups:
            y = x[g] - x[g].mean(axis=0)
            v = np.cos(np.arange(y.shape[1]) + 1.0)
            for _ in range(30):  # the main direction by power iteration
                v = y.T @ (y @ v)
                v /= max(np.linalg.norm(v), 1e-30)
            order = g[np.lexsort((g, np.round(y @ v, 9)))]
            halves += [np.sort(order[: len(g) // 2]), np.sort(order[len(g) // 2 :])]
        groups = halves
    place = np.zeros(SYMBOLS + 1, np.int64)
    place[np.concatenate(groups)] = np.arange(SYMBOLS)
    return place


def first_weights(counts: np.ndarray) -> np.ndarray:
    """The first update: biases are logs of shares, a feature's weights a part of the log ratios of its row's shares to its bias's."""
    bias = counts[:FIXED] + 1e-9
    bias /= bias.sum(axis=1, keepdims=True)
    prior = np.concatenate([bias, np.repeat(bias[:1], CLASS_ROWS, axis=0), np.repeat(bias[1:], SYMBOL_ROWS, axis=0)])
    out = FIRST * np.clip(np.log((counts + PRIOR * prior) / ((counts.sum(axis=1, keepdims=True) + PRIOR) * prior)), -MOST, MOST)
    out[:FIXED] = np.maximum(np.log(bias), -30.0)
    return out


def update(weights: np.ndarray, counts: np.ndarray, grad: np.ndarray, share: float) -> np.ndarray:
    """One step along the gradient, each coordinate's scaled by its counts in the slice."""
    step = RATE * grad / (counts * share + TAU)
    out = weights + np.clip(step, -2.0, 2.0)
    out[:FIXED] = np.maximum(out[:FIXED], -30.0)
    out[FIXED:] = np.clip(out[FIXED:], -MOST, MOST)
    return out


# --- training and scoring on Spark -----------------------------------------


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            yield b.column(0).slice(lo, 64).to_pylist()


def _summed(texts: DataFrame, table) -> np.ndarray:
    """The sum of the tasks' ROWS x WIDTH tables; rows of zeros are not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = table(_texts(batches))
        some = np.flatnonzero(found.any(axis=1))
        for lo in range(0, len(some), 4096):
            r = some[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), *(pa.array(found[r, k]) for k in range(WIDTH))], ["row", *columns])

    columns = [f"v{k}" for k in range(WIDTH)]
    sums = texts.select("symbols").mapInArrow(run, ", ".join(["row int", *(f"{c} float" for c in columns)]))
    got = sums.groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    out = np.zeros((ROWS, WIDTH))
    if got.num_rows:
        out[got["row"].to_numpy()] = np.column_stack([got[c].to_numpy() for c in columns])
    return out


def _pairs(texts: DataFrame) -> np.ndarray:
    """Counts of (symbol before, symbol): at most (SYMBOLS + 1) x SYMBOLS cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((SYMBOLS + 1) * SYMBOLS, np.int64)
        for symbols in _texts(batches):
            s, a, *_ = _contexts(symbols)
            kinds, n = _sorted_counts((a * SYMBOLS + s).astype(np.int32))
            out[kinds] += n
        cells = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(out[cells])], ["cell", "n"])

    got = texts.select("symbols").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((SYMBOLS + 1) * SYMBOLS)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(SYMBOLS + 1, SYMBOLS)


def train(texts: DataFrame, part: Column, rounds: int = ROUNDS) -> Model:
    """A model from encoded training texts; ``part`` (0 to rounds - 1) deals them to the rounds."""
    spark = texts.sparkSession
    place = classes(_pairs(texts))
    sent = spark.sparkContext.broadcast(place)
    counts = _summed(texts, lambda batches: counted(sent.value, batches))
    model = Model(first_weights(counts).astype(np.float32), place)
    for k in range(rounds):
        now = spark.sparkContext.broadcast(model)
        grad = _summed(texts.where(part == k), lambda batches: gradient(now.value, batches))  # noqa: B023  used at once
        model = Model(update(model.weights.astype(float), counts, grad, 1.0 / rounds).astype(np.float32), place)
        now.unpersist()
    sent.unpersist()
    return model


def tails(encoded: DataFrame, lex: Lexicon) -> DataFrame:
    """(rid, tail_known, tail_logs): the tokens outside the head that training texts hold, joined with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                ids, keys = b.column(0).slice(lo, 256).to_numpy(), b.column(1).slice(lo, 256).to_pylist()
                each = np.repeat(ids, [len(k) // 8 for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(np.frombuffer(b"".join(keys), np.int64))], ["rid", "key"])

    rows = encoded.where("length(tail) > 0").select("rid", "tail").mapInArrow(run, "rid long, key long")
    rare = lex.counts.where(F.col("n") < lex.least)
    return rows.join(rare, "key").groupBy("rid").agg(F.count("*").alias("tail_known"), F.sum(F.log10(F.col("n") + 1)).alias("tail_logs"))


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) of every row, learnt from the rows where ``training`` is true.

    base_score is the add-one unigram model's log10 probability, score the
    maximum-entropy model's, both over the words and one end. A null or empty
    text has the end alone; rows with null or repeated ids are rows of their
    own, and rows where ``training`` is null are not learnt from. Without a
    training text all tokens are unknown. Other columns are ignored.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    docs = docs.withColumn("slice", F.pmod(F.xxhash64("text", F.lit(11)), F.lit(max(1, rounds))).cast("int"))
    lex = lexicon(docs.where("training"), "text", head)
    encoded = encode(docs, lex, "text", ["id", "training", "slice"])
    model = train(encoded.where("training"), F.col("slice"), rounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                b = whole.slice(lo, 64)
                logs = sent.value.logs(b.column(b.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(logs)], [*b.schema.names[:-1], "model"])

    rows = encoded.select("id", "rid", "n_tokens", "known", "logs", "rare", "symbols")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    rows = rows.mapInArrow(run, f"{kinds}, model double").join(tails(encoded, lex), "rid", "left")
    more = F.coalesce("tail_logs", F.lit(0.0))
    norm = float(np.log10(lex.total + lex.distinct + 1.0))
    return rows.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("model") + F.col("rare") + more).alias("score"),
    )
