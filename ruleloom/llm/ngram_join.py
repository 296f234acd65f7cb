"""N-gram Jaccard self-join by parity sketches.

A document is the set of its distinct word shingles. The hash range is cut into
k buckets; every shingle XORs its hash into its bucket, so two sketches differ
in at most as many buckets as the sets differ in elements. Sets of similarity
t or more, the smaller of size a, differ in at most D = a (100 - t) / t
elements: among any D + 1 buckets one is equal. Each document therefore gives
its first D + 1 non-empty buckets as join keys, in the size band of its own
length and in each band below that its partners' sizes reach. Both members of
a linked pair share such a band; of the two, the one whose keys end first has
D + 1 non-empty buckets there, and an untouched one among them is a key of
both. Documents too sparse for D + 1 buckets also give single shingles, the
first in hash order and so many that two of them share one, so no link is lost.

Equal sets are one vertex. A key's documents are first compared with the
smallest of them only; where that leaves several components under one key, all
pairs across components follow, pruned by a second, 512-bit parity sketch
(Hamming distance never exceeds the symmetric difference) inside the join.
Every surviving pair is verified on the shingles of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.hashing import BITS, mix, text_sets
from ruleloom.operators.components import connected_components
from ruleloom.plans.durable import materialize

WORDS = 8  # of 64 bits, in the second sketch
#: Ids that are sent to every executor at most; more are joined by a shuffle.
SEND_IDS = 500_000


def bands(limit: int = 1 << 40) -> np.ndarray:
    """Lower ends of the size bands, each half as large again as the one before."""
    low = [1]
    while low[-1] < limit:
        low.append(max(low[-1] + 1, low[-1] * 3 // 2))
    return np.array(low, np.int64)


def _band_keys(value: np.ndarray, owner: np.ndarray, size: np.ndarray, band: np.ndarray, low: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Join keys, and their text numbers, of all texts whose band is not negative; and the texts with too few non-empty buckets."""
    mine = band[owner] >= 0
    value, owner = value[mine], owner[mine]
    if not len(value):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = (low[band + 1] - 1) * (100 - t) // t
    need = np.minimum(size * (100 - t) // t, most) + 1
    k = most + 1 + np.maximum(1, (most + 10) // 10)
    bucket = ((value >> np.uint64(BITS - 32)) * k[owner].astype(np.uint64)) >> np.uint64(32)
    start = np.ones(len(value), bool)
    start[1:] = (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(start)
    sketch = np.bitwise_xor.reduceat(mix(value + np.uint64(0x51ED270B)), at)
    who, where = owner[at], bucket[at]
    first = np.ones(len(who), bool)
    first[1:] = who[1:] != who[:-1]
    begin = np.flatnonzero(first)
    rank = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who))))
    keep = rank < need[who]
    place = band[who].astype(np.uint64) << np.uint64(40)
    keys = mix(sketch ^ mix(place + where))[keep]
    filled = np.bincount(who, minlength=len(size))
    return keys, who[keep], np.flatnonzero((filled > 0) & (filled < need))


def _prefix_keys(value: np.ndarray, owner: np.ndarray, size: np.ndarray, texts: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the first shingles, in hash order, of the given texts: two that share t % of their union share one of them."""
    chosen = np.zeros(len(size), bool)
    chosen[texts] = True
    begin = np.cumsum(size) - size
    rank = np.arange(len(value)) - begin[owner]
    keep = chosen[owner] & (rank <= size[owner] - (size[owner] * t + 99) // 100)
    return mix(value[keep] ^ np.uint64(0x3C6EF372FE94F82B)), owner[keep]


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                with np.errstate(over="ignore"):
                    value, owner = text_sets(b.column(1), width)
                    n = b.num_rows
                    size = np.bincount(owner, minlength=n)
                    full = np.flatnonzero(size)
                    at = np.searchsorted(owner, full)
                    f1, f2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                    bits = np.zeros((n, WORDS), np.uint64)
                    if len(full):
                        m = mix(value + np.uint64(0x1234567))
                        f1[full] = np.bitwise_xor.reduceat(m, at)
                        f2[full] = np.add.reduceat(mix(m), at)
                        word, bit = (m >> np.uint64(6)) % np.uint64(WORDS), np.uint64(1) << (m & np.uint64(63))
                        for w in range(WORDS):
                            bits[full, w] = np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), at)
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, n * WORDS + 1, WORDS), pa.int32()), pa.array(bits.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(size.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), sketch], ["id", "n", "f1", "f2", "sketch"]
                )

    return run


def _keys(width: int, t: int):
    """The join keys of each text, made anew from it: they go into one shuffle, and storing them would take as much disk once more."""
    low = bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                with np.errstate(over="ignore"):
                    value, owner = text_sets(b.column(1), width)
                    n = b.num_rows
                    size = np.bincount(owner, minlength=n)
                    band = np.searchsorted(low, np.maximum(size, 1), side="right") - 1
                    band[size * (100 - t) < t] = -1  # such small sets link with equal sets only
                    keys, who, sparse, down = [], [], [], 0
                    while True:  # its own band, and each below that holds sets large enough to be a partner
                        at_band = band if not down else np.where((band >= down) & (size * t <= 100 * (low[np.maximum(band - down + 1, 0)] - 1)), band - down, -1)
                        if not (at_band >= 0).any():
                            break
                        found = _band_keys(value, owner, size, at_band, low, t)
                        keys.append(found[0])
                        who.append(found[1])
                        sparse.append(found[2])
                        down += 1
                    more = _prefix_keys(value, owner, size, np.concatenate([*sparse, np.zeros(0, np.int64)]), t)
                    keys, who = np.concatenate([*keys, more[0]]), np.concatenate([*who, more[1]])
                    order = np.argsort(who, kind="stable")
                    keys, ends = keys[order], np.cumsum(np.bincount(who, minlength=n))
                offsets = pa.array(np.append(0, ends), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64)))], ["id", "keys"])

    return run


def _verify(width: int, t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets, sizes = [], []
                for c in ("ta", "tb"):
                    value, owner = text_sets(b.column(b.schema.get_field_index(c)), width)
                    sets.append((owner.astype(np.uint64) << np.uint64(BITS)) | value)
                    sizes.append(np.bincount(owner, minlength=b.num_rows))
                both = np.intersect1d(*sets, assume_unique=True)
                common = np.bincount((both >> np.uint64(BITS)).astype(np.int64), minlength=b.num_rows)
                ok = pa.array((100 * common >= t * (sizes[0] + sizes[1] - common)) & (common > 0))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(ok)

    return run


def _send(df: DataFrame) -> DataFrame:
    """A broadcast of ``df`` if it has at most SEND_IDS rows, else ``df`` for a shuffled join."""
    return F.broadcast(df) if df.count() <= SEND_IDS else df


def _linked(pairs: DataFrame, texts: DataFrame, width: int, t: int) -> DataFrame:
    """The pairs (a, b) of ids whose whole texts have the similarity."""
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "op1-ids")
    some = texts.join(_send(ids), "id", "left_semi").dropDuplicates(["id"])
    some = materialize(some, "op1-texts")
    both = pairs.join(some.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(some.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "ta", "tb").mapInArrow(_verify(width, t), f"a {kind}, b {kind}")


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of ``docs``.

    Words are runs outside 0x20 and 0x09-0x0D, A-Z lower-cased; a text with
    fewer than ``width`` words is one shingle. Two documents link when their
    sets' Jaccard similarity is at least ``percent`` / 100; the component is
    the smallest id reachable. Null or empty texts and texts of white space
    have n_shingles 0 and are their own component; a row with a null id keeps
    it and links with nothing; repeated ids are one vertex; other columns of
    ``docs`` are ignored. An empty table gives an empty result.
    """
    if not 50 <= percent <= 100 or width < 1:
        raise ValueError("percent must be 50 to 100 and width positive")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    made = materialize(texts.mapInArrow(_sketches(width), f"id {kind}, n long, f1 long, f2 long, sketch array<long>"), "op1-sketches")
    sets = made.where("n > 0 and id is not null")
    classes = materialize(sets.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "op1-classes")
    copies = sets.join(classes.where("copies > 1"), ["f1", "f2", "n"]).where("id <> rep").select("id").distinct()
    copies = materialize(copies, "op1-copies")
    vertices = sets.join(_send(copies), "id", "left_anti")
    keys = texts.where("id is not null").mapInArrow(_keys(width, percent), f"id {kind}, keys array<long>").where(F.size("keys") > 0).join(_send(copies), "id", "left_anti")
    # dealt once: the groups and the join below read the same shuffle
    keyed = keys.select(F.col("id").alias("doc"), F.explode("keys").alias("key")).repartition("key")
    groups = keyed.groupBy("key").agg(F.min("doc").alias("lead"), F.max("doc").alias("last")).where("lead <> last").select("key", "lead")
    members = materialize(keyed.join(groups, "key"), "op1-members")

    facts = vertices.join(_send(materialize(members.select(F.col("doc").alias("id")).distinct(), "op1-near")), "id", "left_semi")
    facts = materialize(facts.select(F.col("id").alias("doc"), "n", "sketch").dropDuplicates(["doc"]), "op1-facts")
    close = f"least(na, nb) * 100 >= greatest(na, nb) * {percent} and (" + " + ".join(f"bit_count(sa[{w}] ^ sb[{w}])" for w in range(WORDS)) + f") * {100 + percent} <= (na + nb) * {100 - percent}"
    left, right = (facts.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")

    star = members.where("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct()
    star = materialize(star.join(left, "a").join(right, "b").where(close).select("a", "b"), "op1-star")
    links = materialize(_linked(star, texts, width, percent), "op1-links")
    comps = materialize(connected_components(links).withColumnRenamed("vertex", "doc"), "op1-comps")

    known = members.select("key", "doc").join(comps, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    known = materialize(known, "op1-known")
    split = known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    open_ = materialize(known.join(split, "key").join(facts, "doc"), "op1-open")
    sides = [open_.select("key", *(F.col(c).alias(f"{c[0]}{x}") for c in ("component", "n", "sketch")), F.col("doc").alias(x)) for x in "ab"]
    more = sides[0].join(sides[1], (sides[0]["key"] == sides[1]["key"]) & F.expr(f"a < b and ca <> cb and {close}")).select("a", "b").distinct()
    more = materialize(more.join(star, ["a", "b"], "left_anti"), "op1-more")
    if not more.isEmpty():
        links = materialize(links.union(_linked(more, texts, width, percent)), "op1-links")
        comps = materialize(connected_components(links).withColumnRenamed("vertex", "doc"), "op1-comps")

    rep = classes.join(comps.withColumnRenamed("doc", "rep"), "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    out = made.select("id", "n", "f1", "f2").join(rep.select("f1", "f2", "n", "component"), ["f1", "f2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
