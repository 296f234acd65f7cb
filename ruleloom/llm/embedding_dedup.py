"""Near-duplicate vectors by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; the two indices of the
nearest centroids name one cell of the product grid. Every vector is stored in
its cell and looks into the cells that the multi-sequence traversal yields
first: cells in order of the sum of the two distances, found with a heap over
the two sorted lists. How many it looks into is set so that a simulated
neighbour exactly at the threshold is found with the target probability by one
side or the other; all that meet in a cell are then compared in double
precision, so nothing below the threshold links.

Labels are compared within themselves only, so each takes as many centroids as
its own size asks for, without a ceiling: labels whose sizes ask for the same
number, in powers of two, share codebooks, which come from a sample of their
vectors that grows with the centroids alone. The index holds every vector.

Equal vectors are one vertex with a multiplicity. Large cells are split into
blocks on both sides, each pair of blocks is one matrix product, and a block
gives link counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.operators.components import connected_components
from ruleloom.plans.durable import materialize

#: The sample for codebooks of k centroids holds about PER_CENTROID k vectors, LEAST at least; simulated neighbours for the number of visits.
LEAST, PER_CENTROID, SIMULATED = 4_000, 32, 2_000
#: Probability with which a neighbour at the threshold is to be found.
TARGET = 0.99
#: Vectors a cell is meant to hold, and the blocks of stored and of visiting vectors.
FILL, STORED, VISITING = 32, 1_024, 4_096
#: Distances that are held at once.
ROOM = 1 << 21
#: Labels whose sizes are sent to every executor at most; more are joined by a shuffle.
SEND_LABELS = 200_000


@dataclass
class Codebooks:
    halves: tuple[np.ndarray, np.ndarray]
    visits: int

    def traverse(self, x: np.ndarray) -> list[list[int]]:
        """The first ``visits`` cells of each row of unit vectors, nearest first."""
        cut, k, out = x.shape[1] // 2, len(self.halves[0]), []
        step = max(1, ROOM // k)
        for at in range(0, len(x), step):
            y = x[at : at + step]
            ds = [distances(y[:, :cut], self.halves[0]), distances(y[:, cut:], self.halves[1])]
            orders = [np.argsort(d, axis=1, kind="stable")[:, : self.visits] for d in ds]  # no later one can be reached
            a, b = (np.take_along_axis(d, o, 1).tolist() for d, o in zip(ds, orders, strict=True))
            ia, ib = (o.tolist() for o in orders)
            out += [multi_sequence(*row, k, self.visits) for row in zip(a, b, ia, ib, strict=True)]
        return out

    def home(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The distances to both codebooks, and the nearest centroid in each."""
        cut = x.shape[1] // 2
        ds = [distances(x[:, :cut], self.halves[0]), distances(x[:, cut:], self.halves[1])]
        return ds, [d.argmin(1) for d in ds]


def multi_sequence(a: list[float], b: list[float], ia: list[int], ib: list[int], k: int, most: int) -> list[int]:
    """Cells (ia[i] * k + ib[j]) by increasing a[i] + b[j], both lists ascending."""
    heap, seen, out = [(a[0] + b[0], 0, 0)], {(0, 0)}, []
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        out.append(ia[i] * k + ib[j])
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(a) and n[1] < len(b) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (a[n[0]] + b[n[1]], *n))
    return out


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None, :]


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    step = max(1, ROOM // k)
    for _ in range(rounds):
        near = np.concatenate([distances(x[at : at + step], c).argmin(1) for at in range(0, len(x), step)])
        size = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def rank(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many cells come before cell (i, j) when a[i] + b[j] orders them: its place in the multi-sequence traversal."""
    return int(np.searchsorted(np.sort(b), a[i] + b[j] - a - 1e-12, side="left").sum())  # less a rounding, so as not to count itself


def fit(x: np.ndarray, k: int, threshold: float, target: float = TARGET, seed: int = 0) -> Codebooks:
    """Codebooks of the sample ``x`` of unit vectors, and the visits that reach the target."""
    rng = np.random.default_rng(seed)
    cut = x.shape[1] // 2
    if cut == 0 or k < 2 or len(x) < 2 * k:
        return Codebooks((np.zeros((1, cut)), np.zeros((1, x.shape[1] - cut))), 1)
    books = Codebooks((kmeans(x[:, :cut], k, rng), kmeans(x[:, cut:], k, rng)), k * k)
    a = x[rng.choice(len(x), min(len(x), SIMULATED), replace=False)]
    u = rng.standard_normal(a.shape)
    u -= (u * a).sum(1)[:, None] * a
    norm = np.linalg.norm(u, axis=1)[:, None]
    b = threshold * a + np.sqrt(max(0.0, 1 - threshold * threshold)) * np.divide(u, norm, out=np.zeros_like(u), where=norm > 0)
    ranks = []
    for at in range(0, len(a), max(1, ROOM // k)):
        (da, ha), (db, hb) = (books.home(y[at : at + max(1, ROOM // k)]) for y in (a, b))
        ranks += [min(rank(da[0][r], da[1][r], hb[0][r], hb[1][r]), rank(db[0][r], db[1][r], ha[0][r], ha[1][r])) for r in range(len(ha[0]))]
    ranks.sort()
    books.visits = ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))] + 1
    return books


def units(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length in double precision, divided by their norms."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _assign(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                width, bits = np.asarray(b.column(3).value_lengths()), np.asarray(b.column(4))
                cells: list = [None] * b.num_rows
                for d, k in np.unique(np.stack([width, bits]), axis=1).T:
                    rows = np.flatnonzero((width == d) & (bits == k))
                    books = sent.value.get((int(d), int(k)))
                    found = books.traverse(units(b.column(3).take(pa.array(rows)))) if books else [[0]] * len(rows)
                    for r, x in zip(rows, found, strict=True):
                        cells[r] = x
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(cells, pa.list_(pa.int64()))], ["id", "label", "m", "vec", "cells"])

    return run


def compare(ids: np.ndarray, cells: np.ndarray, weight: np.ndarray, vectors: np.ndarray, stored: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(link count, smallest linked id within the block) of each row.

    ``cells``: the cells each row visits, its own first. ``stored`` says which rows lie in the cell; the others visit it. A link
    that both of its ends find is counted at each end by that end's own visit.
    """
    s, v = np.flatnonzero(stored), np.flatnonzero(~stored)
    a, b = np.nonzero(vectors[v] @ vectors[s].T >= threshold)
    a, b = v[a], s[b]
    keep = ids[a] != ids[b]
    a, b = a[keep], b[keep]
    count, least = np.zeros(len(ids), np.int64), ids.copy()
    np.add.at(count, a, weight[b])
    back = np.ones(len(a), bool)
    for at in range(0, len(a), 1 << 16):  # whether the stored one's own visits find the visitor at home
        part = slice(at, at + (1 << 16))
        back[part] = ~(cells[b[part]] == cells[a[part], :1]).any(axis=1)
    np.add.at(count, b[back], weight[a[back]])
    while len(a):
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        # the same vector may be stored and visiting
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1]))
        low = np.minimum.reduceat(least[order], first)
        least[order] = np.repeat(low, np.diff(np.append(first, len(ids))))
        if (least == before).all():
            break
    return count, least


def _compare(threshold: float, schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table["id"].combine_chunks()).astype(np.int64)
        cells = table["cells"].combine_chunks()  # of one label, so of one length
        cells = cells.flatten().to_numpy(zero_copy_only=False).reshape(len(cells), -1)
        count, least = compare(ids, cells, np.asarray(table["m"].combine_chunks()), units(table["vec"]), np.asarray(table["stored"].combine_chunks().to_numpy(zero_copy_only=False)), threshold)
        some = (count > 0) | (least < ids)
        return pa.table([pa.array(ids[some]), pa.array(count[some]), pa.array(least[some])], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", target: float = TARGET) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of ``vectors``; ids are longs.

    Vectors link when their labels are equal and not null, their lengths are
    equal, and the cosine is at least ``threshold``. Null and zero vectors, and
    such with null or non-finite components, link with nothing; they, and rows
    with a null id, are their own component. Repeated rows are vectors of their
    own that share an id. ``kept`` is false for a null id. Other columns are
    ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    sound = F.expr("id is not null and label is not null and vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)")
    sound = F.coalesce(sound, F.lit(False))
    reps = materialize(rows.where(sound).groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("m")).select("id", "label", "m", "vec"), "op5-vectors")

    # the centroids a label asks for, a power of two; a sample of each such class of labels, by hash
    bits = F.greatest(F.lit(0), F.round(F.log2(F.sqrt(F.col("n") / F.lit(float(FILL)))))).cast("int")
    labels = materialize(reps.groupBy("label", F.size("vec").alias("width")).agg(F.count("*").alias("n")).withColumn("bits", bits), "op5-labels")
    classes = labels.where("bits > 0").groupBy("width", "bits").agg(F.sum("n").alias("n")).collect()  # a row a width and power of two
    few = F.broadcast(labels.select("label", "width", "bits")) if labels.count() <= SEND_LABELS else labels.select("label", "width", "bits")
    reps = reps.withColumn("width", F.size("vec")).join(few, ["label", "width"]).select("id", "label", "m", "vec", "bits")
    draw = F.shiftrightunsigned(F.xxhash64("id", "vec", F.lit("sample")), 11) / F.lit(float(1 << 53))
    share = {(c["width"], c["bits"]): min(1.0, max(LEAST, PER_CENTROID << c["bits"]) / c["n"]) for c in classes}
    books = {}
    if share:
        chosen = F.coalesce(*(F.when((F.size("vec") == d) & (F.col("bits") == k), F.lit(x)) for (d, k), x in share.items()), F.lit(0.0))
        sample = reps.where(draw < chosen).select("id", "vec", "bits").orderBy("id", "vec").select("vec", "bits").toArrow()
        vecs, powers = sample["vec"].combine_chunks(), np.asarray(sample["bits"])
        width = np.asarray(vecs.value_lengths()) if len(vecs) else np.zeros(0, int)
        books = {(d, k): fit(units(vecs.take(pa.array(np.flatnonzero((width == d) & (powers == k))))), 1 << k, threshold, target) for d, k in share}
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    kinds = {f.name: f.dataType.simpleString() for f in reps.schema}
    cells = materialize(reps.mapInArrow(_assign(sent), f"id long, label {kinds['label']}, m long, vec {kinds['vec']}, cells array<bigint>"), "op5-cells")
    key = ["label", "width", "cell"]
    cells = cells.withColumn("width", F.size("vec"))
    home = cells.groupBy("label", "width", F.col("cells")[0].alias("cell")).agg(F.ceil(F.count("*") / STORED).cast("int").alias("ns"))
    visits = cells.select("label", "width", F.explode("cells").alias("cell")).groupBy(*key).agg(F.ceil(F.count("*") / VISITING).cast("int").alias("nv"))
    sizes = materialize(home.join(visits, key), "op5-cell-sizes")
    part = lambda n, salt: F.pmod(F.xxhash64("id", "vec", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = cells.withColumn("cell", F.col("cells")[0]).join(sizes, key).withColumn("s", part(F.col("ns"), 1)).withColumn("v", every("nv")).withColumn("stored", F.lit(True))
    visiting = cells.withColumn("cell", F.explode("cells")).join(sizes, key).withColumn("v", part(F.col("nv"), 2)).withColumn("s", every("ns")).withColumn("stored", F.lit(False))
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("least", pa.int64())])
    found = stored.unionByName(visiting).groupBy(*key, "s", "v").applyInArrow(_compare(threshold, schema), "id long, n long, least long")
    found = materialize(found, "op5-links")

    comps = connected_components(found.where("least < id").select("least", "id"))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    known = reps.join(links, "id", "left").join(comps.withColumnRenamed("vertex", "id"), "id", "left")
    known = known.select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    out = rows.withColumn("ok", sound)
    good = out.where("ok").join(known, ["label", "vec"]).select("id", "n", "component")
    rest = out.where("not ok").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    return good.union(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
