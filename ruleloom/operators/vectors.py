"""Exact cosine top-k joins, flat and grouped, in balls and parts.

Queries and index rows are dealt into balls around sampled centres, and balls
near each other into parts: a fixed number of parts of each side, PARTS (more
only where one would hold more than QUERIES or INDEX rows). A task takes one pair of parts, so a row is sent to so many
tasks as the other side has parts, however many balls there are, and the best of
a query leave as many tasks as the index has parts. Where a table's own rows ask,
each row is sent for both sides, so there are fewer parts, OWN, as many for a small
table as for a large one. Inside a task single
precision finds what may be among the k best, double precision decides. Each
query ball that the triangle inequality keeps away from some ball first meets the
balls nearest to it, and the least k-th score of its
queries is all that leaves those tasks; it rules out every ball whose vectors that
inequality keeps below it, so those are not compared, nor sent where no
ball of the part wants them. Balls that all overlap have no such first pass. Vectors of single precision are sent as they are, in
half the bytes of their doubles, and normalised where they are compared, by the
operations of :func:`unit` in their order. No task holds an index, a group lies in one part, so its maximum is final
there, and what reaches the driver is a centre and a radius for each ball, BALLS
of them at most. Scores are rounded before they are ranked, and ties go to the
smaller id.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ruleloom.plans.durable import materialize

#: Rows of a ball or block, and balls at most.
BLOCK, BALLS = 4_096, 4_096
#: Parts of the queries and of the index at least, where there are balls enough: 24 tasks with the fewest rows sent, as a query's k best leave it once for each part of the index.
PARTS = 8, 3
#: The same where a table's own rows ask: 12 tasks, a row is sent 7 times.
OWN = 4, 3
#: Rows of a part of the queries and of the index at most.
QUERIES, INDEX = 65_536, 262_144
#: Queries, and scores, that a task holds at once.
ROWS, TILE = 1_024, 1 << 22
DIGITS = 6
#: Neighbouring values of a histogram that one row holds at most.
STEP = 10_000
#: What rounding can add to a score, and to an angle.
SLACK = 2e-6
log = logging.getLogger(__name__)


def unit(vector: str | Column) -> Column:
    """The vector divided by its norm, in doubles; null for a zero, non-finite or null one."""
    v = F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & (norm > 0) & (norm < float("inf"))
    return F.when(fine, F.transform(v, lambda x: x / norm))


def dual(first: Column, second: Column, weight: float) -> Column:
    """One vector whose dot products are weight * cos(first) + (1 - weight) * cos(second)."""
    if not 0 <= weight <= 1:
        raise ValueError("weights must be shares that sum to 1")
    a, b = float(np.sqrt(weight)), float(np.sqrt(1 - weight))
    return F.concat(F.transform(first, lambda x: x * a), F.transform(second, lambda x: x * b))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _normalised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows divided by their norms, rows that have a norm): the same doubles as :func:`unit` gives, added in the same order."""
    with np.errstate(all="ignore"):
        total = np.zeros(len(x))
        for column in x.T:
            total += column * column
        norm = np.sqrt(total)
        return x / norm[:, None], (norm > 0) & (norm < np.inf)


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in doubles: those of single precision are normalised here, others have been before."""
    return _normalised(_matrix(column))[0] if pa.types.is_float32(column.type.value_type) else _matrix(column)


def _centers(index: DataFrame, balls: int) -> np.ndarray:
    """Unit vectors of the rows with the lowest hashes; any one serves as the centre of a single ball."""
    some = [r["unit"] for r in index.orderBy(F.xxhash64("unit")).limit(balls).collect()] if balls > 1 else [r["unit"] for r in index.select("unit").take(1)]
    if not some:
        return np.zeros((1, 1))
    x, fine = _normalised(np.array(some, float))
    return x[fine] if fine.any() else np.eye(1, x.shape[1])


def _in_balls(rows: DataFrame, key: str, centers: np.ndarray, together: bool = False) -> tuple[DataFrame, dict[int, tuple[float, int]]]:
    """``rows`` with ball, and {ball: (largest angle to its centre, rows)}; ``together``: rows of one ``key`` share a ball (their first vector's).

    Rows of single precision without a norm go here.
    """
    sent = rows.sparkSession.sparkContext.broadcast(centers)
    kind = rows.schema[key].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = (_units(b.column(1)) @ sent.value.T).argmax(axis=1) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32))], ["of", "ball"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if pa.types.is_float32(b.schema.field("unit").type.value_type) and b.num_rows:
                b = b.filter(pa.array(_normalised(_matrix(b.column("unit")))[1]))
            if not b.num_rows:
                continue
            x, names = _units(b.column("unit")), [n for n in b.schema.names if n != "ball"]
            if "ball" in b.schema.names:
                ball = b.column("ball").to_numpy()
            else:
                ball = (x @ sent.value.T).argmax(axis=1) if len(sent.value) > 1 else np.zeros(len(x), np.int64)
            angle = np.arccos(np.clip(np.einsum("ij,ij->i", x, sent.value[ball]), -1, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(ball.astype(np.int32)), pa.array(angle)], [*names, "ball", "angle"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", ball int, angle double"
    if together and len(centers) > 1:
        first = rows.groupBy(F.col(key).alias("of")).agg(F.min_by("unit", F.xxhash64("unit")).alias("unit"))
        of = materialize(first.mapInArrow(nearest, f"of {kind}, ball int"), "balls")
        rows = rows.join(of, F.col(key) == F.col("of")).drop("of")
    out = materialize(rows.mapInArrow(placed, schema), "in-balls")
    found = out.groupBy("ball").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect()  # a row a ball
    return out.drop("angle"), {r["ball"]: (r["r"], r["n"]) for r in found}


def _chain(centers: np.ndarray) -> list[int]:
    """The balls, each followed by the nearest that is left."""
    left, order = np.ones(len(centers), bool), [0]
    left[0] = False
    while len(order) < len(centers):
        order.append(int(np.where(left, centers @ centers[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return order


def _dealt(rows: DataFrame, key: str, balls: dict[int, tuple[float, int]], order: list[int], parts: int, most: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``rows`` with part, and the (ball, part) there are; parts are runs of ``order``, balls above ``most`` rows are cut by ``key``."""
    total, so_far, cells = sum(n for _, n in balls.values()), 0.0, []
    for ball in (b for b in order if b in balls):
        blocks = -(-balls[ball][1] // most)
        for block in range(blocks):
            cells.append((ball, block, blocks, int(so_far * parts / total)))
            so_far += balls[ball][1] / blocks
    of = rows.sparkSession.createDataFrame(cells, "ball int, block int, blocks int, part int")
    of = of.groupBy("ball").agg(F.first("blocks").alias("blocks"), F.map_from_entries(F.collect_list(F.struct("block", "part"))).alias("of"))  # a row a ball
    out = rows.join(F.broadcast(of), "ball").withColumn("part", F.col("of")[F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")]).drop("blocks", "of")
    return out, sorted({(ball, part) for ball, _, _, part in cells})


def _paired(queries: DataFrame, index: DataFrame, qcells: list[tuple[int, int]], icells: list[tuple[int, int]], meet: np.ndarray) -> DataFrame:
    """The rows of both sides for every pair of their parts, columns qpart and ipart, that holds balls which ``meet``; a row goes where its ball meets one."""
    spark = queries.sparkSession

    def listed(mine: list[tuple[int, int]], theirs: list[tuple[int, int]], meet: np.ndarray, names: str) -> DataFrame:
        of: dict[int, list[int]] = {}
        for ball, part in theirs:
            of.setdefault(part, []).append(ball)
        return F.broadcast(spark.createDataFrame([(ball, part, p) for ball, part in mine for p, balls in of.items() if meet[ball, balls].any()], names))  # at most balls x parts

    q = queries.withColumnRenamed("part", "qpart").join(listed(qcells, icells, meet, "ball int, qpart int, ipart int"), ["ball", "qpart"])
    i = index.withColumnRenamed("part", "ipart").join(listed(icells, qcells, meet.T, "ball int, ipart int, qpart int"), ["ball", "ipart"])
    return q.unionByName(i, allowMissingColumns=True)


def _ranked(queries: DataFrame | None, index: DataFrame, key: str, k: int, prepare: Callable, schema: str, order: list, together: bool = False) -> DataFrame:
    """The k best rows of each qid over those pairs of balls that can hold them; ``skipped``: (pairs left out, all pairs).

    Without ``queries`` the index's own rows ask. ``prepare`` takes a part of the
    index and gives (that part in its order, what makes a table from a table of
    queries and the places they meet).
    """
    n_index = index.count()
    centers = _centers(index, max(1, min(BALLS, -(-n_index // BLOCK))))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    best = lambda part: part.withColumn("rank", rank).where(F.col("rank") <= k)
    i, ri = _in_balls(index, key, centers, together)
    q, rq = (i.select(F.col(key).alias("qid"), "unit", F.lit(True).alias("asks"), "ball"), ri) if queries is None else _in_balls(queries, "qid", centers)
    chain, n_queries = _chain(centers), sum(n for _, n in rq.values())
    # where own rows ask, so many parts from a few blocks on that what is sent grows as the table does
    (asking, asked), most, cut = (PARTS, QUERIES, BLOCK) if queries is not None else (OWN, INDEX, max(1, BLOCK // 4))
    parts = lambda n, least, most: max(min(least, -(-n // cut)), -(-n // most))
    i, icells = _dealt(i, key, ri, chain, parts(n_index, asked, INDEX), cut)
    q, qcells = _dealt(q, "qid", rq, chain, parts(n_queries, asking, most), cut)

    def score(pairs: list[tuple[int, int]], bounds: bool = False) -> DataFrame:
        """Each task's best rows of a query or, for ``bounds``, (qpart, ball, low): a score that the k best of each of the ball's queries there reach."""
        meet = np.zeros((len(centers), len(centers)), bool)
        for a, b in pairs:
            meet[a, b] = True
        sent = index.sparkSession.sparkContext.broadcast(meet)

        def run(table: pa.Table) -> pa.Table:
            asks = np.asarray(table["asks"].combine_chunks().to_numpy(zero_copy_only=False))
            a, b = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
            b, make = prepare(b)
            mine, theirs, out = a["ball"].to_numpy(), b["ball"].to_numpy(), [make(a.slice(0, 0), np.zeros(0, np.int64))]
            lows: list[tuple[int, int, float]] = []
            for ball in np.unique(mine):
                places, rows = np.flatnonzero(sent.value[ball][theirs]), np.flatnonzero(mine == ball)
                if bounds and len(places) < k:  # another part of the index may bound them
                    continue
                chunks = [a.take(pa.array(rows[at : at + ROWS])) for at in range(0, len(rows), ROWS)]
                if bounds:
                    lows.append((a["qpart"][0].as_py(), int(ball), min(_reached(c, make(c, places), k) for c in chunks)))
                else:
                    out += [make(c, places) for c in chunks]
            if bounds:
                return pa.table([pa.array([r[c] for r in lows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["qpart", "ball", "low"])
            return pa.concat_tables(out)

        return _paired(q, i, qcells, icells, meet).groupBy("qpart", "ipart").applyInArrow(run, "qpart int, ball int, low double" if bounds else schema)

    between = np.arccos(np.clip(centers @ centers.T, -1, 1)) if n_index else np.zeros((1, 1))
    # the least angle of a query and an index vector, by the triangle inequality
    least = {(a, b): max(0.0, between[a, b] - rq[a][0] - ri[b][0]) for a in rq for b in ri}
    if len(ri) <= 1:
        out = best(score(sorted(least)))
        out.skipped = 0, len(least)
        return out
    near: list[tuple[int, int]] = []
    for a in rq:
        if max(least[a, b] for b in ri) <= SLACK:  # no bound can rule out a ball for it
            continue
        seen = 0
        for b in sorted(ri, key=lambda b: (between[a, b], b)):
            near.append((a, b))
            seen += ri[b][1]
            if seen > k:
                break
    # of several parts of the index the best bound holds, of several parts of a ball's queries the least
    lows = {(r["ball"], r["qpart"]): r["low"] for r in score(near, bounds=True).groupBy("ball", "qpart").agg(F.max("low").alias("low")).collect()} if near else {}  # at most balls x parts
    bound: dict[int, float] = {}
    for cell in qcells:
        bound[cell[0]] = min(bound.get(cell[0], np.inf), lows.get(cell, -2.0))
    met = set(near)
    pairs = [p for p, angle in sorted(least.items()) if p in met or np.cos(max(0.0, angle - SLACK)) + SLACK >= bound[p[0]]]
    log.info("%d of %d pairs of balls can't hold any of the %d best", len(least) - len(pairs), len(least), k)
    out = best(score(pairs))
    out.skipped = len(least) - len(pairs), len(least)
    return out


def _reached(asked: pa.Table, found: pa.Table, k: int) -> float:
    """The least score of ``found`` if each qid of ``asked`` has k rows in it, else -2, which all scores reach."""
    per = found.group_by("qid").aggregate([("score", "count"), ("score", "min")])
    if per.num_rows < pc.count_distinct(asked["qid"]).as_py() or pc.min(per["score_count"]).as_py() < k:
        return -2.0
    low = pc.min(per["score_min"]).as_py()
    return low / 10**DIGITS if pa.types.is_integer(found["score"].type) else low


def _best(scores: np.ndarray, ties: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties in order: only those at or above the k-th score are sorted."""
    if k < len(scores):
        some = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return some[np.lexsort((ties[some], -scores[some]))][:k]
    return np.lexsort((ties, -scores))


def _nearest(a: np.ndarray, b: np.ndarray, single: np.ndarray, places: np.ndarray, k: int, clip: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, place in ``b``, rounded score): the k best of ``places`` for each row, ties to the lower place.

    ``single`` is ``b`` in single precision. Its scores and their largest error
    rule out what is below the k-th score so far; the others are scored in
    double precision.
    """
    size = np.linalg.norm(a, axis=1).max(initial=0) * np.sqrt(np.einsum("ij,ij->i", single, single).max(initial=0))
    slack = 10.0**-DIGITS + (a.shape[1] + 4) * 2.0**-23 * float(size)
    low, mine, step = np.full(len(a), -np.inf), a.astype(np.float32), max(k + 1, TILE // max(1, len(a)))
    row, place, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(places), step):
        p = places[at : at + step]
        rough = mine @ single[p].T
        if not at and len(p) > k:
            low = np.partition(rough, len(p) - k, axis=1)[:, len(p) - k] - 2 * slack
            low = np.minimum(low, 1 - 2 * slack) if clip else low
        r, c = np.nonzero(rough >= low[:, None])
        for part in range(0, len(r), 1 << 16):
            x, y = r[part : part + (1 << 16)], p[c[part : part + (1 << 16)]]
            exact = np.einsum("ij,ij->i", a[x], b[y])
            new.append((x, y, np.round(np.clip(exact, -1, 1) if clip else exact, DIGITS)))
        if at and at + step < len(places) and sum(len(x[0]) for x in new) < 2 * k * len(a):
            continue
        row, place, score = (np.concatenate(x) for x in zip((row, place, score), *new, strict=True))
        order = np.lexsort((place, -score, row))
        row, place, score, new = row[order], place[order], score[order], []
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        low[row[nth == k - 1]] = score[nth == k - 1] - slack
        row, place, score = row[nth < k], place[nth < k], score[nth < k]
    return row, place, score


def top_k(queries: DataFrame | None, index: DataFrame, k: int, exclude_self: bool = False, clip: bool = False, order: str = "id") -> DataFrame:
    """(qid, id, score, rank) of the k best index rows for each query.

    ``queries``: qid, unit; without them the index's own rows ask. ``index``:
    id, unit, unit vectors as ``unit`` makes them, or vectors of single
    precision that are not normalised yet (rows with null vectors, and those
    that ``unit`` makes null, match nothing). ``order`` names an index column
    by which ties go; rounded scores rank first.
    """
    q = None if queries is None else queries.where("unit is not null").select("qid", "unit", F.lit(True).alias("asks"))
    i = index.where("unit is not null").select("id", "unit", F.col(order).alias("tie") if order != "id" else F.col("id").alias("tie"), F.lit(False).alias("asks"))
    ik = i.schema["id"].dataType.simpleString()
    qk = q.schema["qid"].dataType.simpleString() if q is not None else ik
    tie = {} if order == "id" else {"tie": i.schema["tie"].dataType.simpleString()}

    def prepare(b: pa.Table) -> tuple[pa.Table, Callable]:
        b = b.sort_by([("tie", "ascending"), ("id", "ascending")])
        x = _units(b["unit"])
        single = x.astype(np.float32)

        def make(a: pa.Table, places: np.ndarray) -> pa.Table:
            row, place, score = _nearest(_units(a["unit"]), x, single, places, k + exclude_self, clip)
            qid, ident = a["qid"].take(pa.array(row)), b["id"].take(pa.array(place))
            rounded = pa.array(np.rint(score * 10**DIGITS).astype(np.int64))  # whole numbers take fewer bytes in a shuffle
            out = pa.table([qid, ident, rounded, *(b[t].take(pa.array(place)) for t in tie)], names=["qid", "id", "score", *tie])
            if not exclude_self:
                return out
            same = pc.equal(qid, ident) if qid.type == ident.type else pa.array([u == v for u, v in zip(qid.to_pylist(), ident.to_pylist(), strict=True)], pa.bool_())
            return out.filter(pc.invert(same))

        return b, make

    found = _ranked(q, i, "id", k, prepare, ", ".join([f"qid {qk}, id {ik}, score long", *(f"{t} {kind}" for t, kind in tie.items())]), [F.desc("score"), *(F.col(t) for t in tie), F.col("id")])
    out = found.select("qid", "id", (F.col("score") / 10**DIGITS).alias("score"), "rank")
    out.skipped = found.skipped
    return out


def top_groups(queries: DataFrame, index: DataFrame, k: int, clip: bool = True) -> DataFrame:
    """(qid, family, score, base_score, best_variant_score, matched_id, rank): the k best families of each query.

    ``index``: id, family, is_base, unit. A family scores its best
    representation; on equal scores the base matches, then the smaller id.
    base_score and best_variant_score are null where a family has no such
    representation; ties between families go to the smaller family.
    """
    q = queries.where("unit is not null").select("qid", "unit", F.lit(True).alias("asks"))
    i = index.where("unit is not null").select("id", "family", "is_base", "unit", F.lit(False).alias("asks"))
    qk, ik, fk = q.schema["qid"].dataType.simpleString(), i.schema["id"].dataType.simpleString(), i.schema["family"].dataType.simpleString()

    def prepare(b: pa.Table) -> tuple[pa.Table, Callable]:
        b = b.sort_by([("family", "ascending"), ("is_base", "descending"), ("id", "ascending")])
        ids, names = b["id"].to_pylist(), b["family"].to_pylist()
        x, base = _units(b["unit"]), np.array(b["is_base"].to_pylist(), bool)
        changes = np.array([n == 0 or names[n] != names[n - 1] for n in range(len(names))], bool)
        group = np.cumsum(changes)

        def make(a: pa.Table, places: np.ndarray) -> pa.Table:
            out: list[tuple] = []
            first = np.flatnonzero(np.diff(group[places], prepend=-1))
            ends, is_base, there, low = np.append(first[1:], len(places)), base[places], x[places], -np.inf
            step = max(1, TILE // max(1, len(places)))
            for at in range(0, a.num_rows if len(places) else 0, step):
                part = a.slice(at, step)
                scores = _units(part["unit"]) @ there.T
                scores = np.round(np.clip(scores, -1, 1) if clip else scores, DIGITS)
                best = np.maximum.reduceat(scores, first, axis=1)
                base_best = np.maximum.reduceat(np.where(is_base, scores, low), first, axis=1)
                variant_best = np.maximum.reduceat(np.where(is_base, low, scores), first, axis=1)
                for n, qid in enumerate(part["qid"].to_pylist()):
                    for g in _best(best[n], np.arange(len(first)), k):
                        at_most = first[g] + int(scores[n, first[g] : ends[g]].argmax())
                        some = lambda v: float(v) if v > low else None
                        out.append((qid, names[places[first[g]]], float(best[n, g]), some(base_best[n, g]), some(variant_best[n, g]), ids[places[at_most]]))
            kinds = (a.schema.field("qid").type, b.schema.field("family").type, pa.float64(), pa.float64(), pa.float64(), b.schema.field("id").type)
            return pa.table([pa.array([r[c] for r in out], type=t) for c, t in enumerate(kinds)], names=["qid", "family", "score", "base_score", "best_variant_score", "matched_id"])

        return b, make

    return _ranked(q, i, "family", k, prepare, f"qid {qk}, family {fk}, score double, base_score double, best_variant_score double, matched_id {ik}", [F.desc("score"), F.col("family")], together=True)


SHARES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
FIGURES = ("min", "p10", "p25", "median", "mean", "p75", "p90", "p95", "p99", "max")


def distribution(rows: DataFrame, by: str, digits: int = DIGITS) -> DataFrame:
    """(``by``, n, min, p10, p25, median, mean, p75, p90, p95, p99, max) of the cosines of all pairs of different rows of (id, unit, ``by``), each pair once for either row, by that row's ``by``.

    ``unit``: as for :func:`top_k`. Rows are dealt into OWN parts a side, so a
    row is sent 7 times up to 4 * INDEX rows, and a task takes a pair of parts. What leaves it
    are histograms of the scores rounded to ``digits``: at most 2 * 10**digits + 1
    values for each ``by``, however many rows, in which the quantiles are exact,
    linearly interpolated. No pair is emitted and no partner left out. Rows
    without an id or a unit vector have no pairs.
    """
    v = rows.where("unit is not null and id is not null").select("id", "unit", F.col(by).alias("by"), F.xxhash64("id").alias("h"))
    n, scale, kind = v.count(), 10**digits, rows.schema[by].dataType.simpleString()
    a, b = (max(min(least, -(-n // max(1, BLOCK // 4))), -(-n // INDEX), 1) for least in OWN)
    place = lambda parts: F.pmod("h", F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = v.select("id", "unit", "by", place(a).alias("qpart"), every(b).alias("ipart"), F.lit(True).alias("asks"))
    right = v.select("id", "unit", F.lit(None).cast(kind).alias("by"), every(a).alias("qpart"), place(b).alias("ipart"), F.lit(False).alias("asks"))

    def fine(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        if not pa.types.is_float32(table["unit"].type.value_type):
            return table, _matrix(table["unit"])
        x, some = _normalised(_matrix(table["unit"]))
        return table.filter(pa.array(some)), x[some]

    def run(table: pa.Table) -> pa.Table:
        asks = np.asarray(table["asks"].combine_chunks().to_numpy(zero_copy_only=False))
        mine, x = fine(table.filter(pa.array(asks)))
        theirs, y = fine(table.filter(pa.array(~asks)))
        out: list[tuple] = []
        if len(x) and len(y):
            order = pc.sort_indices(theirs["id"]).to_numpy()
            ids, y = theirs["id"].to_numpy()[order], y[order].T
            own = mine["id"].to_numpy()
            same = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
            labels = mine["by"].combine_chunks().dictionary_encode(null_encoding="encode")
            codes, step = labels.indices.to_numpy(), max(1, TILE // y.shape[1])
            for code in np.unique(codes):
                at = np.flatnonzero(codes == code)
                whole = np.zeros(2 * scale + 2, np.int64) if len(at) * len(ids) > scale else None  # the first is for a row with itself
                few: list[np.ndarray] = []
                for some in (at[i : i + step] for i in range(0, len(at), step)):
                    scores = x[some] @ y
                    np.rint(np.multiply(np.clip(scores, -1, 1, out=scores), scale, out=scores), out=scores)
                    places = scores.astype(np.int64) + scale + 1
                    for r, i in enumerate(some):
                        places[r, same[0][i] : same[1][i]] = 0
                    if whole is None:
                        few.append(places.ravel())
                    else:
                        whole += np.bincount(places.ravel(), minlength=len(whole))
                values, counts = np.unique(np.concatenate(few), return_counts=True) if whole is None else (np.flatnonzero(whole), whole[whole > 0])
                counts, values = counts[values > 0], values[values > 0] - scale - 1
                cuts = np.flatnonzero(np.diff(values // STEP)) + 1
                out += [(labels.dictionary[int(code)].as_py(), int(u[0] // STEP), u, w) for u, w in zip(np.split(values, cuts), np.split(counts, cuts), strict=True) if len(u)]
        return histogram(out)

    def histogram(found: list[tuple]) -> pa.Table:
        kinds = (schema.field("by").type, pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.table([pa.array([r[c] for r in found], type=t) for c, t in enumerate(kinds)], names=["by", "step", "values", "counts"])

    def added(table: pa.Table) -> pa.Table:
        values, where = np.unique(table["values"].combine_chunks().flatten().to_numpy(), return_inverse=True)
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, where, table["counts"].combine_chunks().flatten().to_numpy())
        return histogram([(table["by"][0].as_py(), table["step"][0].as_py(), values, counts)])

    def figures(table: pa.Table) -> pa.Table:
        values, counts = (table[c].combine_chunks().flatten().to_numpy() for c in ("values", "counts"))
        order = np.argsort(values)
        values, upto = values[order], np.cumsum(counts[order])
        total = int(upto[-1])
        row = {"min": values[0] / scale, "mean": float(values.astype(float) @ counts[order]) / scale / total, "max": values[-1] / scale}
        for name, share in SHARES.items():
            at = (total - 1) * share
            low, high = (values[np.searchsorted(upto, r, "right")] / scale for r in (int(np.floor(at)), int(np.ceil(at))))
            row[name] = low + (high - low) * (at - np.floor(at))
        return pa.table([table["by"].slice(0, 1), pa.array([total]), *(pa.array([float(row[c])]) for c in FIGURES)], names=["by", "n", *FIGURES])

    schema = pa.schema([pa.field("by", to_arrow_type(rows.schema[by].dataType))])
    made = f"by {kind}, step int, values array<int>, counts array<long>"
    found = left.unionByName(right).groupBy("qpart", "ipart").applyInArrow(run, made).groupBy("by", "step").applyInArrow(added, made)
    found = found.groupBy("by").applyInArrow(figures, ", ".join([f"by {kind}, n long", *(f"{c} double" for c in FIGURES)]))  # a histogram, not rows
    return found.select(F.col("by").alias(by), "n", *(F.round(c, digits + 2).alias(c) for c in FIGURES))


def pair_distribution(rows: DataFrame, digits: int = DIGITS) -> DataFrame:
    """One row (n, min, p10, p25, median, mean, p75, p90, p95, p99, max) of the cosines of all pairs of different rows of (id, unit).

    Each pair of blocks is a product that leaves its task as a histogram of the
    scores rounded to ``digits``; the histograms add up to one of at most
    2 * 10**digits + 1 values, in which the quantiles are exact, linearly
    interpolated. No pair is emitted. Rows without a unit vector have no pairs;
    without any pair all but n is null.
    """
    v = rows.where("unit is not null").select("unit", F.xxhash64("id").alias("h"))
    blocks = max(1, -(-v.count() // BLOCK))
    mine = F.pmod("h", F.lit(blocks)).cast("int")
    v = v.withColumn("mine", mine)
    left = v.withColumn("a", F.col("mine")).withColumn("b", F.explode(F.sequence(F.col("mine"), F.lit(blocks - 1)))).withColumn("asks", F.lit(True))
    right = v.where("mine > 0").withColumn("b", F.col("mine")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("mine") - 1))).withColumn("asks", F.lit(False))

    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].combine_chunks().to_numpy(zero_copy_only=False)
        x = _matrix(table["unit"])
        if table["a"][0].as_py() == table["b"][0].as_py():
            scores = (x @ x.T)[np.triu_indices(len(x), 1)]
        else:
            scores = (x[asks] @ x[~asks].T).ravel()
        values, n = np.unique(np.rint(np.clip(scores, -1, 1) * 10**digits).astype(np.int64), return_counts=True)
        return pa.table([pa.array(values), pa.array(n)], names=["value", "n"])

    found = left.unionByName(right).select("a", "b", "unit", "asks").groupBy("a", "b").applyInArrow(run, "value long, n long")
    found = materialize(found.groupBy("value").agg(F.sum("n").alias("n")), "pair-scores")
    scale, n = 10.0**digits, F.sum("n")
    whole = found.agg(n.alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum(F.col("value") * F.col("n")).alias("sum")).first()
    shares = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    total = whole["n"] or 0
    # coarse steps of the histogram first, so that only the wanted steps are ordered
    step = F.floor(F.col("value") / 1000)
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    coarse = found.groupBy(step.alias("step")).agg(n.alias("m")).withColumn("base", F.coalesce(F.sum("m").over(upto), F.lit(0)))  # at most 2 * 10**digits / 1000 + 1 rows
    inside = Window.partitionBy("step").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = found.withColumn("step", step).join(F.broadcast(coarse), "step").withColumn("upto", F.col("base") + F.sum("n").over(inside))
    wanted = sorted({r for p in shares.values() for at in [(total - 1) * p] for r in (int(np.floor(at)), int(np.ceil(at)))}) if total else []
    at = {r: F.min(F.when(F.col("upto") > r, F.col("value"))) for r in wanted}
    got = ends.agg(*(c.alias(f"r{r}") for r, c in at.items())).first() if wanted else None

    def quantile(p: float) -> float | None:
        if not total:
            return None
        low = int(np.floor((total - 1) * p))
        a, b = got[f"r{low}"] / scale, got[f"r{int(np.ceil((total - 1) * p))}"] / scale
        return a + (b - a) * ((total - 1) * p - low)

    row = {"n": total, "min": whole["min"] / scale if total else None, "mean": whole["sum"] / scale / total if total else None, "max": whole["max"] / scale if total else None} | {k: quantile(p) for k, p in shares.items()}
    names = ["n", "min", "p10", "p25", "median", "mean", "p75", "p90", "p95", "p99", "max"]
    made = rows.sparkSession.createDataFrame([tuple(row[c] for c in names)], ", ".join(["n long", *(f"{c} double" for c in names[1:])]))
    return made.select("n", *(F.round(c, digits + 2).alias(c) for c in names[1:]))
