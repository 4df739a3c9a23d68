"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from flowtriage.functions.joins import lookup
from flowtriage.llm.common import bounded_batches, cut, stored
from flowtriage.llm.components import components

MIN_COSINE = 0.95
# A vector is described by its nearest pivots, in order; a pair is looked at if it shares so many of them.
NEAREST = 8
SHARED = 3
MIN_PIVOTS, MAX_PIVOTS = 256, 16384
SEED = 42
# Pivots and the sample they are drawn from are held by the driver and sent to the tasks.
_PIVOT_BYTES, _SAMPLE_BYTES = 1 << 25, 1 << 26
_CELLS = 1 << 22
# Rounding of an angle near zero.
_SLACK = 1e-6

_DESCRIBED = "node bigint, first bigint, copies bigint, unit array<double>, near array<int>, home bigint"
_GATHERED = "item bigint, ball bigint, center array<double>, radius double, size bigint, n_nodes bigint, near array<int>, home bigint"


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: finite components that are not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


@F.pandas_udf(DoubleType())
def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Inner products of unit vectors."""
    if not len(a):
        return pd.Series([], dtype=float)
    starts = np.cumsum([0, *map(len, a[:-1])])
    return pd.Series(np.add.reduceat(np.concatenate(a.to_numpy()) * np.concatenate(b.to_numpy()), starts))


def _angle(c: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def _rows(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), np.asarray(column.offsets)
    ends = ends - ends[0]
    return [flat[lo:hi] for lo, hi in zip(ends[:-1], ends[1:])]


def _spread_out(sample: np.ndarray, n: int, angle: float) -> np.ndarray:
    """Up to ``n`` of the unit vectors, each the farthest from those before it and by ``angle`` at least.

    Two pivots in one group of near copies would be told apart by noise only.
    """
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < n and nearest.min() <= math.cos(angle):
        chosen.append(int(nearest.argmin()))
        np.maximum(nearest, sample @ sample[chosen[-1]], out=nearest)
    return sample[chosen]


class Pivots:
    """Reference points by dimension: spread over a sample, filled up with random directions."""

    def __init__(self, n: int, drawn: dict[int, np.ndarray]) -> None:
        self.n, self.drawn = n, drawn

    def of(self, dim: int) -> np.ndarray:
        found = self.drawn.get(dim, np.empty((0, dim)))
        if len(found) == self.n:
            return found
        return np.concatenate([found, _random_directions(dim, self.n - len(found))])

    def nearest(self, units: np.ndarray) -> np.ndarray:
        """The numbers of the nearest pivots of each row, nearest first."""
        pivots, step = self.of(units.shape[1]), max(1, _CELLS // self.n)
        out = np.empty((len(units), NEAREST), np.int32)
        for at in range(0, len(units), step):
            part = units[at : at + step] @ pivots.T
            some = np.argpartition(-part, NEAREST, axis=1)[:, :NEAREST]
            order = np.argsort(-np.take_along_axis(part, some, 1), axis=1, kind="stable")
            out[at : at + step] = np.take_along_axis(some, order, 1)
        return out

    def home(self, near: np.ndarray) -> np.ndarray:
        return near[:, 0].astype(np.int64) * self.n + near[:, 1]


@lru_cache(maxsize=4)
def _random_directions(dim: int, n: int) -> np.ndarray:
    drawn = np.random.default_rng([SEED, dim]).standard_normal((n, dim))
    return drawn / np.linalg.norm(drawn, axis=1)[:, None]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def fit(nodes: DataFrame, angle: float) -> Pivots:
    """Pivots for ``nodes`` (key, embedding): some eight times the square root of their number.

    They are drawn from the first vectors by hash (four for each pivot, at
    most 64 MB), 1.5 times the linking ``angle`` apart; random directions make
    up their number.  They take at most 32 MB and are at most ``MAX_PIVOTS``.
    """
    n_nodes, dim = nodes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dim = dim or 1
    wanted = 1 << max(0, math.ceil(math.log2(8 * math.sqrt(n_nodes + 1))))
    n = max(4 * NEAREST, min(MAX_PIVOTS, max(MIN_PIVOTS, wanted), _PIVOT_BYTES // (8 * dim)))
    sample = nodes.orderBy("key").limit(min(4 * n, max(1, _SAMPLE_BYTES // (8 * dim)))).select("embedding").collect()
    by_dim: dict[int, list] = {}
    for row in sample:
        by_dim.setdefault(len(row.embedding), []).append(row.embedding)
    return Pivots(n, {d: _spread_out(_unit(np.array(rows)), n, 1.5 * angle) for d, rows in by_dim.items()})


def _describe(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            vectors = _rows(batch.column("embedding"))
            size = np.array([len(v) for v in vectors], int)
            for dim in np.unique(size):
                at = np.nonzero(size == dim)[0]
                units = _unit(np.array([vectors[i] for i in at]))
                near = pivots.nearest(units)
                same = batch.take(pa.array(at))
                yield pa.record_batch(
                    {c: same.column(c) for c in ("node", "first", "copies")}
                    | {"unit": _array(units), "near": _array(near), "home": pa.array(pivots.home(near))}
                )

    return run


def _array(rows: np.ndarray) -> pa.ListArray:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.ravel()))


def _balls(units: np.ndarray, radius: np.ndarray, angle: float) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Part some balls into larger ones in which any two points are within ``angle``: members, center, radius."""
    todo = np.arange(len(units))
    while len(todo):
        near = np.arccos(np.clip(units[todo] @ units[todo[0]], -1, 1)) + radius[todo] <= angle
        center = units[todo[near]].sum(axis=0) if near.any() else units[todo[0]]
        size = np.linalg.norm(center)
        center = center / size if size > 0.5 else units[todo[0]]
        reach = np.arccos(np.clip(units[todo] @ center, -1, 1)) + radius[todo]
        inside = reach <= angle / 2 - _SLACK
        if inside[0] and inside.sum() > 1:
            yield todo[inside], center, float(reach[inside].max()) + _SLACK
            todo = todo[~inside]
        else:
            yield todo[:1], units[todo[0]], float(radius[todo[0]])
            todo = todo[1:]


def _gather(shared, angle: float):
    """Gather neighbours of a batch, which comes sorted by home, into balls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            item, home, size, n_nodes = (batch.column(c).to_numpy() for c in ("item", "home", "size", "n_nodes"))
            radius, vectors = batch.column("radius").to_numpy(), _rows(batch.column("center"))
            dim = np.array([len(v) for v in vectors], int)
            starts = np.nonzero(np.append(True, (home[1:] != home[:-1]) | (dim[1:] != dim[:-1])))[0]
            ball, own = item.copy(), [None] * len(item)
            sums, counts, reach = size.copy(), n_nodes.copy(), radius.copy()
            nears, homes = _rows(batch.column("near")), home.copy()
            for lo, hi in zip(starts, np.append(starts[1:], len(item))):
                if hi - lo == 1:
                    own[lo] = vectors[lo]
                    continue
                for members, center, r in _balls(np.array(vectors[lo:hi]), radius[lo:hi], angle):
                    at = lo + members
                    head = at[np.argmin(item[at])]
                    ball[at] = item[head]
                    own[head], reach[head], sums[head], counts[head] = center, r, size[at].sum(), n_nodes[at].sum()
                    if len(at) > 1:
                        homes[head] = pivots.home(pivots.nearest(center[None]))[0]
            yield pa.record_batch(
                {
                    "item": pa.array(item), "ball": pa.array(ball), "center": pa.array(own, pa.list_(pa.float64())), "radius": pa.array(reach),
                    "size": pa.array(sums), "n_nodes": pa.array(counts), "near": pa.array(nears, pa.list_(pa.int32())), "home": pa.array(homes),
                }
            )

    return run


def _keys(pivots: int) -> Column:
    """All sets of ``SHARED`` pivots of those that describe a vector, with its dimension."""
    each = [
        f"shiftleft(dim, 42) + shiftleft(bigint(s[{i}]), 28) + shiftleft(bigint(s[{j}]), 14) + s[{k}]"
        for i, j, k in combinations(range(NEAREST), SHARED)
    ]
    return F.expr(f"array({', '.join(each)})")


def near_duplicates(docs: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """Link the vectors of ``docs`` (vec_id, embedding) whose cosine is ``min_cosine`` or more.

    Each vector is described by its eight nearest pivots in order.  Inverted
    lists hold the vectors by every set of three of these, so that two share a
    list exactly if they share three pivots; such pairs are verified in double
    precision.  What is missed are pairs that share fewer (see README for the
    measured recall); nothing below ``min_cosine`` is linked.

    Equal vectors are one node.  Nodes close around their mean make a ball: if
    its radius is half the allowed angle, all its pairs are linked and none is
    listed.  Balls are found among vectors with the same two nearest pivots,
    a batch at a time, and again among balls.  The lists then hold balls, and
    a pair of balls is decided by the angle of their centers and their radii;
    only where these leave it open are members held against the other center,
    and only those still open against its members.

    Returns, one row per input row: vec_id, n_links (other rows linked
    directly, copies included), component_id (least vec_id in reach, null ids
    left out), kept.  Vectors that are null, empty, zero or hold a null or
    non-finite component, and vectors of different length, link with nothing.
    Repeated rows and repeated vec_ids with different vectors are rows of their own.
    """
    bounded_batches(docs.sparkSession)
    angle = math.acos(min_cosine)
    rows = docs.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    ok = usable(F.col("embedding"))
    key = F.when(ok, F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(SEED), "embedding").alias("b")))
    keyed = rows.withColumn("key", key)
    nodes = keyed.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")
    )
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    pivots = fit(nodes, angle)
    shared = docs.sparkSession.sparkContext.broadcast(pivots)
    described = stored(nodes.select("node", "first", "copies", "embedding").mapInArrow(_describe(shared), _DESCRIBED))

    def gathered(items: DataFrame) -> DataFrame:
        sorted_items = items.repartitionByRange("home", "item").sortWithinPartitions("home", "item")
        return stored(sorted_items.mapInArrow(_gather(shared, angle), _GATHERED))

    single = described.select(
        F.col("node").alias("item"), F.col("unit").alias("center"), F.lit(0.0).alias("radius"), F.col("copies").alias("size"),
        F.lit(1).cast("bigint").alias("n_nodes"), "near", "home",
    )
    first = gathered(single)
    heads = first.where("center IS NOT NULL").withColumn("item", F.col("ball"))
    second = gathered(heads.drop("ball"))
    balls = second.where("center IS NOT NULL").select("ball", "center", "radius", "size", "n_nodes")
    outer = second.select(F.col("item").alias("inner"), F.col("ball").alias("outer"))
    members = first.select(F.col("item").alias("node"), F.col("ball").alias("inner"), "near").join(outer, "inner")
    members = stored(members.select("node", F.col("outer").alias("ball"), "near").join(
        described.select("node", "first", "copies", "unit"), "node"
    ))

    placed = members.select("ball", F.sort_array("near").alias("s"), F.size("unit").cast("bigint").alias("dim"))
    lists = placed.select("ball", F.explode(_keys(pivots.n)).alias("key")).distinct()
    several = lists.groupBy("key").agg(F.min("ball").alias("lo"), F.max("ball").alias("hi")).where("lo < hi")
    lists = stored(lists.join(several.select("key"), "key"))
    pairs = lists.select("key", F.col("ball").alias("a")).join(lists.select("key", F.col("ball").alias("b")), "key")
    pairs = pairs.where("a < b").select("a", "b").distinct()
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("center", "radius", "size", "n_nodes")]
    held = pairs.join(balls.select(F.col("ball").alias("a"), *side("a")), "a").join(balls.select(F.col("ball").alias("b"), *side("b")), "b")
    held = held.withColumn("cosine", cosine("center_a", "center_b"))
    apart, reach = _angle(F.col("cosine")), F.col("radius_a") + F.col("radius_b")
    every = F.when((F.col("n_nodes_a") == 1) & (F.col("n_nodes_b") == 1), F.col("cosine") >= min_cosine).otherwise(
        F.when(apart + reach <= angle - _SLACK, True).when(apart - reach <= angle + _SLACK, F.lit(None)).otherwise(False)
    )
    held = held.select("a", "b", "size_a", "size_b", "n_nodes_a", "n_nodes_b", every.alias("every"))
    held = stored(held.where(F.coalesce("every", F.lit(True))))
    whole = held.where("every")

    # Open pairs: the members of the smaller ball against the center of the other.
    swap = F.col("n_nodes_a") > F.col("n_nodes_b")
    open_pairs = held.where("every IS NULL").select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("ball"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("other")
    )
    points = members.select("ball", "node", "copies", "unit")
    far = balls.select(F.col("ball").alias("other"), "center", "radius", F.col("size").alias("other_size"))
    tried = open_pairs.join(points, "ball").join(far, "other").withColumn("apart", _angle(cosine("unit", "center")))
    sure = F.when(F.col("apart") + F.col("radius") <= angle - _SLACK, True).when(
        F.col("apart") - F.col("radius") <= angle + _SLACK, F.lit(None)
    ).otherwise(False)
    tried = tried.select("ball", "other", "other_size", "node", "copies", sure.alias("sure"))
    tried = stored(tried.where(F.coalesce("sure", F.lit(True))))
    one = tried.where("sure IS NULL").select("ball", "other", "node").join(members.select("node", "copies", "unit"), "node")
    two = members.select(
        F.col("ball").alias("other"), F.col("node").alias("node_b"), F.col("copies").alias("copies_b"), F.col("unit").alias("unit_b")
    )
    exact = one.join(two, "other").where(cosine("unit", "unit_b") >= min_cosine)
    exact = stored(exact.select("ball", "other", "node", "copies", "node_b", "copies_b"))

    met = tried.where("sure")
    by_ball = whole.select(F.col("a").alias("ball"), F.col("size_b").alias("n")).unionAll(whole.select("b", "size_a")).unionAll(
        met.select("other", "copies")
    )
    by_node = met.select("node", F.col("other_size").alias("n")).unionAll(exact.select("node", "copies_b")).unionAll(exact.select("node_b", "copies"))
    by_ball = by_ball.groupBy("ball").agg(F.sum("n").alias("by_ball"))
    by_node = by_node.groupBy("node").agg(F.sum("n").alias("by_node"))
    links = whole.select("a", "b").unionAll(met.select("ball", "other")).unionAll(exact.select("ball", "other")).distinct()
    groups = components(links).withColumnRenamed("node", "ball")

    named = members.select("node", "ball", "first").join(groups, "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    named = stored(named)
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    size = balls.select("ball", "size")
    counted = named.join(firsts, "component").join(size, "ball").join(by_ball, "ball", "left").join(by_node, "node", "left")
    n_links = F.col("size") - 1 + F.coalesce("by_ball", F.lit(0)) + F.coalesce("by_node", F.lit(0))
    results = stored(counted.select("node", n_links.alias("n_links"), "component_id").join(nodes.select("node", "key"), "node").drop("node"))
    out = lookup(keyed.select("vec_id", "key"), results, "key", ["vec_id"])
    component_id = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component_id.alias("component_id"),
        F.col("vec_id").eqNullSafe(component_id).alias("kept"),
    )
