"""Near-duplicate embeddings by dual traversal of cover trees.

Vectors are compared as unit vectors, whose distance is ``sqrt(2 - 2 * cosine)``; a cosine of 0.9 is the
distance ``REACH``. Equal vectors collapse into classes with a count. Classes are put in an order that
keeps near ones together (nearest of ``PIVOTS`` sampled vectors, then the signs of a few projections),
numbered, and cut into blocks of ``BLOCK`` classes. Every block gets a cover tree: nested levels with
halving radii, in which each node covers its descendants; the true covering radius of each node is kept.

The trees are traversed in pairs, level by level. They are written once, to the shared folder, and every
task reads two parts of them from there, of at most ``BALLS`` trees each: pairs of blocks whose roots, with
their covering radii, are too far from each other never leave it, and no tree is shipped to other tasks.
A pair of nodes at distance d with covering radii r and s

* is dropped if d > r + s + REACH: no descendants are linked;
* counts as a whole if d + r + s <= REACH: all descendants are linked with each other;
* else its children meet; pairs of single vectors are compared by their cosine in double precision.

So all pairs at or over the threshold are found and none below it. Each pair of blocks returns, per
class, the number of linked vectors and one other class that it is connected with, so the output grows
with the classes, not with the links. The components of those connections are those of all links.

Cost: what the bounds can prune depends on the data. Among vectors without structure in many dimensions
(random ones) radii under half of the usual distance hold single vectors, so all pairs of these meet
once, as products of matrices: the work is quadratic there, in blocks. What is written isn't: it grows with
the classes and the links between blocks, and a task holds one part of the trees and two of them unpacked.

Skew: copies are counted before anything is joined and hot classes are broadcast to their rows (there
can be at most ``HOT_SHARE`` of them); a group of near copies of any size is cut into blocks, and pairs
of blocks within ``REACH`` of each other as a whole are counted without being opened.

Nulls and edge cases: a vector that is null, empty, zero or holds a null or non-finite component, and a
row without ``vec_id``, is linked with nothing; such a row is its own component (null without
``vec_id``, and not kept). Vectors of different lengths are never linked. Repeated rows are linked with
each other and counted one by one; rows that share a ``vec_id`` share their component's name. Ties
at the threshold are links. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.llm.common import cut, cut_in_batches, numbered, read
from vitaeflow.llm.near_duplicates import components

COSINE = 0.9
REACH = float(np.sqrt(2 - 2 * COSINE))
#: Vectors that are sampled to put near ones into an order; the result doesn't depend on them.
PIVOTS = 256
SIGNS = 24
#: Classes of a block, trees of a part at most, and nodes of a side whose distances are computed at once.
BLOCK = 2048
BALLS = 64
ROWS = 512
#: Bytes of a part at most, and parts that there are if there are as many blocks.
PART = 1 << 25
PARTS = 16
#: Radii of the levels; below the last one come the vectors themselves.
RADII = tuple(2.0 / 2**k for k in range(7))
#: What rounding may take from a bound.
MARGIN = 1e-9
HOT_SHARE = 1000
#: Rows of a batch when rows hold two whole trees.
TREES = 16


# --- cover trees ---------------------------------------------------------------------------------
class Level(NamedTuple):
    """Nodes of a level: their vectors, covering radii, numbers of classes and of rows below them, and
    where the children of each begin and stand in the next level."""

    points: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    first: np.ndarray
    children: np.ndarray


class Tree(NamedTuple):
    units: np.ndarray
    levels: list[Level]
    nodes: list[np.ndarray]  # of each vector, its node in every level


def units_of(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def refined(units: np.ndarray, nodes: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """``nodes`` and further vectors, none within ``radius`` of another, which cover all; and the place of
    the node that covers each vector."""
    least = 1 - radius * radius / 2
    cover = np.full(len(units), -1)
    cover[nodes] = np.arange(len(nodes))
    left = np.flatnonzero(cover < 0)

    def covered(some: np.ndarray, by: np.ndarray, before: int) -> None:
        for k in range(0, len(some), ROWS):
            near = units[some[k : k + ROWS]] @ units[by].T
            best = near.argmax(axis=1)
            hit = near[np.arange(len(best)), best] >= least
            cover[some[k : k + ROWS][hit]] = best[hit] + before

    covered(left, nodes, 0)
    left, found, total = left[cover[left] < 0], [nodes], len(nodes)
    while len(left):
        head, rest = left[:128], left[128:]
        near = units[head] @ units[head].T >= least
        np.fill_diagonal(near, True)
        taken, fresh = np.zeros(len(head), dtype=bool), []
        for k in range(len(head)):
            if not taken[k]:
                cover[head[near[k] & ~taken]] = total + len(fresh)
                taken |= near[k]
                fresh.append(head[k])
        covered(rest, np.array(fresh), total)
        found.append(np.array(fresh))
        total += len(fresh)
        left = rest[cover[rest] < 0]
    return np.concatenate(found), cover


def grown(raw: np.ndarray, counts: np.ndarray) -> Tree:
    """The cover tree of a block of vectors, the most central of them at its root."""
    units, every = units_of(raw), np.arange(len(raw))
    nodes = np.array([int((units @ units.mean(axis=0)).argmax())])
    chosen, covers = [nodes], [np.zeros(len(raw), dtype=np.int64)]
    for radius in RADII[1:]:
        if len(nodes) == len(units):
            break
        nodes, cover = refined(units, nodes, radius)
        chosen.append(nodes)
        covers.append(cover)
    chosen.append(every)
    at, own = [every], every
    for k in range(len(covers) - 1, -1, -1):  # a node's descendants follow from the levels below it
        own = covers[k][chosen[k + 1]][own]
        at.append(own)
    at.reverse()
    levels = []
    for k, (points, own) in enumerate(zip(chosen, at, strict=True)):
        radii = np.zeros(len(points))
        np.maximum.at(radii, own, np.linalg.norm(units - units[points[own]], axis=1))
        if k + 1 < len(chosen):
            above = covers[k][chosen[k + 1]]
            children = np.argsort(above, kind="stable")
            first = np.searchsorted(above[children], np.arange(len(points) + 1))
        else:
            children, first = every, np.arange(len(points) + 1)
        levels.append(Level(points, radii, np.bincount(own, minlength=len(points)), np.bincount(own, weights=counts, minlength=len(points)).astype(np.int64), first, children))
    return Tree(units, levels, at)


class Sets:
    """Which of ``n`` things are connected, each labelled with the first of those it is connected with."""

    def __init__(self, n: int):
        self.labels = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.labels[a], self.labels[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.labels, np.maximum(x, y), np.minimum(x, y))
            while True:
                further = self.labels[self.labels]
                if (further == self.labels).all():
                    break
                self.labels = further


def _below(tree: Tree, depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes, and for each the place of its parent among ``nodes``."""
    if depth + 1 == len(tree.levels):
        return nodes, np.arange(len(nodes))
    level = tree.levels[depth]
    n = level.first[nodes + 1] - level.first[nodes]
    parent = np.repeat(np.arange(len(nodes)), n)
    start = level.first[nodes] - (np.cumsum(n) - n)
    return level.children[start[parent] + np.arange(len(parent))], parent


def descended(a: Tree, b: Tree, la: int, lb: int, rows: np.ndarray, cols: np.ndarray, i: np.ndarray, j: np.ndarray, depth: int) -> Iterator[tuple]:
    """The children of open pairs (i, j) of nodes, as rows, columns and which of their pairs are to meet."""
    some_rows, some_cols = np.unique(i), np.unique(j)
    met = np.zeros((len(some_rows), len(some_cols)), dtype=bool)
    met[np.searchsorted(some_rows, i), np.searchsorted(some_cols, j)] = True
    (more_rows, of_row), (more_cols, of_col) = _below(a, la, rows[some_rows]), _below(b, lb, cols[some_cols])
    for k in range(0, len(more_rows), ROWS):
        part = met[of_row[k : k + ROWS]]
        used = np.flatnonzero(part.any(axis=0)[of_col])
        yield depth, more_rows[k : k + ROWS], more_cols[used], part[:, of_col[used]]


def verdicts(cosines: np.ndarray, r: np.ndarray, s: np.ndarray, single: np.ndarray, reach: float = REACH, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of nodes by their cosines, covering radii and whether both are single vectors: which are
    linked as a whole, and which are open."""
    far, near = r + s + reach, reach - r - s
    whole = np.where(single, cosines >= cosine, (near > 0) & (cosines >= 1 - near * near / 2 + MARGIN))
    return whole, ~single & ~whole & (cosines >= 1 - far * far / 2 - MARGIN)


def traversed(a: Tree, b: Tree, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked rows for each vector of ``a`` and of ``b`` (of ``a`` alone, itself included, if both are the
    same tree), and their labels: those of ``b`` are counted on from ``a``'s."""
    same, reach = a is b, float(np.sqrt(2 - 2 * cosine))
    offset = 0 if same else len(a.units)
    sets = Sets(len(a.units) + (0 if same else len(b.units)))
    sums = [[np.zeros(len(x.points), dtype=np.int64) for x in tree.levels] for tree in (a, b)]
    stack = [(0, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.ones((1, 1), dtype=bool))]
    while stack:
        depth, rows, cols, asked = stack.pop()
        la, lb = min(depth, len(a.levels) - 1), min(depth, len(b.levels) - 1)
        x, y = a.levels[la], b.levels[lb]
        cosines = a.units[x.points[rows]] @ b.units[y.points[cols]].T
        r, s = x.radii[rows], y.radii[cols]
        # Most nodes are single vectors, for which one bound holds; the rows and columns of others have their own.
        met = cosines >= 1 - reach * reach / 2 - MARGIN
        broad, wide = np.flatnonzero(r), np.flatnonzero(s)
        met[broad] = cosines[broad] >= 1 - (r[broad, None] + s[None, :] + reach) ** 2 / 2 - MARGIN
        met[:, wide] = cosines[:, wide] >= 1 - (r[:, None] + s[None, wide] + reach) ** 2 / 2 - MARGIN
        i, j = np.divmod(np.flatnonzero(met & asked), len(cols))
        if not len(i):
            continue
        single = (x.sizes[rows[i]] == 1) & (y.sizes[cols[j]] == 1)
        whole, further = verdicts(cosines[i, j], r[i], s[j], single, reach, cosine)
        if whole.any():
            p, q = rows[i[whole]], cols[j[whole]]
            sums[0][la] += np.bincount(p, weights=y.weights[q], minlength=len(x.points)).astype(np.int64)
            sums[1][lb] += np.bincount(q, weights=x.weights[p], minlength=len(y.points)).astype(np.int64)
            sets.join(x.points[p], y.points[q] + offset)
        i, j = i[further], j[further]
        for own in (r[i] > 0, r[i] == 0):  # broad nodes meet many, others only broad ones
            if own.any():
                stack += descended(a, b, la, lb, rows, cols, i[own], j[own], depth + 1)
    totals = []
    for tree, own, shift in ((a, sums[0], 0), (b, sums[1], offset))[: 1 if same else 2]:
        total = np.zeros(len(tree.units), dtype=np.int64)
        for level, added, at in zip(tree.levels, own, tree.nodes, strict=True):
            total += added[at]
            met = np.flatnonzero((added > 0)[at])  # all below a node that is linked as a whole are connected
            sets.join(met + shift, level.points[at[met]] + shift)
        totals.append(total)
    return totals[0], totals[0] if same else totals[1], sets.labels


# --- rows and blocks -----------------------------------------------------------------------------
def _reading(kind: str):
    """Rows as (vec_id, key, dim, raw): the bytes of a vector and their digest; null if it is linked with
    nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, raws = ([None] * batch.num_rows for _ in range(3))
            for k, (row, known) in enumerate(zip(batch.column("embedding"), batch.column("vec_id").is_valid().to_pylist(), strict=True)):
                if known and row.is_valid and len(row) and not row.values.null_count:
                    own = row.values.to_numpy(zero_copy_only=False).astype(kind)
                    if np.isfinite(own).all() and own.any():
                        raws[k], dims[k] = own.tobytes(), len(own)
                        keys[k] = xxhash.xxh3_128_digest(raws[k])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["vec_id", "key", "dim", "raw"])

    return run


def _placing(kind: str, pivots: dict[int, np.ndarray]):
    """Classes with the cell and the signs by which they are put in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells, signs = np.zeros((2, batch.num_rows), dtype=np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                raw = np.frombuffer(b"".join(batch.column("raw").take(pa.array(at)).to_pylist()), dtype=kind).reshape(-1, dim)
                units = units_of(raw)
                if dim in pivots:
                    cells[at] = (units @ pivots[dim].T).argmax(axis=1)
                if dim not in planes:
                    planes[dim] = np.random.default_rng(dim).normal(size=(dim, SIGNS))
                signs[at] = (units @ planes[dim] > 0) @ (1 << np.arange(SIGNS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(signs)], names=[*batch.schema.names, "cell", "signs"])

    return run


_TREE = "dim int, block long, root long, center array<double>, radius double, weight long, tree binary"


def _growing(kind: str):
    """A row for each block, whose classes are next to each other."""

    def grow(dim: int, block: int, places: list, counts: list, raws: list) -> tuple:
        tree = grown(np.frombuffer(b"".join(raws), dtype=kind).reshape(-1, dim), np.array(counts))
        top = tree.levels[0]
        root = int(top.points[0])
        return dim, block, places[root], tree.units[root].tolist(), float(top.radii[0]), int(top.weights[0]), pickle.dumps((np.array(places), raws, tree._replace(units=None)))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.binary()]
        names = ["dim", "block", "root", "center", "radius", "weight", "tree"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ([], [], [])
        for batch in batches:
            for dim, block, *row in zip(*(batch.column(c).to_pylist() for c in ("dim", "block", "place", "n", "raw")), strict=True):
                if (dim, block) != last:
                    if last:
                        yield out([grow(*last, *held)])
                    last, held = (dim, block), ([], [], [])
                for column, value in zip(held, row, strict=True):
                    column.append(value)
        if last:
            yield out([grow(*last, *held)])

    return run


def _loaded(kind: str, dim: int, packed: bytes) -> tuple[np.ndarray, Tree]:
    places, raws, tree = pickle.loads(packed)
    return places, tree._replace(units=units_of(np.frombuffer(b"".join(raws), dtype=kind).reshape(-1, dim)))


_SIDE = ("block", "root", "center", "radius", "weight", "tree")
_LINKS = "dim int, block long, place long, links long, mate long"


def _linking(kind: str):
    """Links between the two blocks of a pair: (place, links, mate) of the classes with links or, of blocks that
    are linked as a whole, (block, links, mate) with the rows linked with each class and the other root."""

    def out(dim: int, blocks: list, places: np.ndarray, links: np.ndarray, mates: np.ndarray) -> pa.RecordBatch:
        empty = pa.nulls(len(links), pa.int64())
        columns = [pa.array(np.full(len(links), dim, dtype=np.int32)), pa.array(blocks, pa.int64()) if blocks else empty, empty if blocks else pa.array(places), pa.array(links, pa.int64()), pa.array(mates, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["dim", "block", "place", "links", "mate"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for dim, *row in zip(*(batch.column(c).to_pylist() for c in ("dim", *(f"{s}_{c}" for s in ("low", "high") for c in _SIDE))), strict=True):
                (low, root, center, r, weight, tree), (high, other, around, s, further, more) = row[: len(_SIDE)], row[len(_SIDE) :]
                if verdicts(np.dot(center, around), np.float64(r), np.float64(s), np.array(False))[0]:
                    yield out(dim, [low, high], None, [further, weight], [other, root]) if low != high else out(dim, [low], None, [weight], [root])
                    continue
                if last != (dim, low):
                    last, held = (dim, low), _loaded(kind, dim, tree)
                places, a = held
                if low == high:
                    links, _, labels = traversed(a, a)
                else:
                    beyond, b = _loaded(kind, dim, more)
                    *links, labels = traversed(a, b)
                    places, links = np.concatenate([places, beyond]), np.concatenate(links)
                at = np.flatnonzero(links)
                if len(at):
                    yield out(dim, [], places[at], links[at], places[labels[at]])

    return run


def _paired(trees: DataFrame) -> DataFrame:
    """Every pair of trees, each with itself too, whose vectors can be linked by the distance of their roots.
    Parts of the trees are read where they are kept; nothing is shuffled or broadcast."""
    known = trees.agg(F.count("*").alias("n"), F.sum(F.length("tree")).alias("bytes")).first()
    parts = max(min(known["n"], PARTS), -(-known["n"] // BALLS), -(-known["bytes"] // PART))
    few = trees.coalesce(parts)
    low, high = (few.select(F.col("dim").alias(f"{side}_dim"), *(F.col(c).alias(f"{side}_{c}") for c in _SIDE)) for side in ("low", "high"))
    cosine = F.aggregate(F.zip_with("low_center", "high_center", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    far = F.col("low_radius") + F.col("high_radius") + REACH
    # Twice the margin, as sums may be rounded in another way than where the pair is opened.
    met = (F.col("low_dim") == F.col("high_dim")) & (F.col("low_block") <= F.col("high_block")) & (cosine >= 1 - far * far / 2 - 2 * MARGIN)
    return low.hint("shuffle_replicate_nl").join(high, met).withColumnRenamed("low_dim", "dim").drop("high_dim")


def linked_classes(classes: DataFrame, kind: str) -> DataFrame:
    """(key, n_links, component_id) of the classes (key, first, n, dim, raw)."""
    sample = classes.select("key", "dim", "raw").orderBy("key").limit(PIVOTS).collect()
    by_dim: dict[int, list] = {}
    for row in sample:
        by_dim.setdefault(row["dim"], []).append(row["raw"])
    pivots = {dim: _in_order(units_of(np.frombuffer(b"".join(raws), dtype=kind).reshape(-1, dim))) for dim, raws in by_dim.items()}
    near = classes.mapInArrow(_placing(kind, pivots), "key binary, first long, n long, dim int, raw binary, cell long, signs long")
    placed = numbered(near, ["dim", "cell", "signs", "key"], "place").drop("cell", "signs").withColumn("block", F.floor(F.col("place") / BLOCK))
    rows = placed.select("dim", "block", "place", "n", "raw").repartition("dim", "block").sortWithinPartitions("dim", "block", "place")
    trees = cut(rows.mapInArrow(_growing(kind), _TREE))
    met = cut_in_batches(_paired(trees).mapInArrow(_linking(kind), _LINKS), TREES)
    within = met.filter("place IS NOT NULL").select("place", "links", "mate")
    # All classes of a block that is linked as a whole are connected with its root, and the root further on.
    whole = met.filter("block IS NOT NULL").select("dim", "block", "links", "mate")
    roots = trees.select("dim", "block", "root")
    sums = whole.groupBy("dim", "block").agg(F.sum("links").alias("links")).join(roots, ["dim", "block"])
    shared = placed.select("dim", "block", "place").join(sums, ["dim", "block"]).select("place", "links", F.col("root").alias("mate"))
    linked = cut(within.unionByName(shared))
    edges = linked.select(F.col("place").alias("a"), F.col("mate").alias("b")).unionByName(whole.join(roots, ["dim", "block"]).select(F.col("root").alias("a"), F.col("mate").alias("b")))
    labels = components(edges.filter("a <> b").distinct())
    known = placed.select("key", "first", "place").join(linked.groupBy("place").agg(F.sum("links").alias("links")), "place", "left")
    named = cut(known.join(labels, F.col("place") == F.col("rep"), "left").select("key", "first", "links", F.coalesce("component", "place").alias("component")))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return named.join(smallest, "component").select("key", (F.col("links") - 1).alias("n_links"), "component_id")


def _in_order(units: np.ndarray) -> np.ndarray:
    """Sampled vectors in the order of their own cover tree, so that near ones are neighbours."""
    tree = grown(units, np.ones(len(units)))
    return units[np.lexsort(tree.nodes[::-1])]


def near_embeddings(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    kind, wide = ("<f4", "float") if element == "float" else ("<f8", "double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{wide}>").alias("embedding"))
    given = cut(rows.mapInArrow(_reading(kind), "vec_id long, key binary, dim int, raw binary"))
    classes = cut(
        given.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("raw").alias("raw"))
    )
    total = classes.agg(F.sum("n")).first()[0] or 0
    found = cut(linked_classes(classes, kind)) if total else classes.select("key", F.lit(0).cast("long").alias("n_links"), F.col("first").alias("component_id"))
    hot_keys = classes.filter(F.col("n") * HOT_SHARE > total).select("key")
    hot, cold = found.join(hot_keys, "key", "left_semi"), found.join(hot_keys, "key", "left_anti")
    light = given.select("vec_id", "key")
    some, none = light.filter("key IS NOT NULL"), light.filter("key IS NULL")
    met = some.join(F.broadcast(hot), "key").unionByName(some.join(F.broadcast(hot_keys), "key", "left_anti").join(cold, "key"))
    alone = none.select("vec_id", "key", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op11_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_embeddings(read(spark, sf_dir, "embeddings"))


ORACLE_SQL = {
    "op11_embedding_links": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
    coalesce(vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND list_sum(list_transform(embedding, lambda x: abs(x)::DOUBLE)) > 0, false) AS given
  FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE a.given AND b.given AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT x, b FROM reach JOIN links ON a = y),
low AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, low.c AS component_id, low.c = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN low ON low.x = v.vec_id
"""
}
QUERIES: dict[str, Callable] = {"op11_embedding_links": op11_embedding_links}
