"""Embedding near-duplicates: all pairs of a cosine or more, by dual traversal of cover trees.

On unit vectors a cosine bound is a distance bound.  Equal vectors are one class (by a partial
aggregation) and weigh as many rows.  Classes are dealt to cells, each to its nearest centre, and
visit every later cell that they could reach into, by its covering radius and by the plane between the two
centres; so a linked pair meets in exactly one cell, and what is too far away is never sent.  Cells of any size are cut to blocks of
about ``BLOCK`` rows, and one task takes two blocks.

In a task each block is a cover tree: nested levels whose radii halve.  Two trees are walked
together: a pair of nodes is dropped if their centres are farther apart than the bound and both
covering radii, and taken whole, without looking at its pairs, if even the farthest points are
within the bound.  What is left at the leaves is measured.  A task gives each of its classes the
weight linked and a root, never pairs; roots are edges for the connected components.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no
links and are their own component; so do rows with a null id, whose component is null and which
are kept; vectors of different lengths aren't linked; rows that share an id are one node of the
graph, and each keeps its own count; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import cut
from .vectors import matrix, usable

BLOCK, LEAF = 4096, 8
#: Rows of a distance matrix that are made at once.
ROWS_AT_ONCE = 512
#: Most centres: what the driver and each task hold of them is bounded by it.
CENTRES = 1024
#: Edges that wait to be folded into a task's roots.
EDGES_HELD = 1 << 18
#: Room for rounding: nearer bounds than this are measured, not decided by radii.
SLACK = 1e-6


class Node:
    """Points within ``radius`` of a centre; the children's radii are at most half of it.

    centres and radii are those of the children, as arrays.
    """

    __slots__ = ("centre", "radius", "points", "children", "centres", "radii")

    def __init__(self, centre: int, radius: float, points: np.ndarray) -> None:
        self.centre, self.radius, self.points, self.children = centre, radius, points, []


def _cosine_of(distance: float | np.ndarray) -> float | np.ndarray:
    """Cosine of unit vectors at a distance, at least -1."""
    return np.maximum(1 - np.square(distance) / 2, -1.0)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * x @ y.T, 0))


def _net(x: np.ndarray, radius: float) -> np.ndarray:
    """For each row the first row, in order, that is a centre of a net and no farther than ``radius``."""
    least = _cosine_of(radius)
    of = np.full(len(x), -1)
    for at in range(0, len(x), ROWS_AT_ONCE):
        rows, near = np.nonzero(x[at : at + ROWS_AT_ONCE] @ x.T >= least)
        bounds = np.searchsorted(rows, np.arange(len(x[at : at + ROWS_AT_ONCE]) + 1))
        alone = np.diff(bounds) <= 1
        for i in range(len(alone)):
            if of[at + i] >= 0:
                continue
            of[at + i] = at + i
            if not alone[i]:
                others = near[bounds[i] : bounds[i + 1]]
                of[others[of[others] < 0]] = at + i
    return of


def cover_tree(x: np.ndarray) -> Node:
    """Cover tree of the unit vectors in the rows of ``x``."""
    every = np.arange(len(x))
    root = Node(0, float(_apart(x, x[:1]).max()), every)
    open_ = [root]
    while open_:
        node = open_.pop()
        if len(node.points) <= LEAF or node.radius <= SLACK:
            continue
        # The node's own centre leads, so that it is the centre of its first child.
        points = np.r_[node.centre, node.points[node.points != node.centre]]
        of = _net(x[points], node.radius / 2)
        order = np.argsort(of, kind="stable")
        firsts, bounds = np.unique(of[order], return_index=True)
        for first, own in zip(firsts.tolist(), np.split(points[order], bounds[1:]), strict=True):
            centre = int(points[first])
            radius = float(_apart(x[own], x[centre : centre + 1]).max()) if len(own) > 1 else 0.0
            child = Node(centre, radius, own)
            node.children.append(child)
            if len(own) > 1:
                open_.append(child)
        _arrays(node)
    return root


def _arrays(node: Node) -> None:
    node.centres = np.array([c.centre for c in node.children])
    node.radii = np.array([c.radius for c in node.children])


class Links:
    """Linked weight of each point and edges that connect what is linked."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, cosine: float) -> None:
        self.x, self.weight, self.cosine = x, weight, cosine
        self.bound = float(np.sqrt(2 - 2 * cosine))
        self.linked = np.zeros(len(x), dtype=np.int64)
        self.root = np.arange(len(x))
        self.edges: list[np.ndarray] = []
        self.held = 0

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.linked, a, self.weight[b])
        np.add.at(self.linked, b, self.weight[a])
        self._connect(a, b)

    def _connect(self, a: np.ndarray, b: np.ndarray) -> None:
        """Edges wait in a buffer of bounded size until they are folded into the roots."""
        self.edges.append(np.stack([a, b]))
        self.held += len(a)
        if self.held > EDGES_HELD:
            self.roots()

    def all_of(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every point of a with every point of b."""
        self.linked[a] += self.weight[b].sum()
        self.linked[b] += self.weight[a].sum()
        self._connect(np.r_[a, b[1:]], np.full(len(a) + len(b) - 1, b[0]))

    def measured(self, a: np.ndarray, b: np.ndarray) -> None:
        i, j = np.nonzero(self.x[a] @ self.x[b].T >= self.cosine)
        if len(i):
            self._pairs(a[i], b[j])

    def within(self, node: Node) -> None:
        """All pairs inside one tree."""
        open_ = [node]
        while open_:
            n = open_.pop()
            if len(n.points) == 1:
                continue
            if 2 * n.radius <= self.bound - SLACK:
                own = self.weight[n.points]
                self.linked[n.points] += own.sum() - own
                self._connect(n.points[1:], np.full(len(n.points) - 1, n.points[0]))
            elif not n.children:
                i, j = np.nonzero(np.triu(self.x[n.points] @ self.x[n.points].T >= self.cosine, 1))
                if len(i):
                    self._pairs(n.points[i], n.points[j])
            else:
                open_ += [c for c in n.children if len(c.points) > 1]
                self._between(n, n, True)

    def between(self, a: Node, b: Node) -> None:
        """All pairs of a point of one tree and a point of the other."""
        self._meet([(a, b)])

    def _meet(self, open_: list[tuple[Node, Node]]) -> None:
        while open_:
            a, b = open_.pop()
            d = float(_apart(self.x[a.centre : a.centre + 1], self.x[b.centre : b.centre + 1])[0, 0])
            reach = a.radius + b.radius
            if d > self.bound + reach + SLACK:
                continue
            if d + reach <= self.bound - SLACK:
                self.all_of(a.points, b.points)
            elif not a.children and not b.children:
                self.measured(a.points, b.points)
            elif a.children and b.children:
                self._between(a, b, False)
            elif a.children:
                open_ += [(c, b) for c in a.children]
            else:
                open_ += [(a, c) for c in b.children]

    def _between(self, a: Node, b: Node, same: bool) -> None:
        """The children of a with those of b (same: each two children of one node once)."""
        open_ = []
        x, y = self.x[a.centres], self.x[b.centres]
        most = float(b.radii.max())
        for at in range(0, len(x), ROWS_AT_ONCE):
            cosine = x[at : at + ROWS_AT_ONCE] @ y.T
            # One bound for a row first, by the widest of the other side; then each pair's own.
            loose = _cosine_of(self.bound + a.radii[at : at + ROWS_AT_ONCE] + most + SLACK)
            i, j = np.nonzero(cosine >= loose[:, None])
            if same:
                i, j = i[j > i + at], j[j > i + at]
            reach = a.radii[i + at] + b.radii[j]
            near = cosine[i, j] >= _cosine_of(self.bound + reach + SLACK)
            i, j, reach = i[near] + at, j[near], reach[near]
            single = reach == 0
            p, q = a.centres[i[single]], b.centres[j[single]]
            linked = np.einsum("ij,ij->i", self.x[p], self.x[q]) >= self.cosine
            if linked.any():
                self._pairs(p[linked], q[linked])
            open_ += [(a.children[k], b.children[m]) for k, m in zip(i[~single].tolist(), j[~single].tolist(), strict=True)]
        self._meet(open_)

    def roots(self) -> np.ndarray:
        """The smallest point reachable from each, by the edges so far."""
        root, self.held = self.root, 0
        if not self.edges:
            return root
        a, b = np.concatenate(self.edges, axis=1)
        self.edges = []
        while True:
            low = np.minimum(root[a], root[b])
            after = root.copy()
            for ends in (a, b, root[a], root[b]):
                np.minimum.at(after, ends, low)
            after = after[after]
            if (after == root).all():
                self.root = root
                return root
            root = after


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _walked(cosine: float):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def walked(table: pa.Table) -> pa.Table:
        x = unit(matrix(table.column("vector")))
        node, weight, side = (table.column(c).to_numpy() for c in ("node", "weight", "side"))
        links = Links(x, weight, cosine)
        parts = [np.flatnonzero(side == s) for s in (0, 1)]
        trees = [_moved(cover_tree(x[p]), p) for p in parts if len(p)]
        if table.column("alone")[0].as_py():
            links.within(trees[0])
        elif len(trees) == 2:
            links.between(*trees)
        root = links.roots()
        some = np.flatnonzero(links.linked)
        return pa.table([node[some], links.linked[some], node[root[some]]], schema=schema)

    return walked


def _moved(tree: Node, to: np.ndarray) -> Node:
    """The tree with its points named by their rows in the task's table."""
    open_ = [tree]
    while open_:
        n = open_.pop()
        n.centre, n.points = int(to[n.centre]), to[n.points]
        if n.children:
            n.centres = to[n.centres]
            open_ += n.children
    return tree


def _homes(centres):
    """(node, weight, vector, dim, home, apart): the nearest centre of each class."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            home, apart = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                known = centres.value.get(int(dim))
                if known is not None:
                    d = _apart(unit(matrix(batch.column("vector").take(pa.array(rows)))), known)
                    home[rows], apart[rows] = d.argmin(axis=1), d.min(axis=1)
                else:
                    apart[rows] = 2.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(apart)], ["node", "weight", "vector", "dim", "home", "apart"])

    return homes


def _reached(x: np.ndarray, centres: np.ndarray, radii: np.ndarray, home: np.ndarray, cosine: float) -> np.ndarray:
    """Whether the cell of each centre, later than home, may hold a vector of that cosine to each row of ``x``.

    Two bounds: the cell's covering radius; and the plane between the two centres, beyond which all of
    the cell lies: what is farther from the plane than the cosine allows has no partner there.
    """
    near = x @ centres.T
    apart = np.sqrt(np.maximum(2 - 2 * near, 0))
    later = np.arange(len(centres))[None, :] > home[:, None]
    by_radius = apart <= radii[None, :] + np.sqrt(2 - 2 * cosine) + SLACK
    between = np.maximum(_apart(centres[home], centres), SLACK)
    beyond = (near[np.arange(len(x)), home][:, None] - near) / between
    return later & by_radius & (beyond <= np.sqrt(max(1 - cosine * cosine, 0)) + SLACK) if cosine > 0 else later & by_radius


def _visits(centres, radii, cosine: float):
    """(node, weight, vector, dim, cell, visitor): the home cell, and each later cell within reach."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                dims, home = batch.column("dim").to_numpy(), batch.column("home").to_numpy()
                rows, cells = [np.arange(len(dims))], [home]
                for dim in np.unique(dims):
                    own = np.flatnonzero(dims == dim)
                    known = centres.value.get(int(dim))
                    if known is None:
                        continue
                    x = unit(matrix(batch.column("vector").take(pa.array(own))))
                    i, cell = np.nonzero(_reached(x, known, radii.value[int(dim)], home[own], cosine))
                    rows.append(own[i])
                    cells.append(cell.astype(np.int32))
                row, cell = pa.array(np.concatenate(rows)), pa.array(np.concatenate(cells), pa.int32())
                visitor = pa.array(np.arange(len(row)) >= len(dims))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(row) for c in ("node", "weight", "vector", "dim")] + [cell, visitor], ["node", "weight", "vector", "dim", "cell", "visitor"])

    return visits


def link(table: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links (other rows linked directly), component_id and kept."""
    spark = table.sparkSession
    v = F.col(vector).cast("array<double>")
    # 128 bits name a vector: rows of equal vectors are one class.
    ok = usable(v) & F.col(vec_id).isNotNull()
    rows = table.select(
        F.col(vec_id).cast("long").alias("id"),
        F.when(ok, F.struct(F.xxhash64(v).alias("x"), F.xxhash64(F.reverse(v), F.size(v)).alias("y"))).alias("class"),
        F.when(ok, v).alias("vector"),
    )
    rows = cut(rows, "cover-rows")
    classes = rows.filter("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("node"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    classes = cut(classes.withColumn("dim", F.size("vector")), "cover-classes")
    counts = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").limit(8).collect()}
    # At most CENTRES rows come to the driver; lengths beyond the 8 most frequent have one cell each.
    nth = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("class")))
    n = sum(counts.values())
    # A length's share of the centres goes by its rows, one for each block of them as long as they last.
    wanted = {d: max(1, min(-(-c // block), CENTRES * c // n)) for d, c in counts.items()}
    most = F.create_map(*(F.lit(v) for pair in wanted.items() for v in pair)) if wanted else F.lit(None)
    chosen = classes.filter(F.col("dim").isin(list(counts))).withColumn("nth", nth).filter(F.col("nth") <= max(wanted.values(), default=0))
    chosen = (chosen.filter(F.col("nth") <= most[F.col("dim")]) if wanted else chosen).orderBy("dim", "nth").select("dim", "vector").toArrow()
    of_dim: dict[int, list] = {}
    for dim, x in zip(chosen.column("dim").to_pylist(), chosen.column("vector").to_pylist(), strict=True):
        of_dim.setdefault(dim, []).append(x)
    centres = spark.sparkContext.broadcast({d: unit(np.array(x)) for d, x in of_dim.items()})
    homes = classes.select("node", "weight", "vector", "dim").mapInArrow(_homes(centres), "node long, weight long, vector array<double>, dim int, home int, apart double")
    homes = cut(homes, "cover-homes")
    reach = {d: np.full(len(x), -np.inf) for d, x in of_dim.items()}
    for r in homes.filter(F.col("dim").isin(list(of_dim))).groupBy("dim", "home").agg(F.max("apart").alias("r")).collect():
        reach[r["dim"]][r["home"]] = r["r"]
    radii = spark.sparkContext.broadcast(reach)
    placed = homes.mapInArrow(_visits(centres, radii, cosine), "node long, weight long, vector array<double>, dim int, cell int, visitor boolean")
    placed = cut(placed, "cover-cells")
    sizes = placed.groupBy("dim", "cell").agg(F.count_if(~F.col("visitor")).alias("n_home"), F.count_if("visitor").alias("n_visit"))
    sizes = sizes.select("dim", "cell", F.ceil(F.col("n_home") / block).cast("int").alias("homes"), F.ceil(F.col("n_visit") / block).cast("int").alias("visits"))
    at = F.pmod(F.xxhash64("node", "dim"), F.when(F.col("visitor"), F.col("visits")).otherwise(F.col("homes"))).cast("int")
    dealt = placed.join(sizes, ["dim", "cell"]).withColumn("at", at)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    at_home = F.transform(upto(F.col("homes")), lambda o: F.struct(F.lit(0).alias("kind"), F.least("at", o).alias("i"), F.greatest("at", o).alias("j"), (F.col("at") > o).cast("int").alias("side")))
    met = F.transform(upto(F.col("visits")), lambda o: F.struct(F.lit(1).alias("kind"), o.alias("i"), F.col("at").alias("j"), F.lit(0).alias("side")))
    out = F.transform(upto(F.col("homes")), lambda o: F.struct(F.lit(1).alias("kind"), F.col("at").alias("i"), o.alias("j"), F.lit(1).alias("side")))
    tasks = dealt.withColumn("t", F.explode(F.when(F.col("visitor"), out).otherwise(F.concat(at_home, met)))).select("node", "weight", "vector", "dim", "cell", "t.*")
    tasks = tasks.withColumn("alone", (F.col("kind") == 0) & (F.col("i") == F.col("j")))
    walked = tasks.groupBy("dim", "cell", "kind", "i", "j").applyInArrow(_walked(cosine), "node long, n long, root long")
    walked = cut(walked, "cover-links")
    totals = walked.groupBy("node").agg(F.sum("n").alias("n"))
    own = rows.filter("class IS NOT NULL").join(classes.select("class", "node", "weight"), "class")
    edges = walked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(own.filter("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b")))
    groups = components(edges).withColumnRenamed("node", "id")
    per_class = classes.select("class", "node", "weight").join(totals, "node", "left").select("class", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    joined = rows.select("id", "class").join(per_class, "class", "left").join(groups, "id", "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


#: The links by all pairs.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
u AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS l FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) >= 9e-1 * a.l * b.l),
r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON l.a = r.b),
root AS (SELECT a AS id, least(a, min(b)) AS root FROM r GROUP BY a),
n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN root ON root.id = vec_id LEFT JOIN n ON n.id = vec_id
"""
