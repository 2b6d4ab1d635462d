"""Exact top-k search by inner product over M-tree pages, best first.

With c the mean and M the largest norm of x - c, a vector x is the point (x - c, sqrt(M^2 - |x - c|^2)) and a query q
the point (q, 0) scaled to norm M. All points then lie at distance M from the origin, and for one query the nearest
points are those of largest inner product, so bounds of a metric hold. Every vector is indexed:

* Cells: each vector goes to the nearest pivot. Pivots are a sample by a hash of vec_id, one for about ``PAGE`` vectors
  and at most ``PIVOTS``. Cells of several pages are cut into ``RINGS`` by distance to the pivot.
* Pages: a ring is dealt to pages of about ``PAGE`` vectors by a hash, so equal vectors spread as others do. A page
  is a small M-tree: its parent object is the pivot, routing objects hold entries within covering radii, and every
  object stores its distance to its parent.
* Queries meet in blocks of one cell. Each block is searched in one page of its cell first, which gives every query a
  k-th best score, and with it the block a largest distance that still counts. Cells and rings that lie beyond it are
  left out before the join with pages; in a page, routing objects and entries whose stored distances rule them out are
  skipped uncomputed, and the rest is visited nearest bound first.

Components are whole numbers (``quantize``); scores are exact. Distances only prune, with slack for rounding.

Edge cases: vectors that are null or hold null or non-finite components, and rows without vec_id, take no part;
vectors of different length do not meet; ties go to the smaller vec_id; rows of the query's own vec_id are never its
results; repeated other rows count each. Components beyond 63 bits are cut to that range by ``quantize``, scores beyond
64 bits by the search. Columns besides are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, small_batches

PIVOTS, RINGS, PAGE, BLOCK = 1_024, 8, 2_048, 1_024
#: Pages of a ring that a block meets under one key of the join.
GROUP = 16
#: Entries below a routing object, on average.
LEAF = 64
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def quantize(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, as array<double>; null where the vector takes no part."""
    x = embedding.cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(good, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("double")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


@dataclass(frozen=True)
class Space:
    """Where vectors and queries of one length lie: the mean, and the largest squared norm around it."""

    centre: np.ndarray
    top: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        y = x - self.centre
        return np.concatenate([y, np.sqrt(np.maximum(self.top - (y * y).sum(axis=1), 0))[:, None]], axis=1)

    def aim(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points of queries, and the factor by which each is scaled (0 for a query of zeros)."""
        norms = np.sqrt((q * q).sum(axis=1))
        factor = np.divide(np.sqrt(self.top), norms, out=np.zeros_like(norms), where=norms > 0)
        return np.concatenate([q * factor[:, None], np.zeros((len(q), 1))], axis=1), factor

    @property
    def slack(self) -> float:
        return 1e-6 * (1 + np.sqrt(self.top))

    def limits(self, q: np.ndarray, factor: np.ndarray, floor: np.ndarray, known: np.ndarray) -> np.ndarray:
        """For each query: the distance beyond which scores are below its floor."""
        away = np.sqrt(np.maximum(2 * self.top - 2 * factor * (floor.astype(np.float64) - q @ self.centre), 0)) + self.slack
        return np.where(known & (factor > 0), away, np.inf)


def _exact(x: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of rows as int64; ``bound`` is at least their size."""
    if bound < 2.0**52:
        return np.rint(q @ x.T).astype(np.int64)
    rows = [[int(v) for v in r] for r in x.tolist()]
    return np.array([[min(max(sum(int(a) * b for a, b in zip(one, row, strict=True)), _LOW), _HIGH) for row in rows] for one in q.tolist()], dtype=np.int64).reshape(len(q), len(x))


def build_page(x: np.ndarray, pivot: np.ndarray, space: Space) -> tuple[np.ndarray, ...]:
    """An M-tree of two levels: order of entries, first entry of each routing object (and the end), routing object
    (by its place in the order), covering radius, its distance to the pivot, each entry's distance to its routing object."""
    points = space.lift(x)
    routes = np.linspace(0, len(x) - 1, max(1, len(x) // LEAF)).astype(np.int64)
    away = _distances(points, points[routes])
    near = np.argmin(away, axis=1)
    order = np.argsort(near, kind="stable")
    near = near[order]
    used, starts = np.unique(near, return_index=True)
    own = away[order, near]
    return order, np.append(starts, len(x)), np.argsort(order)[routes[used]], np.maximum.reduceat(own, starts), _distances(points[routes[used]], pivot[None])[:, 0], own


def search_page(q: np.ndarray, own_ids: np.ndarray, floor: np.ndarray, known: np.ndarray, k: int, ids: np.ndarray, x: np.ndarray, tree: tuple, pivot: np.ndarray, space: Space) -> tuple[tuple[np.ndarray, ...], int]:
    """The k best entries of a page for each query of a block that reach its floor: places of queries, ids, scores; and
    how many scores were computed."""
    starts, routes, radii, to_pivot, own = tree
    big = float(np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1])
    known, floor = known & (big < 2.0**52), floor.copy()
    aims, factor = space.aim(q)
    far = _distances(aims, pivot[None])[:, 0]
    limit = space.limits(q, factor, floor, known)
    open_ = np.abs(far[:, None] - to_pivot[None]) - radii[None] <= limit[:, None] + space.slack  # others are ruled out uncomputed
    cols = np.flatnonzero(open_.any(axis=0))
    away = _distances(aims, space.lift(x[routes[cols]]))
    bounds = np.where(open_[:, cols], away - radii[cols][None] - space.slack, np.inf)
    held: list[tuple[np.ndarray, ...]] = []
    n_held = computed = 0

    def best() -> tuple[np.ndarray, ...]:
        at, own_id, score = (np.concatenate(v) for v in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((own_id, ~score, at))  # not x falls as x rises, also at the ends of the range
        at, own_id, score = at[order], own_id[order], score[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        last = rank == k - 1
        floor[at[last]] = np.maximum(np.where(known[at[last]], floor[at[last]], _LOW), score[last])
        known[at[last]] = big < 2.0**52
        return tuple(v[rank < k] for v in (at, own_id, score))

    for j in np.argsort(bounds.min(axis=0, initial=np.inf), kind="stable"):
        rows = np.flatnonzero(bounds[:, j] <= limit)
        if not len(rows):
            continue
        entries = np.arange(starts[cols[j]], starts[cols[j] + 1])
        if np.isfinite(limit[rows]).all():  # by the distances to the routing object that entries have stored
            lo, hi = (away[rows, j] - limit[rows]).min() - space.slack, (away[rows, j] + limit[rows]).max() + space.slack
            entries = entries[(own[entries] >= lo) & (own[entries] <= hi)]
        scores = _exact(x[entries], q[rows], big)
        computed += scores.size
        keep = (ids[entries][None] != own_ids[rows][:, None]) & (~known[rows][:, None] | (scores >= floor[rows][:, None]))
        r, e = np.nonzero(keep)
        held.append((rows[r], ids[entries][e], scores[r, e]))
        n_held += len(r)
        if n_held > 8 * k * len(q):
            held = [best()]
            n_held, limit = len(held[0][0]), space.limits(q, factor, floor, known)
    return best(), computed


_TREE = "x binary, starts array<int>, routes array<int>, radii array<double>, to_pivot array<double>, own array<double>"
_PAGE = f"dim int, cell int, ring int, page int, ids array<long>, {_TREE}"
_BLOCK = "dim int, cell int, block long, q_ids array<long>, q binary"


def top_k(vectors: DataFrame, query: Column, k: int = 20) -> DataFrame:
    """For each row of (vec_id, x) that ``query`` holds for: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = materialize(vectors.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), "x", F.size("x").alias("dim"), query.alias("is_query")), "vectors")
    means = rows.select("dim", F.posexplode("x").alias("at", "v")).groupBy("dim", "at").agg(F.avg("v").alias("v")).orderBy("dim", "at").collect()  # a number for each component
    counts = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    centres = {d: np.array([r["v"] for r in means if r["dim"] == d]) for d in counts}
    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                y = _matrix(batch.column("x").take(pa.array(np.flatnonzero(dims == d)))) - centres[d]
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([float((y * y).sum(axis=1).max())])], names=["dim", "top"])

    tops = {r["dim"]: r["top"] for r in rows.select("dim", "x").mapInArrow(norms, "dim int, top double").groupBy("dim").agg(F.max("top").alias("top")).collect()}
    spaces = {d: Space(centres[d], tops[d]) for d in counts}
    # A sample of at most PIVOTS vectors of each length.
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    drawn = {d: rows.filter((F.col("dim") == d) & (draw <= (1 << 30) * min(1.0, 8 * PIVOTS / n))).orderBy(draw, "vec_id").limit(min(PIVOTS, -(-n // PAGE))).select("x").collect() for d, n in counts.items()}
    pivots = {d: spaces[d].lift(np.array([r["x"] for r in own])) for d, own in drawn.items()}

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, away = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            homes = np.zeros(batch.num_rows, dtype=np.int32)
            dims, asks = batch.column("dim").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = _matrix(batch.column("x").take(pa.array(at)))
                far = _distances(spaces[d].lift(x), pivots[d])
                cells[at], away[at] = np.argmin(far, axis=1), far.min(axis=1)
                homes[at[asks[at] == True]] = np.argmin(_distances(spaces[d].aim(x[asks[at] == True])[0], pivots[d]), axis=1)  # noqa: E712  null asks nothing
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(away), pa.array(homes)], names=[*batch.schema.names, "cell", "away", "home"])

    celled = materialize(rows.mapInArrow(give_back(to_cells), "vec_id long, x array<double>, dim int, is_query boolean, cell int, away double, home int"), "cells")
    cells = celled.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far"))  # a row per pivot at most
    width = F.greatest(F.col("far") - F.col("near"), F.lit(1e-300))
    ring = F.when(F.col("n") > 4 * PAGE, F.least(F.floor((F.col("away") - F.col("near")) / width * RINGS), F.lit(RINGS - 1))).otherwise(0).cast("int")
    ringed = celled.join(F.broadcast(cells), ["dim", "cell"]).withColumn("ring", ring).select("dim", "cell", "ring", "away", "vec_id", "x")
    sizes = ringed.groupBy("dim", "cell", "ring").agg(F.ceil(F.count("*") / PAGE).cast("int").alias("pages"), F.min("away").alias("near"), F.max("away").alias("far"))
    sizes = materialize(sizes, "rings")  # RINGS rows per pivot at most
    known_rings: dict[int, list] = {}
    for r in sizes.collect():
        known_rings.setdefault(r["dim"], []).append((r["cell"], r["ring"], r["pages"], r["near"], r["far"]))
    ring_table = {d: tuple(np.array(v) for v in zip(*own, strict=True)) for d, own in known_rings.items()}
    number = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(7)), F.greatest(n, F.lit(1))).cast("int")

    def page(key: tuple, group: pa.Table) -> pa.Table:
        d, cell, ring_no, n = (v.as_py() for v in key)
        x = _matrix(group.column("x").combine_chunks())
        order, starts, routes, radii, to_pivot, own = build_page(x, pivots[d][cell], spaces[d])
        one = lambda a, kind: pa.array([a.tolist()], pa.list_(kind))
        whole = lambda v: pa.array([v], pa.int32())
        return pa.table(
            {
                "dim": whole(d), "cell": whole(cell), "ring": whole(ring_no), "page": whole(n), "ids": one(group.column("vec_id").to_numpy()[order], pa.int64()), "x": pa.array([x[order].tobytes()], pa.binary()),
                "starts": one(starts, pa.int32()), "routes": one(routes, pa.int32()), "radii": one(radii, pa.float64()), "to_pivot": one(to_pivot, pa.float64()), "own": one(own, pa.float64()),
            }
        )

    paged = ringed.join(F.broadcast(sizes.select("dim", "cell", "ring", "pages")), ["dim", "cell", "ring"]).withColumn("page", number(F.col("pages")))
    pages = materialize(paged.select("dim", "cell", "ring", "page", "vec_id", "x").groupBy("dim", "cell", "ring", "page").applyInArrow(page, _PAGE), "pages")

    def block(key: tuple, group: pa.Table) -> pa.Table:
        d, cell, n = (v.as_py() for v in key)
        x = _matrix(group.column("x").combine_chunks())
        return pa.table({"dim": pa.array([d], pa.int32()), "cell": pa.array([cell], pa.int32()), "block": pa.array([cell * (1 << 32) + n], pa.int64()), "q_ids": pa.array([group.column("vec_id").to_pylist()], pa.list_(pa.int64())), "q": pa.array([x.tobytes()], pa.binary())})

    asked = celled.filter("is_query").select("dim", F.col("home").alias("cell"), "vec_id", "x")
    many = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row per pivot at most
    blocks = asked.join(F.broadcast(many), ["dim", "cell"]).withColumn("block", number(F.col("blocks"))).drop("blocks").groupBy("dim", "cell", "block").applyInArrow(block, _BLOCK)

    def searched(batch: pa.RecordBatch, i: int) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """A row of block and page: the row, queries, floors, what is known of them, ids and the page's best."""
        r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
        q = np.frombuffer(r["q"], dtype=np.float64).reshape(-1, r["dim"])
        own = np.array(r["q_ids"], dtype=np.int64)
        floor = np.array([_LOW if f is None else f for f in r.get("floor") or [None] * len(own)], dtype=np.int64)
        known = np.array([f is not None for f in r.get("floor") or [None] * len(own)], dtype=bool)
        if r["ids"] is None:
            return r, q, floor, known, own, (np.zeros(0, np.int64),) * 3
        ids, x = np.array(r["ids"], dtype=np.int64), np.frombuffer(r["x"], dtype=np.float64).reshape(-1, r["dim"])
        tree = tuple(np.array(r[c]) for c in ("starts", "routes", "radii", "to_pivot", "own"))
        return r, q, floor, known, own, search_page(q, own, floor, known, k, ids, x, tree, pivots[r["dim"]][r["page_cell"]], spaces[r["dim"]])[0]

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block with its queries' floors, and a row for each ring that may hold something above them."""
        for batch in batches:
            for i in range(batch.num_rows):
                r, q, floor, known, own, (at, _, score) = searched(batch, i)
                for j in range(len(own)):
                    mine = score[at == j]
                    if len(mine) >= k:
                        floor[j], known[j] = mine.min(), True
                space, (cell, ring_no, n_pages, near, far) = spaces[r["dim"]], ring_table[r["dim"]]
                aims, factor = space.aim(q)
                limit = space.limits(q, factor, floor, known & (float(np.abs(q).max(initial=0)) * (np.sqrt(space.top) + np.abs(space.centre).max(initial=0)) * r["dim"] < 2.0**52))
                away = _distances(aims, pivots[r["dim"]])[:, cell]  # of each query to the pivot of each ring
                meets = ((away - limit[:, None] <= far[None] + space.slack) & (away + limit[:, None] >= near[None] - space.slack)).any(axis=0)
                hit = np.flatnonzero(meets)
                groups = [(c, g, p) for c, g, n in zip(cell[hit].tolist(), ring_no[hit].tolist(), n_pages[hit].tolist(), strict=True) for p in range(-(-n // GROUP))]
                for a in range(0, len(groups), 16):
                    some = groups[a : a + 16]
                    m = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r["dim"]] * m, pa.int32()), pa.array([c for c, _, _ in some], pa.int32()), pa.array([g for _, g, _ in some], pa.int32()), pa.array([p for _, _, p in some], pa.int32()), pa.array([r["q_ids"]] * m, pa.list_(pa.int64())),
                            pa.array([r["q"]] * m, pa.binary()), pa.array([[f if y else None for f, y in zip(floor.tolist(), known.tolist(), strict=True)]] * m, pa.list_(pa.int64())),
                        ],
                        names=["dim", "page_cell", "ring", "part", "q_ids", "q", "floor"],
                    )

    first = pages.filter("page = 0").groupBy("dim", "cell").agg(F.min("ring").alias("ring"))
    home_pages = pages.filter("page = 0").join(first, ["dim", "cell", "ring"]).drop("ring", "page")
    home = blocks.join(home_pages, ["dim", "cell"], "left").withColumnRenamed("cell", "page_cell").drop("block")
    known = materialize(home.mapInArrow(give_back(floors), "dim int, page_cell int, ring int, part int, q_ids array<long>, q binary, floor array<long>"), "blocks")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, _, _, _, own, (at, ids, score) = searched(batch, i)
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    # Blocks meet the pages of those rings only that may hold better ones.
    keyed = pages.withColumnsRenamed({"cell": "page_cell"}).withColumn("part", F.floor(F.col("page") / GROUP).cast("int")).drop("page")
    met = known.join(keyed, ["dim", "page_cell", "ring", "part"])
    candidates = met.mapInArrow(give_back(found), "query_id long, vec_id long, score long")
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
