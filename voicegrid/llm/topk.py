"""Exact top-k search by inner product: dual-tree search over cover trees.

Components are turned into integers, floor(``SCALE`` * x); the score of two
vectors is their inner product. Queries and candidates are indexed alike, by a cover
tree: a node has a centre, a covering radius and the points within it; its children's
centres are a net of its points, picked farthest first beginning with its own centre,
so they are apart by at least the distance that still covers all, and each point goes
to the nearest one. A net has as many centres as halve the radius, one level of a
cover tree with base two, or ``FAN`` where space has so many directions that this would
take more; radii are then what they measure, and fall by less. No pair of points
from two nodes scores more than

    <c, d> + r |d| + s |c| + r s        (centres c, d; radii r, s)

so a pair of nodes is left out once this is below the worst k-th score of all
queries in the query node. Pairs with the highest bounds are opened first, and the
scores found in one block of candidates prune in the blocks after it. Bounds have
a margin for rounding, and only pairs strictly below are left out, so ties are
decided by the smaller id as in a full comparison.

The same bound is used before anything is shuffled. A net of at most ``CELLS`` centres, picked
farthest first from a sample, is the topmost level of the tree: each row belongs to the
cell of its nearest centre, and a cell's radius is measured over all its rows. Each
query is also scored against the sample, whose k-th score its own can't be below. Pairs of
cells whose bound is below the least of these among the queries of the one are left
out, so a query is sent to the cells that may hold one of its best only.

A cell's candidates are dealt to parts of about ``TASK_ROWS`` and the queries that they have to meet to
groups of about ``QUERIES``; each pair of these is one task of one shuffle, which indexes its
queries once and its candidates in blocks of ``BLOCK``, and sends on k rows for each query at
most. The best k of these are ranked by query. So the number of jobs doesn't depend on
that of queries; the driver and the broadcasts hold ``SAMPLE`` rows and a row for each pair
of cells at most; candidates are shuffled once for every ``QUERIES`` queries. Parts are
dealt by row, so rows that repeat a vector or an id, however many, are spread.

Vectors that are null or hold a null, NaN or infinite component take no part; an empty table
gives none. Rows are told apart by a number of their own: every row whose id is divisible is a
query, and all other rows, also those that repeat its id, are its candidates, so a repeated id
has each rank once for each of its rows. A row with a null id is no query but a candidate, after all
others of the same score. Vectors of unlike lengths are compared as if filled up with zeros. Scores
are exact below 2**53; beyond that they are rounded, and cut to the range of a long. Other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialize

SCALE = 64
FAN, LEAF = 32, 256
BLOCK = 8192
#: Queries and candidates of a task, about; fewer candidates where there are too few for all cores.
QUERIES, TASK_ROWS = 131_072, 65_536
#: Cells of the shared net at most; rows and components of the sample that it is picked from at most.
CELLS, SAMPLE, SAMPLE_CELLS = 256, 4096, 4 << 20
#: What scores beyond the range of a double count as.
_MOST = 1.7e308
_PLACED = "row long, vec_id long, vector array<double>, cell int, apart double, least double"


class CoverTree:
    """Nodes over a permutation of points: centre, radius, range of points, children."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.range: list[tuple[int, int]] = []
        self.parent: list[int] = []
        self.children: list[list[int]] = []
        if len(points):
            self._grow()
        self.centres = points[self.centre].reshape(len(self.centre), points.shape[1])
        self.points = points[self.order]
        self.radii, self.norms = np.array(self.radius), np.sqrt((self.centres**2).sum(1))

    def _grow(self) -> None:
        middle = int(((self.points - self.points.mean(0)) ** 2).sum(1).argmin())
        waiting = [(0, len(self.points), middle, -1)]
        while waiting:
            start, end, centre, parent = waiting.pop()
            mine = self.order[start:end].copy()
            points = self.points[mine]
            apart = np.sqrt(((points - self.points[centre]) ** 2).sum(1))
            node, radius = len(self.radius), float(apart.max())
            self.centre.append(centre)
            self.radius.append(radius)
            self.range.append((start, end))
            self.parent.append(parent)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if end - start <= LEAF or radius == 0:
                continue
            net, owner = [centre], np.zeros(len(mine), np.int64)
            while len(net) < FAN and apart.max() > radius / 2:
                far = int(apart.argmax())
                new = np.sqrt(((points - points[far]) ** 2).sum(1))
                nearer = new < apart
                owner[nearer] = len(net)
                net.append(int(mine[far]))
                apart = np.minimum(apart, new)
            by = np.argsort(owner, kind="stable")
            self.order[start:end] = mine[by]
            bounds = start + np.searchsorted(owner[by], np.arange(len(net) + 1))
            waiting += [(int(s), int(e), c, node) for s, e, c in zip(bounds, bounds[1:], net) if e > s]


def _net(points: np.ndarray, size: int) -> np.ndarray:
    """Numbers of at most ``size`` points, each the farthest from those before it."""
    net, apart = [0], ((points - points[0]) ** 2).sum(1)
    while len(net) < size and apart.max() > 0:
        net.append(int(apart.argmax()))
        apart = np.minimum(apart, ((points - points[net[-1]]) ** 2).sum(1))
    return np.array(net)


def _bounds(one: np.ndarray, r: np.ndarray, two: np.ndarray, s: np.ndarray) -> np.ndarray:
    """What no pair of points within r and s of the centres scores more than."""
    norms = np.sqrt((one**2).sum(1)), np.sqrt((two**2).sum(1))
    most = (one * two).sum(1) + r * norms[1] + s * norms[0] + r * s
    return most + 1e-9 * (1 + np.abs(most) + norms[0] * norms[1])


class Best:
    """The k best candidates so far of each query of a tree, by score, then smaller id.

    Queries and candidates are named by rows; those with a negative row have no id. What scores below a query's
    ``least`` isn't among its best.
    """

    def __init__(self, tree: CoverTree, rows: np.ndarray, k: int, least: np.ndarray | None = None):
        self.tree, self.ids, self.k = tree, rows[tree.order], k
        self.least = np.full(len(rows), -np.inf) if least is None else least[tree.order]
        self.score = np.full((len(rows), k), -np.inf)  # where nothing is found yet
        self.vec = np.full((len(rows), k), np.iinfo(np.int64).max)
        self.row = np.zeros((len(rows), k), np.int64)
        self.worst = np.array([self.least[s:e].min() for s, e in tree.range])  # of all queries of a node

    def search(self, data: CoverTree, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(self.ids) or not len(ids):
            return
        ids, numbers = ids[data.order], rows[data.order]
        tree = self.tree

        def bounds(q: np.ndarray, d: np.ndarray) -> np.ndarray:
            inner = (tree.centres[q] * data.centres[d]).sum(1)
            most = inner + tree.radii[q] * data.norms[d] + data.radii[d] * tree.norms[q] + tree.radii[q] * data.radii[d]
            return most + 1e-9 * (1 + np.abs(most) + tree.norms[q] * data.norms[d])

        stack = [(float(bounds(np.array([0]), np.array([0]))[0]), 0, 0)]
        while stack:
            bound, q, d = stack.pop()
            if bound < self.worst[q]:
                continue
            below_q, below_d = tree.children[q], data.children[d]
            if not below_q and not below_d:
                self._compare(q, data, d, ids, numbers)
                continue
            # The larger node is opened, so that groups of queries stay whole while candidates are pruned.
            if below_d and (not below_q or data.radii[d] >= tree.radii[q]):
                pairs = [(q, x) for x in below_d]
            else:
                pairs = [(x, d) for x in below_q]
            of_q, of_d = np.array(pairs).T
            most = bounds(of_q, of_d)
            for k in np.argsort(most, kind="stable"):
                if not most[k] < self.worst[of_q[k]]:  # one that isn't a number leaves nothing out
                    stack.append((float(most[k]), int(of_q[k]), int(of_d[k])))

    def _compare(self, q: int, data: CoverTree, d: int, ids: np.ndarray, numbers: np.ndarray) -> None:
        (s, e), (t, u) = self.tree.range[q], data.range[d]
        score = _scores(self.tree.points[s:e], data.points[t:u])
        hit = (score >= np.maximum(self.score[s:e, -1], self.least[s:e])[:, None]) & (numbers[None, t:u] != self.ids[s:e, None])
        rows, columns = np.nonzero(hit)
        if not len(rows):
            return
        changed = np.unique(rows)
        query = np.concatenate([np.repeat(changed, self.k), rows])
        values = np.concatenate([self.score[s + changed].ravel(), score[rows, columns]])
        vec = np.concatenate([self.vec[s + changed].ravel(), ids[t:u][columns]])
        row = np.concatenate([self.row[s + changed].ravel(), numbers[t:u][columns]])
        order = np.lexsort((row, vec, row < 0, -values, query))
        query, values, vec, row = query[order], values[order], vec[order], row[order]
        first = np.searchsorted(query, changed)[:, None] + np.arange(self.k)
        self.score[s + changed], self.vec[s + changed], self.row[s + changed] = values[first], vec[first], row[first]
        # The group's bound, and those of the groups it is part of.
        self.worst[q] = np.maximum(self.score[s:e, -1], self.least[s:e]).min()
        while (q := self.tree.parent[q]) >= 0:
            self.worst[q] = self.worst[self.tree.children[q]].min()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of queries; ids and rows of what was found for them; scores."""
        query, rank = np.nonzero(self.score > -np.inf)
        return self.ids[query], self.vec[query, rank], self.row[query, rank], np.clip(self.score[query, rank], -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def _scores(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.nan_to_num(one @ two.T, nan=0.0, posinf=_MOST, neginf=-_MOST)


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column, filled up with zeros to a common width."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values
    return out


def integers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, vector (array of whole doubles) of the rows that take part."""
    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # floor gives a long, which a huge component doesn't fit; that one is whole already.
    whole = F.transform("embedding", lambda x: F.when(F.abs(x) < 1e12, F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale))
    return embeddings.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))


def _placed(vectors: DataFrame, sample: np.ndarray, rows: np.ndarray, centres: np.ndarray, k: int, modulus: int) -> DataFrame:
    """Each row's cell, the distance from its centre, and for queries a score that their k-th can't be below."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = np.sqrt((sample**2).sum(1)).max()
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                points = _matrix(batch.column("vector"), sample.shape[1])
                with np.errstate(all="ignore"):
                    cell = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
                    apart = np.sqrt(((points - centres[cell]) ** 2).sum(1))
                    least = np.full(len(points), -np.inf)
                    asks = np.array([i is not None and i % modulus == 0 for i in batch.column("vec_id").to_pylist()], bool)
                    if len(rows) >= k and asks.any():
                        score = _scores(points[asks], sample)
                        score[batch.column("row").to_numpy()[asks][:, None] == rows] = -np.inf
                        kth = np.partition(score, len(rows) - k, 1)[:, len(rows) - k]
                        kth -= 1e-9 * np.sqrt((points[asks] ** 2).sum(1)) * reach
                        least[asks] = np.where(np.isnan(kth), -np.inf, kth)
                columns = [*(batch.column(c) for c in ("row", "vec_id", "vector")), pa.array(cell, pa.int32()), pa.array(apart), pa.array(least)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "vector", "cell", "apart", "least"])

    return vectors.mapInArrow(place, _PLACED)


def surviving(cells: list, centres: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (cell of queries, cell of candidates) that may hold one of the best; ``cells`` has cell, asking, radius, asking_radius, least."""
    of = [c for c in cells if c["asking"]]
    out = []
    for c in of:
        many = len(cells)
        with np.errstate(all="ignore"):
            most = _bounds(np.repeat(centres[[c["cell"]]], many, 0), np.full(many, c["asking_radius"]), centres[[d["cell"] for d in cells]], np.array([d["radius"] for d in cells]))
        out += [(c["cell"], d["cell"]) for d, m in zip(cells, most.tolist()) if not m < c["least"]]
    return out


def top_k(embeddings: DataFrame, k: int = 20, modulus: int = 20, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of the rows whose vec_id is divisible by ``modulus``."""
    spark = embeddings.sparkSession
    number = F.monotonically_increasing_id()
    vectors = integers(embeddings, scale).withColumn("row", F.when(F.col("vec_id").isNull(), -1 - number).otherwise(number))
    vectors = materialize(vectors, "vectors")
    is_query = F.col("vec_id") % modulus == 0
    n, n_queries, width = vectors.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("vector"))).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    some = min(SAMPLE, max(1, SAMPLE_CELLS // max(width, 1)))
    drawn = vectors.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) <= int(min(1, some / n) * (1 << 30))).limit(some) if n > some else vectors
    drawn = drawn.select("row", "vector").toArrow().combine_chunks()
    if not drawn.num_rows:
        drawn = vectors.select("row", "vector").limit(1).toArrow().combine_chunks()
    sample, rows = _matrix(drawn.column("vector").chunk(0), width), drawn.column("row").to_numpy()
    # More groups of candidates than cores, or some cores would have none.
    unit = -(-n // max(-(-n // TASK_ROWS), min(3 * spark.sparkContext.defaultParallelism, -(-n // 2048)), 1))
    with np.errstate(all="ignore"):
        centres = sample[_net(sample, min(CELLS, -(-n // unit)))]
    placed = materialize(_placed(vectors, sample, rows, centres, k, modulus), "placed")
    asks = F.when(is_query, 1)
    measured = (F.count("*").alias("n"), F.count(asks).alias("asking"), F.max("apart").alias("radius"), F.max(asks * F.col("apart")).alias("asking_radius"), F.min(F.when(is_query, F.col("least"))).alias("least"))
    cells = placed.groupBy("cell").agg(*measured).collect()  # CELLS rows at most
    pairs = surviving(cells, centres)

    # Tasks are numbered: parts of a cell's candidates times groups of the queries that come to them.
    coming = {d: sum(c["asking"] for c in cells if (c["cell"], d) in set(pairs)) for d in {d for _, d in pairs}}
    dealt, tasks = {}, 0
    for c in cells:
        if c["cell"] in coming:
            parts, groups = -(-c["n"] // unit), -(-coming[c["cell"]] // QUERIES)
            dealt[c["cell"]] = (tasks, parts, groups)
            tasks += parts * groups
    target = spark.createDataFrame([(d, *x) for d, x in dealt.items()], "cell int, base int, parts int, groups int")
    meets = spark.createDataFrame([(q, *dealt[d]) for q, d in pairs], "cell int, base int, parts int, groups int")

    def turn(of: str):
        return F.pmod(F.xxhash64("row"), F.col(of))

    def every(of: str):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    def numbered(df: DataFrame):
        task = (F.col("base") + F.col("part") * F.col("groups") + F.col("grp")).cast("int").alias("task")
        return df.select(task, "row", "vec_id", "vector", "least").repartition(2 * tasks, "task").groupBy("task")

    candidates = numbered(placed.join(F.broadcast(target), "cell").withColumn("part", turn("parts")).withColumn("grp", every("groups")))
    again = spark.read.schema(placed.schema).parquet(placed.stored_at)  # a scan of its own, or the sides' columns are the same
    queries = numbered(again.where(is_query).join(F.broadcast(meets), "cell").withColumn("grp", turn("groups")).withColumn("part", every("parts")))

    def search(theirs: pa.Table, mine: pa.Table) -> pa.Table:
        theirs, mine = theirs.combine_chunks(), mine.combine_chunks()
        best = None
        if mine.num_rows and theirs.num_rows:
            asked = {row: i for row, i in zip(mine.column("row").to_pylist(), mine.column("vec_id").to_pylist())}
            with np.errstate(all="ignore"):
                best = Best(CoverTree(_matrix(mine.column("vector").chunk(0), width)), mine.column("row").to_numpy(), k, mine.column("least").to_numpy())
                for at in range(0, theirs.num_rows, BLOCK):
                    block = theirs.slice(at, BLOCK)
                    ids = block.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
                    best.search(CoverTree(_matrix(block.column("vector").chunk(0), width)), ids, block.column("row").to_numpy())
        query, vec, row, score = best.rows() if best else [np.zeros(0, np.int64)] * 4
        ids = np.array([asked[q] for q in query.tolist()], np.int64) if best else query
        columns = {"query": pa.array(query), "query_id": pa.array(ids), "vec_id": pa.array(vec, mask=row < 0), "score": pa.array(score)}
        return pa.table(columns)

    found = candidates.cogroup(queries).applyInArrow(search, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM whole q JOIN whole d ON d.row <> q.row WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST))::INT AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
