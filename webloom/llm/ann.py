"""Approximate nearest neighbours by robust-pruned directed graphs.

Distinct vectors are dealt by hash to shards of about ``SHARD`` (fewer of wide ones, see
``shard_rows``); a task builds each
shard's graph: beam searches from the medoid propose neighbours for a block of points at
a time, and relaxed pruning keeps an edge only where no kept, nearer neighbour is closer to
the target by the factor ``ALPHA``.  Every shard is searched with a beam for every query; the
shards' answers are merged and ranked by exact distances in double precision.  A search of a
full shard takes the distances to about a tenth of it or less (see the README), and nearly
as few where the shard is several times as large.

Equal vectors are one node, with the k + 1 smallest ids (no others can be among the k
nearest), so any number of copies adds neither edges nor work.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.llm.common import arrow_schema, read, release_memory, written

SHARD = 1 << 16
#: Bytes that a shard may take in a task.
SHARD_BYTES = 256 << 20
DEGREE, SLACK = 32, 16
BEAM_BUILD, BEAM_QUERY = 64, 128
ALPHA = 1.15
#: Points that a search opens at a time, and searches that go together.
OPENED = 4
BLOCK = 512
BLOCK_BYTES = 64 << 20


def block_of(width: int) -> int:
    """How many searches go together: fewer of wide vectors."""
    return max(16, min(BLOCK, BLOCK_BYTES // (8 * width * (DEGREE + SLACK) * OPENED)))


def distances(points: np.ndarray, at: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its row of points ``at``; a place of -1 is
    infinitely far.  Differences are taken first, so vectors far from the origin lose nothing."""
    apart = points[at] - queries[:, None, :]
    return np.where(at >= 0, np.einsum("qkd,qkd->qk", apart, apart), np.inf)


def beam_search(points: np.ndarray, graph: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``beam`` nearest points found for each query, their squared distances, nearest
    first (-1 and infinity where there are fewer), and how many distances each query took.
    All queries advance together: each step opens every query's ``OPENED`` nearest unopened
    points of its beam, and no distance is computed twice."""
    m, n = len(queries), len(points)
    seen = np.zeros((m, n), bool)
    ids = np.full((m, beam), -1)
    far = np.full((m, beam), np.inf, points.dtype)
    open_ = np.zeros((m, beam), bool)
    first = np.unique(start)[:beam]
    ids[:, : len(first)] = first
    far[:, : len(first)] = distances(points, ids[:, : len(first)], queries)
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    open_[:, : len(first)] = True
    seen[:, first] = True
    taken = np.full(m, len(first))
    alive = np.arange(m)
    while True:
        alive = alive[open_[alive].any(axis=1)]
        if not len(alive):
            return ids, far, taken
        pick = open_[alive]
        pick &= np.cumsum(pick, axis=1) <= OPENED
        open_[alive] &= ~pick
        row, slot = np.nonzero(pick)
        of = alive[row]
        new = graph[ids[of, slot]]
        of, new = np.repeat(of, new.shape[1]), new.ravel()
        fresh = new >= 0
        of, new = of[fresh], new[fresh]
        fresh = ~seen[of, new]
        pair = np.unique(of[fresh] * n + new[fresh])
        of, new = pair // n, pair % n
        seen[of, new] = True
        taken += np.bincount(of, minlength=m)
        apart = points[new] - queries[of]
        d = np.einsum("nd,nd->n", apart, apart)
        good = d < far[of, -1]
        of, new, d = of[good], new[good], d[good]
        if not len(of):
            continue
        many = np.bincount(of, minlength=m)
        rows = np.flatnonzero(many)
        place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        at = np.full(m, -1)
        at[rows] = np.arange(len(rows))
        more = np.full((len(rows), int(many.max())), -1)
        more_far = np.full(more.shape, np.inf, points.dtype)
        more[at[of], place], more_far[at[of], place] = new, d
        all_far = np.concatenate((far[rows], more_far), axis=1)
        best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        far[rows] = np.take_along_axis(all_far, best, 1)
        ids[rows] = np.take_along_axis(np.concatenate((ids[rows], more), axis=1), best, 1)
        open_[rows] = np.take_along_axis(np.concatenate((open_[rows], more >= 0), axis=1), best, 1)


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node at most ``degree`` of its candidates (rows of -1-padded places): take
    the nearest, then drop those that are closer to it, by the factor alpha, than to the
    node; and so on."""
    order = np.sort(candidates, axis=1)
    twice = np.zeros(order.shape, bool)
    twice[:, 1:] = order[:, 1:] == order[:, :-1]
    order = np.where(twice | (order == nodes[:, None]), -1, order)
    far = distances(points, order, points[nodes])
    rank = np.argsort(far, axis=1, kind="stable")
    cand, far = np.take_along_axis(order, rank, 1), np.take_along_axis(far, rank, 1)
    alive = np.isfinite(far)
    most = max(1, int(alive.sum(axis=1).max()))
    cand, far, alive = cand[:, :most], far[:, :most], alive[:, :most]
    # squared distances between the candidates of each node, scaled; seen from the node, near
    # ones are short vectors and their products exact enough
    v = points[cand] - points[nodes][:, None, :]
    norms = np.einsum("nkd,nkd->nk", v, v)
    between = np.matmul(v, v.transpose(0, 2, 1))
    between *= -2
    between += norms[:, :, None]
    between += norms[:, None, :]
    between *= alpha * alpha
    out = np.full((len(nodes), degree), -1)
    for k in range(degree):
        r = np.flatnonzero(alive.any(axis=1))
        if not len(r):
            break
        left = alive[r]
        slot = left.argmax(axis=1)
        out[r, k] = cand[r, slot]
        left[np.arange(len(r)), slot] = False
        alive[r] = left & (between[r, slot] > far[r])
    return out


def build(points: np.ndarray, *, degree: int = DEGREE, slack: int = SLACK, beam: int = BEAM_BUILD, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """The graph (rows of places, -1 at the end) and the entry point of a shard.

    From a random graph, each block of points searches for itself in what there is and
    keeps pruned edges; each end of an edge gets the other as a neighbour and is pruned in
    turn when its ``slack`` is full."""
    n, width, block = len(points), degree + slack, block_of(points.shape[1])
    start = np.array([int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())])
    graph = np.full((n, width), -1)
    if n <= width:
        for i in range(n):
            graph[i, : n - 1] = [j for j in range(n) if j != i]
        return graph, start
    graph[:, :degree] = np.random.default_rng(7).integers(0, n, (n, degree))
    for lo in range(0, n, block):
        nodes = np.arange(lo, min(n, lo + block))
        found = beam_search(points, graph, start, points[nodes], beam)[0]
        graph[nodes, :degree] = robust_prune(points, nodes, np.concatenate((found, graph[nodes]), axis=1), degree, alpha)
        graph[nodes, degree:] = -1
        to, of = graph[nodes, :degree].ravel(), np.repeat(nodes, degree)
        to, of = to[to >= 0], of[to >= 0]
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        begin = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        targets, many = to[begin], np.diff(np.append(begin, len(to)))
        place = np.arange(len(to)) - np.repeat(begin, many)
        used = (graph[targets] >= 0).sum(axis=1)
        fits = used + many <= width
        some = np.repeat(fits, many)
        graph[to[some], (np.repeat(used, many) + place)[some]] = of[some]
        full = np.flatnonzero(~fits)
        for part in range(0, len(full), block):
            t = full[part : part + block]
            extra = np.full((len(t), int(many[t].max())), -1)
            row = np.repeat(np.arange(len(t)), many[t])
            inside = np.arange(len(row)) - np.repeat(np.cumsum(many[t]) - many[t], many[t])
            extra[row, inside] = of[np.repeat(begin[t], many[t]) + inside]
            nodes_ = targets[t]
            graph[nodes_, :degree] = robust_prune(points, nodes_, np.concatenate((graph[nodes_], extra), axis=1), degree, alpha)
            graph[nodes_, degree:] = -1
    return graph, start


def usable(vector: str):
    """Vectors that are not null, not zero, and of finite components."""
    v = F.col(vector)
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & good & F.exists(v, lambda x: x != 0), F.lit(False))


def shard_rows(width: int) -> int:
    """Rows of a shard whose vectors (twice, while they are gathered) and edges take at most
    ``SHARD_BYTES``."""
    return max(1024, min(SHARD, SHARD_BYTES // (8 * (2 * width + DEGREE + SLACK))))


def search(table: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, shard: int | None = None, beam: int = BEAM_QUERY) -> DataFrame:
    """query_id, rank (from 1), ``key`` and score (Euclidean distance) of the ``k`` nearest
    rows found for each row of ``queries`` (a selection of ``table``'s rows) but itself.

    Vectors that are null, zero, or hold null or non-finite components take no part, and
    neither do those of another length than most of the queries (the shorter of two lengths
    that are as frequent).  Ties go to the smaller key; with fewer than k candidates all are
    returned; an empty table gives no rows; a key's repeated rows with one vector count
    once; null keys take no part.  All is in double precision, and divided by a power of two
    that brings the largest component to one, so that no square of a finite vector overflows.
    """
    rows, asked = (t.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")) for t in (table, queries))
    asked = written(asked.distinct())
    usual = asked.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    width = usual["size"] if usual else 0
    asked, rows = asked.where(F.size("v") == width), rows.where(F.size("v") == width)
    # distinct vectors with the k + 1 smallest ids of each; the rank filter cuts before the shuffle
    nth = F.row_number().over(W.partitionBy("v").orderBy("id"))
    nodes = written(rows.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    most = F.max(F.array_max(F.transform("v", F.abs))).alias("most")
    facts = nodes.agg(F.count(F.lit(1)).alias("n"), most).first()
    largest = max(facts["most"] or 0.0, asked.agg(most).first()["most"] or 0.0)
    scale = 2.0 ** min(1000, max(-1000, math.frexp(largest)[1]))
    shards = max(1, -(-facts["n"] // (shard or shard_rows(width))))
    # a shard is asked all queries, in parts that a task holds one at a time
    placed = nodes.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("id"), "v", "ids")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("array<bigint>").alias("ids"))
    # by range, as few keys dealt by hash would share tasks while others have none
    both = placed.unionByName(sent).repartitionByRange(min(shards, 2000), "shard").sortWithinPartitions("shard", "kind")
    ddl = "query_id bigint, id bigint, score double"
    schema = arrow_schema(ddl)

    def run(batches):
        at, graph, points = None, None, np.zeros((0, width))
        vectors: list[np.ndarray] = []
        names: list[list[int]] = []

        def answer(ids: np.ndarray, asked_: np.ndarray):
            nonlocal graph, points
            if graph is None:
                points = np.concatenate(vectors) if vectors else points
                vectors.clear()
                graph = build(points) if len(points) else ()
            block = block_of(width)
            for lo in range(0, len(ids) if len(points) else 0, block):
                q = asked_[lo : lo + block]
                found = beam_search(points, graph[0], graph[1], q, max(beam, k + 1))[0]
                exact = scale * np.sqrt(((points[found] - q[:, None, :]) ** 2).sum(axis=2))
                exact[found < 0] = np.inf
                out = ([], [], [])
                for i, me in enumerate(ids[lo : lo + block].tolist()):
                    mine = sorted((d, c) for d, f in zip(exact[i].tolist(), found[i].tolist(), strict=True) if f >= 0 for c in names[f] if c != me)[:k]
                    out[0].extend([me] * len(mine))
                    out[1].extend(c for _, c in mine)
                    out[2].extend(d for d, _ in mine)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                shard_, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = np.flatnonzero((shard_[1:] != shard_[:-1]) | (kind[1:] != kind[:-1])) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                    if at != shard_[lo]:
                        at, graph, points = shard_[lo], None, np.zeros((0, width))
                        vectors.clear()
                        names.clear()
                    v = batch.column(3).slice(lo, hi - lo).flatten().to_numpy().reshape(-1, width) / scale
                    if kind[lo] == 0:
                        vectors.append(v)
                        names.extend(batch.column(4).slice(lo, hi - lo).to_pylist())
                    else:
                        yield from answer(batch.column(2).slice(lo, hi - lo).to_numpy(), v)
        finally:
            vectors, names, graph, points = [], [], None, None
            release_memory()

    found = both.mapInArrow(run, ddl)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").cast(dict(table.dtypes)[key]).alias(key), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    return search(table, table.where(F.col("vec_id") % 100 == 0)).select(F.col("query_id").cast("bigint"), "rank", F.col("vec_id").cast("bigint"), "score")
