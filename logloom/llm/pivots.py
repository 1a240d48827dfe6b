"""Op 5. Exact top-k by inner product with a pivot table.

Vectors become integers. Distances from every vector to a fixed number of pivots are computed once and
kept beside the vectors in packed blocks. For a query q and a candidate x each pivot p gives the lower
bound |d(q,p) - d(x,p)| on their distance; the largest of them bounds the score from above by
(|q|^2 + |x|^2 - bound^2) / 2. Two passes, both over blocks of queries that meet blocks of rows:

1. Each block scores the FIRST candidates of the highest bounds; over all blocks the k-th best score of a query is its floor,
   which no row of the answer can be below.
2. Each block scores candidates in the order of their bounds, in chunks of CHUNK that double, and stops at the first bound below
   the floor or below the k-th best score of the blocks before it: what is left can't be in the answer, so the result is exact.

How many candidates are eliminated depends on the vectors: clustered ones stop early, vectors without structure hardly do.

Bounds are lowered by what floats may have rounded, which grows with the vectors, so results are exact at any scale.
The cost is that of all query blocks against all row blocks: quadratic where queries are a share of the rows.

Queries are a stated set, met with all rows in blocks, never in single pairs. A part of the blocks of rows and a group of queries, about
QUERY_BYTES of them, make a cell, a task of its own, by a shuffle and without a join, so no copies are broadcast: the task holds
the group's queries and their best so far, and the part's blocks pass one by one. Queries are copied once a part (PARTS a core at most), not once a block.
Defined results: null vectors, vectors with null or non-finite components or of another length than
most take no part; ties go to the smaller id; rows without an id take no part; repeated rows count as rows, but never answer
a query of their own id; fewer than k rows give all; scores are exact as long as they fit 64 bits; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, fresh, table, tune

PIVOTS, BLOCK, QUERY_BLOCK, CHUNK, FIRST = 48, 4096, 512, 64, 64
#: Bytes of queries and their distances that a task holds, or one QUERY_BLOCK; parts of the rows a core.
QUERY_BYTES, PARTS = 8 << 20, 4
#: The floor of queries that have none.
LOWEST = -(1 << 63)
#: Whole numbers up to here are exact as floats.
EXACT = 1 << 53
EPS = float(np.finfo(float).eps)
#: Parts of a query's candidates that are cut to k before they meet.
STAGE = 64


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: array of integers floor(scale * x), without rows that take no part."""
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(F.lit(1024) * x.cast("double")))
    return fresh(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fine).select("vec_id", v.alias("v"))


def choose_pivots(rows: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """A fixed number of far-apart vectors out of a bounded sample (16 times as many, by a hash of the id)."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(16 * count).select("v").toPandas()["v"]
    x = np.array([np.asarray(v, float) for v in sample]) if len(sample) else np.zeros((0, 0))
    if not len(x):
        return x
    chosen, gap = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(count, len(x)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots from differences, not from products, whose rounding would grow with the square of the norms."""
    out = np.empty((len(x), len(pivots)))
    for k, p in enumerate(pivots):
        gap = x - p
        out[:, k] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def rounding(norms: np.ndarray, dist: np.ndarray, width: int) -> np.ndarray:
    """What floats may add to or take from each row's distances: components, differences, their sum and its root are each rounded, and a pivot is no longer than the row and its distance together."""
    return 2 * (width + 8) * EPS * (np.sqrt(norms) + dist.max(1, initial=0))


PACKED = "slot int, ids binary, vectors binary, distances binary, floors binary"


def packed(rows: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """rows(slot, vec_id, v, floor), by slot within a task -> blocks of at most `block` rows or so of one slot: ids, integer
    vectors, their pivot table and floors, as bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def pack(batches):
        p = shared.value
        held, slot = [], None

        def out():
            ids, vectors, floors = (np.concatenate(c) for c in zip(*held))
            x = vectors.astype(np.int64)
            d = distances(x.astype(float), p)
            return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (ids, x, d, floors))], ["slot", "ids", "vectors", "distances", "floors"])

        for batch in batches:
            slots = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(slots)] if len(slots) else []
            for s, e in zip(cuts, cuts[1:]):
                part = batch.slice(s, e - s)
                if held and (slots[s] != slot or sum(len(h[0]) for h in held) >= block):
                    yield out()
                    held = []
                slot = int(slots[s])
                held.append((part.column(1).to_numpy(zero_copy_only=False).astype(np.int64), part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1), part.column(3).to_numpy(zero_copy_only=False).astype(np.int64)))
        if held:
            yield out()

    return rows.select("slot", "vec_id", "v", "floor").mapInArrow(pack, PACKED)


def search_block(q_ids, q, q_dist, floors, ids, x, dist, k: int, first_only: bool, best: list | None = None):
    """For each query of a block: (query ids, ids, scores, candidates scored) of its best candidates in one block of rows and in those before it,
    whose (scores, ids, scored) a query are in `best`, which goes on to the next block."""
    best = unmet(q_ids) if best is None else best
    xf, qf = x.astype(float), q.astype(float)
    norm, q_norm = (xf * xf).sum(1), (qf * qf).sum(1)
    whole = np.abs(xf).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1] >= EXACT
    off, q_off = rounding(norm, dist, x.shape[1]), rounding(q_norm, q_dist, q.shape[1])
    by_pivot = np.ascontiguousarray(dist.T, float)
    gap = np.empty_like(by_pivot)
    for i in range(len(q_ids)):
        np.abs(np.subtract(by_pivot, q_dist[i][:, None], out=gap), out=gap)
        bound = np.maximum(gap.max(0, initial=0) - off - q_off[i], 0)
        upper = (norm + q_norm[i] - bound * bound) / 2 + 2 * (x.shape[1] + 8) * EPS * (norm + q_norm[i])
        upper[ids == q_ids[i]] = -np.inf
        best_s, best_i, scored = best[i]
        low = max(floors[i], best_s[-1]) if len(best_s) >= k else floors[i]
        if first_only and len(upper) > FIRST:
            order = np.argpartition(-upper, FIRST)[:FIRST]
        else:
            order = np.flatnonzero(upper >= low)
            order = order[np.argsort(-upper[order])]
        start, size = 0, CHUNK
        while start < len(order):
            at = order[start : start + size]
            at = at[upper[at] >= low]
            if not len(at):
                break
            s = x[at] @ q[i] if whole else (xf.take(at, 0) @ qf[i]).astype(np.int64)
            scored += len(at)
            near = s >= low
            if near.any():
                best_s, best_i = np.concatenate([best_s, s[near]]), np.concatenate([best_i, ids[at[near]]])
                top = np.lexsort((best_i, -best_s))[:k]
                best_s, best_i = best_s[top], best_i[top]
                low = max(low, best_s[-1]) if len(best_s) >= k else low
            start, size = start + size, 2 * size
        best[i] = best_s, best_i, scored
        yield np.full(len(best_s), q_ids[i]), best_i, best_s, np.full(len(best_s), scored)


def unmet(q_ids) -> list:
    """The best of queries that have met no row."""
    return [(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)] * len(q_ids)


def search(blocks: DataFrame, asked: DataFrame, cells: int, k: int, first_only: bool) -> DataFrame:
    """Blocks of rows and of queries, each with its cell -> query_id, vec_id, score, scored (by the cell, for the query)."""
    kind = {"ids": np.int64, "vectors": np.int64, "distances": np.float64, "floors": np.int64}
    side = lambda of, n: of.select("cell", F.lit(n).alias("side"), *kind)
    met = side(asked, 0).unionByName(side(blocks, 1)).repartitionById(cells, "cell").sortWithinPartitions("cell", "side")

    def run(batches):
        cell, held = None, []  # a cell's blocks of queries with their best so far

        def out():
            found = [(np.full(len(s), q), i, s, np.full(len(s), scored)) for (q_ids, *_), best in held for q, (s, i, scored) in zip(q_ids, best)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "vec_id", "score", "scored"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["cell"] != cell:
                    yield from out()
                    cell, held = r["cell"], []
                ids, x, dist, floors = (np.frombuffer(r[n], t) for n, t in kind.items())
                x, dist = x.reshape(len(ids), -1), dist.reshape(len(ids), -1)
                if r["side"] == 0:
                    held.append(((ids, x, dist, floors), unmet(ids)))
                else:
                    for queries, best in held:
                        for _ in search_block(*queries, ids, x, dist, k, first_only, best):
                            pass
        yield from out()

    return met.mapInArrow(run, "query_id long, vec_id long, score long, scored long")


def best_of(near: DataFrame, k: int) -> DataFrame:
    """query_id, best: its k highest scores (s: negated score, vec_id), cut to k in STAGE parts first, so no more than STAGE * k rows of a query meet."""
    first = lambda c: F.slice(F.sort_array(c), 1, k)
    parts = near.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(STAGE)).alias("part")).agg(first(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id")))).alias("best"))
    return parts.groupBy("query_id").agg(first(F.flatten(F.collect_list("best"))).alias("best"))


def top_k(rows: DataFrame, is_query, k: int) -> DataFrame:
    """rows(vec_id, v) -> query_id, rank, vec_id, score."""
    width = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("count"), F.count_if(is_query(F.col("vec_id"))).alias("asked")).orderBy(F.desc("count"), "w").first()
    rows = rows.where(F.size("v") == (width["w"] if width else 0))
    pivots = choose_pivots(rows)
    pivots = pivots if len(pivots) else np.zeros((1, 1))
    slots = max(1, -(-(width["count"] if width else 0) // BLOCK))  # a block of rows each
    parts = min(slots, PARTS * rows.sparkSession.sparkContext.defaultParallelism)
    groups = max(1, -(-(width["asked"] if width else 0) // max(QUERY_BLOCK, QUERY_BYTES // (8 * (width["w"] + PIVOTS) if width else 1))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lowest = F.lit(LOWEST)
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(slots)).cast("int").alias("slot"), "vec_id", "v", lowest.alias("floor"))
    blocks = durable(packed(dealt.repartition(slots, "slot").sortWithinPartitions("slot"), pivots, BLOCK)).withColumn("group", every(groups))
    blocks = blocks.withColumn("cell", F.col("slot") % parts * groups + F.col("group"))
    queries = rows.where(is_query(F.col("vec_id")))

    def asked(floors: DataFrame | None) -> DataFrame:
        """Packed queries, a copy for each part of the rows."""
        own = queries.withColumn("floor", lowest) if floors is None else queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", lowest))
        own = own.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("slot"), "vec_id", "v", "floor").dropDuplicates(["vec_id", "v"])
        once = durable(packed(own.repartition(groups, "slot").sortWithinPartitions("slot"), pivots, QUERY_BLOCK))
        return once.withColumn("part", every(parts)).withColumn("cell", F.col("part") * groups + F.col("slot"))

    cells = parts * groups
    first = best_of(search(blocks, asked(None), cells, k, True), k)
    floors = first.where(F.size("best") >= k).select(F.col("query_id").alias("vec_id"), (-F.col("best")[k - 1]["s"]).alias("floor"))
    best = best_of(search(blocks, asked(durable(floors)), cells, k, False), k)
    return best.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def op5_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark, 2048)
    rows = durable(usable(table(spark, sf_dir, "embeddings")))
    return top_k(rows, lambda c: F.pmod(c, F.lit(100)) == 0, 10)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
       FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
