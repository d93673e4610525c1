"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled and given one more component so that the largest inner
product becomes the smallest distance. A table hashes a vector by K Gaussian
projections cut into cells of width W. A query visits the buckets of each table
in the order of the estimated chance that a neighbour at distance R lies there,
until those chances add up to ``SUCCESS`` and the buckets hold as many vectors as
are asked for; R is the query's own, from a bounded sample of the vectors. What
the tables yield is merged and ranked by exact inner products in double
precision.

Equal vectors are searched once: of each distinct vector the ``k + 1`` smallest
ids are all that a result can show. Projections beyond ``EDGE`` cells share the
outermost cell, so a table has (2 * EDGE) ** K buckets at most. K grows with the
number of vectors, so that buckets stay small (``BUCKET``), up to ``MOST_K``: the
table of bucket sizes, which the driver holds, has a fixed bound. A bucket with
many vectors is spread over several shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mobilome_spark.llm.common import materialize

#: Tables, fewest and most projections of each, cell width (a unit vector's projection has deviation 1), cells to either side.
TABLES, K, MOST_K, WIDTH, EDGE = 2, 4, 6, 1.4, 3
#: Vectors that a bucket should have at most, on average over all that there may be.
BUCKET = 160
#: Chance to reach for one table; two tables miss only what both miss.
SUCCESS = 0.84
#: Vectors, about, of the sample that neighbour distances are taken from.
SAMPLE = 20_000
#: Distinct vectors of a shard, queries of a block.
SHARD, BLOCK = 8192, 50_000


def projections(n: int) -> int:
    """Projections of a table for ``n`` vectors."""
    k = K
    while k < MOST_K and n > BUCKET * (2 * EDGE) ** k:
        k += 1
    return k


class Hashing:
    """The tables' projections for vectors of one length; the same for the same length."""

    def __init__(self, dim: int, tables: int = TABLES, k: int = K, width: float = WIDTH):
        rng = np.random.default_rng([dim, tables, k])
        self.a = rng.standard_normal((tables, dim + 1, k))
        self.b = rng.uniform(0, width, (tables, k))
        self.tables, self.k, self.width, self.cells = tables, k, width, 2 * EDGE

    def project(self, x: np.ndarray) -> np.ndarray:
        """(tables, n, k) projections of augmented unit vectors."""
        return np.einsum("nd,tdk->tnk", x, self.a) + self.b[:, None, :]

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(tables, n) bucket numbers."""
        cell = np.clip(np.floor(self.project(x) / self.width).astype(int) + EDGE, 0, self.cells - 1)
        return cell @ (self.cells ** np.arange(self.k))

    def chances(self, x: np.ndarray, table: int, reach: np.ndarray) -> np.ndarray:
        """(n, buckets): chance that a point at distance ``reach`` (one for each row) of x lies in a bucket."""
        p = self.project(x)[table]
        edges = np.concatenate([[-np.inf], (np.arange(1, self.cells) - EDGE) * self.width, [np.inf]])
        below = _normal((edges - p[:, :, None]) / reach[:, None, None])
        each = np.diff(below, axis=2)
        out = np.ones((len(x), 1))
        for i in range(self.k):  # bucket = sum of cell_i * cells ** i, so later projections vary slower
            out = (each[:, i, :, None] * out[:, None, :]).reshape(len(x), -1)
        return out


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(np.clip(z, -40, 40)))
    tail = np.exp(-np.clip(z, -40, 40) ** 2 / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, 1 - tail, tail)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _augment(x: np.ndarray, longest: float) -> np.ndarray:
    y = x / longest
    return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y**2).sum(axis=1, keepdims=True)))])


def _as_query(x: np.ndarray) -> np.ndarray:
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.hstack([y, np.zeros((len(x), 1))])


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not null, not zero and has finite components only."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select("vec_id", "embedding")


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """(cid, embedding, ids): each distinct vector with its smallest ``ids`` vec_ids."""
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.distinct().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= ids)
    return few.groupBy("embedding").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _search_dim(classes: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """(qid, cid, score): for each query the best ``k`` classes found, of one vector length."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    total = classes.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).first()
    n, longest = total["n"], total["m"]
    hashing = Hashing(dim, k=projections(n))
    sampled = F.pmod(F.xxhash64("cid"), F.lit(max(1, -(-n // SAMPLE)))) == 0
    known = _matrix(classes.filter(sampled).select("embedding").limit(2 * SAMPLE).toArrow().column("embedding"))
    known = known.astype(np.float32)  # goes to the tasks

    def reaches(x: np.ndarray) -> np.ndarray:
        """The distance of each query that holds its k + 1 nearest of the sample, so no fewer of all vectors."""
        if len(known) <= k:
            return np.full(len(x), 2.0)
        near = -np.partition(-(x.astype(np.float32) @ known.T), k, axis=1)[:, k]
        return np.maximum(1e-3, np.sqrt(np.maximum(0, 2 - 2 * near / (np.linalg.norm(x, axis=1) * longest))))

    each = max(1, -(-n // SHARD))
    shards = TABLES * each  # a shard is of one table, so it holds a vector once

    def cells(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            found = hashing.buckets(_augment(x, longest))
            for t in range(TABLES):
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.full(len(x), t)), pa.array(found[t])], ["cid", "embedding", "t", "bucket"])

    kind = classes.schema["embedding"].dataType.simpleString()
    placed = materialize(classes.select("cid", "embedding").mapInArrow(cells, f"cid bigint, embedding {kind}, t bigint, bucket bigint"), "ann-table")
    sizes = {(r.t, r.bucket): r["count"] for r in placed.groupBy("t", "bucket").count().collect()}  # a bounded number of buckets
    parts = {key: max(1, -(-c // (SHARD // 2))) for key, c in sizes.items()}
    width = hashing.cells**hashing.k
    split = np.ones(TABLES * width, np.int64)
    for (t, b), p in parts.items():
        split[t * width + b] = p
    held_by = np.zeros((TABLES, width), np.int64)
    for (t, b), c in sizes.items():
        held_by[t, b] = c
    step = max(16, 512 * 6**K // width)
    blocks = max(1, -(-queries.count() // BLOCK))

    def shard_of(key, salt):
        with np.errstate(over="ignore"):
            h = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (salt.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % each + key // width * each

    def route(batches):
        for batch in batches:
            cid, t, bucket = (batch.column(i).to_numpy() for i in (0, 2, 3))
            key = t * width + bucket
            to = shard_of(key, np.abs(cid) % split[key])
            for block in range(blocks):
                yield pa.record_batch([pa.array(to * blocks + block), batch.column(0), batch.column(1), pa.array(key)], ["cell", "cid", "embedding", "key"])

    reached = [[] for _ in range(shards)]
    for t, b in sizes:
        for shard in np.unique(shard_of(np.full(split[t * width + b], t * width + b), np.arange(split[t * width + b]))):
            reached[shard].append(t * width + b)
    reached = [np.array(sorted(r), np.int64) for r in reached]

    def probe(batches):
        for batch in batches:
            for first in range(0, len(batch), step):
                part = batch.slice(first, step)
                qid, x = part.column(0).to_numpy(), _matrix(part.column(1))
                q, reach, visit = _as_query(x), reaches(x), np.zeros((len(x), TABLES * width), bool)
                for t in range(TABLES):
                    chance = np.where(held_by[t] > 0, hashing.chances(q, t, reach), -1.0)
                    order = np.argsort(-chance, axis=1, kind="stable")
                    each_ = np.take_along_axis(chance, order, axis=1)
                    sure = np.cumsum(np.maximum(0, each_), axis=1)
                    want = np.minimum(SUCCESS, sure[:, -1:] - 1e-12)  # empty buckets hold no neighbours
                    many = np.cumsum(held_by[t][order], axis=1) - held_by[t][order]
                    need = ((sure - np.maximum(0, each_) < want) | (many < k)) & (each_ >= 0)
                    rows = np.zeros_like(need)
                    np.put_along_axis(rows, order, need, axis=1)
                    visit[:, t * width : (t + 1) * width] = rows
                for shard in range(shards):
                    mine = visit[:, reached[shard]]
                    goes = np.flatnonzero(mine.any(axis=1))
                    if len(goes):
                        marks = [np.packbits(m).tobytes() for m in mine[goes]]
                        cell = shard * blocks + np.abs(qid[goes]) // 20 % blocks
                        yield pa.record_batch([pa.array(cell), part.column(0).take(pa.array(goes)), part.column(1).take(pa.array(goes)), pa.array(marks, pa.binary())], ["cell", "qid", "embedding", "marks"])

    def search(held: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("qid", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())])
        if not len(held) or not len(asked):
            return schema.empty_table()
        buckets = reached[asked.column("cell")[0].as_py() // blocks]
        cid, key, v = held.column("cid").to_numpy(), held.column("key").to_numpy(), _matrix(held.column("embedding"))
        order = np.lexsort((cid, key))
        cid, key, v = cid[order], key[order], v[order]
        out = []
        for first in range(0, len(asked), 1024):
            part = asked.slice(first, 1024)
            qid, q = part.column("qid").to_numpy(), _matrix(part.column("embedding"))
            marks = np.unpackbits(np.frombuffer(b"".join(part.column("marks").to_pylist()), np.uint8).reshape(len(part), -1), axis=1)[:, : len(buckets)].astype(bool)
            best_s, best_c = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
            for i, bucket in enumerate(buckets):
                a, b = np.searchsorted(key, [bucket, bucket + 1])
                rows = np.flatnonzero(marks[:, i])
                if a == b or not len(rows):
                    continue
                s = np.hstack([best_s[rows], q[rows] @ v[a:b].T])
                c = np.hstack([best_c[rows], np.broadcast_to(cid[a:b], (len(rows), b - a))])
                if s.shape[1] > 4 * k:  # ties at the edge are kept until ids settle them
                    edge = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                    s = np.where(s >= edge, s, -np.inf)
                top = np.lexsort((c, -s), axis=1)[:, :k]
                best_s[rows], best_c[rows] = np.take_along_axis(s, top, axis=1), np.take_along_axis(c, top, axis=1)
            r, j = np.nonzero(best_s > -np.inf)
            out.append(pa.table([pa.array(qid[r]), pa.array(best_c[r, j]), pa.array(best_s[r, j])], schema=schema))
        return pa.concat_tables(out)

    table = placed.mapInArrow(route, f"cell bigint, cid bigint, embedding {kind}, key bigint").groupBy("cell")
    probes = queries.select("qid", "embedding").mapInArrow(probe, f"cell bigint, qid bigint, embedding {kind}, marks binary").groupBy("cell")
    return table.cogroup(probes).applyInArrow(search, "qid bigint, cid bigint, score double")


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row whose
    vec_id is divisible by ``every``, among all other rows.

    Nearness is the largest inner product, ties go to the smaller vec_id. Rows
    whose vector is null, empty, zero or holds null or non-finite components
    take no part, nor do rows without a vec_id; vectors of different lengths
    never meet. A repeated row counts once. With fewer candidates than ``k`` all
    those found are returned; an empty table gives no rows.
    """
    rows = materialize(usable(vectors), "ann-rows")
    classes = materialize(distinct_vectors(rows, k + 1).withColumn("dim", F.size("embedding")), "ann-distinct")
    asking = rows.filter(F.col("vec_id") % every == 0).distinct().join(classes.select("embedding", "cid"), "embedding")
    asking = materialize(asking.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid")), "ann-queries")
    queries = classes.join(asking.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi").withColumnRenamed("cid", "qid")
    found = None
    for row in classes.groupBy("dim").count().orderBy("dim").collect():
        one = _search_dim(classes.filter(F.col("dim") == row["dim"]), queries.filter(F.col("dim") == row["dim"]), row["dim"], k + 1)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    top = found.groupBy("qid", "cid").agg(F.max("score").alias("score")).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1)
    each = top.join(classes.select("cid", "ids"), "cid").select("qid", (-F.col("score")).alias("_s"), F.explode("ids").alias("vec_id"))
    listed = each.groupBy("qid").agg(F.slice(F.sort_array(F.collect_list(F.struct("_s", "vec_id"))), 1, k + 1).alias("_list"))
    shown = asking.join(listed, "qid").select("query_id", F.slice(F.filter("_list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("_list"))
    return shown.select("query_id", F.posexplode("_list").alias("_p", "_x")).select(
        F.col("query_id").cast("bigint"), (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.vec_id").cast("bigint").alias("vec_id"), (-F.col("_x._s")).alias("score")
    )
