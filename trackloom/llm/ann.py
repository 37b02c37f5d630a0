"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are scaled to length one, put into lists around centroids, and rotated by a random orthogonal matrix, so that any
few coordinates stand for all. A query scans the lists with the nearest centroids. Within a list, coordinates are read in
column blocks; after each block a hypothesis test compares the distance estimated from the coordinates so far with the
query's fifth best, and a candidate that is surely (at `EPSILON`) farther is given up. Survivors are scored exactly, in
double precision on the original vectors, and the best of all lists are merged.

The number of lists grows as the root of the number of vectors, up to `MOST_LISTS`. The centroids are fitted on `SAMPLE`
vectors, or `SAMPLE_A_LIST` a list (a documented bound); every vector is indexed. A list wider than `BLOCK`, say of one
vector that a third of all rows repeat, is split into blocks that are scanned apart. With `exact` all lists are probed and
no candidate is given up before its last coordinate: the way for those whom the approximation does not suit.

Defined results
* null, zero or non-finite vectors, null components, null ids, and vectors of another length than most take no part.
* equal scores go to the smaller vec_id. Repeated rows of one vec_id are one query, and never their own neighbour.
* fewer candidates than asked for: all of them. Empty table: an empty result. Further columns do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

MOST_LISTS = 4096
SAMPLE = 8192
SAMPLE_A_LIST = 16
PROBE_SHARE = 0.62
LEAST_PROBES = 8
BLOCK = 2048
COLUMNS = 16
EPSILON = 1.5
PANEL = 512
SLACK = 1e-4
NEIGHBOURS = 5
SEED = 7


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part, and their length, the most frequent one (ties: the smaller)."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    ok = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(x), F.lit(True))) & F.exists("v", lambda x: x != 0)
    v = v.filter(ok)
    row = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "d").first()
    dim = row["d"] if row else 0
    return v.filter(F.size("v") == dim), dim


def _matrix(column, dim: int) -> np.ndarray:
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centroids(vectors: DataFrame, dim: int, lists: int, seed: int = SEED, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on the SAMPLE vectors, or SAMPLE_A_LIST a list, that come first by hash; at most `lists` centroids."""
    rows = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(max(SAMPLE, SAMPLE_A_LIST * lists)).select("v").toArrow()
    x = _unit(_matrix(rows.column(0), dim))
    start = np.unique(x, axis=0)
    start = start[np.random.default_rng(seed).permutation(len(start))[:lists]]
    centroids = start
    for _ in range(rounds):
        near = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centroids)
    return centroids


def _scan(q_ids, q, v_ids, v, rotation, k: int, epsilon: float = EPSILON):
    """(query id, vector id, exact cosine) of at least each query's k best of the vectors; v_ids in order."""
    dim = q.shape[1]
    qr, vr = (_unit(q) @ rotation).astype(np.float32), (_unit(v) @ rotation).astype(np.float32)
    q_len, v_len = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    best = np.full((len(q), k), np.inf, np.float32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(v), PANEL):
        panel = vr[at : at + PANEL]
        i, j, part = None, None, None
        for done in range(0, dim, COLUMNS):
            cols = slice(done, min(dim, done + COLUMNS))
            d = cols.stop
            if i is None:
                a, b = qr[:, cols], panel[:, cols]
                partial = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)
                partial[q_ids[:, None] == v_ids[None, at : at + PANEL]] = np.inf
            else:
                diff = qr[i, cols] - panel[j, cols]
                part = part + np.einsum("ij,ij->i", diff, diff)
            limit = best[:, -1] * (1 + epsilon / np.sqrt(d)) ** 2 * d / dim if d < dim else best[:, -1]
            if i is None:
                i, j = np.nonzero(np.isfinite(partial) & (partial <= limit[:, None] + SLACK))
                part = partial[i, j]
            else:
                alive = part <= limit[i] + SLACK
                i, j, part = i[alive], j[alive], part[alive]
        if not len(i):
            continue
        found.append((i, j + at, part))
        order = np.lexsort((part, i))
        i, part = i[order], part[order]
        first = np.searchsorted(i, np.arange(len(q)))
        for c in range(k):  # the c-th nearest of this panel joins each query's k best
            here = first + c
            ok = (here < len(i)) & (i[np.minimum(here, len(i) - 1)] == np.arange(len(q)))
            rows = np.flatnonzero(ok)
            merged = np.sort(np.concatenate([best[rows], part[here[rows]][:, None]], axis=1), axis=1)
            best[rows] = merged[:, :k]
    if not found:
        return q_ids[:0], v_ids[:0], np.zeros(0)
    i, j, part = map(np.concatenate, zip(*found))
    alive = part <= best[i, -1] + SLACK
    i, j = i[alive], j[alive]
    score = (q[i] * v[j]).sum(axis=1) / (q_len[i] * v_len[j])
    order = np.lexsort((v_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    top = place < k
    return q_ids[i[top]], v_ids[j[top]], score[top]


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, seed: int = SEED, probe_share: float = PROBE_SHARE, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row where `is_query` (a Column of `id`) holds.

    `probe_share` of the lists are probed; `exact` probes all and gives no candidate up early."""
    import pyarrow as pa

    spark = vectors.sparkSession
    rows, dim = usable(vectors, id_col, vector_col)
    rows = rows.dropDuplicates(["id", "v"])  # else copies take places among the k best of a list
    if not dim:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    total = rows.count()
    lists = max(1, min(MOST_LISTS, int(total**0.5)))
    centroids = fit_centroids(rows, dim, lists, seed)
    lists = len(centroids)
    probes = lists if exact else min(lists, max(int(np.ceil(probe_share * lists)), LEAST_PROBES))
    epsilon = np.inf if exact else EPSILON
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]
    sent = spark.sparkContext.broadcast((centroids, rotation))

    def assign(many: int):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    near = _unit(_matrix(batch.column(1), dim)) @ sent.value[0].T
                    pick = near.argmax(axis=1)[:, None] if many == 1 else np.argsort(-near, axis=1, kind="stable")[:, :many]
                    row = np.repeat(np.arange(batch.num_rows), many)
                    yield pa.RecordBatch.from_arrays([pa.array(pick.reshape(-1).astype(np.int32)), *(c.take(pa.array(row)) for c in batch.columns)], ["list", "id", "v"])

        return run

    kind = rows.schema["v"].dataType.simpleString()
    placed = rows.mapInArrow(assign(1), f"list int, id bigint, v {kind}")
    blocks = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))  # a row a list
    placed = placed.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).drop("blocks")
    asked = rows.filter(is_query).dropDuplicates(["id"]).mapInArrow(assign(probes), f"list int, id bigint, v {kind}")
    asked = asked.join(F.broadcast(blocks), "list").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [], [], []
        if left.num_rows and right.num_rows:
            q_ids, v_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            q, v = _matrix(left.column("v"), dim), _matrix(right.column("v"), dim)
            order = np.argsort(v_ids, kind="stable")
            v_ids, v = v_ids[order], v[order]
            for at in range(0, len(q), 256):
                for have, new in zip(out, _scan(q_ids[at : at + 256], q[at : at + 256], v_ids, v, sent.value[1], k, epsilon)):
                    have.append(new)
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    hits = asked.groupBy("list", "block").cogroup(placed.groupBy("list", "block")).applyInArrow(scan, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
