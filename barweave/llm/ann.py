"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are dealt to lists around centroids; a query probes the lists nearest to it. In a
list the vectors are rotated at random and kept in blocks of columns, so that the squared
distance over the first columns, scaled up, estimates the whole one. After each block a
hypothesis test drops the candidates whose estimate is too far beyond the query's tenth
best so far; only the rest read the next block. What survives is measured on the original
vectors in double precision.

How many lists to probe is measured, not guessed: a bounded sample of queries is searched
by brute force over all rows, and the share of lists is the least that finds ``recall`` of
their true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.common import stored

VECTOR = "vec_id long, vec array<double>"
LIST_ROWS = 1000  # rows aimed at per list
MOST_LISTS = 4096
FIT_ROWS = 20_000  # the centroids are fitted on about so many rows
TRIED_QUERIES = 64  # searched by brute force to set the number of probes
BLOCK_ROWS = 512  # rows of a list that one task holds at once
QUERY_ROWS = 2048  # queries of a list that one task holds at once
COLUMNS = 8  # columns of a block
EPSILON = 2.1  # width of the test; a true neighbour is dropped about once in a thousand


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that can be compared.

    Out stay null ids, vectors that are null, empty, zero or hold null or non-finite
    components, and those of another length than the commonest (ties: the longest).
    """
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
        .where("vec_id IS NOT NULL AND vec IS NOT NULL")
        .where(finite & F.exists("vec", lambda x: x != 0))
    )
    sizes = v.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return v.where(F.size("vec") == (sizes["dim"] if sizes else 0))


def matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 1)


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def centroids(sample: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's means of the distinct rows of a bounded sample."""
    points = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    means = points[np.sort(rng.choice(len(points), min(k, len(points)), replace=False))]
    for _ in range(rounds):
        near = np.concatenate([squared(points[i : i + 4096], means).argmin(1) for i in range(0, len(points), 4096)])
        counts = np.bincount(near, minlength=len(means))
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(points[order], np.minimum(np.cumsum(counts) - counts, len(points) - 1), axis=0)
        means = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], means)
    return means


def exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - q) ** 2).sum(1))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores, ties to the smaller id."""
    return np.lexsort((ids, scores))[:k]


def distinct(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In the order of ids, repeated rows once."""
    order = np.lexsort((*rows.T, ids))
    ids, rows = ids[order], rows[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]).any(1))
    return ids[new], rows[new]


def scan(
    q: np.ndarray, q_turned: np.ndarray, ids: np.ndarray, rows: np.ndarray, columns: list[np.ndarray], own: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of one block to one query: ids and distances.

    ``columns`` holds the rotated rows in blocks of columns. The first rows are measured
    in full and give the limit; the others are tested block by block.
    """
    dim = rows.shape[1]
    first = min(len(ids), 4 * k + 1)
    start = np.flatnonzero(ids[:first] != own)
    found, far = ids[start], exact(q, rows[start])
    limit = np.partition(far, k - 1)[k - 1] if len(far) >= k else np.inf
    alive = first + np.flatnonzero(ids[first:] != own)
    partial, seen = np.zeros(len(alive)), 0
    for block in columns:
        if not len(alive):
            break
        width = block.shape[0]
        partial = partial + ((block[:, alive] - q_turned[seen : seen + width, None]) ** 2).sum(0)
        seen += width
        if seen < dim:
            factor = seen / dim * (1 + EPSILON / np.sqrt(seen)) ** 2
            keep = partial <= limit * limit * factor
            alive, partial = alive[keep], partial[keep]
    # The last test is on the whole distance; a hair's breadth is left for rounding.
    alive = alive[partial <= limit * limit * (1 + 1e-9) + 1e-12] if np.isfinite(limit) else alive
    found, far = np.concatenate([found, ids[alive]]), np.concatenate([far, exact(q, rows[alive])])
    top = best(found, far, k)
    return found[top], far[top]


def _nearest_all(queries: pd.DataFrame, k: int):
    """Brute force of a bounded query set over one task's rows."""
    q_ids, q = queries["vec_id"].to_numpy(), np.stack(queries["vec"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)) for _ in q_ids]
        for batch in filter(len, batches):
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("list").to_numpy()
            far = np.sqrt(squared(q, matrix(batch.column("vec"))))
            for i, own in enumerate(q_ids):
                near = np.argpartition(far[i], min(k + 1, len(ids) - 1))[: k + 2]
                near = near[ids[near] != own]
                merged = [np.concatenate(x) for x in zip(held[i], (ids[near], far[i][near], lists[near]))]
                top = best(merged[0], merged[1], k)
                held[i] = tuple(x[top] for x in merged)
        yield pa.RecordBatch.from_pydict(
            {
                "query_id": pa.array(np.repeat(q_ids, [len(h[0]) for h in held]), pa.int64()),
                "list": pa.array(np.concatenate([h[2] for h in held]), pa.int32()),
                "vec_id": pa.array(np.concatenate([h[0] for h in held]), pa.int64()),
                "far": pa.array(np.concatenate([h[1] for h in held]), pa.float64()),
            }
        )

    return run


def search(
    vectors: DataFrame,
    is_query: str = "vec_id % 100 = 0",
    k: int = 10,
    recall: float = 0.97,
    seed: int = 7,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query row.

    Candidates are all other rows; the query's own id is never its neighbour. Repeated rows
    count once; an id with several vectors has the distance of its nearest one. Fewer than k candidates: all of them. Vectors that
    :func:`usable` leaves out neither ask nor answer; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    n = rows.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return spark.createDataFrame([], empty)
    share = min(1.0, FIT_ROWS / n)
    fit = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = matrix(fit.select("vec").toArrow().column("vec"))
    dim = sample.shape[1] if len(sample) else rows.select(F.size("vec")).first()[0]
    k_lists = int(min(max(1, n // LIST_ROWS), MOST_LISTS))
    means = centroids(sample, k_lists, seed) if len(sample) else np.zeros((1, dim))
    turn = rotation(dim, seed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = squared(matrix(batch.column("vec")), means).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=["vec_id", "vec", "list"])

    index = stored(rows.mapInArrow(deal, VECTOR + ", list int"), "vector-lists")
    counts = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}  # <= MOST_LISTS
    held = np.array([counts.get(i, 0) for i in range(len(means))])
    asked = index.where(is_query)

    # The share of lists that finds enough, from brute force for a bounded sample of queries.
    n_asked = asked.count()
    if n_asked == 0:
        return spark.createDataFrame([], empty)
    part = int(min(1.0, TRIED_QUERIES / n_asked) * 1_000_000) + 1
    tried = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.lit(1_000_000)) < part).toPandas()
    probes = 1
    if len(means) > 1:
        tried = tried if len(tried) else asked.limit(1).toPandas()
        first = Window.partitionBy("query_id").orderBy("far", "vec_id")
        truth = (
            index.mapInArrow(_nearest_all(tried, k), "query_id long, list int, vec_id long, far double")
            .withColumn("r", F.row_number().over(first))
            .where(F.col("r") <= k)
            .toPandas()
        )
        ranks = np.argsort(np.argsort(squared(np.stack(tried["vec"].to_numpy()), means), axis=1), axis=1)
        place = {int(i): p for i, p in zip(tried["vec_id"], ranks)}
        needed = np.sort([place[int(i)][j] for i, j in zip(truth["query_id"], truth["list"])])
        probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else 1

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(squared(matrix(batch.column("vec")), means), axis=1, kind="stable")
            # At least ``probes`` lists, and more where those hold too few candidates.
            enough = (np.cumsum(held[order], axis=1) >= 4 * k + 1).argmax(1) + 1
            enough[np.cumsum(held[order], axis=1)[:, -1] < 4 * k + 1] = len(means)
            wide = np.maximum(enough, probes)
            chosen = np.concatenate([o[:w] for o, w in zip(order, wide)]).astype(np.int32)
            again = np.repeat(np.arange(batch.num_rows), wide)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(again)), batch.column(1).take(pa.array(again)), pa.array(chosen)],
                names=["vec_id", "vec", "list"],
            )

    # Hot lists are dealt to several tasks on both sides: rows in blocks, queries in parts.
    sizes = [(i, max(1, -(-int(c) // BLOCK_ROWS))) for i, c in enumerate(held)]
    many = [F.broadcast(spark.createDataFrame(sizes, "list int, blocks int")) for _ in range(2)]  # MOST_LISTS rows at most
    parts = max(1, -(-n_asked // QUERY_ROWS))
    sent = (
        asked.select("vec_id", "vec")
        .mapInArrow(probe, VECTOR + ", list int")
        .join(many[0], "list")
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    placed = (
        index.join(many[1], "list")
        .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    )
    key = ["list", "block", "part"]

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, rows = left.column("vec_id").to_numpy(), matrix(left.column("vec"))
        q_ids, qs = right.column("vec_id").to_numpy(), matrix(right.column("vec"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(ids) and len(q_ids):
            ids, rows = distinct(ids, rows)
            q_ids, qs = distinct(q_ids, qs)
            turned = np.ascontiguousarray((rows @ turn).T)
            columns = [turned[i : i + COLUMNS] for i in range(0, dim, COLUMNS)]
            q_turned = qs @ turn
            for own, q, q_t in zip(q_ids, qs, q_turned):
                got, far = scan(q, q_t, ids, rows, columns, own, k)
                out.append((np.full(len(got), own), got, far))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    hits = placed.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(near, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        hits.groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
