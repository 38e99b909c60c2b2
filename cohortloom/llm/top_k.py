"""Exact top-k inner products through distances to pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.plans.lineage import cut

PIVOTS, SAMPLE = 64, 2048
RING, CHUNK = 1024, 256
#: Rings that one task follows for a chunk of queries.
RINGS_IN_TURN = 64
#: Distances are doubles; bounds give way by this share of the largest norm.
SLACK = 1e-9
#: Score of a place that nothing has taken yet.
NONE = np.iinfo(np.int64).min // 4


def whole_numbers(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id`` and ``v`` = floor(scale * x) of every component, of vectors whose components are all finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(key).cast("long").alias("id"), scaled.cast("array<bigint>").alias("v")
    )


class Space:
    """Pivots in the space where nearest means largest inner product.

    A vector gets one more component, sqrt(limit - |v|^2) with the largest |v|^2 as ``limit``, a query gets
    0 there.  The squared distance is then |q|^2 + limit - 2 q.v: order by distance is
    order by inner product, and distances to pivots bound distances by the triangle inequality.
    """

    def __init__(self, sample: np.ndarray, ids: np.ndarray, width: int, limit: float, pivots: int):
        self.sample, self.ids, self.width, self.limit = sample, ids, width, limit
        self.pivots = self.lifted(sample[:pivots])

    def lifted(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.limit - (v * v).sum(axis=1), 0.0))
        return np.concatenate((v, last[:, None]), axis=1)

    def distances(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """To every pivot, one row per vector."""
        x = self.lifted(v, query)
        square = (x * x).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)[None, :] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(square, 0.0))

    def slack(self) -> float:
        return SLACK * (1.0 + self.limit)


def as_matrix(vectors, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors end with zeros."""
    rows = [np.asarray(v, np.float64) for v in vectors]
    if all(len(r) == width for r in rows):
        return np.stack(rows) if rows else np.zeros((0, width))
    return np.stack([np.pad(r, (0, width - len(r))) for r in rows])


def products(q: np.ndarray, v: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products: in doubles where these hold them exactly, else in 64-bit integers."""
    return (q @ v.T).astype(np.int64) if exact else q.astype(np.int64) @ v.astype(np.int64).T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest of each row, ties to the smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)



def top_k(rows: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for every id divisible by ``every``, the ``k`` largest integer inner products.

    Candidates are all rows of another id; equal scores go by the smaller id.  Vectors that are
    null or have a null or non-finite component take no part; shorter ones count as ended by
    zeros.  A query id that repeats is asked once, with its largest vector in array order.

    The index keys every vector by its nearest pivot and its distance to it.  Sorted by these, vectors
    fall into rings (annuli) of ``RING``, queries into chunks of ``CHUNK`` neighbours.  Pivots and
    first thresholds come from a sample of ``SAMPLE`` rows (a true k-th best of some rows is a
    bound for all).  A ring goes to a chunk only if a query's radius reaches it; a task then takes
    a chunk's rings nearest first, and passes over rings that the thresholds reached so far rule out.
    """
    vectors = cut(whole_numbers(rows, key, vector, scale))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, width, limit = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(square)).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not n or not width:
        return rows.sparkSession.createDataFrame([], out)
    exact = limit < 2**52
    stored = np.int16 if limit < 2**30 else np.int64
    sample = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).toPandas()
    space = Space(as_matrix(sample["v"], width), sample["id"].to_numpy(), width, limit, PIVOTS)

    def keyed(query: bool):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                far = space.distances(as_matrix(batch["v"], width), query)
                near = far.argmin(axis=1)
                yield batch.assign(pivot=near.astype(np.int32), far=far[np.arange(len(near)), near])

        return work

    def packed(size: int):
        """Neighbours of one pivot in rows of ``size``, each with its range of distances."""

        def spans(pivot: np.ndarray) -> list[tuple[int, int]]:
            cuts = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
            return [(i, min(b, i + size)) for a, b in zip(cuts, cuts[1:], strict=False) for i in range(a, b, size)]

        def row(group: pd.DataFrame, number: int) -> pd.DataFrame:
            far, held = group["far"], as_matrix(group["v"], width).astype(stored)
            return pd.DataFrame(
                {"block": [number], "pivot": [int(group["pivot"].iloc[0])], "low": [far.min()], "high": [far.max()],
                 "n": [len(group)], "ids": [group["id"].to_numpy(np.int64).tobytes()], "mat": [held.tobytes()]}
            )

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            number, rest = TaskContext.get().partitionId() << 32, None
            for batch in batches:
                rest = batch if rest is None else pd.concat((rest, batch), ignore_index=True)
                *full, (last, _) = spans(rest["pivot"].to_numpy()) or [(0, 0)]
                for a, b in full:
                    yield row(rest.iloc[a:b], number)
                    number += 1
                rest = rest.iloc[last:]
            if rest is not None and len(rest):
                yield row(rest, number)

        return work

    shape = "block long, pivot int, low double, high double, n int, ids binary, mat binary"
    key_shape = "id long, v array<bigint>, pivot int, far double"

    def arranged(df: DataFrame, query: bool, size: int) -> DataFrame:
        sorted_rows = df.mapInPandas(keyed(query), key_shape).repartitionByRange("pivot", "far", "id").sortWithinPartitions("pivot", "far", "id")
        return cut(sorted_rows.mapInPandas(packed(size), shape))

    rings = arranged(vectors, False, RING)
    asked = vectors.where(F.col("id") % every == 0).groupBy("id").agg(F.max("v").alias("v"))
    chunks = arranged(asked, True, CHUNK)

    def unpack(n: int, ids: bytes, mat: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, np.int64), np.frombuffer(mat, stored).reshape(n, width).astype(np.float64)

    def radius(q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """How far a candidate of at least the floor's score can be."""
        return np.sqrt(np.maximum((q * q).sum(axis=1) + space.limit - 2.0 * floor, 0.0)) + math.sqrt(space.slack())

    def first_floor(q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        scores = products(q, space.sample, exact)
        scores[ids[:, None] == space.ids[None, :]] = NONE
        return np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), NONE)

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For every chunk and pivot, the distances at which a ring can hold an answer."""
        for batch in batches:
            for block, n, ids, mat in batch[["block", "n", "ids", "mat"]].itertuples(index=False):
                qid, q = unpack(n, ids, mat)
                far, r = space.distances(q, True), radius(q, first_floor(q, qid))[:, None]
                yield pd.DataFrame({"chunk": block, "pivot": np.arange(far.shape[1], dtype=np.int32), "from": (far - r).min(axis=0), "to": (far + r).max(axis=0), "near": far.min(axis=0)})

    ranges = chunks.select("block", "n", "ids", "mat").mapInPandas(reach, "chunk long, pivot int, from double, to double, near double")
    turns = max(1, math.ceil(n / RING / RINGS_IN_TURN))
    visits = (
        rings.join(ranges, "pivot").where((F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from")))
        .select("chunk", F.pmod(F.xxhash64("block"), F.lit(turns)).cast("int").alias("turn"), "block", "pivot", "low", "high", "n", "ids", "mat",
                F.greatest(F.col("low") - F.col("near"), F.col("near") - F.col("high"), F.lit(0.0)).alias("gap"))
    )
    questions = chunks.select(F.col("block").alias("chunk"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"))
    met = visits.join(questions, "chunk").repartition("chunk", "turn").sortWithinPartitions("chunk", "turn", "gap", "block")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None

        def result() -> pd.DataFrame:
            qid, scores, ids = state["qid"], state["scores"], state["ids"]
            real = scores > NONE
            return pd.DataFrame({"query_id": np.repeat(qid, real.sum(axis=1)), "vec_id": ids[real], "score": scores[real]})

        for batch in batches:
            for v in batch.itertuples(index=False):
                if (v.chunk, v.turn) != at:
                    if state is not None:
                        yield result()
                    at = (v.chunk, v.turn)
                    qid, q = unpack(v.q_n, v.q_ids, v.q_mat)
                    state = {"qid": qid, "q": q, "far": space.distances(q, True), "floor": first_floor(q, qid),
                             "scores": np.full((len(q), k), NONE), "ids": np.full((len(q), k), np.iinfo(np.int64).max)}
                far, r = state["far"][:, v.pivot], radius(state["q"], state["floor"])
                reached = np.flatnonzero((far - r <= v.high) & (far + r >= v.low))
                if not reached.size:
                    continue
                ids, mat = unpack(v.n, v.ids, v.mat)
                scores = products(state["q"][reached], mat, exact)
                scores[state["qid"][reached][:, None] == ids[None, :]] = NONE
                better = (scores >= state["floor"][reached][:, None]) & (scores > NONE)
                some = np.flatnonzero(better.any(axis=1))
                if not some.size:
                    continue
                who = reached[some]
                both = np.concatenate((state["scores"][who], np.where(better[some], scores[some], NONE)), axis=1)
                names = np.concatenate((state["ids"][who], np.broadcast_to(ids, (len(who), len(ids)))), axis=1)
                state["scores"][who], state["ids"][who] = best(both, names, k)
                state["floor"][who] = np.maximum(state["floor"][who], state["scores"][who][:, -1])
        if state is not None:
            yield result()

    found = met.mapInPandas(answer, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
