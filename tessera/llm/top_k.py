"""Operator 6: exact top-k search by inner product over an impact-ordered, score-at-a-time index.

Components become integers, and each is the sum of quantised impacts, powers of two. The index holds, for each block of
vectors, one posting segment for each impact: the signs of the entries that hold it, and how long the part of each vector
is that smaller impacts still add. It is built once and written to the shared folder. A block of queries processes the
segments by descending impact. What is then still open of a score is at most |query| x |open rest of the vector|, which
bounds every score from both sides; a query stops only when that proves all but a few vectors out, and these are rescored
exactly. The k-th best score of a block goes along as a bound to the next blocks that a task meets, where it can stop a
query after the first segments. Blocks have fixed sizes, so a task holds the same at any scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidied

#: Vectors in a block of the index, and queries in a block of queries, about.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 512

#: Times k: vectors that may be left to rescore when a query stops.
FEW = 4

#: Largest size of a quantised component; with it, sums over 2,048 components fit into 64 bits.
MOST = 1 << 26

Segment = tuple[int, np.ndarray, np.ndarray]


def segments(vectors: np.ndarray) -> Iterator[Segment]:
    """(impact, signs of the entries that hold it, norms of what is open afterwards) by descending impact."""
    size, sign = np.abs(vectors), np.sign(vectors).astype(np.int8)
    for bit in reversed(range(int(size.max(initial=0)).bit_length())):
        rest = (size & ((1 << bit) - 1)).astype(np.float64)
        yield 1 << bit, (size >> bit & 1).astype(np.int8) * sign, np.sqrt((rest * rest).sum(1))


def search(queries: np.ndarray, query_ids: np.ndarray, index: list[Segment], vectors: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's row, ids, scores) of what may be among the k best vectors for each query, its own id left out; ties go to smaller ids.

    `floor` has scores that k other vectors are known to reach, one a query; what is sure to be below may be missing.
    It is raised to the k-th best score of this block where that is more.
    """
    most = float(np.abs(queries).sum(1).max(initial=0)) * float(np.abs(vectors).max(initial=0))
    kind = np.float32 if most < 1 << 24 else np.float64  # sums of integers below these are exact
    eps = 0.0 if most < 1 << 53 else most * 2.0**-40
    q, norms = queries.astype(kind), np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    going = np.arange(len(q))
    scores = np.zeros((len(q), len(vectors)), kind)
    scores[query_ids[:, None] == ids[None, :]] = -np.inf

    def finish(row: int, may: np.ndarray):
        may = may[ids[may] != query_ids[row]]
        exact = vectors[may] @ queries[row]
        top = np.lexsort((ids[may], -exact))[:k]
        if len(top) == k:
            floor[row] = max(floor[row], float(exact[top[-1]]))
        return int(row), ids[may][top], exact[top]

    def edge(lower: np.ndarray, rows: np.ndarray) -> np.ndarray:
        own = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(rows), -np.inf)
        return np.maximum(own, floor[rows]) - eps

    for impact, signs, rest in index:
        scores[going] += q[going] @ (signs.astype(kind) * kind(impact)).T
        slack = norms[going, None] * rest[None, :] * (1 + 1e-6)
        may = scores[going] + slack >= edge(scores[going] - slack, going)[:, None]
        done = may.sum(1) <= FEW * k
        for row, m in zip(going[done], may[done], strict=True):
            yield finish(row, np.flatnonzero(m))
        going = going[~done]
        if not len(going):
            return
    for row in going:  # all is processed: more than a few tie, or there was no segment at all
        yield finish(row, np.flatnonzero(scores[row] >= edge(scores[None, row], going[going == row])[0]))


def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of distinct rows in order; shorter vectors are filled up with zeros."""
    lists = t["v"].combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), 1 + max(1, int(sizes.max(initial=0)))), np.int64)
    out[:, 0] = t["vec_id"].to_numpy()
    out[:, 1:][np.arange(out.shape[1] - 1) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.unique(out, axis=0)
    return out[:, 0], out[:, 1:]


INDEX = "block int, ids binary, rows binary, width int, impacts array<int>, signs array<binary>, open array<binary>"
QUERIES = "q_block int, q_ids binary, q_rows binary, q_width int"


def build_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """The posting segments of every block, with the vectors themselves for rescoring."""

    def pack(t: pa.Table) -> pa.Table:
        ids, rows = matrix(t)
        index = list(segments(rows))
        columns = [t["block"][:1].combine_chunks(), [ids.astype("<i8").tobytes()], [rows.astype("<i4").tobytes()], [rows.shape[1]], [[x[0] for x in index]], [[x[1].tobytes() for x in index]], [[x[2].astype("<f8").tobytes() for x in index]]]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])

    return in_blocks(vectors, "block", blocks).applyInArrow(pack, INDEX)


def pack_queries(vectors: DataFrame, blocks: int) -> DataFrame:
    def pack(t: pa.Table) -> pa.Table:
        ids, rows = matrix(t)
        return pa.table({"q_block": t["q_block"][:1], "q_ids": [ids.astype("<i8").tobytes()], "q_rows": [rows.astype("<i4").tobytes()], "q_width": pa.array([rows.shape[1]], pa.int32())})

    return in_blocks(vectors, "q_block", blocks).applyInArrow(pack, QUERIES)


def in_blocks(vectors: DataFrame, name: str, blocks: int):
    return vectors.withColumn(name, F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(blocks)).cast("int")).groupBy(name)


def quantised(embeddings: DataFrame, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * x) of vectors without null or non-finite components."""
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    infinite = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    too_large = F.raise_error(F.lit(f"a component is over {MOST} when scaled; lower the scale")).cast("long")
    return x.where(~infinite).select("vec_id", F.transform("x", lambda c: F.when(F.abs(c * scale) <= MOST, F.floor(c * scale)).otherwise(too_large)).alias("v"))


def top_k(embeddings: DataFrame, is_query, k: int, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors by integer inner product, ties to smaller vec_id.

    `is_query` is a condition on vec_id. Queries meet all vectors, block by block. Vectors that are null or hold null, NaN
    or infinite components take no part, nor do null vec_ids; an empty vector scores 0; of vectors of unequal length the
    shorter is filled up with zeros. Rows with one vec_id and equal vectors count as one; with different vectors each is a
    candidate and a query of its own, ranked apart, and none of them is a candidate for that vec_id. With fewer
    than k candidates all are returned. An empty table gives no rows. Components that are over 2**26 when scaled are an
    error, as scores could leave 64 bits. Other columns are left out.
    """
    vectors = quantised(embeddings, scale)
    queries = vectors.where(is_query)
    n, n_queries = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    n_blocks, n_query_blocks = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    index = cut(build_index(vectors, n_blocks), "index")
    asked = pack_queries(queries, n_query_blocks).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = asked.join(index, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, np.ndarray] = {}  # of the query blocks that this task has met
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                ids, q_ids = (np.frombuffer(get(c), "<i8") for c in ("ids", "q_ids"))
                v, q = (np.frombuffer(get(c), "<i4").reshape(len(own), -1).astype(np.int64) for c, own in (("rows", ids), ("q_rows", q_ids)))
                width = max(v.shape[1], q.shape[1])
                wide = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))  # noqa: B023, E731
                found_segments = [(p, wide(np.frombuffer(s, np.int8).reshape(len(ids), -1)), np.frombuffer(o, "<f8")) for p, s, o in zip(get("impacts"), get("signs"), get("open"), strict=True)]
                floor = floors.setdefault(get("q_block"), np.full(len(q_ids), -np.inf))
                found = list(search(wide(q), q_ids, found_segments, wide(v), ids, k, floor))
                if found:
                    copies = np.arange(len(q_ids)) - np.searchsorted(q_ids, q_ids)
                    sizes = [len(f[1]) for f in found]
                    rows = np.repeat([f[0] for f in found], sizes).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(copies[rows]), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], ["query_id", "copy", "vec_id", "score"])

    best = pairs.mapInArrow(tidied(run), "query_id long, copy long, vec_id long, score long")
    # Different vectors of one candidate id can tie in nothing but rank, so a rank is decided by score and id alone.
    order = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
