"""Most similar vectors for every vector (problem 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.buckets import compared, fitted, of_heavy
from winnow.llm.forest import ForestConfig
from winnow.llm.kernels import neighbours, ranked
from winnow.llm.packs import mix, packed, regroup, unit, unpack_all

#: For neighbours of at least about 0.82, and for neighbours of any similarity, which may be farther away: 1.0 is the
#: distance at a cosine of 0.5.  Recall against trees, leaf size and similarity is in the README.
ALIKE = ForestConfig(step=0.4)
ANY = ForestConfig(step=1.0, miss=0.03)
#: Ids of one task that merges the lists of several leaves.
MERGE_IDS = 50_000
LISTS = [(np.int64, 0), (np.int64, 0), (np.int32, 0)]


def most_similar(
    df: DataFrame,
    k: int = 5,
    floor: float = -1.0,
    config: ForestConfig = ANY,
    ids: str = "id",
    vectors: str = "embedding",
) -> DataFrame:
    """The ``k`` most similar vectors of every usable vector: (id, rank, neighbor_id, similarity).

    Similarity is the cosine in double precision, rounded to six decimals for ranking and output; ties
    go to the smaller id.  Neighbours below ``floor`` (compared before rounding) are left out.

    Method: a forest of random-projection trees, whose leaves each vector pops from one queue over all trees
    until the chance that they lack a neighbour is at most ``config.miss``, then exact ranking of the candidates
    (see :mod:`winnow.llm.forest`).  Two shuffles: the vectors to their leaves, and the short lists of the
    leaves to the ids.  Neighbours that share no leaf are missed; a smaller ``miss`` lowers their number.

    Defined cases: an unusable vector (null, other length, null or not finite component, all zero) is
    no row and no neighbour; rows of one id count once; an empty table gives an empty result; copies of
    a vector are neighbours with similarity 1; other columns are ignored, whatever their names.
    """
    index = fitted(df, config, ids, vectors, k + 1)
    parts = max(1, -(-index.rows // MERGE_IDS))
    schema = "id long, rank int, neighbor_id long, similarity double"

    def search(i: np.ndarray, x: np.ndarray, home: np.ndarray) -> pa.Table:
        a, b, micro = neighbours(i, unit(x), home, k, floor)
        task = (mix(a, 1) % np.uint64(parts)).astype(np.int64)
        return pa.Table.from_batches([packed(task, [a, b, micro])])

    def merge(table: pa.Table) -> pa.Table:
        a, b, micro = unpack_all(table.column("pack"), LISTS)
        keep = ranked(np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1], micro, k)
        a, b, micro = a[keep], b[keep], micro[keep]
        start = np.r_[True, a[1:] != a[:-1]]
        rank = np.arange(len(a)) - np.maximum.accumulate(np.where(start, np.arange(len(a)), 0)) + 1
        return pa.table({"id": a, "rank": rank.astype(np.int32), "neighbor_id": b, "similarity": micro / 1e6})

    def copies(i: np.ndarray, firsts: np.ndarray) -> pa.RecordBatch:
        """The list of a copy beyond the first k + 1 of its vector: the first k."""
        near = firsts[:, :k]
        columns = [np.repeat(i, near.shape[1]), np.tile(np.arange(1, near.shape[1] + 1, dtype=np.int32), len(i)), near.ravel(), np.ones(near.size)]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["id", "rank", "neighbor_id", "similarity"])

    lists = compared(df, index, search, "task long, pack binary", ids, vectors)
    out = regroup(lists, parts, merge, schema)
    more = of_heavy(df, index, copies, schema, ids, vectors) if floor <= 1.0 else None
    return out if more is None else out.unionAll(more.dropDuplicates(["id", "rank"]))


def similar_pairs(lists: DataFrame) -> DataFrame:
    """Each unordered pair of the lists of :func:`most_similar` once: (id_a, id_b), id_a < id_b."""
    return lists.select(F.least("id", "neighbor_id").alias("id_a"), F.greatest("id", "neighbor_id").alias("id_b")).distinct()
