"""Exact nearest neighbours by cosine, over cells around pivots (a Voronoi partition) and blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import landed

#: Cells at most; about how many examples, and how many queries, one task compares.
CELLS, BLOCK = 256, 16_384
#: Steps of a distance (0 to 2) in which a cell's examples are counted.
STEPS = 32
#: Distances are rounded: a cell is left out only if it is farther by more than this.
_SLACK = 1e-6
#: Numbers that a task works on at once.
_ROOM = 1 << 23


def unit_rows(vectors: list, zero: int) -> np.ndarray:
    """Vectors of length 1, with two columns more; a zero vector is 1 in column ``zero`` of the two, so that its cosines are 0."""
    x = np.array([list(v) for v in vectors], float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    none = norm < 1e-12
    extra = np.zeros((len(x), 2))
    extra[none[:, 0], zero] = 1
    return np.hstack((np.where(none, 0.0, x / np.where(none, 1.0, norm)), extra))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Between unit vectors; unlike cosines they obey the triangle inequality."""
    return np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))


def reach(away: np.ndarray, counts: pd.DataFrame, k: int) -> np.ndarray:
    """Per query (row) a distance within which k examples lie for certain.

    ``away`` are the distances to the pivots; counts: cell, edge, n: so many of a cell's examples lie within ``edge`` of its pivot, beyond those of smaller edges.
    """
    counts = counts.sort_values(["cell", "edge"])
    counts = counts[counts.groupby("cell")["n"].cumsum() - counts["n"] < k]
    far = away[:, counts["cell"].to_numpy()] + counts["edge"].to_numpy()
    order = np.argsort(far, axis=1)
    enough = np.cumsum(counts["n"].to_numpy()[order], axis=1) >= k
    place = np.take_along_axis(order, enough.argmax(axis=1)[:, None], 1)
    return np.where(enough.any(axis=1), np.take_along_axis(far, place, 1)[:, 0], np.inf)


def compare(asked: pd.DataFrame, examples: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id, example_id, score: the k best of these examples for each query, ties by id; both have id, vector (float64 bytes)."""
    # of equal vectors only the k smallest ids can be among the best
    examples = examples.sort_values("id").groupby("vector", sort=False).head(k).sort_values("id")
    ids, own = examples["id"].to_numpy(), np.frombuffer(b"".join(examples["vector"]), float).reshape(len(examples), -1)
    query, wanted = asked["id"].to_numpy(), np.frombuffer(b"".join(asked["vector"]), float).reshape(len(asked), -1)
    k, out = min(k, len(ids)), []
    for start in range(0, len(query), max(1, _ROOM // len(ids))):
        q = wanted[start:start + max(1, _ROOM // len(ids))]
        product = q @ own.T
        # a product's last digits depend on the matrix around it: near the cut, scores are summed anew, pair by pair
        row, col = np.nonzero(product >= np.partition(product, -k, axis=1)[:, -k, None] - 1e-9)
        step = max(1, _ROOM // own.shape[1])
        score = np.concatenate([(q[row[a:a + step]] * own[col[a:a + step]]).sum(axis=1) for a in range(0, len(row), step)])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, row)
        best = np.arange(len(row)) - first < k
        out.append(pd.DataFrame({"query_id": query[start + row[best]], "example_id": ids[col[best]], "score": score[best]}))
    return pd.concat(out)


def _best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    lists = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("example_id").alias("id")))), 1, k)
    return found.groupBy(*keys).agg(lists.alias("best")).select(*keys, F.explode("best").alias("e")).select(*keys, F.col("e.id").alias("example_id"), (-F.col("e.minus")).alias("score"))


def _number_of(cell_values: list[int]) -> Column:
    """The cell's value; there are no more than CELLS."""
    return F.array(*[F.lit(int(v)) for v in cell_values])[F.col("cell")]


def nearest(queries: DataFrame, examples: DataFrame, k: int = 3, least_confidence: float | None = None, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """query_id, example_id, score: the k most similar stored examples, ties by id; queries and examples have id, vector.

    With ``least_confidence``, only examples of that confidence (column confidence) count. The result is exact: examples belong to the
    cell of their nearest pivot (pivots are examples drawn by hash, one a block, ``cells`` at most), and a query visits each cell
    that can hold one of its k nearest, by the triangle inequality: from the distances to the pivots and counts of each cell's
    examples by distance. Cells of more than ``block`` examples, and queries beyond ``block`` that visit one cell, are
    split, so no group is larger, whatever one cell holds. Where vectors have no near neighbours nothing can be left out, and all
    blocks are compared.

    ids are unique; rows without an id or a vector are left out; a zero vector has score 0 with everything; fewer than k
    examples give fewer rows, none give an empty result; vectors of different lengths are an error. The driver gets the pivots and
    STEPS counts a cell.
    """
    if least_confidence is not None:
        examples = examples.where(F.col("confidence") >= least_confidence)
    examples, queries = (df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id is not null and vector is not null") for df in (examples, queries))
    examples = landed(examples, "nearest-examples")
    drawn = examples.orderBy(F.xxhash64("id"), "id").limit(max(1, min(cells, -(-examples.count() // block)))).collect()
    if not drawn:
        return queries.select(F.col("id").alias("query_id"), F.col("id").alias("example_id"), F.lit(0.0).alias("score")).limit(0)
    pivots = unit_rows([r["vector"] for r in drawn], 0)

    def place(batches):
        for batch in batches:
            if len(batch):
                x = unit_rows(batch["vector"].tolist(), 0)
                away = distances(x, pivots)
                cell = away.argmin(axis=1)
                yield pd.DataFrame({"cell": cell, "away": away[np.arange(len(x)), cell], "id": batch["id"], "vector": [v.tobytes() for v in x]})

    placed = landed(examples.mapInPandas(place, "cell int, away double, id long, vector binary"), "nearest-placed")
    edge = F.ceil(F.col("away") * (STEPS / 2)) * (2 / STEPS)
    counts = placed.groupBy("cell", edge.alias("edge")).agg(F.count("*").alias("n")).toPandas()  # at most CELLS * (STEPS + 1) rows
    size, radius = counts.groupby("cell")["n"].sum(), counts.groupby("cell")["edge"].max()
    parts = [-(-int(size.get(c, 0)) // block) for c in range(len(pivots))]
    full, widest = size.index.to_numpy(), radius.to_numpy()

    def ask(batches):
        for batch in batches:
            for start in range(0, len(batch), 1024):
                some = batch.iloc[start:start + 1024]
                x = unit_rows(some["vector"].tolist(), 1)
                away = distances(x, pivots)
                row, at = np.nonzero(away[:, full] - widest <= reach(away, counts, k)[:, None] + _SLACK)
                yield pd.DataFrame({"cell": full[at], "id": some["id"].to_numpy()[row], "vector": [x[r].tobytes() for r in row]})

    asked = landed(queries.mapInPandas(ask, "cell int, id long, vector binary"), "nearest-asked")
    visits = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most CELLS rows
    slices = [-(-visits.get(c, 0) // block) for c in range(len(pivots))]
    hashed, keys = F.xxhash64("id"), ("cell", "part", "slice")
    own = placed.where(_number_of(slices) > 0).select("cell", F.pmod(hashed, _number_of(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), _number_of(slices) - 1)).alias("slice"), "id", "vector")
    wanted = asked.select("cell", F.explode(F.sequence(F.lit(0), _number_of(parts) - 1)).alias("part"), F.pmod(hashed, _number_of(slices)).cast("int").alias("slice"), "id", "vector")

    def pairs(key, left, right):
        found = compare(left, right, k) if len(left) and len(right) else pd.DataFrame({"query_id": [], "example_id": [], "score": []})
        return found.assign(cell=key[0])

    found = wanted.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInPandas(pairs, "query_id long, example_id long, score double, cell int")
    # a query's best of each cell first: no list has more than k rows a block or a cell
    return _best(_best(found, k, "query_id", "cell"), k, "query_id")
