"""Approximate nearest neighbours: an inverted-file index of quantised vectors, as tables.

* *Fit.* Cells are the centroids of a spherical k-means over a bounded sample (`SAMPLE` rows, in the order of a
  hash of the id); their number is the square root of the rows, `MOST_CELLS` at most. The number of cells a
  query probes is the smallest that reaches the wanted share of true neighbours within the sample.
* *Index.* Every row is assigned to its nearest cell and written as (cell, id, twin, scale, slack, code): two bytes
  a dimension, how far the code is from the vector, and a hash that copies share. New rows are assigned to the same
  cells and appended.
* *Search.* Probes and index rows meet on the cell, an equi-join by cogroup. A cell of many rows, or one many
  queries probe, is cut into blocks. A task multiplies codes and keeps the best of each query; the best of
  all its cells, `REFINE` * k of them and every other whose code leaves open whether it is one of the k, are joined
  to the vectors and scored exactly. Only these pairs are scored, however large the gallery is.

Rows without an id or a vector, and vectors of other lengths, are not indexed; an empty gallery finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.vectors import dot
from recallspark.sources.staging import staged

#: Rows the cells are fitted on and the probes measured with, cells at most, rounds of k-means.
SAMPLE, MOST_CELLS, ROUNDS, ASKED = 50_000, 4096, 6, 1024
#: Index rows and probes of a block, exactly scored candidates for each wanted neighbour.
ROWS, PROBES, REFINE = 32_768, 4096, 3
#: Scores are compared to six places.
PLACE = 1e-6


@dataclass(frozen=True)
class Index:
    """Cells, the number of them a query probes, and the table (cell, id, twin, scale, slack, code)."""

    centroids: np.ndarray
    probes: int
    rows: DataFrame


def _usable(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id is not null and size(vector) > 0")
    return rows if dimension is None else rows.where(F.size("vector") == dimension)


def k_means(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors, from the first `cells` rows on; an empty cell keeps its centroid."""
    centre = sample[:cells].copy()
    for _ in range(rounds):
        own = _nearest_cells(sample, centre, 1)[:, 0]
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1)
        some = size > 0
        centre[some] = total[some] / size[some, None]
    return centre


def _nearest_cells(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each vector, nearest first, ties by number (equal cells tie whatever the product's last bits)."""
    some, which = np.unique(centroids, axis=0, return_inverse=True)
    out = []
    for at in range(0, len(vectors), 1024):
        s = (vectors[at : at + 1024] @ some.T)[:, which.ravel()]
        out.append(np.argsort(-s, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def probes_needed(sample: np.ndarray, centroids: np.ndarray, k: int, share: float) -> int:
    """The smallest number of cells that hold `share` of the k nearest rows of the first rows of the sample."""
    asked = sample[:ASKED]
    cell = _nearest_cells(sample, centroids, 1)[:, 0]
    place = np.empty((len(asked), len(centroids)), np.int64)  # of each cell in the order of a row
    np.put_along_axis(place, _nearest_cells(asked, centroids, len(centroids)), np.arange(1, len(centroids) + 1)[None, :], axis=1)
    need = []
    for i in range(len(asked)):
        s = np.round(sample @ asked[i], 6)
        s[i] = -2
        near = np.lexsort((np.arange(len(s)), -s))[: min(k, len(s) - 1)]
        need.append(place[i, cell[near]])
    need = np.sort(np.concatenate(need)) if need else np.ones(1, np.int64)
    return int(need[max(0, int(np.ceil(share * len(need))) - 1)]) if len(need) else 1


def fit(vectors: DataFrame, k: int = 10, share: float = 0.95) -> tuple[np.ndarray, int]:
    """(centroids, probes) for a gallery (id, vector) of unit vectors."""
    rows = _usable(vectors)
    shape = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not shape[0]:
        return np.zeros((0, 0)), 1
    some = rows.where(F.size("vector") == shape[1]).orderBy(F.md5(F.col("id").cast("string")), "id").limit(SAMPLE).select("vector")
    sample = np.array([r[0] for r in some.collect()])  # SAMPLE rows at most
    cells = min(len(sample), MOST_CELLS, int(np.ceil(np.sqrt(shape[0]))))
    centroids = k_means(sample, cells)
    return centroids, probes_needed(sample, centroids, k, share)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cell, id, twin, scale, slack, code) of every row (id, vector). The product of a query with the code is off by `slack` times
    the query's length at most, what 32-bit arithmetic loses included."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
            scale = np.abs(v).max(axis=1, initial=0) / 32_767
            code = np.rint(v / np.where(scale > 0, scale, 1)[:, None]).astype(np.int16)
            slack = np.linalg.norm(v - code * scale[:, None], axis=1) + np.linalg.norm(v, axis=1) * (v.shape[1] + 4) / (1 << 23)
            cell = _nearest_cells(v, centroids, 1)[:, 0].astype(np.int32)
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(2), pa.array(scale), pa.array(slack), codes], names=["cell", "id", "twin", "scale", "slack", "code"])

    rows = _usable(vectors, centroids.shape[1]).withColumn("twin", F.xxhash64("vector"))
    return rows.mapInArrow(task, "cell int, id long, twin long, scale double, slack double, code binary")


def built(vectors: DataFrame, k: int = 10, share: float = 0.95) -> Index:
    """An index of all rows, its table written."""
    centroids, probes = fit(vectors, k, share)
    return Index(centroids, probes, staged(assigned(vectors, centroids), "cells"))


def saved(index: Index, path: str) -> None:
    """Write an index as two tables below `path`; `opened` reads it again, `appended` adds rows to it."""
    spark = index.rows.sparkSession
    cells = [(i, c.tolist(), index.probes) for i, c in enumerate(index.centroids)]
    spark.createDataFrame(cells, "cell int, vector array<double>, probes int").write.parquet(f"{path}/centroids")
    index.rows.write.parquet(f"{path}/rows")


def opened(spark, path: str) -> Index:
    cells = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MOST_CELLS at most
    return Index(np.array([r["vector"] for r in cells]), cells[0]["probes"] if cells else 1, spark.read.parquet(f"{path}/rows"))


def appended(spark, path: str, vectors: DataFrame) -> None:
    """Rows that came after the fit: assigned to the cells there are."""
    assigned(vectors, opened(spark, path).centroids).write.mode("append").parquet(f"{path}/rows")


def _probing(centroids: np.ndarray, probes: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
            cell = _nearest_cells(v, centroids, probes)
            which = np.repeat(np.arange(len(v)), cell.shape[1])
            raw = pa.array([x.tobytes() for x in v.astype(np.float32)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cell.ravel().astype(np.int32)), batch.column(0).take(pa.array(which)), raw.take(pa.array(which))], names=["cell", "query_id", "raw"])

    return task


_FOUND = "query_id long, id long, twin long, near double, off double, met long"


def _first_copies(ids: np.ndarray, twin: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows that are among the `most` smallest ids of their copies."""
    order = np.lexsort((ids, twin))
    first = np.searchsorted(twin[order], twin[order])
    return np.sort(order[np.arange(len(order)) - first < most])


def _between(ordered: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where the ids asked for begin and end."""
    return np.stack([np.searchsorted(ordered, asked, side) for side in ("left", "right")])


def _best(k: int, most: int, exclude_self: bool):
    """The `most` best index rows of each query of a block by their codes, those that may be among its k best by their vectors,
    and how many were met there (its own row is not, if `exclude_self`)."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            q = np.frombuffer(b"".join(left["raw"].to_pylist()), np.float32).reshape(left.num_rows, -1)
            asked, length = np.asarray(left["query_id"]), np.linalg.norm(q, axis=1)
            every = np.full(left.num_rows, right.num_rows)
            if exclude_self:
                every -= np.diff(_between(np.sort(np.asarray(right["id"])), asked), axis=0)[0]
            right = right.take(pa.array(_first_copies(np.asarray(right["id"]), np.asarray(right["twin"]), most + 1)))
            g = np.frombuffer(b"".join(right["code"].to_pylist()), np.int16).reshape(right.num_rows, -1).astype(np.float32)
            g *= np.asarray(right["scale"], np.float32)[:, None]
            ids, twin, slack = (np.asarray(right[c]) for c in ("id", "twin", "slack"))
            by_id = np.argsort(ids, kind="stable")
            own = _between(ids[by_id], asked)
            for at in range(0, len(q), 512):
                s = q[at : at + 512] @ g.T
                for i in np.flatnonzero(own[0][at : at + 512] < own[1][at : at + 512]) if exclude_self else ():
                    s[i, by_id[own[0][at + i] : own[1][at + i]]] = -np.inf
                n = min(most, s.shape[1])
                top = np.sort(np.partition(s, -n, axis=1)[:, -n:], axis=1)
                off = length[at : at + 512] * slack.max()
                least = np.minimum(top[:, 0], _open_from(top[:, -min(k, n)] - off) - off)
                row, near = np.nonzero(s >= np.maximum(least, np.finfo(np.float32).min)[:, None])
                met = np.where(np.searchsorted(row, row) == np.arange(len(row)), every[at + row], 0)
                score = s[row, near].astype(float)
                parts.append(pa.table([asked[at + row], ids[near], twin[near], score, length[at + row] * slack[near], met], names=_names(_FOUND)))
        return pa.concat_tables(parts) if parts else pa.table([np.zeros(0, np.int64)] * 3 + [np.zeros(0)] * 2 + [np.zeros(0, np.int64)], names=_names(_FOUND))

    return task


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _open_from(least):
    """From which score on a row may be among the k best, of which the last has `least` or more. Scores are
    held to -1..1 and rounded."""
    return np.where(least <= -1, -np.inf, np.minimum(least, 1.0) - PLACE)


def candidates(index: Index, queries: DataFrame, k: int, most: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, met): the `most` nearest rows of the probed cells by their codes with every row that may be one of the k
    nearest by its vector, and the rows met there. Of copies the `most` smallest ids are enough."""
    asked = _usable(queries.select(F.col("query_id").alias("id"), "vector"), index.centroids.shape[1])
    probes = asked.mapInArrow(_probing(index.centroids, index.probes), "cell int, query_id long, raw binary")
    probes = staged(probes, "probes")
    # blocks of each cell: a row a cell, MOST_CELLS at most
    g = index.rows.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("g"))
    q = probes.groupBy("cell").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("q"))
    size = F.broadcast(staged(g.join(q, "cell"), "blocks"))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = probes.join(size, "cell").select("cell", own("query_id", "q").alias("qb"), every("g").alias("gb"), "query_id", "raw").groupBy("cell", "gb", "qb")
    b = index.rows.join(size, "cell").select("cell", own("id", "g").alias("gb"), every("q").alias("qb"), "id", "twin", "scale", "slack", "code").groupBy("cell", "gb", "qb")
    found = a.cogroup(b).applyInArrow(_best(k, most, exclude_self), _FOUND)
    whole = Window.partitionBy("query_id")
    copy = F.row_number().over(Window.partitionBy("query_id", "twin").orderBy("id"))
    rows = found.withColumn("met", F.sum("met").over(whole)).withColumn("copy", copy).where(F.col("copy") <= most)
    surely = F.row_number().over(whole.orderBy(F.desc(F.col("near") - F.col("off"))))
    rows = rows.withColumn("place", F.row_number().over(whole.orderBy(F.desc("near"), "id"))).withColumn("surely", surely)
    least = F.max(F.when(F.col("surely") == k, F.col("near") - F.col("off"))).over(whole)
    maybe = least.isNull() | (least <= -1) | (F.col("near") + F.col("off") >= F.least(least, F.lit(1.0)) - PLACE)
    return rows.withColumn("maybe", maybe).where((F.col("place") <= most) | F.col("maybe")).select("query_id", "id", "met")


def nearest_indexed(index: Index, queries: DataFrame, vectors: DataFrame, k: int, refine: int = REFINE, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, similarity, rank, scored, met): the k nearest (id, vector) that the probed cells hold.

    Similarities are exact, to six places, ties by id. `scored` pairs of a query were scored exactly, `met`
    rows compared by their codes.
    """
    found = staged(candidates(index, queries, k, refine * k, exclude_self), "candidates")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("asked"))
    rows = _usable(vectors, index.centroids.shape[1])
    pairs = found.join(rows, "id").join(asked, "query_id")
    score = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("asked", "vector"))), 6)
    scored = pairs.select("query_id", "id", score.alias("similarity"), "met")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("scored", F.count("*").over(Window.partitionBy("query_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", "similarity", "rank", "scored", "met")
