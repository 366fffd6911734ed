"""Near-duplicate embeddings by collision-counting projections.

Unit vectors are projected on many random directions.  Two vectors whose cosine
reaches the threshold differ on each direction by a normal variable of known
spread, so a window of half-width ``w`` around a query catches a partner with a
probability set beforehand, and the number of directions that catch it is
binomial: both the window and the count a pair must reach are calibrated from
the recall asked for.  Pairs that reach the count are verified in double precision.

A window on one direction catches a third of all vectors, so collisions are counted
within cells.  A cell is named by further projections: of each of some sets of
directions, the one with the longest projection and its sign.  The number and size of
these sets grow with the number of vectors, so that a cell holds about ``CELL_ROWS``
of them at every size; independent groups of sets, as many as the recall asks for
under the chance (by simulation) that a pair at the threshold shares a cell, bring
the recall back up.  A vector is in one cell a group.

In a cell vectors are sorted by the first direction; each is a query to those after it
in a window so wide (``SURE``) that a partner at the threshold is outside it once in a
million, and whether it collides on that direction is then counted as on the others.  A pair that shares the cells of several groups counts under the
first, which either side's cell names tell, so link counts need no exchange of
pairs.  Equal vectors are folded into one beforehand, cells of over ``SPLIT_ROWS``
are split into parts whose pairs are tasks, and only counts and spanning edges leave
a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import bounded_batches, components, frugal, materialize

COSINE = 0.95
DIRECTIONS = 24
CATCH = 0.97
CELL_ROWS, SPLIT_ROWS = 500, 4000
SURE = 1 - 1e-6  # chance that the window of the sorted direction holds a partner at the threshold
SET = 64  # directions in a set at most
#: a table of split cells is broadcast up to so many rows of three numbers
FEW_CELLS = 100_000


@dataclass(frozen=True)
class Plan:
    """What is fixed before any vector is compared."""

    sets: tuple[int, ...]  # directions in each set that names a cell
    groups: int
    catch: float = CATCH
    directions: int = DIRECTIONS
    cosine: float = COSINE
    seed: int = 31

    def width(self, dim: int, catch: float | None = None) -> float:
        """Half-width that catches a partner at the threshold with probability ``catch`` on one direction."""
        # projections can't differ by more than the vectors do
        return min(_normal_quantile((1 + (catch or self.catch)) / 2) / math.sqrt(dim), 1.0) * math.sqrt(2 - 2 * self.cosine)

    def count(self, miss: float = 0.003) -> int:
        """Greatest count that a partner at the threshold reaches but for a chance of ``miss``."""
        total, n, p = 0.0, self.directions, self.catch
        for k in range(n + 1):
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if total > miss:
                return k
        return n

    def matrix(self, dim: int) -> np.ndarray:
        return _directions(dim, self.directions, self.seed)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Names of the cells of unit vectors, a column a group."""
        dim = x.shape[1]
        out = np.empty((len(x), self.groups), np.int64)
        with np.errstate(over="ignore"):
            for g in range(self.groups):
                y = x @ _directions(dim, max(1, sum(self.sets)), self.seed + 1000 * (g + 1))
                h, at = np.full(len(x), dim, np.uint64), 0
                for size in self.sets:
                    own = y[:, at : at + size]
                    longest = np.abs(own).argmax(1)
                    sign = np.take_along_axis(own, longest[:, None], 1)[:, 0] > 0
                    h = (h ^ (2 * longest + sign).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                    at += size
                out[:, g] = h.view(np.int64)
        return out


def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    m = np.random.default_rng(seed + dim).normal(size=(dim, n))
    return m / np.linalg.norm(m, axis=0)


def plan_for(rows: int, recall: float = 0.99, cosine: float = COSINE, dim: int = 64) -> Plan:
    """Sets so that cells stay near ``CELL_ROWS`` of ``rows`` vectors, groups so that ``recall`` is met at the threshold; counting takes a third of the misses, cells the rest at most."""
    sets, cells = [], rows / CELL_ROWS
    while cells > 1:
        sets.append(min(SET, math.ceil(cells / 2)))
        cells /= 2 * sets[-1]
    rng = np.random.default_rng(5)
    x, z = _unit(rng.normal(size=(2000, dim))), rng.normal(size=(2000, dim))
    z = _unit(z - (z * x).sum(1, keepdims=True) * x) if dim > 1 else x
    y = cosine * x + math.sqrt(1 - cosine**2) * z
    trial = Plan(tuple(sets), 8, cosine=cosine)
    p = min(0.999, max(0.001, float((trial.cells(x) == trial.cells(y)).mean())))
    return Plan(tuple(sets), max(1, math.ceil(math.log((1 - recall) / 2) / math.log(1 - p))) if sets else 1, cosine=cosine)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _normal_quantile(p: float) -> float:
    low, high = 0.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (low, mid)
    return low


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def cell_names(vectors: DataFrame, plan: Plan) -> DataFrame:
    """``id, copies, v`` with ``cells``, a name for each group."""
    bounded_batches(vectors.sparkSession)
    kind = vectors.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                cells = plan.cells(_unit(_matrix(part.column(2)).astype(np.float64)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, plan.groups), pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["id", "copies", "v", "cells"])

    return vectors.select("id", "copies", "v").mapInArrow(frugal(run), f"id long, copies long, v {kind}, cells array<long>")


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after uniting the trees of ``i`` and ``j``; every label is a root before and after."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _links(table: pa.Table, plan: Plan) -> pa.Table:
    """Links within a part of a cell, or between two: a row (id, links, root) for each vector that has any."""
    group = table.column("grp")[0].as_py()
    side = table.column("own").to_numpy()
    ids, copies, cells = table.column("id").to_numpy(), table.column("copies").to_numpy(), _matrix(table.column("cells"))
    x = _unit(_matrix(table.column("v")).astype(np.float64))
    dim = x.shape[1]
    y = (x @ plan.matrix(dim)).astype(np.float32)
    order = np.argsort(y[:, 0], kind="stable")
    side, ids, copies, x, cells, y = side[order], ids[order], copies[order], x[order], cells[order].T.copy(), y[order].T.copy()
    w, most = np.float32(plan.width(dim)), plan.directions - plan.count()
    wide = np.float32(plan.width(dim, SURE)) + np.float32(1e-6)
    two = table.column("pa")[0].as_py() != table.column("pb")[0].as_py()
    n = len(ids)
    links, label = np.zeros(n, np.int64), np.arange(n)
    for at in range(0, n, 128):
        stop = min(n, at + 128)
        high = int(np.searchsorted(y[0], y[0, stop - 1] + wide, side="right"))
        near = np.abs(y[0, at:stop, None] - y[0, at:high]) <= wide
        near &= np.arange(at, stop)[:, None] < np.arange(at, high)
        if two:
            near &= side[at:stop, None] != side[at:high]
        for g in range(group):  # counted under an earlier group
            near &= cells[g, at:stop, None] != cells[g, at:high]
        i, j = np.nonzero(near)
        i, j = i + at, j + at
        missed = np.zeros(len(i), np.int8)
        for k in range(plan.directions):
            missed += np.abs(y[k, i] - y[k, j]) > w
            if k % 4 == 0:
                some = missed <= most
                i, j, missed = i[some], j[some], missed[some]
        some = missed <= most
        i, j = i[some], j[some]
        for low in range(0, len(i), 100_000):
            a, b = i[low : low + 100_000], j[low : low + 100_000]
            ok = np.einsum("ij,ij->i", x[a], x[b]) >= plan.cosine
            a, b = a[ok], b[ok]
            links += np.bincount(a, copies[b], minlength=n).astype(np.int64) + np.bincount(b, copies[a], minlength=n).astype(np.int64)
            label = _unite(label, a, b)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    who = np.flatnonzero(links)
    return pa.table({"id": pa.array(ids[who]), "links": pa.array(links[who]), "root": pa.array(least[label[who]])})


def vector_links(vectors: DataFrame, plan: Plan, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``id, links, root`` rows of distinct ``vectors(id, copies, v)``; sum ``links`` by id.

    Cells of more than ``split_rows`` are split; every two parts meet in a task of their own.
    """
    named = materialize(cell_names(vectors, plan), "vec-cells")
    dealt = named.select("id", "copies", "v", "cells", F.posexplode("cells").alias("grp", "cell"))
    large = named.select(F.posexplode("cells").alias("grp", "cell")).groupBy("grp", "cell").agg(F.ceil(F.count("*") / F.lit(split_rows)).alias("k")).where("k > 1")
    large = materialize(large, "vec-large-cells")
    rows = dealt.join(F.broadcast(large) if large.count() <= FEW_CELLS else large, ["grp", "cell"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("k"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    rows = rows.select("grp", "cell", F.least("own", "other").alias("pa"), F.greatest("own", "other").alias("pb"), "own", "id", "copies", "cells", "v")
    schema = StructType().add("id", LongType()).add("links", LongType()).add("root", LongType())
    return rows.repartition("grp", "cell", "pa", "pb").groupBy("grp", "cell", "pa", "pb").applyInArrow(lambda t: _links(t, plan), schema)


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = 0.99) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding)``: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, nor do rows with a null vec_id; vectors of different lengths never link.
    Equal vectors link with each other.  No pair below ``cosine`` is linked.  Rows that
    repeat a vec_id are vectors of their own; other columns are left out; an empty table
    gives no rows.
    """
    good = F.expr(
        "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
        " and exists(embedding, x -> x <> 0)"
    )
    marked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("_good", F.coalesce(good, F.lit(False)))
    usable = marked.where("_good").select("vec_id", F.col("embedding").alias("v"))
    # a number of its own for each vector, fixed once the table is written; vec_ids only label
    distinct = usable.groupBy("v").agg(F.min("vec_id").alias("label"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id())
    distinct = materialize(distinct.select("v", "id", "label", "copies"), "vec-distinct")
    sizes = distinct.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    plan = plan_for(distinct.count(), recall, cosine, sizes["dim"] if sizes else 1)
    found = materialize(vector_links(distinct, plan), "vec-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = groups.join(distinct.select("id", "label"), "id")
    least = named.groupBy("component").agg(F.min("label").alias("component_id"))
    of = named.select("id", "component").join(least, "component").select("id", "component_id")
    per = (
        distinct.join(links, "id", "left").join(of, "id", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "label").alias("component_id"))
    )
    linked = usable.join(per, "v").select("vec_id", "n_links", "component_id")
    alone = marked.where(~F.col("_good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
