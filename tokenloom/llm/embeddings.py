"""Near-duplicate embeddings: an exact metric range join on the unit sphere.

cosine >= t is distance <= r = sqrt(2 - 2t) between unit vectors. Pivots, at most MAX_PIVOTS of the vectors, part the vectors into
cells by the nearest pivot. From the triangle inequality, a vector x of cell i can have a partner in cell j only if
|x - p_j|^2 - |x - p_i|^2 <= 2 r |p_i - p_j| and |x - p_j| <= r + the cell's radius; x is replicated to those cells j < i, so each
pair meets in one cell. Within a cell, vectors whose distances to its pivot differ by more than r are no partners: rings of width r
are joined with themselves and the next one only, in blocks of some BLOCK vectors, one work unit for each pair of blocks, so a cell
with very many vectors is many units. The units are rows, made by joining the cells' blocks; no list of them is held anywhere.
Products in single precision, less a margin that grows with the width, select what is computed in double precision.

Equal vectors are one class with a weight. Units return sums of links and a forest of stars instead of pairs.

Defined cases: a vector that is null, zero or holds a null or non-finite component links with nothing, nor do vectors of other
lengths with each other; equal rows, also of one vec_id, are vectors of their own, and link with each other; a null vec_id is never
the smallest of a group and not kept; a cosine that equals the threshold links; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.components import UnionFind, components
from tokenloom.llm.scratch import Scratch

THRESHOLD = 0.95
BLOCK, TILE, MAX_PIVOTS = 4096, 512, 1024
MARGIN = 1e-5  #: at least; the rounding of a product of unit vectors in single precision grows with their width
CELL_ROWS = 8192


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _radii(vectors: DataFrame, pivots: np.ndarray) -> np.ndarray:
    """The largest distance of a cell's own vectors from its pivot."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.full(len(pivots), -1.0)
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                dots = _unit(_matrix(b.column("embedding").slice(start, 2000))) @ pivots.T
                own = dots.argmax(1)
                np.maximum.at(far, own, _distance(dots[np.arange(len(own)), own]))
        cells = np.flatnonzero(far >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(far[cells], pa.float64())], ["cell", "radius"])

    found = vectors.select("embedding").mapInArrow(work, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect()  # one row for each pivot
    out = np.zeros(len(pivots))
    for x in found:
        out[x.cell] = x.radius
    return out


def _distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * dots))


def _cells(vectors: DataFrame, pivots: np.ndarray, r: float) -> DataFrame:
    """cell, home (it is the vector's own), ring, id, weight, embedding."""
    apart, radii = _distance(pivots @ pivots.T), _radii(vectors, pivots)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                dots = _unit(_matrix(part.column("embedding"))) @ pivots.T
                own = dots.argmax(1)
                rows = np.arange(len(own))
                gap, far = 2 * (dots[rows, own][:, None] - dots), _distance(dots)  # gap = |x - p_j|^2 - |x - p_i|^2
                near = (gap <= 2 * r * apart[own] + 1e-9) & (far <= radii + r + 1e-9) & (np.arange(len(pivots)) <= own[:, None])
                near[rows, own] = True
                at, cell = np.nonzero(near)
                ring = np.floor(far[at, cell] / (r + 1e-9)).astype(np.int32)
                for k in range(0, len(at), 20_000):
                    i, c = at[k : k + 20_000], cell[k : k + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int32()), pa.array(c == own[i]), pa.array(ring[k : k + 20_000]), *(part.column(x).take(pa.array(i)) for x in ("id", "weight", "embedding"))],
                        ["cell", "home", "ring", "id", "weight", "embedding"],
                    )

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.mapInArrow(work, f"cell int, home boolean, ring int, id long, weight long, embedding {kind}")


def _units(placed: DataFrame) -> DataFrame:
    """cell, home, ring, part -> unit, side, itself: which blocks of the placed vectors meet. Blocks of a cell's own vectors meet
    each other once and all blocks of its guests, if their rings are the same or next to each other."""
    blocks = placed.groupBy("cell", "home", "ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left, right = (blocks.where("home") if k == "l" else blocks for k in "lr")
    left, right = (b.select(*(F.col(c).alias(f"{k}_{c}") for c in ("cell", "home", "ring", "part"))) for k, b in (("l", left), ("r", right)))
    meet = (F.col("l_cell") == F.col("r_cell")) & (F.abs(F.col("l_ring") - F.col("r_ring")) <= 1)
    later = (F.col("r_ring") > F.col("l_ring")) | ((F.col("r_ring") == F.col("l_ring")) & (F.col("r_part") >= F.col("l_part")))
    pairs = left.join(right, meet & (~F.col("r_home") | later))
    itself = F.col("r_home") & (F.col("r_ring") == F.col("l_ring")) & (F.col("r_part") == F.col("l_part"))
    pairs = pairs.withColumns({"itself": itself, "unit": F.concat_ws(":", "l_cell", "l_ring", "l_part", F.col("r_home").cast("string"), "r_ring", "r_part")})
    side = lambda k, n: F.struct(*(F.col(f"{k}_{c}").alias(c) for c in ("cell", "home", "ring", "part")), "unit", F.lit(n).alias("side"), "itself")
    return pairs.select(F.explode(F.when(F.col("itself"), F.array(side("l", 0))).otherwise(F.array(side("l", 0), side("r", 1)))).alias("x")).select("x.*")


class _Links:
    """Joins the vectors of a unit; sums weights of linked partners and unites what is linked."""

    def __init__(self, t: float):
        self.t = t

    def linked(self, a32, b32, a64, b64) -> np.ndarray:
        near = a32 @ b32.T >= self.t - max(MARGIN, 2.0**-22 * a32.shape[1])
        i, j = np.nonzero(near)
        if len(i) > near.size // 50:
            return near & (self.cosines(a64, b64) >= self.t)
        near[i, j] = self.cosines_of(a64, b64, i, j) >= self.t
        return near

    @staticmethod
    def cosines(a, b) -> np.ndarray:
        return (a @ b.T) / np.sqrt((a * a).sum(1))[:, None] / np.sqrt((b * b).sum(1))

    @staticmethod
    def cosines_of(a, b, i, j) -> np.ndarray:
        x, y = a[i], b[j]
        return (x * y).sum(1) / np.sqrt((x * x).sum(1)) / np.sqrt((y * y).sum(1))

    def join(self, ids, weights, x, n_left: int, itself: bool) -> tuple[np.ndarray, np.ndarray]:
        """(sum of partners' weights, least index reachable within the unit) of each row; the first n_left rows against the rest,
        or all against all if itself."""
        x64 = x.astype(np.float64)
        x32 = _unit(x).astype(np.float32)
        sums, sets, label = np.zeros(len(x), np.int64), UnionFind(), np.arange(len(x))
        right = np.arange(len(x)) if itself else np.arange(n_left, len(x))
        for start in range(0, n_left, TILE):
            left = np.arange(start, min(start + TILE, n_left))
            cols = right[right >= start] if itself else right
            near = self.linked(x32[left], x32[cols], x64[left], x64[cols])
            if itself:
                near &= cols[None, :] > left[:, None]
            if not near.any():
                continue
            sums[left] += near @ weights[cols]
            sums[cols] += near.T @ weights[left]
            for axis, own, other in ((1, left, cols), (0, cols, left)):
                some = np.flatnonzero(near.any(axis))
                for p, q in zip(own[some].tolist(), other[near.argmax(axis)[some]].tolist(), strict=True):
                    sets.union(p, q)
            for k in range(2):  # what is not united by these: few pairs
                for p, q in sets.stars():
                    label[p] = q
                i, j = np.nonzero(near & (label[left][:, None] != label[cols][None, :])) if k == 0 else ((), ())
                for p, q in zip(left[i].tolist() if len(i) else (), cols[j].tolist() if len(j) else (), strict=True):
                    sets.union(p, q)
        for p, q in sets.stars():
            label[p] = q
        return sums, label


def _unit_work(t: float):
    links = _Links(t)

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = np.asarray(table.column("side"))
        order = np.argsort(side, kind="stable")
        table = table.take(pa.array(order))
        n_left = int((side == 0).sum())
        itself = bool(table.column("itself")[0].as_py())
        ids, weights = np.asarray(table.column("id")), np.asarray(table.column("weight"))
        x = _matrix(table.column("embedding").combine_chunks() if isinstance(table.column("embedding"), pa.ChunkedArray) else table.column("embedding"))
        if not itself and n_left in (0, len(ids)):
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        sums, label = links.join(ids, weights, x, n_left, itself)
        some = np.flatnonzero(sums)
        return pa.table({"id": pa.array(ids[some], pa.int64()), "links": pa.array(sums[some], pa.int64()), "root": pa.array(ids[label[some]], pa.int64())})

    return work


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    e = F.col("embedding")
    fit = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    kind = "array<double>" if "double" in vectors.schema["embedding"].dataType.simpleString() else "array<float>"
    rows = scratch.cut(vectors.select("vec_id", F.when(fit, e.cast(kind)).alias("embedding")))
    classes = rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("weight"))
    classes = scratch.cut(classes.select(F.monotonically_increasing_id().alias("id"), "*", F.size("embedding").alias("width")))
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    links, edges = [], []
    for width, n in sorted((x.width, x.n) for x in classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each width
        own = classes.where(F.col("width") == width)
        k = int(min(MAX_PIVOTS, max(1, -(-n // CELL_ROWS))))
        drawn = own.orderBy(F.xxhash64("embedding")).limit(k).select("embedding").collect()  # MAX_PIVOTS at most
        pivots = _unit(np.array([x.embedding for x in drawn], np.float64))
        placed = scratch.cut(_cells(own.select("id", "weight", "embedding"), pivots, r))
        parts = placed.groupBy("cell", "home", "ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
        dealt = placed.join(parts, ["cell", "home", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        dealt = dealt.join(scratch.cut(_units(placed)), ["cell", "home", "ring", "part"]).select("unit", "side", "itself", "id", "weight", "embedding")
        found = scratch.cut(dealt.groupBy("unit").applyInArrow(_unit_work(threshold), "id long, links long, root long"))
        links.append(found.select("id", "links"))
        edges.append(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    if not links:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    found = components(union(edges), scratch)
    known = classes.join(union(links).groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(found.withColumnRenamed("node", "id"), "id", "left")
    known = scratch.cut(known.select("id", "embedding", "least_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")))
    least = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = known.join(least, "root").select("embedding", "n_links", "component_id")
    out = rows.join(known, "embedding", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
