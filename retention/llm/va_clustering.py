"""Centroid clustering over a vector approximation (VA) file.

Vectors are rounded to integers.  Beside the full vectors stands the VA file: per vector one cell number
of ``bits`` bits for each dimension.  The cells of a dimension are integer ranges between exact global
ends, halved where a bounded sample (the ``sample`` rows with the least hash) is dense; the sample only
affects how tight the intervals are.

A round first reads the cells alone.  For the centroids in force, a lookup table holds the least and the
greatest squared difference of every (centroid, dimension, cell); sums over the dimensions give every
vector a distance interval per centroid.  Where one interval ends before all others begin the cluster is
known.  The other vectors keep a bit mask of the centroids whose intervals overlap the best one, and the
full vectors of just those are fetched by row number and measured exactly (ties: smaller number).

Centroids need exact sums, which are kept from round to round: only a vector that changes its cluster
is fetched and moves between two sums.  The first round, where every vector is new to its cluster, and
the last assignment, which returns exact distances, read cells and vectors side by side instead.

Only the k centroids and the k x dimensions sums pass through the driver, both of fixed size.

Defined results: vectors that are null, of another length, or hold a null or non-finite component take no
part, nor do those with a component beyond 2^27 after rounding (their squared distances don't fit a long);
rows that share an id, or repeat, are separate vectors, ordered by their components where their hashes
tie as first centroids; a null id hashes as the empty text; with fewer vectors than k there are fewer
centroids; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

LIMIT = 2**27
BATCH = 2048  # vectors measured at once inside a task


def usable(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x), x as double, for vectors that take part, else null."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    sound = (F.size(vector) == dims) & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < LIMIT))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(doubles, lambda x: F.floor(x * scale).cast("int")))


def cell_bounds(vectors: DataFrame, dims: int, bits: int, sample: int) -> np.ndarray:
    """(dims, 2^bits + 1): cell c of a dimension covers bounds[c] <= x < bounds[c + 1]."""
    ends = vectors.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()
    some = vectors.select("v").orderBy(F.xxhash64("row", F.lit(31)), "row").limit(sample).toArrow().column("v")
    some = np.array(some.to_pylist(), np.int64).reshape(-1, dims)
    return np.array([split_range(r["low"], r["high"] + 1, some[:, r["at"]], 2**bits) for r in ends], np.int64)


def split_range(low: int, end: int, values: np.ndarray, cells: int) -> list[int]:
    """Bounds of ``cells`` integer ranges: the range with the greatest width times number of values
    is halved until there are enough; ranges of one integer or no value stay, and empty ones fill the rest."""
    values = np.sort(values)
    weigh = lambda a, z: ((z - a) * int(np.searchsorted(values, z) - np.searchsorted(values, a)) if z - a > 1 else 0, a, z)
    ranges = [weigh(low, end)]
    while len(ranges) < cells and max(ranges)[0] > 0:
        _, a, z = ranges.pop(ranges.index(max(ranges)))
        ranges += [weigh(a, (a + z) // 2), weigh((a + z) // 2, z)]
    bounds = [low, *sorted(z for _, _, z in ranges)]
    return bounds + [end] * (cells + 1 - len(bounds))


def to_cells(v: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The cell of every component."""
    out = np.empty(v.shape, np.uint8)
    for d in range(v.shape[1]):
        out[:, d] = np.searchsorted(bounds[d, 1:-1], v[:, d], "right")
    return out


def pack(cells: np.ndarray, bits: int) -> np.ndarray:
    """Each row's cells as one run of ``bits``-bit numbers, in bytes."""
    each = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - bits:]
    return np.packbits(each.reshape(len(cells), -1), axis=1)


def unpack(packed: np.ndarray, dims: int, bits: int) -> np.ndarray:
    each = np.unpackbits(packed, axis=1)[:, :dims * bits].reshape(len(packed), dims, bits)
    return each @ (1 << np.arange(bits - 1, -1, -1))


def lookup(centroids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) squared difference of a component in (dimension, cell) and each centroid."""
    low, high = bounds[None, :, :-1], bounds[None, :, 1:] - 1
    c = centroids[:, :, None]
    far = np.maximum(np.abs(low - c), np.abs(high - c))
    near = np.maximum(np.maximum(low - c, c - high), 0)
    return near**2, far**2


def intervals(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, centroids): least and greatest possible distance."""
    k, dims, _ = tables[0].shape
    least, greatest = (np.zeros((len(cells), k), np.int64) for _ in range(2))
    for d in range(dims):
        least += tables[0][:, d, :].T[cells[:, d]]
        greatest += tables[1][:, d, :].T[cells[:, d]]
    return least, greatest


def decide(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster or -1, which centroids may be nearest) of every vector."""
    least, greatest = intervals(cells, tables)
    may = least <= greatest.min(axis=1, keepdims=True)
    return np.where(may.sum(axis=1) == 1, may.argmax(axis=1), -1), may


def nearest(v: np.ndarray, centroids: np.ndarray, may: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance), exact; among the centroids of ``may`` where given."""
    distance = np.full((len(v), len(centroids)), np.iinfo(np.int64).max)
    for c, centre in enumerate(centroids):
        rows = slice(None) if may is None else np.flatnonzero(may[:, c])
        distance[rows, c] = ((v[rows] - centre) ** 2).sum(axis=1)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(v)), best]


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _bytes(column: pa.Array) -> np.ndarray:
    """A column of equally long binaries as an array of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, BATCH):
            yield whole.slice(start, BATCH)


def _compress(bounds: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            packed = pack(to_cells(_vectors(batch.column("v"), len(bounds)), bounds), bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), batch.column("v"), pa.array([p.tobytes() for p in packed], pa.binary())],
                names=["row", "vec_id", "v", "cells"])

    return run


def _first(centroids: np.ndarray, bounds: np.ndarray, bits: int):
    """Every vector's cluster, cells and vector at hand: intervals first, overlaps measured."""
    tables = lookup(centroids, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            cluster, may = decide(unpack(_bytes(batch.column("cells")), len(bounds), bits), tables)
            v, open_ = _vectors(batch.column("v"), len(bounds)), np.flatnonzero(cluster < 0)
            cluster[open_] = nearest(v[open_], centroids, may[open_])[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("cells"), pa.array(cluster, pa.int32()), batch.column("v")], names=["row", "cells", "cluster", "v"])

    return run


def _by_cells(centroids: np.ndarray, bounds: np.ndarray, bits: int):
    """What the cells alone tell: the new cluster, or -1 and the mask of possible centroids."""
    tables = lookup(centroids, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            cluster, may = decide(unpack(_bytes(batch.column("cells")), len(bounds), bits), tables)
            mask = [m.tobytes() if c < 0 else None for m, c in zip(np.packbits(may, axis=1), cluster.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("cells"), batch.column("cluster"), pa.array(cluster, pa.int32()), pa.array(mask, pa.binary())],
                names=["row", "cells", "old", "cluster", "may"])

    return run


def _fetched(centroids: np.ndarray):
    """The cluster of every fetched vector; one that the cells decided is as they said."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            cluster = batch.column("cluster").to_numpy().copy()
            open_ = np.flatnonzero(cluster < 0)
            if len(open_):
                v = _vectors(batch.column("v").take(pa.array(open_)), centroids.shape[1])
                may = np.unpackbits(_bytes(batch.column("may").take(pa.array(open_))), axis=1)[:, :len(centroids)].astype(bool)
                cluster[open_] = nearest(v, centroids, may)[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("cells"), batch.column("old"), pa.array(cluster, pa.int32()), batch.column("v")],
                names=["row", "cells", "old", "cluster", "v"])

    return run


def _sums(k: int, dims: int):
    """Partial sums of a task: vectors enter ``cluster`` and leave ``old``; (cluster, place, total),
    place -1 for the count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in _slices(batches):
            v = np.concatenate([np.ones((batch.num_rows, 1), np.int64), _vectors(batch.column("v"), dims)], axis=1)
            for name, sign in (("cluster", 1), ("old", -1)):
                if name in batch.schema.names:
                    at = batch.column(name).to_numpy()
                    for c in np.unique(at):
                        total[c] += sign * v[at == c].sum(axis=0)
        c, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()), pa.array(place - 1, pa.int32()), pa.array(total[c, place], pa.int64())], names=["cluster", "place", "total"])

    return run


def _collected(rows: DataFrame, k: int, dims: int) -> np.ndarray:
    """The k x (1 + dims) sums, as Python integers of any size."""
    out = np.zeros((k, dims + 1), object)
    parts = rows.mapInArrow(_sums(k, dims), "cluster int, place int, total long")
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["cluster"], r["place"] + 1] = int(r["total"])
    return out


def _last(centroids: np.ndarray, bounds: np.ndarray, bits: int):
    """The last assignment with exact distances."""
    tables = lookup(centroids, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            _, may = decide(unpack(_bytes(batch.column("cells")), len(bounds), bits), tables)
            cluster, distance = nearest(_vectors(batch.column("v"), len(bounds)), centroids, may)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, bits: int = 6, sample: int = 4096,
            id_col: str = "vec_id", vec_col: str = "embedding", seed: str = "1:") -> tuple[DataFrame, np.ndarray, list[int]]:
    """(rows, centroids, fetched): vec_id, cluster and squared distance of every vector that takes part, the
    final centroids, and for each round after the first how many vectors were fetched."""
    spark = vectors.sparkSession
    if not 1 <= bits <= 8:
        raise ValueError("bits must be 1 to 8")
    # row numbers become data here: later joins and retries see the same ones
    full = materialize(
        vectors.select(F.col(id_col).alias("vec_id"), usable(F.col(vec_col), dims, scale).alias("v")).filter("v is not null")
        .withColumn("row", F.monotonically_increasing_id()), "va-vectors")
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = full.select("v").orderBy(key, "v").limit(k).collect()
    if not start:
        return spark.createDataFrame([], f"vec_id {full.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"), np.zeros((0, dims), np.int64), []
    centroids = np.array([r["v"] for r in start], np.int64)
    k = len(centroids)
    bounds = cell_bounds(full, dims, bits, sample)
    kind = full.schema["vec_id"].dataType.simpleString()
    file = materialize(full.mapInArrow(_compress(bounds, bits), f"row long, vec_id {kind}, v array<int>, cells binary"), "va-file")
    state, sums, fetched = None, np.zeros((k, dims + 1), object), []
    for _ in range(rounds):
        if state is None:
            # cells, vectors and clusters side by side: the sums of the first round
            placed = file.select("row", "cells", "v").mapInArrow(_first(centroids, bounds, bits), "row long, cells binary, cluster int, v array<int>")
            placed = materialize(placed, "va-first")
            state = placed.select("row", "cells", "cluster")
            sums += _collected(placed.select("cluster", "v"), k, dims)
        else:
            seen = materialize(state.mapInArrow(_by_cells(centroids, bounds, bits), "row long, cells binary, old int, cluster int, may binary"), "va-seen")
            wanted = seen.filter("cluster <> old")  # open (-1), or decided and moved
            got = materialize(wanted.join(file.select("row", "v"), "row").select("row", "cells", "old", "cluster", "may", "v").mapInArrow(
                _fetched(centroids), "row long, cells binary, old int, cluster int, v array<int>"), "va-fetched")
            fetched.append(got.count())
            sums += _collected(got.filter("cluster <> old").select("cluster", "old", "v"), k, dims)
            state = seen.filter("cluster = old").select("row", "cells", "cluster").unionByName(got.select("row", "cells", "cluster"))
        centroids = np.array([[int(s // sums[c, 0]) for s in sums[c, 1:]] if sums[c, 0] else centroids[c] for c in range(k)], np.int64)
    rows = file.select("vec_id", "cells", "v").mapInArrow(_last(centroids, bounds, bits), f"vec_id {kind}, cluster int, distance long")
    return rows, centroids, fetched


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    rows, centroids, _ = cluster(vectors, **options)
    rows = materialize(rows, "va-rows")
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    names = rows.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = rows.groupBy("cluster").agg(total.alias("cluster_inertia"))
    whole = rows.agg(total.alias("inertia"))
    # at most k rows
    facts = sums.join(F.broadcast(names), "cluster").withColumn("inertia", whole.scalar())
    return rows.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", F.expr("try_cast(cluster_inertia as bigint)").alias("cluster_inertia"),
        F.expr("try_cast(inertia as bigint)").alias("inertia"), "centroid_sha256")
