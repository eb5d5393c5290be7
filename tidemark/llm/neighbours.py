"""Most similar vectors for every vector: sharded robust-pruned graphs.

1. Usable vectors are brought to unit length; vectors that point the same way form one class and are indexed once.
2. Cells are centred on a k-means of a bounded sample.  A class is a member of its ``assign`` nearest cells and a
   query of its ``probe`` nearest ones.  A cell with more than one and a half times ``shard_rows`` members is
   split by a k-means of its own, and so on, so the number of cells grows with the table and with its dense
   regions, and a query visits a number of cells that grows with the depth alone.
3. Each cell builds its graph and beam-searches its queries.  The queries of a cell are cut into slices, each with
   the members beside it, so that one vectorised task holds at most ``1.5 shard_rows`` members and about
   ``SLICE`` times ``shard_rows`` queries.
4. The answers of a query's cells are merged, and classes are unfolded into ids.

No bound drops a vector: the samples only place the centres.  Vectors so close that eight levels of cells cannot
part them are cut by hash, and each is then compared with those of its own part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import vamana
from tidemark.runtime import Scratch

#: Vectors from which the centres of a dimension, or of a cell that is split, are fitted.
SAMPLE_ROWS = 20_000
SHARD_ROWS = 4_096
#: Cells that a dimension or a cell is split into at once, and levels of splits.
FANOUT, DEPTH = 256, 8
ASSIGN, PROBE = 2, 5
#: Queries of one task, in shards.
SLICE = 4
#: Cells whose sizes are broadcast; the sizes of more are joined by a shuffle.
BROADCAST_CELLS = 100_000


def _flat(col: pa.ChunkedArray | pa.Array) -> pa.Array:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return _flat(col).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, dim, key, unit of every usable row.

    Usable: not null, as long as ``dim``, all finite, not all zero.  ``key`` is a digest of the unit vector to six
    places.
    """
    schema = pa.schema([("id", pa.string()), ("dim", pa.int32()), ("key", pa.binary()), ("unit", pa.list_(pa.float32()))])
    for b in batches:
        vec = b["vec"]
        size = np.diff(vec.offsets.to_numpy())
        size = np.where(vec.is_null().to_numpy(zero_copy_only=False), -1, size)
        dims = b["dim"].fill_null(-2).to_numpy()
        for dim in np.unique(dims[(dims > 0) & (dims == size)]):
            at = pa.array(np.flatnonzero((dims == dim) & (size == dim)))
            x = vec.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, int(dim))
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            x, at = x[good], at.filter(pa.array(good))
            # by the largest part first, so that no square over- or underflows
            x /= np.abs(x).max(1, keepdims=True, initial=0)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            rounded = np.rint(x * 1e6).astype(np.int32)
            keys = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in rounded]
            unit = pa.ListArray.from_arrays(np.arange(0, x.size + 1, int(dim), dtype=np.int32), pa.array(x.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b["id"].take(at), pa.array(np.full(len(at), dim, np.int32)), pa.array(keys, pa.binary()), unit], schema=schema)


def classes(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, dim, key of every usable id; key, dim, unit of every class)."""
    v = vectors.select(F.col("id").cast("string").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.col("dim").cast("int").alias("dim"))
    rows, _ = scratch.put(v.filter("id is not null and vec is not null and dim > 0").mapInArrow(_units, "id string, dim int, key binary, unit array<float>"), "rows")
    ids, _ = scratch.put(rows.groupBy("id").agg(F.min(F.struct("dim", "key")).alias("v"), F.max(F.struct("dim", "key")).alias("w")).select("id", "v.dim", "v.key", (F.col("v") != F.col("w")).alias("torn")), "ids")
    if ids.filter("torn").limit(1).count():  # rows of one id that differ: only the one that counts is indexed
        rows = rows.join(ids.select("id", "dim", "key"), ["id", "dim", "key"], "left_semi")
    units, _ = scratch.put(rows.groupBy("key").agg(F.min("dim").alias("dim"), F.min_by("unit", "id").alias("unit")), "units")
    return ids.select("id", "dim", "key"), units


def _centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of a k-means by Euclidean distance."""
    rng = np.random.default_rng(0)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        own = np.concatenate([_nearest(sample[i : i + 4096], c, 1)[:, 0] for i in range(0, len(sample), 4096)])
        count = np.bincount(own, minlength=len(c))[:, None]
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(count[:, 0])
        sums = np.zeros(c.shape, np.float64)
        if len(at):
            starts = np.concatenate([[0], np.cumsum(count[at, 0])[:-1]])
            sums[at] = np.add.reduceat(sample[order].astype(np.float64), starts, axis=0)
        c = np.where(count > 0, sums / np.maximum(count, 1), c).astype(np.float32)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, how_many: int) -> np.ndarray:
    """Numbers of the nearest centres of each row, nearest first.  Seen from the centres' mean, so that near ones part."""
    mid = c.mean(0)
    y = c - mid
    score = (x - mid) @ y.T - (y * y).sum(1) / 2
    if how_many == 1:
        return score.argmax(1)[:, None]
    return np.argsort(-score, axis=1, kind="stable")[:, :how_many]


def _child(cell: int, sub: np.ndarray) -> np.ndarray:
    """Numbers of cells inside a cell, as in a heap: no two cells of any level share one."""
    return cell * FANOUT + 1 + sub


_PLACED = "key binary, dim int, unit array<float>, cell bigint, a int, p int"
_PLACED_SCHEMA = pa.schema([("key", pa.binary()), ("dim", pa.int32()), ("unit", pa.list_(pa.float32())), ("cell", pa.int64()), ("a", pa.int32()), ("p", pa.int32())])


def _place(t: pa.Table | pa.RecordBatch, centres: np.ndarray, cell: int, a: np.ndarray, p: np.ndarray) -> pa.Table:
    """Rows sent on into the cells inside a cell; the n-th nearest one is allowed n less of what the row was allowed."""
    dim = centres.shape[1]
    best = _nearest(_matrix(t["unit"], dim), centres, int(max(a.max(), p.max())))
    place = np.arange(best.shape[1])
    left_a, left_p = np.maximum(a[:, None] - place, 0), np.maximum(p[:, None] - place, 0)
    r, c = np.nonzero((left_a > 0) | (left_p > 0))
    at = pa.array(r)
    cols = [_flat(t[n]).take(at) for n in ("key", "dim", "unit")]
    return pa.Table.from_arrays([*cols, pa.array(_child(cell, best[r, c])), pa.array(left_a[r, c].astype(np.int32)), pa.array(left_p[r, c].astype(np.int32))], schema=_PLACED_SCHEMA)


def _first_cells(centres: dict[int, tuple[int, np.ndarray]], assign: int, probe: int):
    def run(batches):
        for b in batches:
            dims = b["dim"].to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                root, c = centres[int(dim)]
                part = pa.RecordBatch.from_arrays([b[n].take(pa.array(at)) for n in ("key", "dim", "unit")], ["key", "dim", "unit"])
                yield from _place(part, c, root, np.full(len(at), assign), np.full(len(at), probe)).to_batches()

    return run


def _fit_cell(shard_rows: int):
    def run(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        c = _centres(_matrix(t["unit"], dim), min(FANOUT, -(-t["n"][0].as_py() // shard_rows)))
        return pa.table({"cell": pa.array([t["cell"][0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()), "centres": pa.array([c.ravel().tolist()], pa.list_(pa.float32()))})

    return run


def _split_cell(rows: pa.Table, centres: pa.Table) -> pa.Table:
    if not rows.num_rows or not centres.num_rows:
        return _PLACED_SCHEMA.empty_table()
    c = _matrix(centres["centres"], centres["dim"][0].as_py())
    return _place(rows, c, rows["cell"][0].as_py(), rows["a"].to_numpy(), rows["p"].to_numpy())


def place_in_cells(units: DataFrame, scratch: Scratch, *, assign: int, probe: int, shard_rows: int, sample_rows: int) -> DataFrame | None:
    """key, dim, unit, cell, a, p: every class in its cells, as a member where a > 0 and as a query where p > 0."""
    sizes = {r["dim"]: r["n"] for r in units.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    centres = {}
    for root, (dim, n) in enumerate(sorted(sizes.items()), 1):
        by_hash = units.filter(F.col("dim") == dim).select("unit", "key").orderBy(F.xxhash64("key"), "key").limit(sample_rows).select("unit")
        centres[dim] = (root, _centres(_matrix(by_hash.toArrow()["unit"], dim), min(FANOUT, -(-n * assign // shard_rows))))
    placed, _ = scratch.put(units.mapInArrow(_first_cells(centres, assign, probe), _PLACED), "placed0")
    done: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        members = placed.filter("a > 0").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        large = members.filter(F.col("n") > 1.5 * shard_rows)
        n_large = large.count()
        if not n_large:
            break
        large, _ = scratch.put(large.withColumn("parts", F.ceil(F.col("n") / (8 * shard_rows)).cast("int")), f"large{depth}")
        sized = F.broadcast(large) if n_large <= BROADCAST_CELLS else large
        done.append(placed.join(F.broadcast(large.select("cell")) if n_large <= BROADCAST_CELLS else large.select("cell"), "cell", "left_anti").select("key", "dim", "unit", "cell", "a", "p"))
        open_ = placed.join(sized, "cell")
        # a share of each cell by hash, about ``sample_rows``
        share = F.pmod(F.xxhash64("key", F.lit(depth)), F.lit(1 << 20)) < F.lit(float(1 << 20)) * sample_rows / F.col("n")
        fitted, _ = scratch.put(open_.filter((F.col("a") > 0) & share).select("cell", "n", "dim", "unit").groupBy("cell").applyInArrow(_fit_cell(shard_rows), "cell bigint, dim int, centres array<float>"), f"centres{depth}")
        part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
        sent = fitted.join(sized, "cell").select("cell", "dim", "centres", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        left = open_.select("key", "dim", "unit", "cell", "a", "p", part.alias("part")).groupBy("cell", "part")
        placed, _ = scratch.put(left.cogroup(sent.groupBy("cell", "part")).applyInArrow(_split_cell, _PLACED), f"placed{depth}")
    for d in done:
        placed = placed.unionByName(d)
    return placed


def _search_shard(k: int, degree: int, beam: int):
    def run(t: pa.Table) -> pa.Table:
        schema = pa.schema([("key", pa.binary()), ("near", pa.binary()), ("cos", pa.float64())])
        member, query = (np.flatnonzero(t[c].to_numpy(zero_copy_only=False)) for c in ("member", "query"))
        if not len(member) or not len(query):
            return schema.empty_table()
        x = _matrix(t["unit"], t["dim"][0].as_py())
        keys = _flat(t["key"])
        points = x[member]
        place = np.full(len(x), -1, np.int64)
        place[member] = np.arange(len(member))
        graph, entries = vamana.build(points, degree=degree, beam=beam)
        out = []
        for i in range(0, len(query), vamana.BATCH):
            q = query[i : i + vamana.BATCH]
            start = np.concatenate([np.broadcast_to(entries, (len(q), len(entries))), place[q][:, None]], 1)
            ids, _ = vamana.beam_search(points, graph, x[q], start, beam)
            ids = np.where(ids == place[q][:, None], -1, ids)
            r, c = np.nonzero(ids >= 0)
            a, b = q[r], member[ids[r, c]]
            cos = np.einsum("ij,ij->i", x[a].astype(np.float64), x[b].astype(np.float64))
            # the first k of each query; found points come in descending order
            n = np.arange(len(r)) - np.searchsorted(r, r)
            keep = n < k
            out.append(pa.table([keys.take(pa.array(a[keep])), keys.take(pa.array(b[keep])), pa.array(cos[keep])], schema=schema))
        return pa.concat_tables(out)

    return run


def shards(placed: DataFrame, scratch: Scratch, shard_rows: int) -> DataFrame:
    """cell, shard, slice, key, dim, unit, member, query: the groups that are searched, each of bounded size.

    A shard is a cell but where members cannot be parted.  The members of a shard stand in each of its slices, and
    a query in one of them.
    """
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.when(F.col("a") > 0, 1)) / (1.5 * shard_rows)).alias("n_shards"), F.count(F.when(F.col("p") > 0, 1)).alias("n_queries"))
    sizes = sizes.select("cell", F.greatest("n_shards", F.lit(1)).cast("int").alias("n_shards"), "n_queries")
    sizes, n_cells = scratch.put(sizes.select("cell", "n_shards", F.ceil(F.col("n_queries") / F.col("n_shards") / (SLICE * shard_rows)).cast("int").alias("n_slices")), "sizes")
    sent = placed.join(F.broadcast(sizes) if n_cells <= BROADCAST_CELLS else sizes, "cell")
    own = F.pmod(F.xxhash64("key", F.lit(1)), F.greatest("n_slices", F.lit(1))).cast("int")
    sent = sent.withColumn("own", own).withColumn("slice", F.explode(F.when(F.col("a") > 0, F.sequence(F.lit(0), F.greatest("n_slices", F.lit(1)) - 1)).otherwise(F.array("own"))))
    return sent.select("cell", F.pmod(F.xxhash64("key"), F.col("n_shards")).cast("int").alias("shard"), "slice", "key", "dim", "unit", (F.col("a") > 0).alias("member"), ((F.col("p") > 0) & (F.col("slice") == F.col("own"))).alias("query"))


def class_neighbours(units: DataFrame, scratch: Scratch, *, k: int, assign: int = ASSIGN, probe: int = PROBE, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS, degree: int = vamana.DEGREE, beam: int = vamana.BEAM) -> DataFrame:
    """key, near, cos, rank: the k most similar other keys of every key; ties of cosine by key."""
    placed = place_in_cells(units, scratch, assign=assign, probe=probe, shard_rows=shard_rows, sample_rows=sample_rows)
    if placed is None:
        return scratch.spark.createDataFrame([], "key binary, near binary, cos double, rank int")
    sent = shards(placed, scratch, shard_rows)
    found = sent.groupBy("cell", "shard", "slice").applyInArrow(_search_shard(k, degree, beam), "key binary, near binary, cos double")
    found = found.groupBy("key", "near").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("cos").desc(), "near"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def neighbours(vectors: DataFrame, *, k: int = 5, min_cos: float = -1.0, **how) -> DataFrame:
    """id, near, cos, rank: for every usable id up to k most similar other ids of the same dimension.

    ``vectors``: id string, vec array, dim int; other columns are ignored.  Usable: vec not null, as long as
    dim, all finite, not all zero; the rest gives no row.  An id counts once; of rows of one id that differ the
    smallest (dim, digest of the unit vector) counts.  Ids whose vectors point the same way (to six places) are neighbours of cosine
    1, nearest in order of id; each lists at most k of them, so a group of n copies gives at most k n rows.
    An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    all_ids, units = classes(vectors, scratch)
    near = class_neighbours(units, scratch, k=k, **how).filter(F.col("cos") >= min_cos)
    # of each class the k + 1 first ids, ranked within salts first: a class may be any share of the table
    salted = all_ids.select("key", "id").withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(32)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy("key", "_s").orderBy("id"))).filter(F.col("_r") <= k + 1)
    firsts, _ = scratch.put(few.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("place") <= k + 1).select("key", F.col("id").alias("first_id"), "place"), "firsts")
    # only classes of several ids have rows here
    listed = firsts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "first_id"))).alias("firsts"), F.count(F.lit(1)).alias("n"))
    copies = listed.filter("n > 1").select("key", F.transform("firsts", lambda s: s["first_id"]).alias("mates"))
    ids = all_ids.select("id", "key").join(copies, "key", "left")
    own = F.slice(F.array_remove(F.coalesce("mates", F.array().cast("array<string>")), F.col("id")), 1, k)
    own_rows = ids.withColumn("own", own)
    inside = own_rows.select("id", F.posexplode("own").alias("pos", "near")).select("id", "near", F.lit(1.0).alias("cos"), F.col("pos").cast("bigint").alias("order"))
    others = (
        near.join(listed.select(F.col("key").alias("near"), F.transform("firsts", lambda s: s["first_id"]).alias("their")), "near")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "cos", "their"))).alias("near"))
    )
    outside = (
        own_rows.select("id", "key", F.size("own").alias("taken"))
        .filter(F.col("taken") < k)
        .join(others, "key")
        .select("id", "taken", F.explode("near").alias("c"))
        .select("id", "taken", "c.rank", "c.cos", F.posexplode("c.their").alias("pos", "near"))
        .select("id", "near", "cos", (F.lit(k) + F.col("rank") * (k + 2) + F.col("pos")).cast("bigint").alias("order"))
    )
    every = inside.unionByName(outside)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("order"))
    return every.filter(F.col("cos") >= min_cos).withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "near", F.col("cos"), "rank")


def similar_pairs(vectors: DataFrame, *, k: int = 5, min_cos: float = 0.8, **how) -> DataFrame:
    """id_a < id_b: pairs in which one is among the other's k most similar and the cosine is at least ``min_cos``."""
    n = neighbours(vectors, k=k, min_cos=min_cos, **how)
    return n.select(F.least("id", "near").alias("id_a"), F.greatest("id", "near").alias("id_b")).distinct()
