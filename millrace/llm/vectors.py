"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

A vector is rotated by sign changes and Hadamard transforms and hashed to the axis it then lies nearest to; some such
axes make a bucket of a table. Each vector is also put in the buckets of its next best axes (multiprobe). Members of a
bucket are compared in blocks by matrix products in double precision, and a link is counted only in the first bucket
that its two ends share, so the blocks emit counts and a forest of links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.arrow import emit_rows
from millrace.llm.graph import components
from millrace.llm.shared import checkpointed

PROBES = 4
BLOCK = 2048
SPREAD = 0.25


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        step *= 2
    return x


def buckets(x: np.ndarray, tables: int, axes: int, seed: int = 0) -> np.ndarray:
    """Keys of each unit vector's buckets, as (vectors, tables, probes): first its own, then the next best by one axis.

    Keys begin with the table's number, so that they order by table.
    """
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    rng = np.random.default_rng([seed, size])
    out = np.empty((n, tables, PROBES), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        codes, seconds, losses = [], [], []
        for _ in range(axes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            strength = np.abs(y)
            order = np.argpartition(-strength, min(3, size - 1), axis=1)[:, : min(4, size)]
            order = np.take_along_axis(order, np.argsort(-np.take_along_axis(strength, order, 1), axis=1, kind="stable"), 1)
            code = lambda j: 2 * order[:, j] + (y[rows, order[:, j]] < 0)  # noqa: E731, B023
            codes.append(code(0))
            best = strength[rows, order[:, 0]]
            for j in range(1, order.shape[1]):
                seconds.append((len(codes) - 1, code(j)))
                losses.append((best - strength[rows, order[:, j]]) / np.maximum(best, 1e-300))
        own = np.stack(codes, 1)
        picks = np.argsort(np.stack(losses, 1), axis=1, kind="stable")[:, : PROBES - 1]
        keys = [own]
        for p in range(PROBES - 1):
            probe = own.copy()
            if p < picks.shape[1]:
                for i, (axis, alt) in enumerate(seconds):
                    at = picks[:, p] == i
                    probe[at, axis] = alt[at]
            keys.append(probe)
        for p, key in enumerate(keys):
            h = np.full(n, np.uint64(d))  # vectors of different lengths share no bucket
            with np.errstate(over="ignore"):
                h *= np.uint64(0xD1342543DE82EF95)
                h ^= h >> np.uint64(29)
                for a in range(axes):
                    h = (h + key[:, a].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
            out[:, t, p] = (np.int64(t) << np.int64(52)) | (h >> np.uint64(12)).astype(np.int64)
    return out


def shape(count: int, dim: int) -> tuple[int, int]:
    """Axes of a bucket and number of tables: at any count few unrelated vectors share a bucket, so few are sent for
    comparison, and a pair of cosine 0.9 is missed by all tables about once in a thousand."""
    size = 1 << max(1, (max(dim, 2) - 1).bit_length())
    axes = max(1, math.ceil(math.log(max(count, 1) / SPREAD + 1) / math.log(2 * size)))
    tables = {1: 3, 2: 6, 3: 12}.get(axes, 8 * axes - 8)
    return axes, tables + (tables // 4 if size > 256 else 0)


def _by_length(vectors: pa.Array):
    """For each length of vectors, their places and their values as a matrix; null lists have none, null values are NaN."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    values = pc.fill_null(vectors.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    start = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == dim)
        yield at, values[start[at][:, None] + np.arange(dim)[None, :]]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their magnitude; a row's result does not depend on the others."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, key, vec`` of the vectors that are neither null nor zero and hold finite values alone; of the type they have."""
    kind = vectors.schema[vec_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    stored = pa.list_(pa.float32() if single else pa.float64())

    def make():
        def fn(ids, vecs):
            if ids is None:
                return
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            for at, x in _by_length(vecs):
                ok = known[at] & np.isfinite(x).all(1) & x.any(1)
                at, x = pa.array(at[ok]), np.ascontiguousarray(x[ok]) + 0.0  # -0.0 is 0.0
                yield [ids.take(at).cast(pa.int64()), pa.array([xxhash.xxh3_128_digest(v.tobytes()) for v in x], pa.binary()), vecs.take(at).cast(stored)]

        return fn

    return emit_rows(vectors, [id_col, vec_col], f"id long, key binary, vec array<{'float' if single else 'double'}>", make)


def _placed(reps: DataFrame, tables: int, axes: int) -> DataFrame:
    def make():
        def fn(ids, vecs):
            if ids is None:
                return
            for at, x in _by_length(vecs):
                b = buckets(unit(x), tables, axes).reshape(len(at), -1)
                yield [ids.take(pa.array(at)), pa.array(list(b), pa.list_(pa.int64()))]

        return fn

    return emit_rows(reps, ["rep", "vec"], "rep long, buckets array<long>", make)


def _compare(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, keys: np.ndarray, side: np.ndarray, bucket: int, least: float, two: bool):
    """Counts and a forest of the links whose first shared bucket this is. With ``two`` sides only links across count."""
    n, table = len(ids), bucket >> 52
    counts, label = np.zeros(n, np.int64), np.arange(n)
    pairs_i, pairs_j = [], []
    for lo in range(0, n, 512):
        close = x[lo : lo + 512] @ x.T >= least
        i, j = np.nonzero(close)
        i += lo
        ok = i < j
        if two:
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        for at in range(0, len(i), 20000):
            p, q = i[at : at + 20000], j[at : at + 20000]
            # Most close pairs share a bucket of the first tables, and go at once.
            for t in range(int(table)):
                if not len(p):
                    break
                new = ~(keys[p, t][:, :, None] == keys[q, t][:, None, :]).any((1, 2))
                p, q = p[new], q[new]
            a, b = keys[p, int(table)], keys[q, int(table)]
            lowest = np.where((a[:, :, None] == b[:, None, :]).any(2), a, np.iinfo(np.int64).max).min(1)
            own = lowest == bucket
            pairs_i.append(p[own])
            pairs_j.append(q[own])
    if not pairs_i:
        return counts, label
    i, j = np.concatenate(pairs_i), np.concatenate(pairs_j)
    np.add.at(counts, i, copies[j])
    np.add.at(counts, j, copies[i])
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_id] = np.arange(n)
    low = rank.copy()
    while len(i):
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = np.minimum(low, low[by_id[low]])
        if (before == low).all():
            break
    return counts, by_id[low]


def _blocks(entries: DataFrame, least: float) -> DataFrame:
    """``kind, a, b`` from entries sorted by block: kind 0 has a vertex and a count, kind 1 a link of the forest.

    Blocks are told apart as sorted rows stream by, so no more than one block and one batch is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def done(b: pa.RecordBatch) -> pa.RecordBatch | None:
            bucket, lo, hi = b["bucket"][0].as_py(), b["i"][0].as_py(), b["j"][0].as_py()
            if b.num_rows < 2:
                return None
            ids, copies, side = (b[c].to_numpy() for c in ("rep", "copies", "side"))
            x = unit(np.stack(b["vec"].to_numpy(zero_copy_only=False)).astype(np.float64))
            keys = np.stack(b["buckets"].to_numpy(zero_copy_only=False)).reshape(len(ids), -1, PROBES)
            counts, label = _compare(ids, copies, x, keys, side, bucket, least, lo != hi)
            v, e = counts > 0, label != np.arange(len(ids))
            kind = np.concatenate([np.zeros(v.sum(), np.int32), np.ones(e.sum(), np.int32)])
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([ids[v], ids[e]])), pa.array(np.concatenate([counts[v], ids[label[e]]]))], ["kind", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch[c].to_numpy() for c in ("bucket", "i", "j")], 1)
            cuts = [0, *(np.nonzero((marks[1:] != marks[:-1]).any(1))[0] + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                part = batch.slice(lo, hi - lo)
                if held and tuple(held[0][c][0].as_py() for c in ("bucket", "i", "j")) != tuple(marks[lo].tolist()):
                    if out := done(_joined(held)):
                        yield out
                    held = []
                held.append(part)
        if held and (out := done(_joined(held))):
            yield out

    return entries.mapInArrow(run, "kind int, a long, b long")


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def links(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, block: int = BLOCK) -> DataFrame:
    """``id, n_links, component, kept`` for every row of ``vectors``.

    Vectors that are null, zero, or hold nulls or values that are not finite, and rows with a null id, are linked with
    nothing. Vectors of different lengths are never linked. Equal vectors are one class, compared once. Rows that share
    an id count as so many vectors and lie in the components of their vectors. Other columns, whatever their names, are not
    looked at. An empty table gives none.

    Ids alone are dealt out by buckets; a vector is sent once for each bucket, or block of one, that it shares with another.
    """
    usable = checkpointed(_usable(vectors, id_col, vec_col))
    reps = checkpointed(usable.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")))
    usable = usable.select("id", "key")
    count, dim = reps.agg(F.count("*"), F.max(F.size("vec"))).first()
    axes, tables = shape(count, dim or 2)
    placed = checkpointed(_placed(reps, tables, axes))
    each = placed.select("rep", F.explode(F.array_distinct("buckets")).alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").withColumn("g", F.ceil(F.col("m") / block))
    entries = each.join(shared.select("bucket", "g"), "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("g")))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    entries = entries.select("rep", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"))
    full = entries.join(placed, "rep").join(reps.select("rep", "copies", "vec"), "rep")
    # A bucket's block asks for the buckets of its own table and of those before it.
    keys = F.slice("buckets", F.lit(1), (F.shiftright("bucket", 52).cast("int") + 1) * PROBES)
    full = full.select("bucket", "i", "j", "side", "rep", "copies", "vec", keys.alias("buckets"))
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = checkpointed(_blocks(full.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"), least))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("linked"))
    labels = components(found.where("kind = 1").select("a", "b"))
    known = reps.select("key", "rep", "copies").join(counts, "rep", "left").join(labels.withColumnRenamed("vertex", "rep"), "rep", "left")
    known = known.select("key", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    by_id = usable.select("id", "key").join(known, "key").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = vectors.select(F.col(id_col).cast("long").alias("id")).join(by_id, "id", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
