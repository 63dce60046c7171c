"""Near-duplicates by circulant MinHash.

Two permutations of the 64-bit words make every coordinate of a signature: the first scatters a set's shingles, the
second, shifted circularly by one place for each coordinate, ranks them. Documents that agree in all rows of a band are
candidates; candidates are verified on their full sets.

Documents of equal sets are one class from the start. In a bucket each class is first compared with one hub, so a bucket
of thousands of copies costs as many comparisons as it has members. Where a bucket's other members are then in more than
one component, those that are not in its largest one are compared with the others in blocks, each by one matrix product,
which emit a forest of links and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import emit_rows, raw
from millrace.llm.graph import components
from millrace.llm.shared import checkpointed, unique_name
from millrace.llm.words import WordHashes, mix, shingles, words

ROWS, BANDS = 5, 28
_BLOCK = 512


def signature(items: np.ndarray, size: int) -> np.ndarray:
    """The circulant MinHash signature of a set of 64-bit items."""
    with np.errstate(over="ignore"):
        placed = mix(items ^ np.uint64(0x5851F42D4C957F2D))
        shift = np.arange(size, dtype=np.uint64)
        best = np.full(size, np.uint64(2**64 - 1))
        for i in range(0, len(placed), _BLOCK):
            x = placed[i : i + _BLOCK, None] - shift[None, :]
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xCA5A826395121157)
            np.minimum(best, x.min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band."""
    with np.errstate(over="ignore"):
        parts = sig.reshape(-1, rows)
        key = np.arange(len(parts), dtype=np.uint64) + np.uint64(1)
        for i in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return key


def sketches(docs: DataFrame, *, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id, n, key, bands`` of each row: its set's size and digest, and its bands' keys; no set is empty but for no words."""

    def make():
        hashes = WordHashes()

        def fn(ids, col):
            if ids is None:
                return
            n, keys, bands = [], [], []
            for text in raw(col):
                s = shingles(hashes.of(words(text)), width)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(signature(s, ROWS * BANDS), ROWS).view(np.int64) if len(s) else None)
            yield [ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]

        return fn

    return emit_rows(docs, [id_col, text_col], "id long, n long, key binary, bands array<long>", make, portions=True)


def sets_of(docs: DataFrame, ids: DataFrame, *, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id, items``: the full sets of the documents of ``ids``."""

    def make():
        hashes = WordHashes()

        def fn(keys, col):
            if keys is not None:
                yield [keys.cast(pa.int64()), pa.array([shingles(hashes.of(words(t)), width).view(np.int64) for t in raw(col)], pa.list_(pa.int64()))]

        return fn

    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text")).join(ids, "id", "left_semi")
    return emit_rows(wanted, ["id", "__text"], "id long, items array<long>", make, portions=True)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets' intersection is at least ``percent`` hundredths of their union.

    Nothing is aggregated after the joins, so Spark can split what one key, a hub's, brings to a task. Where several sets
    share an id a pair may come more than once.
    """
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("__x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("items").alias("__y")), "b")
    common = F.size(F.array_intersect("__x", "__y"))
    return both.where(100 * common >= percent * (F.size("__x") + F.size("__y") - common)).select("a", "b")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``id, n_shingles, component, kept`` for every row of ``docs``.

    Rows without words, and rows with a null id, are linked with nothing and are their own component. The texts of rows
    that share an id belong together. An empty table gives none.
    """
    how = {"id_col": id_col, "text_col": text_col, "width": width}
    sketch = checkpointed(sketches(docs, **how))
    whole = sketch.where("n > 0 AND id IS NOT NULL")
    reps = checkpointed(whole.groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    entries = reps.select("rep", "n", F.explode("bands").alias("band"))
    hubs = entries.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub <> top").select("band")
    members = checkpointed(entries.join(hubs, "band").select("band", "rep", "n"))
    sets = checkpointed(sets_of(docs, members.select(F.col("rep").alias("id")).distinct(), **how))

    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    # A table of its own, so that the join with it can split what a large bucket brings to a task.
    hub = checkpointed(members.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("h")).select("band", F.col("h.rep").alias("hub"), F.col("h.n").alias("m")))
    pairs = members.join(hub, "band").where((F.col("rep") != F.col("hub")) & near(F.col("n"), F.col("m"))).select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    links = checkpointed(verified(pairs, sets, percent))
    labels = components(links)
    more = _apart(members, labels, sets, percent)
    if not more.isEmpty():
        labels = components(links.union(more))
    final = reps.select("key", "rep").join(labels.withColumnRenamed("vertex", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    out = sketch.select("id", "n", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(final, "key", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


#: Members of a block. A bucket of more is dealt out to several, and each two of them are compared in a task of their own.
BLOCK = 1024
_DENSE = 32_000_000


def _apart(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: a forest of the links between components that share a bucket and are not those of its hub.

    Buckets of the same members are looked at once. A bucket's hub has been compared with all of it and is left out. The
    others of its largest component are linked already: only the strays, all that are not in it, are compared, with them
    and with each other, block by block, each two blocks in a task of their own.
    """
    live = checkpointed(members.join(labels.select(F.col("vertex").alias("rep"), "component"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("comp")))
    same = F.bit_xor(F.xxhash64("rep"))
    parts = live.groupBy("band", "comp").agg(F.count("*").alias("n"), F.min("rep").alias("hub"), same.alias("x"))
    seen = parts.groupBy("band").agg(F.min("hub").alias("hub"), F.sum("n").alias("m"), F.bit_xor("x").alias("x"), F.max(F.struct("n", "comp")).alias("main"), F.count("*").alias("k")).where("k > 1 AND m > 2")
    seen = checkpointed(seen.groupBy("hub", "m", "x").agg(F.min("band").alias("band"), F.max("main").alias("main")))
    blocks = lambda n: F.greatest(F.lit(1).cast("long"), F.ceil(n / BLOCK)).cast("long")
    each = live.join(seen, "band").where("rep <> hub").withColumn("stray", F.col("comp") != F.col("main.comp"))
    each = each.withColumns({"strays": blocks(F.col("m") - F.col("main.n")), "mains": blocks(F.col("main.n"))})
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("mains")))
    each = each.withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    # Blocks j of the main component are 0 and up, those of strays -1 and down.
    beside = F.transform(upto("mains"), lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))
    among = F.transform(upto("strays"), lambda j: F.struct(F.least("own", j).alias("i"), (-1 - F.greatest("own", j)).alias("j")))
    of_main = F.transform(upto("strays"), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))
    each = each.select("rep", "comp", "band", F.explode(F.when(F.col("stray"), F.concat(beside, among)).otherwise(of_main)).alias("at")).select("rep", "comp", "band", "at.i", "at.j")
    full = each.join(sets.select(F.col("id").alias("rep"), "items"), "rep").select("band", "i", "j", "rep", "comp", "items")
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = full.repartition(tasks, "band", "i", "j").sortWithinPartitions("band", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def done() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            a, b = linked(rows["rep"].to_numpy(), rows["comp"].to_numpy(), rows["items"].to_numpy(zero_copy_only=False), percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch[c].to_numpy() for c in ("band", "i", "j")], 1)
            cuts = [0, *(np.nonzero((marks[1:] != marks[:-1]).any(1))[0] + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and tuple(held[0][c][0].as_py() for c in ("band", "i", "j")) != tuple(marks[lo].tolist()):
                    yield done()
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield done()

    return checkpointed(dealt.mapInArrow(run, "a long, b long"))


def linked(reps: np.ndarray, comps: np.ndarray, items: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between sets of different components, as two arrays of ends. Only those that are not in the
    component of most are compared with all."""
    n = len(reps)
    kinds, which, often = np.unique(comps, return_inverse=True, return_counts=True)
    if n < 2 or len(kinds) < 2:
        return reps[:0], reps[:0]
    strays = np.flatnonzero(which != np.argmax(often))
    size = np.array([len(x) for x in items])
    owner = np.repeat(np.arange(n), size)
    _, code, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    width = int(code.max()) + 1 if len(code) else 0
    common = np.zeros((len(strays), n), np.float32)
    step = max(1, _DENSE // n)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for lo in range(0, width, step):
        at = slice(*np.searchsorted(code, [lo, lo + step]))
        held = np.zeros((n, min(step, width - lo)), np.float32)
        held[owner[at], code[at] - lo] = 1
        common += held[strays] @ held.T
    i, j = np.nonzero((100 * common >= percent * (size[strays][:, None] + size[None, :] - common)) & (comps[strays][:, None] != comps[None, :]))
    i = strays[i]
    by = np.argsort(reps, kind="stable")
    low = np.empty(n, np.int64)
    low[by] = np.arange(n)
    start = low.copy()
    while True:
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = np.minimum(low, low[by[low]])
        if (before == low).all():
            break
    moved = low != start
    return reps[moved], reps[by[low[moved]]]


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are not their component's smallest id; rows that share an id go together."""
    mine = unique_name("gone")
    gone = classes(docs, id_col=id_col, text_col=text_col, width=width, percent=percent).where(~F.col("kept")).select(F.col("id").alias(mine)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(mine), "left_anti")
