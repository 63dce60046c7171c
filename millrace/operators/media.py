"""Video scenes and slices, hashes, sampling, and dealing blocks to ranks. Probing and cutting files is left to the caller's
functions; all that follows from their numbers is column expressions."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalar import fraction


_FRAMES = "struct<frames:array<struct<pts_time:string>>>"
_META = "struct<streams:array<struct<width:int,height:int,avg_frame_rate:string>>,format:struct<duration:string>>"


def boundaries_of(probed: Column) -> Column:
    """The times of the frames in a scene probe's JSON, ascending; frames without one, or with one that is none, go."""
    times = F.transform(F.from_json(probed, _FRAMES)["frames"], lambda f: f["pts_time"].try_cast("double"))
    return F.array_sort(F.coalesce(F.filter(times, lambda t: t.isNotNull()), F.array().cast("array<double>")))


def metadata_of(probed: Column) -> Column:
    """``width, height, fps, duration_sec`` of a metadata probe's JSON: of the first stream, null where it says nothing;
    the rate of ``0/0``, or over zero, is null."""
    x = F.from_json(probed, _META)
    first = F.get(x["streams"], 0)
    return F.struct(first["width"].alias("width"), first["height"].alias("height"), fraction(first["avg_frame_rate"]).alias("fps"), x["format"]["duration"].try_cast("double").alias("duration_sec"))


def probed(df: DataFrame, path: str, probe: Callable[[str], str | None], into: str) -> DataFrame:
    """``df`` with what ``probe`` says of each path (its JSON), null for null paths. The probe is the caller's, say a
    process that reads the file; a failure fails the job. It runs once a distinct path of a batch."""
    out = T.StructType([*df.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(path).to_pylist()
            said = {p: probe(p) for p in dict.fromkeys(paths) if p is not None}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([said.get(p) for p in paths], pa.string())], [*b.schema.names, into])

    return df.mapInArrow(run, out)


def _number(data: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, at, size)), 16, 10).cast("long")


def image_facts(content: Column) -> Column:
    """``format, width, height, size_bytes, sha256`` of an image's bytes, by its header: PNG and GIF sizes are read from it,
    JPEG and WEBP are told by name alone; other bytes have a null format."""
    head = F.hex(F.substring(content, 1, 12))
    png, gif = head.startswith("89504E470D0A1A0A"), head.startswith("474946383761") | head.startswith("474946383961")
    kind = F.when(png, "PNG").when(gif, "GIF").when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("52494646") & head.endswith("57454250"), "WEBP")
    little = lambda at: _number(content, at, 1) + 256 * _number(content, at + 1, 1)
    return F.struct(
        kind.alias("format"), F.when(png, _number(content, 17, 4)).when(gif, little(7)).alias("width"), F.when(png, _number(content, 21, 4)).when(gif, little(9)).alias("height"),
        F.octet_length(content).cast("long").alias("size_bytes"), F.sha2(content, 256).alias("sha256"),
    )


def fitted(width: Column, height: Column, most: int) -> Column:
    """``width, height`` after a resize to a largest dimension: the longer side becomes it, the other keeps the ratio and
    is 1 at least; smaller images stay."""
    long = F.greatest(width, height)
    side = lambda x: F.when(long <= most, x.cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(x * F.lit(float(most)) / long + 0.5)))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def good_image(width: Column, height: Column, blur: Column, brightness: Column, *, min_width: int = 100, min_height: int = 100, min_blur: float = 50.0, darkest: float = 30.0, brightest: float = 220.0) -> Column:
    """Whether an image is large, sharp and neither dark nor overexposed; what was not measured does not pass."""
    return F.coalesce((width >= min_width) & (height >= min_height) & (blur >= min_blur) & brightness.between(darkest, brightest), F.lit(False))


def or_row(probed: Column, own: Column) -> Column:
    """A probed value, or the row's own where it is null or zero."""
    return F.coalesce(F.when(probed != 0, probed), F.when(own != 0, own))


def scenes_of(boundaries: Column, duration: Column, min_length: Column | float) -> Column:
    """An array of ``(start, end)`` scenes from boundary times, in any order.

    Times are clamped between the last cut and the end; a boundary cuts only if the scene it ends is long enough, and so
    does the end: a short last scene is dropped. Without any scene the whole is one. Times have three decimals.
    """
    least = F.lit(min_length) if isinstance(min_length, float) else min_length
    total = duration.cast("double")
    start = F.struct(F.lit(0.0).alias("at"), F.array().cast("array<struct<start:double,end:double>>").alias("done"))

    def cut(state: Column, time: Column) -> Column:
        t = F.least(F.greatest(time, state["at"]), total)
        scene = F.struct(F.round(state["at"], 3).alias("start"), F.round(t, 3).alias("end"))
        return F.when(t - state["at"] >= least, F.struct(t.alias("at"), F.concat(state["done"], F.array(scene)).alias("done"))).otherwise(state)

    def finish(state: Column) -> Column:
        tail = F.struct(F.round(state["at"], 3).alias("start"), F.round(total, 3).alias("end"))
        done = F.when(total - state["at"] >= least, F.concat(state["done"], F.array(tail))).otherwise(state["done"])
        whole = F.array(F.struct(F.lit(0.0).alias("start"), F.round(total, 3).alias("end")))
        return F.when(F.size(done) == 0, whole).otherwise(done)

    times = F.filter(F.coalesce(boundaries.cast("array<double>"), F.array().cast("array<double>")), lambda x: x.isNotNull())
    return F.aggregate(F.array_sort(times), start, cut, finish)


def scene_rows(df: DataFrame, boundaries: str = "boundaries", duration: str = "duration_sec", min_length: float = 0.5, index_col: str | None = None) -> DataFrame:
    """One row a scene: ``scene_index, scene_start, scene_end, scene_duration, scene_count``, and the rank of its slice."""
    length = F.coalesce(F.when(F.col(duration) != 0, F.col(duration)), F.lit(min_length))
    out = df.withColumn("__scenes", scenes_of(F.col(boundaries), length, min_length))
    out = out.select(*df.columns, F.size("__scenes").alias("scene_count"), F.posexplode("__scenes").alias("scene_index", "__s"))
    out = out.select(*df.columns, "scene_count", "scene_index", F.col("__s.start").alias("scene_start"), F.col("__s.end").alias("scene_end"), F.round(F.col("__s.end") - F.col("__s.start"), 3).alias("scene_duration"))
    return out.withColumn("global_slice_rank", F.col(index_col) + F.col("scene_index")) if index_col else out


def slice_name(uid: Column, scene: Column) -> Column:
    return F.format_string("%s_scene_%04d.mp4", uid, scene)


def with_hash(df: DataFrame, content: str = "slice_binary") -> DataFrame:
    """The SHA-256 and size of a binary column; a row without it fails the job."""
    data = F.coalesce(F.col(content), F.raise_error(F.lit(f"{content} is missing")).cast("binary"))
    return df.withColumn("slice_sha256", F.sha2(data, 256)).withColumn("slice_size", F.octet_length(data))


def every_nth(rank: Column, n: int) -> Column:
    """Whether a rank (0 if null) is a multiple of ``n``; for ``n`` of 0 or less all are."""
    return F.lit(True) if n <= 0 else F.pmod(F.coalesce(rank, F.lit(0)), F.lit(n)) == 0


def random_split(df: DataFrame, weights: list[float], seed: int = 0, key: str | None = None) -> list[DataFrame]:
    """Parts of about the given weights. By a key's hash a row's part stays the same whatever the partitioning."""
    if key is None:
        return df.randomSplit(weights, seed)
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 1_000_000.0
    edges, total = [0.0], sum(weights)
    for w in weights:
        edges.append(edges[-1] + w / total)
    edges[-1] = 1.0
    return [df.where((at >= lo) & (at < hi)) for lo, hi in zip(edges, edges[1:])]


def deal_blocks(sizes: list[int], ranks: int, shuffle: bool = False, seed: int = 0) -> dict[int, list[tuple[int, int]]]:
    """Blocks and sample counts for each rank, the same number of samples each: ranks take blocks in turn, in a seeded
    order if they are shuffled, and one that is short takes on from the first blocks again."""
    if not sizes or ranks < 1 or ranks > len(sizes):
        raise ValueError("there must be at least as many blocks as ranks")
    order = list(range(len(sizes)))
    if shuffle:
        random.Random(seed).shuffle(order)
    each = -(-sum(sizes) // ranks)
    out = {}
    for r in range(ranks):
        picked, left, i = [], each, r
        while left > 0:
            block = order[i % len(sizes)]
            take = min(sizes[block], left)
            if take:
                picked.append((block, take))
            left -= take
            i += ranks if i + ranks < len(sizes) else 1
        out[r] = picked
    return out
