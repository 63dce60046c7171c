"""WARC: records, and a Merkle fixity audit of replicas.

Each record's bytes are hashed; hashes are gathered, in order of offset, into a tree with a fixed number of children.
A node hashes its range of offsets and its children with their numbers. A replica's tree is built from its own files,
order and sizes. Trees are compared from the root downwards: only the children of nodes that differ are looked at, so an
audit of sound replicas ends at the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import checkpointed

FANOUT = 16
NODE = ["level", "file", "pos", "lo", "hi", "hash"]


def record(url: Column, body: Column, key: Column) -> Column:
    """The bytes of a response record, as text: header lines, an empty line, the body, two line ends."""
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"),
        F.regexp_replace(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def pack(pages: DataFrame, *, key_col: str = "page_id", url_col: str = "url", body_col: str = "html", per_file: int = 1000) -> DataFrame:
    """One row a record: ``key, file, record``. Files hold the records of ``per_file`` successive keys.

    A null body is empty, a null url too. Records with a null key are put in file -1.
    """
    key = F.col(key_col)
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    return pages.select(key.alias("key"), F.coalesce(F.floor(key / per_file), F.lit(-1)).cast("long").alias("file"), record(F.col(url_col).cast("string"), body, key).alias("record"))


def _ranges(facts: DataFrame) -> DataFrame:
    """``file, pos, key, lo, hi, hash`` of ``facts``, in the order of their ``pos`` or else of keys and digests."""
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy(*[c for c in ("pos", "key", "hash") if c in facts.columns])
    hi = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return facts.select("file", (F.row_number().over(order) - 1).cast("long").alias("pos"), "key", (hi - F.col("size")).alias("lo"), hi.alias("hi"), "hash")


def _facts(records: DataFrame) -> DataFrame:
    held = [c for c in ("file", "pos") if c in records.columns]
    return records.select(*[F.col(c).cast("long").alias(c) for c in held], "key", F.octet_length("record").cast("long").alias("size"), F.sha2("record", 256).alias("hash"))


def leaves(records: DataFrame) -> DataFrame:
    """``file, pos, key, lo, hi, hash``: each record's place in its file, its range of offsets and its digest.

    Records of a file are ordered by their ``pos`` if there is one, else by key, and repeated keys by digest. Only
    digests and lengths are shuffled.
    """
    return _ranges(_facts(records))


def reread(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """The leaves of a replica, by the files, order and sizes of what it holds.

    ``stored`` has ``key, record`` and, where the places in it are known, ``file`` and maybe ``pos``. Without ``file``
    a record is put in the manifest's file of its key, or in file -1 if the manifest has no such key.
    """
    facts = _facts(stored)
    if "file" not in stored.columns:
        at = manifest.groupBy(F.col("key").alias("__key")).agg(F.min("file").alias("file"))
        facts = facts.join(at, F.col("key").eqNullSafe(F.col("__key")), "left").drop("__key")
    return _ranges(facts.withColumn("file", F.coalesce("file", F.lit(-1).cast("long"))))


@dataclass
class Tree:
    """The levels of a Merkle tree, leaves first; within files up to each file's root, then over files to one root."""

    levels: list[DataFrame]


def _parents(nodes: DataFrame, level: int, across: bool) -> DataFrame:
    group = [F.floor(F.col("file") / FANOUT).alias("file"), F.lit(0).cast("long").alias("pos")] if across else ["file", F.floor(F.col("pos") / FANOUT).alias("pos")]
    order = "file" if across else "pos"
    kids = F.array_sort(F.collect_list(F.struct(F.col(f"__{order}"), "hash")))  # at most FANOUT of them
    text = F.concat_ws(":", F.min("lo").cast("string"), F.max("hi").cast("string"), F.array_join(F.transform(kids, lambda x: F.concat_ws("=", x[f"__{order}"].cast("string"), x["hash"])), ","))
    return nodes.withColumn(f"__{order}", F.col(order)).groupBy(*group).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sha2(text, 256).alias("hash")).select(F.lit(level).alias("level"), F.col("file").cast("long").alias("file"), F.col("pos").cast("long").alias("pos"), "lo", "hi", "hash")


def tree(leaf_rows: DataFrame, most_pos: int, most_file: int) -> Tree:
    """Builds the levels over leaves whose positions and files go up to the given numbers. Each is written before the next
    is made of it, so that neither building nor looking at one comes back to the leaves."""
    levels = [leaf_rows.select(F.lit(0).alias("level"), "file", "pos", "lo", "hi", F.concat_ws(":", "lo", "hi", "hash").alias("hash"))]
    while most_pos > 0:
        levels.append(checkpointed(_parents(levels[-1], len(levels), False)))
        most_pos //= FANOUT
    while True:
        levels.append(checkpointed(_parents(levels[-1], len(levels), True)))
        if most_file <= 0:
            return Tree(levels)
        most_file //= FANOUT


def _differing(sound: DataFrame, held: DataFrame) -> DataFrame:
    """``file, pos`` of the leaves that differ between two trees, or that one of them lacks."""
    bounds = sound.unionByName(held).agg(F.max("pos"), F.max("file"), F.min("file")).first()
    most, shift = bounds[0] or 0, -min(0, bounds[2] or 0)
    a, b = (tree(x.withColumn("file", F.col("file") + shift), most, (bounds[1] or 0) + shift) for x in (sound, held))
    n, suspects = len(a.levels), None
    within = next(i for i in range(n) if not most // FANOUT**i)
    for level in range(n - 1, -1, -1):
        mine, theirs = a.levels[level], b.levels[level]
        if suspects is not None:
            up = suspects.select(F.col("file").alias("__f"), F.col("pos").alias("__p"))
            held_by = (F.floor(F.col("file") / FANOUT) == F.col("__f")) if level >= within else (F.col("file") == F.col("__f")) & (F.floor(F.col("pos") / FANOUT) == F.col("__p"))
            mine, theirs = mine.join(up, held_by, "left_semi"), theirs.join(up, held_by, "left_semi")
        other = theirs.select("file", "pos", F.col("hash").alias("__found"))
        suspects = mine.select("file", "pos", "hash").join(other, ["file", "pos"], "full").where(~F.col("hash").eqNullSafe(F.col("__found")))
        suspects = checkpointed(suspects.select("file", "pos"))
        if suspects.isEmpty():
            break
    return suspects.withColumn("file", F.col("file") - shift)


def faults(records: DataFrame, replica: DataFrame) -> DataFrame:
    """What is wrong with a replica: ``fault, file, pos, key, lo, hi, expected, found, at_file, at_pos, at_lo, at_hi``.

    A record is ``lost``, ``altered``, ``extra`` (one more than the manifest has, a copy too; its place and digest are the
    replica's), ``moved`` (in another file, or in another order among the records that both hold) or ``shifted`` (whole and
    in order, but at another offset or number, as all are that follow a loss). The columns ``at_`` tell the place in the replica.
    ``records`` has ``key, file, record``, both may have ``pos``. A replica without ``file`` has no places: then nothing is moved or shifted.
    """
    from pyspark.sql import Window

    sound = checkpointed(leaves(records))
    held = checkpointed(reread(sound, replica))
    suspects = _differing(sound, held)
    here, there = sound.join(suspects, ["file", "pos"], "left_semi"), held.join(suspects, ["file", "pos"], "left_semi")
    here = here.select("file", "pos", "key", "lo", "hi", F.col("hash").alias("expected"))
    there = there.select(F.col("key").alias("__key"), F.col("hash").alias("found"), *[F.col(c).alias(f"at_{c}") for c in ("file", "pos", "lo", "hi")])
    # The same bytes are the same record, equal ones by their order; what is left of a key is altered, lost or extra.
    nth = lambda *by, order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    mine = here.withColumn("__nth", nth("key", "expected", order=("file", "pos")))
    theirs = there.withColumn("__m", nth("__key", "found", order=("at_file", "at_pos")))
    same = F.col("key").eqNullSafe(F.col("__key")) & (F.col("expected") == F.col("found")) & (F.col("__nth") == F.col("__m"))
    both = checkpointed(mine.join(theirs, same, "full").drop("__nth", "__m"))
    kept = both.where("expected IS NOT NULL AND found IS NOT NULL")
    mine = both.where("found IS NULL").select(*here.columns).withColumn("__nth", nth("key", order=("expected", "file", "pos")))
    theirs = both.where("expected IS NULL").select(*there.columns).withColumn("__m", nth("__key", order=("found", "at_file", "at_pos")))
    rest = mine.join(theirs, F.col("key").eqNullSafe(F.col("__key")) & (F.col("__nth") == F.col("__m")), "full")
    fault = F.when(F.col("found").isNull(), "lost").when(F.col("expected").isNull(), "extra").otherwise("altered")
    columns = [F.coalesce("key", "__key").alias("key") if c == "key" else F.col(c) for c in ("file", "pos", "key", "lo", "hi", "expected", "found", "at_file", "at_pos", "at_lo", "at_hi")]
    out = rest.select(fault.alias("fault"), *columns)
    if "file" not in replica.columns:
        return out
    # Sound leaves are not among the suspects, and keep their order: their numbers are the same in both.
    kept = kept.withColumn("__a", nth("file", "at_file", order=("pos",))).withColumn("__b", nth("file", "at_file", order=("at_pos",)))
    moved = (F.col("file") != F.col("at_file")) | (F.col("__a") != F.col("__b"))
    return out.unionByName(kept.select(F.when(moved, "moved").otherwise("shifted").alias("fault"), *columns))


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """What a replica has lost, altered, moved or holds in addition: ``file, pos, key, lo, hi, expected, found``.

    found is null if the record is missing; expected is null, and the place is the replica's, if it is one too many; both
    are equal if it was moved. Records that others' faults only shift are left to ``faults``, but that of a replica with
    nothing else wrong is told. Sound replicas, and empty tables, give no rows.
    """
    found = checkpointed(faults(records, replica))
    if not found.where("fault <> 'shifted'").isEmpty():
        found = found.where("fault <> 'shifted'")
    place = [F.coalesce(c, f"at_{c}").alias(c) for c in ("file", "pos")]
    return found.select(*place, "key", *[F.coalesce(c, f"at_{c}").alias(c) for c in ("lo", "hi")], "expected", "found")


def parse(data: bytes) -> list[dict]:
    """Records of an uncompressed WARC file's bytes: headers, body, range of offsets. A cut-off last record is kept as
    far as it goes; bytes that begin no record end the parse."""
    out, at = [], 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            break
        lines = data[at:end].decode(errors="replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers.get("content-length", "0"))
        stop = min(len(data), end + 4 + size)
        out.append({"headers": headers, "body": data[end + 4 : stop], "lo": at, "hi": min(len(data), stop + 4)})
        at = stop + 4
    return out
