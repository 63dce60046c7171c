"""Language-model scores by Brown's class-based bigrams.

Words get classes so that neighbouring classes tell most of each other, in two steps. The most frequent words are
clustered by exchange, from the counts of their neighbours in all training text; the others take part in it in units by
their endings. Then each of the others, however rare, takes the class that all its neighbours' classes make likeliest, if
these speak clearly, as Brown puts the words beyond his window into the classes at hand. Words that no training text has
are left in their endings' classes. A text's probability is the product of class transitions and of words' shares of their classes.

Texts are taken apart once, into numbers; all later passes read these. Counts cover all training text. Those of the words
that are sent, of which there is a fixed number, go to all tasks, with their classes; the counts and classes of the others
reach the texts by a join on the word.
"""

from __future__ import annotations

import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.arrow import emit_rows, raw
from millrace.llm.shared import checkpointed, unique_name
from millrace.llm.words import words

END = b"\n"
FREQUENT, ENDINGS, CLASSES, SENT = 3000, 71, 128, 200_000
#: A word that is exchanged has as many occurrences at least; fewer teach it a class by chance.
LEAST = 10
#: What a word's neighbours must say for another class than its ending's, as a logarithm, for the same reason.
DOUBT = 10.0
UNITS = 1 + FREQUENT + ENDINGS
_BITS = 12
PRIOR = 20.0
#: Rows of a batch that a task emits.
_ROWS = 200_000


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


def ending(word: bytes) -> int:
    """The unit of a word that is not frequent, by its last three bytes."""
    return 1 + FREQUENT + xxhash.xxh3_64_intdigest(word[-3:]) % ENDINGS


def number_kind(sent: int) -> type:
    """What holds ``Units``' numbers if so many words are sent."""
    return np.int32 if sent < 1 << (31 - _BITS) else np.int64


class Units(dict):
    """For a word, its place among the words that are sent plus one (0 if it isn't) and its unit, packed in a number. What is
    kept is bounded."""

    def __init__(self, hashes: np.ndarray, frequent: np.ndarray):
        super().__init__()
        self.places = {h: 1 + i for i, h in enumerate(hashes.tolist())}
        self.frequent = {h: 1 + i for i, h in enumerate(frequent.tolist())}
        self.kind = number_kind(len(hashes))

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = word_hash(word)
        unit = 0 if word == END else self.frequent.get(h) or ending(word)
        self[word] = v = self.places.get(h, 0) << _BITS | unit
        return v

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), self.kind, len(ws))


def blobs(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    """Binary values: ``values`` cut at ``starts``, which has their end too."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def numbers(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """What ``blobs`` made: ``starts`` and ``values``."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, kind)
    starts = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data.slice(int(starts[0]), int(starts[-1] - starts[0])), kind) if starts[-1] > starts[0] else np.zeros(0, kind)
    return (starts - starts[0]) // np.dtype(kind).itemsize, values


def pieces_of(starts: np.ndarray, most: int = 200_000):
    """Ranges of rows that have ``most`` values or are one row."""
    lo, n = 0, len(starts) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, least: float = 1e-9) -> np.ndarray:
    """Classes of units from the counts of neighbouring units, by exchange: each unit in turn, the frequent first, moves to
    the class that raises the likelihood most, until no move raises it by more than ``least`` a token. Every move raises
    it, so this ends. Unit 0, the end, has class 0 to itself."""
    n = len(pairs)
    total = pairs.sum(0, dtype=np.float64)
    order = np.argsort(-total[1:], kind="stable") + 1
    cls = np.zeros(n, np.int64)
    cls[order] = 1 + np.arange(n - 1) % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), cls] = 1
    right, left = pairs @ member, pairs.T @ member
    between = member.T @ right
    logs = _xlogx(between)
    size = member.T @ total
    enough = least * max(1.0, total.sum())
    while True:
        moved = 0
        for w in order:
            if not total[w]:
                break
            a, r, s, own = cls[w], right[w].copy(), left[w].copy(), float(pairs[w, w])
            r[a] -= own
            s[a] -= own
            _shift(between, logs, size, a, r, s, own, total[w], -1)
            # Adding to class b changes row b by r, column b by s, and their crossing by both and the word's own pairs;
            # a class that is no neighbour of the word changes nothing.
            x, y = np.flatnonzero(r), np.flatnonzero(s)
            gain = (_xlogx(between[:, x] + r[x]) - logs[:, x]).sum(1) + (_xlogx(between[y] + s[y, None]) - logs[y]).sum(0)
            d = np.diag(between)
            gain += _xlogx(d + r + s + own) + np.diag(logs) - _xlogx(d + r) - _xlogx(d + s)
            gain -= 2 * (_xlogx(size + total[w]) - _xlogx(size))
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + enough:
                b = int(a)
            _shift(between, logs, size, b, r, s, own, total[w], 1)
            if b != a:
                moved += 1
                cls[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if not moved:
            return cls


def _shift(between: np.ndarray, logs: np.ndarray, size: np.ndarray, at: int, r: np.ndarray, s: np.ndarray, own: float, n: float, sign: int) -> None:
    """Puts a word's neighbours into a class (1), or takes them out (-1)."""
    between[at] += sign * r
    between[:, at] += sign * s
    between[at, at] += sign * own
    size[at] += sign * n
    logs[at], logs[:, at] = _xlogx(between[at]), _xlogx(between[:, at])


def vocabulary(train: DataFrame, text_col: str) -> DataFrame:
    """``word, n, unit``: each training word's hash, count, and the unit of its ending. Tasks count before they send."""

    def make():
        tally: Counter = Counter()

        def flush():
            ws = list(tally)
            out = [pa.array([word_hash(w) for w in ws], pa.int64()), pa.array(list(tally.values()), pa.int64()), pa.array([0 if w == END else ending(w) for w in ws], pa.int32())]
            tally.clear()
            return out

        def fn(col):
            if col is None:
                yield flush()
                return
            for text in raw(col):
                tally.update(words(text))
                tally[END] += 1
                if len(tally) > 400_000:
                    yield flush()

        return fn

    return emit_rows(train, [text_col], "word long, n long, unit int", make).groupBy("word", "unit").agg(F.sum("n").alias("n"))


def encoded(df: DataFrame, text_col: str, shared, names: tuple[str, str, str]) -> DataFrame:
    """``df`` with its texts as numbers: a number for the row, ``Units``' numbers of the text's words and of its end, and the
    hashes of the words that aren't sent, in their order."""
    kept = [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType(list(kept))
    for name, kind in zip(names, ("long", "binary", "binary")):
        schema = schema.add(name, kind)

    def make():
        units = Units(*shared.value)
        at = int.from_bytes(os.urandom(7))  # numbers rows; what follows is checkpointed

        def fn(*cols):
            nonlocal at
            if cols[0] is None:
                return
            vs, rare, lo, size = [], [], 0, 0
            for i, text in enumerate(raw(cols[-1])):
                ws = [*words(text), END]
                v = units.of(ws)
                vs.append(v.tobytes())
                rare.append(np.array([word_hash(ws[i]) for i in np.flatnonzero(v < 1 << _BITS).tolist()], np.int64).tobytes())
                size += len(ws)
                if size > 1_000_000 or i == len(cols[0]) - 1:
                    rows = pa.array(np.arange(at, at + len(vs)))
                    yield [*(c.slice(lo, len(vs)) for c in cols[:-1]), rows, pa.array(vs, pa.binary()), pa.array(rare, pa.binary())]
                    at += len(vs)
                    vs, rare, lo, size = [], [], i + 1, 0

        return fn

    return checkpointed(emit_rows(df, [f.name for f in kept] + [text_col], schema, make))


def unit_pairs(train: DataFrame, col: str, shared) -> np.ndarray:
    """Counts of neighbouring units over all training text; texts begin and end at the end. The table's size is fixed."""

    def make():
        table = np.zeros(UNITS * UNITS, np.int32)
        kind = number_kind(len(shared.value[0]))

        def fn(texts):
            if texts is None:
                at = np.flatnonzero(table)
                for lo in range(0, len(at), _ROWS):
                    some = at[lo : lo + _ROWS]
                    yield [pa.array(some.astype(np.int32)), pa.array(table[some].astype(np.int64))]
                return
            starts, v = numbers(texts, kind)
            for lo, hi in pieces_of(starts):
                # Each text closes with the end, unit 0, so the next one begins at it.
                u = np.concatenate([[0], v[starts[lo] : starts[hi]] & (2**_BITS - 1)])
                np.add.at(table, u[:-1] * UNITS + u[1:], 1)

        return fn

    found = emit_rows(train, [col], "pair int, n long", make).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(UNITS * UNITS, np.int64)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(UNITS, UNITS)


def likeliest(between: np.ndarray) -> np.ndarray:
    """What one neighbour of a class says for each class of a word: rows are classes before the word, then after it."""
    size = np.log(between.sum(0) + 1.0)
    return np.concatenate([np.log(between + 0.5) - size, np.log(between.T + 0.5) - size])


def neighbours_classes(train: DataFrame, col: str, rare_col: str, shared, between: np.ndarray, unit_class: np.ndarray, ends: np.ndarray, rest: bool) -> DataFrame:
    """The words that are no units of their own and whose neighbours speak for another class than their ending's: ``word,
    place`` (-1: not sent)``, to, was, n``, with the word's count; and what this changes in the counts of neighbouring
    classes, in rows of the place -2, ``n`` at ``to, was``. Without ``rest`` only words that are sent are looked at.

    Tasks count the classes beside each word; all of a word's counts then meet in one bucket, of which there are several a
    partition, and the task that has it takes the likeliest class. A bucket is gone through in pieces.
    """
    spark, classes = train.sparkSession, len(between)
    model = spark.sparkContext.broadcast((unit_class, ends, likeliest(between)))
    wide, parts = 2 * classes, int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 8 * parts
    small, slots = np.min_scalar_type(classes - 1), np.min_scalar_type(wide - 1)

    def make():
        hashes = shared.value[0]
        of, ends, _ = model.value
        ours: list[np.ndarray] = []
        others: list[tuple] = []
        size = 0

        def flush():
            nonlocal size
            code, n = np.unique(np.concatenate(ours or [np.zeros(0, np.int64)]), return_counts=True)
            place = code // wide
            found = [(hashes[place], of[ends[place]].astype(small), (code % wide).astype(slots), n.astype(np.uint32)), *others]
            key, was, slot, n = (np.concatenate(x) for x in zip(*found))
            ours.clear()
            others.clear()
            size = 0
            bucket = key % buckets
            order = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")
            bucket = bucket[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            cuts = np.append(starts, len(bucket))
            yield [pa.array(bucket[starts].astype(np.int32)), blobs(cuts, key[order]), *(blobs(cuts, x[order]) for x in (was, slot, n))]

        def fn(texts, rare):
            nonlocal size
            if texts is None:
                if size:
                    yield from flush()
                return
            (starts, v), (cuts, words) = numbers(texts, number_kind(len(hashes))), numbers(rare, np.int64)
            for lo, hi in pieces_of(starts):
                some = v[starts[lo] : starts[hi]]
                unit, place = some & (2**_BITS - 1), (some >> _BITS).astype(np.int64) - 1
                k = of[unit]
                before, after = np.concatenate([[0], k[:-1]]), np.append(k[1:], 0)
                at = np.flatnonzero((place >= 0) & (unit > FREQUENT))
                ours.append(np.concatenate([place[at] * wide + before[at], place[at] * wide + classes + after[at]]))
                size += 2 * len(at)
                if rest:
                    at = np.flatnonzero(place < 0)
                    key, real = words[cuts[lo] : cuts[hi]], unit[at] > FREQUENT  # the end may be among them
                    at, key = at[real], key[real]
                    others.append((np.repeat(key, 2), np.repeat(k[at].astype(small), 2), np.stack([before[at], classes + after[at]], 1).ravel().astype(slots), np.ones(2 * len(at), np.uint32)))
                    size += 2 * len(at)
                if size > 1_000_000:
                    yield from flush()

        return fn

    def decide(batches):
        _, _, votes = model.value
        hashes = shared.value[0]
        by = np.argsort(hashes)
        ordered = hashes[by]
        moved = np.zeros((classes, classes))

        def settle(held):
            key, was, slot, n = (np.concatenate([np.frombuffer(b, kind) for b in x]) for x, kind in zip(zip(*held), (np.int64, small, slots, np.uint32)))
            keys, first, at = np.unique(key, return_index=True, return_inverse=True)
            was = was[first].astype(np.int64)
            code = at * wide + slot
            order = np.argsort(code, kind="stable")
            code = code[order]
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            n = np.add.reduceat(n[order].astype(np.float64), starts)
            word, slot = np.divmod(code[starts], wide)
            rows = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word))
            to = np.empty(len(keys), np.int64)
            for lo, hi in pieces_of(rows, 16_384):
                some = slice(rows[lo], rows[hi])
                said = np.add.reduceat(votes[slot[some]] * n[some, None], rows[lo:hi] - rows[lo])
                said[np.arange(hi - lo), was[lo:hi]] += DOUBT
                to[lo:hi] = 1 + np.argmax(said[:, 1:], 1)  # class 0 is the end's
            gone = np.flatnonzero((to != was)[word])
            word, slot, m = word[gone], slot[gone], n[gone]
            left = slot < classes
            for c, sign in ((to, 1), (was, -1)):
                np.add.at(moved, (slot[left], c[word[left]]), sign * m[left])
                np.add.at(moved, (c[word[~left]], slot[~left] - classes), sign * m[~left])
            count = np.bincount(word[left], m[left], len(keys)).astype(np.float64)  # whole numbers where there is none
            i = np.flatnonzero(to != was)
            near = np.minimum(np.searchsorted(ordered, keys[i]), len(ordered) - 1)
            place = np.where(ordered[near] == keys[i], by[near], -1) if len(ordered) else np.full(len(i), -1)
            return pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(place.astype(np.int32)), pa.array(to[i].astype(np.int32)), pa.array(was[i].astype(np.int32)), pa.array(count[i])], found)

        last, held = None, []
        for b in batches:
            for bucket, *row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if bucket != last and held:
                    yield settle(held)
                    held = []
                last = bucket
                held.append(row)
        if held:
            yield settle(held)
        i, j = np.nonzero(moved)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(i), pa.int64()), pa.array(np.full(len(i), -2, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(moved[i, j])], found)

    found = ["word", "place", "to", "was", "n"]
    seen = emit_rows(train, [col, rare_col], "bucket int, word binary, was binary, slot binary, n binary", make)
    return checkpointed(seen.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(decide, "word long, place int, to int, was int, n double"))


def scores(docs: DataFrame, train: DataFrame | str, *, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, known: int | None = None, sent: int = SENT) -> DataFrame:
    """``docs``' ids and extra columns with ``n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    ``train`` has the texts to learn from, or is the name of a boolean column that marks them in ``docs``, which is cheaper.
    Every training word gets a class by its neighbours; ``sent`` of them at most go to all tasks, the others' classes are
    joined, which changes no result while the words of ``LEAST`` occurrences that are exchanged are among those sent. Whoever
    gives ``known`` has only as many words classed, the most frequent; others keep their endings' classes.

    Scores are base-10 logarithms. A null text is empty: one token, the end. Without training text every word is as
    likely as the next. Rows are kept as they are, equal ones and those of null ids too; columns that have one of the new
    names are replaced, others of any name pass through; long texts are scored whole; an empty table gives none.
    """
    spark = docs.sparkSession
    rest, sent = known is None, sent if known is None else known
    learnt = docs.where(F.col(f"`{train}`")) if isinstance(train, str) else train
    vocab = checkpointed(vocabulary(learnt, text_col))
    total, distinct = (x or 0 for x in vocab.agg(F.sum("n"), F.count("*")).first())
    # The least count of which at most ``sent`` words have as much, from a histogram of fixed length.
    bins = sorted(((r["bin"], r["words"]) for r in vocab.groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, held = None, 0
    for level, n in bins:
        if held + n > sent:
            break
        least, held = level, held + n
    most = vocab.where(F.floor(F.log2("n") * 8) >= (least if least is not None else 10**6)).select("word", "n", "unit").toArrow()
    hashes, counts, ends = (most[c].to_numpy() for c in ("word", "n", "unit"))
    order = np.lexsort((hashes, -counts))
    hashes, counts, ends = hashes[order], counts[order], ends[order]
    rank = np.flatnonzero((hashes != word_hash(END)) & (counts >= LEAST))[:FREQUENT]
    shared = spark.sparkContext.broadcast((hashes, hashes[rank]))

    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    kept = [f for f in docs.schema.fields if f.name != text_col and f.name not in new]
    mine = unique_name("lm")
    row, coded, rare, learns, n_tokens, n_seen, logs, path, which, more, found, moves, steps = (f"{mine}_{c}" for c in ("row", "coded", "rare", "learns", "n", "seen", "logs", "path", "which", "more", "found", "moves", "steps"))
    texts = docs.select(*[f"`{f.name}`" for f in kept], F.col(f"`{train}`").alias(learns) if isinstance(train, str) else F.lit(False).alias(learns), F.col(f"`{text_col}`"))
    texts = encoded(texts, text_col, shared, (row, coded, rare))
    learnt = texts.where(learns) if isinstance(train, str) else encoded(train.select(F.col(f"`{text_col}`")), text_col, shared, (row, coded, rare))

    pairs = unit_pairs(learnt, coded, shared)
    unit_class = exchange(pairs, classes)
    member = np.zeros((UNITS, classes))
    member[np.arange(UNITS), unit_class] = 1
    between = member.T @ pairs @ member
    placed = neighbours_classes(learnt, coded, rare, shared, between, unit_class, ends, rest)
    cls = unit_class[ends]
    cls[rank] = unit_class[1 : 1 + len(rank)]
    own = placed.where("place >= 0").select("place", "to").toArrow()
    cls[own["place"].to_numpy()] = own["to"].to_numpy()
    for r in placed.where("place = -2").groupBy("to", "was").agg(F.sum("n").alias("n")).collect():  # one row for two classes
        between[r["to"], r["was"]] += r["n"]
    between = np.maximum(between, 0.0)

    # Tokens and words of each class: by endings, then those sent and the others that have another class.
    sizes, types = np.zeros(classes), np.zeros(classes)
    for r in vocab.groupBy("unit").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():  # one row a unit at most
        sizes[unit_class[r["unit"]]] += r["n"]
        types[unit_class[r["unit"]]] += r["types"]
    for at, sign in ((cls, 1), (unit_class[ends], -1)):
        np.add.at(sizes, at, sign * counts)
        np.add.at(types, at, sign)
    others = placed.where("place = -1")
    for r in others.groupBy("to", "was").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():  # one row for two classes
        for at, sign in ((r["to"], 1), (r["was"], -1)):
            sizes[at] += sign * r["n"]
            types[at] += sign * r["types"]
    share = (sizes + 1) / (sizes.sum() + classes)
    trans = np.log10((between + PRIOR * share[None, :]) / (between.sum(1) + PRIOR)[:, None])
    within = np.log10(sizes + 0.5 * (types + 1))
    model = spark.sparkContext.broadcast((counts, cls, unit_class, trans, within))
    whole = math.log10(total + 0.5 * (distinct + 1))
    marked = np.min_scalar_type(2 * classes - 1)

    def classed():
        """Of the words that are sent, what they add; and each word's class, raised by ``classes`` if it isn't sent."""
        counts, cls, unit_class, _, _ = model.value
        # A word that isn't sent has the place -1, the last.
        counts, cls = np.append(counts, -1), np.append(cls, -1)
        each = np.log10(np.where(counts >= 0, counts + 0.5, 1.0))
        kind = number_kind(len(counts) - 1)

        def fn(*cols):
            if cols[0] is None:
                return
            starts, v = numbers(cols[-1], kind)
            for lo, hi in pieces_of(starts):
                some = v[starts[lo] : starts[hi]]
                place = (some >> _BITS) - 1
                k = np.where(place >= 0, cls[place], unit_class[some & (2**_BITS - 1)] + classes)
                cuts = starts[lo : hi + 1] - starts[lo]
                said = np.diff(cuts), np.add.reduceat((counts[place] > 0).astype(np.int64), cuts[:-1]), np.add.reduceat(each[place], cuts[:-1])
                yield [*(c.slice(lo, hi - lo) for c in cols[:-1]), *map(pa.array, said), blobs(cuts, k.astype(marked))]

        return fn

    def unsent():
        def fn(rows, col):
            if rows is None:
                return
            cuts, words = numbers(col, np.int64)
            for lo, hi in pieces_of(cuts, _ROWS):
                n = np.diff(cuts[lo : hi + 1])
                at = np.arange(n.sum()) - np.repeat(cuts[lo:hi] - cuts[lo], n)
                yield [pa.array(np.repeat(rows.to_numpy()[lo:hi], n)), pa.array(at), pa.array(words[cuts[lo] : cuts[hi]])]

        return fn

    def stepped():
        _, _, _, trans, within = model.value

        def fn(*cols):
            if cols[0] is None:
                return
            starts, path = numbers(cols[-2], marked)
            for lo, hi in pieces_of(starts):
                k = path[starts[lo] : starts[hi]].astype(np.int64)
                cuts = starts[lo : hi + 1] - starts[lo]
                at = np.flatnonzero(k >= classes)
                k[at] -= classes
                to = cols[-1].slice(lo, hi - lo)
                i, c = np.divmod(to.flatten().to_numpy(), classes)
                first = np.searchsorted(at, cuts[:-1])
                k[at[np.repeat(first, pc.fill_null(pc.list_value_length(to), 0).to_numpy()) + i]] = c
                before = np.concatenate([[0], k[:-1]])
                yield [*(x.slice(lo, hi - lo) for x in cols[:-2]), pa.array(np.add.reduceat(trans[before, k] - within[k], cuts[:-1]))]

        return fn

    def schema(start, *fields):
        out = T.StructType(list(start))
        for name, kind in fields:
            out = out.add(name, kind)
        return out

    numbered = schema(kept, (row, "long"))
    said = emit_rows(texts, [*numbered.names, coded], schema(numbered.fields, (n_tokens, "long"), (n_seen, "long"), (logs, "double"), (path, "binary")), classed)
    tail = emit_rows(texts, [row, rare], schema([], (row, "long"), (which, "long"), ("word", "long")), unsent)
    tail = tail.join(vocab.select("word", "n").join(others.select("word", "to"), "word", "left"), "word", "left").groupBy(row)
    tail = tail.agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias(more), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias(found), F.collect_list(F.col(which) * classes + F.col("to")).alias(moves))
    joined = said.join(tail, row, "left")
    done = [*kept, *schema([], (n_tokens, "long"), (n_seen, "long"), (logs, "double"), (more, "double"), (found, "long")).fields]
    out = emit_rows(joined, [*(f.name for f in done), path, moves], schema(done, (steps, "double")), stepped)
    base = F.col(logs) + F.coalesce(more, F.lit(0.0))
    score = base + F.col(steps)
    return out.select(
        *[f"`{f.name}`" for f in kept],
        F.col(n_tokens).alias("n_tokens"),
        (F.col(n_seen) + F.coalesce(found, F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (base - F.col(n_tokens) * F.lit(whole)).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col(n_tokens)).alias("perplexity"),
    )
