"""Personal data: patterns, and information-theoretic sanitisation of the terms that give them away.

Patterns find the protected entities; those of different kinds that stand near each other are also one class, as a
person's address and number. Over the whole corpus, the documents that hold an entity or class, a term and both give the
pointwise mutual information of term and entity; divided by the entity's own information it is the share of the entity
that the term discloses. The estimate is a lower confidence bound, so few documents count for less but are not ignored. A
term that discloses more than a threshold is a span wherever it stands in a document that holds the entity or one of the
class: it is generalised, and from a second threshold on removed.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import graph
from millrace.llm.arrow import append_columns, emit_rows, texts
from millrace.llm.shared import checkpointed, unique_name

KINDS = ("email", "ip", "card", "phone", "term")
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]+")
NEAR = 60

Span = tuple[int, int, int]  # start, place in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns in a whole text, by start. Each kind's matches are leftmost and do not overlap; those that
    fail their check are dropped without another try. Time is linear in the text but for phones, whose runs are scanned
    once for each plus sign."""
    out: list[Span] = []
    if "@" in text:
        done = 0
        for m in _AT.finditer(text):
            at = lo = m.start()
            while lo > done and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < at:
                done = m.end()
                out.append((lo, 0, done))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def entity(text: str, span: Span) -> int:
    """A protected entity: the hash of its kind and of its value without punctuation and case."""
    value = text[span[0] : span[2]]
    value = value.lower() if span[1] == 0 else value if span[1] == 1 else re.sub("[^0-9]", "", value)
    return xxhash.xxh3_64_intdigest(f"{KINDS[span[1]]}:{value}") >> 1


def covered(spans: list[Span], lo: int, hi: int) -> bool:
    return any(s < hi and lo < e for s, _, e in spans)


class Terms(dict):
    """The disclosing terms of entities, with those of the classes that they are in."""

    def __init__(self, terms: dict[int, list[tuple[str, bool]]], groups: dict[int, int]):
        super().__init__(terms)
        self.groups = groups

    def get(self, e: int, default=()):
        return [*super().get(e, ()), *super().get(self.groups.get(e), ())]


def term_spans(text: str, found: list[Span], entities: dict[int, list[tuple[str, bool]]]) -> list[tuple[int, int, bool]]:
    """Spans of a text's disclosing terms outside its base spans, and whether they are to be removed."""
    terms: dict[str, bool] = {}
    for span in found:
        for term, removed in entities.get(entity(text, span), ()):
            terms[term] = terms.get(term, False) or removed
    if not terms:
        return []
    out, at = [], 0
    for m in _TERM.finditer(text):
        removed = terms.get(m[0].lower())
        if removed is None:
            continue
        while at < len(found) and max(found[at][2], 0) <= m.start():
            at += 1
        if not covered(found[at : at + 8], m.start(), m.end()):
            out.append((m.start(), m.end(), removed))
    return out


def disclosures(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.8, remove: float = 0.95, doubt: float = 0.2) -> DataFrame:
    """``entity, term, disclosure, removed, group``: the terms over the threshold, estimated over all documents. Rows with
    a null term tell the class of an entity, in ``group``; a class has its own rows, as an entity.

    A term is a word of letters outside the patterns, anywhere in a document. Of ``k`` different surroundings, the lower
    bound of a share that is missed with probability ``doubt`` is the share times ``doubt ** (1 / k)``, as for a share
    of one. A term within 60 characters of the entity gives a surrounding, one farther off the half of one, and copies
    of a text give the same. Counts are of documents; every task flushes its counts when they reach a bound.
    """

    def pairs():
        at = int.from_bytes(os.urandom(7))  # numbers documents; what follows is checkpointed
        # What can't reach the threshold, were it in all documents of the entity and in no others, isn't sent.
        n_all, frequent, sizes, other_size = known.value

        def fn(col):
            nonlocal at
            if col is None:
                return
            rows: list[tuple] = []

            def flush():
                out = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64()))]
                rows.clear()
                return out

            for text in texts(col):
                spans = base_spans(text)
                if not spans:
                    continue
                at += 1
                whole = xxhash.xxh3_64_intdigest(text) >> 1
                terms, i = [], 0
                for m in _TERM.finditer(text):
                    while i < len(spans) and spans[i][2] <= m.start():
                        i += 1
                    if not covered(spans[i : i + 8], m.start(), m.end()):
                        terms.append((m.start(), m.end(), m[0].lower()))
                starts = [x[0] for x in terms]
                each = {x[2] for x in terms}
                held: dict[int, dict[str, int]] = {}
                for s in spans:
                    e = entity(text, s)
                    around = xxhash.xxh3_64_intdigest(text[max(0, s[0] - NEAR) : s[0]] + " " + text[s[2] : s[2] + NEAR]) >> 1
                    near = held.setdefault(e, {})
                    for j in range(bisect_left(starts, s[2] + NEAR) - 1, -1, -1):
                        if terms[j][1] <= s[0] - NEAR:
                            break
                        near.setdefault(terms[j][2], around)
                for e, near in held.items():
                    rows.append((at, e, "", True, 0))
                    most = n_all ** (1 - threshold) * sizes.get(e, other_size) ** threshold
                    rows += [(at, e, w, w in near, near.get(w, whole)) for w in each if frequent.get(w, 0) <= most]
                    if len(rows) > 100_000:
                        yield flush()
            if rows:
                yield flush()

        return fn

    def words():
        tally: Counter = Counter()  # of terms, of entities, and of pairs of them
        docs_seen = 0

        def flush():
            kinds = [pa.array([x if isinstance(x, kind) else None for x in tally], to) for kind, to in ((str, pa.string()), (int, pa.int64()))]
            links = [pa.array([x[i] if isinstance(x, tuple) else None for x in tally], pa.int64()) for i in (0, 1)]
            out = [*kinds, *links, pa.array(list(tally.values()), pa.int64())]
            tally.clear()
            return out

        def fn(col):
            nonlocal docs_seen
            if col is None:
                tally[""] = docs_seen
                yield flush()
                return
            for text in texts(col):
                docs_seen += 1
                tally.update({w.lower() for w in set(_TERM.findall(text))})
                spans = base_spans(text)
                ents = [entity(text, x) for x in spans]
                tally.update(set(ents))
                beside = zip(spans, spans[1:], ents, ents[1:])
                tally.update({(e, f) for a, b, e, f in beside if e != f and a[1] != b[1] and b[0] - a[2] <= NEAR})
                if len(tally) > 400_000:
                    yield flush()

        return fn

    spark = docs.sparkSession
    counts = emit_rows(docs, [text_col], "term string, entity long, a long, b long, n long", words, portions=True)
    counts = checkpointed(counts.groupBy("term", "entity", "a", "b").agg(F.sum("n").alias("n")))
    members = graph.components(counts.where("a IS NOT NULL"))
    members = checkpointed(members.select(F.col("vertex").alias("entity"), F.shiftrightunsigned(F.xxhash64("component", F.lit("class")), 1).alias("group")))
    alone = counts.where("entity IS NOT NULL").select("entity", F.col("n").alias("n_entity"))
    terms = counts.where("term <> ''").select("term", F.col("n").alias("n_term"))
    n_all = (counts.where("term = ''").select("n").first() or [0])[0] or 0
    # At most the sum of its members' documents are a class's.
    largest = members.join(alone, "entity").groupBy("group").agg(F.sum("n_entity").alias("m"))
    sizes = alone.join(members, "entity", "left").join(largest, "group", "left").select("entity", F.greatest("n_entity", F.coalesce("m", "n_entity")).alias("m"))
    sizes = sizes.where("m > 1").orderBy(F.desc("m")).limit(MOST_SENT).collect()
    frequent = terms.where(F.col("n_term") > n_all ** (1 - threshold)).orderBy(F.desc("n_term")).limit(MOST_SENT).collect()
    other_size = 1 if len(sizes) < MOST_SENT else sizes[-1]["m"]
    known = spark.sparkContext.broadcast((n_all, {r["term"]: r["n_term"] for r in frequent}, {r["entity"]: r["m"] for r in sizes}, other_size))

    rows = checkpointed(emit_rows(docs, [text_col], "doc long, entity long, term string, near boolean, around long", pairs, portions=True))
    # A document counts once for a class, whatever it holds of it.
    held = rows.where("term = ''").join(members, "entity").select("group", "doc").distinct().groupBy(F.col("group").alias("entity")).agg(F.count("*").alias("n_entity"))
    rows = rows.where("term <> ''")
    classes = rows.join(members, "entity").groupBy(F.col("group").alias("entity"), "term", "doc").agg(F.max("near").alias("near"), F.max(F.struct("near", "around"))["around"].alias("around"))
    rows = rows.unionByName(classes).groupBy("entity", "term", "around").agg(F.count("*").alias("n"), F.max("near").alias("near"))
    pairs_left = rows.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.sum(F.when(F.col("near"), 1.0).otherwise(0.5)).alias("k"))
    alone = alone.unionByName(held)
    bound = F.log(F.lit(float(doubt))) / F.col("k")
    share = (F.log(F.lit(float(n_all)) * F.col("n_both") / (F.col("n_term") * F.col("n_entity"))) + bound) / F.log(F.lit(float(n_all)) / F.col("n_entity"))
    scored = pairs_left.join(alone, "entity").join(terms, "term").where(F.col("n_entity") < n_all)
    out = checkpointed(scored.withColumn("disclosure", share).where(F.col("disclosure") >= threshold).select("entity", "term", "disclosure", (F.col("disclosure") >= remove).alias("removed"), F.lit(None).cast("long").alias("group")))
    told = members.join(out.select(F.col("entity").alias("group")).distinct(), "group", "left_semi")
    return out.unionByName(told.select("entity", F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("disclosure"), F.lit(None).cast("boolean").alias("removed"), "group"))


#: Rows of disclosing terms that are sent to all tasks at most; beyond it they reach the texts by a join.
MOST_SENT = 200_000


def find(docs: DataFrame, *, text_col: str = "text", found: DataFrame | None = None, sanitised: str | None = None, most_sent: int = MOST_SENT, **how) -> DataFrame:
    """``docs`` with ``n_email, n_ip, n_card, n_phone, base_sha256, spans``, and the sanitised text where it is asked for.

    Each base span becomes ``[EMAIL]`` and so on (of overlapping ones the union, by the first's kind); a disclosing term
    becomes ``[TERM]``, or nothing if it discloses as much as the threshold for removal; of two disclosures the stronger
    decides. A null text is empty, texts of any length are searched whole, repeated rows stay and are treated alike. Columns
    that have one of the new names are replaced, others of any name pass through. An empty table gives none.
    """
    found = disclosures(docs, text_col=text_col, **how) if found is None else found
    rows = found.select("entity", "term", "removed", "group").limit(most_sent + 1).collect()
    inputs, extra = [text_col], None
    if len(rows) > most_sent:
        extra = unique_name("terms")
        docs = _with_terms(docs, text_col, found, extra)
        inputs.append(extra)
        rows = []
    known: dict[int, list[tuple[str, bool]]] = {}
    groups: dict[int, int] = {}
    for r in rows:
        if r["term"] is None:
            groups[r["entity"]] = r["group"]
        else:
            known.setdefault(r["entity"], []).append((r["term"], r["removed"]))
    shared = docs.sparkSession.sparkContext.broadcast((known, groups))

    def make():
        terms_of = Terms(*shared.value)

        def fn(col, own=None):
            n = [[] for _ in range(4)]
            sha, said, clean = [], [], []
            own = own.to_pylist() if own is not None else None
            for i, text in enumerate(texts(col)):
                base = base_spans(text)
                for k in range(4):
                    n[k].append(sum(s[1] == k for s in base))
                words = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
                sha.append(hashlib.sha256(",".join(words).encode()).hexdigest())
                if own is not None:
                    terms_of_text: dict = {}
                    for x in own[i] or []:
                        terms_of_text.setdefault(entity(text, base[0]), []).append((x["term"], x["removed"]))
                else:
                    terms_of_text = terms_of
                terms = term_spans(text, base, terms_of_text) if base else []
                every = sorted([*base, *((s, 4, e) for s, e, _ in terms)])
                said.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in every))
                if sanitised:
                    clean.append(sanitise(text, every, {s for s, _, gone in terms if gone}))
            out = [pa.array(x, pa.int64()) for x in n] + [pa.array(sha, pa.string()), pa.array(said, pa.string())]
            return out + ([pa.array(clean, pa.string())] if sanitised else [])

        return fn

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]] + [T.StructField(x, T.StringType()) for x in ("base_sha256", "spans")]
    if sanitised:
        fields.append(T.StructField(sanitised, T.StringType()))
    out = append_columns(docs, inputs, fields, make, portions=True)
    return out.drop(extra) if extra else out


def sanitise(text: str, spans: list[Span], gone: set[int]) -> str:
    out, at, i = [], 0, 0
    while i < len(spans):
        lo, kind, hi = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < hi:
            hi = max(hi, spans[i][2])
            i += 1
        out += [text[at:lo], "" if kind == 4 and lo in gone else f"[{KINDS[kind].upper()}]"]
        at = hi
    return "".join(out) + text[at:]


def _with_terms(docs: DataFrame, text_col: str, found: DataFrame, into: str) -> DataFrame:
    """``docs`` with the disclosing terms of each text's entities, brought to it by the hash of the text. Texts without
    entities, as null and empty ones, have keys of their own, and copies of a text that is large are split by Spark."""
    mine = unique_name("key")

    def make():
        def fn(col):
            if col is None:
                return
            keys, ents = [], []
            for text in texts(col):
                for e in {entity(text, s) for s in base_spans(text)}:
                    keys.append(xxhash.xxh3_64_intdigest(text) >> 1)
                    ents.append(e)
            yield [pa.array(keys, pa.int64()), pa.array(ents, pa.int64())]

        return fn

    def hashed():
        at = -1 - (int.from_bytes(os.urandom(7)) << 1)

        def fn(col):
            nonlocal at
            keys = []
            for t in texts(col):
                at -= 1
                keys.append(xxhash.xxh3_64_intdigest(t) >> 1 if base_spans(t) else at)
            return [pa.array(keys, pa.int64())]

        return fn

    held = emit_rows(docs, [text_col], "__key long, entity long", make).distinct()
    groups = found.where("term IS NULL").select("entity", "group")
    held = held.unionByName(held.join(groups, "entity").select("__key", F.col("group").alias("entity"))).distinct()
    terms = held.join(found.where("term IS NOT NULL").select("entity", "term", "removed"), "entity").groupBy("__key", "term").agg(F.max("removed").alias("removed"))
    terms = checkpointed(terms.groupBy(F.col("__key").alias(mine)).agg(F.collect_list(F.struct("term", "removed")).alias(into)))
    keyed = append_columns(docs, [text_col], [T.StructField(mine, T.LongType())], hashed)
    return keyed.join(terms, mine, "left").drop(mine)
