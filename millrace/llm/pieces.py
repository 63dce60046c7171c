"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Machines are compiled from a model file:

* the normaliser: the character map, leftmost and longest matches first, then white space (its sign, the leading sign,
  runs made one where the model asks for it). It is deterministic, so its composition with an input is one text;
* the pieces: a trie that reads characters, and on its way back to the root writes the piece for the piece's weight;
* fallback: from the root a character that is no piece is read whole, and written as its bytes' pieces or as unknown;
* neighbours, for BPE models alone. There a piece's score is the rank of a merge, and sums of ranks do not give the
  merges' result. This machine remembers the last piece: its arc from ``a`` to ``b`` weighs 0 if merging the text ``ab``
  ends in exactly ``a b``, and infinity otherwise. A sequence of pieces is the result of the merges if and only if all
  its neighbours are such pairs, so exactly one path is finite and it is the encoding. For a unigram model an arc of the
  pieces weighs the negated score of its piece.

Composed with an input they give a lattice, whose shortest path in the tropical semiring is the encoding.
``Transducer.machine`` is that composition as such; ``Transducer.shortest`` follows the same arcs, found along the trie or by
the last two characters that they read. A text is cut where no piece spans. Of a block of texts each distinct stretch from one
sign to the next is encoded once; its ids, and those of the parts that it is cut into, are remembered.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.arrow import append_columns, texts
from millrace.llm.fst import INF, Machine, compose, shortest_path

SIGN = "▁"
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """The normaliser's map of characters: a transducer whose states are those of a model file's double-array trie."""

    def __init__(self, blob: bytes):
        size = int(np.frombuffer(blob[:4], "<u4")[0])
        self.units, self.said = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
        seven = range(1, 128)
        #: ASCII characters that begin a match of ASCII characters alone.
        self.lively = {chr(c) for c in seven if (at := self.step(self.root, c)) is not None and (self.units[at] >> 8 & 1 or any(self.step(at, d) is not None for d in seven))}

    root = 0

    def step(self, state: int, byte: int) -> int | None:
        """The state that a byte leads to."""
        to = state ^ _offset(self.units[state]) ^ byte
        return to if to < len(self.units) and self.units[to] & 0x800000FF == byte else None

    def apply(self, text: str) -> str:
        """The text with the longest match at each place replaced; what none matches stays."""
        if text.isascii() and self.lively.isdisjoint(text):
            return text
        data, out, i = text.encode(), bytearray(), 0
        while i < len(data):
            state, at, found, end = self.root, i, -1, i
            while at < len(data) and (state := self.step(state, data[at])) is not None:
                at += 1
                if self.units[state] >> 8 & 1:
                    found, end = self.units[state ^ _offset(self.units[state])] & 0x7FFFFFFF, at
            if found >= 0:
                out += self.said[found : self.said.index(0, found)]
            else:
                end = i + 1
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end += 1
                out += data[i:end]
            i = end
        return out.decode()


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 512) >> 6)


def _fields(data: bytes):
    """Numbers and values of a protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, data[i : i + size]
        i += size


class Remembered(dict):
    """What ``make`` gives for a key of up to 48 characters, made once: ``most`` newer ones and as many from before, so that
    what is frequent stays."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 48:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def spans(pieces: Iterable[str]) -> list[set[str]]:
    """Characters other than the sign that stand in pieces beside others, in groups, the one of most pairs first: no piece
    has characters of two groups."""
    pairs = {a + b for p in pieces for a, b in zip(p, p[1:]) if SIGN not in (a, b)}
    root = {c: c for pair in pairs for c in pair}

    def find(c: str) -> str:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for a, b in pairs:
        root[find(a)] = find(b)
    groups, count = defaultdict(set), Counter(find(a) for a, _ in pairs)
    for c in root:
        groups[find(c)].add(c)
    return [groups[r] for r in sorted(groups, key=lambda r: (-count[r], r))]


class Transducer:
    """The compiled machines of a model file's bytes."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        kind, suffix, charsmap = 1, False, b""
        self.prefix, self.squeeze, self.escape = True, True, True
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                kind, suffix = spec.get(3, kind), bool(spec.get(24, suffix))
            elif number == 3:
                spec = dict(_fields(value))
                charsmap = spec.get(2, charsmap)
                self.prefix, self.squeeze, self.escape = bool(spec.get(3, self.prefix)), bool(spec.get(4, self.squeeze)), bool(spec.get(5, self.escape))
        if kind not in (1, 2) or suffix or UNUSED in self.types:
            raise ValueError("only unigram and BPE models that put white space first and use all their pieces can be compiled")
        self.map = CharacterMap(charsmap) if charsmap else None
        self.bpe = kind == 2
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER)}
        self.longest = max(map(len, self.ids), default=1)
        self.least = min((s for s, t in zip(self.scores, self.types) if t == NORMAL), default=0.0) - 10.0
        self.most = max((s for s, t in zip(self.scores, self.types) if t == NORMAL), default=0.0)
        own = sorted((p for p, t in zip(self.pieces, self.types) if t == USER), key=len, reverse=True)
        #: The user's own symbols: a BPE model's merges don't cross them, and no model's normaliser touches them.
        self.user = re.compile("(" + "|".join(map(re.escape, own)) + ")") if own else None
        joined = own or any(re.search(f"[^{SIGN}]{SIGN}", p) for p in self.ids)
        # Unknown characters in a row are written as one, so they must not be parted.
        joined = joined or not self.bytes and not {SIGN}.union(*(p for p in self.ids if len(p) > 1)) <= self.ids.keys()
        groups = spans(self.ids)
        runs = [*groups[:7], *([set().union(*groups[7:])] if groups[7:] else [])]
        runs = ["[" + "".join(map(re.escape, sorted(g))) + "]+" for g in runs]
        if not self.bytes:
            runs.append(f"[^{SIGN}" + "".join(re.escape(p) for p in self.ids if len(p) == 1) + "]+")
        # No piece spans these cuts, so the shortest paths of the parts make up that of the whole.
        self.cut = re.compile("(?s).+" if joined else f"{SIGN}*(?:{'|'.join([*runs, f'[^{SIGN}]'])})|{SIGN}+")
        #: Whether a text is one part.
        self.joined = bool(joined)
        self.stretches = re.compile(f"{SIGN}+[^{SIGN}]*")
        ends = defaultdict(set)
        for p in self.ids:
            if len(p) > 1:
                ends[p[-2:]].add(len(p))
        #: Lengths of the pieces that end in two characters, the longest first.
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        #: The trie: nodes by the next character, and under "" the arcs that end on the way to a node, the longest first.
        self.trie: dict = {"": ()}
        for p in sorted(self.ids, key=len):  # pieces come after those that they begin with
            at = self.trie
            for c in p:
                at = at.get(c) or at.setdefault(c, {"": at[""] or (c,)})
            at[""] = (p, *(x for x in at[""] if x != p))
        self.ranks = {p: -self.scores[i] for p, i in self.ids.items()}
        sign = SIGN.encode()
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b"" if t == CONTROL else p.encode().replace(sign, b" ") if self.escape else p.encode() for p, t in zip(self.pieces, self.types)]
        # What has been learned of pairs: the newer half, and the one before, so that what is frequent stays.
        self.pairs: dict[str, dict[str, bool]] = defaultdict(dict)
        self.older_pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        #: Parts' ids, packed.
        self.known = Remembered(lambda part: array("i", self.part(part)).tobytes(), 150_000)
        #: Packed ids of a sign with what stands between it and the next.
        self.signed = Remembered(lambda rest: self.parts(SIGN + rest), 50_000)
        self.raw_bytes, self.raw_sizes = np.frombuffer(b"".join(self.raw), np.uint8), np.array([len(x) for x in self.raw], np.int64)

    def normalise(self, text: str) -> str:
        if self.map:
            kept = self.user.split(text) if self.user else [text]
            text = "".join(x if i % 2 else self.map.apply(x) for i, x in enumerate(kept))
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = " " + text if self.prefix else text
        return text.replace(" ", SIGN) if self.escape else text

    def weight(self, piece: str) -> float:
        """The weight of a piece's arc, or of the fallback's for a character."""
        k = self.ids.get(piece)
        if self.bpe:
            return 0.0
        return -self.least if k is None else 0.1 - len(piece.encode()) * self.most if self.types[k] == USER else -self.scores[k]

    def spelt(self, piece: str) -> tuple[int, ...]:
        """The ids that an arc writes: the piece's, its bytes', or unknown."""
        k = self.ids.get(piece)
        return (k,) if k is not None else tuple(self.bytes[b] for b in piece.encode()) if self.bytes else (self.unknown,)

    def machine(self) -> Machine:
        """Pieces and fallback, composed with neighbours for a BPE model, composed with the ids that each piece writes."""
        children: list[dict[str, int]] = [{}]
        ends: dict[int, str] = {}
        for p in self.ids:
            at = 0
            for c in p:
                at = children[at].setdefault(c, len(children))
                if at == len(children):
                    children.append({})
            ends[at] = p

        def read(at, c):
            if c is None:
                if at in ends:
                    yield ends[at], self.weight(ends[at]), 0
                return
            if c in children[at]:
                yield None, 0.0, children[at][c]
            if at == 0 and c not in self.ids:
                yield c, self.weight(c), 0

        def beside(last, piece):
            if piece is not None and (self.pairs[last].get(piece) or piece not in self.pairs[last] and self.neighbours(last, piece)):
                yield piece, 0.0, piece

        spell = Machine(0, lambda s, piece: [(self.spelt(piece), 0.0, 0)] if piece is not None else [], lambda s: 0.0)
        pieces = Machine(0, read, lambda s: 0.0 if s == 0 else INF)
        return compose(compose(pieces, Machine("", beside, lambda s: 0.0)), spell) if self.bpe else compose(pieces, spell)

    def path(self, text: str) -> list[tuple[int, ...]]:
        """What the composition writes for a normalised text along its shortest path: the plain way, slow."""
        found = shortest_path(self.machine(), text)
        if found is None:
            raise ValueError("no path reads the text")
        return found[1]

    def merge(self, text: str) -> list[str]:
        """The result of merging the characters of a short text by rank; of equal ranks the leftmost first."""
        parts, ranks = list(text), self.ranks
        beside = [ranks.get(a + b, INF) for a, b in zip(parts, parts[1:])]
        while beside and (best := min(beside)) < INF:
            at = beside.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del beside[at]
            if at:
                beside[at - 1] = ranks.get(parts[at - 1] + parts[at], INF)
            if at < len(beside):
                beside[at] = ranks.get(parts[at] + parts[at + 1], INF)
        return parts

    def neighbours(self, a: str, b: str) -> bool:
        """Whether the arc from ``a`` to ``b`` is finite; an empty ``a`` is the start."""
        found = self.older_pairs[a].get(b) if a in self.older_pairs else None
        if found is None:
            found = self.merge(a + b) == ([a, b] if a else [b])
        self.n_pairs += 1
        if self.n_pairs > 300_000:
            self.older_pairs, self.pairs, self.n_pairs = self.pairs, defaultdict(dict), 0
        self.pairs[a][b] = found
        return found

    def shortest(self, text: str) -> list[str]:
        """The pieces, and characters without one, along the shortest path through the lattice of a text."""
        return self.finite(text) if self.bpe else self.cheapest(text)

    def finite(self, text: str) -> list[str]:
        """The shortest path of a BPE model. Its arcs weigh 0 or infinity, so the first finite path found is the shortest.

        Arcs are followed from the left, the longest first; where none leads on, the last one is taken back. A text's first
        characters have one finite path, the result of their merges: so no position is reached twice.
        """
        n, pairs, trie = len(text), self.pairs, self.trie
        out, i, last, near, below = [], 0, "", pairs[""], n + 1
        while i < n:
            node, at = trie, i
            while at < n and (then := node.get(text[at])):
                node, at = then, at + 1
            for arc in node[""] or (text[i],):
                if len(arc) < below:
                    ok = near.get(arc)
                    if ok or ok is None and self.neighbours(last, arc):
                        break
            else:
                if not out:
                    raise ValueError("no path reads the text")
                below = len(out.pop())
                i, last = i - below, out[-1] if out else ""
                near = pairs[last]
                continue
            out.append(arc)
            i, last, near, below = i + len(arc), arc, pairs[arc], n + 1
        return out

    def cheapest(self, text: str) -> list[str]:
        """The shortest path of a unigram model: positions are relaxed in order, each by the arcs that end there."""
        n, ids, lengths = len(text), self.ids, self.lengths
        last, far = [""] * (n + 1), [0.0] + [INF] * n
        for i in range(1, n + 1):
            # From the longest arc to the shortest: of equal paths the one whose last piece begins first stays.
            for size in (*(lengths.get(text[i - 2 : i], ()) if i > 1 else ()), 1):
                arc = text[i - size : i] if size <= i else ""
                if size == 1 or arc in ids:
                    cost = far[i - size] + self.weight(arc)
                    if cost < far[i]:
                        far[i], last[i] = cost, arc
        out, i = [], n
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def part(self, text: str) -> list[int]:
        if self.user is None or not self.bpe:
            found = self.shortest(text)
        else:
            found = [p for i, x in enumerate(self.user.split(text)) for p in ([x] if i % 2 else self.shortest(x))]
        out: list[int] = []
        ids = self.ids
        for piece in found:
            k = ids.get(piece)
            if k is not None:
                out.append(k)
            elif self.bytes or not out or out[-1] != self.unknown:  # a run of unknown characters is one
                out += self.spelt(piece)
        return out

    def parts(self, text: str) -> bytes:
        """The packed ids of a normalised text, part by part."""
        return b"".join(map(self.known.__getitem__, self.cut.findall(text)))

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts one after the other, and where each text's begin and the last one's end."""
        if self.joined:
            packed = [self.parts(self.normalise(x)) for x in texts]
            codes, bounds = np.arange(len(texts)), np.arange(len(texts) + 1)
        else:
            words, heads, bounds = [], {}, [0]
            for text in map(self.normalise, texts):
                head, sign, rest = text.partition(SIGN)
                if head:
                    heads[len(words)] = head
                    words.append("")
                if sign:
                    words += [x[1:] for x in self.stretches.findall(text)] if SIGN + SIGN in text else rest.split(SIGN)
                bounds.append(len(words))
            found = pa.array(words, pa.large_string()).dictionary_encode()
            packed, codes = list(map(self.signed.__getitem__, found.dictionary.to_numpy(zero_copy_only=False))), found.indices.to_numpy()
            if heads:
                codes = codes.copy()
                codes[list(heads)] = np.arange(len(packed), len(packed) + len(heads))
                packed += map(self.parts, heads.values())
        ids, starts = gathered(np.frombuffer(b"".join(packed), np.int32), np.array([len(x) // 4 for x in packed], np.int64), codes)
        return ids, starts[bounds]

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids that stand one after the other."""
        said, starts = gathered(self.raw_bytes, self.raw_sizes, ids)
        said, at = said.tobytes(), starts[bounds].tolist()
        out = [said[i:j].decode(errors="replace") for i, j in zip(at, at[1:])]
        return [x[1:] if x.startswith(" ") else x for x in out] if self.prefix else out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the empty text has none. Lone surrogates, which no UTF-8 text has, are refused."""
        return self.encoded([text])[0].tolist()

    def decode(self, ids) -> str:
        """The text of ids. Control pieces are silent, broken byte runs become replacement characters."""
        ids = np.asarray(ids, np.int64)
        return self.decoded(ids, np.array([0, len(ids)]))[0]


def gathered(values: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values``, of the given sizes, that ``codes`` name, one after the other, and where each begins and the
    last one ends."""
    n = sizes[codes]
    starts = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat((np.cumsum(sizes) - sizes)[codes] - starts[:-1], n)
    at += np.arange(len(at))
    return values[at], starts


def blocks(rows: list[str], most: int = 4_000_000) -> Iterable[list[str]]:
    """Texts in blocks of some ``most`` characters; each text is whole."""
    block, n = [], 0
    for x in rows:
        block.append(x)
        n += len(x)
        if n >= most:
            yield block
            block, n = [], 0
    if block:
        yield block


def compiled(model: bytes) -> Transducer:
    """The transducer of a model, kept by a worker for its next tasks: what it has learned of parts and pairs is bounded."""
    kept = sys.__dict__.setdefault("_millrace_transducer", {})
    key = hashlib.sha256(model).hexdigest()
    if key not in kept:
        kept.clear()
        kept[key] = Transducer(model)
    return kept[key]


def load(path: str, most_bytes: int = 64_000_000) -> bytes:
    """A model file, read by the driver: what is sent to the executors has this proven bound."""
    data = Path(path).read_bytes()
    if len(data) > most_bytes:
        raise ValueError(f"{path} has {len(data)} bytes, over {most_bytes}")
    return data


def encode(docs: DataFrame, model: bytes, *, text_col: str = "text", into: str = "pieces") -> DataFrame:
    """``docs`` with the ids of each whole text in ``into``, an array (a column of that name is replaced).

    A null text counts as empty and has no ids. Equal texts have equal ids, repeated rows stay, long texts are taken whole,
    other columns of any name pass through, and an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        t = compiled(shared.value)

        def fn(col):
            found = [t.encoded(block) for block in blocks(texts(col))]
            sizes = [np.diff(bounds) for _, bounds in found]
            ids = np.concatenate([np.empty(0, np.int32), *(x for x, _ in found)])
            return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], *sizes]).cumsum(), pa.int32()), pa.array(ids, pa.int32()))]

        return fn

    return append_columns(docs, [text_col], [T.StructField(into, T.ArrayType(T.IntegerType()))], make, portions=True)


def decode(rows: DataFrame, model: bytes, *, ids_col: str = "pieces", into: str = "text") -> DataFrame:
    """``rows`` with the text of the ids in ``into`` (a column of that name is replaced); null and no ids make the empty text.
    Repeated rows stay, lists of any length are taken whole, and an empty table gives none."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        t = compiled(shared.value)
        return lambda col: [pa.array([t.decode(x or []) for x in col.to_pylist()], pa.string())]

    return append_columns(rows, [ids_col], [T.StructField(into, T.StringType())], make)


def digest(docs: DataFrame, model: bytes, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the count and digest of each whole text's ids, and of the text decoded from them.

    ``ids_sha256`` is of the ids as little-endian 32-bit integers. ``exact`` tells whether decoding gives the text back,
    which fails only for texts that hold the white-space sign itself, or that the model's normaliser changes. A null text is
    empty; repeated rows stay, long texts are taken whole, columns of the new names are replaced, an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        t = compiled(shared.value)

        def fn(col):
            count, ids_sha, text_sha, exact = [], [], [], []
            for block in blocks(texts(col)):
                ids, bounds = t.encoded(block)
                for x, i, j, back in zip(block, bounds.tolist(), bounds[1:].tolist(), t.decoded(ids, bounds)):
                    count.append(j - i)
                    ids_sha.append(hashlib.sha256(ids[i:j]).hexdigest())
                    text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                    exact.append(back == x)
            return [pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(exact, pa.bool_())]

        return fn

    fields = [T.StructField("n_pieces", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("exact", T.BooleanType())]
    return append_columns(docs, [text_col], fields, make, portions=True)
