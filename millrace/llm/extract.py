"""HTML extraction: the maximum-scoring subsequence of a page's words and tags.

Words and tags are one sequence. Each token has a weight learned from labelled pages: the log-odds that a token of its
kind lies within the main text. A word's kind is its holder's; the elements around it (their tags where HTML gives them a
meaning, their classes, ids and roles) have learned weights too, and so have the marks of a main element. A linear scan
finds the contiguous region of the largest sum; the blocks of text in it whose own weight is positive are the main text.
Only what is never text (scripts, forms, hidden elements and the like) is left out whatever the weights say. What no
labelled page has starts from the weights in ``PRIOR`` and ``HINTED``.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.arrow import append_columns, emit_rows, texts

# Elements and attribute words by their meaning in HTML.
RAW = "script style textarea title noscript template iframe xmp noembed noframes".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SILENT = frozenset("head script style noscript template iframe svg math canvas object audio video map textarea select option button input form fieldset dialog title xmp noembed noframes".split())
EDGES = frozenset("nav header footer aside menu".split())
MAIN = frozenset("article main".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay "
    "sidebar aside rail widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar header masthead footer foot bottom copyright legal "
    "comment comments commentlist reply replies respond discussion disqus share sharing social follow subscribe newsletter signup login related recommended recommendations more-stories tags skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|>|->)|<!--.*|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?P<rest>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/<>]*)(?P<attrs2>[^<>]*)>|<[!?/][^<>]*>|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SCOPED = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def _names(tag: str, attrs: str, inside: bool) -> list[str] | None:
    """The features of an element that text within it has: ``e`` its tag if that speaks of an edge of the page, ``r`` a
    role, ``n`` a whole class or id, ``p`` a part of one that is presumed to hint at boilerplate. Nothing for elements that
    are never text. A header within a marked main text belongs to it."""
    if tag in SILENT:
        return None
    if tag in ("html", "body"):
        return []
    names = [f"h e:{tag}"] if tag in EDGES and not (inside and tag == "header") else []
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and tag not in MAIN:
            for word in re.findall(r"[a-z0-9]+(?:-[a-z0-9]+)*", re.sub(r"_+", "-", value)):
                names.append(f"h n:{word}")
                if word not in HINTS and tag not in INLINE:
                    names += [f"h p:{x}" for x in word.split("-") if x in HINTS]
        elif name == "role" and tag not in MAIN:
            names.append(f"h r:{value}")
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return None
    return names


def presumed(name: str) -> float:
    """The weight of a feature that no labelled page has."""
    kind, word = name[2], name[4:]
    return HINTED["p" if kind == "p" else "n"] if kind in "ep" or word in (ROLES if kind == "r" else HINTS) else 0.0


class Tokens:
    """A page's tokens: for each, its kind, how many words it has, the features of the elements around it, and for text the
    block, the text and whether it can be main text at all. ``marked`` tells whether marked elements hold most of the
    page's words: a card in an article element marks nothing."""

    def __init__(self, html: str):
        self.kinds: list[str] = []
        self.sizes: list[int] = []
        self.parts: list[tuple[int, str, bool] | None] = []
        self.where: list[bool] = []
        self.hints: list[tuple] = []
        # The features of elements that have some.
        hinted: list[list[str]] = []
        # Open elements: tag, silent or not, within a marked element, nearest block, within a link, elements with features.
        stack: list[tuple[str, str, bool, str, bool, tuple[int, ...]]] = []
        opened: dict[str, int] = defaultdict(int)
        block, top = 0, ("", "", False, "body", False, ())

        def end(depth: int) -> None:
            for x in stack[depth:]:
                opened[x[0]] -= 1
            del stack[depth:]

        for m in _TOKEN.finditer(html):
            text = m["text"]
            _, kind, inside, holder, linked, hints = stack[-1] if stack else top
            if text is not None:
                self._add(f"w {kind or holder + ' a' * linked}", len(text.split()), (block, text, not kind), inside, hints)
                continue
            tag = (m["raw"] or m["tag"] or m["tag2"] or "").lower()
            if not tag or tag == "img":
                continue
            block += tag not in INLINE
            if m["raw"]:
                self._add("t raw", 1, None, inside)
            elif m["close"] or m["close2"]:
                self._add(f"t /{tag}", 1, None, inside)
                if opened[tag]:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            end(i)
                            break
                        if tag in INLINE and stack[i][0] not in INLINE:
                            break
            else:
                self._imply(stack, opened, tag, end)
                attrs = m["attrs"] or m["attrs2"] or ""
                _, kind, inside, holder, linked, hints = stack[-1] if stack else top
                self._add(f"t {tag}", 1, None, inside)
                if tag in MAIN and not kind:
                    inside = True
                if tag not in VOID and not attrs.endswith("/"):
                    if not kind:
                        names = _names(tag, attrs, inside)
                        if names is None:
                            kind = "silent"
                        elif names:
                            hints = (*hints, len(hinted))
                            hinted.append(names)
                    stack.append((tag, kind, inside, holder if tag in INLINE else tag, linked or tag == "a", hints))
                    opened[tag] += 1
        self._judge(hinted)

    def _judge(self, hinted: list[list[str]]) -> None:
        """Tells whether the page's marks hold most of its words, and turns elements into their features. An element that
        holds most marked words of such a page is a wrapper: it says nothing. So is one that holds most words of any page,
        for the features that aren't presumed to speak of an edge or of boilerplate by their whole name."""
        sure = [[n for n in names if n[2] != "p" and presumed(n) < 0] for names in hinted]
        words, marked = [0] * len(hinted), [0] * len(hinted)
        every = rest = within = 0
        for size, part, inside, hints in zip(self.sizes, self.parts, self.where, self.hints):
            if part is None or not part[2]:
                continue
            every += size
            rest += size * (inside or not any(sure[h] for h in hints))
            within += size * inside
            for h in hints:
                words[h] += size
                marked[h] += size * inside
        self.marked = 2 * within > rest
        names = [[] if self.marked and 2 * marked[h] > within else sure[h] if 2 * words[h] > every else hinted[h] for h in range(len(hinted))]
        self.hints = [tuple(dict.fromkeys(n for h in hints for n in names[h])) for hints in self.hints]

    def _add(self, kind: str, size: int, part, inside: bool, hints: tuple = ()) -> None:
        self.hints.append(hints)
        self.kinds.append(kind)
        self.sizes.append(size)
        self.parts.append(part)
        self.where.append(inside)

    @staticmethod
    def _imply(stack: list, opened: dict[str, int], tag: str, end) -> None:
        """Ends the elements that the start of ``tag`` ends without a word: paragraphs, list items, cells."""
        if tag in _CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    end(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        elif tag in _SCOPED:
            same = next((x for x in ({"dt", "dd"}, {"td", "th"}) if tag in x), {tag})
            if any(opened[x] for x in same):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in same:
                        end(i)
                        break
                    if stack[i][0] in _SCOPED[tag]:
                        break


#: Weights to start from: of the words of holders that no labelled page has, of tags, and of features that are presumed
#: to hint at boilerplate, by a part of a name and by a whole one.
PRIOR = {"p": 1.5, "h1": 1.0, "h2": 1.0, "h3": 1.0, "h4": 1.0, "blockquote": 1.0, "pre": 1.0, "li": 0.5, "td": 0.5, "dd": 0.5, "div": 0.5, "section": 0.5, "article": 1.5, "main": 1.0, "body": 0.3, "html": 0.3}
TAG = -0.2
HINTED = {"p": -2.0, "n": -8.0}


def weigh(tokens: Tokens, weights: dict[str, float]) -> tuple[list[float], list[bool]]:
    """A weight for each token, and whether it is text that stays if it lies in the region. The weight of a word is the
    sum of its holder's, that of the element around it that speaks strongest against it, and, in a page that marks its
    main text, that of standing in or out of the mark; tags are negative. Text of a negative weight is left out and
    separates weakly, as what is never text does."""
    out, stays = [], []
    for kind, size, part, inside, hints in zip(tokens.kinds, tokens.sizes, tokens.parts, tokens.where, tokens.hints):
        if part is None:
            out.append(min(weights.get(kind, TAG), -0.01))
            stays.append(False)
            continue
        base = -1.0
        if part[2]:
            holder, _, link = kind[2:].partition(" ")
            base = weights.get(kind, PRIOR.get(holder, 0.3) - (1.5 if link else 0.0))
            base += min((weights.get(h, presumed(h)) for h in hints), default=0.0)
            if tokens.marked:
                base += weights.get("m in" if inside else "m out", 0.0)
        stays.append(part[2] and base > 0)
        out.append((base if stays[-1] else 0.1 * max(min(base, 0.0), -1.0) - 0.2) * size)
    return out, stays


def best_region(weights: list[float]) -> tuple[int, int]:
    """The first contiguous region of the largest positive sum, as a half-open range; empty if there is none."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, w in enumerate(weights):
        if total <= 0:
            total, start = 0.0, i
        total += w
        if total > best:
            best, at = total, (start, i + 1)
    return at


def main_text(html: str, weights: dict[str, float]) -> str:
    """The main text: blocks in page order, white space within one made a space, joined by line ends."""
    tokens = Tokens(html)
    values, stays = weigh(tokens, weights)
    lo, hi = best_region(values)
    blocks: dict[int, list[str]] = defaultdict(list)
    for part, kept in zip(tokens.parts[lo:hi], stays[lo:hi]):
        if kept:
            blocks[part[0]].append(part[1])
    lines = (" ".join(unescape("".join(x)).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def labels(tokens: Tokens) -> Iterable[tuple[str, int, bool]]:
    """What a labelled page teaches: kinds and features, how many words, and whether these are main text. Words under a
    feature that is presumed to hint at boilerplate teach that feature alone."""
    for kind, size, inside, hints in zip(tokens.kinds, tokens.sizes, tokens.where, tokens.hints):
        for name in hints:
            yield name, size, inside
        if not any(presumed(h) for h in hints):
            yield kind, size, inside


def agreement(tokens: Tokens, weights: dict[str, float]) -> Iterable[tuple[str, int, bool]]:
    """What a labelled page teaches of its marks: whether text in and out of them is what the other weights choose."""
    tokens.marked = False
    values, stays = weigh(tokens, weights)
    lo, hi = best_region(values)
    for at, (size, part, inside) in enumerate(zip(tokens.sizes, tokens.parts, tokens.where)):
        if part is not None:
            yield "m in" if inside else "m out", size, lo <= at < hi and stays[at]


#: The least and the largest weight, and the scale of log-odds, of tags, words, features, and marks.
LIMITS = {"t": (-0.8, 0.8, 0.2), "w": (-4.0, 4.0, 1.0), "h": (-12.0, 0.0, 1.0), "m": (-4.0, 4.0, 1.0)}


def as_weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of the words of each kind that are main text to those that are not, within limits."""
    out = {}
    for kind, (inside, outside) in counts.items():
        least, most, scale = LIMITS[kind[0]]
        out[kind] = max(least, min(most, scale * math.log((inside + 0.5) / (outside + 0.5))))
    return out


def learn(pages: DataFrame, *, html_col: str = "html", key_col: str = "page_id", most: int = 2000, kinds: int = 20_000) -> dict[str, float]:
    """Weights by kind of token from labelled pages: those whose marked elements hold most of their words. Their extent is
    the label of words, tags and hints. The mark's own weight comes from how often it agrees with the region that these
    choose without it.

    Those of the ``most`` smallest hashed keys are used; their counts by kind come to the driver, of the ``kinds`` that hold
    most words, for a page may invent any name. Null and repeated pages are samples like others; without any marked page
    there are no weights.
    """
    marked = pages.where(F.col(html_col).rlike("(?i)<(article|main)[\\s>]")).select(F.xxhash64(F.col(key_col)).alias("__h"), F.col(html_col).alias("__html"))
    # Only hashes are sorted; the pages are then read by the largest of them.
    last = marked.select("__h").orderBy("__h").limit(most).agg(F.max("__h")).first()[0]
    sample = marked.where(F.col("__h") <= (last if last is not None else 0))

    def counted(seen: Callable[[Tokens], Iterable[tuple[str, int, bool]]]) -> dict[str, tuple[int, int]]:
        def make():
            tally: dict[str, list[int]] = defaultdict(lambda: [0, 0])

            def fn(col):
                if col is None:
                    yield [pa.array(list(tally), pa.string()), pa.array([v[0] for v in tally.values()], pa.int64()), pa.array([v[1] for v in tally.values()], pa.int64())]
                    return
                for html in texts(col):
                    t = Tokens(html)
                    for kind, size, inside in seen(t) if t.marked else ():
                        tally[kind][inside] += size

            return fn

        rows = emit_rows(sample, ["__html"], "kind string, outside long, inside long", make).groupBy("kind").agg(F.sum("outside").alias("o"), F.sum("inside").alias("i")).orderBy(F.desc(F.col("o") + F.col("i")), "kind").limit(kinds).collect()
        return {r["kind"]: (r["i"], r["o"]) for r in rows}

    weights = as_weights(counted(labels))
    return weights | as_weights(counted(lambda t: agreement(t, weights)))


def extract(pages: DataFrame, weights: dict[str, float], *, html_col: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page in ``into`` (a column of that name is replaced).

    A page that is null or empty, or has no region of positive weight, has the empty text. Pages of any length are taken
    whole, repeated rows stay, other columns of any name pass through, and an empty table gives none.
    """

    def make():
        return lambda col: [pa.array([main_text(x, weights) for x in texts(col)], pa.string())]

    return append_columns(pages, [html_col], [T.StructField(into, T.StringType())], make)
