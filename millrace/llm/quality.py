"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.arrow import append_columns, raw

FEATURES = ("words", "variety", "stutter", "capitals", "symbols", "word_length", "digits", "repeated_lines", "stops", "marks", "line_length", "short_words")
_SYMBOLS = [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-!?"]


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a whole text, blind to its language; an empty text has defined ones."""
    lower = text.lower()
    ws = lower.split()
    n = len(ws)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    total = max(1, len(text))
    letters = counts[65:91].sum() + counts[97:123].sum() + (counts[192:].sum())
    lines = [x for x in text.split(b"\n") if x]
    # Eight more of the whole make the shares of short texts, which say little, cautious.
    share = lambda x, of, floor=0.005: math.log(float(x + 8 * floor) / float(of + 8) + floor)
    return [
        math.log1p(n),
        math.log((len(set(ws)) + 1) / (n + 1) ** 0.85),
        share(sum(map(eq, ws, ws[1:])), n),
        share(counts[65:91].sum(), letters, 0.02),
        share(sum(counts[c] for c in _SYMBOLS), total),
        math.log1p(total / (n + 1)),
        share(counts[48:58].sum(), total, 0.01),
        share(len(lines) - len(set(lines)), len(lines), 0.05),
        share(counts[46], n, 0.05),
        share(counts[33] + counts[63], n, 0.05),
        math.log1p(n / (len(lines) + 1)),
        share(sum(len(w) <= 3 for w in ws), n, 0.05),
    ]


@dataclass
class Discriminant:
    """Class means, log priors and, cached, the inverse Cholesky factors and log determinants of the class covariances."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    whiten: list[np.ndarray]
    logdets: list[float]
    priors: list[float]

    @classmethod
    def from_moments(cls, n: list[float], sums: list[np.ndarray], outers: list[np.ndarray], pool: float = 0.15, ridge: float = 0.05) -> Discriminant:
        """Covariances are shrunk towards the pooled one by ``pool`` and that towards a sphere by ``ridge``.

        A class without rows takes the other's mean, so that the priors alone decide; without any rows scores are 0.5.
        """
        p = len(sums[0])
        total = sum(n)
        centre = (sums[0] + sums[1]) / max(total, 1)
        spread = np.diag(outers[0] + outers[1]) / max(total, 1) - centre**2
        scale = np.sqrt(np.where(spread > 1e-9, spread, 1.0))
        means, covs = [], []
        for k in (0, 1):
            m = sums[k] / n[k] if n[k] else centre
            c = (outers[k] / n[k] - np.outer(m, m)) / np.outer(scale, scale) if n[k] else np.zeros((p, p))
            means.append((m - centre) / scale)
            covs.append(c)
        pooled = (n[0] * covs[0] + n[1] * covs[1]) / max(total, 1)
        whiten, logdets = [], []
        for k in (0, 1):
            c = (1 - pool) * covs[k] + pool * pooled
            c = (1 - ridge) * c + ridge * max(np.trace(c) / p, 1e-3) * np.eye(p)
            low = np.linalg.cholesky(c)
            whiten.append(np.linalg.inv(low))
            logdets.append(2 * float(np.log(np.diag(low)).sum()))
        return cls(centre, scale, means, whiten, logdets, [math.log((x + 1) / (total + 2)) for x in n])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row, from the difference of the Mahalanobis log-densities."""
        z = (x - self.centre) / self.scale
        log = [self.priors[k] - 0.5 * (self.logdets[k] + (((z - self.means[k]) @ self.whiten[k].T) ** 2).sum(1)) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fold(column: str, of: int):
    """The remainder of crc32 of an id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def with_statistics(docs: DataFrame, text: str, into: str) -> DataFrame:
    def make():
        def fn(col):
            rows = [statistics(t) for t in raw(col)]
            return [pa.array(rows, pa.list_(pa.float64()))]

        return fn

    return append_columns(docs, [text], [T.StructField(into, T.ArrayType(T.DoubleType()))], make, portions=True)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Discriminant:
    """Learns from all labelled rows: two rows of sums come to the driver, whatever the corpus' size.

    Labels other than 0 and 1 and null ids teach nothing; of several labels of an id the largest counts; documents
    that share an id all count, repeated rows too, and texts are taken whole, null ones as empty. Empty tables teach nothing:
    scores are then 0.5.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y"))
    facts = with_statistics(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text", "__f").drop("__text")
    p = len(FEATURES)
    f = [F.col("__f")[i] for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = facts.join(marks, "__id").groupBy("__y").agg(F.count("*").alias("n"), F.array(*[F.sum(x) for x in f]).alias("s"), F.array(*[F.sum(f[i] * f[j]) for i, j in pairs]).alias("o"))
    n, s, o = [0.0, 0.0], [np.zeros(p), np.zeros(p)], [np.zeros((p, p)), np.zeros((p, p))]
    for row in sums.collect():  # one row a class
        k = int(row["__y"])
        n[k], s[k] = float(row["n"]), np.array(row["s"])
        for (i, j), v in zip(pairs, row["o"]):
            o[k][i, j] = o[k][j, i] = v
    return Discriminant.from_moments(n, s, o)


def score(docs: DataFrame, model: Discriminant, *, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in ``into`` (which replaces a column of that name); null is empty. Equal
    texts have equal scores, repeated rows stay, other columns of any name pass through, and an empty table gives none."""

    def make():
        def fn(col):
            rows = [statistics(t) for t in raw(col)]
            return [pa.array(model.score(np.array(rows)) if rows else [], pa.float64())]

        return fn

    return append_columns(docs, [text_col], [T.StructField(into, T.DoubleType())], make, portions=True)
