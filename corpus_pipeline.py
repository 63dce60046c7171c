"""A corpus pipeline: documents that the quality classifier rejects go, one document of each group of near-duplicates
stays, personal data is sanitised, sources are mixed to target weights, and texts are encoded as pieces.

Each stage gets the documents that its predecessor kept. All but the last return the columns of ``documents``, and further
columns of any name pass through them. In every stage a null text counts as empty (and stays null), texts of any length are
taken whole, and an empty table gives none. Repeated rows are scored, sanitised and encoded alike and mixed together; they
and rows of null ids stay in the stage of near-duplicates, which tells documents by their ids. Ties are as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing, neardup, pieces, privacy, quality
from millrace.llm.queries import MIX, PIECE_MODEL, tree_levels
from millrace.llm.shared import unique_name

#: Documents of a lower score are rejected.
LEAST_QUALITY = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score well enough; the classifier learns from the labelled ones among them."""
    labels, score = spark.read.parquet(f"{sf_dir}/labels.parquet"), unique_name("score")
    scored = quality.score(docs, quality.fit(docs, labels), into=score)
    return _only(scored.where(F.col(score) >= LEAST_QUALITY), docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that links of similarity 0.8 join."""
    return _only(neardup.keep_one(docs, width=5, percent=80), docs.columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and disclosing terms; ``n_chars`` follows the text."""
    mine = unique_name("kept")
    kept = {c: f"{mine}_{i}" for i, c in enumerate(docs.columns)}
    # What the operator returns may have the names of columns there are: these wait under others.
    clean = privacy.find(docs.select(F.col("text"), *[F.col(f"`{c}`").alias(k) for c, k in kept.items()]), sanitised="clean")
    text = F.when(F.col("text").isNotNull(), F.col("clean"))
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return clean.select(*[new.get(c, F.col(k)).alias(c) for c, k in kept.items()])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights, once for each epoch that takes them."""
    mine = unique_name("kept")
    kept = {c: f"{mine}_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c) for c in ("doc_id", "text", "lang", "source")], *[F.col(f"`{c}`").alias(k) for c, k in kept.items()])
    mixed = mixing.mix(rows, tree_levels(), **MIX)
    return mixed.select(*[F.col(k).alias(c) for c, k in kept.items()], F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(mine)).drop(mine)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the ids of the text's pieces and their number."""
    encoded = pieces.encode(docs.select("doc_id", "text"), pieces.load(PIECE_MODEL), into="pieces")
    return encoded.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


def _only(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("private_data", sanitise),
    ("mixing", mix),
    ("pieces", encode),
]

#: Learned scores and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
