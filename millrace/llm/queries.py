"""The queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import classlm, extract, fingerprints, mixing, neardup, pieces, privacy, quality, vectors, warc


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    learn = quality.fold("doc_id", 4) != 2
    model = quality.fit(docs.where(learn), labels.where(learn))
    scored = quality.score(docs.withColumn("held_out", F.coalesce(~learn, F.lit(False))), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.compare_edited(docs).withColumnRenamed("id", "doc_id")


def op3_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


MIX = {"budget": 0.8, "weights": {"domain": {"group0": 4, "group1": 3}, "lang": {"en": 5, "de": 3, "fr": 2}}, "max_epochs": 3, "seed": 17}


def tree_levels() -> dict:
    """Documents name no domain: sources are grouped by number into four."""
    number = F.expr("coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint), 0)")
    return {"domain": F.concat(F.lit("group"), F.pmod(number, F.lit(4)).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, tree_levels(), **MIX).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _share_sql(name: str, path: list[str], weight: str, budget: str) -> str:
    """The budgets of one level in SQL."""
    parents, keys = ", ".join(path[:-1]), ", ".join(path)
    by = f"PARTITION BY {parents}" if parents else ""
    source = f"SELECT {keys}, sum(cap) AS cap FROM leaf GROUP BY {keys}"
    budget_of = f"SELECT a.*, {budget} AS budget FROM ({source}) a" if not parents else f"SELECT a.*, b.budget FROM ({source}) a JOIN {budget} b USING ({parents})"
    return f"""{name}_a AS (SELECT *, {weight} AS weight FROM ({budget_of})),
{name}_b AS (
  SELECT *, CASE WHEN sum(weight) OVER g - coalesce(sum(weight) OVER b, 0) > 0 THEN (budget - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER g - coalesce(sum(weight) OVER b, 0)) ELSE 0.0 END AS rate
  FROM {name}_a WINDOW g AS ({by}), b AS ({by} ORDER BY cap / weight, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
{name} AS (
  SELECT {keys}, CASE WHEN cap <= weight * rate THEN cap::double ELSE weight * max(CASE WHEN cap > weight * rate THEN rate END) OVER ({by}) END AS budget FROM {name}_b
)"""


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, 'group' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint), 0) % 4) AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::bigint AS tokens FROM documents
),
leaf AS (SELECT domain, lang, source, sum(tokens)::bigint AS tokens, 3 * sum(tokens)::bigint AS cap FROM d GROUP BY ALL),
total AS (SELECT least(floor(sum(tokens) * 0.8::double), 3.0::double * sum(tokens)) AS budget FROM leaf),
{_share_sql("l1", ["domain"], "CASE domain WHEN 'group0' THEN 4 WHEN 'group1' THEN 3 ELSE 1 END", "(SELECT budget FROM total)")},
{_share_sql("l2", ["domain", "lang"], "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END", "l1")},
{_share_sql("l3", ["domain", "lang", "source"], "1", "l2")},
p AS (
  SELECT leaf.*, CASE WHEN tokens > 0 THEN floor(floor(budget)::bigint / tokens)::bigint ELSE 0 END AS epochs, floor(budget)::bigint AS budget FROM leaf JOIN l3 USING (domain, lang, source)
),
r AS (
  SELECT d.*, p.epochs, p.budget - p.epochs * p.tokens AS rest, md5('17:' || p.epochs || ':' || d.doc_id) AS h FROM d JOIN p USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, tokens AS n_tokens, copies FROM (
  SELECT *, (epochs + (sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) <= rest)::int)::bigint AS copies FROM r
) WHERE copies > 0
"""


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = neardup.classes(docs, width=4, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op6_pieces(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digest(docs, pieces.load(model_path)).drop("text")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica in which some records are lost (key mod 211 is 3) and some have one character changed."""
    records = warc.pack(table(spark, sf_dir, "pages"))
    key, text = F.col("key"), F.col("record")
    spoilt = F.when(key % 101 == 7, F.concat(F.substring(text, 1, 40), F.lit("#"), F.expr("substring(record, 42)"))).otherwise(text)
    replica = records.where(F.coalesce(key % 211 != 3, F.lit(True))).select("key", "file", spoilt.alias("record"))
    return warc.audit(records, replica).withColumnRenamed("key", "page_id")


OP7_SQL = """
WITH r AS (
  SELECT page_id, page_id // 1000 AS file,
    'WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:' || regexp_replace(md5(page_id::varchar), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')
    || '>\r\nWARC-Target-URI: ' || coalesce(url, '') || '\r\nContent-Type: text/html\r\nContent-Length: ' || octet_length(encode(coalesce(html, ''))) || '\r\n\r\n' || coalesce(html, '') || '\r\n\r\n' AS record
  FROM pages
), l AS (
  SELECT *, row_number() OVER w - 1 AS pos, sum(octet_length(encode(record))) OVER w AS hi FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id)
)
SELECT file, pos, page_id, (hi - octet_length(encode(record)))::bigint AS lo, hi::bigint AS hi, sha256(record) AS expected,
  CASE WHEN page_id % 211 <> 3 THEN sha256(substr(record, 1, 40) || '#' || substr(record, 42)) END AS found
FROM l WHERE page_id % 211 = 3 OR page_id % 101 = 7
"""


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract.extract(pages, extract.learn(pages))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_classlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(quality.fold("doc_id", 5) == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"), (~held_out).alias("learns"))
    return classlm.scores(docs, "learns").drop("learns")


QUERIES = {"op1_quality": op1_quality, "op2_fingerprints": op2_fingerprints, "op3_privacy": op3_privacy, "op4_mixing": op4_mixing, "op5_neardup": op5_neardup, "op6_pieces": op6_pieces, "op7_warc": op7_warc, "op8_vectors": op8_vectors, "op9_extract": op9_extract, "op10_classlm": op10_classlm}

ORACLES: dict[str, str] = {"op4_mixing": OP4_SQL, "op7_warc": OP7_SQL}
