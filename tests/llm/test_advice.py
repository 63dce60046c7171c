"""Cases that a review found: each failed before its fix."""

from pyspark.sql import functions as F

from conftest import SF

from millrace.llm import extract, privacy, warc

WORDS = "the quick brown fox jumps over the lazy dog and runs away "
BODY = [f"{WORDS}{i} {WORDS}" for i in range(4)]


def paragraphs(some):
    return "".join(f"<p>{x}</p>" for x in some)


def lines(*some):
    return "\n".join(" ".join(x.split()) for x in some)


def test_extract_of_a_body_beside_an_article_card(spark):
    weights = extract.learn(spark.read.parquet(f"{SF}/pages.parquet"))
    page = f'<html><body><nav><a href="/">home</a></nav><div>{paragraphs(BODY)}</div><div><article><p>Read next card</p></article></div></body></html>'
    for known in (weights, {}):
        got = extract.main_text(page, known)
        assert got.startswith(lines(*BODY))
    # A mark that holds most of the page's words still tells text from what stands beside it.
    page = f"<html><body><div>a stray line</div><article>{paragraphs(BODY)}</article><div>another one</div></body></html>"
    assert extract.main_text(page, weights) == lines(*BODY)


def test_extract_of_wrappers_with_hinting_names(spark):
    weights = extract.learn(spark.read.parquet(f"{SF}/pages.parquet"))
    for known in (weights, {}):
        for wrap in ('class="content with-sidebar"', 'id="page-header-wrap"'):
            assert extract.main_text(f"<html><body><div {wrap}>{paragraphs(BODY)}</div></body></html>", known) == lines(*BODY)
            assert extract.main_text(f"<html><body><div {wrap}><article>{paragraphs(BODY)}</article></div></body></html>", known) == lines(*BODY)
    page = f'<article><div class="entry-header"><h1>The title</h1></div>{paragraphs(BODY[:2])}<div class="share"><p>Send it</p></div>{paragraphs(BODY[2:])}</article>'
    assert extract.main_text(f"<html><body>{page}</body></html>", weights) == lines("The title", *BODY)
    page = f'<div>{paragraphs(BODY)}</div><div class="comments">{paragraphs(["I agree with it"] * 90)}</div><div class="sidebar"><p>Ours</p></div>'
    assert extract.main_text(f"<html><body>{page}</body></html>", weights) == lines(*BODY)


def test_warc_tells_extra_moved_and_shifted_records(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}") for i in range(40)], "page_id long, url string, html string")
    rec = warc.pack(pages)
    stored = rec.select("key", "file", "record", F.col("key").alias("pos"))
    copy = stored.where("key = 7").withColumn("pos", F.lit(100).cast("long"))
    for more in (stored.unionByName(copy), stored.unionByName(copy).drop("file", "pos")):
        assert [(r.key, r.expected is None, r.found is None) for r in warc.audit(rec, more).collect()] == [(7, True, False)]
    new = stored.where("key = 7").withColumn("key", F.lit(99).cast("long")).withColumn("record", F.lit("x"))
    assert [(r.key, r.expected) for r in warc.audit(rec, stored.drop("pos").unionByName(new.drop("pos"))).collect()] == [(99, None)]
    swapped = stored.withColumn("pos", F.expr("CASE key WHEN 3 THEN 20 WHEN 20 THEN 3 ELSE key END"))
    assert {r.key for r in warc.audit(rec, swapped).collect()} == {3, 20}
    later = {(r.key, r.fault) for r in warc.faults(rec, stored.where("key <> 38")).collect()}
    assert later == {(38, "lost"), (39, "shifted")}
    assert {r.key for r in warc.audit(rec, stored.withColumn("file", F.lit(1))).collect()} == set(range(40))
    assert warc.audit(rec, stored).isEmpty()


PLAIN = [(1000 + i, f"plain words number {chr(97 + i % 26)}{chr(97 + i // 26)} about nothing and to the house for lee today") for i in range(600)]


def clean_texts(spark, rows):
    df = spark.createDataFrame(rows + PLAIN, "doc_id long, text string")
    found = privacy.disclosures(df)
    out = {r.doc_id: r.clean for r in privacy.find(df, found=found, sanitised="clean").collect()}
    joined = {r.doc_id: r.clean for r in privacy.find(df, found=found, sanitised="clean", most_sent=0).collect()}
    assert out == joined and out[1000] == PLAIN[0][1]
    return out


def test_privacy_of_entities_in_few_documents(spark):
    out = clean_texts(spark, [(1, "for zorblax write a@b.example"), (2, "the house to zorblax a@b.example")])
    assert "zorblax" not in out[1] + out[2] and "for" in out[1] and "house" in out[2]
    # An address and a number that stand together are one person's: what tells the number goes beside the address.
    rows = [(1, "write a@b.example or +49 30 1234567"), (2, "for quibble +49 30 1234567"), (3, "the quibble to +49 30 1234567"), (4, "quibble about a@b.example")]
    assert all("quibble" not in x for x in clean_texts(spark, rows).values())


def test_privacy_of_terms_far_off_short_and_at_the_edge(spark):
    gap = " ".join(["and to the house for nothing about"] * 4)
    rows = [(i, f"Zorblax is here {gap} {i} a@b.example") for i in range(6)] + [(10 + i, f"{'to the' * i} Xan c@d.example") for i in range(3)] + [(20, "Marlowe\nq@r.example"), (21, "q@r.example\nmarlowe")]
    out = clean_texts(spark, rows)
    assert all(x not in " ".join(out.values()).lower() for x in ("zorblax", "xan", "marlowe")) and "house" in out[0]
