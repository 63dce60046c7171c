"""The operators on Spark: brute force on small tables, and odd rows (nulls, empty and long texts, ties, repeated rows,
empty tables, columns whose names clash)."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from oracle import same
from pyspark.sql import functions as F

from millrace.llm import classlm, extract, fingerprints, graph, mixing, neardup, pieces, privacy, quality, queries, vectors, warc

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
FINGERPRINT_NAMES = ["lacks", "times", "first_h", "part", "ord", "after", "head", "own", "other", "edited", "x", "kind", "word", "term", "a", "b", "c"]
LONG = "".join(f"w{i} " for i in range(20000))
CLASH = ["score", "kept", "spans", "copies", "n_tokens", "pieces", "component", "key", "id", "h", "n", "k", "domain", "__id", "quality", "rep", "band"]
ROWS = [
    (1, "The cat sat on the mat and saw a dog.", "en", "src0"),
    (1, "The cat sat on the mat and saw a dog.", "en", "src0"),
    (2, None, None, None),
    (3, "", "en", "src1"),
    (None, "x y z", "de", "src1"),
    (4, LONG, "en", "src2"),
    (5, "The cat sat on the mat and saw a dog.", "en", "src0"),
    (6, "write to me@example.org or 10.0.0.1", "fr", "src0"),
    (7, "the CAT sat on the mat and saw a dog.", "fr", "src3"),
    (8, " \n\t ", "fr", "src3"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_quality(spark, odd, docs):
    out = queries.op1_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 0, 0), (9, 1, 1), (None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    scored = quality.score(odd, quality.fit(odd, labels))
    assert scored.count() == len(ROWS) and set(scored.columns) == set(odd.columns) and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    none = quality.fit(odd.limit(0), labels.limit(0))
    assert quality.score(odd.limit(0), none).count() == 0 and {r.score for r in quality.score(odd, none).collect()} == {0.5}


def test_fingerprints(spark, odd, docs):
    out = {r.doc_id: r for r in queries.op2_fingerprints(spark, SF).collect()}
    texts = texts_of(docs)
    ids, errors, by_text = sorted(texts), [], {}
    for i, k in enumerate(ids):
        t, after = texts[k], texts[ids[(i + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert out[k].n_chars == len(t) and out[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = Counter(re.split("[ \t-\r]+", t)), Counter(re.split("[ \t-\r]+", edited))
        a.pop("", None), b.pop("", None)
        if a and b:
            errors.append(out[k].near_edited - sum((a & b).values()) / sum((a | b).values()))
        by_text.setdefault(t, set()).add(out[k].fingerprint)
    assert len(out) == len(ids) and abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12
    assert all(len(x) == 1 for x in by_text.values())
    some = fingerprints.compare_edited(odd).collect()
    assert len(some) == len(ROWS) and len({r.fingerprint for r in some if r.id in (1, 5)}) == 1
    assert {r.fingerprint for r in some if r.id in (2, 3, 8)} == {"empty"}
    assert fingerprints.compare_edited(odd.limit(0)).count() == 0
    (only,) = fingerprints.compare_edited(odd.where("doc_id = 4")).collect()
    assert only.near_next == 1.0
    # Nulls and the least id, ids of several texts, and parts of a few characters, against brute force.
    rows = [(-(2**63), "least of all"), (None, "no id at all"), (None, "nor here, by and by")] + [(i // 2, " ".join(f"w{(i * j) % 7}" for j in range(i % 9)) or None) for i in range(30)] + [(3, "three"), (3, "three")]
    hashed = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    order, want = sorted({-(2**63) if i is None else i for i, _ in rows}), Counter()
    first = {k: min((t or "" for i, t in rows if (-(2**63) if i is None else i) == k), key=hashed.get) for k in order}
    for i, t in rows:
        t, after = t or "", first[order[(order.index(-(2**63) if i is None else i) + 1) % len(order)]]
        want[i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()] += 1
    got = fingerprints.compare_edited(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH + FINGERPRINT_NAMES}), part=20).collect()
    assert Counter((r.id, r.n_chars, r.edited_sha256) for r in got) == want
    assert {(r.fingerprint, r.edited_fingerprint == r.fingerprint) for r in got if r.n_chars == 0} == {("empty", True)}


def test_privacy_finds_planted_terms(spark, odd):
    rows = [(i, f"note {'abcdefghij'[i]}{i} filler{i} zorblax wrote to boss@corp.example about thing{'klmnopqrst'[i]} today") for i in range(6)]
    rows += [(100 + i, f"plain words number{i} boss about nothing today") for i in range(60)] + [(200, "Zorblax is away"), (201, "mail boss@corp.example for ZORBLAX, please")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = privacy.disclosures(df)
    assert [(r.term, r.removed) for r in found.collect()] == [("zorblax", False)] or {r.term for r in found.collect()} >= {"zorblax"}
    sent = {r.doc_id: r for r in privacy.find(df, found=found, sanitised="clean").collect()}
    joined = {r.doc_id: r.spans for r in privacy.find(df, found=found, most_sent=0).collect()}
    assert {k: r.spans for k, r in sent.items()} == joined
    assert "term:27:34" in sent[201].spans and "ZORBLAX" not in sent[201].clean and "corp.example" not in sent[201].clean
    assert sent[200].spans == "" and sent[200].clean == "Zorblax is away"
    out = {r.doc_id: r for r in privacy.find(odd, sanitised="clean").collect()}
    assert out[6].clean == "write to [EMAIL] or [IP]" and (out[6].n_email, out[6].n_ip) == (1, 1) and out[2].clean == "" and out[4].clean == LONG
    assert out[3].base_sha256 == hashlib.sha256(b"").hexdigest() and privacy.find(odd.limit(0)).count() == 0


def test_mixing(spark, odd):
    same(queries.op4_mixing(spark, SF), queries.OP4_SQL, SF)
    out = mixing.mix(odd, queries.tree_levels(), budget=10.0, max_epochs=2)
    assert {r.copies for r in out.where("n_tokens > 0").collect()} == {2} and out.count() == len(ROWS)
    assert mixing.mix(odd.limit(0), queries.tree_levels(), budget=1.0).count() == 0
    assert mixing.mix(odd, queries.tree_levels(), budget=0.0).where("n_tokens > 0").count() == 0


def test_budgets_fill_siblings_first(spark):
    rows = [(0, "a", "x", "w " * 10), (1, "a", "y", "w " * 100), (2, "b", "x", "w " * 1000)]
    df = spark.createDataFrame(rows, "doc_id long, d string, s string, text string")
    meta = df.select(F.col("d"), F.col("s"), mixing.n_tokens(F.col("text")).alias("__tokens"), F.col("doc_id").cast("string").alias("__key"))
    got = {(r.d, r.s): r.budget for r in mixing.plan(meta, ["d", "s"], budget=200 / 1110, max_epochs=1).collect()}
    # The half of a, 100 tokens, fills a/x and goes on to a/y; b has no need to take any of it.
    assert got == {("a", "x"): 10, ("a", "y"): 90, ("b", "x"): 100}


def brute_components(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def shingle_set(text, width=4):
    ws = text.encode().lower().split()
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def test_neardup(spark, odd, docs):
    sets = {k: shingle_set(t) for k, t in texts_of(docs).items()}
    out = queries.op5_neardup(spark, SF).collect()
    truth = brute_components(sets, 80)
    assert {r.doc_id: r.component_id for r in out} == truth
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == truth[r.doc_id]) for r in out)
    got = neardup.classes(odd).collect()
    assert sorted((r.id or -1, r.component or -1) for r in got) == [(-1, -1), (1, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (6, 6), (7, 1), (8, 8)]
    assert sorted(r.doc_id or -1 for r in neardup.keep_one(odd).collect()) == [-1, 1, 1, 2, 3, 4, 6, 8]
    assert neardup.classes(odd.limit(0)).count() == 0


def test_neardup_of_a_large_group_of_near_copies(spark):
    import random

    rng = random.Random(9)
    base, rows = [f"b{i}" for i in range(60)], []
    for d in range(220):
        ws = list(base)
        for j in rng.sample(range(60), rng.randint(0, 4)):
            ws[j] = f"e{rng.randint(0, 10**6)}"
        rows.append((d, " ".join(ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    truth = brute_components({d: shingle_set(t, 5) for d, t in rows}, 80)
    assert {r.id: r.component for r in neardup.classes(df).collect()} == truth and len(set(truth.values())) > 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 100 + i) for i in range(1, 40)] + [(130, 300), (7, 7)]
    out = {r.vertex: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(31)) and all(out[100 + i] == 100 for i in range(40)) and out[300] == 100
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pieces(spark, odd):
    import sentencepiece

    sp, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load(MODEL)
    enc = pieces.encode(odd, model).collect()
    assert all(r.pieces == sp.encode(r.text or "") for r in enc) and len(enc) == len(ROWS)
    back = pieces.decode(pieces.encode(odd.select("doc_id", F.col("text").alias("was")), model, text_col="was"), model)
    assert back.where("text <> coalesce(was, '')").count() == 0
    out = queries.op6_pieces(spark, SF).collect()
    assert all(r.exact for r in out) and pieces.encode(odd.limit(0), model).count() == 0


def test_warc(spark):
    same(queries.op7_warc(spark, SF), queries.OP7_SQL, SF)
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (None, "u", ""), (2000, "v", "x" * 100000), (-5, "v", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("hash", F.lit("clash"))
    rec = warc.pack(pages)
    assert warc.audit(rec, rec.select("key", "record")).count() == 0
    lost = warc.audit(rec, rec.where("key <> 2000").select("key", "record")).collect()
    assert {(r.key, r.found) for r in lost} == {(2000, None), (None, None)}
    assert warc.audit(rec.limit(0), rec.limit(0).select("key", "record")).count() == 0
    data = "".join(r.record for r in rec.where("file = 0").orderBy("key").collect()).encode()
    assert [x["hi"] - x["lo"] for x in warc.parse(data)] == [len(r.record.encode()) for r in rec.where("file = 0").orderBy("key").collect()]


def test_vectors(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(30):
        mid = rng.normal(size=24)
        for _ in range(rng.integers(1, 30)):
            rows.append((len(rows), (mid + rng.normal(size=24) * rng.choice([0.05, 0.25])).astype(float).tolist()))
    n = len(rows)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    label = np.arange(n)
    for _ in range(n):
        label = np.minimum(label, np.where(close, label[None, :], n).min(1))
    odd = [(n, None), (n + 1, [0.0] * 24), (n + 2, [float("nan")] + [1.0] * 23), (n + 3, [1.0, 2.0]), (n + 4, [1.0, 2.0]), (None, [1.0, 2.0]), (n + 5, []), (n + 6, [None, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rep", F.lit("clash"))
    for block in (2048, 8):
        out = {r.id: (r.n_links, r.component, r.kept) for r in vectors.links(df, block=block).collect()}
        got = np.array([out[i][0] for i in range(n)])
        assert (got == close.sum(1)).mean() > 0.99 and np.mean([out[i][1] == label[i] for i in range(n)]) > 0.99
        assert [out[n + i][:2] for i in range(3)] == [(0, n + i) for i in range(3)] and out[n + 4] == (1, n + 3, False) and out[None] == (0, None, True)
    assert vectors.links(df.limit(0)).count() == 0


def test_extract(spark):
    out = queries.op9_extract(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in out:
        body = re.search("<article>(.*)</article>", pages[r.page_id], re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", body))
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "<p>" + "a " * 100000, "c")], "page_id long, html string, text string")
    got = extract.extract(df, extract.learn(df)).orderBy("page_id").collect()
    assert [len(r.text) for r in got] == [0, 0, 199999] and extract.extract(df.limit(0), extract.learn(df.limit(0))).count() == 0


@pytest.mark.parametrize("known", [200_000, 300])
def test_classlm(spark, docs, known):
    held = F.coalesce(quality.fold("doc_id", 5) == 1, F.lit(False))
    some = docs.select("doc_id", "text", held.alias("held_out"))
    out = classlm.scores(some, some.where(~F.col("held_out")), known=known).collect()
    toks = {k: [*t.encode().lower().split(), b"\n"] for k, t in texts_of(docs).items()}
    c = Counter(w for k, ws in toks.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in out:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks[r.doc_id])
        assert abs(r.base_score - base) < 1e-6 and (r.n_tokens, r.train_tokens, r.n_known) == (len(toks[r.doc_id]), n, sum(c[w] > 0 for w in toks[r.doc_id]))
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)
    score = brute_class_model([ws[:-1] for k, ws in toks.items() if zlib.crc32(str(k).encode()) % 5 != 1], known)
    for r in out[:: len(out) // 60]:
        assert abs(r.score - score(toks[r.doc_id][:-1])) < 1e-6


def brute_class_model(train, most):
    """The class model of lists of words, by loops; only the exchange itself is the operator's, which has a test of its own."""
    c, n_classes = Counter(w for ws in train for w in ws), classlm.CLASSES
    full = c + Counter({b"\n": len(train)})
    level = lambda w: math.floor(math.log2(full[w]) * 8)
    least, held = None, 0
    for at, n in sorted(Counter(map(level, full)).items(), reverse=True):
        if held + n > most:
            break
        least, held = at, held + n
    known = {w for w in c if least is not None and level(w) >= least}
    ranked = sorted((w for w in known if c[w] >= classlm.LEAST), key=lambda w: (-c[w], classlm.word_hash(w)))[: classlm.FREQUENT]
    own = {w: 1 + i for i, w in enumerate(ranked)}
    unit = lambda w: 0 if w == b"\n" else own.get(w) or classlm.ending(w)
    pairs = np.zeros((classlm.UNITS, classlm.UNITS), np.int64)
    texts = [[b"\n", *ws, b"\n"] for ws in train]
    for ws in texts:
        for a, b in zip(ws, ws[1:]):
            pairs[unit(a), unit(b)] += 1
    of_unit = classlm.exchange(pairs, n_classes)
    between = np.zeros((n_classes, n_classes))
    np.add.at(between, (of_unit[:, None], of_unit[None, :]), pairs)
    before, after = Counter(), Counter()
    for ws in texts:
        for a, w, b in zip(ws, ws[1:], ws[2:]):
            if w in known and w not in own:
                before[w, of_unit[unit(a)]] += 1
                after[w, of_unit[unit(b)]] += 1
    size, logs = between.sum(0) + 1, np.log(between + 0.5)
    votes = {w: np.zeros(n_classes) for w in known if w not in own}
    for (w, k), n in before.items():
        votes[w] += n * (logs[k] - np.log(size))
    for (w, k), n in after.items():
        votes[w] += n * (logs[:, k] - np.log(size))
    cls, moved = {}, between.copy()
    for w, v in votes.items():
        v[of_unit[unit(w)]] += classlm.DOUBT
        cls[w] = 1 + int(np.argmax(v[1:]))
    for (w, k), n in before.items():
        moved[k, cls[w]] += n
        moved[k, of_unit[unit(w)]] -= n
    for (w, k), n in after.items():
        moved[cls[w], k] += n
        moved[of_unit[unit(w)], k] -= n
    moved = np.maximum(moved, 0)
    class_of = lambda w: cls.get(w, of_unit[unit(w)])
    tokens, kinds = np.zeros(n_classes), np.zeros(n_classes)
    for w, n in full.items():
        tokens[class_of(w)] += n
        kinds[class_of(w)] += 1
    share = (tokens + 1) / (tokens.sum() + n_classes)
    step = (moved + classlm.PRIOR * share) / (moved.sum(1) + classlm.PRIOR)[:, None]
    assert np.allclose(step.sum(1), 1)

    def score(ws):
        total, last = 0.0, 0
        for w in [*ws, b"\n"]:
            k = class_of(w)
            total += math.log10(step[last, k] * (full[w] + 0.5) / (tokens[k] + 0.5 * (kinds[k] + 1)))
            last = k
        return total

    return score


@pytest.mark.parametrize("parts", ["4", "1"])
def test_classlm_of_words_that_are_not_sent(spark, docs, parts):
    """Words beyond those that go to all tasks get classes by their neighbours too, and their texts' scores show it."""
    learn = F.coalesce(quality.fold("doc_id", 5) != 1, F.lit(True))
    some = docs.select("doc_id", "text", learn.alias("learns"))
    toks = {k: [*t.encode().lower().split()] for k, t in texts_of(docs).items()}
    train = [ws for k, ws in toks.items() if zlib.crc32(str(k).encode()) % 5 != 1]
    c = Counter(w for ws in train for w in ws)
    sent = 1 + sum(n >= classlm.LEAST for n in c.values())
    assert 300 < sent < len(c) / 2
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        whole, marked, cut = ({r.doc_id: r for r in classlm.scores(some, t, **more).collect()} for t, more in ((some.where("learns"), {"sent": sent}), ("learns", {"sent": sent}), ("learns", {"known": sent})))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    score = brute_class_model(train, 10**9)
    for k in [*toks][:: len(toks) // 60]:
        assert abs(whole[k].score - score(toks[k])) < 1e-6
    assert all(abs(whole[k].score - marked[k].score) < 1e-6 and whole[k].n_known == marked[k].n_known for k in toks)
    assert any(abs(whole[k].score - cut[k].score) > 1e-3 for k in toks)  # a bound on the words shows


def test_classlm_of_odd_rows(odd):
    out = classlm.scores(odd, odd.where("doc_id > 3")).collect()
    assert len(out) == len(ROWS) and all(r.score <= 0 and r.n_tokens >= 1 for r in out) and len({r.score for r in out if r.doc_id in (1, 5)}) == 1
    assert classlm.scores(odd, odd.limit(0)).where("train_tokens = 0 AND score <= 0").count() == len(ROWS)
    assert classlm.scores(odd.limit(0), odd.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs.count())
        if name == "private_data":
            assert docs.where("text RLIKE '[A-Za-z0-9]@[A-Za-z0-9-]+[.][a-z]'").count() == 0
    assert seen[0] > seen[1] > seen[2] == seen[3] and seen[5] == seen[4] > 0


def test_stages_take_empty_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert all(stage(spark, docs, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)
