"""The pipeline and the estimates behind it against brute force, and queries over planted tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F
from test_corpus_operators import MODEL, ROWS, brute_components, shingle_set

import corpus_pipeline
from millrace.llm import neardup, privacy, quality, queries

#: Names that the stages and operators use inside, as columns that pass through.
INNER = ["key", "tokens", "score", "clean", "copies", "n_tokens", "domain", "spans", "n_email", "kept", "gone", "pieces", "__key", "__tokens", "__l0", "__cut", "__copies", "__hash", "__score", "__clean", "__epoch", "__terms", "component", "id", "a b", "a.b"]


@pytest.fixture(scope="module")
def table(spark):
    """Documents with odd rows: nulls in any column, repeated rows, empty and long texts, and clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(None if i is None else 10**6 + i, *rest) for i, *rest in ROWS], docs.schema)
    both = docs.unionByName(odd).withColumn("n_chars", F.char_length("text").cast("long"))
    return both.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in INNER})


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def passed_through(rows):
    return all(r[c] == f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in INNER)


def mixed(rows):
    """Hierarchical budgets and leaf prefixes by loops."""
    level = lambda r: ("group" + str(int((re.search("([0-9]+)$", r["source"] or "") or [0, 0])[1]) % 4), r["lang"] or "", r["source"] or "")
    tokens = [len(re.findall("[^ \t-\r]+", r["text"] or "")) for r in rows]
    most, how = queries.MIX["max_epochs"], queries.MIX["weights"]
    weigh = [how["domain"], how["lang"], {}]
    leaf = defaultdict(int)
    for r, n in zip(rows, tokens):
        leaf[level(r)] += n
    out = {}

    def give(at, budget):
        if len(at) == 3:
            out[at] = math.floor(budget)
            return
        caps = defaultdict(int)
        for k, n in leaf.items():
            if k[: len(at)] == at:
                caps[k[len(at)]] += most * n
        weight, left = {c: weigh[len(at)].get(c, 1) for c in caps}, dict(caps)
        share, rest = {}, float(budget)
        while left:
            rate = rest / sum(weight[c] for c in left)
            full = [c for c in left if caps[c] <= weight[c] * rate]
            if not full:
                share |= {c: weight[c] * rate for c in left}
                break
            first = min(full, key=lambda c: caps[c] / weight[c])
            share[first] = float(caps[first])
            rest -= caps[first]
            del left[first]
        for c, b in share.items():
            give((*at, c), b)

    total = sum(tokens)
    give((), min(float(int(total * queries.MIX["budget"])), float(total * most)))
    copies = []
    order = defaultdict(list)
    for r, n in zip(rows, tokens):
        k = level(r)
        epochs = out[k] // leaf[k] if leaf[k] else 0
        h = hashlib.md5(f"{queries.MIX['seed']}:{epochs}:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        order[k].append((h, n))
        copies.append((k, epochs, h))
    for k, epochs, h in copies:
        rest = out[k] - (out[k] // leaf[k] if leaf[k] else 0) * leaf[k]
        yield epochs + (sum(n for g, n in order[k] if g <= h) <= rest)


def test_stages_against_brute_force(spark, table, tmp_path):
    import sentencepiece

    stages = dict(corpus_pipeline.STAGES)
    before, docs, spot = rows_of(table), table, 0

    def run(name):
        nonlocal docs, spot
        out = stages[name](spark, docs, SF)
        if name != "pieces":
            assert out.columns == table.columns
            spot += 1
            out.toDF(*[f"c{i}" for i in range(len(out.columns))]).write.parquet(f"{tmp_path}/{spot}")
            docs = spark.read.parquet(f"{tmp_path}/{spot}").toDF(*table.columns)
            got = rows_of(docs)
            assert passed_through(got), name
            return got
        return rows_of(out)

    same = lambda a, b: Counter((r["doc_id"], r["text"]) for r in a) == Counter((r["doc_id"], r["text"]) for r in b)
    # Quality: the discriminant of the moments, in numpy.
    labels = defaultdict(lambda: -1)
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        labels[r.doc_id] = max(labels[r.doc_id], r.quality if r.quality in (0, 1) else -1)
    x = np.array([quality.statistics((r["text"] or "").encode()) for r in before])
    y = np.array([labels[r["doc_id"]] for r in before])
    model = quality.Discriminant.from_moments([float((y == k).sum()) for k in (0, 1)], [x[y == k].sum(0) for k in (0, 1)], [x[y == k].T @ x[y == k] for k in (0, 1)])
    kept = [r for r, s in zip(before, model.score(x)) if s >= corpus_pipeline.LEAST_QUALITY]
    got = run("quality")
    assert same(got, kept) and 0 < len(kept) < len(before)
    # Near-duplicates: all pairs of sets. Rows of one id go together; those without one stay.
    sets = defaultdict(set)
    for r in got:
        if r["doc_id"] is not None:
            sets[r["doc_id"]] |= shingle_set(r["text"] or "", 5)
    part = brute_components(dict(sets), 80)
    kept = [r for r in got if r["doc_id"] is None or part[r["doc_id"]] == r["doc_id"]]
    got = run("near_duplicates")
    assert same(got, kept) and len(got) < sum(1 for _ in before)
    # Private data: the spans of each text, and the disclosures that brute force finds.
    terms = brute_disclosures([r["text"] or "" for r in got])
    clean = []
    for r in got:
        spans = privacy.base_spans(r["text"] or "")
        found = privacy.term_spans(r["text"] or "", spans, terms)
        every = sorted([*spans, *((s, 4, e) for s, e, _ in found)])
        clean.append(r | {"text": None if r["text"] is None else privacy.sanitise(r["text"], every, {s for s, _, gone in found if gone})})
    got = run("private_data")
    assert same(got, clean) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    # Mixing: budgets and prefixes.
    want = Counter()
    for r, n in zip(got, mixed(got)):
        if n:
            want[r["doc_id"], r["text"]] += n
    got = run("mixing")
    assert Counter((r["doc_id"], r["text"]) for r in got) == want
    # Pieces: the library.
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = run("pieces")
    assert Counter((r["doc_id"], tuple(r["pieces"])) for r in out) == Counter((r["doc_id"], tuple(sp.encode(r["text"] or ""))) for r in got)
    assert all(r["n_pieces"] == len(r["pieces"]) for r in out)


def brute_disclosures(texts, threshold=0.8, remove=0.95, doubt=0.2):
    """The disclosing terms of each entity, with those of its class, by loops over documents."""
    n_all, held, groups = len(texts), [], {}

    def root(e):
        while groups.setdefault(e, e) != e:
            e = groups[e]
        return e

    n_term = Counter()
    for text in texts:
        spans = privacy.base_spans(text)
        ents = [privacy.entity(text, s) for s in spans]
        n_term.update({w.lower() for w in set(privacy._TERM.findall(text))})
        words = [(m.start(), m.end(), m[0].lower()) for m in privacy._TERM.finditer(text) if not privacy.covered(spans, m.start(), m.end())]
        for a, b, e, f in zip(spans, spans[1:], ents, ents[1:]):
            if e != f and a[1] != b[1] and b[0] - a[2] <= privacy.NEAR:
                groups[max(root(e), root(f))] = min(root(e), root(f))
        whole = xxhash.xxh3_64_intdigest(text) >> 1
        of = {}
        for s, e in zip(spans, ents):
            around = xxhash.xxh3_64_intdigest(text[max(0, s[0] - privacy.NEAR) : s[0]] + " " + text[s[2] : s[2] + privacy.NEAR]) >> 1
            for lo, hi, w in words:
                near = lo < s[2] + privacy.NEAR and hi > s[0] - privacy.NEAR
                was = of.setdefault(e, {}).get(w)
                if was is None or near and not was[0]:
                    of[e][w] = (near, around if near else whole)
            of.setdefault(e, {})
        held.append(of)
    many = Counter(root(e) for e in list(groups))
    found = defaultdict(list)
    for of_class in (False, True):
        docs, both = Counter(), defaultdict(lambda: defaultdict(list))
        for of in held:
            joined = {}
            for e, ws in of.items():
                k = ("class", root(e)) if of_class else e
                if of_class and many[root(e)] < 2:
                    continue
                mine = joined.setdefault(k, {})
                for w, seen in ws.items():
                    mine[w] = max(mine.get(w, (False, -1)), seen)
            for k, ws in joined.items():
                docs[k] += 1
                for w, seen in ws.items():
                    both[k][w].append(seen)
        for k, ws in both.items():
            if docs[k] >= n_all:
                continue
            for w, seen in ws.items():
                around = defaultdict(bool)
                for near, a in seen:
                    around[a] |= near
                strength = sum(1.0 if near else 0.5 for near in around.values())
                share = (math.log(n_all * len(seen) / (n_term[w] * docs[k])) + math.log(doubt) / strength) / math.log(n_all / docs[k])
                if share >= threshold - 1e-12:
                    found[k].append((w, share >= remove))
    return {e: [*found.get(e, ()), *found.get(("class", root(e)), ())] for of in held for e in of}


def test_disclosures_against_brute_force(spark):
    plain = [f"plain words number {chr(97 + i % 26)}{chr(97 + i // 26)} about nothing and to the house for lee today" for i in range(500)]
    some = ["for zorblax write a@b.example", "the house to zorblax a@b.example", "write c@d.example or +49 30 1234567 soon", "for quibble +49 30 1234567", "the quibble to +49 30 1234567", "quibble about c@d.example", f"Xan {'and to the house ' * 9} e@f.example", "e@f.example says xan", "e@f.example says xan"]
    want = {(e, w, gone) for e, ws in brute_disclosures(some + plain).items() for w, gone in ws}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some + plain)], "doc_id long, text string")
    rows = privacy.disclosures(df).collect()
    groups = {r.entity: r.group for r in rows if r.term is None}
    own = defaultdict(list)
    for r in rows:
        if r.term is not None:
            own[r.entity].append((r.term, r.removed))
    ents = {privacy.entity(t, s) for t in some for s in privacy.base_spans(t)}
    got = {(e, w, gone) for e in ents for k in (e, groups.get(e)) for w, gone in own.get(k, ())}
    assert got == want and {"zorblax", "quibble"} <= {w for _, w, _ in got}


def test_a_bucket_of_thousands_with_strays(spark):
    rng, rows = np.random.default_rng(4), []
    base = [f"b{i}" for i in range(60)]
    for d in range(2500):
        ws = list(base)
        for j in rng.choice(60, rng.choice([1, 2, 3, 5, 7]), replace=False):
            ws[j] = f"e{rng.integers(10**6)}"
        rows.append((int(d), " ".join(ws)))
    sets = [shingle_set(t, 5) for _, t in rows]
    code = {s: i for i, s in enumerate({s for x in sets for s in x})}
    m = np.zeros((len(rows), len(code)), np.float32)
    for i, x in enumerate(sets):
        m[i, [code[s] for s in x]] = 1
    size = m.sum(1)
    common = m @ m.T
    close = 100 * common >= 80 * (size[:, None] + size[None, :] - common)
    label = np.arange(len(rows))
    while True:
        low = np.where(close, label[None, :], len(rows)).min(1)
        if (low == label).all():
            break
        label = low
    got = {r.id: r.component for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == label.tolist() and 1 < len(set(label.tolist())) < 2500


def test_embeddings_query_over_planted_pairs(spark, tmp_path):
    rng, rows = np.random.default_rng(5), []
    for _ in range(900):
        mid = rng.normal(size=48)
        for _ in range(int(rng.choice([1, 1, 1, 2, 3, 12]))):
            rows.append((len(rows), (mid + rng.normal(size=48) * rng.choice([0.0, 0.1, 0.25, 0.33])).astype(np.float32).tolist(), 0))
    rows += [(len(rows) + i, v, 1) for i, v in enumerate([None, [0.0] * 48, [float("inf")] + [1.0] * 47, [1.0, None]])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {r.vec_id: r for r in queries.op8_vectors(spark, str(tmp_path)).collect()}
    n = len(rows) - 4
    x = np.array([v for _, v, _ in rows[:n]], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    found, there = sum(out[i].n_links for i in range(n)), int(close.sum())
    assert there > 500 and 0.99 * there <= found <= there and all(out[i].n_links <= close[i].sum() for i in range(n))
    assert all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i in range(n, n + 4))
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(close, label[None, :], n).min(1))
        if (low == label).all():
            break
        label = low
    assert np.mean([out[i].component_id == label[i] and out[i].kept == (label[i] == i) for i in range(n)]) > 0.99
