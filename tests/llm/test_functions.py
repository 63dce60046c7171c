"""The operators' functions against brute force, without Spark."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from millrace.llm import arrow, classlm, extract, neardup, pieces, privacy, quality, vectors, warc
from millrace.llm.words import WordHashes, shingles, words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_words_and_shingles():
    assert words("A b\tCÉ \x0bd e\n".encode()) == [b"a", b"b", "cÉ".encode(), "d e".encode()]
    h = WordHashes(3)
    f = lambda t, w=4: len(shingles(h.of(words(t.encode())), w))
    assert [f(""), f("a"), f("a b c"), f("a b c d"), f("a b c d e"), f("a a a a a a")] == [0, 1, 1, 1, 2, 1]
    assert len(h) <= 3


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 200).astype(np.uint64)
        y = x.copy()
        y[: rng.integers(1, 150)] ^= np.uint64(12345)
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        errors.append((neardup.signature(x, 512) == neardup.signature(y, 512)).mean() - j)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_signature_of_long_set_is_that_of_its_blocks():
    x = np.arange(5000, dtype=np.uint64) * np.uint64(2654435761)
    assert (neardup.signature(x, 140) == np.minimum(neardup.signature(x[:3000], 140), neardup.signature(x[3000:], 140))).all()


def test_linked_sets_equal_brute_force():
    rng = np.random.default_rng(1)

    def comps(reps, edges):
        p = {r: r for r in reps.tolist()}

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in edges:
            p[max(find(a), find(b))] = min(find(a), find(b))
        return {r: find(r) for r in p}

    for _ in range(100):
        n, base, items = rng.integers(2, 12), rng.integers(0, 10**6, 40), []
        for _ in range(n):
            x = base.copy()
            k = rng.integers(0, 12)
            x[rng.choice(40, k, replace=False)] = rng.integers(0, 10**6, k)
            items.append(np.unique(x))
        reps = rng.permutation(100)[:n]
        a, b = neardup.linked(reps, reps.copy(), items, 80)
        true = [(int(reps[i]), int(reps[j])) for i in range(n) for j in range(i) if 100 * len(np.intersect1d(items[i], items[j])) >= 80 * len(np.union1d(items[i], items[j]))]
        assert comps(reps, zip(a.tolist(), b.tolist())) == comps(reps, true)


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and privacy.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_spans_equal_the_patterns():
    rng = random.Random(2)
    texts = ["".join(rng.choice("a.@-1 2+()0b.@é") for _ in range(rng.randint(0, 40))) for _ in range(20000)]
    texts += ["x a.b@c-d.ef, 10.0.0.255 4111 1111 1111 1111 +1 (706) 555-3138", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "000255.1.1.1"]
    assert all(privacy.base_spans(t) == plain_spans(t) for t in texts)


def test_spans_take_linear_time():
    began = time.time()
    for t in ("1" * 300000, "a." * 150000, "1.1.1x" * 80000, "a@" * 150000, "+1x" * 100000):
        privacy.base_spans(t)
    assert time.time() - began < 10


def test_sanitised_text_joins_overlapping_spans():
    text = "call +4111111111111111 or me@x.org now"
    spans = privacy.base_spans(text)
    assert privacy.sanitise(text, spans, set()) == "call [PHONE] or [EMAIL] now" or "[CARD]" in privacy.sanitise(text, spans, set())
    assert "4111" not in privacy.sanitise(text, spans, set()) and privacy.sanitise("", [], set()) == ""


def test_pieces_equal_the_library():
    import sentencepiece

    sp, t = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Transducer(pieces.load(MODEL))
    rng = random.Random(3)
    texts = ["", " ", "  a  ", "a\n\n b", "▁▁ x", "日本語 text \U0001f600", "internationalization " * 3, "a" * 800, "   " * 30 + "x", "def f(x):\n    return x**2\n"]
    texts += ["".join(rng.choice("abcdehilnorst ▁\n.,0123é") for _ in range(rng.randint(1, 120))) for _ in range(400)]
    for x in texts:
        assert t.encode(x) == sp.encode(x)
        assert t.decode(t.encode(x)) == sp.decode(sp.encode(x))
        assert "▁" in x or t.decode(t.encode(x)) == x


def test_pieces_work_once_for_each_word():
    import sentencepiece

    sp, t = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Transducer(pieces.load(MODEL))

    class Counted:
        cut, n = t.cut, 0

        def findall(self, text):
            self.n += len(text)
            return self.cut.findall(text)

    t.cut = counted = Counted()
    for x in ["the cat sat on the mat, " * 200, "a mat on the cat  sat, the " * 200]:
        assert t.encode(x) == sp.encode(x) and counted.n < 100


def test_pieces_of_blocks():
    import sentencepiece

    rng = random.Random(11)
    texts = ["", " ", "a", "▁", "  a", "a  ", "▁▁a▁ b", "x" * 60 + " y", "\n\n", "\0 a\0", "日本 \U0001f600"] + ["".join(rng.choice("abet ▁\n.é") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for more in (b"", b"\x1a\x02" + bytes([3 << 3, 0]), b"\x1a\x02" + bytes([5 << 3, 0])):  # also without the leading sign, and with plain spaces
        sp, t = sentencepiece.SentencePieceProcessor(model_proto=pieces.load(MODEL) + more), pieces.Transducer(pieces.load(MODEL) + more)
        for most in (1, 50, 10**6):
            for block in pieces.blocks(texts, most):
                ids, at = t.encoded(block)
                assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [sp.encode(x) for x in block]
                assert t.decoded(ids, at) == [t.decode(sp.encode(x)) for x in block]
        assert [x for b in pieces.blocks(texts, 50) for x in b] == texts and not list(pieces.blocks([]))


def test_unigram_path_is_the_cheapest():
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    def piece(text, score, kind=1):
        return field(1, field(1, text.encode()) + b"\x15" + np.float32(score).tobytes() + bytes([3 << 3, kind]))

    model = piece("<unk>", 0, 2) + piece("▁", -3) + piece("▁ab", -2) + piece("a", -1.5) + piece("b", -1.5) + piece("ab", -2.5) + piece("abab", -9)
    t = pieces.Transducer(model + field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 0])))
    assert not t.bpe and [t.pieces[i] for i in t.encode("abab")] == ["▁ab", "ab"]
    assert t.encode("xx") == [1, 0] and t.decode(t.encode("ab")) == "ab"


def test_machines_composed_by_hand():
    from millrace.llm.fst import INF, Machine, compose, shortest_path

    # Reads a and b; b may be written as x for 1 or as y for 3, which the second machine makes dear and cheap.
    first = Machine(0, lambda s, c: [("x", 1.0, 0), ("y", 3.0, 0)] if c == "b" else [(None, 0.5, 0)] if c == "a" else [], lambda s: 0.0)
    second = Machine(0, lambda s, c: {"x": [(1, 4.0, 0)], "y": [(2, 0.25, 1)]}.get(c, []), lambda s: 0.0 if s else INF)
    assert shortest_path(compose(first, second), "ab") == (3.75, [2]) and shortest_path(first, "ab") == (1.5, ["x"])
    assert shortest_path(compose(first, second), "a") is None and shortest_path(first, "c") is None
    # Arcs that read nothing: the shorter way over two of them.
    silent = Machine(0, lambda s, c: {(0, None): [("p", 5.0, 2), ("q", 1.0, 1)], (1, None): [("r", 1.0, 2)]}.get((s, c), []), lambda s: 0.0 if s == 2 else INF)
    assert shortest_path(silent, "") == (2.0, ["q", "r"])


def test_shortest_is_the_path_of_the_composition():
    t = pieces.Transducer(pieces.load(MODEL))
    rng = random.Random(5)
    for x in ["Hello world", "stra\u00dfe \u65e5\u672c\u8a9e \u203d", "  a  b ", "aaaa"] + ["".join(rng.choice("aehinrst \u203d") for _ in range(14)) for _ in range(20)]:
        text = t.normalise(x)
        assert [i for ids in t.path(text) for i in ids] == t.encode(x)


def _varint(n):
    return bytes([n & 127 | 128]) + _varint(n >> 7) if n > 127 else bytes([n])


def test_pieces_with_a_character_map():
    import sentencepiece

    spec = next(v for k, v in pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()) if k == 3)
    blob = dict(pieces._fields(spec))[2]
    body = b"\x12" + _varint(len(blob)) + blob
    model = pieces.load(MODEL) + b"\x1a" + _varint(len(body)) + body
    sp, t, rng = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Transducer(model), random.Random(7)
    letters = "a\ufb01\u2460 \u0301e\u3000\t\u00bdX\uff21\u00e9\u306f\u200d\u3099"
    for x in ["", "\ufb01ne \u2460 \u33a5 \uff21\uff42\uff43\u3000x", "a\u200bb\tc\nd", "plain"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(300)]:
        assert t.encode(x) == sp.encode(x), x


def test_user_symbols_stay_whole():
    import sentencepiece

    own = b"\x0a" + _varint(4) + b"<ab>" + b"\x15" + np.float32(0).tobytes() + bytes([3 << 3, 4])
    model = pieces.load(MODEL) + b"\x0a" + _varint(len(own)) + own
    sp, t = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Transducer(model)
    for x in ["an <ab> is<ab><ab>here", "<ab", "x <ab>"]:
        assert t.encode(x) == sp.encode(x)


def test_extract_follows_its_weights_alone(monkeypatch):
    import html
    from collections import defaultdict

    import pyarrow.parquet as pq

    def learnt(pages):
        def counted(seen):
            tally = defaultdict(lambda: [0, 0])
            for p in pages:
                t = extract.Tokens(p)
                for kind, size, inside in seen(t) if t.marked else ():
                    tally[kind][inside] += size
            return {k: (i, o) for k, (o, i) in tally.items()}

        w = extract.as_weights(counted(extract.labels))
        return w | extract.as_weights(counted(lambda t: extract.agreement(t, w)))

    def truth(page):
        body = re.search("<article>(.*)</article>", page, re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", body))
        return "\n".join(x for x in parts if x)

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    weights = learnt(pages)
    # A weight that is turned turns the result.
    page = f"<html><body><nav><p>{'home and away ' * 9}</p></nav><div>{'<p>the body of the text runs on</p>' * 9}</div></body></html>"
    assert "home" not in extract.main_text(page, weights) and "home" in extract.main_text(page, weights | {"h e:nav": 0.0})
    # Without any list or presumed weight, and without the mark, what is learned finds every text.
    for name in ("HINTS", "EDGES", "ROLES"):
        monkeypatch.setattr(extract, name, frozenset())
    monkeypatch.setattr(extract, "PRIOR", {})
    weights = learnt(pages)
    for page in pages:
        assert extract.main_text(page, weights) == truth(page) == extract.main_text(page.replace("article>", "div>"), weights)


def test_pieces_refuse_large_models(tmp_path):
    (tmp_path / "m").write_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        pieces.load(str(tmp_path / "m"), most_bytes=10)


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div>%s<aside><p>see also this</p></aside><div id="comments"><p>first comment here</p></div><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>'])
def test_main_text(wrap):
    body = '<h1>Ti&eacute;tle</h1><p>One  two\nthree<p>Five <b>six</b>seven &lt;b&gt;<div class="ad">buy now</div><form><p>name</p></form><p>nine ten'
    assert extract.main_text(PAGE % (wrap % body), {}) == "Tiétle\nOne two three\nFive sixseven <b>\nnine ten"


def test_main_text_of_odd_pages():
    assert [extract.main_text(x, {}) for x in ("", "<p></p>", "plain < text", "<p>a<p>b <i>c", "<article>x", "<nav>only</nav>")] == ["", "", "plain < text", "a\nb c", "x", ""]
    began = time.time()
    for x in ("<p " * 100000, '<p a="' * 50000, "<script>" * 30000, "<!--" * 30000, "<div>" * 30000 + "x", "<b>" * 30000 + "</i>" * 30000 + "x"):
        extract.main_text(x, {})
    assert time.time() - began < 20


def test_best_region_is_the_largest_sum():
    rng = random.Random(4)
    for _ in range(300):
        w = [rng.choice((-2, -1, 1, 2)) for _ in range(rng.randint(0, 12))]
        lo, hi = extract.best_region(w)
        assert sum(w[lo:hi]) == max([0, *(sum(w[i:j]) for i in range(len(w)) for j in range(i, len(w) + 1))])


def test_discriminant_equals_densities():
    rng = np.random.default_rng(5)
    x = [rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (500, 3))]
    m = quality.Discriminant.from_moments([300.0, 500.0], [a.sum(0) for a in x], [a.T @ a for a in x], pool=0.0, ridge=0.0)
    both = np.concatenate(x)
    z, logs = (both - m.centre) / m.scale, []
    for k in (0, 1):
        t = (x[k] - m.centre) / m.scale
        c, mu = np.cov(t.T, bias=True), t.mean(0)
        logs.append(-0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ij,jk,ik->i", z - mu, np.linalg.inv(c), z - mu) + m.priors[k])
    assert np.allclose(m.score(both), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_discriminant_without_rows():
    p = len(quality.FEATURES)
    empty = quality.Discriminant.from_moments([0.0, 0.0], [np.zeros(p)] * 2, [np.zeros((p, p))] * 2)
    assert np.allclose(empty.score(np.array([quality.statistics(b""), quality.statistics(b"a b")])), 0.5)


def test_hashing_finds_close_vectors():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.9 * x + np.sqrt(1 - 0.81) * z
    for count in (1000, 100_000, 10_000_000):
        axes, tables = vectors.shape(count, 48)
        a, b = vectors.buckets(x, tables, axes), vectors.buckets(y, tables, axes)
        assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() > 0.99


def test_hadamard_is_orthogonal():
    h = vectors.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, 8 * np.eye(8))


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(7)
    pairs = rng.integers(0, 3, (41, 41))
    pairs[1:21, 21:] += 30
    pairs[21:, 1:21] += 30
    pairs[0] = pairs[:, 0] = 1
    pairs = (pairs + pairs.T) // 2
    cls = classlm.exchange(pairs, 3)
    assert cls[0] == 0 and len(set(cls[1:21])) == 1 and len(set(cls[21:])) == 1 and cls[1] != cls[21]


def test_warc_records_are_parsed():
    data = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    found = warc.parse(data * 2 + b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab")
    assert [(r["body"], r["lo"]) for r in found] == [(b"abc", 0), (b"abc", len(data)), (b"ab", 2 * len(data))]
    assert warc.parse(b"") == [] and warc.parse(b"junk") == []


def _own_mb() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read()))) / 1024


def test_portions_are_small_and_lose_no_row():
    column = pa.array(["x" * 9_000_000, None, "", *(str(i) * 300 for i in range(20_000))])
    batches = [pa.record_batch([column, pa.array(range(len(column)))], ["t", "i"]), pa.record_batch([column[:0], pa.array([], pa.int64())], ["t", "i"])]
    seen = []

    def run(parts):
        for b in parts:
            seen.append(b)
            yield b

    assert pa.Table.from_batches(arrow.in_portions(run)(iter(batches))) == pa.Table.from_batches(batches)
    assert max(b.nbytes for b in seen[1:]) < 2 * arrow.PORTION and seen[0].num_rows < 2000 and seen[0]["t"][0].as_py() == "x" * 9_000_000


def test_spark_sends_workers_small_batches(spark):
    # A slice shares its batch's buffers, so their size is that of what was sent.
    def make():
        return lambda column: [pa.array([column.buffers()[2].size] * len(column), pa.int64())]

    session = spark.newSession()
    docs = session.range(0, 9000, 1, 1).selectExpr("id", "if(id = 70, repeat('y', 5000000), repeat('x', 2000)) AS text")
    new = [T.StructField("sent", T.LongType())]
    rows = arrow.append_columns(docs, ["text"], new, make, portions=True).selectExpr("id", "length(text) AS n", "sent").collect()
    assert sorted((r.id, r.n) for r in rows) == [(i, 5_000_000 if i == 70 else 2000) for i in range(9000)]
    assert max(r.sent for r in rows if r.id > 70) < 2 * arrow.PORTION
    sent = arrow.emit_rows(docs.where("id > 70"), ["text"], "sent long", lambda: lambda c: None if c is None else [[pa.array([c.buffers()[2].size], pa.int64())]], portions=True)
    assert max(r.sent for r in sent.collect()) < 2 * arrow.PORTION
    # What the session has set stays.
    session.conf.set(arrow.SENT, "1g")
    assert arrow.append_columns(docs, ["text"], new, make, portions=True).selectExpr("min(sent)").first()[0] > 20_000_000


def test_a_worker_gives_freed_memory_back():
    t = pieces.compiled(pieces.load(MODEL))
    rng = random.Random(5)

    def batches(n):
        for _ in range(n):
            yield pa.record_batch([pa.array([" ".join(f"w{rng.randrange(3000)}" for _ in range(300)) for _ in range(12_000)])], ["t"])

    def run(parts):
        for b in parts:
            ids, bounds = t.encoded(b["t"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["t"], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], ["t", "n"])

    for _ in arrow.in_portions(run)(batches(1)):
        pass
    before = _own_mb()
    for _ in arrow.in_portions(run)(batches(2)):
        pass
    assert _own_mb() - before < 30
    # At some 170 bytes each, what is remembered of parts and stretches is under 80 MB.
    assert 2 * (t.known.most + t.signed.most) * 170 < 80e6
