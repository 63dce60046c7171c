"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document's terms are its words, weighted by their counts. For each coordinate a term draws, from hashes of itself, two
gamma variates ``r`` and ``c`` of shape 2 and a uniform ``b``; with ``t = floor(ln w / r + b)`` its draw is
``ln a = ln c - r (t - b + 1)``, and the coordinate samples the term, and level ``t``, of the smallest draw. Two documents
agree in a coordinate with the probability of their generalised Jaccard similarity, the sum of the smaller weights over
the sum of the larger. A draw is a function of coordinate, term and level alone, so two draws are equal just if these
are, and 32 bits of the smallest draw's hash stand for the sample: one minimum a coordinate, aggregated in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import checkpointed

COORDINATES = 32
_WORD = 2.0**-32


def draw(term: str, log_weight: str, coordinate: int) -> Column:
    """``ln a`` of a hashed term for a coordinate; both names are of columns. Three hashes give two uniforms each."""
    h = [f"xxhash64({term}, {3 * coordinate + i})" for i in range(3)]
    u = [f"(({x}) + 0.5D) * {_WORD!r}D" for i in h for x in (f"shiftrightunsigned({i}, 32)", f"{i} & 4294967295L")]
    r, c = f"(-ln({u[0]} * {u[1]}))", f"(-ln({u[2]} * {u[3]}))"
    return F.expr(f"ln({c}) - {r} * (floor({log_weight} / {r} + {u[4]}) - {u[4]} + 1)")


def sample(texts: DataFrame, keys: list[str], text: str, coordinates: int = COORDINATES) -> DataFrame:
    """``keys, sample``: the coordinates of each text, an array, null without words.

    Rows that share the keys are sampled as one text. Nothing is shuffled where ``texts`` is dealt out by some of the keys.
    """
    inner = [f"k{i}" for i in range(len(keys))]
    words = texts.select(*[F.col(k).alias(i) for k, i in zip(keys, inner)], F.lit(0).alias("kind"), F.explode(_words(F.coalesce(F.col(text), F.lit("")))).alias("word"))
    return _least(words, inner, coordinates).select(*[F.col(i).alias(k) for k, i in zip(keys, inner)], F.col("a").alias("sample"))


def _words(text: Column) -> Column:
    return F.split(text, "[ \\t-\\r]+")


def _least(rows: DataFrame, keys: list[str], coordinates: int) -> DataFrame:
    """``keys, a, b``: of ``keys, kind, word`` rows, the coordinates of the words of kinds 0 and 2, and of kinds 1 and 2.

    A term is kept once, with two counts, and its variates are drawn once. The empty word is no term: it brings the keys
    of a text without words, whose coordinates are null. Nothing is shuffled where ``rows`` is dealt out by some of the keys.
    """
    of = lambda i: F.sum((F.col("kind") != 1 - i).cast("long"))
    term = F.when(F.col("word") != "", F.xxhash64("word")).alias("term")
    counted = rows.select(*keys, "kind", term).groupBy(*keys, "term").agg(of(0).alias("n0"), of(1).alias("n1"))
    # The logarithm of a count of 0 is null, and so are the draws, which the minimum passes over.
    weight = lambda i: F.when(F.col("term").isNotNull() & (F.col(f"n{i}") > 0), F.ln(F.col(f"n{i}").cast("double")))
    weighed = counted.select(*keys, "term", *[weight(i).alias(f"w{i}") for i in (0, 1)])
    least = weighed.groupBy(*keys).agg(*[F.min(draw("term", f"w{i}", j)).alias(f"a{i}_{j}") for j in range(coordinates) for i in (0, 1)])
    sampled = lambda i: F.expr(f"IF(a{i}_0 IS NOT NULL, array({', '.join(f'cast(shiftright(xxhash64(a{i}_{j}), 32) AS int)' for j in range(coordinates))}), NULL)")
    return least.select(*keys, sampled(0).alias("a"), sampled(1).alias("b"))


def _pairs(rows: DataFrame, coordinates: int) -> DataFrame:
    """``part, ord, k, h, n, edited_sha256, a, b`` of rows with ``text`` and the text ``after`` it, null where only the
    text's own coordinates are asked for.

    Both texts begin alike: the words that end before the middle are split and counted once for the two.
    """
    n = F.char_length("text")
    rows = rows.select("part", "ord", "k", "h", "text", "after", n.cast("long").alias("n"), (n - F.expr("char_length(text) div 2")).cast("int").alias("cut"))
    rows = rows.withColumn("head", F.when(F.col("after").isNotNull(), F.regexp_extract(F.expr("substring(text, 1, cut)"), "(?s)^(.*[ \\t-\\r])", 1)).otherwise(""))
    rows = rows.withColumn("own", F.expr("substring(text, char_length(head) + 1)"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cut), substring(after, 1, cast(n as int) - cut))"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumn("other", F.expr("substring(edited, char_length(head) + 1)"))
    kinds = [F.struct(F.lit(kind).alias("kind"), F.coalesce(F.col(c), F.lit("")).alias("t")) for kind, c in ((2, "head"), (0, "own"), (1, "other"))]
    keys = ["part", "ord", "k", "h", "n", "edited_sha256"]
    split = rows.select(*keys, F.explode(F.array(*kinds)).alias("x")).where("x.t <> '' OR x.kind = 2")
    return _least(split.select(*keys, "x.kind", F.explode(_words(F.col("x.t"))).alias("word")), keys, coordinates)


def likeness(a: str, b: str, coordinates: int = COORDINATES) -> Column:
    """The share of equal coordinates in two columns; texts without words are like each other and unlike all others."""
    same = " + ".join(f"cast({a}[{j}] = {b}[{j}] AS int)" for j in range(coordinates))
    return F.expr(f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1.0D WHEN {a} IS NULL OR {b} IS NULL THEN 0.0D ELSE ({same}) / {float(coordinates)!r}D END")


def as_text(a: str, coordinates: int = COORDINATES) -> Column:
    """Coordinates as text, eight hexadecimal digits each; ``empty`` without words."""
    digits = ", ".join(f"lpad(lower(hex(cast({a}[{j}] AS bigint) & 4294967295L)), 8, '0')" for j in range(coordinates))
    return F.expr(f"IF({a} IS NULL, 'empty', concat({digits}))")


#: Characters of a part, and the number of parts at most: beyond it parts grow with the table.
PART, MOST_PARTS = 2_000_000, 1 << 17


def bounds_of(ids: DataFrame, part: int = PART, most: int = MOST_PARTS) -> list[int]:
    """The least ``k`` of each part, ascending: ranges of distinct ``k`` whose texts' lengths ``n`` sum up to some ``part``.

    Ids are dealt out by ranges and cut within a range by running sums; what comes to the driver is a number for each
    part, of which there are ``most`` and one a range at most.
    """
    ranges = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = ids.agg(F.sum("n")).first()[0] or 0
    placed = checkpointed(ids.select("k", "n").repartitionByRange(ranges, "k").withColumn("range", F.spark_partition_id()))
    before = F.sum("n").over(Window.partitionBy("range").orderBy("k")) - F.col("n")
    cut = placed.select("range", "k", F.floor(before / max(part, -(-total // most))).alias("cut"))
    return sorted(r[0] for r in cut.groupBy("range", "cut").agg(F.min("k")).select("min(k)").collect())


def part_of(k: str, bounds: list[int]) -> Column:
    """The place of the last bound that is not over ``k``, by bisection; 0 where all are."""
    steps, array = len(bounds).bit_length(), f"cast(split('{','.join(map(str, bounds))}', ',') AS array<bigint>)"
    halve = f"IF(s.hi - s.lo <= 1, s, IF({array}[cast((s.lo + s.hi) div 2 AS int)] <= {k}, struct((s.lo + s.hi) div 2 AS lo, s.hi AS hi), struct(s.lo AS lo, (s.lo + s.hi) div 2 AS hi)))"
    return F.expr(f"aggregate(sequence(0, {steps}), struct(cast(0 AS bigint) AS lo, cast({len(bounds)} AS bigint) AS hi), (s, i) -> {halve}, s -> s.lo)")


def compare_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", coordinates: int = COORDINATES, part: int = PART) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, whose second half is the next document's beginning.

    ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row; other columns,
    whatever their names, are not looked at. A null text is empty. Documents are in order of ids, null first (and told
    apart from none that has the least long); the last is followed by the first. Rows that share an id have the same one
    next, and of them the one of the smallest hash is the one that others have next; equal rows are fingerprinted once.
    Long texts are taken whole. An empty table gives none.

    Documents are dealt out by parts, ranges of ids; the first of each part goes to the part before it too, so a window
    over a part sees every document's next. The text is shuffled once, and all that follows is done where it then lies.
    """
    least = -(2**63)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).select(F.coalesce("id", F.lit(least)).alias("k"), "text", F.xxhash64("text").alias("h"), F.col("id").isNull().alias("lacks"))
    facts = checkpointed(rows.groupBy("k", "h", "lacks").agg(F.count("*").alias("times"), F.max(F.char_length("text")).cast("long").alias("n")))
    each = checkpointed(facts.groupBy("k").agg(F.min(F.struct("h", "n")).alias("f"), F.sum("times").alias("times"), F.max("lacks").alias("lacks")).select("k", "f.h", "f.n", "times", "lacks"))
    unique, has_null = each.where("times > 1").isEmpty(), not each.where("lacks").isEmpty()
    rows = rows.drop("lacks")
    firsts = rows if unique else rows.dropDuplicates(["k", "h"]).join(each.select("k", "h"), ["k", "h"], "left_semi")
    bounds = bounds_of(each, part) or [0]
    at = firsts.withColumn("part", part_of("k", bounds))
    heads = F.expr(f"cast(split('{','.join(map(str, bounds))}', ',') AS array<bigint>)[cast(part AS int)] = k")
    here, before = F.struct(F.col("part"), F.lit(0).alias("ord")), F.struct(F.pmod(F.col("part") - 1, F.lit(len(bounds))).cast("long").alias("part"), F.lit(1).alias("ord"))
    placed = at.select("k", "h", "text", F.explode(F.when(heads, F.array(here, before)).otherwise(F.array(here))).alias("x")).select("x.part", "x.ord", "k", "h", "text")
    # Two parts a task on average; one more part than tasks costs no more than a few empty tasks.
    tasks = max(1, -(-len(bounds) // 2))
    order = Window.partitionBy("part").orderBy("ord", "k")
    dealt = placed.repartition(tasks, "part").withColumn("after", F.when(F.col("ord") == 0, F.lead("text").over(order)))
    made = _pairs(dealt, coordinates)
    made = made.withColumn("c", F.lead("a").over(order)).where("ord = 0").select("k", "h", "n", "edited_sha256", "a", "b", "c")
    if unique:
        made = made.withColumn("id", F.when((F.col("k") != least) | F.lit(not has_null), F.col("k")))
    else:
        made = checkpointed(made)
        # The other texts of an id have the same next; a hot id's are split by Spark, for each id has one next.
        starts = dealt.where("ord = 0").join(each.where("times > 1").select("k"), "k", "left_semi").select("k", "after")
        others = rows.dropDuplicates(["k", "h"]).join(each.select("k", "h"), ["k", "h"], "left_anti").join(starts, "k")
        others = others.select(F.pmod("h", F.lit(2 * tasks)).alias("part"), F.lit(0).alias("ord"), "k", "h", "text", "after").repartition(tasks, "part")
        others = _pairs(others, coordinates).join(made.select("k", "c"), "k")
        made = made.unionByName(others.select(*made.columns))
        copies = facts.select("k", "h", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))), F.when(~F.col("lacks"), F.col("k")).alias("id"))
        made = made.join(copies.select("k", "h", "id"), ["k", "h"])
    likenesses = [likeness("a", b, coordinates).alias(name) for b, name in (("b", "near_edited"), ("c", "near_next"))]
    return made.select("id", F.col("n").alias("n_chars"), "edited_sha256", as_text("a", coordinates).alias("fingerprint"), as_text("b", coordinates).alias("edited_fingerprint"), *likenesses)
