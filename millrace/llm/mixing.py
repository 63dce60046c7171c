"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

A tree of groups (domain, language, source) gets a budget of tokens at its root. Each node shares its budget among its
children by weight; a child that cannot use its share, even when its documents are repeated for the most epochs
allowed, is filled, and what is left is shared again among its siblings. A shortage reaches a node's own siblings only
when all its children are full. Each leaf then takes whole epochs and of one more epoch, in its seeded order, the
longest prefix of documents that fits the rest of its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import checkpointed, unique_name

SPACES = "[ \\t-\\r]+"


def n_tokens(text: Column) -> Column:
    """Words of a text, split at space and the controls 9 to 13; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    first, last = F.element_at(parts, 1) == "", F.element_at(parts, -1) == ""
    return (F.size(parts) - first.cast("int") - (last & (F.size(parts) > 1)).cast("int")).cast("long")


def weight_of(level: Column, weights: dict[str, int] | None) -> Column:
    """A node's weight: 1 where none is given. The given weights are a parameter, as long as the caller wrote it."""
    out = F.lit(1)
    for value, weight in (weights or {}).items():
        out = F.when(level == value, F.lit(weight)).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``nodes`` (``cap``, ``weight`` and the parent's ``budget``) with each one's own budget in place of the parent's.

    In order of capacity to weight, a node is full if its share of what is left by those before it is no less than its
    capacity; the others share the rest by weight. Nodes of weight 0 get nothing.
    """
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    group = Window.partitionBy(*parents) if parents else Window.partitionBy()
    order = group.orderBy("__ratio", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumn("__ratio", ratio)
    used = F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rate = F.when(left > 0, (F.col("budget") - used) / left).otherwise(F.lit(0.0))
    out = out.withColumn("__rate", rate).withColumn("__full", (F.col("weight") > 0) & (F.col("cap") <= F.col("weight") * F.col("__rate")))
    final = F.max(F.when(~F.col("__full"), F.col("__rate"))).over(group)
    own = F.when(F.col("__full"), F.col("cap").cast("double")).otherwise(F.col("weight") * final)
    return out.withColumn("__own", own).drop("budget", "__ratio", "__rate", "__full").withColumnRenamed("__own", "budget")


def _small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of leaves, sent to all executors if it has at most ``most`` rows; else Spark joins it by key."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def plan(meta: DataFrame, levels: list[str], *, budget: float, weights: dict[str, dict[str, int]] | None = None, max_epochs: int = 4, seed: int = 0) -> DataFrame:
    """One row a leaf: its budget, whole ``epochs`` and the ``cut``, the largest hash that its last epoch takes.

    ``meta`` has the levels, ``__key`` and ``__tokens``. ``budget`` is the share of all tokens to take, which may be over 1.
    A leaf's order is by hash, so a leaf of any size is cut by sums over its hash ranges, in two steps of 4096, and only
    the rows of one of its 16 million ranges are ever sorted together.
    """
    weights = weights or {}
    leaf = meta.groupBy(*levels).agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("docs"))
    leaf = checkpointed(leaf)
    total = leaf.agg(F.sum("tokens")).first()[0] or 0
    nodes = leaf.withColumn("__cap", F.col("tokens") * max_epochs)
    budgets = None
    for depth, name in enumerate(levels):
        path = levels[: depth + 1]
        at = nodes.groupBy(*path).agg(F.sum("__cap").alias("cap")).withColumn("weight", weight_of(F.col(name), weights.get(name)))
        if budgets is None:
            at = at.withColumn("budget", F.least(F.lit(float(int(total * budget))), F.lit(float(total * max_epochs))))
        else:
            at = at.join(budgets, levels[:depth])
        budgets = share(at, levels[:depth], name).select(*path, "budget")
    leaves = nodes.join(budgets, levels).withColumn("budget", F.floor("budget").cast("long"))
    each = F.col("tokens") > 0
    leaves = leaves.withColumn("epochs", F.when(each, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long"))
    leaves = checkpointed(leaves.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).drop("__cap"))

    rows = meta.join(_small(leaves.select(*levels, "epochs", "rest")), levels).withColumn("__hash", order_hash(seed))
    cut, taken = F.lit(""), rows.withColumnRenamed("rest", "__rest")
    bounds = None
    for step in range(2):
        key = F.substring("__hash", 1, 3 * (step + 1))
        sums = taken.groupBy(*levels, key.alias("__range")).agg(F.sum("__tokens").alias("__sum"), F.first("__rest").alias("__rest"))
        upto = F.sum("__sum").over(Window.partitionBy(*levels).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0))
        over = sums.withColumn("__upto", upto).where(F.col("__upto") > F.col("__rest"))
        bounds = checkpointed(over.groupBy(*levels).agg(F.min(F.struct("__range", (F.col("__rest") - F.col("__upto") + F.col("__sum")).alias("__rest"))).alias("__b")).select(*levels, "__b.__range", "__b.__rest"))
        taken = taken.drop("__rest").join(_small(bounds), levels).where(key == F.col("__range")).drop("__range")
    fits = F.sum("__tokens").over(Window.partitionBy(*levels).orderBy("__hash")) <= F.col("__rest")
    last = taken.withColumn("__fits", fits).where("__fits").groupBy(*levels).agg(F.max("__hash").alias("__last"))
    cut = F.when(F.col("__range").isNull(), F.lit("~")).otherwise(F.coalesce("__last", "__range"))
    return checkpointed(leaves.join(bounds.select(*levels, "__range"), levels, "left").join(last, levels, "left").withColumn("cut", cut).drop("__range", "__last"))


def order_hash(seed: int, epochs: str = "epochs", key: str = "__key") -> Column:
    """Places documents in a leaf's order for its epoch; those that share a key are taken together."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epochs).cast("string"), F.coalesce(F.col(key), F.lit("null"))).cast("binary"))


def mix(docs: DataFrame, levels: dict[str, Column], *, budget: float, weights: dict[str, dict[str, int]] | None = None, max_epochs: int = 4, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the levels as text (null: empty), ``n_tokens`` and ``copies``; documents without copies go.

    Columns of ``docs`` that have one of these names are replaced, others of any name pass through. No text is shuffled. An
    empty table gives none. Leaves without tokens keep their documents once; equal ids in a leaf, and null ones, are taken or
    left together; of equal hashes none is before the other, so ties are taken together too. Null texts have no tokens.
    """
    names, mine = list(levels), unique_name("mix")
    level, tokens, key, epochs, cut, times = [f"{mine}_{i}" for i in range(len(names))], f"{mine}_tokens", f"{mine}_key", f"{mine}_epochs", f"{mine}_cut", f"{mine}_copies"
    marked = docs.select("*", *[F.coalesce(c.cast("string"), F.lit("")).alias(to) for to, c in zip(level, levels.values())], n_tokens(F.col(text_col)).alias(tokens), F.col(id_col).cast("string").alias(key))
    inner = [f"__l{i}" for i in range(len(names))]
    meta = checkpointed(marked.select(*[F.col(a).alias(b) for a, b in zip(level, inner)], F.col(tokens).alias("__tokens"), F.col(key).alias("__key")))
    inner_weights = {inner[i]: (weights or {}).get(n) for i, n in enumerate(names)}
    leaves = plan(meta, inner, budget=budget, weights=inner_weights, max_epochs=max_epochs, seed=seed)
    leaves = leaves.select(*[F.col(a).alias(b) for a, b in zip(inner, level)], F.col("epochs").alias(epochs), F.col("cut").alias(cut))
    out = marked.join(_small(leaves), level)
    out = out.withColumn(times, F.col(epochs) + (order_hash(seed, epochs, key) <= F.col(cut)).cast("long")).where(F.col(times) > 0)
    replaced = {*names, "n_tokens", "copies"}
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in replaced], *[F.col(a).alias(b) for a, b in zip(level, names)], F.col(tokens).alias("n_tokens"), F.col(times).alias("copies"))
