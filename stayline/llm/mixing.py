"""Mixing sources to target weights in a tree of levels (such as domain, language, source).

Budgets go down the tree. A node's budget is shared among its children by
weight; a child can use at most its tokens times the epochs allowed. What a
child cannot use goes to its siblings by weight first; a node is given less
than its share only if its whole subtree is used up, and only then does the
rest reach the node's own siblings. All shares are whole tokens.

Each leaf then gives full epochs and, in one more epoch, the prefix of its
documents in a seeded order that covers the rest of its budget. The order key is
a hash: running sums over coarse cells of it, then over fine cells of the one
where the budget ends, then over the documents of that fine cell give the last
key of the prefix, and a document is in the prefix if its key is not behind it.
So no leaf is ever sorted, however large.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.columns import numbered, restored
from stayline.session import cut_lineage

#: Hex digits of the order key that make a coarse and a fine cell.
COARSE, FINE = 3, 6


@dataclass(frozen=True)
class Mix:
    """What to mix. `weights` names children by their path; others weigh `default_weight`.

    A path is a tuple of names from the top level down; a string stands for its
    parts between slashes ("en", "en/src1"), so names that hold a slash need tuples.
    """

    levels: Mapping[str, Column]
    tokens: Column
    share: tuple[int, int] = (1, 2)  # of all tokens at hand, as a fraction
    budget: int | None = None  # instead of a share
    weights: Mapping[str | tuple[str, ...], int] = field(default_factory=dict)
    default_weight: int = 1
    epochs: int = 2
    seed: int = 0


def word_tokens(text: Column) -> Column:
    """Tokens of a text by white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def _share(children: DataFrame, parent: list[str]) -> DataFrame:
    """budget of each child: _weight and _most (what it can use) are given, _budget is the parent's.

    Children fill up in order of _most per weight. A child is full if what is
    left when its turn comes would give it all it can use; the children behind
    the last full one share what is left, in whole tokens rounded down.
    """
    whole = Window.partitionBy(*parent)
    ratio = (F.col("_most") / F.col("_weight")).alias("ratio")
    before = whole.orderBy(ratio, "_name").rowsBetween(Window.unboundedPreceding, -1)
    out = children.withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_most").over(before), F.lit(0)))
    out = out.withColumn("_behind", F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    full = (F.col("_left") > 0) & (_wide("_left") * _wide("_weight") >= _wide("_most") * _wide("_behind"))
    out = out.withColumn("_full", full)
    first = F.struct(ratio, F.col("_name"), F.greatest("_left", F.lit(0)).alias("left"), F.col("_behind").alias("weight"))
    out = out.withColumn("_open", F.min(F.when(~F.col("_full"), first)).over(whole))
    part = F.expr("CAST(CAST(_open.left AS DECIMAL(19,0)) * CAST(_weight AS DECIMAL(18,0)) DIV CAST(_open.weight AS DECIMAL(19,0)) AS BIGINT)")
    budget = F.when(F.col("_full"), F.col("_most")).otherwise(F.least("_most", part))
    return out.withColumn("budget", budget).drop("_left", "_behind", "_full", "_open")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """`leaves` (levels, tokens; one row for each leaf, no null levels) with the budget of each leaf.

    Nodes are told apart by all their levels, whatever characters the names hold.
    """
    names = list(mix.levels)
    by_path = {tuple(k.split("/")) if isinstance(k, str) else tuple(k): int(v) for k, v in mix.weights.items()}
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    budget = min(mix.budget if mix.budget is not None else total * mix.share[0] // mix.share[1], total * mix.epochs)
    above = None
    for depth in range(1, len(names) + 1):
        path, parent = names[:depth], names[: depth - 1]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * mix.epochs).alias("_most"))
        own = {k: v for k, v in by_path.items() if len(k) == depth}
        given = F.lit(None)
        if own:
            table = F.create_map(*[x for k, v in own.items() for x in (F.array(*map(F.lit, k)), F.lit(v))])
            given = F.element_at(table, F.array(*[F.col(f"`{n}`").cast("string") for n in path]))
        nodes = nodes.withColumn("_weight", F.coalesce(given, F.lit(mix.default_weight)).cast("bigint"))
        nodes = nodes.withColumn("_name", F.col(f"`{path[-1]}`")).where("_weight > 0")
        nodes = nodes.withColumn("_budget", F.lit(budget)) if above is None else nodes.join(above, parent)
        above = _share(nodes, parent).select(*path, F.col("budget").alias("_budget"))
    return leaves.join(above, names).select(*names, "tokens", F.col("_budget").alias("budget"))


def order_key(doc_id: Column, text: Column, epoch: Column, seed: int) -> Column:
    """Place of a document in the seeded order of an epoch; without doc_id its text stands for it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.md5(text.cast("string")), F.lit(""))))


def _cut(rows: DataFrame, leaf: list[str], digits: int) -> DataFrame:
    """Rows (leaf, key, tokens, rest) to those of the cell of `digits` hex digits where each leaf's rest ends."""
    cells = rows.groupBy(*leaf, "rest", F.substring("key", 1, digits).alias("_cell")).agg(F.sum("tokens").alias("_n"))
    before = Window.partitionBy(*leaf).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ends = cells.where((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_n") >= F.col("rest")))
    ends = ends.select(*leaf, "_cell", (F.col("rest") - F.col("_before")).alias("_rest"))
    inside = rows.withColumn("_cell", F.substring("key", 1, digits)).drop("rest").join(ends, [*leaf, "_cell"])
    return inside.select(*leaf, "key", "tokens", F.col("_rest").alias("rest"))


def select(docs: DataFrame, mix: Mix) -> DataFrame:
    """All columns of `docs` with `tokens`, `budget` (of the leaf) and `copies` (epochs a row is in) behind.

    Rows that are in no epoch are left out. A null level is the leaf "unknown";
    a null text has no tokens and is chosen while its key is in the prefix.
    Rows with one doc_id have one key, so at the end of a prefix they are taken
    together; the document that crosses the budget is taken whole. Columns of
    `docs` with the names of the new ones are replaced.
    """
    leaf = [f"_level{i}" for i in range(len(mix.levels))]
    own = [c for c in docs.columns if c not in ("tokens", "budget", "copies")]
    named = mix.levels.values()
    rows = docs.select(
        *numbered(own), F.col("doc_id"), F.col("text"), mix.tokens.alias("tokens"),
        *[F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in zip(leaf, named)],
    )
    inner = Mix(dict.fromkeys(leaf), F.lit(0), mix.share, mix.budget, mix.weights, mix.default_weight, mix.epochs, mix.seed)
    leaves = cut_lineage(leaf_budgets(cut_lineage(rows.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"))), inner))
    epoch = F.when(F.col("tokens") > 0, F.expr("budget DIV tokens")).otherwise(F.lit(0))
    plan = leaves.select(*leaf, "budget", epoch.alias("full"), (F.col("budget") - epoch * F.col("tokens")).alias("rest"))
    keyed = rows.join(plan, leaf).withColumn("key", order_key(F.col("doc_id"), F.col("text"), F.col("full"), mix.seed))
    narrow = cut_lineage(keyed.where("rest > 0").select(*leaf, "key", "tokens", "rest"))
    last = _cut(_cut(narrow, leaf, COARSE), leaf, FINE)
    last = last.groupBy(*leaf, "key", "rest").agg(F.sum("tokens").alias("tokens"))
    before = Window.partitionBy(*leaf).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    last = last.where("tokens > 0").withColumn("_before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).where("_before < rest")
    # stored, so that Spark knows its size and sends it to all tasks only if it is small
    cuts = cut_lineage(plan.join(last.groupBy(*leaf).agg(F.max("key").alias("last_key")), leaf, "left").select(*leaf, "budget", "full", "last_key"))
    chosen = rows.join(cuts, leaf).withColumn("key", order_key(F.col("doc_id"), F.col("text"), F.col("full"), mix.seed))
    in_prefix = F.coalesce((F.col("key") <= F.col("last_key")).cast("bigint"), F.lit(0))
    return chosen.withColumn("copies", F.col("full") + in_prefix).where("copies > 0").select(*restored(own), "tokens", "budget", "copies")
