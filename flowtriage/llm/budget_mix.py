"""Mixing sources to target weights by hierarchical budgeting.

DataFrame functions only.  Token counts go up a tree of domains, languages and
sources; a token budget comes down it by weight.  A child that cannot spend
its share leaves the shortage to its siblings; only what all of them cannot
spend is left to the parent's siblings, since a parent's budget is bounded by
what its children can spend.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtriage.llm.common import cut, set_aside
from flowtriage.llm.running import key, running, shuffle_key

LEVELS = ("domain", "lang", "source")
SEED = 29
MAX_EPOCHS = 4
BUDGET_PERCENT = 80
# Parts of a leaf when its plan is too large to be broadcast.
PARTS = 64
MOST_BROADCAST = 100_000
# Production weights; names that are not listed weigh 1.
WEIGHTS = {
    "domain": {"crawl": 4, "books": 3, "code": 2, "news": 3},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 2},
    "source": {},
}


def domain_of(source: Column) -> Column:
    """The domain of a source: src0 is the crawl, others go by their number."""
    number = F.regexp_extract(source, r"^src(\d{1,9})$", 1).try_cast("bigint")
    return (
        F.when(number == 0, "crawl").when(number % 3 == 0, "books").when(number % 3 == 1, "code").when(number % 3 == 2, "news").otherwise("other")
    )


def token_count(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _weight(level: str, weights: dict[str, int]) -> Column:
    """The weight of a node by its group key; negative weights count as 0."""
    if not weights:
        return F.lit(1).cast("bigint")
    pairs = chain.from_iterable((F.lit(f"={name}"), F.lit(max(0, int(w)))) for name, w in weights.items())
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(f"_{level}")), F.lit(1)).cast("bigint")


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split each parent's ``_budget`` among its children by ``_weight``, up to their ``_capacity``.

    Children are taken by capacity per weight, ascending.  One that the
    remaining budget would fill is filled; the rest share what is left by
    weight, rounded down.  So shortages go to siblings in proportion.
    """
    siblings = Window.partitionBy(*parent)
    ratio = F.when(F.col("_weight") > 0, F.col("_capacity") / F.col("_weight")).otherwise(0.0)
    before = siblings.orderBy(ratio, name).rowsBetween(Window.unboundedPreceding, -1)
    spend = F.least(F.col("_budget"), F.sum("_capacity").over(siblings)).cast("decimal(20,0)")
    staged = nodes.select(
        "*",
        spend.alias("_spend"),
        (F.sum("_weight").over(siblings) - F.coalesce(F.sum("_weight").over(before), F.lit(0))).alias("_weights_left"),
        F.coalesce(F.sum("_capacity").over(before), F.lit(0)).cast("decimal(20,0)").alias("_spent"),
    )
    full = F.col("_capacity").cast("decimal(20,0)") * F.col("_weights_left").cast("decimal(18,0)") <= F.col("_weight").cast(
        "decimal(18,0)"
    ) * (F.col("_spend") - F.col("_spent"))
    filled = staged.withColumn("_full", full)
    taken = F.sum(F.when(F.col("_full"), F.col("_capacity")).otherwise(0)).over(siblings)
    heavy = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_weight"))).over(siblings)
    shared = filled.select("*", (F.col("_spend") - taken).alias("_open"), heavy.alias("_heavy"))
    part = F.expr("(cast(_weight as decimal(18,0)) * cast(_open as decimal(20,0))) div cast(_heavy as decimal(18,0))")
    return shared.withColumn("_allotted", F.when(F.col("_full"), F.col("_capacity")).otherwise(part)).drop(
        "_spend", "_weights_left", "_spent", "_full", "_open", "_heavy"
    )


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget_percent: int, max_epochs: int) -> DataFrame:
    """Allot tokens to leaves (_domain, _lang, _source, tokens): adds ``allotted``.

    The budget is that percentage of all tokens; a leaf can give its tokens
    ``max_epochs`` times.
    """
    names = [f"_{level}" for level in LEVELS]
    wide = leaves.withColumn("_weight", _weight("source", weights.get("source", {})))
    wide = wide.withColumn("_capacity", F.when(F.col("_weight") > 0, F.col("tokens") * max_epochs).otherwise(0))
    tree = [wide]
    for depth in (2, 1):
        sums = [F.sum(c).cast("bigint").alias(c) for c in ("_capacity", "tokens")]
        node = tree[0].groupBy(*names[:depth]).agg(*sums)
        node = node.withColumn("_weight", _weight(LEVELS[depth - 1], weights.get(LEVELS[depth - 1], {})))
        tree.insert(0, node.withColumn("_capacity", F.when(F.col("_weight") > 0, F.col("_capacity")).otherwise(0)))
    top = tree[0].withColumn("_root", F.lit(0))
    whole = F.sum("tokens").over(Window.partitionBy("_root"))
    top = top.withColumn("_whole", whole).withColumn("_budget", F.expr(f"(_whole * {int(budget_percent)}) div 100"))
    allotted = share(top, ["_root"], names[0])
    for depth in (1, 2):
        parent = allotted.select(*names[:depth], F.col("_allotted").alias("_budget"))
        allotted = share(tree[depth].join(parent, names[:depth]), names[:depth], names[depth])
    return allotted.select(*names, "tokens", F.col("_allotted").alias("allotted"))


def _planned(rows: DataFrame, plan: DataFrame, names: list[str]) -> DataFrame:
    """Join the plan, which has one row a leaf, without gathering the rows of a leaf."""
    plan = cut(plan)
    if plan.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(plan), names)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(PARTS)).cast("int"))
    copies = plan.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.hint("merge").join(copies, [*names, "_part"]).drop("_part")


def mix(
    docs: DataFrame,
    weights: dict[str, dict[str, int]] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """Choose rows of ``docs`` so that their tokens follow the weights of the tree.

    ``docs`` has doc_id, text, lang and source.  A leaf that is allotted B of
    its T tokens gives all of its rows for B div T epochs.  In the next epoch
    it gives the rows of a shuffle seeded by epoch whose running token count
    stays within the rest, so no leaf exceeds its budget.

    No leaf is gathered in a task: the plan, a row a leaf, is broadcast if it
    is counted to be small, else each leaf is dealt out over ``PARTS`` copies
    of its row; ranks are taken by leaf and bucket.

    Keeps all columns of ``docs`` and adds domain, epoch (from 0) and n_tokens;
    columns with these names are replaced.  Null languages and sources are
    nodes of their own; null and empty texts have no tokens and come along
    with the rows around them; a leaf or tree without tokens gives no rows.
    Repeated rows are drawn one by one.
    """
    if max_epochs < 1 or budget_percent < 0:
        raise ValueError("there must be an epoch, and no negative budget")
    docs, named_back = set_aside(docs, ("doc_id", "text", "lang", "source"), ("domain", "epoch", "n_tokens"))
    rows = docs.withColumns({"domain": domain_of(F.col("source")), "n_tokens": token_count(F.col("text"))})
    names = [f"_{level}" for level in LEVELS]
    rows = rows.withColumns({f"_{level}": key(level) for level in LEVELS})
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, weights, budget_percent, max_epochs).select(
        *names,
        F.expr("if(tokens > 0, allotted div tokens, 0)").alias("_whole"),
        F.expr("if(tokens > 0, allotted % tokens, 0)").alias("_rest"),
    )
    keyed = _planned(rows, plan.where("_whole > 0 OR _rest > 0"), names)
    keyed = keyed.withColumn("_order", shuffle_key(seed, F.col("_whole"), F.col("doc_id")))
    keyed = keyed.withColumn("_bucket", F.substring("_order", 1, 3))
    summed = running(keyed, names, "_bucket", ["_order", "n_tokens"], "n_tokens", "_before", "_tokens")
    drawn = (F.col("_rest") > 0) & (F.col("_before") + F.col("n_tokens") <= F.col("_rest"))
    times = (F.col("_whole") + F.when(drawn, 1).otherwise(0)).cast("int")
    chosen = summed.withColumn("_times", times).where("_times > 0")
    epochs = chosen.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    return epochs.select(*named_back, "domain", "n_tokens", "epoch")
