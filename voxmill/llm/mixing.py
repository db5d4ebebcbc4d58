"""Mixing sources to target weights by hierarchical budgets.

A tree has the levels given as columns (domain, language, source). A total of tokens is handed
down by weights; a node can take no more than its documents hold times the number of epochs.
What a node cannot take goes to its siblings first, in proportion to their weights, and only
what all siblings cannot take goes back to their parent's siblings. Leaves then take their
documents in an order drawn anew for each epoch from a seed, until the budget is spent; the last
document may be taken in part (a token prefix).

Budgets are worked out on leaf totals (one row for each leaf), level by level, each by running sums over the children of
a parent in the order in which they fill up; tokens stay whole numbers, and none is lost on the way down. The plan is
broadcast up to ``LEAVES`` leaves and joined by shuffle beyond. Selection is by two-level running sums: tokens are summed in
bins of the drawn order, bins get their offset, and only bins that hold a budget's end are sorted, so a
source with a third of all rows is spread over as many tasks as it has bins.

Null level values form a leaf of their own; a null or empty text has no tokens and is never
taken. Ties in the drawn order are broken by id, then by text hash; equal rows are taken each. Long texts count whole. Other
columns are not read and may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmill.llm.common import staged

#: Leaves whose plan is broadcast, at most.
LEAVES = 100_000
#: Rows in a bin of the drawn order, on average.
BIN_ROWS = 2_000
#: Weights are counted in parts of one UNIT-th; sums of a parent's weights stay below 10^19 of them.
UNIT = 1_000_000
#: Draws are the first 60 bits of an md5.
DRAW_DIGITS = 15


def same(a: DataFrame, b: DataFrame, names: list[str]) -> list[Column]:
    return [a[c].eqNullSafe(b[f"__{c}"]) for c in names]


def renamed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"__{c}" for c in names})


def shared_out(children: DataFrame, names: list[str]) -> DataFrame:
    """``budget`` of children (names, cap, weight, total), whose parent (all names but the last) has ``total`` to give.

    Weights are counted in millionths, and all sums and quotients are of whole numbers. Children fill up in the order of cap / weight. A child is full
    if the total covers what filled up before it and, at its own level, itself and all that come after; the others share the rest by weight: each gets
    what the shares up to it, rounded down, have gained, and the last one's is the whole rest. A child without weight gets nothing.
    """
    some = F.col("weight") > 0
    whole = F.greatest(F.round(F.col("weight") * UNIT), F.lit(1.0)).cast("decimal(18,0)")
    c = children.withColumn("cap", F.when(some, F.col("cap")).otherwise(0)).withColumn("weight", F.when(some, whole).otherwise(F.lit(UNIT).cast("decimal(18,0)")))
    family = Window.partitionBy(*names[:-1])
    order = family.orderBy(F.col("cap") / F.col("weight").cast("double"), names[-1])
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    big = lambda x: x.cast("decimal(19,0)")
    c = c.withColumns({"before": before, "after": after.cast("decimal(19,0)")})
    c = c.withColumn("full", big(F.col("cap")) * F.col("after") <= big(F.col("total") - F.col("before")) * F.col("weight"))
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family)
    open_ = F.when(F.col("full"), F.lit(0).cast("decimal(18,0)")).otherwise(F.col("weight"))
    upto = F.sum(open_).over(order.rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumns({"rest": big(rest), "open": F.sum(open_).over(family).cast("decimal(19,0)"), "upto": upto.cast("decimal(19,0)")})
    c = c.withColumn("below", (F.col("upto") - F.col("weight")).cast("decimal(19,0)"))
    part = F.expr("CASE WHEN open > 0 THEN (rest * upto) div open - (rest * below) div open ELSE 0 END")
    return c.select(*names, F.when(F.col("full"), F.col("cap")).otherwise(part).cast("long").alias("budget"))


def budgets(leaves: DataFrame, levels: list[str], weights: dict[tuple, float], total: int, epochs: int) -> DataFrame:
    """Whole tokens (levels, budget) for each leaf (levels, leaf_tokens). ``weights`` of a path (a tuple from the top) default to 1."""
    spark = leaves.sparkSession
    most = leaves.agg(F.coalesce(F.sum("leaf_tokens"), F.lit(0))).first()[0] * epochs
    given = None
    for k in range(1, len(levels) + 1):
        names = levels[:k]
        nodes = leaves.groupBy(*names).agg((F.sum("leaf_tokens") * epochs).alias("cap"))
        kinds = ", ".join(f"`__{c}` {leaves.schema[c].dataType.simpleString()}" for c in names)
        told = spark.createDataFrame([(*path, float(w)) for path, w in weights.items() if len(path) == k], f"{kinds}, weight double")
        nodes = nodes.join(told, same(nodes, told, names), "left").select(*names, "cap", F.coalesce("weight", F.lit(1.0)).alias("weight"))
        if given is None:
            children = nodes.withColumn("total", F.lit(min(total, most)).cast("long"))
        else:
            parents = renamed(given, names[:-1]).withColumnRenamed("budget", "total")
            children = nodes.join(parents, same(nodes, parents, names[:-1])).select(*names, "cap", "weight", "total")
        given = staged(shared_out(children, names), "budgets")
    return given


def leaf_totals(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Tokens and rows of each leaf. A hot leaf is one row of partial sums."""
    return rows.groupBy(*levels).agg(F.sum("n_tokens").alias("leaf_tokens"), F.count("*").alias("leaf_rows"))


def word_count(text: str) -> Column:
    """How many words (runs of other characters than space and U+0009..U+000D)."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.regexp_count(content, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix(docs: DataFrame, levels: dict[str, str], weights: dict[tuple, float], share: float = 0.6, epochs: int = 2, seed: int = 42, tokens: Column | None = None) -> DataFrame:
    """What is taken: doc_id, the levels, n_tokens, epoch (from 0) and take_tokens.

    ``levels`` names the levels of the tree from the top, each with its SQL expression over the columns of ``docs``. ``share`` is the total as a share of all tokens; ``epochs`` says how often a document may be taken.
    """
    count = word_count("text") if tokens is None else tokens
    copy = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), copy.cast("string")))
    named = [F.expr(e).alias(n) for n, e in levels.items()]
    levels = list(levels)
    rows = docs.select(*named, "doc_id", copy.alias("copy"), count.alias("n_tokens"), name.alias("name"))
    rows = staged(rows.where("n_tokens > 0"), "sizes")
    totals = staged(leaf_totals(rows, levels), "leaves")
    whole_sum = totals.agg(F.coalesce(F.sum("leaf_tokens"), F.lit(0))).first()[0]
    given = renamed(budgets(totals, levels, weights, floor(whole_sum * share), epochs), levels)
    plan = renamed(totals.join(given, same(totals, given, levels)).select(*levels, "leaf_tokens", "leaf_rows", "budget"), levels)
    plan = F.broadcast(plan) if totals.count() <= LEAVES else plan
    joined = rows.join(plan, same(rows, plan, levels)).select(*levels, "doc_id", "copy", "n_tokens", "name", "leaf_tokens", "budget", "leaf_rows")
    # epochs that a budget fills are taken whole; the last one, if any, is a prefix of its order
    whole, part = F.floor(F.col("budget") / F.col("leaf_tokens")), F.col("budget") % F.col("leaf_tokens")
    joined = joined.select("*", whole.alias("whole"), part.alias("part"))
    full = joined.where("whole > 0").select("*", F.explode(F.expr("sequence(0L, whole - 1)")).alias("epoch")).withColumn("take_tokens", F.col("n_tokens"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), "name")), 1, DRAW_DIGITS), 16, 10).cast("long")
    order = joined.where("part > 0").withColumn("at", drawn)
    bins = F.greatest(F.ceil(F.col("leaf_rows") / BIN_ROWS), F.lit(1))
    order = order.withColumn("bin", F.least(F.floor(F.col("at") / F.lit(16.0**DRAW_DIGITS) * bins), bins - 1))
    sums = order.groupBy(*levels, "bin").agg(F.sum("n_tokens").alias("bin_tokens"))
    before = F.coalesce(F.sum("bin_tokens").over(Window.partitionBy(*levels).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*levels, "bin", "bin_tokens", before.alias("bin_start"))
    b = sums.select(*[F.col(c).alias(f"__{c}") for c in levels], F.col("bin").alias("__bin"), "bin_tokens", "bin_start")
    placed = order.join(b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in levels] + [F.col("bin") == F.col("__bin")])
    placed = placed.where("bin_start < part")
    inside = placed.where("bin_start + bin_tokens <= part").withColumn("take_tokens", F.col("n_tokens"))
    window = Window.partitionBy(*levels, "bin").orderBy("at", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    crossing = placed.where("bin_start + bin_tokens > part").withColumn("start", F.col("bin_start") + F.coalesce(F.sum("n_tokens").over(window), F.lit(0)))
    crossing = crossing.where("start < part").withColumn("take_tokens", F.least("n_tokens", F.col("part") - F.col("start")))
    last = inside.select(*joined.columns, "take_tokens").unionByName(crossing.select(*joined.columns, "take_tokens")).withColumn("epoch", F.col("whole"))
    out = ["doc_id", *levels, "n_tokens", F.col("epoch").cast("int").alias("epoch"), "take_tokens"]
    return full.select(*out).unionByName(last.select(*out))


#: The weights of the query and of the pipeline; other paths weigh 1.
WEIGHTS = {("domain0",): 4.0, ("domain1",): 3.0, ("domain2",): 2.0, ("domain3",): 1.0, **{(f"domain{k}", "en"): 2.0 for k in range(4)}}
#: Sources fall into four domains by the number at their end.
LEVELS = {"domain": r"concat('domain', coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,6})$', 1) as int) % 4, 0))", "lang": "lang", "source": "source"}
