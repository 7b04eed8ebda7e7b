"""Mixing sources to target weights: hierarchical budgets and seeded epochs.

The token budget goes down a tree (domain, language, source).  At each node the children
share it by weight, none above what its documents can give in ``max_epochs`` epochs; what a
child cannot use goes to its siblings by their weights, and only what all of them cannot use
stays with the parent's siblings, because a parent's own ceiling is the sum of its children's.
A leaf spends its budget on whole epochs and a token prefix of the next one, each epoch an
order of its own: by a hash of the seed, the document's id and text, and the epoch's number.

The prefix needs no global sort: tokens are summed per slice of the hash, the slice that the
budget ends in is found from those sums, and only that slice's documents are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
WHOLE = "decimal(38,0)"


def share(nodes: DataFrame, parent: Sequence[str], budget: str, weight: str, ceiling: str, out: str) -> DataFrame:
    """``out``: each row's part of its parent's ``budget`` by ``weight``, at most ``ceiling``, by exact integers.

    Children fill up in the order of ceiling / weight: those whose ceiling is below their part
    of what is left take the ceiling, the others share the rest by weight (rounded down).
    """
    names = [c for c in nodes.columns if c.startswith("k_")]
    order = Window.partitionBy(*parent).orderBy(F.col(ceiling) / F.col(weight), *names)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    zero = F.lit(0).cast(WHOLE)
    filled = nodes.withColumn("_b", F.coalesce(F.sum(ceiling).over(before), zero)) \
        .withColumn("_w", F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), zero))
    left = F.greatest(F.col(budget) - F.col("_b"), zero)
    full = F.col(ceiling) * F.col("_w") <= left * F.col(weight)
    # the first child that does not fill up sets the rate for all after it
    rate = filled.withColumns({"_full": full, "_left": left, "_n": F.row_number().over(order)})
    first = F.struct("_n", F.col("_left").alias("l"), F.col("_w").alias("w"))
    rate = rate.withColumn("_first", F.min(F.when(~F.col("_full"), first)).over(whole))
    part = F.expr(f"(_first.l * `{weight}`) div _first.w").cast(WHOLE)
    return rate.withColumn(out, F.when(F.col("_full"), F.col(ceiling)).otherwise(F.least(part, F.col(ceiling)))) \
        .drop("_b", "_w", "_full", "_left", "_n", "_first")


def budgets(leaves: DataFrame, budget: int | Column, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """Leaf budgets for ``leaves`` (k_domain, k_lang, k_source, tokens): exact integer water-filling level by level.

    ``weights`` holds each level's weights by name (whole numbers from 1; 1 for names not given).
    """
    levels = ["k_domain", "k_lang", "k_source"]

    def weight(level: str) -> Column:
        given = weights.get(level.removeprefix("k_"), {})
        w = F.lit(1)
        for name, value in sorted(given.items()):
            w = F.when(F.col(level) == name, value).otherwise(w)
        return w.cast(WHOLE)

    leaves = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast(WHOLE)).withColumn("root", F.lit(0))
    total = budget if isinstance(budget, Column) else F.lit(budget)
    tree, parents, given = leaves, ["root"], "b_root"
    tree = tree.withColumn(given, total.cast(WHOLE))
    for depth, level in enumerate(levels):
        path = levels[:depth + 1]
        nodes = tree.groupBy("root", *path).agg(F.sum("cap").cast(WHOLE).alias("c"), F.first(given).alias("g")) \
            .withColumn("w", weight(level))
        nodes = share(nodes, [*parents], "g", "w", "c", f"b_{depth}").select(*path, f"b_{depth}")
        on = [F.col(f"t.{p}").eqNullSafe(F.col(f"n.{p}")) for p in path]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        tree = tree.alias("t").join(nodes.alias("n"), cond).select("t.*", f"n.b_{depth}")
        parents, given = ["root", *path], f"b_{depth}"
    return tree.withColumnRenamed("b_2", "leaf_budget").select(*levels, "tokens", "leaf_budget")


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget_percent: int = 100, max_epochs: int = 4,
        seed: int = 17, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` with ``mix_copies``: in how many epochs of its leaf the row is taken (rows of 0 copies included).

    The budget is ``budget_percent`` of all tokens (words).  Null keys are leaves of their own;
    null and empty texts have no tokens and go with the prefix they stand in; very long texts count whole;
    rows that share only an id are apart in the order, repeated rows (ties) stand next to each other and count each; added columns are ``mix_tokens`` and
    ``mix_copies``; an empty table gives an empty result.
    """
    keys = ["k_domain", "k_lang", "k_source"]

    def marked(df, m=""):
        own = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
        return df.withColumns({f"{m}k_domain": domain, f"{m}k_lang": F.col(lang), f"{m}k_source": F.col(source), f"{m}own": own,
                               "mix_tokens": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")})

    rows = written(marked(docs.select(id_col, text, lang, source)).select(*keys, "own", "mix_tokens"), "mix-rows")
    # about as many slices as documents in a slice: either side of the cut stays small at any size
    slices_of = 1 << max(1, rows.count().bit_length() // 2)

    def placed(df, m=""):
        """The place of each row in the order of its leaf's last epoch, and the slice of that place."""
        place = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(f"{m}own"), F.col(f"{m}epochs").cast("string"))), 1, 12), 16, 10).cast("long")
        return df.withColumn(f"{m}place", place).withColumn(f"{m}slice", F.floor(F.col(f"{m}place") / (2**48 // slices_of)).cast("long"))

    leaves = written(rows.groupBy(*keys).agg(F.sum("mix_tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = budgets(leaves, total * budget_percent // 100, weights, max_epochs)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("leaf_budget div tokens")).otherwise(0).cast("long")) \
        .withColumn("rest", (F.col("leaf_budget") - F.col("epochs") * F.col("tokens")).cast("long"))
    plan = written(plan, "mix-budgets")

    def same(a, b):
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return cond

    slices = written(placed(rows.alias("r").join(plan.select(*keys, "epochs").alias("p"), same("r", "p")).select("r.*", "p.epochs"))
                     .groupBy(*keys, "slice").agg(F.sum("mix_tokens").alias("tokens")), "mix-slices")
    # the slice of each leaf in which the last, partial epoch ends
    running = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = slices.withColumn("prior", F.coalesce(F.sum("tokens").over(running), F.lit(0)))
    cut = (plan.alias("p").join(sums.alias("s"), same("p", "s"), "left")
           .where(F.col("s.prior") < F.col("p.rest"))
           .groupBy(*[F.col(f"p.{k}") for k in keys]).agg(F.max("s.slice").alias("last"), F.max("s.prior").alias("prior")))
    plan = written(plan.alias("p").join(cut.alias("c"), same("p", "c"), "left")
                   .select(*[F.col(f"p.{k}").alias(f"p_{k}") for k in keys], "epochs", "rest",
                           F.coalesce("last", F.lit(-1)).alias("last"), F.coalesce("prior", F.lit(0)).alias("prior")), "mix-plan")
    # beside the columns of ``docs`` all names of the plan have a prefix, so that none clash
    m = "__mix_"
    plan = plan.select(*[F.col(c).alias(m + c) for c in plan.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(m + k).eqNullSafe(F.col(f"{m}p_{k}"))
    rows = placed(marked(docs, m).join(plan, cond), m)
    slice_, last, epochs = F.col(f"{m}slice"), F.col(f"{m}last"), F.col(f"{m}epochs")
    inner = rows.where(slice_ == last)
    outer = rows.where((slice_ != last) | slice_.isNull()).withColumn("mix_copies", epochs + (slice_ < last).cast("long"))
    order = Window.partitionBy(*[m + k for k in keys]).orderBy(f"{m}place", id_col, text).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col(f"{m}prior") + F.coalesce(F.sum("mix_tokens").over(order), F.lit(0))
    inner = inner.withColumn(f"{m}before", before) \
        .withColumn("mix_copies", epochs + (F.col(f"{m}before") < F.col(f"{m}rest")).cast("long")).drop(f"{m}before")
    return outer.unionByName(inner).drop(*[c for c in rows.columns if c.startswith(m)])
