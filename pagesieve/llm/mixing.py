"""Mixing sources to target weights (numbered operator 10). Column functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagesieve.llm.util import WORD_CLASS, hash128
from pagesieve.operators.skew import skewable_join
from pagesieve.session import materialize

ENTROPY_SHARE, MAX_REPEATS = 0.97, 4.0
BLOCK_TOKENS, SEED = 200_000, 17
KEYS = ["doc_id", "source", "h1", "h2"]
SLAB_BLOCKS = 10_000  # blocks that one window sums up
STEPS, HALVINGS = 6, 5  # rounds of bisection, and halvings that one round decides


def key_hash(*parts: Column) -> Column:
    """60 bits of MD5: a permutation key that any SQL engine can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("bigint")


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS)).cast("bigint")


def _measures(sources: DataFrame, exponents: list[float], budget: float, largest: float) -> dict[float, tuple[float, float]]:
    """Entropy of the weights and the largest number of repetitions, per exponent; one row each."""
    x = F.pow(F.col("tokens") / F.lit(largest), F.col("a"))
    rows = (
        sources.withColumn("a", F.explode(F.array(*[F.lit(a) for a in exponents]))).withColumn("x", x)
        .groupBy("a").agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.log("x")).alias("xlogx"),
                          F.max(F.col("x") / F.col("tokens")).alias("most")).collect()
    )
    return {r["a"]: (math.log(r["z"]) - r["xlogx"] / r["z"], budget * r["most"] / r["z"]) for r in rows}


def find_exponent(
    sources: DataFrame, budget: float, entropy_share: float = ENTROPY_SHARE,
    max_repeats: float = MAX_REPEATS,
) -> float:
    """The exponent between 0 (all sources alike) and 1 (shares as they are), by bisection.

    The entropy falls as the exponent grows: the largest exponent whose entropy is at least
    `entropy_share` of the highest possible is taken, and raised, if need be, to the smallest
    exponent at which no source is repeated more than `max_repeats` times. A job decides five halvings
    for both limits at once and returns a row for each point tried, however many sources there are.
    """
    n, largest = sources.agg(F.count(F.lit(1)), F.max("tokens").cast("double")).first()
    if n < 2:
        return 1.0
    target = entropy_share * math.log(n)

    def measure(points: list[float]) -> dict[float, tuple[float, float]]:
        return _measures(sources, points, budget, largest)

    at_one = measure([1.0])[1.0]

    def bisect(holds_low) -> tuple[float, float]:
        """holds_low(entropy, repeats): true below the sought exponent."""
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            points = [low + (high - low) * k / 2**HALVINGS for k in range(1, 2**HALVINGS)]
            seen = measure(points)
            below = [p for p in points if holds_low(*seen[p])]
            low, high = (below[-1] if below else low), min([p for p in points if not holds_low(*seen[p])], default=high)
        return low, high

    by_entropy = 1.0 if at_one[0] >= target else bisect(lambda entropy, _: entropy >= target)[0]
    if at_one[1] > max_repeats:
        return 1.0
    if measure([by_entropy])[by_entropy][1] <= max_repeats:
        return by_entropy
    return bisect(lambda _, repeats: repeats > max_repeats)[1]


def _running(epochs: DataFrame) -> DataFrame:
    """epochs with `before`, the tokens of a source's blocks that come earlier in its epoch. Blocks are
    cut by their order into slabs of about SLAB_BLOCKS, and slabs into as few as there are of them, so
    that no window holds all blocks of a source."""
    epochs = epochs.withColumn("slab", F.floor(F.col("order") / F.lit(float(1 << 60)) * F.ceil(F.col("blocks") / SLAB_BLOCKS)).cast("bigint"))
    within = Window.partitionBy("source", "epoch", "slab").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("source", "epoch").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    slabs = epochs.groupBy("source", "epoch", "slab").agg(F.sum("block_tokens").alias("slab_tokens")).withColumn(
        "slab_before", F.coalesce(F.sum("slab_tokens").over(across), F.lit(0))).drop("slab_tokens")
    placed = epochs.withColumn("inner_before", F.coalesce(F.sum("block_tokens").over(within), F.lit(0)))
    return placed.join(slabs, ["source", "epoch", "slab"]).withColumn(
        "before", F.col("epoch") * F.col("tokens") + F.col("slab_before") + F.col("inner_before")).drop("slab_before", "inner_before", "slab")


def _identity(docs: DataFrame) -> list[Column]:
    """doc_id, source and a 128-bit hash of the text: rows that agree in them are copies of one row."""
    first, second = hash128(docs["text"])
    return [docs["doc_id"], F.coalesce(docs["source"], F.lit("")).alias("source"), first, second]


def _plan(docs: DataFrame, entropy_share: float, max_repeats: float, block_tokens: int, seed: int) -> DataFrame:
    """The plan for rows without their copies: *KEYS, n_tokens, n_rows (copies), weight, epoch, block, slot."""
    # rows without an id have none to be dealt by and go by their text
    dealt = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("h1").cast("string")))
    counted = docs.select(*_identity(docs), tokens(docs["text"]).alias("n_tokens")).groupBy(*KEYS, "n_tokens").agg(F.count(F.lit(1)).alias("n_rows"))
    counted = materialize(counted.withColumns({"hash": key_hash(F.lit(seed), dealt), "all_tokens": F.col("n_tokens") * F.col("n_rows")}), "tokens")
    sources = materialize(counted.groupBy("source").agg(F.sum("all_tokens").alias("tokens")).filter(F.col("tokens") > 0), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    exponent = find_exponent(sources, float(total), entropy_share, max_repeats) if total else 1.0
    scale = sources.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(exponent)))).first()[0] or 1.0
    weight = F.round(F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(exponent)) / F.lit(scale), 9)
    budgets = sources.withColumn("weight", weight).withColumn("budget", F.floor(F.col("weight") * F.lit(total)).cast("bigint")).withColumns({
        "blocks": F.ceil(F.col("tokens") / block_tokens).cast("bigint"),
        "epochs": F.ceil(F.col("budget") / F.col("tokens")).cast("int"),
    })
    in_block = skewable_join(counted, budgets.select("source", "blocks"), ["source"], "inner").withColumn(
        "block", F.pmod("hash", "blocks")).drop("blocks")
    blocks = in_block.groupBy("source", "block").agg(F.sum("all_tokens").alias("block_tokens"))
    epochs = (
        blocks.join(budgets, "source").filter(F.col("epochs") > 0)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
        .withColumn("order", key_hash(F.lit(seed), F.col("source"), F.col("epoch"), F.col("block")))
    )
    placed = _running(epochs)
    placed = placed.filter(F.col("before") < F.col("budget")).select(
        "source", "block", "epoch", "weight", F.col("before"), F.round(F.col("before") / F.col("budget"), 9).alias("slot"),
        (F.col("budget") - F.col("before")).alias("room"), (F.col("before") + F.col("block_tokens") > F.col("budget")).alias("partial"))
    placed = materialize(placed, "placed")
    columns = [*KEYS, "n_tokens", "n_rows", "weight", "epoch", "block", "slot"]
    whole = skewable_join(in_block, placed.filter(~F.col("partial")), ["source", "block"], "inner").select(*columns)
    last = placed.filter("partial")
    inside = Window.partitionBy("source", "block").orderBy("hash", "doc_id", "n_tokens", "h1", "h2").rowsBetween(Window.unboundedPreceding, 0)
    cut = in_block.join(last, ["source", "block"]).withColumn("used", F.sum("all_tokens").over(inside)).filter(
        F.col("used") <= F.col("room")).select(*columns)
    return whole.unionByName(cut)


def plan_mixture(
    docs: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS,
    block_tokens: int = BLOCK_TOKENS, seed: int = SEED,
) -> DataFrame:
    """docs(doc_id, text, source) to doc_id, source, n_tokens, weight, epoch, block, slot: one row for
    each time that a document is read. The budget is the number of tokens in docs.

    A source's share of the budget is its weight; a source with a larger share than tokens is read
    again, an epoch for each time. Documents belong to blocks of about `block_tokens` tokens, by a
    hash. In each epoch the blocks of a source come in an order of their own; the last epoch takes
    whole blocks while they fit, and from the block after them documents in hash order while they
    fit. slot, from 0 to 1, is how far the source's share has been used before the
    block; reading by slot mixes the sources evenly.

    Sums are reduced before they are shuffled. The running sums are over slabs of a source's blocks, over
    the blocks of one slab, and over the documents of one block per source, so no task sees a source's documents.
    A null source counts as the empty one; null and empty texts have no token and are read with their block. Rows that
    share a doc_id are planned by their text, rows without one are dealt by it; copies of a row
    (doc_id, source and text) are read equally often, so the last block takes all of them or none.
    Without a token in the table nothing is planned.
    """
    plan = _plan(docs, entropy_share, max_repeats, block_tokens, seed)
    each = plan.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows"))))
    return each.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "slot")


def mix_documents(
    docs: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS,
    block_tokens: int = BLOCK_TOKENS, seed: int = SEED,
) -> DataFrame:
    """docs with n_copies, the times that the row is read (rows never read go), and the slots at which
    it is read, in order. Odd rows are treated as in plan_mixture: a row has its own numbers, whatever
    other rows share its doc_id or have none, and copies of a row have equal ones. Columns of these two names are
    replaced."""
    plan = _plan(docs, entropy_share, max_repeats, block_tokens, seed).groupBy(*[F.col(k).alias(f"planned_{k}") for k in KEYS]).agg(
        F.count(F.lit(1)).alias("n_copies"), F.array_sort(F.collect_list("slot")).alias("slots"))
    rest = docs.drop("n_copies", "slots")
    # the hash of the text stands first, as an id may be null and a text may not be told by its source
    same = [own.eqNullSafe(plan[f"planned_{k}"]) for own, k in zip(_identity(rest), KEYS)]
    return rest.join(plan, same[2] & same[3] & same[0] & same[1]).drop(*[f"planned_{k}" for k in KEYS])
