"""Preference pairs as a shared prompt and two masked completions (numbered operator 1). Column
functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagesieve.llm.util import hash128
from pagesieve.operators.skew import skewable_join
from pagesieve.session import materialize

# Fixed values of the chat template.
START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def shared_turns(chosen: Column, rejected: Column) -> Column:
    """Number of leading turns (role and text) that both conversations have."""
    shorter = F.least(F.size(chosen), F.size(rejected))
    alike = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b))
    different = F.array_position(alike, F.lit(False)).cast("int")
    # zip_with pads the shorter side with nulls, which differ from any turn
    return F.when(different > 0, different - 1).otherwise(shorter)


def segments(turns: Column) -> Column:
    """Turns as array<struct<text, train>>: a header that is never trained, then the text with its end
    mark, trained where the assistant speaks."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(F.concat(F.lit(START), t["role"], F.lit("\n")).alias("text"), F.lit(False).alias("train")),
        F.struct(F.concat(t["text"], F.lit(END)).alias("text"), (t["role"] == TRAINED_ROLE).alias("train")))))


def rendered(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Adds n_shared, prompt, chosen_segments and rejected_segments to pairs with chosen and rejected
    (array<struct<role, text>>), and drops those two.

    The prompt is the longest common prefix of turns, rendered once; a completion is what follows, in
    segments marked for training. If one conversation is a prefix of the other, its completion is
    empty; equal conversations have two empty ones. A null role is `user`, a null text
    empty, a null conversation one without turns.
    """

    def clean(c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.expr("array()")), lambda t: F.struct(
            F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))

    n = F.col("n_shared")

    def after(c: str) -> Column:
        return segments(F.slice(F.col(c), n + 1, F.greatest(F.size(c) - n, F.lit(0))))

    cleaned = pairs.withColumns({"chosen": clean("chosen"), "rejected": clean("rejected")})
    return cleaned.withColumn("n_shared", shared_turns(F.col("chosen"), F.col("rejected"))).withColumns({
        "prompt": rendered(segments(F.slice("chosen", F.lit(1), n))),
        "chosen_segments": after("chosen"), "rejected_segments": after("rejected"),
    }).drop("chosen", "rejected")


def conversation_table(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) to conv_id, turns in order of turn (ties: role, text); a row
    per conversation, which is what is rendered. Rows without conv_id are left out."""
    return turns.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) to conv_id, chosen_id, kind, chosen, rejected: one pair per
    conversation at most.

    Conversations that open with the same turn compete: the one with the most turns (ties: the smallest
    conv_id) is chosen over each other one (kind `sibling`), so pairs are as many as
    conversations, never all pairs of a group. The chosen one of each group, up to its last
    answer, is paired with itself with that answer replaced by the one before, or by an
    empty one (kind `stale`); without an answer it gives no pair.
    """
    conversations = materialize(conversation_table(turns), "conversations")
    keyed = conversations.select("conv_id", "turns", *hash128(F.to_json(F.get("turns", F.lit(0)))))
    best = keyed.groupBy("h1", "h2").agg(F.min(F.struct((-F.size("turns")).alias("n"), "conv_id"))["conv_id"].alias("chosen_id"))
    led = skewable_join(keyed, best, ["h1", "h2"], "inner").select("conv_id", "chosen_id", "turns")
    chosen = conversations.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"))
    siblings = skewable_join(led.filter(F.col("conv_id") != F.col("chosen_id")), chosen, ["chosen_id"], "inner").select(
        "conv_id", "chosen_id", F.lit("sibling").alias("kind"), "chosen", F.col("turns").alias("rejected"))
    answers = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["role"] == TRAINED_ROLE)
    own = led.filter(F.col("conv_id") == F.col("chosen_id")).withColumn("answers", answers).filter(F.size("answers") > 0)
    last = F.element_at("answers", F.lit(-1))
    before = F.when(F.size("answers") > 1, F.get("turns", F.get("answers", F.size("answers") - 2))["text"])
    stale = F.array(F.struct(F.lit(TRAINED_ROLE).alias("role"), F.coalesce(before, F.lit("")).alias("text")))
    alone = own.select(
        "conv_id", "chosen_id", F.lit("stale").alias("kind"), F.slice("turns", F.lit(1), last + 1).alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), last), stale).alias("rejected"))
    return siblings.unionByName(alone)
