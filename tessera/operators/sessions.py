"""Sessions as sequences of messages: turns and steps (W6), extraction batches (W7) and retention.

Running numbers of a conversation are made of those within stretches of CHUNK positions and of the totals of the
stretches before, so a conversation of any length is many tasks' work. Turns are the largest groups handled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import token_estimate, truncate_to_tokens
from .windows import pack_batches

#: Positions of a conversation whose running numbers are made at once.
CHUNK = 4096


def running(df: DataFrame, by: str, pos: str, **sums: Column) -> DataFrame:
    """df with running sums (pos and all before) within `by`; a null `by` is a value of its own, rows of equal pos are
    summed together."""
    chunk = F.floor(F.col(pos) / CHUNK)
    totals = df.groupBy(F.col(by).alias("_by"), chunk.alias("_at")).agg(*(F.sum(c).alias(f"_before_{n}") for n, c in sums.items()))
    earlier = Window.partitionBy("_by").orderBy(F.asc_nulls_first("_at")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_by", "_at", *(F.coalesce(F.sum(f"_before_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums))
    own = Window.partitionBy(by, "_chunk").orderBy(F.asc_nulls_first(pos)).rangeBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_chunk", chunk).withColumns({n: F.sum(c).over(own) for n, c in sums.items()})
    both = local.join(before, F.col(by).eqNullSafe(F.col("_by")) & F.col("_chunk").eqNullSafe(F.col("_at")))
    return both.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums}).drop("_by", "_at", "_chunk", *(f"_before_{n}" for n in sums))


def turns(messages: DataFrame) -> DataFrame:
    """Turn and step numbers of messages (conv_id, pos, role, is_tool): a user message that isn't tool transport
    opens a turn, an assistant message that isn't tool transport a step; tool results stay with the step before."""
    own = ~F.coalesce(F.col("is_tool"), F.lit(False))
    opens = (F.coalesce(F.col("role"), F.lit("")) == "user") & own
    step = (F.coalesce(F.col("role"), F.lit("")) == "assistant") & own
    counted = running(messages, "conv_id", "pos", turn_no=opens.cast("int"), _steps=step.cast("int"))
    first = F.min(F.col("_steps") - step.cast("int")).over(Window.partitionBy("conv_id", "turn_no"))
    return counted.withColumn("step_no", F.col("_steps") - first).drop("_steps")


def anchored() -> Column:
    """Whether a message of turns() is the user message that its turn answers."""
    return (F.coalesce(F.col("role"), F.lit("")) == "user") & ~F.coalesce(F.col("is_tool"), F.lit(False))


def units(messages: DataFrame, max_tokens: int, max_messages: int) -> DataFrame:
    """What batches are made of, from messages of turns() with tokens: (session, pos, level, tokens, messages). A
    turn within both limits is one unit; a larger one is opened into its anchor and its steps, a step that is still
    larger into its messages. pos is that of a unit's first message."""
    sums = lambda *by: (F.sum("tokens").over(Window.partitionBy(*by)), F.count(F.lit(1)).over(Window.partitionBy(*by)))
    over = lambda of: (of[0] > max_tokens) | (of[1] > max_messages)
    part = F.when(anchored(), -1).otherwise(F.col("step_no"))
    rows = messages.select(F.col("conv_id").alias("session"), "pos", "turn_no", part.alias("part"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    rows = rows.withColumn("open", over(sums("session", "turn_no"))).withColumn("wide", F.col("open") & over(sums("session", "turn_no", "part")))
    level = F.when(F.col("wide") | (F.col("open") & (F.col("part") == -1)), "message").when(F.col("open"), "step").otherwise("turn")
    by = rows.withColumn("level", level).groupBy("session", "turn_no", "level", F.when(F.col("level") != "turn", F.col("part")).alias("part"), F.when(F.col("level") == "message", F.col("pos")).alias("one"))
    return by.agg(F.min("pos").alias("pos"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("messages")).select("session", "pos", "level", "tokens", "messages")


def extraction_batches(messages: DataFrame, max_tokens: int | None = None, max_messages: int | None = None) -> DataFrame:
    """Units of each session packed greedily in order: (session, pos, level, tokens, messages, batch, oversized). A
    unit that no batch can hold is a batch of its own. Without limits a session is one batch."""
    none = 1 << 62
    limits = (none if max_tokens is None else max_tokens, none if max_messages is None else max_messages)
    return pack_batches(units(messages, *limits), *limits)


def retain(messages: DataFrame, keep_turns: int, token_budget: int, min_tail_steps: int = 1) -> DataFrame:
    """What becomes of messages of turns() with tokens, and text where previews are wanted: a row for each place
    of a message, `archive` or `keep`; a message may have both.

    The last keep_turns turns stay as far as they fit the budget whole, the last first; older ones are archived. A last
    turn above the budget is split: its anchor stays and is repeated in the archive, which the last whole steps that
    fit beside it don't go to; of the last min_tail_steps steps, those that don't fit are archived whole and stay as a
    preview, cut to their messages' shares of what the anchor leaves. `checkpoint` marks the archived sources of a split
    turn but the anchor. Without an anchor such a turn is archived whole. Messages of an anchor without steps stay."""
    rows = messages.withColumns({"anchor": anchored(), "tokens": F.coalesce("tokens", F.lit(0)).cast("long")})
    last = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.max("turn_no").alias("_last"))
    recent = rows.join(last, F.col("conv_id").eqNullSafe(F.col("_c"))).where(F.col("turn_no") > F.col("_last") - keep_turns)
    by_turn = recent.groupBy(F.col("conv_id").alias("_c"), F.col("turn_no").alias("_t"), (F.col("turn_no") == F.col("_last")).alias("_is_last")).agg(
        F.sum("tokens").alias("_size"), F.sum(F.when(F.col("anchor"), F.col("tokens"))).alias("_anchor"), F.max(F.when(~F.col("anchor"), F.col("step_no"))).alias("_end"))
    late = Window.partitionBy("_c").orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, 0)
    fits = F.sum("_size").over(late) <= token_budget
    fate = F.when(fits, "keep").when(~F.col("_is_last") | F.col("_anchor").isNull(), "archive").when(F.col("_end").isNull(), "keep").otherwise("split")
    by_turn = by_turn.withColumn("_fate", fate)
    steps = recent.where(~F.col("anchor")).groupBy(F.col("conv_id").alias("_c"), F.col("turn_no").alias("_t"), F.col("step_no").alias("_s")).agg(F.sum("tokens").alias("_step"))
    same = lambda a, b: F.col(f"{a}._c").eqNullSafe(F.col(f"{b}._c")) & (F.col(f"{a}._t") == F.col(f"{b}._t"))
    split = steps.alias("a").join(by_turn.where("_fate = 'split'").alias("b"), same("a", "b")).select("a._c", "a._t", "_s", "_step", "_anchor")
    back = Window.partitionBy("_c", "_t").orderBy(F.desc("_s"))
    split = split.withColumns({"_after": F.sum("_step").over(back.rangeBetween(Window.unboundedPreceding, 0)), "_rank": F.row_number().over(back)})
    room = F.greatest(F.lit(token_budget) - F.col("_anchor"), F.lit(0))
    split = split.withColumns({"_room": room, "_step_fate": F.when(F.col("_after") <= room, "keep").when(F.col("_rank") <= min_tail_steps, "preview").otherwise("archive")})
    # what previews share: the room that kept tail steps leave
    tail = Window.partitionBy("_c", "_t")
    split = split.withColumns({"_room": F.col("_room") - F.coalesce(F.sum(F.when(F.col("_step_fate") == "keep", F.col("_step"))).over(tail), F.lit(0)), "_wanted": F.sum(F.when(F.col("_step_fate") == "preview", F.col("_step"))).over(tail)})

    turn = rows.alias("m").join(by_turn.select("_c", "_t", "_fate").alias("t"), F.col("conv_id").eqNullSafe(F.col("t._c")) & (F.col("turn_no") == F.col("t._t")), "left")
    both = turn.join(split.select("_c", "_t", "_s", "_step_fate", "_room", "_wanted").alias("s"), F.col("conv_id").eqNullSafe(F.col("s._c")) & (F.col("turn_no") == F.col("s._t")) & (F.col("step_no") == F.col("s._s")) & ~F.col("anchor"), "left")
    share = F.floor(F.col("tokens") * F.col("_room") / F.greatest("_wanted", F.lit(1))).cast("long")
    place = lambda where, checkpoint=False, preview=None: F.struct(F.lit(where).alias("place"), F.lit(checkpoint).alias("checkpoint"), (F.lit(None).cast("long") if preview is None else preview).alias("preview_tokens"))
    places = (
        F.when(F.coalesce("_fate", F.lit("archive")) == "archive", F.array(place("archive"))).when(F.col("_fate") == "keep", F.array(place("keep"))).when(F.col("anchor"), F.array(place("archive"), place("keep")))
        .when(F.col("_step_fate") == "keep", F.array(place("keep"))).when(F.col("_step_fate") == "archive", F.array(place("archive", True))).otherwise(F.array(place("archive", True), place("keep", False, share)))
    )
    out = both.select(*(f"m.{c}" for c in messages.columns), F.explode(places).alias("_p")).select(*messages.columns, "_p.*")
    if "text" not in messages.columns:
        return out
    return out.withColumn("text", F.when(F.col("preview_tokens").isNotNull(), truncate_to_tokens(F.col("text"), F.col("preview_tokens"))).otherwise(F.col("text")))


def active_tokens(plan: DataFrame) -> DataFrame:
    """(conv_id, tokens) of what a plan keeps, previews by their texts."""
    kept = plan.where("place = 'keep'")
    tokens = F.when(F.col("preview_tokens").isNotNull(), token_estimate(F.col("text"))).otherwise(F.col("tokens"))
    return kept.groupBy("conv_id").agg(F.sum(tokens).alias("tokens"))
