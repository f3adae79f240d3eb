"""Preference formatting of chosen and rejected conversations (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import fresh

#: Marks around a turn in the rendering.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
#: Role whose text a model is trained on.
TRAINED = "assistant"


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column) -> Column:
    """Start and end (characters, end exclusive) of each trained text with its closing mark in the rendering of ``turns``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["role"]) + (len(OPEN) + len(MIDDLE))
        end = begin + F.length(t["text"]) + len(CLOSE)
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    return F.aggregate(turns, start, step)["out"]


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns in order as structs (role, text).

    Null roles become ``user`` and null texts empty; rows repeated in every
    part count once; distinct rows of one turn follow each other by role and
    text, and null turns come first. Rows without an id belong to no
    conversation and go.
    """
    one = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_set(one)).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Columns ``n_prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans`` added to ``pairs(chosen_turns, rejected_turns)``.

    The longest common prefix of turns (equal role and text) is rendered once,
    as the prompt; what is left of each side is its completion, with the spans
    that training keeps. Null sides count as no turns. Where one side is a
    prefix of the other its completion is empty. Other columns stay as they are,
    but for those of the results' names, which are replaced.
    """
    empty = F.array().cast(pairs.schema["chosen_turns"].dataType)
    a, b = F.coalesce("chosen_turns", empty), F.coalesce("rejected_turns", empty)
    differs = F.filter(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z, i: F.when(~z["a"].eqNullSafe(z["b"]), i)), lambda i: i.isNotNull())
    out = pairs.withColumn("n_prompt_turns", F.coalesce(F.get(differs, 0), F.size(a)).cast("long"))
    n = F.col("n_prompt_turns").cast("int")
    rest = lambda x: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    p, c, r = fresh(out, "p", "c", "r")
    out = out.withColumns({p: F.slice(a, 1, n), c: rest(a), r: rest(b)})
    made = {"prompt": _rendered(F.col(p)), "chosen": _rendered(F.col(c)), "chosen_spans": _spans(F.col(c)), "rejected": _rendered(F.col(r)), "rejected_spans": _spans(F.col(r))}
    return out.withColumns(made).drop(p, c, r, "chosen_turns", "rejected_turns")


def reply_pairs(turns: DataFrame) -> DataFrame:
    """``(pair_id, chosen_turns, rejected_turns)``: each conversation against itself with its last reply taken from its neighbour.

    Conversations 2k and 2k+1 are neighbours. The rejected side ends where the
    chosen side's last trained turn stood, with the neighbour's last trained
    text instead. Conversations without a trained turn, without such a
    neighbour, or with an equal reply express no preference and give no row.
    One shuffle brings both neighbours together.
    """
    convs = conversations(turns)
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i)))
    convs = convs.withColumn("last", last).withColumn("reply", F.get("turns", F.col("last"))["text"])
    both = convs.groupBy(F.shiftright("conv_id", 1).alias("half")).agg(F.collect_list(F.struct("conv_id", "turns", "last", "reply")).alias("c"))
    each = both.where(F.size("c") == 2).select(F.posexplode("c").alias("at", "own"), F.col("c")).withColumn("other", F.get("c", 1 - F.col("at"))["reply"])
    each = each.where("own.reply is not null and other is not null and own.reply <> other")
    swapped = F.struct(F.lit(TRAINED).alias("role"), F.col("other").alias("text"))
    return each.select(
        F.col("own.conv_id").alias("pair_id"), F.slice("own.turns", 1, F.col("own.last") + 1).alias("chosen_turns"), F.concat(F.slice("own.turns", 1, F.col("own.last")), F.array(swapped)).alias("rejected_turns")
    )
