"""Preference pairs: one prompt, two completions, and the characters a loss counts.

Native: only DataFrame functions. The turns of a conversation become one array; the prompt is the
longest run of turns with which both arrays begin, compared turn by turn inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How a turn is written: role, then text.
HEAD, MIDDLE, TAIL = "<|", "|>\n", "\n<|end|>\n"
#: The role whose words in a completion are learned.
LEARNED = "assistant"


def head(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(MIDDLE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(TAIL))), "")


def learned_spans(turns: Column, ends: Column) -> Column:
    """(start, end) of what is learned of each assistant turn, from its text to the end of its tail.

    ``ends`` are where the turns end, counted in characters from the begin of the prompt.
    """
    spans = F.zip_with(turns, ends, lambda t, e: F.struct((t["role"] == LEARNED).alias("learned"), (e - F.length(t["text"]) - len(TAIL)).alias("start"), e.alias("end")))
    return F.transform(F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["start"], s["end"]))


def conversations(turns: DataFrame, pair: Column, side: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """(pair_id, side, turns, ends): the turns of each conversation in order, repeated rows once, and where each ends.

    The ends are running sums over the sorted rows, before these become an array.
    """
    rows = turns.select(pair.alias("pair_id"), side.alias("side"), turn.alias("turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    length = F.length(head(F.struct("role"))) + F.length("text") + len(TAIL)
    upto = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.filter("pair_id IS NOT NULL AND side IS NOT NULL").distinct().withColumn("end", F.sum(length.cast("long")).over(upto))
    found = rows.groupBy("pair_id", "side").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "end"))).alias("t"))
    return found.select("pair_id", "side", F.transform("t", lambda t: F.struct(t["role"], t["text"])).alias("turns"), F.transform("t", lambda t: t["end"]).alias("ends"))


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans).

    ``turns`` has a row per turn; ``pair`` tells which conversations are compared and ``chosen``
    which of the two the row belongs to. Turns are ordered by ``turn`` (null first), then role and
    text; rows repeated in all of these count once. Null roles and texts are empty ones. A pair of
    which one side is missing has no prompt, and an empty text and no spans on that side. Two equal
    conversations are all prompt. Rows whose pair or side is null are in no pair. An empty table
    gives an empty result.
    """
    sides = conversations(turns, pair, chosen, turn, role, text)
    of = {"c": F.col("side"), "r": ~F.col("side")}
    both = sides.groupBy("pair_id").agg(*[F.max(F.when(side, F.struct("turns", "ends"))).alias(c) for c, side in of.items()])
    none = F.array().cast(sides.schema["turns"].dataType)
    ends = [F.coalesce(F.col(f"{c}.ends"), F.array().cast("array<long>")).alias(f"{c}_ends") for c in of]
    both = both.select("pair_id", *ends, *[F.coalesce(F.col(f"{c}.turns"), none).alias(c) for c in of])
    differs = F.array_position(F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b)), False)
    both = both.withColumn("n", F.when(differs == 0, F.size("c").cast("long")).otherwise(differs - 1).cast("int"))
    rest = lambda name: F.slice(name, F.col("n") + 1, F.size(name))
    both = both.select("pair_id", "n", rendered(F.slice("c", 1, F.col("n"))).alias("prompt"), *[rest(c).alias(c) for c in ("c", "r", "c_ends", "r_ends")])
    return both.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        "prompt",
        rendered(F.col("c")).alias("chosen"),
        rendered(F.col("r")).alias("rejected"),
        learned_spans(F.col("c"), F.col("c_ends")).alias("chosen_spans"),
        learned_spans(F.col("r"), F.col("r_ends")).alias("rejected_spans"),
    )


def spans_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
