"""Conversations as training windows of a limited number of tokens, in built-in expressions only.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside texts a backslash is put
after every ``<`` that backslashes (or none) and ``|`` follow, so no control string can
occur there and taking one backslash away restores the text. Roles write ``%``, ``<`` and line
breaks as ``%25``, ``%3C`` and ``%0A``.

A leading system turn is repeated in every window. Prefix sums of the turns' tokens choose
the spans: a window takes new turns while system turn, repeated history and new turns fit
the budget, and at least one. Before its first new turn it repeats the turns of the last
``history`` tokens, if they fit together with that turn. Only assistant texts among
the new turns are targets, so each is a target once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 256
HISTORY = 64
OVERHEAD = 4  # tokens of a turn besides the words of its text

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(
        F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A")
    )


def _unescape_role(role: Column) -> Column:
    return F.replace(
        F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%")
    )


def chat_windows(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """Rows ``conv_id, window, n_repeated, n_new, tokens, formatted, loss``.

    Turns go by number, then role, then text (null turns first); repeated rows are turns of
    their own. Null roles and texts are empty; a null id is a conversation like any other.
    Tokens are words plus ``OVERHEAD``. ``n_repeated`` leading turns were in an earlier
    window; ``loss`` holds the start and end (code points, end exclusive) of the targets. A single
    turn over the budget has a window of its own and is not cut.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + OVERHEAD).cast("long"))

    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.row_number().over(in_order)).withColumn("upto", F.sum("tokens").over(upto))
    turn = F.struct("at", "upto", "tokens", "role", "text")
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    # The leading system turn, and the rest.
    leads = F.col("turns")[0]["role"] == "system"
    talks = talks.withColumn("system", F.when(leads, F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0)))
    talks = talks.withColumn("lead", F.when(leads, F.col("turns")[0]["tokens"]).otherwise(F.lit(0).cast("long")))
    talks = talks.withColumn(
        "body", F.when(leads, F.slice("turns", 2, F.size("turns"))).otherwise(F.col("turns"))
    )

    # One pass over the turns of a conversation. ``early`` is the first turn that still lies within
    # the last ``history`` tokens before the turn at hand; it only moves forward.
    empty = F.expr("cast(array() as array<struct<early: int, first: int, last: int>>)")
    begin = F.struct(
        F.lit(1).alias("early"),
        F.lit(1).alias("first"),
        F.lit(1).alias("from"),
        F.lit(0).alias("i"),
        empty.alias("spans"),
    )
    body = F.col("body")

    def before(i: Column) -> Column:
        """Tokens before the i-th turn of the body (counted from one)."""
        turn = F.element_at(body, i)
        return turn["upto"] - turn["tokens"]

    def step(state: Column, turn: Column) -> Column:
        i = state["i"] + 1
        start = turn["upto"] - turn["tokens"]
        steps = F.sequence(state["early"], i)
        inside = F.filter(steps, lambda k: start - before(k) <= history)
        early = F.element_at(inside, 1)
        full = (i > state["first"]) & (F.col("lead") + turn["upto"] - before(state["from"]) > budget)
        fits = F.col("lead") + turn["upto"] - before(early) <= budget
        span = F.struct(state["from"].alias("early"), state["first"].alias("first"), (i - 1).alias("last"))
        return F.struct(
            early.alias("early"),
            F.when(full, i).otherwise(state["first"]).alias("first"),
            F.when(full & fits, early).when(full, i).otherwise(state["from"]).alias("from"),
            i.alias("i"),
            F.when(full, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    def finish(state: Column) -> Column:
        span = F.struct(state["from"].alias("early"), state["first"].alias("first"), state["i"].alias("last"))
        return F.concat(state["spans"], F.array(span))

    talks = talks.withColumn("spans", F.aggregate("body", begin, step, finish))
    windows = talks.select("conv_id", "system", "lead", "body", F.posexplode("spans").alias("window", "span"))

    span = F.col("span")
    repeated = F.slice("body", span["early"], span["first"] - span["early"])
    new = F.slice("body", span["first"], span["last"] - span["first"] + 1)
    n_repeated = F.size(repeated) + F.when(F.col("window") > 0, F.size("system")).otherwise(0)

    def written(turn: Column, target: Column) -> Column:
        head = F.concat(F.lit(START), _escape_role(turn["role"]), F.lit("\n"))
        return F.struct(
            head.alias("head"),
            escape(turn["text"]).alias("text"),
            (target & (turn["role"] == "assistant")).alias("target"),
            turn["tokens"].alias("tokens"),
        )

    parts = F.concat(
        F.transform("system", lambda t: written(t, F.lit(False))),
        F.transform(repeated, lambda t: written(t, F.lit(False))),
        F.transform(new, lambda t: written(t, F.lit(True))),
    )
    windows = windows.select("conv_id", "window", n_repeated.alias("n_repeated"), F.size(new).alias("n_new"), parts.alias("parts"))

    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")

    def place(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["head"])
        end = start + F.length(part["text"])
        here = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + len(END)).alias("at"),
            F.when(part["target"], F.concat(state["loss"], here)).otherwise(state["loss"]).alias("loss"),
        )

    text = F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(END)))
    return windows.select(
        "conv_id",
        "window",
        "n_repeated",
        "n_new",
        F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["tokens"]).alias("tokens"),
        F.array_join(text, "").alias("formatted"),
        F.aggregate(
            "parts", F.struct(F.lit(0).alias("at"), none.alias("loss")), place, lambda s: s["loss"]
        ).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turns, targets, formatted_chars``, all taken from the formatted texts.

    ``turns`` are (role, text) in order, each once; ``targets`` is the unmasked text, end to end.
    """
    pieces = F.split("formatted", r"<\|im_start\|>")
    pieces = F.slice(pieces, F.col("n_repeated") + 2, F.size(pieces))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = F.substr(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    targets = F.transform(
        "loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    )
    read = windows.select(
        "conv_id",
        F.struct(
            "window", F.transform(pieces, turn).alias("turns"), F.array_join(targets, "").alias("targets")
        ).alias("part"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars")
    )
    return whole.select(
        "conv_id",
        F.flatten(F.transform("parts", lambda p: p["turns"])).alias("turns"),
        F.array_join(F.transform("parts", lambda p: p["targets"]), "").alias("targets"),
        "formatted_chars",
    )
