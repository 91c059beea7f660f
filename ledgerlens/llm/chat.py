"""Chat formatting in budgeted windows, with DataFrame functions only.

Every turn becomes ``<|turn|>role<|text|>text<|end|>`` and a line feed. Texts and roles are
escaped first: a backslash becomes ``\\b`` and ``<`` becomes ``\\l``, so no text can hold a
control string, and reading back restores it exactly.

A conversation longer than the budget is cut into windows along its turns. The room of a
window is the budget less the history and the opening system turn; the prefix sum of
tokens before a turn, divided by the room, is the turn's span. Turns that end in the span
they start in share a window, whose own tokens cannot pass the room; a turn that crosses
the end of its span has a window of its own. Each window repeats the system turn that opens
the conversation and as much of the turns before it as history and budget allow. Only the
assistant texts of a window's own turns are targets; repeated ones are masked, so each is
learned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the control strings of the template
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def turn_tokens(role: Column, text: Column) -> Column:
    """Tokens of a turn as the budget counts them: the UTF-8 bytes of the escaped role and
    text, and four for the control strings and the line feed. A byte-level vocabulary that
    holds the control strings never makes more tokens than that."""
    return (F.octet_length(escaped(role)) + F.octet_length(escaped(text)) + 4).cast("long")


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *, budget: int = 3072, history: int = 768) -> DataFrame:
    """One row per window: conv_id, window (increasing, with gaps), first_turn and last_turn
    (positions from 0), n_repeated (leading turns that repeat earlier ones), n_turns,
    n_tokens (turn_tokens of all its turns), formatted, and loss_spans (start from 0 and
    length, in code points of formatted).

    n_tokens is at most ``budget``, or the window is one turn that is longer, alone. Repeated
    turns have at most ``history`` tokens besides the system turn, which is repeated wherever
    the own turns leave room for it. Null texts and roles count as empty. Turns of equal
    number are ordered by role and text; equal rows stay. A null conv_id is a conversation
    like another. Other columns do not matter; an empty table has no windows. Turns stay rows
    until the turns of a window are brought together.
    """
    if not 0 <= history < budget:
        raise ValueError("0 <= history < budget is needed")
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("o"),
    )
    order = Window.partitionBy("conv_id").orderBy("o")
    w = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size_of = lambda o: turn_tokens(o["role"], o["text"])
    rows = rows.withColumn("tokens", size_of(F.col("o")))
    rows = rows.withColumns({"pos": F.row_number().over(order) - 1, "before": F.sum("tokens").over(w) - F.col("tokens"), "opening": F.first("o").over(w)})
    opens = F.col("opening.role") == "system"
    room = F.greatest(F.lit(1), budget - history - F.when(opens, size_of(F.col("opening"))).otherwise(0))
    span = F.floor(F.col("before") / room)
    crosses = F.floor((F.col("before") + F.col("tokens") - 1) / room) > span
    rows = rows.withColumn("number", 2 * span + crosses.cast("int"))
    # the windows that begin within reach of a turn
    rows = rows.withColumn("near", F.collect_set("number").over(Window.partitionBy("conv_id").orderBy("before").rangeBetween(0, history)))
    is_first = (F.col("pos") > 0) & (F.col("number") != F.lag("number").over(order))
    # the system turn goes with the first turn of each later window
    rows = rows.withColumn("opening", F.when(is_first & opens, F.col("opening")))
    rows = rows.withColumn("system", (F.col("pos") == 0) & (F.col("o.role") == "system"))
    # a turn goes to its own window and to the few after it that begin within its history
    place = lambda number, kind: F.struct(number.alias("number"), F.lit(kind).alias("kind"))
    places = F.concat(
        F.array(place(F.col("number"), "own")),
        F.when(~F.col("system"), F.transform(F.filter("near", lambda n: n > F.col("number")), lambda n: place(n, "back"))).otherwise(F.array()),
        F.when(F.col("opening").isNotNull(), F.array(place(F.col("number"), "system"))).otherwise(F.array()),
    )
    rows = rows.withColumn("place", F.explode(places))
    again = F.col("place.kind") == "system"
    o = F.when(again, F.col("opening")).otherwise(F.col("o"))
    head = F.concat(F.lit(TURN), escaped(o["role"]), F.lit(TEXT))
    rows = rows.select(
        "conv_id",
        F.col("place.number").alias("number"),
        F.struct(
            F.when(again, 0).otherwise(F.col("pos")).alias("pos"),
            (again | F.col("system")).alias("system"),
            (F.col("place.kind") == "own").alias("own"),
            (o["role"] == "assistant").alias("target"),
            "before",
            size_of(o).alias("tokens"),
            F.length(head).alias("skip"),
            F.length(escaped(o["text"])).alias("size"),
            F.concat(head, escaped(o["text"]), F.lit(END)).alias("line"),
        ).alias("t"),
    )
    # dealt by conv_id already: no further exchange
    cut = rows.groupBy("conv_id", "number").agg(F.array_sort(F.collect_list("t")).alias("all"))
    cut = cut.withColumn("own", F.filter("all", lambda t: t["own"])).where(F.size("own") > 0).withColumn("first", F.col("own")[0])
    # what the own turns leave is for the system turn first, then for the turns before them
    sum_of = lambda turns: F.aggregate(turns, F.lit(0).cast("long"), lambda n, t: n + t["tokens"])
    cut = cut.withColumn("left", budget - sum_of("own") - sum_of(F.filter("all", lambda t: ~t["own"] & t["system"])))
    reach = F.least(F.lit(history).cast("long"), F.col("left"))
    back = F.filter("all", lambda t: ~t["own"] & (F.col("left") >= 0) & (t["system"] | (t["before"] >= F.col("first")["before"] - reach)))
    cut = cut.withColumn("back", back).withColumn("shown", F.concat("back", "own"))
    spans = F.aggregate(
        "shown",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["line"])).alias("at"),
            F.when(t["target"] & (t["pos"] >= F.col("first")["pos"]), F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["skip"]).alias("start"), t["size"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return cut.select(
        "conv_id",
        F.col("number").alias("window"),
        F.col("first")["pos"].alias("first_turn"),
        F.element_at("own", -1)["pos"].alias("last_turn"),
        F.size("back").alias("n_repeated"),
        F.size("shown").alias("n_turns"),
        sum_of("shown").alias("n_tokens"),
        F.array_join(F.transform("shown", lambda t: t["line"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the windows alone: turns (role and text of every
    turn, once, in order), loss_text (all text under the loss mask, unescaped) and
    formatted_chars (code points of all windows)."""
    lines = F.slice(F.split("formatted", "<\\|end\\|>\n"), F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    turn = lambda x: F.struct(
        unescaped(F.substring_index(F.substr(x, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
        unescaped(F.substring_index(x, TEXT, -1)).alias("text"),
    )
    masked = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    rows = formatted.select("conv_id", F.struct("window", F.transform(lines, turn).alias("turns"), masked.alias("loss"), F.length("formatted").alias("chars")).alias("w"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return convs.select(
        "conv_id",
        F.flatten(F.transform("w", lambda w: w["turns"])).alias("turns"),
        F.array_join(F.transform("w", lambda w: w["loss"]), "").alias("loss_text"),
        F.aggregate("w", F.lit(0).cast("long"), lambda s, w: s + w["chars"]).alias("formatted_chars"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: number and digest of its turns, length and digest of what is
    learned, and the length of its windows, all read back from the formatted text."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(whole).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha(F.col("loss_text")).alias("loss_sha256"),
        "formatted_chars",
    )
