"""Chat formatting in windows of a token budget. DataFrame functions only.

A turn is written `<turn role>text</turn>` and a line break; one that only repeats context is
written `<past role>text</turn>`. Inside roles and texts a backslash becomes `\\b`, `<` becomes `\\l`
and `>` becomes `\\g`, so no text can hold a control string and every text is got back exactly.

Prefix sums of the turns' tokens cut a conversation into windows of whole turns. Each window
starts with the system turn, then repeats the last turns before it up to `history` tokens, then
has its own turns. The loss mask covers texts of the assistant among its own turns: repeated ones
are context, so each target is learned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabassay.llm.common import let, prefix_sums

#: Tokens that the marks of a turn count.
MARKS = 4


def escaped(text: Column) -> Column:
    for raw, safe in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for raw, safe in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def formatted(turns: DataFrame, budget: int = 512, history: int = 96) -> DataFrame:
    """One row per window: conv_id, window (from 0), n_turns, n_tokens, text, loss (array of start, length).

    `turns`: conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn, then role, then
    text; a null role or text is empty, rows with a null conv_id form one conversation, repeated rows
    are turns of their own, an empty table has no windows. Tokens are words and single signs, plus
    MARKS a turn. A window has at most `budget` tokens, unless its system turn or a turn of its
    own is longer than there is room for: such a turn is never cut and stands in a window alone.
    Offsets of `loss` are code points of `text`.

    Sorting a conversation's turns streams through one task and may spill; nothing holds a
    whole conversation. A window holds at most `budget / MARKS` turns.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    tokens = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long") + MARKS
    df = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), tokens.alias("tokens"))
    conversation = Window.partitionBy("conv_id")
    order = conversation.orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    df = df.select("*", F.row_number().over(order).alias("at"))
    # The system turn counts if it opens the conversation, as it then stands before all windows.
    opens = (F.col("at") == 1) & (F.col("role") == "system")
    df = df.select("*", opens.alias("opens"), F.sum(F.when(opens, F.col("tokens"))).over(so_far).alias("system_tokens"))
    df = df.withColumn("end", F.sum(F.when(opens, 0).otherwise(F.col("tokens"))).over(so_far))
    df = df.withColumn("start", F.col("end") - F.when(F.col("opens"), 0).otherwise(F.col("tokens")))
    # Turns that start in one cell of half the room fit together, unless one is longer than a cell.
    room = F.greatest(F.lit(budget) - F.coalesce("system_tokens", F.lit(0)) - history, F.lit(2 * MARKS))
    cell = F.floor(room / 2)
    df = df.select(
        "*", F.floor(F.col("start") / cell).alias("cell"), (~F.col("opens") & (F.col("tokens") > cell)).alias("alone")
    )
    before = lambda c: F.lag(c).over(order)
    breaks = F.coalesce(
        ~before("opens") & ((F.col("cell") != before("cell")) | F.col("alone") | before("alone")), F.lit(False)
    )
    df = df.withColumn("breaks", breaks.cast("int")).withColumn("window", F.sum("breaks").over(so_far))
    system = F.first(F.when(F.col("opens"), F.col("text"))).over(so_far)
    first = F.row_number().over(Window.partitionBy("conv_id", "window").orderBy("at")) == 1
    df = df.withColumn("system", F.when(first & (F.col("window") > 0), system))
    # A turn is repeated in the next window if it starts at most `history` tokens before that begins.
    window_end = F.max("end").over(Window.partitionBy("conv_id", "window"))
    last = F.max("window").over(conversation)
    again = ~F.col("opens") & (window_end - F.col("start") <= history)
    df = df.withColumn("again", again & (F.col("window") < last))
    copies = F.when(F.col("again"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    df = df.select("conv_id", "window", "at", "role", "text", "tokens", "system", "system_tokens", F.explode(copies).alias("late"))
    own = F.struct(
        F.col("at"), F.col("late").alias("past"), F.col("role"), F.col("text"), F.col("tokens"),
    )
    windows = df.groupBy("conv_id", (F.col("window") + F.col("late")).alias("window")).agg(
        F.sort_array(F.collect_list(own)).alias("turns"), F.max("system").alias("system"), F.max("system_tokens").alias("system_tokens")
    )
    opening = F.struct(
        F.lit(0).alias("at"), F.lit(1).alias("past"), F.lit("system").alias("role"), F.col("system").alias("text"), F.col("system_tokens").alias("tokens")
    )
    every = F.when(F.col("system").isNotNull(), F.concat(F.array(opening), F.col("turns"))).otherwise(F.col("turns"))
    windows = windows.select("conv_id", "window", every.alias("turns"))
    return _written(windows)


def _written(windows: DataFrame) -> DataFrame:
    head = lambda t: F.concat(F.when(t["past"] == 1, "<past ").otherwise("<turn "), escaped(t["role"]), F.lit(">"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            head(t).alias("head"), escaped(t["text"]).alias("body"), ((t["past"] == 0) & (t["role"] == "assistant")).alias("loss")
        ),
    )
    sizes = F.transform("parts", lambda p: (F.char_length(p["head"]) + F.char_length(p["body"]) + F.char_length(F.lit(END))).cast("long"))

    def spans(starts: Column) -> Column:
        every = F.transform(
            "parts",
            lambda p, i: F.struct(
                (F.get(starts, i) + F.char_length(p["head"])).alias("start"), F.char_length(p["body"]).cast("long").alias("length"), p["loss"].alias("loss")
            ),
        )
        return F.transform(
            F.filter(every, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))
        )

    return windows.select("*", parts.alias("parts")).select(
        "conv_id",
        F.col("window").cast("long").alias("window"),
        F.size(F.filter("turns", lambda t: t["past"] == 0)).cast("long").alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("text"),
        let(let(sizes, lambda s: prefix_sums(s)), spans).alias("loss"),
    )


END = "</turn>\n"


def turns_read(text: Column) -> Column:
    """The turns that a window's text holds: array of past (boolean), role, text."""
    parts = F.slice(F.split(text, END), F.lit(1), F.size(F.split(text, END)) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            p.startswith("<past ").alias("past"),
            unescaped(F.substr(F.substring_index(p, ">", 1), F.lit(7))).alias("role"),
            unescaped(F.substr(p, F.instr(p, ">") + 1)).alias("text"),
        ),
    )


def loss_read(text: Column, loss: Column) -> Column:
    """All text under a window's loss mask, unescaped."""
    return F.array_join(
        F.transform(loss, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted windows alone.

    A digest needs its whole text in one row, so this report holds a conversation per row; `formatted` does not.
    """
    own = F.filter(turns_read(F.col("text")), lambda t: ~t["past"])
    df = windows.select(
        "conv_id",
        F.struct(
            F.col("window"),
            F.size(own).cast("long").alias("n"),
            F.array_join(F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            loss_read(F.col("text"), F.col("loss")).alias("loss"),
            F.char_length("text").cast("long").alias("chars"),
        ).alias("w"),
    )
    df = df.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    total = lambda field: F.aggregate(F.col(f"w.{field}"), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.select(
        "conv_id", total("n").alias("n_turns"), F.array_join("w.turns", "").alias("turns"), F.array_join("w.loss", "").alias("loss"),
        total("chars").alias("formatted_chars"), F.size("w").cast("long").alias("n_windows"),
    )
    return df.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
