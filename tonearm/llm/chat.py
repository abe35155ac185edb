"""Chat formatting in budgeted windows.

Prefix sums of the turns' token counts cut a conversation into windows of whole turns: with S tokens left by the
budget after the system turn and the history, the turns that end within the same stretch of S tokens share a window,
and a turn that crosses from one stretch to the next has a window of its own. So no window holds more than S new
tokens, but for a turn that is longer itself; turns are never cut. Every later window begins with the conversation's
first system turn, wherever that stood, and with up to HISTORY_TURNS turns before it, of HISTORY tokens at most. The loss mask covers each assistant text once,
where it is new; repeated ones are masked.

A turn is written as `<|role|>`, a line end, the text, `</s>`, a line end. Backslashes in roles and texts are doubled
and control strings get one inside, so texts hold no control string, and `unescape` gives the text back.

Cases: null texts and roles count as empty; turns of equal number are ordered by role and text, repeated rows are
turns of their own; rows with a null conversation id form one conversation, null turn numbers come first; an empty
table gives an empty table; other columns, whatever their names, are left out. A conversation is one task's sort, as
its turns follow one another; a turn of any length is a window of its own where it must be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.functions.frames import together
from tonearm.llm.common import table

BUDGET, HISTORY, HISTORY_TURNS, OVERHEAD = 2048, 512, 2, 4
TARGET = "assistant"
#: What counts as a token: a word, a number of up to three digits, or another sign.
TOKEN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]"
END = "</s>"
#: How control strings of chat templates begin.
CONTROL = r"<(?=\||/?s>)|\[(?=/?INST\])|<(?=</?SYS>>)"
TURN = r"(?s)^<\|((?:[^\\|]++|\\.)*+)\|>\n(.*)$"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$0\\")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), r"[|<\[]", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """turns (conv_id, turn, role, text) to (conv_id, window, text, loss, n_repeated, n_tokens).

    loss: array of (start, end) in the text; n_repeated: turns at the beginning that earlier windows had as new.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    clean = clean.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)).cast("long") + OVERHEAD)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = F.struct("place", "start", "role", "text")
    placed = clean.select("*", F.row_number().over(order).alias("place"), F.sum("tokens").over(so_far).alias("end"))
    placed = placed.select("*", (F.col("end") - F.col("tokens")).alias("start"))
    first = F.first(F.when(F.col("role") == "system", F.struct("place", "start", "role", "text", "tokens")), ignorenulls=True).over(so_far)
    placed = placed.select("*", first.alias("system"), F.collect_list(turn).over(order.rowsBetween(-HISTORY_TURNS, -1)).alias("before"))
    room = F.greatest(F.lit(1), budget - history - F.coalesce(F.col("system.tokens"), F.lit(0)))
    stretch = F.floor((F.col("end") - 1) / room).cast("long")
    alone = stretch != F.floor(F.col("start") / room).cast("long")
    cut = placed.select("*", (2 * stretch + F.when(alone, 0).otherwise(1)).alias("window"))
    opens = F.coalesce(F.lag("window").over(order) != F.col("window"), F.lit(True))
    recent = F.filter("before", lambda t: (F.col("start") - t["start"] <= history) & (F.col("system").isNull() | (t["place"] != F.col("system.place"))))
    kept = F.when(F.col("system").isNotNull() & (F.col("place") > F.col("system.place")), F.array(F.struct("system.place", "system.start", "system.role", "system.text"))).otherwise(F.array().cast("array<struct<place:int,start:long,role:string,text:string>>"))
    cut = cut.select("conv_id", "window", "tokens", turn.alias("new"), F.when(opens, F.concat(kept, recent)).alias("head"))
    # A window is no longer than the budget or one turn, so its turns fit a task.
    held = cut.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("new")).alias("new"), F.first("head", ignorenulls=True).alias("head"), F.sum("tokens").alias("n_tokens"))
    part = lambda fresh: lambda t: F.struct(
        F.concat(F.lit("<|"), escape_role(t["role"]), F.lit("|>\n")).alias("header"), escape(t["text"]).alias("body"), ((t["role"] == TARGET) & F.lit(fresh)).alias("target")
    )
    held = held.select("conv_id", "window", "n_tokens", F.size("head").alias("n_repeated"), F.concat(F.transform("head", part(False)), F.transform("new", part(True))).alias("parts"))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["header"]) + F.length(p["body"]) + len(END) + 1).alias("at"),
        F.when(p["target"], F.concat(acc["loss"], F.array(F.struct((acc["at"] + F.length(p["header"])).alias("start"), (acc["at"] + F.length(p["header"]) + F.length(p["body"])).alias("end"))))).otherwise(acc["loss"]).alias("loss"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("loss"))
    written = F.array_join(F.transform("parts", lambda p: F.concat(p["header"], p["body"], F.lit(END + "\n"))), "")
    return held.select("conv_id", "window", written.alias("text"), F.aggregate("parts", zero, step, lambda acc: acc["loss"]).alias("loss"), "n_repeated", "n_tokens")


def read_back(formatted: DataFrame) -> DataFrame:
    """What windows() wrote to (conv_id, window, new, lost): new turns (role, text) and the texts under the mask, unescaped."""
    pieces = F.split("text", END + "\n", -1)
    new = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_repeated"), F.lit(0)))
    turn = lambda p: F.struct(unescape(F.regexp_extract(p, TURN, 1)).alias("role"), unescape(F.regexp_extract(p, TURN, 2)).alias("text"))
    lost = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "window", F.transform(new, turn).alias("new"), lost.alias("lost"), F.length("text").alias("chars"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds control strings, formatted and read back."""
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), F.lit(tricky).alias("text"))
    turns = together(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), extra)
    back = read_back(windows(turns))
    written = F.array_join(F.transform("new", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = back.select("conv_id", F.struct("window", written.alias("turns"), F.array_join("lost", "").alias("lost")).alias("part"), F.size("new").alias("n"), "chars")
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.count("*").alias("n_windows"))
    whole = whole.select("*", F.array_join(F.transform("parts", lambda p: p["turns"]), "").alias("turns"), F.array_join(F.transform("parts", lambda p: p["lost"]), "").alias("lost"))
    return whole.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars", "n_windows")
