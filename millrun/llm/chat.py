"""Chat formatting in budgeted windows (operator 10), with DataFrame functions only.

A conversation's turns are numbered and given prefix sums of their tokens. The
sums are cut into cells of half the budget that the system turn leaves; the
turns that start in a cell are one window, so windows are aligned to turns and
none exceeds the budget, except one that holds a single longer turn (a turn over
half the budget always is a window of its own and is never cut). A window
repeats the conversation's first system turn and, as far as ``history`` tokens
and its budget allow, the turns just before it. Repeated turns are masked: only
the assistant texts of a window's own turns count for the loss.

Template: ``<turn ROLE>TEXT</turn>`` and a line end per turn. In texts ``\\`` is
written ``\\b`` and ``<`` is written ``\\l`` (in roles also ``>`` as ``\\g``), so
control strings inside texts can't be taken for marks and every text can be read
back exactly.

Turns are numbered and their prefix sums made over ranges of turns, in two steps (within
a range, then over ranges), so a hot conversation is not one task, whatever its turn
numbers. Only ``digest`` needs a whole conversation in one row, since its hashes run
over all turns.

Defined cases: null texts and roles are empty; a null conversation id is a
conversation of its own; turns with a null number come first; equal turn numbers
are ordered by role, then text; repeated rows are repeated turns; an empty table
gives no window; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrun.llm.common import numbered_cells

#: A run of letters, digits and underscores, or any other visible character, is a token.
TOKEN = r"[\p{L}\p{N}_]+|[^\s]"
_END = "</turn>\n"
_FIRST = -(2 ** 62)


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(">"), F.lit("\\g")) if role else out


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def _turns(conversations: DataFrame, tokens: str | None, marks: int) -> DataFrame:
    """Turns with ``seq`` (from 1), ``tokens`` and ``before``, the tokens of the turns before."""
    size = F.regexp_count("text", F.lit(TOKEN)) if tokens is None else F.coalesce("given", F.lit(0))
    t = conversations.select(
        F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("c_null"),
        F.coalesce(F.col("turn").cast("long"), F.lit(_FIRST)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        *([F.col(tokens).cast("long").alias("given")] if tokens else []))
    t = t.withColumn("tokens", size.cast("long") + F.lit(marks))
    # prefix sums within the cells of a conversation, and over its cells
    conv = ["c", "c_null"]
    t, cells = numbered_cells(t, conv, ["turn", "role", "text"])
    own = Window.partitionBy("_part", *conv).orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("before", F.sum("tokens").over(own) - F.col("tokens"))
    sums = t.groupBy("_part", *conv).agg(F.sum("tokens").alias("all_tokens"))
    earlier = Window.partitionBy(*conv).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(sums, ["_part", *conv]).select(
        "_part", *conv, "_before", F.coalesce(F.sum("all_tokens").over(earlier), F.lit(0)).alias("t0"))
    return t.join(cells, ["_part", *conv]).select(
        *conv, "role", "text", "tokens", (F.col("_nth") + F.col("_before")).alias("seq"),
        (F.col("before") + F.col("t0")).alias("before"))


def formatted(conversations: DataFrame, budget: int = 1024, history: int = 256, tokens: str | None = None,
              marks: int = 0) -> DataFrame:
    """``conv_id, window, n_context, text, loss, tokens``, one row per window.

    ``tokens`` names a column with each turn's tokens, as a tokenizer counts them (null: none);
    without it words and signs are counted. ``marks`` is what a turn's marks add to that.

    ``loss`` lists ``(start, length)`` in code points of ``text``; the first
    ``n_context`` turns of a window are repeated ones."""
    if budget < 4 or not 0 <= history <= budget // 4:
        raise ValueError("budget must be 4 or more and history at most a quarter of it")
    conv = ["c", "c_null"]
    turns = _turns(conversations, tokens, marks)
    system = (turns.filter("role = 'system'").groupBy(*conv)
              .agg(F.min_by(F.struct("seq", "text", "tokens"), "seq").alias("system")))
    room = F.lit(budget) - F.coalesce("system.tokens", F.lit(0))
    turns = turns.join(system, conv, "left").withColumn(
        "cell", F.greatest(F.lit(2 * history), F.lit(2), room)).withColumn("cell", F.floor(F.col("cell") / 2))
    # window 2g holds the turns that start in cell g; a turn longer than a cell is window 2g + 1
    turns = turns.withColumn("g", F.floor(F.col("before") / F.col("cell"))).withColumn(
        "window", 2 * F.col("g") + F.when(F.col("tokens") > F.col("cell"), 1).otherwise(0))
    windows = turns.groupBy(*conv, "window").agg(
        F.min("before").alias("since"), F.sum("tokens").alias("new_tokens"),
        F.least(F.lit(history), F.greatest(F.lit(0), F.first(room) - F.sum("tokens"))).alias("reach"))
    # a turn may be history for the windows of the next cell, and for a long turn in its own cell
    near = F.col("before") + history >= (F.col("g") + 1) * F.col("cell")
    targets = F.filter(F.array(
        F.struct(F.col("window"), F.lit(True).alias("new")),
        F.struct(F.when(F.col("window") == 2 * F.col("g"), F.col("window") + 1).alias("window"), F.lit(False).alias("new")),
        F.struct(F.when(near, 2 * F.col("g") + 2).alias("window"), F.lit(False).alias("new")),
        F.struct(F.when(near, 2 * F.col("g") + 3).alias("window"), F.lit(False).alias("new"))),
        lambda x: x["window"].isNotNull())
    is_system = F.col("seq").eqNullSafe(F.col("system.seq"))
    dealt = (turns.select(*conv, "system", "role", "text", "tokens", "seq", "before", F.explode(targets).alias("to"))
             .select(*conv, "system", "role", "text", "tokens", "seq", "before", "to.window", "to.new")
             .join(windows, [*conv, "window"])
             .filter(F.col("new") | ~is_system & (F.col("before") < F.col("since"))
                     & (F.col("before") >= F.col("since") - F.col("reach"))))
    whole = dealt.groupBy(*conv, "window").agg(
        F.sort_array(F.collect_list(F.struct("seq", "new", "role", "text", "tokens"))).alias("turns"), F.first("system").alias("system"))
    held = F.exists("turns", lambda t: t["seq"] == F.col("system.seq"))
    lead = F.struct(F.col("system.seq").alias("seq"), F.lit(False).alias("new"), F.lit("system").alias("role"),
                    F.col("system.text").alias("text"), F.col("system.tokens").alias("tokens"))
    whole = whole.withColumn("turns", F.when(F.col("system").isNull() | held, F.col("turns")).otherwise(
        F.concat(F.array(lead), F.col("turns"))))
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit("<turn "), escaped(t["role"], True), F.lit(">")).alias("head"), escaped(t["text"]).alias("body"),
        (t["new"] & (t["role"] == "assistant")).alias("learn")))
    whole = whole.withColumn("parts", parts)
    text = F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(_END))))
    sizes = F.transform("parts", lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + len(_END))
    loss = F.filter(F.transform("parts", lambda p, i: F.struct(
        (F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, x: a + x) + F.char_length(p["head"])).alias("start"),
        F.char_length(p["body"]).alias("length"), p["learn"].alias("learn"))), lambda s: s["learn"])
    return whole.withColumn("sizes", sizes).select(
        F.when(~F.col("c_null"), F.col("c")).alias("conv_id"), "window",
        F.size(F.filter("turns", lambda t: ~t["new"])).alias("n_context"), text.alias("text"),
        F.transform(loss, lambda s: F.struct(s["start"], s["length"])).alias("loss"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("tokens"))


def read_back(windows: DataFrame) -> DataFrame:
    """``conv_id, window, turns, learned``: a window's own turns and the texts under its mask."""
    marked = F.slice(F.split("text", _END), F.col("n_context") + 1,
                     F.size(F.split("text", _END)) - 1 - F.col("n_context"))
    turns = F.transform(marked, lambda s: F.struct(
        unescaped(F.substring(F.substring_index(s, ">", 1), 7, 2 ** 31 - 1)).alias("role"),
        unescaped(F.substr(s, F.instr(s, F.lit(">")) + 1)).alias("text")))
    learned = F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", turns.alias("turns"), learned.alias("learned"),
                          F.char_length("text").cast("long").alias("chars"))


def digest(windows: DataFrame) -> DataFrame:
    """Per conversation, hashes of all turns and of all text under the mask, read back from the output."""
    whole = read_back(windows).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "turns", "learned"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns = F.flatten(F.transform("w", lambda w: w["turns"]))
    lines = F.concat_ws("", F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    learned = F.concat_ws("", F.flatten(F.transform("w", lambda w: w["learned"])))
    return whole.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                        F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
                        "formatted_chars")
