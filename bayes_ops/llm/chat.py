"""Chat formatting by event-sourced reconstruction.

The log is a table of events (conv_id, seq, msg, kind, role, text):

* ``message``     opens message ``msg`` with a role and a text (null: empty);
* ``delta``       appends streamed text to it;
* ``edit``        replaces its text;
* ``regenerate``  empties it (deltas that follow fill it again) and discards
                  the messages that were opened after it up to this event.

Events are sorted by seq within a conversation.  The fold is declarative:
texts before a message's last reset drop out, the rest is concatenated per
message, and a running maximum over the messages finds the discarded ones.
Events of a message that was never opened are ignored.  Ties in seq are
broken by msg, kind and text, so the result is defined.

Template: each turn is ``<|turn|>role<|text|>text<|end|>`` and a line end.  In
roles and texts a backslash is doubled and control strings are broken by
``\\!`` after their first character, which ``unescape`` undoes exactly, so no
text can open or close a turn, or show another template's control string.
Loss spans cover the texts of assistant turns in the formatted string.

Defined results: a null role is empty; an empty conversation gives no row; a
null conv_id is a conversation of its own; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>\n"

# Control strings of this and of common templates (fixed values).
CONTROL = r"<\||\|>|</?s>|\[/?INST\]|<</?SYS>>|<unk>|<pad>|<bos>|<eos>"

EVENTS = "conv_id long, seq long, msg long, kind string, role string, text string"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, rf"(?=(?:{CONTROL}))(.)", r"$1\\!")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|!)", "$1")


def from_turns(turns: DataFrame) -> DataFrame:
    """Events of a table (conv_id, turn, role, text): each row opens a message, in the order of turns."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    seq = F.row_number().over(order).cast("long")
    return turns.select("conv_id", seq.alias("seq"), "role", "text").select(
        "conv_id", "seq", F.col("seq").alias("msg"), F.lit("message").alias("kind"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, place, role, text of the final messages."""
    of_msg = W.partitionBy("conv_id", "msg")
    resets = F.col("kind").isin("message", "edit", "regenerate")
    order = F.struct("seq", "kind")
    e = events.select("conv_id", "seq", "msg", "kind", "role",
                      F.when(F.col("kind") == "regenerate", "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    e = e.withColumns({
        "opened": F.min(F.when(F.col("kind") == "message", F.col("seq"))).over(of_msg),
        "reset": F.max(F.when(resets, order)).over(of_msg)})
    e = e.filter((F.col("seq") >= F.col("opened")) & (order >= F.col("reset")) | (F.col("kind") == "message")
                 | (F.col("kind") == "regenerate")).filter(F.col("opened").isNotNull())
    live = order >= F.col("reset")
    m = e.groupBy("conv_id", "msg").agg(
        F.min("opened").alias("opened"),
        F.min_by("role", F.when(F.col("kind") == "message", F.col("seq"))).alias("role"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(live, F.struct("seq", "kind", "text")))),
                                 lambda x: x["text"]), "").alias("text"))
    before = W.partitionBy("conv_id").orderBy("opened", "msg").rowsBetween(W.unboundedPreceding, -1)
    m = m.withColumn("cut", F.max("again").over(before))
    return m.filter(F.col("cut").isNull() | (F.col("cut") < F.col("opened"))).select(
        "conv_id", F.struct("opened", "msg").alias("place"), F.coalesce("role", F.lit("")).alias("role"), "text")


def render(events: DataFrame) -> DataFrame:
    """conv_id, formatted, turns: array of (start, end, loss_start, loss_end) in code points, loss ones null
    for turns that are not trained on."""
    m = fold(events)
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY))
    m = m.select("conv_id", "place", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    m = m.withColumn("line", F.concat("head", "body", F.lit(CLOSE)))
    run = W.partitionBy("conv_id").orderBy("place")
    m = m.withColumn("end", F.sum(F.length("line").cast("long")).over(run))
    m = m.withColumn("start", F.col("end") - F.length("line"))
    loss = F.col("role") == "assistant"
    span = F.struct(
        "start", "end",
        F.when(loss, F.col("start") + F.length("head")).alias("loss_start"),
        F.when(loss, F.col("end") - len(CLOSE)).alias("loss_end"))
    g = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "line", span.alias("span")))).alias("t"))
    return g.select("conv_id", F.array_join(F.transform("t", lambda x: x["line"]), "").alias("formatted"),
                    F.transform("t", lambda x: x["span"]).alias("turns"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted
    string and its loss spans alone."""
    lines = F.split("formatted", r"<\|turn\|>")          # nothing stands before the first mark
    r = rendered.withColumn("_p", F.slice(lines, 2, F.greatest(F.lit(1), F.size(lines))))
    r = r.withColumn("_t", F.transform("_p", lambda p: F.struct(
        unescape(F.substring_index(p, BODY, 1)).alias("role"),
        unescape(F.regexp_extract(p, r"(?s)<\|text\|>(.*)<\|end\|>\n\z", 1)).alias("text"))))
    loss = F.transform(F.filter(F.arrays_zip(F.col("_p").alias("p"), F.col("turns").alias("s")),
                                lambda z: z["s"]["loss_start"].isNotNull()),
                       lambda z: unescape(F.substring(
                           z["p"], (z["s"]["loss_start"] - z["s"]["start"] - len(OPEN) + 1).cast("int"),
                           (z["s"]["loss_end"] - z["s"]["loss_start"]).cast("int"))))
    r = r.withColumn("_loss", F.array_join(loss, ""))
    turns = F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select("conv_id", F.size("_t").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                    F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))


PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def report(turns: DataFrame) -> DataFrame:
    """The digest of every conversation and of the probe conversation -7."""
    spark = turns.sparkSession
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    every = turns.select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(render(from_turns(every)))
