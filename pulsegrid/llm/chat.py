"""Chat formatting from an event log, with DataFrame functions only.

Events are partitioned by conversation and sorted by sequence. Every message is folded from its events:

* `message` opens a message (or opens it anew) with a role and a first text,
* `delta` appends streamed text,
* `edit` replaces the text,
* `regenerate` drops the text; the deltas after it build the next try.

An edit or regeneration starts the conversation again at its message: what was said after that message and before the
event goes. The final messages are rendered with one marked turn each.

Defined cases: NULL text or role is empty; a NULL kind is `message`; events of equal sequence number are ordered by kind,
text and role; equal rows count as often as they occur; a NULL conversation id is a conversation; a message whose events
are all gone is no turn; long texts are rendered whole; an empty log gives no rows. Columns beyond those named are not read, whatever their names.

Bounds: the fold streams over sorted rows, which spill. Only the rendered text of one conversation meets in one row, as
its result has to; `turns` gives the same turns one per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ["message", "edit", "regenerate", "delta"]  # order of equal sequence numbers


def escape(text: Column) -> Column:
    """No `<|` remains: one more backslash goes between the two signs."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As `escape`, and on one line."""
    one_line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.replace(one_line, F.lit("<"), F.lit("\\l"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))), "\\")


def fold(events: DataFrame, conv: str = "conv_id", seq: str = "seq", msg: str = "msg", kind: str = "kind",
         role: str = "role", text: str = "text") -> DataFrame:
    """Final messages (conv_id, msg, role, text) of an event log."""
    e = events.select(
        F.col(conv).alias("conv_id"), F.col(msg).alias("msg"), F.col(seq).alias("seq"),
        F.coalesce(F.array_position(F.lit(KINDS), F.lower(F.col(kind))), F.lit(1)).cast("int").alias("kind"),
        F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    back = [F.col(c).desc_nulls_last() for c in ("seq", "kind", "text", "role")]

    def later(*keys: str):
        return Window.partitionBy(*keys).orderBy(*back).rowsBetween(Window.unboundedPreceding, -1)

    again = F.col("kind").isin(2, 3)
    e = e.withColumn("branch", F.min(F.when(again, F.col("msg"))).over(later("conv_id")))
    e = e.filter(F.col("branch").isNull() | F.col("msg").isNull() | (F.col("msg") <= F.col("branch")))
    e = e.withColumn("replaced", F.max((F.col("kind") < 4).cast("int")).over(later("conv_id", "msg")))
    # a replaced opening still says who speaks
    own = F.coalesce(F.col("replaced"), F.lit(0)) == 0
    pieces = e.select("conv_id", "msg", F.when(own, F.struct("seq", "kind", "text", "role")).alias("piece"),
                      F.struct("seq", "kind", "role").alias("said"))
    m = pieces.groupBy("conv_id", "msg").agg(
        F.sort_array(F.collect_list("piece")).alias("pieces"), F.max(F.when(F.col("said.role").isNotNull(), F.col("said"))).alias("said"))
    return m.select("conv_id", "msg", F.coalesce(F.col("said.role"), F.lit("")).alias("role"),
                    F.array_join(F.col("pieces.text"), "").alias("text"))


def turns(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: conv_id, msg, rendered, start (code points before it), body (start of its text), size of its
    escaped text, loss (text is learned)."""
    m = messages.select(
        "conv_id", "msg", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
        F.col("role").isin(*learn).alias("loss"))
    m = m.select("conv_id", "msg", F.concat("head", "body", F.lit(END + "\n")).alias("rendered"), "loss",
                 F.length("head").alias("head_size"), F.length("body").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("rendered").cast("long")).over(before), F.lit(0))
    return m.withColumn("start", start).withColumn("from", F.col("start") + F.col("head_size")).drop("head_size")


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (start and end of learned texts, code points),
    loss_turns (their turn numbers from 1)."""
    t = turns(messages, learn)
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("msg", "rendered", "from", "size", "loss"))).alias("t"))
    numbers = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.element_at("t", i)["loss"])
    return g.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join("t.rendered", "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(
            x["from"].alias("start"), (x["from"] + x["size"]).alias("end"))).alias("loss_spans"), numbers.alias("loss_turns"))


def parse(formatted: Column) -> Column:
    """Turns (role, text) read back from rendered text."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)

    def turn(p: Column) -> Column:
        line = F.substring_index(p, "\n", 1)
        rest = F.length(p) - F.length(line) - 2 - len(END)
        return F.struct(unescape_role(line).alias("role"), unescape(F.substr(p, F.length(line) + 2, rest)).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), turn)


def events_of_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A stored conversation table as an event log: every row opens a message and streams its text."""
    order = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), F.col(role), F.col(text))
    n = rows.select(F.col(conv).alias("conv_id"), F.row_number().over(order).cast("long").alias("msg"), F.col(role).alias("_r"), F.col(text).alias("_t"))
    both = F.array(
        F.struct((F.col("msg") * 2).alias("seq"), F.lit("message").alias("kind"), F.coalesce("_r", F.lit("")).alias("role"), F.lit("").alias("text")),
        F.struct((F.col("msg") * 2 + 1).alias("seq"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.coalesce("_t", F.lit("")).alias("text")))
    return n.select("conv_id", "msg", F.inline(both))
