"""Chat formatting from an event log.

Only DataFrame functions. The log holds events of conversations: (conv_id, seq,
message, kind, role, text). They are partitioned by conversation, ordered by seq
and folded: ``delta`` appends text to its message, ``edit`` replaces the message's
text, ``regenerate`` empties the message and drops every later message begun before
it, with what still arrives for those. A message's role is the first one that any of its
events names. The final messages are rendered with turn marks and a loss mask.

The template is ``<|im_start|>role`` newline ``text<|im_end|>`` newline per turn.
Inside roles and texts a backslash becomes two and ``<|`` becomes ``<\\|``, so no
control string can occur in content, and reading back restores every text; a newline
in a role becomes backslash n. The loss mask is a list of (start, length) in bytes of
the UTF-8 output, one span for each assistant text.

Null texts and roles count as empty. Null ids are one conversation of their own.
Ties in turn are ordered by role, then text; repeated rows are turns of their own. An
empty table gives no rows. A conversation's output is one value and has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import settled

START, END, ROLE = "<|im_start|>", "<|im_end|>", "assistant"


def events_of_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log of a table of finished turns: one delta per row, a message for each."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("_turn", "role", "text")).cast("long")
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("_turn"), role_.alias("role"), text_.alias("text"))
    return rows.withColumn("seq", at).select("conv_id", "seq", F.col("seq").alias("message"), F.lit("delta").alias("kind"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of an event log; one shuffle, by conversation."""
    later = Window.partitionBy("conv_id").orderBy("seq", "message", "text").rowsBetween(1, Window.unboundedFollowing)
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later)
    whole = Window.partitionBy("conv_id", "message")
    own = whole.orderBy("seq", "text")
    reset = F.sum(F.when(F.col("kind").isin("edit", "regenerate"), 1).otherwise(0)).over(own)
    began = F.first("_cut").over(own)  # what is regenerated after the message began
    named = F.first("role", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    live = events.withColumn("_cut", cut).withColumns({"_began": began, "_role": named, "_reset": reset}).where("_began is null or message <= _began")
    live = live.withColumn("_last", F.max("_reset").over(whole)).where("_reset = _last")
    ordered = F.sort_array(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))
    out = live.groupBy("conv_id", "message").agg(F.first("_role").alias("role"), ordered.alias("_t"))
    return out.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("_t", lambda x: x["text"]), "").alias("text"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def unescape_role(role: Column) -> Column:
    pieces = F.split(role, r"\\\\")
    return F.array_join(F.transform(pieces, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from final messages."""
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    rows = messages.select("conv_id", "message", "role", head.alias("_head"), escape(F.col("text")).alias("_body"))
    rows = rows.withColumn("_piece", F.concat("_head", "_body", F.lit(END + "\n")))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("_piece").cast("long")).over(before), F.lit(0).cast("long"))
    rows = rows.withColumn("_span", F.when(F.col("role") == ROLE, F.struct((at + F.octet_length("_head")).alias("start"), F.octet_length("_body").cast("long").alias("length"))))
    turns = F.sort_array(F.collect_list(F.struct("message", "_piece", "_span")))
    out = rows.groupBy("conv_id").agg(turns.alias("_t"))
    return out.select("conv_id", F.array_join(F.transform("_t", lambda x: x["_piece"]), "").alias("formatted"), F.filter(F.transform("_t", lambda x: x["_span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of rendered text, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = p.substr(F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, joined without anything between."""
    raw = F.encode(formatted, "UTF-8")
    cut = lambda s: unescape(F.decode(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))
    return F.array_join(F.transform(spans, cut), "")


def chat_report(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Format every conversation and read the output back."""
    out = render(fold(events_of_turns(turns, conv, turn, role, text)))
    out = settled(out, _turns=parse(F.col("formatted")), _loss=loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
