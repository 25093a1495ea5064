r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Template (one turn):  ``### ROLE: TEXT</turn>\n``.  The deterministic parser splits at the turn end, then at the first
``": "``; it refuses a turn whose role or text holds a control string or an unpaired escape.  Every turn is first
rendered as it is and reparsed; where the parser does not give back the same role and text the content is escaped:
``\`` becomes ``\\`` and a control string is broken up by a ``\`` behind its first character(s).  The finished
conversation is parsed once more and must equal its source, or the job stops.

The loss mask is a list of code-point spans in the formatted text covering the assistant's texts.

Defined cases: null role or text is empty; rows are ordered by turn (null first), equal turns by role and text; every row
is a turn, repeated ones too; a null conversation id is a conversation of its own; an empty table gives an empty result;
other columns are not read.  A conversation's formatted text is one value, so it is limited to Spark's 2 GB per value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

TURN, MARK, END, ESCAPE = "### ", ": ", "</turn>", "\\"
LOSS_ROLE = "assistant"


def escape(c: Column, role: bool = False) -> Column:
    """Content without any control string; ``unescape`` gives back the original."""
    c = F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for s, broken in ((TURN, "#\\## "), (END, "<\\/turn>")):
        c = F.replace(c, F.lit(s), F.lit(broken))
    return F.replace(c, F.lit(MARK), F.lit(":\\ ")) if role else c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), role, F.lit(MARK), text, F.lit(END + "\n"))


def parse_piece(piece: Column) -> Column:
    """(role, text) of what stands before one turn end, null where the grammar refuses it."""
    body = F.substring(piece, len(TURN) + 1, 2147483647)
    at = F.locate(MARK, body)
    role = F.substring(body, F.lit(1), at - 1)
    text = F.substring(body, at + len(MARK), F.lit(2147483647))
    fine = piece.startswith(TURN) & (at > 0) & ~body.contains(TURN) & ~body.contains(END)
    paired = ~F.regexp_like(body, F.lit(r"^(?s)(?:[^\\]|\\.)*+\\$"))
    return F.when(fine & paired, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation; a refused turn is null."""
    pieces = F.split(formatted, END + "\n", -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parse_piece)


def format_conversations(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (as reparsed) and loss_spans (array of start, length)."""
    rows = conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text")
    )
    plain = F.struct("role", "text")
    # What the parser sees of a turn ends at the first turn end, so content that holds one does not come back whole.
    back = parse_piece(F.split(render(F.col("role"), F.col("text")), END + "\n", -1)[0])
    rows = rows.withColumn("same", F.coalesce(back == plain, F.lit(False))).select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("same"), F.col("role")).otherwise(escape(F.col("role"), role=True)).alias("shown_role"),
        F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text"))).alias("shown"),
    )
    rows = rows.withColumn("piece", render(F.col("shown_role"), F.col("shown")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = len(TURN) + len(MARK)
    span = F.when(
        F.col("role") == LOSS_ROLE,
        F.struct((before + head + F.length("shown_role")).alias("start"), F.length("shown").cast("long").alias("length")),
    )
    rows = rows.select("conv_id", F.row_number().over(order).alias("k"), span.alias("span"), "piece", "role", "text")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "piece", "span", "role", "text"))).alias("all"))
    done = grouped.select(
        "conv_id",
        F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("all", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.transform("all", lambda t: F.struct(t["role"], t["text"])).alias("source"),
    )
    done = done.withColumn("turns", parse(F.col("formatted")))
    checked = F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(
        F.raise_error(F.lit("a formatted conversation does not parse back to its source"))
    )
    return done.select("conv_id", "formatted", checked.alias("turns"), "loss_spans")


def digests(formatted: DataFrame) -> DataFrame:
    """Sizes and SHA-256 digests read back from the formatted text and its loss mask."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    cut = lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(cut(s))), "")
    return formatted.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
