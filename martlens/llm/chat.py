r"""Chat formatting with a grammar round trip.

A conversation is rendered as turns ``### role: text</turn>\n``. A deterministic
parser reads it back. A turn is rendered as it stands if the parser recovers it
from that; otherwise its role and text are escaped first. The parser always
undoes escapes, so it needs no mark to tell the two cases apart:

    \   as \b       </turn>  as \e       ###  as \h       :  (in roles)  as \c

Every backslash of an escaped text is followed by one of these letters, so that
undoing ``\b`` last restores the source exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, COLON, END = "### ", ": ", "</turn>"
LOSS_ROLE = "assistant"
PAGE = 4096  # code points of a page that spans are looked up in
_ESCAPES = (("\\", "\\b"), (END, "\\e"), ("###", "\\h"))


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    for plain, escaped in _ESCAPES:
        text = _replace(text, plain, escaped)
    return text


def escape_role(role: Column) -> Column:
    return _replace(escape(role), ":", "\\c")


def unescape(text: Column) -> Column:
    for plain, escaped in reversed(_ESCAPES):
        text = _replace(text, escaped, plain)
    return text


def unescape_role(role: Column) -> Column:
    for plain, escaped in ((":", "\\c"), *reversed(_ESCAPES)):
        role = _replace(role, escaped, plain)
    return role


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(COLON), text, F.lit(f"{END}\n"))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text), in order.

    A turn ends at the first end mark; its role ends at the first colon.
    """
    pieces = F.split(formatted, f"{END}\n")
    bodies = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        # Anything but a header keeps its text, so that it can't equal the source.
        body = F.when(piece.startswith(HEAD), F.substring(piece, len(HEAD) + 1, 2**31 - 1)).otherwise(
            F.concat(F.lit(COLON), piece)
        )
        role = F.substring_index(body, COLON, 1)
        text = body.substr(F.length(role) + 1 + len(COLON), F.length(body))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, turn)


def _round_trips(role: Column, text: Column) -> Column:
    """Whether the parser recovers a turn that is rendered as it stands.

    A control mark inside a text is a conflict in any case, as it would mislead
    a reader other than the parser.
    """
    marks = text.contains(END) | text.contains("###") | role.contains("###") | role.contains(END)
    turns = parse(render(role, text))
    one = (F.size(turns) == 1) & (turns[0]["role"] == role) & (turns[0]["text"] == text)
    return ~marks & F.coalesce(one, F.lit(False))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, place, role, text, rendered, loss_start, loss_end.

    ``place`` numbers the turns of a conversation from 1 by turn, then role and
    text, so that ties and repeated rows have one order; a null turn comes first.
    Null roles and texts are empty. Offsets count characters of the conversation's
    formatted text; they are null unless the turn is the assistant's.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    role, text = F.col("role"), F.col("text")
    plain = _round_trips(role, text)
    rows = rows.withColumn("shown_role", F.when(plain, role).otherwise(escape_role(role)))
    rows = rows.withColumn("shown", F.when(plain, text).otherwise(escape(text)))
    rows = rows.withColumn("rendered", render(F.col("shown_role"), F.col("shown")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.row_number().over(order))
    begin = F.coalesce(F.sum(F.length("rendered").cast("long")).over(before), F.lit(0).cast("long"))
    start = begin + len(HEAD) + F.length("shown_role") + len(COLON)
    loss = F.col("role") == LOSS_ROLE
    return rows.select(
        "conv_id", "place", "role", "text", "rendered",
        F.when(loss, start).alias("loss_start"),
        F.when(loss, start + F.length("shown")).alias("loss_end"),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, exact.

    ``loss_spans`` are the (start, end) offsets of the assistant's texts. ``exact``
    tells that parsing the whole formatted text gives back every turn. A null
    conv_id is one conversation. A conversation is one text and hence one row;
    memory is bounded by its length.
    """
    rows = format_turns(turns)
    cells = F.struct("place", "rendered", "loss_start", "loss_end", "role", "text")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(cells)).alias("cells"))
    built = grouped.select(
        "conv_id",
        F.array_join(F.transform("cells", lambda c: c["rendered"]), "").alias("formatted"),
        F.transform(
            F.filter("cells", lambda c: c["loss_start"].isNotNull()),
            lambda c: F.struct(c["loss_start"].alias("start"), c["loss_end"].alias("end")),
        ).alias("loss_spans"),
        F.transform("cells", lambda c: F.struct(c["role"].alias("role"), c["text"].alias("text"))).alias("source"),
    )
    exact = parse(F.col("formatted")) == F.col("source")
    return built.select("conv_id", "formatted", "loss_spans", exact.alias("exact"))


def _cut(text: Column, spans: Column) -> Column:
    """The texts at ``spans`` (code points) of ``text``.

    The text is cut into pages once, so that a span is found without counting
    from the start again; the pages are bound to a name for the same reason.
    """
    pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))

    def at(pages: Column, span: Column) -> Column:
        first, last = F.floor(span["start"] / PAGE), F.floor(span["end"] / PAGE)
        near = F.array_join(F.slice(pages, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        begin = (span["start"] - first * PAGE + 1).cast("int")
        return near.substr(begin, (span["end"] - span["start"]).cast("int"))

    return F.transform(F.array(pages), lambda p: F.transform(spans, lambda s: at(p, s)))[0]


def read_back(formatted: DataFrame) -> DataFrame:
    """Parsed turns and the text under the loss mask: conv_id, turns, loss_text, n_chars.

    ``loss_text`` is what ``loss_spans`` cut out of the formatted text, unescaped.
    A conversation that is not ``exact`` stops the job.
    """
    masked = F.transform(_cut(F.col("formatted"), F.col("loss_spans")), unescape)
    inexact = F.raise_error(F.concat(F.lit("not recovered: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    return formatted.select(
        "conv_id",
        F.when(F.col("exact"), parse(F.col("formatted"))).otherwise(inexact).alias("turns"),
        F.array_join(masked, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("n_chars"),
    )
