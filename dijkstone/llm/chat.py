r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered ``### role: text</turn>\n``. The parser is deterministic: it splits at ``</turn>\n``; a part must begin
with ``### ``, its role ends at the first ``:``, a ``*`` before that says that the text is escaped, and a text that still
holds ``### `` or ``</turn>`` is an error. Every turn is rendered as it is and parsed again; where the outcome differs from
the source it is escaped (\ becomes \b, < \l, # \h) and marked. Then whole conversations are parsed again, and the job fails
if one differs.

The result has the formatted text, the recovered turns and the loss mask: spans (start, length, in code points) of the
assistant's texts, as they stand in the formatted text.

Defined results: a null or empty text is empty, a null role is the empty role. Turns are ordered by turn (null first), then
role and text, so repeated and tied rows have one order; repeated rows stay. A row with a null conversation id is a
conversation of its own (equal ones together). Extra columns of the input are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
HEAD, END = "### ", "</turn>\n"
_RESERVED = ("### ", "</turn>")
_TEXT = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_ROLE = (*_TEXT, (":", "\\c"), ("*", "\\s"), ("\n", "\\n"))


def _escape(c: Column, pairs) -> Column:
    for plain, code in pairs:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def _unescape(c: Column, pairs) -> Column:
    for plain, code in reversed(pairs):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _head(role: Column, escaped: Column) -> Column:
    return F.concat(F.lit(HEAD), _escape(role, _ROLE), F.when(escaped, "*").otherwise(""), F.lit(": "))


def render(role: Column, text: Column, escaped: Column) -> Column:
    """One turn."""
    return F.concat(_head(role, escaped), F.when(escaped, _escape(text, _TEXT)).otherwise(text), F.lit(END))


def _parse_part(p: Column) -> Column:
    """role, text, ok of one part between ends."""
    head = F.substring_index(p, ":", 1)
    body = F.substr(p, F.char_length(head) + 3)
    escaped = F.endswith(head, F.lit("*"))
    role = F.substr(head, F.lit(len(HEAD) + 1))
    role = F.when(escaped, F.substr(role, F.lit(1), F.greatest(F.char_length(role) - 1, F.lit(0)))).otherwise(role)
    ok = F.startswith(p, F.lit(HEAD)) & (F.substr(p, F.char_length(head) + 1, F.lit(2)) == ": ")
    for r in _RESERVED:
        ok = ok & ~F.contains(body, F.lit(r))
    return F.struct(_unescape(role, _ROLE).alias("role"), F.when(escaped, _unescape(body, _TEXT)).otherwise(body).alias("text"), ok.alias("ok"))


def parse(formatted: Column) -> Column:
    """The turns (role, text, ok) of a formatted text; what follows the last end counts as a turn that isn't ok."""
    parts = F.split(formatted, END, -1)
    rest = F.element_at(parts, -1)
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), _parse_part)
    return F.when(rest == "", turns).otherwise(F.concat(turns, F.array(F.struct(F.lit("").alias("role"), rest.alias("text"), F.lit(False).alias("ok")))))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, turns, loss): one row for each conversation; turns are those read back from ``formatted``."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("own", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")))
    back = parse(render(F.col("role"), F.col("text"), F.lit(False)))
    same = (F.size(back) == 1) & back[0]["ok"] & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text"))
    rows = rows.withColumn("escaped", ~same)
    rows = rows.withColumns({"piece": render(F.col("role"), F.col("text"), F.col("escaped")), "skip": F.char_length(_head(F.col("role"), F.col("escaped")))})
    before = Window.partitionBy("conv_id", "own").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length("piece").cast("long")).over(before), F.lit(0)))
    span = F.struct((F.col("at") + F.col("skip")).alias("start"), (F.char_length("piece") - F.col("skip") - len(END)).cast("long").alias("length"))
    whole = rows.groupBy("conv_id", "own").agg(
        F.sort_array(F.collect_list(F.struct("at", "piece", "role", "text"))).alias("made"),
        F.sort_array(F.collect_list(F.when(F.col("role") == ASSISTANT, span))).alias("loss"),
    )
    out = whole.select("conv_id", F.array_join(F.col("made.piece"), "").alias("formatted"), "made", "loss").withColumn("turns", parse(F.col("formatted")))
    good = (F.col("turns.role") == F.col("made.role")) & (F.col("turns.text") == F.col("made.text")) & F.forall("turns", lambda t: t["ok"])
    turns_ = F.when(good, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).otherwise(
        F.raise_error(F.lit("a formatted conversation doesn't parse back to its source")).cast("array<struct<role:string,text:string>>")
    )
    return out.select("conv_id", "formatted", turns_.alias("turns"), "loss")


def read_back(chats: DataFrame) -> DataFrame:
    """Digest columns of formatted conversations, from the turns parsed out of them."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
