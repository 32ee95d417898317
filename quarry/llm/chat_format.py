r"""Chat formatting with a grammar round trip (native: DataFrame functions only).

Grammar of one formatted conversation::

    conversation := header turn*
    header       := "<|chat:0|>\n" | "<|chat:1|>\n"        (1: texts and roles are escaped)
    turn         := "<|turn|>" role "<|says|>" text "<|end|>\n"

Rendering starts plain. The rendered string is parsed again by the deterministic parser and the turns it
gives are compared with the source; only where they differ is the conversation rendered again with
its control-like strings escaped, and that rendering must parse back to the source or the job fails.
Escaping puts one backslash into every ``<``, backslashes, ``|`` sequence and is undone by taking one out, so
it is reversible for any text, and an escaped text can hold no control string.

``loss_spans`` are the code-point spans [start, end) of the texts (not the marks) of the trained roles.

Defined cases: null role or text is the empty string; turns are ordered by (turn, role, text), nulls first,
repeated rows are kept; rows without a conversation id form one conversation with a null id; an empty
table gives no rows; other columns are ignored. A conversation is one output string, so its turns meet
in one row by nature of the result; conversations are otherwise spread by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN, ESCAPED = "<|chat:0|>\n", "<|chat:1|>\n"
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<$1\\|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<\\(\\*)\|", r"<$1|")


def _segments(turns: Column, fix) -> Column:
    return F.transform(turns, lambda t: F.concat(F.lit(TURN), fix(t["role"]), F.lit(SAYS), fix(t["text"]), F.lit(END)))


def render(turns: Column, escaped: bool) -> Column:
    fix = escape if escaped else (lambda x: x)
    return F.concat(F.lit(ESCAPED if escaped else PLAIN), F.array_join(_segments(turns, fix), ""))


def parse(formatted: Column) -> Column:
    """Turns array<struct<role,text>> of a formatted conversation; null where it breaks the grammar."""
    level = F.left(formatted, F.lit(len(PLAIN)))
    body = F.substring(formatted, len(PLAIN) + 1, 2_147_483_647)
    pieces = F.split(body, r"<\|end\|>\n", -1)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1),
                        lambda p: F.split(F.substring(p, len(TURN) + 1, 2_147_483_647), r"<\|says\|>", -1))
    shaped = (F.element_at(pieces, -1) == "") \
        & F.forall(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.startswith(p, F.lit(TURN))) \
        & F.forall(turns, lambda t: F.size(t) == 2)

    def pair(t, fix):
        return F.struct(fix(F.get(t, F.lit(0))).alias("role"), fix(F.get(t, F.lit(1))).alias("text"))

    return (F.when((level == PLAIN) & shaped, F.transform(turns, lambda t: pair(t, lambda x: x)))
            .when((level == ESCAPED) & shaped, F.transform(turns, lambda t: pair(t, unescape))))


def _spans(turns: Column, escaped: Column, roles: Sequence[str]) -> Column:
    """Code-point spans of the trained texts, by one running position over the turns."""
    start = F.struct(F.lit(len(PLAIN)).cast("long").alias("at"),
                     F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("out"))

    def size(x):
        return F.length(F.when(escaped, escape(x)).otherwise(x)).cast("long")

    def step(s, t):
        begin = s["at"] + F.lit(len(TURN) + len(SAYS)) + size(t["role"])
        end = begin + size(t["text"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + F.lit(len(END))).alias("at"),
                        F.when(t["role"].isin(*roles), F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    return F.aggregate(turns, start, step)["out"]


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, ``formatted``, ``escaped``, ``loss_spans``."""
    said = rows.select(F.col(conv_id).alias("_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_t"))
    conv = said.groupBy("_id").agg(F.transform(
        F.sort_array(F.collect_list("_t")),
        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("_turns"))
    tried = conv.withColumn("_plain", render(F.col("_turns"), False))
    tried = tried.withColumn("escaped", ~F.coalesce(parse(F.col("_plain")) == F.col("_turns"), F.lit(False)))
    done = tried.withColumn("formatted", F.when(F.col("escaped"), render(F.col("_turns"), True)).otherwise(F.col("_plain")))
    same = F.coalesce(parse(F.col("formatted")) == F.col("_turns"), F.lit(False))
    checked = done.withColumn("formatted", F.when(~F.col("escaped") | same, F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation does not parse back to its turns"))))
    return checked.select(F.col("_id").alias(conv_id), "formatted", "escaped",
                          _spans(F.col("_turns"), F.col("escaped"), loss_roles).alias("loss_spans"))


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask as a reader of the file sees it: cut out by span, then unescaped."""
    cut = F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    plain = F.startswith(formatted, F.lit(PLAIN))
    return F.array_join(F.transform(cut, lambda x: F.when(plain, x).otherwise(unescape(x))), "")
