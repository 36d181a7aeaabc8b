"""Conversations with typed content parts as training texts, with DataFrame functions only.

A turn is a list of parts. Text is taken as it is; an image, audio or document part becomes a placeholder in its place,
and its reference, place and expanded token count are recorded in the order of the placeholders. The template is

    <turn role="ROLE">CONTENT</turn> and a line feed.

Inside texts `&` and `<` are written `&amp;` and `&lt;` (in roles also `"` as `&quot;`), so no text can look like a
mark, and every text can be had back. Loss spans name the contents of assistant turns in code points of the whole.

Edge cases: a null text, role or list of parts counts as empty, an unknown part type as no content. Turns are ordered by
turn (null first), then role, then content; repeated rows are turns of their own. A null conv_id is a conversation. A
conversation is one string, so its turns meet in one task: its length is bounded by what a row can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 512  # pixels of an image patch; tokens of a second and of a page
LOSS_ROLE = "assistant"


def _escape(text: str) -> str:
    return rf"replace(replace(coalesce({text}, ''), '&', '&amp;'), '<', '&lt;')"


def _unescape(text: str) -> str:
    return rf"replace(replace({text}, '&lt;', '<'), '&amp;', '&')"


TOKENS = (f"case p.type when 'image' then ceil(coalesce(p.width, 0) / {PATCH}D) * ceil(coalesce(p.height, 0) / {PATCH}D)"
          f" when 'audio' then ceil(coalesce(p.seconds, 0) * {AUDIO_RATE}) when 'document' then coalesce(p.pages, 0) * {PAGE_TOKENS} else 0 end")


def text_parts(text: str) -> Column:
    """The parts of a row that has a text only."""
    return F.expr(f"array(cast(named_struct('type', 'text', 'text', {text}, 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null) as {PART}))")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None,
                 text_col: str = "text") -> DataFrame:
    """One row for each conversation: `conv_id`, `formatted`, `loss` (start and length), `attachments` (type, ref, start, tokens), `expanded_tokens`."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        (text_parts(f"`{text_col}`") if parts is None else parts).alias("parts"))
    shown = f"case p.type when 'text' then {_escape('p.text')} when 'image' then '<image/>' when 'audio' then '<audio/>' when 'document' then '<document/>' else '' end"
    rows = rows.withColumn("shown", F.expr(f"transform(coalesce(parts, array()), p -> {shown})"))
    rows = rows.withColumn("content", F.array_join("shown", ""))
    rows = rows.withColumn("open", F.concat(F.lit('<turn role="'), F.expr(f"replace({_escape('role')}, '\"', '&quot;')"), F.lit('">')))
    rows = rows.withColumn("block", F.concat("open", "content", F.lit("</turn>\n")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "content")
    rows = rows.withColumn("no", F.row_number().over(order))
    before = F.sum(F.char_length("block")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("at", F.coalesce(before, F.lit(0).cast("long")) + F.char_length("open"))
    found = (f"filter(transform(coalesce(parts, array()), (p, i) -> named_struct('type', p.type, 'ref', p.ref, 'start', at + char_length(array_join(slice(shown, 1, i), '')),"
             f" 'tokens', cast({TOKENS} as long))), a -> a.type in ('image', 'audio', 'document'))")
    rows = rows.select("conv_id", F.struct("no", "block", F.when(F.col("role") == LOSS_ROLE, F.struct(F.col("at").alias("start"), F.char_length("content").cast("long").alias("length"))).alias("loss"),
                                           F.expr(found).alias("found")).alias("t"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    out = out.select("conv_id", F.array_join("turns.block", "").alias("formatted"), F.expr("filter(turns.loss, x -> x is not null)").alias("loss"), F.flatten("turns.found").alias("attachments"))
    return out.withColumn("expanded_tokens", F.expr("aggregate(attachments, 0L, (n, a) -> n + a.tokens)"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """From `formatted` and `loss` alone: `conv_id`, `turns` (role and text), `loss_text` (under the spans, unescaped) and `formatted_chars`."""
    out = formatted.withColumn("blocks", F.expr(r"filter(split(formatted, '</turn>\n', -1), b -> b <> '')"))
    role = _unescape("replace(substring(b, 13, instr(b, '\">') - 13), '&quot;', '\"')")
    turns = F.expr(rf"transform(blocks, b -> named_struct('role', {role}, 'text', {_unescape('''substring(b, instr(b, '">') + 2)''')}))")
    # Four octets for each code point, so that a span is found without walking the text before it.
    out = out.withColumn("wide", F.encode("formatted", "UTF-32"))
    under = F.expr(rf"array_join(transform(loss, s -> {_unescape('''decode(substring(wide, cast(4 * s.start + 1 as int), cast(4 * s.length as int)), 'UTF-32')''')}), '')")
    return out.select("conv_id", turns.alias("turns"), under.alias("loss_text"), (F.octet_length("wide") / 4).cast("long").alias("formatted_chars"))
