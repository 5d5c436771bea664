"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is written as turns; a turn is ``begin``, the mark of its role, the text, the closing mark and ``end``. Nothing is taken on
trust: each rendered turn is read again by the parser below, and only what gives back the very same role and text is let through. A turn that
does not is rendered again with its conflicting content escaped, first the text, then the role as well.

Escaping is quoting: a control string, with any number of backslashes after its first character, gets one backslash more; reading takes one
away. So ``[INST]`` in a text becomes ``[\\INST]``, and a text that already says ``[\\INST]`` becomes ``[\\\\INST]``. Texts without such strings stay as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``marks``: role, opening and closing mark. ``loss_role`` has no marks of its own; any other role is named between ``named``."""

    begin: str = "<s>"
    end: str = "</s>"
    marks: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"))
    named: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    loss_role: str = "assistant"

    @property
    def controls(self) -> list[str]:
        return [self.begin, self.end, *(x for m in self.marks for x in m[1:]), *self.named]

    @property
    def _heads_and_rests(self) -> tuple[str, str]:
        heads = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        rests = "|".join(sorted({re.escape(c[1:]) for c in self.controls}, key=lambda r: (-len(r), r)))
        return f"([{heads}])", f"({rests})"

    @property
    def quotable(self) -> str:
        """Control strings with any number of backslashes inside."""
        head, rest = self._heads_and_rests
        return rf"{head}(\\*){rest}"

    @property
    def quoted(self) -> str:
        """Control strings with one backslash at least."""
        head, rest = self._heads_and_rests
        return rf"{head}\\(\\*){rest}"

    @property
    def plain(self) -> str:
        """Control strings as the grammar has them."""
        return "|".join(re.escape(c) for c in sorted(self.controls, key=lambda c: (-len(c), c)))


CHAT = Template()


def quote(text: Column, template: Template = CHAT) -> Column:
    return F.regexp_replace(text, template.quotable, r"$1\\$2$3")


def unquote(text: Column, template: Template = CHAT) -> Column:
    return F.regexp_replace(text, template.quoted, "$1$2$3")


def render_turn(role: Column, text: Column, template: Template = CHAT) -> tuple[Column, Column, Column]:
    """What stands before, in and after the text of one turn; nothing is escaped here."""
    opening, closing = F.when(role == template.loss_role, F.lit("")), F.when(role == template.loss_role, F.lit(""))
    for name, a, b in template.marks:
        opening, closing = opening.when(role == name, F.lit(a)), closing.when(role == name, F.lit(b))
    opening = opening.otherwise(F.concat(F.lit(template.named[0]), role, F.lit(template.named[1])))
    return F.concat(F.lit(template.begin), opening), text, F.concat(closing.otherwise(F.lit("")), F.lit(template.end))


def _inside(body: Column, a: int, b: int) -> Column:
    """``body`` without its first ``a`` and last ``b`` characters."""
    return F.substring(body, F.lit(a + 1), F.length(body) - (a + b))


def parse_turn(part: Column, template: Template = CHAT) -> Column:
    """The role and text that a turn (without its ``end``) stands for; null where the grammar does not allow it."""
    turn = lambda role, inner: F.when(~role.rlike(template.plain) & ~inner.rlike(template.plain), F.struct(unquote(role, template).alias("role"), unquote(inner, template).alias("text")))
    body = _inside(part, len(template.begin), 0)
    found = F.when(~part.startswith(template.begin), F.lit(None))
    for name, a, b in template.marks:
        closed = body.endswith(b) & (F.length(body) >= len(a) + len(b))
        found = found.when(body.startswith(a), F.when(closed, turn(F.lit(name), _inside(body, len(a), len(b)))))
    a, b = template.named
    ends = F.instr(body, b)
    other = F.when(ends > 0, turn(F.substring(body, F.lit(len(a) + 1), ends - (len(a) + 1)), F.substring(body, ends + len(b), F.length(body))))
    return found.when(body.startswith(a), other).otherwise(turn(F.lit(template.loss_role), body))


def parse(formatted: Column, template: Template = CHAT) -> Column:
    """The turns of a formatted conversation as an array of role and text; null in place of a turn that the grammar does not allow.

    ``end`` occurs at the end of turns only, so the text is split there; whatever follows the last one is no turn and gives a null.
    """
    parts = F.split(formatted, re.escape(template.end), -1)
    whole = F.slice(parts, 1, F.size(parts) - 1)
    return F.concat(F.transform(whole, lambda p: parse_turn(p, template)), F.when(F.element_at(parts, -1) == "", F.array()).otherwise(F.array(F.lit(None))))


def _settled(turns: DataFrame, template: Template) -> DataFrame:
    """``before``, ``shown`` and ``after`` of each turn, escaped as far as the round trip asks for, and ``_level``: how far that was."""
    role, text = F.col("_role"), F.col("_text")
    tries = [(role, text), (role, quote(text, template)), (quote(role, template), quote(text, template))]
    level = F.when(F.lit(False), F.lit(0))
    for k, (r, t) in enumerate(tries[:-1]):
        before, shown, after = render_turn(r, t, template)
        back = parse(F.concat(before, shown, after), template)
        # Compared without nulls: a turn that cannot be read is not identical.
        same = (F.size(back) == 1) & F.coalesce((back[0]["role"] == role) & (back[0]["text"] == text), F.lit(False))
        level = level.when(same, F.lit(k))
    levelled = turns.withColumn("_level", level.otherwise(F.lit(len(tries) - 1)))
    pick = lambda i: F.when(F.col("_level") == 0, tries[0][i]).when(F.col("_level") == 1, tries[1][i]).otherwise(tries[2][i])
    before, shown, after = render_turn(pick(0), pick(1), template)
    return levelled.withColumns({"_before": before, "_shown": shown, "_after": after})


def format_conversations(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start from 0 and length, in code points), n_escaped (turns) and exact.

    ``exact`` says that the parser, run on the whole formatted text, gives back the source turns; it is true for every input. Turns are
    ordered by ``turn``, null first, ties by role and text. A null role or text is an empty one; rows with a null conv_id are one
    conversation with a null id; repeated rows are turns of their own. An empty table gives no rows; other columns are not read, whatever
    their names. A conversation is one row and its digest one string, so it has to fit a task, as a long document does.
    """
    turns = conversations.select("conv_id", F.col("turn").alias("_turn"), F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text")
    settled = _settled(turns, template).withColumns(
        {
            "_at": F.row_number().over(in_order),
            "_until": F.sum(F.length("_before") + F.length("_shown") + F.length("_after")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        }
    )
    start = F.col("_until") - F.length("_after") - F.length("_shown")
    turn = F.struct(
        "_at", F.concat("_before", "_shown", "_after").alias("piece"), F.struct(F.col("_role").alias("role"), F.col("_text").alias("text")).alias("source"),
        F.when(F.col("_role") == template.loss_role, F.struct(start.cast("long").alias("start"), F.length("_shown").cast("long").alias("length"))).alias("span"),
    )
    # The window has dealt and ordered the rows by conversation; the grouping adds no exchange.
    grouped = settled.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"), F.count_if(F.col("_level") > 0).alias("n_escaped"))
    formatted = F.concat_ws("", F.transform("_turns", lambda t: t["piece"]))
    spans = F.filter(F.transform("_turns", lambda t: t["span"]), lambda s: s.isNotNull())
    shaped = grouped.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"), "n_escaped", F.transform("_turns", lambda t: t["source"]).alias("_source"))
    return shaped.select("conv_id", "formatted", "loss_spans", "n_escaped", F.coalesce(parse(F.col("formatted"), template) == F.col("_source"), F.lit(False)).alias("exact"))


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Adds turns, as the parser reads them, and loss_text: what lies under the spans, unescaped, nothing between."""
    under = F.transform("loss_spans", lambda s: unquote(F.substring("formatted", s["start"].cast("int") + 1, s["length"].cast("int")), template))
    return formatted.withColumns({"turns": parse(F.col("formatted"), template), "loss_text": F.concat_ws("", under)})


def chat_digests(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_escaped and exact, all read back from the formatted text."""
    back = read_back(format_conversations(conversations, template), template)
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "n_escaped", "exact",
    )
