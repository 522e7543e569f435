"""Chat formatting: a state machine over roles checks the order of turns, a template gives text segments with loss flags.

DataFrame functions throughout. A conversation's turns, by turn, then role and text, become segments: an opening with
the role, the escaped text, a close. Only the text of a role in `loss_roles` is under the loss. The escape character and
the control strings inside a text are each replaced by the escape character and a digit, so no text holds a control
string and every text can be told from the template again.

Cases: a null text or role is empty; a null turn comes first; rows of a null conv_id are one conversation; repeated rows
are turns; an order of roles that the machine does not allow makes valid false, and is formatted all the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Declares the text around turns, the roles under the loss, and the machine: (state, role) -> state."""

    open: str = "### "
    role_end: str = ":\n"
    close: str = "</turn>\n"
    escape: str = "\\"
    controls: tuple[str, ...] = ("</turn>", "###")
    loss_roles: tuple[str, ...] = ("assistant",)
    order: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "asks", ("start", "user"): "answers", ("asks", "user"): "answers", ("answers", "assistant"): "asks"})
    final: tuple[str, ...] = ("asks", "answers")

    def pairs(self, more: tuple[str, ...] = ()) -> list[tuple[str, str]]:
        return [(self.escape, f"{self.escape}0"), *((c, f"{self.escape}{k}") for k, c in enumerate((*self.controls, *more), 1))]

    def escaped(self, x: Column, more: tuple[str, ...] = ()) -> Column:
        return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), self.pairs(more), x)

    def unescaped(self, x: Column, more: tuple[str, ...] = ()) -> Column:
        return reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), reversed(self.pairs(more)), x)

    def valid(self, turns: Column) -> Column:
        """Whether the roles of turns lead the machine from start to a final state."""

        def step(state: Column, turn: Column) -> Column:
            chosen = F.lit("refused")
            for (at, role), to in self.order.items():
                chosen = F.when((state == at) & (turn["role"] == role), F.lit(to)).otherwise(chosen)
            return chosen

        return F.aggregate(turns, F.lit("start"), step).isin(*self.final)


def formatted_chats(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """(conv_id, valid, segments array<struct<text, loss>>, formatted) of each conversation."""
    t = template or ChatTemplate()
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    chats = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(t.open), t.escaped(x["role"], (t.role_end,)), F.lit(t.role_end))
        parts = ((head, F.lit(False)), (t.escaped(x["text"]), x["role"].isin(*t.loss_roles)), (F.lit(t.close), F.lit(False)))
        return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts])

    chats = chats.select("conv_id", t.valid(F.col("turns")).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return chats.withColumn("formatted", F.array_join("segments.text", ""))


def read_chats(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """(conv_id, turns array<struct<role, text, loss>>) from the formatted text; loss from the segments' flags."""
    t = template or ChatTemplate()
    parts = F.split("formatted", f"\\Q{t.close}\\E")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    flags = F.transform(F.filter("segments", lambda x, i: i % 3 == 1), lambda x: x["loss"])

    def turn(part: Column, loss: Column) -> Column:
        head = F.substring_index(part, t.role_end, 1)
        role = t.unescaped(F.substr(head, F.lit(len(t.open) + 1)), (t.role_end,))
        text = t.unescaped(F.substr(part, F.length(head) + len(t.role_end) + 1))
        return F.struct(role.alias("role"), text.alias("text"), loss.alias("loss"))

    return formatted.withColumn("turns", F.zip_with(parts, flags, turn))


def chat_digests(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid), all read back from the output."""
    chats = read_chats(formatted_chats(conversations, template), template)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    chats = chats.select("conv_id", "valid", F.size("turns").cast("long").alias("n_turns"), F.length("formatted").cast("long").alias("formatted_chars"), said.alias("said"), loss.alias("loss"))
    return chats.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid")
