"""Chat templates: messages to marked-up text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.arrays import let
from turnloom.functions.text import SPACES, quote

# The chat markup and the payload marks looked for in it.
START = "<|im_start|>"
END = "<|im_end|>"
SYSTEM_MARK = "<|im_start|>system"
TOOLS_MARK = "# Tools"


@dataclass(frozen=True)
class ChatTemplate:
    """One turn is ``start role newline content end newline``.

    ``default_system`` is put before a conversation that does not begin with a system
    message. ``tools`` text, where given, goes into the system turn under ``tools_head``.
    """

    start: str = START
    end: str = END
    default_system: str | None = None
    tools_head: str = "\n\n# Tools\n\n"

    @property
    def generation_header(self) -> str:
        return f"{self.start}assistant\n"

    @property
    def terminator(self) -> str:
        return f"{self.end}\n"

    @property
    def prefix(self) -> str:
        """What rendering adds before a first message that is not a system message."""
        if self.default_system is None:
            return ""
        return f"{self.start}system\n{self.default_system}{self.terminator}"

    def turn(self, role: Column, content: Column) -> Column:
        return F.concat(
            F.lit(self.start), role, F.lit("\n"), content, F.lit(self.terminator)
        )

    def opening(self, role: Column, content: Column, tools: Column | None = None) -> Column:
        """The first turn, with the default system turn and the tools where they apply."""
        plain = F.when(role == "system", self.turn(role, content)).otherwise(
            F.concat(F.lit(self.prefix), self.turn(role, content))
        )
        if tools is None:
            return plain
        section = F.concat(F.lit(self.tools_head), tools)
        system = F.lit("system")
        with_tools = F.when(
            role == "system", self.turn(system, F.concat(content, section))
        ).otherwise(
            F.concat(
                self.turn(system, F.concat(F.lit(self.default_system or ""), section)),
                self.turn(role, content),
            )
        )
        return F.when(tools.isNull(), plain).otherwise(with_tools)

    def render(
        self, messages: Column, generation: bool = False, tools: Column | None = None
    ) -> Column:
        """The whole list as text, with the assistant header appended on request."""

        def join(msgs: Column) -> Column:
            turns = F.transform(
                msgs,
                lambda m, i: F.when(i == 0, self.opening(m["role"], m["content"], tools)).otherwise(
                    self.turn(m["role"], m["content"])
                ),
            )
            return F.array_join(turns, "")

        text = let(messages, join)
        return F.concat(text, F.lit(self.generation_header)) if generation else text

    def render_text(self, messages: list[tuple[str, str]], generation: bool = False) -> str:
        """The same for a few literal messages at plan time."""
        text = "".join(f"{self.start}{role}\n{content}{self.terminator}" for role, content in messages)
        if messages and messages[0][0] != "system":
            text = self.prefix + text
        return text + (self.generation_header if generation else "")

    def assistant_spans(self, text: Column) -> Column:
        """Every assistant text between its header and the next end mark, trimmed."""
        pattern = f"(?s){quote(self.generation_header)}(.*?){quote(self.end)}"
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.transform(found, lambda span: F.btrim(span, F.lit(SPACES)))


CHATML = ChatTemplate()


def payload_flags(payload: Column) -> tuple[Column, Column]:
    """Does the text hold a system turn, does it hold a tools section."""
    return (
        F.contains(payload, F.lit(SYSTEM_MARK)).alias("payload_has_system"),
        F.contains(payload, F.lit(TOOLS_MARK)).alias("payload_has_tools"),
    )
