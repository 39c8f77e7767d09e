"""Prompt templates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quern.functions.text import CODE_END, strip, text_or_empty

# The parts of the templates.
INSTRUCTION_HEAD = "### Instruction:\n"
RESPONSE_HEAD = "\n\n### Response:\n"
FENCE_OPEN = "```python\n"
FENCE_CLOSE = "\n```"
SYSTEM_HEAD = (
    "### System:\n"
    "You are a Python coding assistant.Use Python 3 syntax.Write only the code required to "
    "fulfill the user's instruction. Stop after ## End of Code ##.\n\n"
)


def prompt(instruction: Column | str, system: bool = False, fence: bool = False) -> Column:
    return F.concat(
        F.lit((SYSTEM_HEAD if system else "") + INSTRUCTION_HEAD),
        strip(instruction),
        F.lit(RESPONSE_HEAD + (FENCE_OPEN if fence else "")),
    )


def fenced_text(instruction: Column | str, code: Column | str, ending: str = "") -> Column:
    return F.concat(prompt(instruction, fence=True), strip(code), F.lit(FENCE_CLOSE + ending))


def drop_end_marker(code: Column | str) -> Column:
    """The code without the marker that sample building appends."""
    trimmed = strip(code)
    return F.when(
        F.endswith(trimmed, F.lit(CODE_END)),
        F.substr(trimmed, F.lit(1), F.length(trimmed) - len(CODE_END)),
    ).otherwise(trimmed)


def both_filled(instruction: Column | str, code: Column | str) -> Column:
    return (strip(text_or_empty(instruction)) != "") & (strip(text_or_empty(code)) != "")
