"""Prompts of generation tasks, as columns: a text in the template of its task, unless it is a formed prompt already."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_empty, trim_ws

#: The headings of a prompt, marks of texts that are prompts already, and the task of unknown names.
INSTRUCTION, INPUT, RESPONSE = "### Instruction:\n", "### Input:\n", "### Response:\n"
FORMED = ("### Instruction:", "<|begin_of_text|>")
DEFAULT_TASK, DEFAULT_STYLE, DEFAULT_LENGTH = "grammar", "formal", "medium"
#: What each task asks for; {style} and {length} are filled in where a task has them.
ASKED = {
    "grammar": "Correct the grammar and the spelling of the text. Change nothing else.",
    "style": "Rewrite the article in a {style} style.",
    "summarizer": "Write a {length} summary of the article.",
    "headline": "Write a {length} headline for the article.",
}
#: Said behind the instruction of tasks that rewrite a whole article.
FACT_RULES = {"style": "Keep all names, numbers and dates as they are. Add nothing that the article does not say."}


def build_prompt(task: Column, text: Column, style: Column | None = None, length: Column | None = None) -> Column:
    """formed prompts pass unchanged; other texts are trimmed and put into the template of their task. An unknown or null task means DEFAULT_TASK, a null text an empty one."""
    text = text_or_empty(text)
    style = F.coalesce(style if style is not None else F.lit(None), F.lit(DEFAULT_STYLE))
    length = F.coalesce(length if length is not None else F.lit(None), F.lit(DEFAULT_LENGTH))

    def template(name: str) -> Column:
        asked = F.replace(F.replace(F.lit(ASKED[name]), F.lit("{style}"), style), F.lit("{length}"), length)
        rules = [F.lit(FACT_RULES[name] + "\n\n")] if name in FACT_RULES else []
        return F.concat(F.lit(INSTRUCTION), asked, F.lit("\n\n"), *rules, F.lit(INPUT), trim_ws(text), F.lit("\n\n" + RESPONSE))

    out = F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(mark)) for mark in FORMED)), text)
    for name in ASKED:
        if name != DEFAULT_TASK:
            out = out.when(task == name, template(name))
    return out.otherwise(template(DEFAULT_TASK))
