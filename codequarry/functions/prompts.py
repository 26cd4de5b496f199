"""Prompt and chat rendering as Column expressions.

A template is split once on its ``{slot}`` markers into literal pieces and
slots; the Spark form is ``concat(lit, col, lit, ...)`` and the oracle form
is the same concatenation in SQL, so both engines render byte-identical text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import catalog

_SLOT = re.compile(r"\{(\w+)\}")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def template_parts(template: str) -> list[tuple[str, str]]:
    """[('lit', text) | ('slot', name), ...] in template order."""
    parts, pos = [], 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(("lit", template[pos:m.start()]))
        parts.append(("slot", m.group(1)))
        pos = m.end()
    if pos < len(template):
        parts.append(("lit", template[pos:]))
    return parts


def fill(template: str, **slots) -> Column:
    """Render ``template`` with Columns (or column names) for its slots."""
    pieces = [F.lit(v) if k == "lit" else _c(slots[v]) for k, v in template_parts(template)]
    return F.concat(*pieces)


def sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_fill(template: str, **slots: str) -> str:
    """SQL twin of :func:`fill`; ``slots`` are SQL expressions."""
    pieces = [sql_literal(v) if k == "lit" else f"({slots[v]})" for k, v in template_parts(template)]
    return "(" + " || ".join(pieces) + ")"


# --- QA answering prompts ----------------------------------------------------

PROMPT_MODES = ("with_code", "question_only", "raw")


def qa_prompt(code, question, mode: str) -> Column:
    """Answering prompt: with code, question only, or the raw code."""
    if mode == "with_code":
        return fill(catalog.QA_TEMPLATE_WITH_CODE, prompt=code, question=question)
    if mode == "question_only":
        return fill(catalog.QA_TEMPLATE_QUESTION_ONLY, question=question)
    if mode == "raw":
        return _c(code)
    raise ValueError(f"unknown prompt mode {mode!r}; expected one of {PROMPT_MODES}")


def qa_prompt_by_column(code, question, mode_col) -> Column:
    """Same, with the mode read per row from a column."""
    m = _c(mode_col)
    return (F.when(m == "with_code", qa_prompt(code, question, "with_code"))
             .when(m == "question_only", qa_prompt(code, question, "question_only"))
             .when(m == "raw", _c(code)))


def summarize_prompt(code) -> Column:
    return fill(catalog.SUMMARIZE_TEMPLATE, code=code)


def codegen_prompt(code, summary) -> Column:
    return fill(catalog.CODEGEN_TEMPLATE, prompt=code, summary=summary)


ANSWER_MODES = (*PROMPT_MODES, "summarize", "fewshot", "codegen")


def answer_prompt(code, question, mode: str, examples=None) -> Column:
    """Prompt of the answering job: the Q/A modes, or a summary of the code, without or with
    worked ``examples`` (a text), or the code to go with a summary (the question)."""
    if mode == "summarize":
        return summarize_prompt(code)
    if mode == "codegen":
        return codegen_prompt(code, question)
    if mode == "fewshot":
        if examples is None:
            raise ValueError("mode fewshot needs examples")
        return fewshot_prompt(code, examples)
    return qa_prompt(code, question, mode)


def fewshot_example(inp, out) -> Column:
    return fill(catalog.FEWSHOT_EXAMPLE_TEMPLATE, input=inp, output=out)


def fewshot_prompt(code, examples_text) -> Column:
    return fill(catalog.FEWSHOT_SUMMARIZE_TEMPLATE, fewshot_examples=examples_text, code=code)


def edge_case_prompt(code) -> Column:
    """One-shot prompt asking for three edge-case questions with answers."""
    return fill(catalog.EDGE_CASE_TEMPLATE, code=code)


def question_turn(code, instruction) -> Column:
    """User turn asking for a question/rewrite: code, blank line, instruction; NULL without code."""
    return F.concat(_c(code), F.lit("\n\n"), _c(instruction))


# --- chat rendering ------------------------------------------------------------

def chat_segment(role, text) -> Column:
    """One message with simple role markers: '<|role|>\\n' text '\\n'."""
    return F.concat(F.lit("<|"), _c(role), F.lit("|>\n"), _c(text), F.lit("\n"))


GENERATION_PROMPT = "<|assistant|>\n"


def user_message(prompt) -> Column:
    """Single-user-message list: [{role: 'user', content: prompt}]."""
    return F.array(F.struct(F.lit("user").alias("role"), _c(prompt).alias("content")))


def render_messages(messages, add_generation_prompt: bool = True) -> Column:
    """Render an in-row message list (bounded by construction) to chat text."""
    body = F.array_join(F.transform(_c(messages), lambda m: chat_segment(m["role"], m["content"])), "")
    return F.concat(body, F.lit(GENERATION_PROMPT)) if add_generation_prompt else body
