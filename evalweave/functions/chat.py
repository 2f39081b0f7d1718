"""Chat-style prompt and completion columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evalweave.functions.text import clean_answer


def message(role: str, content: Column) -> Column:
    """One chat message."""
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_prompt(system_prompt: str, instruction: Column, question: Column) -> Column:
    """System message (prompt text and instruction, directly joined) and user message."""
    return F.array(
        message("system", F.concat(F.lit(system_prompt), instruction)),
        message("user", question),
    )


def chat_completion(answer: Column) -> Column:
    """The assistant's message."""
    return F.array(message("assistant", answer))


def question_of(prompt: Column) -> Column:
    """Content of the first user message, ``''`` without one."""
    asked = F.filter(prompt, lambda m: m["role"] == "user")
    return F.coalesce(F.get(asked, F.lit(0))["content"], F.lit(""))


def reference_of(completion: Column) -> Column:
    """Cleaned content of the first completion message; NULL when there is no message."""
    first = F.get(completion, F.lit(0))
    return F.when(first.isNotNull(), clean_answer(first["content"]))


def render(
    prompt: Column,
    before_role: Column,
    after_role: Column,
    after_message: Column,
    generation_header: Column,
    no_think_suffix: Column,
) -> Column:
    """Prompt text in a model's chat format; a message without content gives NULL."""
    body = F.array_join(
        F.transform(
            prompt,
            lambda m: F.concat(before_role, m["role"], after_role, m["content"], after_message),
        ),
        "",
    )
    text = F.concat(body, generation_header, F.coalesce(no_think_suffix, F.lit("")))
    return F.when(~F.exists(prompt, lambda m: m["content"].isNull()), text)
