"""Prompt and completion text of question-answer rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.scalars import strip

# Wording the prompts must carry exactly.
SYSTEM_PARTS = ("<Título>\n", "\n</Título>\n<Contexto>\n", "\n</Contexto>")
NO_ANSWER = "No responde"
TEXT_START = "<|begin_of_text|>"
DATE_PREAMBLE = r"(?s)Cutting Knowledge Date:.*?\nToday Date:.*?\n\n"


@dataclass(frozen=True)
class ChatTemplate:
    """How one message is written; ``{role}`` and ``{content}`` are replaced.

    The default writes ChatML.
    """

    message: str = "<|im_start|>{role}\n{content}<|im_end|>\n"
    generation: str = "<|im_start|>assistant\n"
    begin: str = ""
    eos: str = "<|im_end|>"

    def render(self, role: str, content: Column) -> Column:
        head, tail = self.message.replace("{role}", role).split("{content}")
        return F.concat(F.lit(head), content, F.lit(tail))


def system_message(title: Column, context: Column) -> Column:
    """The system turn built from a document's title and context."""
    opening, between, closing = map(F.lit, SYSTEM_PARTS)
    return F.concat(opening, title, between, context, closing)


def answer_or_default(text: Column) -> Column:
    """SCL-15: stripped answer; an empty one reads as the default wording.

    Emptiness is tested first, so an answer of blanks becomes an empty text.
    """
    return F.when(F.length(text) > 0, strip(text)).otherwise(F.lit(NO_ANSWER))


def drop_date_preamble(prompt: Column) -> Column:
    """SCL-17: remove every date preamble a template may have added."""
    return F.regexp_replace(prompt, DATE_PREAMBLE, "")


def chat_prompt(
    title: Column,
    context: Column,
    question: Column,
    template: ChatTemplate = ChatTemplate(),
    answer: Column | None = None,
) -> Column:
    """SCL-16: system and user turns, then the answer or the marker to write one.

    Without an ``answer`` column every row ends in the generation marker.  With
    one, a null answer gets the marker, a text its assistant turn, and an empty
    text neither.
    """
    text = F.concat(
        F.lit(template.begin),
        template.render("system", system_message(title, context)),
        template.render("user", question),
    )
    if answer is None:
        ending: Column = F.lit(template.generation)
    else:
        ending = (
            F.when(answer.isNull(), F.lit(template.generation))
            .when(F.length(answer) > 0, template.render("assistant", answer))
            .otherwise(F.lit(""))
        )
    return drop_date_preamble(F.replace(F.concat(text, ending), F.lit(TEXT_START), F.lit("")))


def completion(answer: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """SCL-18: the answer closed by the end-of-text token."""
    return F.concat(answer, F.lit(template.eos))
