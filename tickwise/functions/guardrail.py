"""Guardrail-error classification (X8, X9) as VARIANT expressions.

An error body is JSON. When its ``message`` member is a *string*, that string
is parsed as JSON and inspected instead of the body itself. ``get_json_object``
cannot tell a string member from an object member, so the body is parsed into a
VARIANT and the member's type is read with ``schema_of_variant``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# ---------------------------------------------------------------------------
# Category precedence and the user-facing messages.
# ---------------------------------------------------------------------------
GUARDRAIL_KEY = "output_guardrail"
MSG_SPECIALIZED_ADVICE = (
    "I'm unable to provide specific financial advice or recommendations. "
    "I can help you with general market data analysis or factual information instead. "
    "Please rephrase your question to focus on data extraction or general market insights."
)
MSG_HATE = "I can't provide content that contains hate speech or discriminatory language."
MSG_VIOLENCE = "I can't provide content related to violence or violent activities."
MSG_SEXUAL = "I can't provide sexual content or content related to sexual crimes."
MSG_PRIVACY = "I can't provide content that may violate privacy guidelines."
MSG_DEFAULT = (
    "I'm unable to process this request due to content policy restrictions. "
    "Please try rephrasing your question or ask for general information instead."
)
# (category label, flags that select it, message) in precedence order
CATEGORY_RULES = [
    ("specialized-advice", ["specialized-advice"], MSG_SPECIALIZED_ADVICE),
    ("hate", ["hate"], MSG_HATE),
    ("violence", ["violence", "violent-crimes"], MSG_VIOLENCE),
    ("sexual", ["sexual-content", "sex-crimes"], MSG_SEXUAL),
    ("privacy", ["privacy"], MSG_PRIVACY),
]


def guardrail_root(c) -> Column:
    """The JSON text that holds ``output_guardrail``: the nested message or the body."""
    body = F.try_parse_json(col(c))
    message = F.try_variant_get(body, "$.message", "variant")
    message_is_string = F.schema_of_variant(message) == F.lit("STRING")
    return F.when(message_is_string, F.try_variant_get(body, "$.message", "string")).otherwise(col(c))


def is_guardrail_root(root) -> Column:
    """True when ``root`` is a JSON object with an ``output_guardrail`` member."""
    return F.coalesce(F.array_contains(F.json_object_keys(col(root)), F.lit(GUARDRAIL_KEY)), F.lit(False))


def is_guardrail(c) -> Column:
    """X8 – True when the (possibly nested) JSON object has an ``output_guardrail`` member."""
    return is_guardrail_root(guardrail_root(c))


def _flag(root_variant: Column, name: str) -> Column:
    path = f"$.{GUARDRAIL_KEY}[0].categories['{name}']"
    v = F.try_variant_get(root_variant, path, "variant")
    # JSON ``true`` only: a flag must be a boolean to select a category.
    return F.coalesce((F.schema_of_variant(v) == F.lit("BOOLEAN")) & F.try_variant_get(root_variant, path, "boolean"),
                      F.lit(False))


def category_of_variant(v) -> Column:
    """X9 on an already parsed root: first matching category in precedence order, else ``default``."""
    v = col(v)
    expr = F.lit("default")
    for label, flags, _ in reversed(CATEGORY_RULES):
        cond = _flag(v, flags[0])
        for extra in flags[1:]:
            cond = cond | _flag(v, extra)
        expr = F.when(cond, F.lit(label)).otherwise(expr)
    return expr


def guardrail_category(c) -> Column:
    """X9 – first matching category in precedence order, else ``default``."""
    return category_of_variant(F.try_parse_json(guardrail_root(c)))


def message_of_category(cat) -> Column:
    """X9 – friendly message of a category."""
    cat = col(cat)
    expr = F.lit(MSG_DEFAULT)
    for label, _, msg in reversed(CATEGORY_RULES):
        expr = F.when(cat == F.lit(label), F.lit(msg)).otherwise(expr)
    return expr


def guardrail_message(c) -> Column:
    """X9 – friendly message of the selected category."""
    return message_of_category(guardrail_category(c))
