"""Column expressions (scalar rules of the application)."""
from .text import *  # noqa: F401,F403
from .guardrail import guardrail_category, guardrail_message, is_guardrail  # noqa: F401
