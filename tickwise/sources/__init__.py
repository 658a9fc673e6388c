"""Readers of vendor responses, configuration files and declared schemas."""
from .readers import *  # noqa: F401,F403
from .schemas import (action_request, conform, data_request, history_request, raw_schema,  # noqa: F401
                      tick_quote_request, tick_trade_request)
