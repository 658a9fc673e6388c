"""Tool catalog and message-log fixtures derived from the events table.

The catalog is configuration (a few tools per provider, in provider order).
Events are read as a tool-call log: each event type names one tool function,
and error events carry a guardrail error body chosen from their ``k`` value.
Spark expressions and their SQL twins are kept side by side.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guardrail import CATEGORY_RULES, MSG_DEFAULT
from ..sources.readers import tool_catalog_from_json

# ---------------------------------------------------------------------------
# The tool catalog (provider → tools, in order)
# ---------------------------------------------------------------------------
DOC_COLUMNS = ["chunk_id", "document_name", "document_type", "company_name", "section_number", "symbol",
               "content"]
TOOL_CATALOG = {
    "filings": [
        {"tool_id": "filings_search", "tool_name": "Corporate filings", "tool_enabled": True,
         "tool_type": "vector", "tool_description": "Public filings with vector search",
         "tool_coordinates": "analytics.research.filings_index",
         "tool_description_details": "Search filings and disclosures by similarity", "tool_columns": DOC_COLUMNS},
        {"tool_id": "news_search", "tool_name": "News", "tool_enabled": False, "tool_type": "vector",
         "tool_description": "Latest news with vector search", "tool_coordinates": "analytics.research.news_index",
         "tool_description_details": "Search news by similarity", "tool_columns": DOC_COLUMNS},
    ],
    "market": [
        {"tool_id": "market_analytics", "tool_name": "Market data", "tool_enabled": True, "tool_type": "genie",
         "tool_description": "Market data and fundamentals", "tool_coordinates": "analytics.market.market_space",
         "tool_description_details": "Daily returns, top performers, volatility, most traded, industry stats"},
        {"tool_id": "market_filings", "tool_name": "Market filings mirror", "tool_enabled": False,
         "tool_type": "vector", "tool_description": "Mirror of the filings index",
         "tool_coordinates": "analytics.market.filings_index",
         "tool_description_details": "Same function name as the filings index", "tool_columns": DOC_COLUMNS},
    ],
    "portfolio": [
        {"tool_id": "portfolio_holdings", "tool_name": "Equity holdings", "tool_enabled": True,
         "tool_type": "function", "tool_description": "Portfolio positions",
         "tool_coordinates": "analytics.portfolio.get_portfolio_data",
         "tool_description_details": "Positions with company reference data"},
    ],
}
# event type → called tool function (catalog__schema__name)
EVENT_FUNCTIONS = {
    "view": "analytics__research__filings_index",
    "click": "analytics__portfolio__get_portfolio_data",
    "purchase": "analytics__market__market_space",
    "signup": "analytics__research__news_index",
    "error": "analytics__misc__unknown_tool",
}


def tool_catalog(spark: SparkSession) -> DataFrame:
    """The catalog as a flat DataFrame (provider, provider_pos, tool_pos, tool fields)."""
    text = spark.createDataFrame([(json.dumps(TOOL_CATALOG),)], "value string")
    return tool_catalog_from_json(text)


def function_name_of(event_type: Column) -> Column:
    expr = None
    for et, fn in EVENT_FUNCTIONS.items():
        expr = (F.when(event_type == et, F.lit(fn)) if expr is None
                else expr.when(event_type == et, F.lit(fn)))
    return expr


FUNCTION_NAME_SQL = "CASE event_type " + " ".join(
    f"WHEN '{et}' THEN '{fn}'" for et, fn in EVENT_FUNCTIONS.items()) + " END"


def _catalog_rows():
    for pos, (provider, tools) in enumerate(TOOL_CATALOG.items()):
        for t in tools:
            yield provider, pos, t


CATALOG_VALUES_SQL = ", ".join(
    f"('{t['tool_coordinates'].split('.')[-1]}', '{p}', {pos})" for p, pos, t in _catalog_rows())
CATALOG_FULL_VALUES_SQL = ", ".join(
    f"('{t['tool_id']}', '{p}', '{t['tool_type']}', {str(t['tool_enabled']).lower()}, "
    f"'{t['tool_coordinates'].split('.')[-1]}')" for p, pos, t in _catalog_rows())

# ---------------------------------------------------------------------------
# Guardrail error bodies, selected by ``k mod 8`` of an error event
# ---------------------------------------------------------------------------
GUARDRAIL_BODIES = [
    r'{"message": "{\"output_guardrail\":[{\"categories\":{\"privacy\":true}}]}"}',
    r'{"output_guardrail":[{"categories":{"hate":true,"specialized-advice":true}}]}',
    r'{"message": {"code": 400}, "output_guardrail":[{"categories":{"violent-crimes":true}}]}',
    r'{"output_guardrail":[]}',
    r'{"message": "not json"}',
    r'{"output_guardrail":[{"categories":{"sex-crimes":true,"privacy":true}}]}',
    r'{}',
    r'{"output_guardrail":[{"categories":{"hate":false,"privacy":true}}]}',
]


def guardrail_body(props: Column) -> Column:
    m = F.pmod(F.get_json_object(props, "$.k").cast("int"), F.lit(len(GUARDRAIL_BODIES)))
    expr = F.when(m == 0, F.lit(GUARDRAIL_BODIES[0]))
    for i, b in enumerate(GUARDRAIL_BODIES[1:], start=1):
        expr = expr.when(m == i, F.lit(b))
    return expr


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


GUARDRAIL_BODY_SQL = (f"CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % {len(GUARDRAIL_BODIES)} "
                      + " ".join(f"WHEN {i} THEN {_sql_str(b)}" for i, b in enumerate(GUARDRAIL_BODIES))
                      + " END")


def _flag_sql(name: str) -> str:
    path = f"'$.output_guardrail[0].categories.\"{name}\"'"
    return (f"coalesce(json_type(root, {path}) = 'BOOLEAN' "
            f"AND json_extract_string(root, {path}) = 'true', false)")


GUARDRAIL_CATEGORY_SQL = "CASE " + " ".join(
    f"WHEN {' OR '.join(_flag_sql(f) for f in flags)} THEN '{label}'" for label, flags, _ in CATEGORY_RULES
) + " ELSE 'default' END"
GUARDRAIL_MESSAGE_SQL = "CASE category " + " ".join(
    f"WHEN '{label}' THEN {_sql_str(msg)}" for label, _, msg in CATEGORY_RULES
) + f" ELSE {_sql_str(MSG_DEFAULT)} END"
