"""Declared vendor response schemas (S8) and ``conform``.

A response is landed as text (CSV, JSON, marked text); ``conform`` turns the
raw string columns into the declared types field by field. Dates and
timestamps are parsed with the pattern kept in the field's metadata; a value
that does not parse becomes NULL and its field name is listed in
``_corrupt_fields`` instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Field names, types and formats of the vendor schemas.
# ---------------------------------------------------------------------------
SOURCE_NAME_TRADES = "trades"
SOURCE_NAME_QUOTES = "quotes"
DATE_FMT = "dd/MM/yyyy"
TICK_TS_FMT = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"
SNAPSHOT_TS_FMT = "yyyy-MM-dd'T'HH:mm:ss"
PRICE = T.DecimalType(38, 6)


def _f(name, dtype, fmt=None, comment=None):
    md = {}
    if fmt:
        md["format"] = fmt
    if comment:
        md["comment"] = comment
    return T.StructField(name, dtype, True, md)


def action_request() -> T.StructType:
    """Corporate actions (22 fields, one map)."""
    s = T.StringType()
    return T.StructType([
        _f("IDENTIFIER", s), _f("ID_BB_COMPANY", T.LongType()), _f("ID_BB_SECURITY", T.IntegerType()),
        _f("RC", T.IntegerType()), _f("ACTION_ID", T.LongType()), _f("CP_ACTION_MNEMONIC", s),
        _f("CP_ACTION_FLAG", s), _f("ID_BB_GLOBAL_COMPANY_NAME", s), _f("CA_SECURITY_IDENTIFIER_TYPE", s),
        _f("CA_SECURITY_IDENTIFIER", s), _f("CURRENCY", s), _f("MARKET_SECTOR_DES", s), _f("ID_BB_UNIQUE", s),
        _f("CP_ANN_DATE", T.DateType(), DATE_FMT), _f("CP_EFFECTIVE_DATE", T.DateType(), DATE_FMT),
        _f("CP_AMENDMENT_DATE", T.DateType(), DATE_FMT), _f("ID_BB_GLOBAL", s), _f("ID_BB_GLOBAL_COMPANY", s),
        _f("ID_BB_SEC_NUM_DES", s), _f("FEED_SOURCE", s), _f("NUM_FIELDS", s),
        _f("ACTION_FIELDS", T.MapType(T.StringType(), T.StringType())),
    ])


def _quote_side(side: str):
    s = T.StringType()
    return [
        _f(f"EVT_QUOTE_{side}_TIME", T.TimestampType(), TICK_TS_FMT), _f(f"EVT_QUOTE_{side}_PRICE", PRICE),
        _f(f"EVT_QUOTE_{side}_SIZE", T.LongType()), _f(f"EVT_QUOTE_{side}_CONDITION_CODE", s),
        _f(f"EVT_QUOTE_{side}_LOCAL_EXCH_SRC", s), _f(f"UPFRONT_QUOTED_{side}_PRICE", PRICE),
    ]


def tick_quote_request() -> T.StructType:
    """Tick quotes (15 fields)."""
    head = [_f("SECURITY", T.StringType()), _f("TICK_SEQUENCE_NUMBER", T.LongType()), _f("TICK_TYPE", T.StringType())]
    return T.StructType(head + _quote_side("BID") + _quote_side("ASK"))


def tick_trade_request() -> T.StructType:
    """Tick trades (24 fields)."""
    s = T.StringType()
    ts = T.TimestampType()
    fields = [
        _f("SECURITY", s), _f("TICK_SEQUENCE_NUMBER", T.LongType()), _f("TICK_TYPE", s),
        _f("EVT_TRADE_TIME", ts, TICK_TS_FMT), _f("TRADE_REPORTED_TIME", ts, TICK_TS_FMT),
        _f("EVT_TRADE_EXECUTION_TIME", ts, TICK_TS_FMT), _f("EVT_TRADE_IDENTIFIER", s),
        _f("EVENT_ORIGINAL_TRADE_ID", T.LongType()), _f("EVENT_ORIGINAL_TRADE_TIME", ts, TICK_TS_FMT),
        _f("EVT_TRADE_PRICE", PRICE), _f("EVT_TRADE_SIZE", T.LongType()),
    ]
    for name in ["EVT_TRADE_LOCAL_EXCH_SOURCE", "EVT_TRADE_CONDITION_CODE", "EVT_TRADE_BUY_BROKER",
                 "EVT_TRADE_SELL_BROKER", "TRACE_RPT_PARTY_SIDE_LAST_TRADE", "EVT_TRADE_RPT_PARTY_TYP",
                 "EVT_TRADE_BIC", "EVT_TRADE_MIC", "EVT_TRADE_ESMA_TRADE_FLAGS", "EVT_TRADE_AGGRESSOR",
                 "EVT_TRADE_RPT_CONTRA_TYP", "EVT_TRADE_REMUNERATION", "EVT_TRADE_ATS_INDICATOR"]:
        fields.append(_f(name, s))
    return T.StructType(fields)


def data_request(additional_fields: list[str]) -> T.StructType:
    """Data request response: 6 fixed fields + every requested field as STRING."""
    s = T.StringType()
    fields = [_f("DL_REQUEST_ID", s), _f("DL_REQUEST_NAME", s),
              _f("DL_SNAPSHOT_START_TIME", T.TimestampType(), SNAPSHOT_TS_FMT), _f("DL_SNAPSHOT_TZ", s),
              _f("IDENTIFIER", s), _f("RC", T.IntegerType())]
    return T.StructType(fields + [_f(a, s) for a in additional_fields])


def history_request(additional_fields: list[str]) -> T.StructType:
    """History request response: 4 positional fields + requested fields as STRING."""
    fields = [_f("_c0", T.StringType()), _f("_c1", T.IntegerType()), _f("_c2", T.IntegerType()),
              _f("_c3", T.DateType(), DATE_FMT)]
    return T.StructType(fields + [_f(a, T.StringType()) for a in additional_fields])


#: Time fields whose zone stands in another field of the row.
SNAPSHOT_ZONES = {"DL_SNAPSHOT_START_TIME": "DL_SNAPSHOT_TZ"}


def raw_schema(schema: T.StructType) -> T.StructType:
    """All-string layout of a schema (how text responses are landed)."""
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])


def _typed(c: Column, field: T.StructField) -> Column:
    dt = field.dataType
    fmt = field.metadata.get("format") if field.metadata else None
    if isinstance(dt, T.StringType):
        return c.cast("string")
    if isinstance(dt, T.DateType):
        return F.try_to_date(c, fmt) if fmt else F.try_to_date(c)
    if isinstance(dt, T.TimestampType):
        return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    if isinstance(dt, T.MapType):
        return F.from_json(c, dt)
    return c.try_cast(dt)


def conform(df: DataFrame, schema: T.StructType, corrupt_col: str = "_corrupt_fields",
            keep: list[str] | None = None) -> DataFrame:
    """Cast the raw (string) columns of ``df`` to ``schema``; missing columns become NULL.

    Adds ``corrupt_col``: names of fields that were non-null raw and NULL typed.
    Fields already of the target type are passed through unchanged; ``keep``
    names extra columns carried along unchanged. Each field
    is parsed once: the typed values are projected first and the corrupt list
    is built from them in a second projection (no higher-order function, so
    both stay in whole-stage codegen).
    """
    present = {f.name.lower(): f for f in df.schema.fields}
    typed_cols, raw_cols, checks = [], [], []
    for i, field in enumerate(schema.fields):
        src = present.get(field.name.lower())
        if src is None:
            typed_cols.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        raw = F.col(f"`{src.name}`")
        if src.dataType == field.dataType:
            typed_cols.append(raw.alias(field.name, metadata=dict(field.metadata or {})))
            continue
        typed = _typed(raw, field)
        zone = present.get(SNAPSHOT_ZONES.get(field.name, "").lower())
        if zone is not None:      # a local time with its zone beside it
            typed = F.coalesce(F.to_utc_timestamp(typed, F.col(f"`{zone.name}`")), typed)
        typed_cols.append(typed.alias(field.name, metadata=dict(field.metadata or {})))
        raw_cols.append(raw.isNotNull().alias(f"__raw{i}"))
        checks.append(F.when(F.col(f"__raw{i}") & F.col(f"`{field.name}`").isNull(), F.lit(field.name)))
    keep = list(keep or [])
    step = df.select(*typed_cols, *raw_cols, *keep)
    if checks:
        corrupt = F.array_except(F.array(*checks), F.array(F.lit(None).cast("string")))
    else:
        corrupt = F.array().cast("array<string>")
    return step.select(*[F.col(f"`{f.name}`") for f in schema.fields], corrupt.alias(corrupt_col), *keep)
