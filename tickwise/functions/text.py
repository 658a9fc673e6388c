"""Scalar Column expressions (string, identifier and label rules).

Every function here builds a plain Catalyst expression, so it stays inside
whole-stage codegen and is pushed down wherever Catalyst can push it. None of
them calls back into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the semantics of the source application)
# ---------------------------------------------------------------------------
# Characters for which Python's ``str.isspace()`` is true; ``str.strip()`` and
# ``str.split()`` use exactly this set. Written as a regex character class that
# both Java regex and RE2 accept.
PY_WHITESPACE_CLASS = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
DEFAULT_MARKET = "US"
REQUEST_ID_MAX_LEN = 21
RESPONSE_URL_TEMPLATE = "%s/catalogs/%s/content/responses/%s"
POLICY_ERROR_HEADER = "[ERROR] Content policy violation detected."


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(col(c), rf"^{PY_WHITESPACE_CLASS}+|{PY_WHITESPACE_CLASS}+$", "")


def first_token(c) -> Column:
    """X1 – text before the first space (whole text if none); NULL stays NULL."""
    return F.substring_index(col(c), " ", 1)


def normalise_ticker(c, market: str = DEFAULT_MARKET) -> Column:
    """P1 – ``"BG US Equity"`` → ``"BG-US"``. Builtin replacement of the row UDF."""
    return F.concat(first_token(c), F.lit(f"-{market}"))


def ticker_root(c, overrides: dict[str, str] | None = None) -> Column:
    """P2 – market-independent root of a ticker (``BG-US``, ``BG LN Equity`` → ``BG``).

    Class-share tickers contain ``-`` themselves (``BRK-B``); list them in
    ``overrides`` (full ticker → root), which is consulted first.
    """
    root = F.regexp_extract(col(c), r"^([^\s\-]+)", 1)
    if not overrides:
        return root
    m = F.create_map(*[F.lit(x) for kv in sorted(overrides.items()) for x in kv])
    return F.coalesce(F.try_element_at(m, col(c)), root)


def last_part(c, sep: str) -> Column:
    """X2 – Python ``s.split(sep)[-1]``."""
    import re
    return F.element_at(F.split(col(c), re.escape(sep)), -1)


def after_first_space(c) -> Column:
    """X3 – Python ``s.split(' ', 1)[-1]``."""
    return F.regexp_replace(col(c), r"^[^ ]* ", "")


def file_stem(c) -> Column:
    """X4 – ``os.path.splitext(name)[0]``; a name made of leading dots keeps them."""
    return F.regexp_replace(col(c), r"(?s)^((?:.*/)?\.*[^./][^/]*)\.[^./]*$", "$1")


def citation_label(document_name, document_type, section_number) -> Column:
    """X5 – ``stem`` or ``stem (type, section n)`` when both stripped values are non-empty."""
    stem = file_stem(last_part(document_name, "/"))
    t = py_strip(document_type)
    s = py_strip(section_number)
    return F.when(
        (F.length(t) > 0) & (F.length(s) > 0),
        F.concat(stem, F.lit(" ("), t, F.lit(", section "), s, F.lit(")")),
    ).otherwise(stem)


def reference_label(n) -> Column:
    """X6 – ``"<n> reference(s)"``."""
    return F.concat(col(n).cast("string"), F.lit(" reference(s)"))


def escape_dollar(c) -> Column:
    """``$`` → ``\\$`` (not idempotent, as in the source application)."""
    return F.replace(col(c), F.lit("$"), F.lit("\\$"))


def clean_text(c) -> Column:
    """X7 – escape ``$`` then strip like Python."""
    return py_strip(escape_dollar(c))


def policy_error(message) -> Column:
    """X10 – two-line error text."""
    return F.concat_ws("\n", F.lit(POLICY_ERROR_HEADER), col(message))


def request_id(ts, key) -> Column:
    """X11 – ``r`` + yyyyMMddHHmmss + 6 hex characters (21 characters).

    The hex part is taken from a hash of ``key`` instead of a random draw, so a
    retried task produces the same identifier.
    """
    return F.concat(
        F.lit("r"),
        F.date_format(col(ts), "yyyyMMddHHmmss"),
        F.substring(F.sha2(col(key).cast("string"), 256), 1, 6),
    )


def media_type(c) -> Column:
    """X12 – media type before the first ``;``."""
    return F.substring_index(col(c), ";", 1)


def digest_algorithm(c) -> Column:
    """X13 – upper-cased algorithm before the first ``=``."""
    return F.upper(F.get(F.split(col(c), "="), 0))


def digest_value(c) -> Column:
    """X13 – element 1 of the split on ``=`` (base64 padding is lost); NULL if absent."""
    return F.get(F.split(col(c), "="), 1)


def base_identifier(c) -> Column:
    """X14 – identifier before the first ``.``."""
    return F.substring_index(col(c), ".", 1)


def minutes_between(a, b) -> Column:
    """X15 – minutes from ``a`` to ``b`` as a double."""
    return F.timestamp_diff("MICROSECOND", col(a), col(b)) / F.lit(60_000_000.0)


def iso_date(c) -> Column:
    """X16 – ``%Y-%m-%d``."""
    return F.date_format(col(c), "yyyy-MM-dd")


def compact_ts(c) -> Column:
    """X16 – ``%Y%m%d%H%M%S``."""
    return F.date_format(col(c), "yyyyMMddHHmmss")


def row_json(*cols) -> Column:
    """X17 – one JSON object per row (NULL fields are omitted)."""
    return F.to_json(F.struct(*[col(c) for c in cols]))


def response_url(host, catalog, key) -> Column:
    """X18 – download URL of a response."""
    return F.format_string(RESPONSE_URL_TEMPLATE, col(host), col(catalog), col(key))


def capitalise(c) -> Column:
    """X19 – Python ``str.capitalize()`` (first character upper, rest lower)."""
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def words(c) -> Column:
    """X20 – Python ``s.split()``: array of whitespace-separated words."""
    parts = F.split(col(c), f"{PY_WHITESPACE_CLASS}+")
    return F.filter(parts, lambda w: F.length(w) > 0)


def lookup(m, key: str, default=None) -> Column:
    """X21 – ``m.get(key, default)`` on a map column."""
    v = F.try_element_at(col(m), F.lit(key))
    return v if default is None else F.coalesce(v, F.lit(default))


def action_field(m, key: str) -> Column:
    """X22 – one entry of the corporate-action field map."""
    return F.try_element_at(col(m), F.lit(key))


def tokens(c) -> Column:
    """Lower-cased letter runs of a text (whole text, any script); cut at what is between, which is several times
    faster than extracting every match."""
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}]+"), lambda w: w != "")
