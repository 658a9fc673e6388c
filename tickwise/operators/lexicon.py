"""Dictionary matching along a token trie.

A lexicon is a table of terms (words or phrases) with a value each. Its trie has one row per distinct prefix of a
term. A text is cut into letter runs; a position is kept only if its token is the first of some term, and is then
extended token by token along the trie for as long as some term goes on, so a position meets at most one row per
depth, however many terms share a first token. No n-gram is built that no term begins with.

The trie is the built side of every join. It is broadcast while it is small, which is checked; beyond that the
positions carry the few tokens that the longest term needs and are joined by first token, then by longer prefixes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Prefixes up to which a trie is broadcast (some tens of MB).
BROADCAST_PREFIXES = 200_000


@dataclass(frozen=True)
class Lexicon:
    """``entries`` (``term, value``), ``trie`` (``prefix, depth, ends, goes_on``), the tokens of the longest term and whether
    the trie is small enough to be broadcast."""

    entries: DataFrame
    trie: DataFrame
    longest: int
    small: bool


def normalised(term: str) -> str:
    """A term as its letter runs, lower case, one space between (the form in which texts are cut)."""
    return " ".join(re.findall(r"[^\W\d_]+", term.lower()))


def lexicon(spark: SparkSession, terms: dict[str, str] | DataFrame, broadcast_prefixes: int = BROADCAST_PREFIXES) -> Lexicon:
    """The lexicon of a dictionary, or of a table whose first two columns are term and value. Terms without a letter
    match nothing; a term with several values counts for each."""
    if isinstance(terms, DataFrame):
        term, value = terms.columns[:2]
        entries = terms.select(F.array_join(tokens(term), " ").alias("term"), F.col(value).alias("value"))
        entries = entries.where(F.col("term") != "").distinct()
    else:
        rows = sorted({(normalised(k), v) for k, v in terms.items() if normalised(k)})
        entries = spark.createDataFrame(rows, "term string, value string")
    parts = entries.select(F.split("term", " ").alias("_w")).distinct()
    trie = (parts.select("_w", F.explode(F.sequence(F.lit(1), F.size("_w"))).alias("depth"))
            .groupBy(F.array_join(F.slice("_w", F.lit(1), F.col("depth")), " ").alias("prefix"), "depth")
            .agg(F.max(F.col("depth") == F.size("_w")).alias("ends"), F.max(F.col("depth") < F.size("_w")).alias("goes_on")))
    if isinstance(terms, DataFrame):
        longest, size = trie.agg(F.max("depth"), F.count(F.lit(1))).first()
    else:
        longest = max((t.count(" ") + 1 for t, _ in rows), default=0)
        size = sum(t.count(" ") + 1 for t, _ in rows)
    return Lexicon(entries, trie, longest or 0, size <= broadcast_prefixes)


def matches(texts: DataFrame, keys: list[str], text: str, lex: Lexicon) -> DataFrame:
    """One row per place where ``text`` holds a term: ``keys``, ``term``, ``value``. Overlapping terms all count."""
    def built(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if lex.small else df

    def level(depth: int) -> DataFrame:
        return built(lex.trie.where(F.col("depth") == depth).select(
            F.col("prefix").alias("_prefix"), F.col("ends").alias("_ends"), F.col("goes_on").alias("_goes")))

    # (outer: the planner would cut the text again to filter out empty ones; the join drops them anyway)
    found = texts.select(*keys, tokens(text).alias("_w")).select(*keys, "_w", F.posexplode_outer("_w").alias("_p", "_t"))
    ahead = F.slice("_w", F.col("_p") + 1, max(1, lex.longest)).alias("_ahead")
    if not lex.small:  # rows will be shuffled: with the tokens they may need, not with the whole text
        found = found.select(*keys, ahead, "_t")
        found = found.join(level(1), F.col("_t") == F.col("_prefix"))
    else:
        found = found.join(level(1), F.col("_t") == F.col("_prefix"))
        found = found.select(*keys, ahead, "_prefix", "_ends", "_goes")
    found = found.select(*keys, "_ahead", F.when(F.col("_ends"), F.col("_prefix")).alias("_hit1"),
                         F.when(F.col("_goes"), F.col("_prefix")).alias("_at"))
    for depth in range(2, lex.longest + 1):
        longer = F.concat("_at", F.lit(" "), F.get("_ahead", F.lit(depth - 1)))  # null behind the end of the text
        hits = [f"_hit{i}" for i in range(1, depth)]
        found = (found.withColumn("_longer", longer).join(level(depth), F.col("_longer") == F.col("_prefix"), "left")
                 .select(*keys, "_ahead", *hits, F.when(F.col("_ends"), F.col("_prefix")).alias(f"_hit{depth}"),
                         F.when(F.col("_goes"), F.col("_prefix")).alias("_at")))
    hits = F.array_compact(F.array(*[F.col(f"_hit{i}") for i in range(1, max(1, lex.longest) + 1)]))
    return found.select(*keys, F.explode(hits).alias("term")).join(built(lex.entries), "term")
