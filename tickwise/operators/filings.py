"""Filings text analytics and embedding.

Texts are tokenised whole (letter runs, lower case) and matched against a lexicon of words and phrases along its
token trie (``lexicon``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .lexicon import lexicon, matches


def link_mentions(chunks: DataFrame, aliases: dict[str, str] | DataFrame, doc: str = "chunk_id",
                  text: str = "content") -> DataFrame:
    """J6 – mentions of holdings (by alias word or phrase) in each chunk: (doc, ticker, n_mentions).

    ``aliases`` is a table (alias, ticker), e.g. company names of the entity data, or a small dictionary.
    """
    hits = matches(chunks, [doc], text, lexicon(chunks.sparkSession, aliases))
    return hits.groupBy(doc, F.col("value").alias("ticker")).agg(F.count(F.lit(1)).alias("n_mentions"))


def risk_signals(chunks: DataFrame, terms: dict[str, str] | DataFrame, ticker: str = "symbol",
                 text: str = "content") -> DataFrame:
    """A14/X20 – risk-signal term counts by ticker and signal family."""
    hits = matches(chunks, [ticker], text, lexicon(chunks.sparkSession, terms))
    return hits.groupBy(ticker, F.col("value").alias("signal")).agg(F.count(F.lit(1)).alias("n_hits"))


def theme_exposure(h: DataFrame, chunks: DataFrame, terms: list[str], ticker: str = "symbol",
                   text: str = "content", holding_key: str = "ticker") -> DataFrame:
    """P13 – holdings of companies whose filings mention any theme word or phrase (semi-join)."""
    hits = matches(chunks, [ticker], text, lexicon(chunks.sparkSession, {t: "" for t in terms}))
    return h.join(hits.select(F.col(ticker).alias(holding_key)).distinct(), holding_key, "left_semi")


def embed(df: DataFrame, text: str = "content", num_features: int = 1 << 18, out: str = "embedding",
          idf: bool = True) -> DataFrame:
    """F4 – text → L2-normalised TF-IDF vector (hashing TF, so no vocabulary on the driver).

    ``idf=False`` gives the stateless form (hashing TF, L2-normalised): each row's
    vector depends on its own text only, so an index synced batch by batch stays
    consistent across versions.
    """
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    with_tokens = df.withColumn("_tokens", tokens(text))
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features).transform(with_tokens)
    if idf:
        tf = IDF(inputCol="_tf", outputCol="_w").fit(tf).transform(tf)
    else:
        tf = tf.withColumnRenamed("_tf", "_w")
    vec = Normalizer(inputCol="_w", outputCol=out, p=2.0).transform(tf)
    return vec.drop("_tokens", "_tf", "_w")
