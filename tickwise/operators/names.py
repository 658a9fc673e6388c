"""P2/J6 – names that differ in spelling: set-similarity join with a prefix filter.

A name is the set of its character trigrams (lower case, white space folded). Names of equal sets are one class from the
start. Trigrams are ordered from rare to frequent; two sets of Jaccard similarity ``t`` or more must share a trigram among
the first ``|x| - ceil(t |x|) + 1`` of each, so only those rare prefixes are joined. The length of the sets and the place
of the shared trigram bound the overlap. A signature of bits does too: each bit in which two sets differ stands for a
trigram that only one of them has. Both bounds hold for every pair, and the join applies them before a candidate leaves
its task, so that nearly only true pairs are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: 64-bit words of a signature.
WORDS = 4
#: Names of a trigram that are paired with as many others in one group, about.
CELL_NAMES = 4096


def _folded(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def grams(name: Column) -> Column:
    """Distinct trigrams of a name in lower case with one space at each end; of a blank or NULL name none."""
    def of(padded):
        starts = F.sequence(F.lit(1), F.length(padded) - (GRAM - 1))
        return F.array_distinct(F.transform(starts, lambda i: F.substr(padded, i, F.lit(GRAM))))

    # (through an array of one, so that a name is folded once and not for each trigram)
    padded = F.array(F.concat(F.lit(" "), _folded(name), F.lit(" ")))
    return F.when(F.length(_folded(name)) > 0, F.element_at(F.transform(padded, of), 1))


def spelling_classes(names: DataFrame, name: str) -> DataFrame:
    """``name, class``: each different name with the smallest name of the same trigram set."""
    sets = (names.select(F.col(name).cast("string").alias("name")).where(F.length(_folded(F.col("name"))) > 0).distinct()
            .withColumn("grams", F.array_sort(grams(F.col("name")))))
    reps = sets.groupBy("grams").agg(F.min("name").alias("class"))
    return sets.join(reps, "grams").select("name", "class")


def similar_names(names: DataFrame, name: str, threshold: float = 0.7, cell_names: int = CELL_NAMES) -> DataFrame:
    """``name_a, name_b, similarity`` for each pair ``a < b`` of class representatives with Jaccard ``threshold`` or more
    (see ``spelling_classes`` for the members of a class)."""
    reps = (spelling_classes(names, name).select("class").distinct()
            .select(F.col("class").alias("name"), grams(F.col("class")).alias("grams")))
    counts = reps.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # each set in the global order, rare trigrams first, and its signature
    place = F.pmod(F.xxhash64("gram"), F.lit(64 * WORDS)).cast("int")
    word = F.floor(place / 64)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place % 64)
    ordered = (reps.select("name", F.explode("grams").alias("gram")).join(counts, "gram").groupBy("name")
               .agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("_grams"),
                    *[F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"bits{i}") for i in range(WORDS)]))
    ordered = ordered.withColumn("grams", F.transform("_grams", lambda x: x["gram"])).withColumn("size", F.size("grams"))
    t = F.lit(threshold)
    eps = F.lit(1e-9)  # products that are whole numbers must not round up
    prefix = F.col("size") - F.ceil(t * F.col("size") - eps).cast("int") + 1
    bits = [f"bits{i}" for i in range(WORDS)]
    heads = ordered.select("name", "size", *bits, F.posexplode(F.slice("_grams", F.lit(1), prefix)).alias("pos", "_g")).select(
        "name", "size", *bits, "pos", F.col("_g.gram").alias("gram"), F.ceil(F.col("_g.n") / F.lit(cell_names)).cast("int").alias("_cells"))
    # the names of a crowded trigram in cells: every pair of cells is a group of its own
    heads = (heads.withColumn("_own", F.pmod(F.xxhash64("name"), F.col("_cells")).cast("int"))
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)))
             .withColumn("lo", F.least("_own", "_other")).withColumn("hi", F.greatest("_own", "_other")))
    group = ["gram", "lo", "hi"]
    # few bytes make many candidates: as many tasks as the session has partitions, neither broadcast nor coalesced
    heads = heads.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)
    a, b = (heads.where(F.col("_own") == F.col(own)).select(*group, *[F.col(c).alias(f"{c}_{s}") for c in ("name", "size", "pos", *bits)])
            for s, own in (("a", "lo"), ("b", "hi")))
    need = F.ceil(t / (1 + t) * (F.col("size_a") + F.col("size_b")) - eps)
    most = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in bits), F.lit(0))
    pairs = (a.hint("merge").join(b, group).where(apart <= F.col("size_a") + F.col("size_b") - 2 * need)
             .where((F.col("size_a") >= t * F.col("size_b") - eps) & (F.col("size_b") >= t * F.col("size_a") - eps)
                    & (most >= need))
             .where((F.col("lo") < F.col("hi")) | (F.col("name_a") < F.col("name_b")))
             .select(F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b")).distinct())
    sets = ordered.select("name", "grams")
    both = (pairs.join(sets.toDF("name_a", "grams_a"), "name_a").join(sets.toDF("name_b", "grams_b"), "name_b"))
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return (both.withColumn("similarity", shared / (F.size("grams_a") + F.size("grams_b") - shared))
            .where(F.col("similarity") >= t - eps).select("name_a", "name_b", "similarity"))
