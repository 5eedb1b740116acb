"""Substring joins: which texts hold which patterns, by equal keys only, without comparing each with each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docintake.sources.sinks import scratch_path

#: Lengths of the heads by which patterns and places of texts meet: of each pattern the longest that it has.
HEADS = (1, 2, 4, 8, 16, 32)


def held_by(patterns: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``patterns`` (keys, pattern, ...) with rows of ``texts`` (keys, text, ...) that hold the pattern as it
    stands, once for each place: keys and the other columns of both. Empty patterns are left out.

    Places of texts meet the heads of patterns, each with the lengths of its patterns; then what stands there in such a
    length meets the patterns themselves. So rows grow with the texts' lengths, never with patterns times texts. The
    heads are written down: few are sent to the texts, many are joined."""
    spark = patterns.sparkSession
    own = [c for c in patterns.columns if c not in (*keys, "pattern")]
    other = [c for c in texts.columns if c not in (*keys, "text")]
    n = F.length("pattern")
    head = F.coalesce(*(F.when(n >= h, h) for h in reversed(HEADS)))
    path = scratch_path(spark, "heads")
    named = patterns.filter(n > 0).groupBy(*keys, F.substr("pattern", F.lit(1), head).alias("head")).agg(F.collect_set(n).alias("lengths"))
    named.write.parquet(path)
    heads = spark.read.schema(named.schema).parquet(path)
    found = heads.agg(F.collect_set(F.length("head")), F.max(F.array_max("lengths"))).first()
    if not found[0]:
        return patterns.join(texts.drop("text"), keys).select(*keys, "pattern", *own, *other).limit(0)
    size = F.explode(F.lit(sorted(found[0]))).alias("size")
    places = texts.filter(F.length("text") >= min(found[0])).select(*keys, *other, "text", F.explode(F.sequence(F.lit(1), F.length("text") - min(found[0]) + 1)).alias("at"))
    places = places.select(*keys, *other, F.substr("text", F.col("at"), F.lit(found[1])).alias("rest")).select("*", size).filter(F.length("rest") >= F.col("size"))
    met = places.withColumn("head", F.substr("rest", F.lit(1), F.col("size"))).join(heads, [*keys, "head"])
    cut = met.select(*keys, *other, "rest", F.explode("lengths").alias("length")).filter(F.length("rest") >= F.col("length"))
    cut = cut.select(*keys, *other, F.substr("rest", F.lit(1), F.col("length")).alias("pattern"))
    return cut.join(patterns, [*keys, "pattern"]).select(*keys, "pattern", *own, *other)
