"""A corpus pipeline: each stage reads what the one before it wrote.

toxicity -> quality -> near-duplicates -> packing. The first three return the columns of documents; the last
returns one row per packed piece.

Defined cases, for ``run`` and each stage: null and empty texts are scored as such, have no shingles and so are no
copies, and are packed as one end token; very long texts are scored whole and packed in pieces; repeated rows share
their fate in the first two stages and, having one id, are one document in the third and pieces of their own in the
last; rows with a null id are kept; scores at a threshold count as toxic, and as good; an empty table gives an empty
table; other columns of documents stay, whatever their names, up to the last stage, which ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docintake.llm import neardup, packing, quality, toxicity
from docintake.llm.common import stored

STAGES = [
    ("toxicity", toxicity.stage),
    ("quality", quality.stage),
    ("neardup", neardup.stage),
    ("packing", packing.stage),
]

#: The first two stages are trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
