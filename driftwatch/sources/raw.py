"""Raw sensor files: one JSON object per modality, person and day.

Layout: ``<root>/<modality>/<person>/<YYYY-MM-DD>.json``. Person, day and modality come from
the path, so one glob reads any number of them in one distributed scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.config import DAY, KEY, MODALITIES
from driftwatch.functions.scalars import safe_double
from driftwatch.operators.assemble import assemble

# Fixed value: what the path of a raw file looks like.
PATH = r"/([^/]+)/([^/]+)/(\d{4}-\d{2}-\d{2})\.json$"


def raw_modality(spark: SparkSession, root: str, modality: str) -> DataFrame:
    """Features of one modality; values that are no numbers become NULL, other keys are dropped."""
    fields = MODALITIES[modality]
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    df = (spark.read.schema(schema).option("multiLine", True)
          .json(f"{root}/{modality}/*/*.json"))
    path = F.col("_metadata.file_path")
    return df.select(F.regexp_extract(path, PATH, 2).alias(KEY),
                     F.to_date(F.regexp_extract(path, PATH, 3)).alias(DAY),
                     *[safe_double(f).alias(f) for f in fields])


def raw_days(spark: SparkSession, root: str) -> DataFrame:
    """All modalities assembled per person and day; an absent file is a missing modality."""
    return assemble({m: raw_modality(spark, root, m) for m in MODALITIES})
