"""op10_bpe over the whole of documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import round_trip
from .shared import table


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
