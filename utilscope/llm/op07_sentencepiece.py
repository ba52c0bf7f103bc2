"""`op7_sentencepiece`: ids and decoded text of all documents, as digests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utilscope.llm.piece_bpe import encode_texts

MODEL = "piece_bpe_32k.model"
#: Units that a worker keeps, twice; with their parts some 230 MB.
KEPT_UNITS = 400_000


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode_texts(docs, public_tokenizers.path(MODEL), ["doc_id"], packed=True, kept_units=KEPT_UNITS)
    return encoded.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
