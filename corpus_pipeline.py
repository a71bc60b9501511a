"""A training corpus from raw documents: five stages, each one of the operators in ``weftline.llm``.

Each stage works on all that the one before kept, and gets it as a table that was written and read again.
All but the last return the columns of ``documents``:

1. ``toxicity``: documents that are predicted toxic go
2. ``near_dedup``: of documents with near-equal text the one with the smallest id stays (five-word shingles,
   similarity 0.8 or more)
3. ``secret_scan``: reported secrets in the text are replaced by their kind; all documents stay
4. ``mixing``: documents are selected to target weights; one that is used in two epochs comes twice,
   and one that is used in part is cut after that many words
5. ``bpe``: token ids of the text, with their number and digests

Nulls, empty tables, repeated rows and extra columns are as the operators define them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, mixing, near_dedup, secret_scan, toxicity
from weftline.llm.common import bound_batches, read, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    kinds = dict(docs.dtypes)
    return model.score(docs, [(c, kinds[c]) for c in COLUMNS if c != "text"], text=True).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return near_dedup.deduplicated(docs, COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = secret_scan.redact(docs, COLUMNS)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(docs, COLUMNS)
    uses = F.col("mx_epochs") + F.when(F.col("mx_part") > 0, 1).otherwise(0)
    used = chosen.withColumn("mx_use", F.explode(F.sequence(F.lit(1).cast("long"), uses.cast("long"))))
    cut = (F.col("mx_use") > F.col("mx_epochs")) & (F.col("mx_part") < F.col("mx_tokens"))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))  # each with the space before it
    part = used.withColumn("text", F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("mx_part").cast("int")), "")).otherwise(F.col("text")))
    return part.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return bpe.digests(docs, public_tokenizers.path(bpe.TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Models and exact tokenization have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
