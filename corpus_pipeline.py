"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

Each stage works on all rows that the one before it kept, and each but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm import decontaminate, jaccard, langid, packing, quality
from vaultspark.llm._common import input_table, work_folder

#: Words of a shingle and the similarity (in hundredths) of near duplicates.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: A document is rejected as of another language only if the one that it says needs so many standard deviations more phrases.
SURE = 6.0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the co-trained classifier scores below its threshold (poor or toxic documents)."""
    labels = input_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    model = quality.train(docs, labels)
    return quality.score(docs, model).filter("accepted").select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, and those that are surely of another language than they say.

    Documents of two languages stay unless the other one clearly prevails, and so do those whose language isn't known."""
    samples = langid.labelled_sample(docs.filter(~langid.held_out()))
    found = langid.identify(docs, samples)
    said = F.array_position(F.array(*[F.lit(x) for x in sorted(samples)]), F.col("lang")) if samples else F.lit(0)
    own, best = F.get("phrases", F.greatest(said - 1, F.lit(0)).cast("int")), F.array_min("phrases")
    other = (said > 0) & ((own - best) / F.sqrt(own + best) >= SURE)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & ~F.coalesce(other, F.lit(False))).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked documents."""
    return jaccard.keep_one(docs, k=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(docs, input_table(spark, sf_dir, "benchmark", "item_id", "text"), mode="documents")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("language identification", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Classifiers, components and tokenizers aren't SQL; tests/llm holds brute-force versions against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = work_folder(spark, f"stage-{name.replace(' ', '-')}")
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
