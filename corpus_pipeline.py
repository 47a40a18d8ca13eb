"""A training corpus from ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir), works on every row it is given and
returns rows with the columns of ``documents``; the last returns token ids.
Stages are written as Parquet and read again before the next.

1. language: documents whose language stays unclear are dropped, and so are null
   texts and texts without a letter. With no labelled language all are.
2. quality: documents scored below the classifier's threshold are dropped; a null
   text is scored as an empty one. With no usable labels nothing is dropped.
3. near_dup: one document of each near-duplicate group stays (shingles of five
   words, similarity 0.8): that of the smallest doc_id, a null one last. Texts
   without words stay.
4. mix: the words that the mix takes, so that each source has its target: whole
   documents as they are, parts as rows of their own; texts without words go.
5. bpe: documents become token ids, checked by decoding.

Rows with equal or null doc_id are documents of their own in every stage, rows equal
in all columns too, until stage 3 keeps one of them. Columns other than doc_id, text,
lang and source only travel along, whatever their names; names that begin with two
underscores are the stages' own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.llm.bpe import encode_documents
from filelens.llm.common import new_path, read_table
from filelens.llm.language_id import identify_languages, learn_languages
from filelens.llm.mixing import mixed_rows
from filelens.llm.near_dup import without_near_duplicates
from filelens.llm.quality import QualityConfig, learn_quality, score_documents
from filelens.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = identify_languages(docs, learn_languages(docs), docs.columns, prefix="__")
    return found.filter("NOT __rejected").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, _ = learn_quality(docs, read_table(spark, sf_dir, "labels"))
    if model.means is None:
        return docs
    scored = score_documents(docs, model, docs.columns, prefix="__")
    return scored.filter(F.col("__score") >= QualityConfig().threshold).select(*docs.columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = encode_documents(docs, tokenizer_path(), ["doc_id", "lang", "source", "text"])
    intact = F.coalesce("text", F.lit("")) == F.col("decoded")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", intact.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [("language", language), ("quality", quality), ("near_dup", near_dup), ("mix", mix), ("bpe", bpe)]

#: Models, hashes and token ids have no SQL form; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage-{name}")
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
