"""A training corpus in five stages: language ID, quality, near copies, mixing, encoding.

Each stage takes the documents that its predecessor kept and returns those that it keeps, with their columns; the last
returns the encoded documents. Stages are written as Parquet in the shared folder and read again.

Any column may hold nulls; ids may repeat. A null, empty or blank text goes in the language stage, as it has no letter. Rows
that are all alike are near copies, of which one stays. Further columns pass through up to the last stage, whatever their
names. A stage that is given no rows returns none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import bpe, language, mixing, quality, simhash
from vertexloom.llm.common import Scratch, table, unused, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; learned from all labels of documents that aren't held out.

    Rejected are texts without a letter, and texts that no learned language explains: their likelihood a letter is far
    below that of nearly all labelled texts, as in languages that were never taught and in random letters. Where the
    language is null it becomes the predicted one. Without any label only texts without a letter are rejected.
    """
    where = ~F.coalesce(language.held_out("id"), F.lit(True))
    model = language.learn(docs, public_tokenizers.path("piece_bpe_32k.model"), where)
    if not model["langs"]:
        return docs.where(F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    lang, score, fit = (unused(docs, x) for x in ("_lang", "_score", "_fit"))
    # written, so that texts are scored once: for what labelled ones reach, and for themselves
    found = written(language.predict(docs, model, lang_name=lang, score_name=score, fit_name=fit), "language-scored")
    least = language.least_fit(found, model, where, fit_col=fit)
    found = found.where((F.col(lang) != "und") & (F.col(fit) >= F.lit(-float("inf") if least is None else least)))
    return found.withColumn("lang", F.coalesce("lang", lang)).drop(lang, score, fit)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer keeps."""
    names = [unused(docs, x) for x in ("_score", "_weak", "_keep")]
    return quality.classify(docs, quality.learn(docs), names=names).where(F.col(names[2])).drop(*names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their digests, of each row."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", identify_language), ("quality", keep_quality), ("near_copies", drop_near_copies), ("mixing", mix_sources), ("encoding", encode)]

#: Learned models and hashed ranks are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What a stage wrote on its way goes once the next stage's input is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with Scratch(spark) as scratch:
            docs = scratch.keep(written(stage(spark, docs, sf_dir), f"pipeline-{name}", docs))
    return docs
