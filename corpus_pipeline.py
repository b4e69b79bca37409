"""A corpus pipeline: language ID, quality, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and decides on all the documents that its predecessor kept.
All but the last return the columns of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltry.llm import quality as quality_vote
from basaltry.llm.common import fresh_names, id_hash_mod, written
from basaltry.llm.language_id import annotate, fit_on
from basaltry.llm.packing import pack_mixture
from basaltry.llm.queries import table
from basaltry.llm.similar import without_near_copies
from basaltry.llm.tokens import public_path

#: A document goes if no language has at least this posterior probability.
SURE = 0.5
#: A document goes if the vote for good quality is lower.
GOOD = 0.7
#: Parts of texts that a worker keeps encoded: few, since other stages ran in the same executors before.
PARTS = 100_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: text without any letter, or in none of the learned languages with probability of SURE or more.

    The probability is among the learned languages.  Where no document has a language, nothing can be learned and all stay.
    """
    model = fit_on(docs.where(id_hash_mod("doc_id", 5) != 0), public_path("byte_bpe_50k.json"))
    if model is None:
        return docs
    lang, score, words = fresh_names(docs, "lang_pred", "score", "words")
    kept = annotate(docs, model, (lang, score, words)).where((F.col(lang) != "und") & (F.col(score) >= SURE))
    return kept.select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: documents whose weighted vote for label 1 is under GOOD.  Without labels of both kinds all stay."""
    learn = id_hash_mod("doc_id", 4) != 2
    model = quality_vote.fit_on(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    if len(set(model.votes.tolist())) < 2:
        return docs
    (score,) = fresh_names(docs, "score")
    return quality_vote.annotate(docs, model, score).where(F.col(score) >= GOOD).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: SimHash links and five-word shingle similarity of 0.8 or more."""
    return without_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that the kept documents fill."""
    return pack_mixture(docs, public_path("byte_bpe_50k.json"), cache=PARTS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Fingerprints, votes and ids cannot be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
