"""Corpus pipeline over ``documents``: five operators, each stage written and read again.

1. quality     the byte network; documents it gives less than 0.3 go
2. language    rank-order profiles; documents without a letter go, and those nearer to
               another language's profile than to their declared one's by more than MARGIN
3. near        n-gram Jaccard classes (five words, 0.8); the smallest id of each stays
4. benchmark   documents that hold a benchmark item (0.8) go
5. tokens      byte-level BPE ids and the round trip, as digests

Columns keep their names and values whatever they are called.  Rows with a null id are
never merged with others.  Rows that repeat an id count as one document in the third
stage: where it stays, each of its different texts does, repeats of a text once.  An empty
table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontam, jaccard, langid, quality, scratch
from barloom.llm import queries as llm

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Least quality score, and the difference of language scores (0 to 1) that decides.
QUALITY, MARGIN = 0.3, 0.05


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not use."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = llm.table(spark, sf_dir, "labels").select("doc_id", "quality")
    net = quality.fit(quality.sample(docs, labels.where(langid.fold() != 0)))
    score = _free(docs, "quality")
    return quality.score(docs, net, out=score).where(F.col(score) >= QUALITY).select(docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = langid.fit(docs.where(langid.fold() != 0))
    best, score, own = (_free(docs, c) for c in ("best", "best_score", "own_score"))
    named = langid.predict(docs, profiles, lang=best, out=score, declared="lang", declared_out=own)
    other = F.coalesce(F.col(score) - F.col(own) > MARGIN, F.lit(False))
    return named.where((F.col(best) != langid.UNDETERMINED) & ~other).select(docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with scratch.scope() as around:
        classes = jaccard.classes(docs, k=5, threshold=Fraction(4, 5))
        first = scratch.write(classes.where("doc_id = component_id").select("doc_id").distinct(), "first", around)
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, llm.table(spark, sf_dir, "benchmark"), similarity=0.8)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return llm.bpe_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near", keep_distinct),
    ("benchmark", keep_clean),
    ("tokens", tokens),
]

#: Learned models and edit distance to substrings have no SQL; tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to ``documents``."""
    docs, before = llm.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch.scope() as around:
            after = around if name == STAGES[-2][0] else []
            docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{name}", after)
        scratch.release(before)
        before = [] if after is around else after
    return STAGES[-1][1](spark, docs, sf_dir)
