"""The training corpus pipeline: from documents to packed windows, each stage written before the next reads it.

Every stage works on all documents its predecessor kept; all but the last return the columns of documents, others of
any name among them. In every stage a null text counts as empty, texts of any length are taken whole, a null id is a
document like any other, rows that repeat wholly are judged each for itself unless the stage says otherwise, and an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strainlake.llm import exact_dedup, jaccard, mixing, packing, toxicity
from strainlake.llm.common import ship, written
from strainlake.llm.queries import docs_of, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: drops documents that score 0.7 or more by the model fitted on these documents and labels.

    Empty texts stay. Null labels and ids teach nothing; without labels of both classes nothing is dropped.
    """
    ship(spark)
    return toxicity.kept(docs, toxicity.fit(docs, docs_of(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: keeps one row of equal texts: the longest, then the smallest id, a null one last.

    Of wholly repeated rows one stays, and so does one of all empty texts.
    """
    ship(spark)
    return exact_dedup.kept(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: keeps the smallest id of each group of near copies, at five words and a similarity of 0.8.

    Texts without words are near nothing and stay.
    """
    ship(spark)
    return jaccard.kept(docs, words=5, at_least=(80, 100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: samples documents by the raked probabilities of their source, language and topic.

    A null source or language counts as the empty one; the draw depends on the id alone, so rows of one id share it.
    """
    ship(spark)
    return mixing.kept(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token windows of 2048, a row for each piece; an empty text is its end id alone.

    The rows are written here as well, so that texts reach Python in small batches: the stages before leave the
    executors' heaps full.
    """
    ship(spark)
    return written(packing.pack(docs, vocabulary(), part_bytes=3 << 20), "stage-packing")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]
#: Tokenization, a fitted model and connected components: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    df = docs_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        df = written(stage(spark, df, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, df, sf_dir)
