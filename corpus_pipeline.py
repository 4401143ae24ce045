"""A corpus-cleaning pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and
read again as the next stage's docs. All but the last keep the columns of documents, and all
of them take an empty table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import benchmark_tiling, language_id, ngram_join, sentencepiece_gumbel, toxicity
from gneiss.llm.common import cut
from gneiss.llm.registry import table, tokenizer_path

#: The least cosine that a text needs, by the trigrams in its distinct words, and evenly between. By
#: chance the best of all prototypes has about 0.03 to 0.1 with random letters; the bounds lie under what
#: held-out texts of sf0.1 have with their own language and, from about 80 trigrams on, above what
#: almost all texts have when their language is left out of the fit (README).
LEAST_SCORE = ((6, 0.02), (20, 0.10), (40, 0.13), (80, 0.19), (160, 0.25), (320, 0.30))


def least_score(text: Column) -> Column:
    """The cosine that a text needs."""
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(text), r"\P{L}+", " ")), " "))
    n = F.aggregate(words, F.lit(0), lambda total, w: total + F.length(w) + 1) - 1
    bound = F.lit(LEAST_SCORE[-1][1])
    for (a, low), (b, high) in reversed(list(zip(LEAST_SCORE, LEAST_SCORE[1:]))):
        bound = F.when(n < b, low + (high - low) / (b - a) * (n - a)).otherwise(bound)
    return F.when(n <= LEAST_SCORE[0][0], LEAST_SCORE[0][1]).otherwise(bound)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the texts that are in a learned language; letterless and null texts go. Each row is
    judged by itself, so repeated rows and rows without an id share its fate."""
    profiles = language_id.fit(language_id.training_fold(table(spark, sf_dir, "documents")))
    scored = language_id.predict(docs, profiles, keep=tuple(docs.columns))
    enough = (F.col("score") >= LEAST_SCORE[-1][1]) | (F.col("score") >= least_score(F.col("text")))
    return scored.filter((F.col("lang_pred") != "und") & enough).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the texts that are not predicted toxic, row by row."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.training_rows())
    return toxicity.score(docs, model, keep=tuple(docs.columns)).filter("predicted = 0").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal or near texts: the one with the smallest id; of rows
    that share it, or of a group without ids, the smallest row. Empty texts all stay."""
    return ngram_join.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text covers a benchmark item, whatever their id."""
    return benchmark_tiling.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of what is left, piece ids included; null texts have none."""
    # The workers have served four other operators, so this one takes less memory than by itself.
    return sentencepiece_gumbel.sample_segmentations(docs, tokenizer_path("piece_bpe_32k.model"), chars=40_000, memo=400_000)


STAGES = [
    ("language_id", language),
    ("toxicity", clean),
    ("ngram_jaccard_join", distinct),
    ("benchmark_decontamination", uncontaminated),
    ("sentencepiece", encoded),
]

#: Learned and sampled stages have no SQL equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each kept in the session's checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
