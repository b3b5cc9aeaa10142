"""Corpus pipeline: documents in a known language, not toxic, one of each group of near copies, packed into sequences.

The stages return the columns of documents (the last one, pieces); columns that a stage needs for itself take names that
docs do not have. Ids may be null or repeat; an empty table goes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustline.llm import dart_minhash, language_id, packing, toxicity
from trustline.llm.common import fold, stored, table
from trustline.llm.queries import BYTE_BPE

LEAST_LANGUAGE_SCORE = 0.4


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores until docs have no such column."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def columns_of(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the network names with a score of at least 0.4.

    Null and empty texts and those without a letter are ``und`` and go, and so does everything if no language can be
    learned. Repeated rows are judged alike; columns other than text are not looked at."""
    net = language_id.train(table(spark, sf_dir, "documents"), fold("doc_id", 4) != 2)
    lang, score = unused(docs, "lang_pred", "lang_score")
    told = language_id.classify(docs, net, lang_col=lang, score_col=score)
    return told.where((F.col(lang) != language_id.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(columns_of(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that op10_toxicity does not call toxic.

    Null and empty texts match nothing and stay; repeated rows are judged alike; columns other than text are not looked at."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    (score,) = unused(docs, "toxic_score")
    return toxicity.score_toxicity(docs, model, score_col=score).where(F.col(score) < toxicity.TOXIC_FROM).select(columns_of(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near copies, the document of the smallest doc_id.

    Texts without a word (null, empty, white space) are no one's copies and stay, once an id. Rows that repeat an id and a
    text stay once, whichever of them comes first; of an id's different texts those stay that are their groups' kept ones.
    Null ids count as one id, larger than all others."""
    key, text_class = unused(docs, "near_id", "near_class")
    kept = dart_minhash.near_duplicates(docs.select("doc_id", "text")).where("kept")
    id_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kept = kept.select(id_of("doc_id").alias(key), F.coalesce("text_class", F.lit("")).alias(text_class))
    spoken = F.col("text").rlike(dart_minhash.HAS_WORDS)
    rows = docs.withColumns({key: id_of("doc_id"), text_class: F.coalesce(F.when(spoken, F.md5(F.col("text").cast("binary"))), F.lit(""))})
    # Texts meet their ids in one exchange; repeats lie together then.
    return rows.join(kept, [key, text_class], "left_semi").dropDuplicates([key, text_class]).select(columns_of(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens in the mixture of the sources that are left.

    Null texts are one token, the end; null sources are a source; repeated rows are packed as often as they occur."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [("language", known_language), ("toxicity", not_toxic), ("near duplicates", one_of_each), ("packing", packed)]
# Stages that read their documents several times: what was judged before them is written first, and judged once.
READ_AGAIN = {one_of_each}

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, stored(docs) if stage in READ_AGAIN else docs, sf_dir)
    return docs
