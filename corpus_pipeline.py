"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes the session, the documents its predecessor kept, and the folder of the other tables.
All but the last return the columns of `documents`; other columns of their input are left out. In every stage null
texts count as empty, rows that repeat a doc_id or have none are judged each for itself unless it says otherwise, and
an empty table gives no rows. Stages never cut, sample or drop texts but by the decision they name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import chains, decontaminate, line_rules, packing, simhash
from lectern.llm.queries import TOXICITY, tokenizer
from lectern.session import discard, spread, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their hosts' frequent lines.

    n_chars is that of the text that is left. A null or empty text fails (it has fewer than 50 words); a null source is a
    host of its own. Rows with equal source and text get equal verdicts.
    """
    judged = line_rules.judge(docs, keep=("lang", "source")).where("kept")
    return judged.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic: whose probability of the category `toxic` is below one half; at one half they go.

    The chain is fitted on labelled documents among those given (at most linear.SAMPLE); null labels are left out, of
    several for one document the least counts. Without labels, or with documents of one class alone, nothing goes but for that class.
    """
    chain = chains.fit_chain(docs, table(spark, sf_dir, "labels"), TOXICITY)
    return chains.predict(docs, chain, list(TOXICITY), keep=COLUMNS[1:]).where("NOT is_toxic").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the row with the smallest doc_id, then with the least text digest.

    It goes by rows, so a doc_id that comes again with another text is kept for it. Rows without a doc_id come last;
    texts without words are copies of each other. Rows that are equal in id and text leave one, whichever it is.
    """
    return simhash.representatives(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Items without a word match nothing; without items all documents stay. Equal items, and items without an id, count each.
    """
    return decontaminate.search(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:]).where("NOT contaminated").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, with their ids; an empty text has its end id alone."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]
#: Hashing, learned weights and subword merges are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written before the next begins."""
    docs = spread(table(spark, sf_dir, "documents"))
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
