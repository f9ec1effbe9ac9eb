"""The corpus pipeline: language ID, near-duplicate removal, suffix deduplication, secret redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; all but the last
return the columns of `documents`. Stages are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm import langid, minhash, packing, secrets, suffixes
from inkframe.llm.common import free_name, release, staged, table
from inkframe.llm.queries import tokenizer_file

#: Texts whose main language has less than this share of their letters are rejected, and texts without letters.
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language: texts whose main language has `LEAST_SHARE` of their letters.

    Null and empty texts and texts without letters go; a row that repeats is judged each time, with the same result; where
    no row has a language to learn from, or the table is empty, nothing stays. Other columns stay, whatever their names.
    """
    name = free_name("found", docs.columns)
    found = langid.labelled(docs, langid.fit(docs), name)
    return found.where((F.col(f"`{name}`.lang_pred") != "und") & (F.col(f"`{name}`.score") >= LEAST_SHARE)).select(_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id.

    Null and empty texts, and rows without an id, are in no group and stay. Rows that repeat id and text are one document, of
    which one row stays; rows that share an id only, and aren't near copies, all stay. Ties can't occur: ids order a group.
    """
    found = staged(minhash.near_duplicates(docs).select("doc_id", "n_shingles", "kept"), "near")
    gone = found.where("not kept").select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(_columns(docs))
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return out
    # written first, so that Spark can split the joins
    again = staged(again, "again")
    several = out.join(again, "doc_id").select(_columns(docs)).withColumn(name := free_name("hash", docs.columns), F.xxhash64("text"))
    once = several.dropDuplicates(["doc_id", name]).select(_columns(docs))
    return out.join(again, "doc_id", "left_anti").select(_columns(docs)).unionByName(once)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes bytes of long strings that occur elsewhere; a character cut in two goes with them.

    Every document stays, with what is left of its text: null texts stay null, texts under 200 bytes stay as they are, rows that
    repeat and are long enough lose everything. Other columns stay, whatever their names; n_chars is counted anew.
    """
    return _sized(suffixes.trim_repeats(docs)).select(_columns(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mask.

    Every document stays: null texts stay null, empty ones empty, rows that repeat get the same text each. Without a secret to
    learn from, or in an empty table, only the base expressions' finds are masked. Other columns stay; n_chars is counted anew.
    """
    return _sized(secrets.redact(docs, secrets.fit(docs))).select(_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences.

    Null and empty texts give one piece with the closing id only; rows that repeat, or share an id, are packed each; an
    empty table gives no pieces. Only doc_id and text are read.
    """
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("secret_scan", secret_scan),
    ("pack", pack),
]
#: None: the first stage is a fitted model, which SQL can't express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
