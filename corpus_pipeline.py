"""The corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of `documents`.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm import bpe, decontaminate, langid, simhash, substrings
from chronotext.llm.common import free, read, settled, unpacked
from chronotext.llm.queries import tokenizer_file

#: The tokens' identity can't be had in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, no letter) go; the model learns from the rows with a language."""
    return langid.keep_identified(docs, langid.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays."""
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents of which nothing is left go."""
    out = substrings.cut_repeats(docs).where("n_words = 0 or n_removed < n_words")
    cut, row = F.col("n_removed") > 0, F.col("row")
    changed = {"text": F.when(cut, F.col("kept_text")).otherwise(row.getField("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(row.getField("n_chars"))
    return unpacked(out, changed)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of them and of the text that they decode to."""
    out = bpe.encode_decode(docs, tokenizer_file())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_leaks),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; what a stage leaves behind goes."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        was, docs = docs, settled(partial(stage, spark, docs, sf_dir))
        free(was)
    return STAGES[-1][1](spark, docs, sf_dir)
