"""The corpus pipeline: from raw documents to token files, each stage over all that the stage before it kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from quillmill.llm import decontaminate, language_id, mixing, near_dedup, token_files


def language(spark, docs, sf_dir):
    """Documents go for which the classifier gives no language: without a text, or without a letter in it. Of the others
    `lang` becomes its prediction, which decides what the mix takes of each source."""
    return language_id.drop_undetermined(docs)


def near_duplicates(spark, docs, sf_dir):
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, the one with the smallest doc_id stays."""
    return near_dedup.drop_near_duplicates(docs, n=5, percent=80)


def decontamination(spark, docs, sf_dir):
    """Documents with a window that resembles a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark, docs, sf_dir):
    """Documents are taken never, once or twice, so that sources come near their targets, and predicted languages keep their
    shares of each source; a document taken twice is two rows."""
    return mixing.mixed_documents(docs, within="lang")


def tokens(spark, docs, sf_dir):
    """All token ids are written to files and read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.encoded_documents(docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_files", tokens),
]

#: SQL can't express sketches, fingerprints, the seeded selection or the tokenizer; a test holds a whole run against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """All stages in order, over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
