"""Corpus pipeline: toxicity, SimHash near copies, repeated passages, benchmark leaks, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a table that is stored and read again as the next stage's documents."""

from __future__ import annotations

import public_tokenizers

from assayframe.llm import bpe, decontaminate, simhash, substrings, toxicity
from assayframe.llm.common import table, written


def drop_toxic(spark, docs, sf_dir):
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark, docs, sf_dir):
    return simhash.keep_first(docs)


def cut_repeats(spark, docs, sf_dir):
    return substrings.without_repeats(docs)


def drop_leaks(spark, docs, sf_dir):
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("substrings", cut_repeats), ("decontamination", drop_leaks), ("encoding", encode)]
# Trees, fingerprints, recompression and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"stage-{name}")
    return docs
