"""opN queries: each applies its operator to the whole table and derives the result's columns."""

from __future__ import annotations

import public_tokenizers

from . import collocations, fm_index, hard_negatives, hilbert, hmm, host_rules, kneser_ney, neighbours, pieces, simhash, suffix_dedup, token_counts, url_trust
from .common import read
from .registry import query

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_PIECES = public_tokenizers.path("word_bpe_49k.json")


@query("op3_sentencepiece")
def op3(spark, sf_dir):
    return pieces.digests(read(spark, sf_dir, "documents"), PIECES)


@query("op5_token_counts")
def op5(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"), WORD_PIECES)


@query("op10_hilbert_shards")
def op10(spark, sf_dir):
    return hilbert.shard_documents(read(spark, sf_dir, "documents"))


@query("op2_host_rules", host_rules.SQL)
def op2(spark, sf_dir):
    return host_rules.quality(read(spark, sf_dir, "documents"))


@query("op4_url_trust", url_trust.SQL)
def op4(spark, sf_dir):
    return url_trust.judged(read(spark, sf_dir, "pages"))


@query("op1_simhash")
def op1(spark, sf_dir):
    return simhash.simhash(read(spark, sf_dir, "documents"))


@query("op6_fm_decontamination")
def op6(spark, sf_dir):
    return fm_index.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op9_nearest_toxicity")
def op9(spark, sf_dir):
    return neighbours.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op7_kneser_ney")
def op7(spark, sf_dir):
    return kneser_ney.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op8_hidden_markov")
def op8(spark, sf_dir):
    return hmm.language_scores(read(spark, sf_dir, "documents"))


@query("op13_hard_negatives", hard_negatives.SQL)
def op13(spark, sf_dir):
    return hard_negatives.mined(read(spark, sf_dir, "embeddings"))


@query("op11_collocations", collocations.SQL)
def op11(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents"))


@query("op12_suffix_dedup")
def op12(spark, sf_dir):
    return suffix_dedup.removals(read(spark, sf_dir, "documents"))
