"""The registered queries: each reads its tables and applies one operator with its production parameters."""

from __future__ import annotations

from postingworks.llm import (
    checks,
    debruijn,
    decontamination,
    fingerprints,
    language,
    licenses,
    manifest,
    minhash,
    packing,
    pii,
    spelling,
    suffixes,
    token_files,
    toxicity,
)
from postingworks.llm.common import read
from postingworks.llm.registry import CHECKS, QUERIES, query
from postingworks.llm.tokens import tokenizer_path

__all__ = ["CHECKS", "QUERIES"]


@query("op9_fingerprints")
def op9(spark, sf_dir):
    return fingerprints.digest(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_decontamination", decontamination.SQL)
def op10(spark, sf_dir):
    return decontamination.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op8_personal_data")
def op8(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(docs, pii.fit(docs))


@query("op4_licenses", licenses.SQL)
def op4(spark, sf_dir):
    return licenses.digest(read(spark, sf_dir, "documents"), licenses.templates(spark))


@query("op1_packing")
def op1(spark, sf_dir):
    return packing.digest(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), most_kept=500_000, slice_chars=8 << 20)


@query("op7_token_files")
def op7(spark, sf_dir):
    return token_files.digest(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op2_near_duplicates", checks.NEAR_DUPLICATES)
def op2(spark, sf_dir):
    return minhash.digest(read(spark, sf_dir, "documents"))


@query("op6_language")
def op6(spark, sf_dir):
    return language.digest(read(spark, sf_dir, "documents"))


@query("op3_substrings", checks.SUBSTRINGS)
def op3(spark, sf_dir):
    return debruijn.digest(read(spark, sf_dir, "documents"))


@query("op5_suffixes", checks.SUFFIXES)
def op5(spark, sf_dir):
    return suffixes.digest(read(spark, sf_dir, "documents"))


@query("op11_manifest", manifest.SQL)
def op11(spark, sf_dir):
    return manifest.digest(read(spark, sf_dir, "documents"))


@query("op12_spelling", spelling.SQL)
def op12(spark, sf_dir):
    return spelling.digest(read(spark, sf_dir, "documents"))


@query("op13_toxicity")
def op13(spark, sf_dir):
    return toxicity.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
