"""The operators over the supplied tables, and the SQL text of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, byte_fold, html_text, licenses, line_dedup, packing, part_codes, pii, prefix_trie, quality, secrets, simhash
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; every machine of the cluster must hold it at this path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op2_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@register
def op3_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@register
def op4_bpe(spark, sf_dir):
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@register
def op5_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLES["op5_licenses"] = licenses.oracle()


@register
def op6_quality(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"))


@register
def op7_multi_index(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@register
def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@register
def op9_pii(spark, sf_dir):
    return pii.scan(table(spark, sf_dir, "documents"))


@register
def op10_html(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@register
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op13_prefix_trie"] = prefix_trie.oracle()


@register
def op12_part_codes(spark, sf_dir):
    return part_codes.part_codes(table(spark, sf_dir, "embeddings"))


ORACLES["op12_part_codes"] = part_codes.oracle()


@register
def op11_byte_fold(spark, sf_dir):
    import public_tokenizers

    return byte_fold.token_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
