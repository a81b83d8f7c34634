"""The registered queries opN_<name> of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


from . import (  # noqa: E402
    decontaminate, language, lexical, licenses, mixing, neardup, secrets, syncmers, tokens, transcripts, url_filter,
    vector_links, whitening)


@register("op2_token_blocks")
def op2(spark, sf_dir):
    return tokens.tokenize(table(spark, sf_dir, "documents"), word_bpe())


@register("op6_mixing", mixing.OP6_SQL)
def op6(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op10_language")
def op10(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@register("op4_decontaminate", decontaminate.OP4_SQL)
def op4(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op3_minhash_neardup")
def op3(spark, sf_dir):
    return neardup.groups(table(spark, sf_dir, "documents"))


@register("op5_secret_ledger", secrets.OP5_SQL)
def op5(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


@register("op1_url_filter")
def op1(spark, sf_dir):
    return url_filter.report(table(spark, sf_dir, "pages"))


@register("op9_syncmer_fingerprints")
def op9(spark, sf_dir):
    return syncmers.report(table(spark, sf_dir, "documents"))


@register("op7_license_scan")
def op7(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@register("op8_chat_transcripts")
def op8(spark, sf_dir):
    lines = transcripts.as_transcripts(table(spark, sf_dir, "conversations"))
    model = transcripts.fit(lines.where(transcripts.trained_on()))
    return transcripts.render(transcripts.parse(lines.drop("role"), model))


@register("op11_lexical_search", lexical.OP11_SQL)
def op11(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op13_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@register("op12_embedding_links", vector_links.OP12_SQL)
def op12(spark, sf_dir):
    return vector_links.link(table(spark, sf_dir, "embeddings"))
