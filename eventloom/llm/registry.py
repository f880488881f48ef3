"""Registered queries of the subpackage: opN_<name> -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from eventloom.llm import bpe, chat, clustering, exact, factorisation, jaccard, langid, licenses, linededup, mixing, quality, search, secrets
from eventloom.llm.common import documents


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, which is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir)).drop("clean_text")


def op2_bpe(spark, sf_dir):
    return bpe.digest(bpe.encode_decode(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")))


def op3_line_dedup(spark, sf_dir):
    return linededup.repeated(documents(spark, sf_dir))


def op4_temperature_mix(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


def op5_language_id(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


def op6_chat_format(spark, sf_dir):
    return chat.collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.scan(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken")))


def op8_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def op9_jaccard_join(spark, sf_dir):
    return jaccard.similar(documents(spark, sf_dir))


def op10_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(documents(spark, sf_dir))


def op11_centroid_clustering(spark, sf_dir):
    return clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_quality_classifier(spark, sf_dir):
    return factorisation.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_lexical_search(spark, sf_dir):
    return search.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries():
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_bpe": op2_bpe,
        "op3_line_dedup": op3_line_dedup,
        "op4_temperature_mix": op4_temperature_mix,
        "op5_language_id": op5_language_id,
        "op6_chat_format": op6_chat_format,
        "op7_secret_scan": op7_secret_scan,
        "op8_license_scan": op8_license_scan,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_quality_classifier": op12_quality_classifier,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql():
    return {
        "op1_quality_rules": quality.oracle(),
        "op4_temperature_mix": mixing.oracle(),
        "op6_chat_format": chat.ORACLE,
        "op10_exact_dedup": exact.ORACLE,
        "op11_centroid_clustering": clustering.oracle(),
        "op13_lexical_search": search.ORACLE,
    }
