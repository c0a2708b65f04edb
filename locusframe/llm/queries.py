"""The registered queries of the corpus operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import audio, bpe, chat, ctw, funnels, jaccard, langid, mixing, shards, suffixes, toxicity, trie, vectors
from locusframe.llm.common import documents

#: Target weights of the mixture; names that aren't listed weigh 1.
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 4}}


def op1_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), WEIGHTS)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digest(audio.features(documents(spark, sf_dir)))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_recurrent_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.learn(docs))


#: Schemas of the tools; user turns of plain conversations call ``reply``.
TOOLS = {"reply": {"prompt": "string", "turn": "integer"}, "search": {"query": "string", "limit": "integer?"}}


def op7_linked_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(chat.events_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")), TOOLS)


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score(docs, model)
    return found.select(
        "doc_id", toxicity.held_out("doc_id", 2, 4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages")
    )


def op9_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op10_proportional_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.interleave(documents(spark, sf_dir))


def op11_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(documents(spark, sf_dir), additive=True)


def op12_ordered_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnels.count(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hierarchical_mixing": op1_hierarchical_mixing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_audio_features": op3_audio_features,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_projection_forest": op5_projection_forest,
    "op6_recurrent_language": op6_recurrent_language,
    "op7_linked_chat": op7_linked_chat,
    "op8_toxic_segments": op8_toxic_segments,
    "op9_token_groups": op9_token_groups,
    "op10_proportional_shards": op10_proportional_shards,
    "op11_context_trees": op11_context_trees,
    "op12_ordered_funnels": op12_ordered_funnels,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLE: dict[str, str] = {
    "op1_hierarchical_mixing": mixing.oracle(WEIGHTS),
    "op12_ordered_funnels": funnels.oracle(),
    "op13_conversation_trie": trie.oracle(),
}
