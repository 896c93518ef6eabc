"""Registered queries of the operators, and SQL equivalents where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracehold.llm import ann, chat, fim, minhash, orc_tokens, packing, pii, sharding, suffix, tiling, toxicity, trie, windows
from tracehold.llm.common import table
from tracehold.session import new_folder


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_hash_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every 20th vector among all embeddings."""
    index, vectors = ann.build_index(table(spark, folder, "embeddings"))
    return ann.nearest(index, vectors.where("vec_id % 20 = 0"), k=20)


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents on 16 shards by the weighted hash tree, and on 17."""
    leaves = sharding.topology(16)
    return sharding.shard_documents(table(spark, folder, "documents"), leaves, sharding.grown(leaves))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that occur twice."""
    return suffix.removed_digest(suffix.repeated_strings(table(spark, folder, "documents"), window=200))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored for toxicity, learned from the labels that are not held out."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' token ids written as ORC and read back."""
    path = new_folder(spark, "token-files")
    orc_tokens.write_tokens(table(spark, folder, "documents"), path, tokenizer_path())
    return orc_tokens.token_index(spark, path)


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())


def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.personal_data(table(spark, folder, "documents"))


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations from every speaker's view."""
    return chat.perspectives(table(spark, folder, "conversations"))


def op9_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against all benchmark items."""
    return tiling.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' near-duplicate components at a similarity of 0.85."""
    return minhash.near_duplicates(table(spark, folder, "documents"), percent=85)


def op11_window_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the words of 50-word windows that start in an earlier document."""
    return windows.digests(windows.removals(table(spark, folder, "documents"), window=50))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the prefix trie of all conversations, rebuilt in groups of 20."""
    return trie.conversation_trie(table(spark, folder, "conversations"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """All documents cut and rearranged for filling in the middle, and restored."""
    return fim.digests(fim.piece_tables(table(spark, folder, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hash_prefix_forest": op1_hash_prefix_forest,
    "op2_sharding": op2_sharding,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_token_orc": op5_token_orc,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_personal_data": op7_personal_data,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_string_tiling": op9_string_tiling,
    "op10_minhash": op10_minhash,
    "op11_window_dedup": op11_window_dedup,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op8_chat_formatting": chat.ORACLE,
    "op11_window_dedup": windows.ORACLE,
    "op12_conversation_trie": trie.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
