"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fertility, hamming, htmltext, langid, mixing, negatives, oracles, packing, repair, sharding, simhash, toxicity
from .common import crc_mod, shared_dir, table


def tokenizer_file(name: str) -> str:
    """Where the box keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of every document; learned where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 3) == 1
    trees = langid.train(docs, where=~held_out)
    return langid.identify(docs, trees).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op3_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    found = hamming.top_k(vectors, vectors.where("id % 100 = 0"), k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's byte-level BPE ids and of what they decode to."""
    source = bpe.vocabulary(tokenizer_file("byte_bpe_50k.json"))
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), source)


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by a CRF trained on 900 labelled pages."""
    model = htmltext.train(htmltext.labelled_pages(900))
    return htmltext.extract(table(spark, sf_dir, "pages"), model)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash class of every document: links at three or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling probability and fate of every document under raked weights."""
    return mixing.mix(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 9) for c in ("prob", "t_source", "t_lang", "t_topic", "residual")})


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted windows."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    odd = F.lit("\\### Assistant: </turn> ok")
    turn = F.col("id").alias("turn")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn, F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), odd.alias("text"))
    return chat.digests(chat.windows(rows.unionByName(more)))


def op9_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and next shard of every document under the law ``key``."""
    return sharding.assign(table(spark, sf_dir, "documents"), 8)


def op10_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, fertility rates and verdict of every document, with bands per language."""
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    import public_tokenizers

    with open(tokenizer_file("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read(), public_tokenizers.PATTERN
    return fertility.judge(table(spark, sf_dir, "documents"), model, group=F.col("lang"), ranks=ranks)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, size and checksum of every document's ids, read back from bit-packed files."""
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        source = f.read()
    path = f"{shared_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    packing.write(table(spark, sf_dir, "documents"), path, source, end_id=2)
    return packing.read(spark, path, ids=False)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the digest of every conversation, damaged and repaired."""
    rows = repair.damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return repair.digests(rows, repair.plans(rows, copies="copies"), copies="copies")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives for each of five positives of every anchor (vec_id divisible by 50)."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_language_id": op2_language_id,
        "op3_hamming_top_k": op3_hamming_top_k,
        "op4_bpe_round_trip": op4_bpe_round_trip,
        "op5_html_main_text": op5_html_main_text,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_mixing": op7_mixing,
        "op8_chat_windows": op8_chat_windows,
        "op9_hash_tree_shards": op9_hash_tree_shards,
        "op10_tokeniser_fertility": op10_tokeniser_fertility,
        "op11_token_files": op11_token_files,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that have one. The others are models (1, 2, 5), need a
    tokenizer (4, 10, 11) or hashes that SQL lacks (6, 9); tests compare those with brute force."""
    return {"op3_hamming_top_k": oracles.HAMMING_TOP_K, "op7_mixing": oracles.mixing(), "op8_chat_windows": oracles.CHAT_WINDOWS, "op12_conversation_repair": oracles.CONVERSATION_REPAIR, "op13_hard_negatives": oracles.HARD_NEGATIVES}
