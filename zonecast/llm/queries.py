"""The operators as queries over the given tables: callables (spark, sf_dir) -> DataFrame."""

import public_tokenizers
from pyspark.sql import functions as F

from zonecast.llm import (
    codes,
    fragments,
    interactions,
    language,
    mixing,
    packing,
    phrases,
    projections,
    retrieval,
    setsketch,
    shards,
    tries,
    whitening,
)
from zonecast.llm.store import new_path

SHARDS = 40
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_string_kernels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    apart = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~apart).select("text", "lang"))
    return language.predict(docs, model).select("doc_id", apart.alias("held_out"), "lang_pred", "score")


def op2_sampled_splitters(spark, sf_dir):
    placed = shards.shard(shards.digest(table(spark, sf_dir, "documents")), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_phrase_automata(spark, sf_dir):
    kept = phrases.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op4_addressable_codes(spark, sf_dir):
    path = new_path(spark, "codes")
    codes.write_codes(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE))
    return codes.read_codes(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_trie_counts(spark, sf_dir):
    return tries.merge_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op6_collision_counting(spark, sf_dir):
    return projections.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op7_exact_complements(spark, sf_dir):
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    digests = pieces.select("part", "doc_id", "piece", "start", F.col("length").cast("long"), "rank", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op8_norm_buckets(spark, sf_dir):
    vectors = retrieval.quantized(table(spark, sf_dir, "embeddings"))
    return retrieval.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op9_weighted_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_setsketch(spark, sf_dir):
    return setsketch.near_documents(table(spark, sf_dir, "documents"), 75)


def op11_filter_tensors(spark, sf_dir):
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_contour_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_forced_boundaries(spark, sf_dir):
    path = public_tokenizers.path(BYTE_BPE)
    decoded = fragments.decode(fragments.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )


QUERIES = {
    "op1_string_kernels": op1_string_kernels,
    "op2_sampled_splitters": op2_sampled_splitters,
    "op3_phrase_automata": op3_phrase_automata,
    "op4_addressable_codes": op4_addressable_codes,
    "op5_trie_counts": op5_trie_counts,
    "op6_collision_counting": op6_collision_counting,
    "op7_exact_complements": op7_exact_complements,
    "op8_norm_buckets": op8_norm_buckets,
    "op9_weighted_mix": op9_weighted_mix,
    "op10_setsketch": op10_setsketch,
    "op11_filter_tensors": op11_filter_tensors,
    "op12_contour_whitening": op12_contour_whitening,
    "op13_forced_boundaries": op13_forced_boundaries,
}
