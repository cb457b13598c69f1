"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from fleetfault.llm import chat, decontam, hpylm, jaccard, language, mixing, piecewise, quality, repair, repeats, token_counts, wavelet, whitening
from fleetfault.llm.oracles import ORACLES  # noqa: F401
from fleetfault.llm.tables import read


def op1_mix_sources(spark, sf_dir):
    drawn = mixing.draw(mixing.sized(read(spark, sf_dir, "documents")))
    words = F.expr("aggregate(copies, 0L, (a, c) -> a + c.words)")
    return drawn.select(
        "doc_id", "size", "source_size", "target", words.alias("taken"), F.get("copies", F.lit(0))["shard"].alias("first_shard")
    )


def op2_lm_scores(spark, sf_dir):
    return hpylm.score(read(spark, sf_dir, "documents"))


def op3_format_chats(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise(chat.ASSISTANT)
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    talks = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = chat.format_trees(chat.chains(talks.unionByName(extra)))
    read_back = formatted.select("tree", "formatted", F.explode(F.array(chat.turns_of(F.col("formatted")))).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    read_back = read_back.select("tree", "formatted", "turns", F.inline(F.array(F.struct(lines.alias("lines"), loss.alias("loss")))))
    return read_back.select(
        F.expr("try_cast(tree as bigint)").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("lines", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_suffix_repeats(spark, sf_dir):
    return repeats.without_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_ngram_jaccard(spark, sf_dir):
    return jaccard.groups(read(spark, sf_dir, "documents"), size=4, percent=85).select(
        "doc_id", "n_shingles", "component_id", "class_id"
    )


def op6_token_shards(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    files = wavelet.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"))
    return wavelet.text_digests(files)


def op7_benchmark_tiles(spark, sf_dir):
    found = decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "n_covered", "coverage", F.size("tiles").cast("long").alias("n_tiles"))


def op8_token_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op9_quality_rules(spark, sf_dir):
    return quality.quality(read(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    field = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, field)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_piecewise_hashes(spark, sf_dir):
    return piecewise.compare_with_next(read(spark, sf_dir, "documents"))


def op12_repair_conversations(spark, sf_dir):
    talks = read(spark, sf_dir, "conversations")
    return repair.summaries(repair.damage(talks), talks)


def op13_whiten_embeddings(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_lm_scores": op2_lm_scores,
    "op3_format_chats": op3_format_chats,
    "op4_suffix_repeats": op4_suffix_repeats,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_token_shards": op6_token_shards,
    "op7_benchmark_tiles": op7_benchmark_tiles,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
    "op11_piecewise_hashes": op11_piecewise_hashes,
    "op12_repair_conversations": op12_repair_conversations,
    "op13_whiten_embeddings": op13_whiten_embeddings,
}
