"""Documents cleaned, deduplicated, decontaminated, mixed and written as token shards.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all
but the last return the columns of the documents.  ``run`` writes what a stage returns as
Parquet and reads it again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers

from fleetfault.llm import decontam, jaccard, mixing, quality, wavelet
from fleetfault.llm.tables import read, set_up
from fleetfault.session import scratch_folder


def quality_rules(spark, docs, sf_dir):
    """Failed lines are removed; documents that fail or lose too much go."""
    set_up(spark)
    return quality.clean(docs)


def ngram_jaccard_join(spark, docs, sf_dir):
    """Of documents that share four fifths of their five-word shingles, or are linked by others
    that do, the one with the lowest id stays."""
    set_up(spark)
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold at least half of a benchmark item, in whatever order, go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark, docs, sf_dir):
    """Every document as often as the mix of the sources takes it, at most three times."""
    set_up(spark)
    return mixing.mixed_documents(docs)


def token_shards(spark, docs, sf_dir):
    """Token ids of what is left, as wavelet-matrix files, and a digest of each text read back."""
    set_up(spark)
    return wavelet.text_digests(wavelet.write_shards(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_shards),
]

# Similarity joins, tiling and seeded draws have no plain SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{scratch_folder(spark)}/stage-{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
