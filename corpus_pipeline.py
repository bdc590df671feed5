"""Corpus pipeline: from documents to token ids, in stages that are each written and read again.

quality    documents the quality classifier rejects go
near       of each group of SimHash near-duplicates (4-word shingles, at most 4 bits) the smallest doc_id stays
benchmark  documents with a benchmark passage go
secrets    secrets are masked in the text; n_chars follows
tokens     SentencePiece ids of what is left: doc_id, ids and figures of the round trip

Every stage takes nulls, empty texts, repeated rows, further columns and empty tables as its operator says. SQL can't
express the stages; tests compare them with plain versions.
"""

from kilowatch.llm import decontamination, quality, secrets, sentencepiece_lattice, simhash_dedup
from kilowatch.llm.common import written


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark, docs, sf_dir):
    return quality.accepted(docs, _table(spark, sf_dir, "labels"), threshold=0.7)


def near_duplicate_stage(spark, docs, sf_dir):
    return simhash_dedup.deduplicated(docs, size=4, max_bits=4)


def benchmark_stage(spark, docs, sf_dir):
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def secret_stage(spark, docs, sf_dir):
    return secrets.redacted(docs)


def token_stage(spark, docs, sf_dir):
    import public_tokenizers

    return sentencepiece_lattice.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secret_stage),
    ("SentencePiece encoding", token_stage),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
