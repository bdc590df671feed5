"""The registered query of every operator, and SQL where SQL can express it."""

from kilowatch.llm import chat, decontamination, fingerprints, licences, prefix_trie, quality, quality_rules, secrets, sentencepiece_lattice, simhash_dedup, spelling, token_files, warc
from kilowatch.session import shared_folder


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark, sf_dir):
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], rows.schema)
    return chat.digests(chat.formatted(rows.unionByName(more)))


def op2_document_fingerprints(spark, sf_dir):
    """Sketches of all documents and of their edited texts."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    """Benchmark items found in all documents."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash_dedup(spark, sf_dir):
    """Near-duplicate classes of all documents: 4-word shingles, at most 4 differing bits."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4, max_bits=4)


def op5_sentencepiece(spark, sf_dir):
    """Ids of all documents, decoded again."""
    import public_tokenizers

    return sentencepiece_lattice.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality_classifier(spark, sf_dir):
    """Quality scores of all documents."""
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op7_warc(spark, sf_dir):
    """All pages as WARC archives, read back through the merged index."""
    path = shared_folder(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path, min_bytes=0)
    index = warc.capture_index(spark, path)
    first = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return index.select(*first, "urlkey", "captured_at", "file", "offset", "length")


def op8_licence_scans(spark, sf_dir):
    """Licences stated in all documents."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_token_files(spark, sf_dir):
    """All documents as files of 16-bit token ids, read back."""
    import public_tokenizers

    path = shared_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)
    return token_files.read_documents(spark, path)


def op10_secret_scans(spark, sf_dir):
    """Secrets in all documents."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark, sf_dir):
    """Words of all documents with their spelling variants, forms and roots."""
    found = spelling.variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_quality_rules(spark, sf_dir):
    """All documents judged by fixed limits and by robust distances within their language and source."""
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark, sf_dir):
    """All nodes of the trie of rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def queries():
    found = (
        op1_chat_formatting,
        op2_document_fingerprints,
        op3_decontamination,
        op4_simhash_dedup,
        op5_sentencepiece,
        op6_quality_classifier,
        op7_warc,
        op8_licence_scans,
        op9_token_files,
        op10_secret_scans,
        op11_spelling_variants,
        op12_quality_rules,
        op13_prefix_trie,
    )
    return {f.__name__: f for f in found}


def oracle_sql():
    return {}
