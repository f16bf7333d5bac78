"""The queries of this package, by name, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, htmltext, licences, lm, mixing, neardup, quality, resample, spelling, suffixdedup, warc
from .exchange import NO_ID
from .shared import new_path, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2 in turn and share 150 % of all words."""
    mixed = mixing.in_order(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against windows of ten words of the benchmark."""
    d = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return d.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), sha.alias("items_sha256"), "contaminated")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 5-word shingles agree to 85 %."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the policy prose 2."""
    kept = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), ("prose", 2))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.passes(("base", 1))).alias("base_failed"), "kept", "failed")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the licence notices, in windows of all lengths that can match."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents inside 100-byte strings that start earlier too."""
    cut = suffixdedup.remove(table(spark, sf_dir, "documents"))
    ident = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return cut.select(ident.alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a model of those whose id's crc32 modulo 5 isn't 1."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return lm.score(table(spark, sf_dir, "documents"), held_out)


def op10_chat_format(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    if vocabulary is None or pattern is None:
        import public_tokenizers

        vocabulary, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    codec = chat.load(spark, vocabulary, pattern)
    return chat.digest(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations")), codec), codec)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents, drawn by their words' likeness to the benchmark's."""
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, those one letter apart, and the form that each is a slip of."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All documents encoded by a vocabulary of words with word ends, and decoded."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    codec = bpe.load(spark, vocabulary)
    read = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), codec), codec)
    n, ids = F.size("ids").cast("long"), F.array_join(F.col("ids").cast("array<string>"), " ")
    return read.select("doc_id", n.alias("n_tokens"), bpe.digest(ids).alias("ids_sha256"), bpe.digest(F.col("decoded")).alias("decoded_sha256"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
