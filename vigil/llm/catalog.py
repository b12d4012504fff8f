"""The registered queries of the operators: op<N>_<name> over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import (alignment, chat_format, decontaminate, exact_dedup, jaccard_join, language_id, merkle, mixing, quality, secret_scan, token_files,
                       toxicity, warc)
from vigil.llm.shared import Workspace, held_out, load


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming exact dedup of all documents."""
    found = exact_dedup.dedup(load(spark, sf_dir, "documents"), Workspace(spark, "op1"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of all documents at five words and a similarity of 0.8."""
    found = jaccard_join.similar(load(spark, sf_dir, "documents"), Workspace(spark, "op2"))
    return found.select("doc_id", "class_id", "class_size", "n_links")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    docs = load(spark, sf_dir, "documents")
    found = docs.select("doc_id", secret_scan.scanned(secret_scan.train(docs)).alias("f"))
    return found.select("doc_id", "f.n_assign", "f.n_access", "f.n_hex", "f.base_sha256", "f.spans", "f.n_format")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents."""
    docs = load(spark, sf_dir, "documents")
    model = quality.train(docs, load(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), quality.scored(model).alias("score"))
    return scored.withColumn("predicted", quality.accepted(F.col("score")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings, formatted and read back."""
    tricky = "\\### Assistant: </turn> ok"
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    ws = Workspace(spark, "op5")
    messages = chat_format.chains(rows.unionByName(extra), ws)
    read = chat_format.read_back(chat_format.conversations(chat_format.paths(messages, ws)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in all documents."""
    found = decontaminate.scan(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), Workspace(spark, "op6"))
    return found.drop("key")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ARC files of both versions, converted to WARC files and read back."""
    ws, pages = Workspace(spark, "op7"), load(spark, sf_dir, "pages")
    version = F.when(F.pmod(F.xxhash64("page_id"), F.lit(2)) == 0, 1).otherwise(2)
    for v in (1, 2):
        warc.write_arc(pages.where(version == v), ws.path(f"arc/v{v}"), v)
    warc.convert(ws, ws.path("arc"), ws.path("warc"))
    return warc.read_warc(ws, ws.path("warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    plan = mixing.mix(load(spark, sf_dir, "documents"), Workspace(spark, "op8"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = load(spark, sf_dir, "documents")
    found = docs.select("doc_id", held_out().alias("held_out"), language_id.predicted(language_id.train(docs)).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all documents."""
    docs = load(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, load(spark, sf_dir, "labels"))
    found = docs.select("doc_id", held_out().alias("held_out"), toxicity.scored(lexicon).alias("s"))
    return found.select("doc_id", "held_out", "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.hits")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, and each document's proof, folded from an altered text where three divides the id's CRC-32."""
    ws = Workspace(spark, "op11")
    return merkle.prove(ws, *merkle.manifest(load(spark, sf_dir, "documents"), ws, merkle.lowered_every_third()))


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens by two tokenizers, aligned."""
    return alignment.align(load(spark, sf_dir, "documents"), Workspace(spark, "op12"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids written to files, and what the files hold."""
    ws = Workspace(spark, "op13")
    token_files.write(load(spark, sf_dir, "documents"), ws, ws.path("files"), vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.positions(ws, ws.path("files"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_jaccard_join, op3_secret_scan, op4_quality, op5_chat_format, op6_decontaminate,
                                   op7_warc, op8_mixing, op9_language_id, op10_toxicity, op11_merkle_manifest, op12_token_alignment,
                                   op13_token_files)}
