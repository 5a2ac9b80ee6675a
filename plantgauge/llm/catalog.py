"""The registered queries of this folder, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantgauge.llm.common import table, whole_text
from plantgauge.llm.twins import TWINS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(TWINS)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_quality_rules(spark, folder):
    """Figures and verdict of every document."""
    from plantgauge.llm.quality_rules import quality_rules

    docs = table(spark, folder, "documents").select("doc_id", "text")
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept kept_words".split()
    return quality_rules(docs).select(*columns)


@query
def op9_sharding(spark, folder):
    """Every document in one of 40 shards; only the figures of a row are moved."""
    from plantgauge.llm.sharding import hypergeometric_shards

    bytes_ = F.encode(whole_text(), "UTF-8")
    rows = table(spark, folder, "documents").select(
        "doc_id", (F.length(bytes_) + 16).cast("long").alias("size"), F.crc32(bytes_).cast("long").alias("text_crc32")
    )
    out = hypergeometric_shards(rows, 40, seed=9)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_license_scan(spark, folder):
    """License phrases and notices of every document."""
    from plantgauge.llm.license_scan import license_scan

    return license_scan(table(spark, folder, "documents").select("doc_id", "text"))[0]


@query
def op6_pii(spark, folder):
    """Personal data of every document."""
    from plantgauge.llm.pii import BASE, base_count, find_personal_data, span_digest

    rows = find_personal_data(table(spark, folder, "documents").select("doc_id", "text"))
    spans = F.col("pii")
    return rows.select(
        "doc_id",
        *[base_count(spans, kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(span_digest(spans, True), 256).alias("base_sha256"),
        span_digest(spans, False).alias("spans"),
    )


@query
def op5_sentencepiece(spark, folder):
    """Token ids of every document with the installed public piece model."""
    from plantgauge.llm.sentencepieces import encode_documents

    rows = encode_documents(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_tokens", "token_ids", "round_trip")


@query
def op8_near_dedup(spark, folder):
    """Near-duplicate class of every document."""
    from plantgauge.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op1_decontamination(spark, folder):
    """Every document and benchmark item it leaks."""
    from plantgauge.llm.decontaminate import find_leaks

    rows = find_leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return rows.select("doc_id", F.inline("leaks")).select(
        "doc_id", F.col("item").alias("item_id"), *[F.round(c, 6).alias(c) for c in ("lcs_share", "answer_share", "cosine")]
    )


@query
def op4_html_extraction(spark, folder):
    """Main text of every page."""
    from plantgauge.llm.html_extract import extract_articles

    rows = extract_articles(table(spark, folder, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op3_repeated_strings(spark, folder):
    """Bytes of every document that a repeated string of 400 bytes covers, and the text without them."""
    from plantgauge.llm.repeated_strings import drop_repeated_strings

    docs = table(spark, folder, "documents")
    rows = drop_repeated_strings(docs.select("doc_id", F.col("text").alias("whole")), "whole")
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))


@query
def op2_near_passages(spark, folder):
    """Every passage of a document that another document holds too."""
    from plantgauge.llm.near_passages import near_passages

    return near_passages(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op11_collocations(spark, folder):
    """The first phrases of every language by how much they exceed chance."""
    from plantgauge.llm.collocations import collocations

    return collocations(table(spark, folder, "documents").select("doc_id", "text", "lang"))


@query
def op12_spelling_variants(spark, folder):
    """Near words, form and root of every frequent word."""
    from plantgauge.llm.spelling import spelling_variants

    return spelling_variants(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op13_warc(spark, folder):
    """Every page through an archive and back."""
    from plantgauge.llm.warc import read_archives, write_archives
    from plantgauge.session import fresh_folder

    path = fresh_folder(spark, "warc")
    write_archives(table(spark, folder, "pages").select("page_id", "url", "html"), path)
    rows = read_archives(spark, path, payloads=False, strict=True)
    return rows.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
