"""The operators as queries over the whole test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline.llm import conversations, decontaminate, digest, filter_audit, html_text, language_id, lattice_lm, minhash, packing, pii
from fleetline.llm import quality, sharding, simhash
from fleetline.llm.common import bounded_batches, fold, table
from fleetline.session import staged

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def bounded(spark, sf):
        bounded_batches(spark)
        return fn(spark, sf)

    _QUERIES[fn.__name__] = bounded
    return bounded


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


@query
def op9_fingerprints(spark, sf):
    return digest.digest_and_neighbours(table(spark, sf, "documents"))


@query
def op10_sharding(spark, sf):
    """Texts are reduced to size and checksum before rows are dealt, as only those are returned."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf, "documents").select(
        "doc_id", F.xxhash64(text).alias("hash"), (F.octet_length(text.cast("binary")) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard_rows(rows, shards=8, hash_col="hash").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_packing(spark, sf):
    packed = packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                    public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op1_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op3_quality(spark, sf):
    """Statistics are written once; the fit and the scores read them."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    measured = staged(quality.with_statistics(docs).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "statistics"), "statistics")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    model = quality.fit(measured.filter("NOT held_out").join(labels, "doc_id"))
    return quality.with_scores(measured, model).select("doc_id", "held_out", "score", "predicted")


@query
def op5_language(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 4) == 2)
    model = language_id.fit(docs.filter("NOT held_out"))
    return language_id.identify(docs, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op8_pii(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    marked = staged(pii.with_candidates(docs).select("doc_id", "candidates"), "candidates")
    found = pii.with_spans(marked, pii.fit(marked))
    base = F.filter("spans", lambda s: s["base"])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query
def op2_html(spark, sf):
    return html_text.extract(table(spark, sf, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@query
def op4_decontamination(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op6_lattice_lm(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = lattice_lm.score_documents(docs, fold("doc_id", 5) != 1, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", (~F.col("learned_from")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "piece_score")


@query
def op11_conversations(spark, sf):
    """The rows are damaged as the contract says before they are audited."""
    return conversations.audit(conversations.damaged(table(spark, sf, "conversations"))).withColumnRenamed("conv", "conv_id")


@query
def op12_minhash(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"))


@query
def op13_filter_audit(spark, sf):
    return filter_audit.report(filter_audit.combinations(table(spark, sf, "documents"), table(spark, sf, "labels")))
