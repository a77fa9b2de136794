"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costwright.llm import (
    bpe,
    classifier,
    exact,
    hnsw,
    html_crf,
    jaccard,
    merkle,
    ngram_trie,
    packing,
    periodic,
    quality,
    secrets,
    warc_zip,
)
from costwright.llm.oracle import ORACLE_SQL as ORACLE_SQL
from costwright.llm.shared import SPACE, crc_fold, id_text, shipped, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    weights = quality.ratio_weights(docs, trusted, "doc_id", "text")
    return quality.rated(docs, weights)


def op2_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.score(table(spark, sf_dir, "documents"), crc_fold("doc_id", 7) == 2)


def op3_hnsw_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_crf.extract(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE, decoded="decoded").select(
        "doc_id",
        F.expr("cast(length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_zip.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_secret_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = [f"'{kind}'" for kind in secrets.BASE_KINDS]
    spans = "concat_ws(',', transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)))"
    return found.select(
        "doc_id",
        *(
            F.expr(f"cast(size(filter(secrets, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
            for kind in secrets.BASE_KINDS
        ),
        F.expr(f"sha2({spans.format(f'filter(secrets, s -> s.kind in ({", ".join(base)}))')}, 256)").alias("base_sha256"),
        F.expr(spans.format("secrets")).alias("spans"),
    )


def op9_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = table(spark, sf_dir, "labels").filter(crc_fold("doc_id", 3) != 1)
    scored = classifier.score(docs.select("doc_id", "text"), classifier.fit(docs, learned)).drop("text")
    return scored.select(
        "doc_id",
        (crc_fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        F.expr("if(score >= 0.5, 1, 0)").alias("predicted"),
    )


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op11_veb_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    small = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(crc_fold("doc_id", 5) == 0, merkle.record_digest(*others, small))
    manifest = merkle.build(docs, merkle.record_digest(*others, F.col("text")), carry={"tampered": tampered})
    return merkle.proofs(manifest, claimed="tampered").drop("tampered")


def op12_progressive_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Of each tenth document by the hash of its id, the words from some place on repeat with some period."""
    words = F.filter(F.split("text", f"{SPACE}+"), lambda w: w != "")
    h = F.crc32(id_text("doc_id").cast("binary"))
    docs = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    docs = docs.select("*", F.size("words").cast("long").alias("n"), F.expr("h div 10").alias("g"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr(
        "concat(slice(words, 1, cast(a as int)), slice(flatten(array_repeat("
        "slice(words, cast(a + 1 as int), cast(p as int)), cast((n - a) div p + 1 as int))), 1, cast(n - a as int)))"
    )
    text = F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(planted, " ")).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_with_planted_runs(table(spark, sf_dir, "documents")))
    lines = "concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))"
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.*",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


Query = Callable[[SparkSession, str], DataFrame]


def _registered(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shipped(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    query.__name__: _registered(query)
    for query in (
        op1_quality_ratio,
        op2_ngram_trie,
        op3_hnsw_near_duplicates,
        op4_jaccard_join,
        op5_crf_main_text,
        op6_trie_bpe,
        op7_warc_zip,
        op8_secret_structures,
        op9_subword_classifier,
        op10_harmonic_packing,
        op11_veb_merkle_manifest,
        op12_progressive_exact,
        op13_periodic_runs,
    )
}
