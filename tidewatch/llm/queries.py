"""The queries of this subpackage; ``__spark_entry__`` adds them if it can be imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, lm_score, order_minhash, parts, piece_codec, pii, quality, secret_scan, url_filter
from .common import stored, table

#: A SentencePiece model with byte fallback.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Rows of the labelled URL table.
LABELLED_URLS = 2000


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(secret_scan.searched(table(spark, sf_dir, "documents")), "secrets")
    return secret_scan.digest(secret_scan.scan(found, secret_scan.cuts(found)))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(pii.searched(table(spark, sf_dir, "documents")), "pii")
    return pii.digest(pii.find(found, pii.learn(found)))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(table(spark, sf_dir, "documents"), PIECES, seed=1)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "distances")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = url_filter.train(url_filter.labelled(pages, LABELLED_URLS), LABELLED_URLS)
    return url_filter.judge(pages, model)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(lm_score.marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_secret_scan, op3_near_duplicates, op4_pii, op5_chat, op6_piece_codec, op7_quality_rules, op8_decontamination, op9_url_filter, op10_lm_score)} | parts.QUERIES
ORACLES: dict[str, str] = {"op5_chat": chat.ORACLE} | parts.ORACLES
