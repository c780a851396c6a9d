"""Registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollatlas.llm import (
    decontamination, graphs, importance, jaccard, language, matrices, packing, repeats, sharding, spelling, statements as sql,
    toxicity, urlrules, warc,
)
from rollatlas.llm.shared import new_folder, ship, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    model = language.fit(language.training_rows(docs, ~held_out))
    found = language.identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_graph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = graphs.usable(table(spark, folder, "embeddings"))
    return graphs.search(graphs.build_index(rows), rows.filter("id % 50 = 0"))


def op3_packed_matrices(spark: SparkSession, folder: str) -> DataFrame:
    return matrices.packed_matrices(table(spark, folder, "documents"), TOKENIZER)


def op4_packed_windows(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), TOKENIZER)


def op5_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = new_folder(spark, "warc")
    warc.write_warc(warc.page_records(table(spark, folder, "pages")), archive)
    return warc.archived_pages(warc.read_warc(spark, archive))


def op7_benchmark_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.shared_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    model = toxicity.fit(toxicity.labelled_rows(docs, table(spark, folder, "labels"), ~held_out))
    found = toxicity.score(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeat_digests(table(spark, folder, "documents"))


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return urlrules.judge(table(spark, folder, "pages"), urlrules.rule_table(spark, urlrules.RULES))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, folder, "documents"))


def _sent(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [k for k, f in globals().items() if k.startswith("op") and callable(f)]
    return {k: _sent(globals()[k]) for k in sorted(found, key=lambda k: int(k[2:].split("_")[0]))}


def statements() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return sql.statements()
