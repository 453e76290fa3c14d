"""Queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import read_table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.neardup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from waymark.llm.tokens import round_trips

    return round_trips(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.toxicity import scored

    return scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_packed_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from waymark.llm.packing import matrix

    return matrix(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.quality import line_quality

    return line_quality(read_table(spark, sf_dir, "documents"))


def op6_url_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.urlfilter import judged

    return judged(read_table(spark, sf_dir, "pages"))


def op7_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.sharding import sharded

    return sharded(read_table(spark, sf_dir, "documents"))


def op8_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from waymark.llm.packing import packed

    return packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_pruned_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.ann import neighbours

    vectors = read_table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where("vec_id % 50 = 0"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.pii import personal_data

    return personal_data(read_table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.phrases import collocations

    return collocations(read_table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.trie import prefix_trie

    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.pagetext import main_text

    return main_text(read_table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_byte_bpe, op3_toxicity, op4_packed_token_rows, op5_line_quality, op6_url_redirect_equivalence, op7_balanced_label_propagation, op8_min_slack_packing, op9_pruned_graph_neighbours, op10_personal_data, op11_phrase_collocations, op12_conversation_trie, op13_main_text)}


def oracle_sql() -> dict[str, str]:
    from waymark.llm import phrases, trie, urlfilter

    return {"op6_url_redirect_equivalence": urlfilter.ORACLE, "op11_phrase_collocations": phrases.ORACLE, "op12_conversation_trie": trie.ORACLE}
