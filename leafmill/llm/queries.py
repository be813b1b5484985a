"""The dealt operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.chat_examples import chat_examples, example_columns
from leafmill.llm.common import fold, table
from leafmill.llm.decontaminate import contamination_columns, find_contamination
from leafmill.llm.fingerprints import edited_fingerprints
from leafmill.llm.lm_scores import score_texts
from leafmill.llm.near_copies import near_copies
from leafmill.llm.packing import pack_documents
from leafmill.llm.page_text import extract_pages
from leafmill.llm.periodic_runs import periodic_runs, repeat_tails, run_columns
from leafmill.llm.pii import pseudonymise_documents
from leafmill.llm.quality import fit_quality, score_quality
from leafmill.llm.spelling_variants import count_words, spelling_variants
from leafmill.llm.suffix_dedup import remove_repeats
from leafmill.llm.toxicity import fit_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn
    return register


@query("op2_bradley_terry_quality")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit_quality(docs, labels, fold("doc_id", 5) != 0)
    return score_quality(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def vocabulary() -> str:
    """The tokenizer file of the packing query, where the installed package has it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_residual_packing")
def packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), vocabulary())


#: The key of the pseudonyms in the query and the pipeline; a user brings one of their own.
PSEUDONYM_KEY = b"leafmill-test-key"


@query("op6_feistel_pseudonyms")
def pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymise_documents(table(spark, folder, "documents"), PSEUDONYM_KEY)


@query("op5_nnpu_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = fit_toxicity(docs, labels, fold("doc_id", 3) != 1)
    return score_toxicity(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query("op8_fm_index_decontamination")
def contamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination_columns(find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query("op7_ngram_jaccard_join")
def jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(table(spark, folder, "documents"))


@query("op1_suffix_array_dedup")
def without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_winnowing_fingerprints")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(table(spark, folder, "documents"))


@query("op10_min_cut_extraction")
def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(table(spark, folder, "pages"))


@query("op9_bloom_language_model")
def language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score_texts(docs, fold("doc_id", 7) != 2).select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_minimizer_runs")
def word_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_columns(periodic_runs(repeat_tails(table(spark, folder, "documents"))))


#: What conversation -1 says in both its turns.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query("op12_prefix_targets", rf"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')),
    written AS (
        SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
            23 + length(regexp_replace(role, '(<|\[)(\\*)(\||/?s>|/?INST\]|/?SYS>)', '\1\\\2\3', 'g'))
               + length(regexp_replace(text, '(<|\[)(\\*)(\||/?s>|/?INST\]|/?SYS>)', '\1\\\2\3', 'g')) AS chars
        FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    placed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS so_far FROM written)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(so_far) FILTER (role = 'assistant' OR place = n)::BIGINT AS formatted_chars
    FROM placed GROUP BY conv_id
""")
def chat(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CONTROL_TEXT).alias("text"))
    added = added.select(*[F.col(f.name).cast(f.dataType) for f in given.schema])
    return example_columns(chat_examples(given.unionByName(added)))


@query("op13_asymmetric_q_chunks")
def spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(count_words(table(spark, folder, "documents"), fraction=199))
