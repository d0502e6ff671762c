"""The queries of this subpackage, by name, over the given tables."""

from __future__ import annotations

from lodestone.llm import arc_convert, chat_format, class_lm, edit_counts, audio_fingerprint, hard_negatives, jaccard_join, language_id, mixing, quality_rules, sentencepiece_codec, token_alignment, toxicity
from lodestone.llm.common import table


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {
    "op1_mixing": lambda spark, d: mixing.query(table(spark, d, "documents")),
    "op2_sentencepiece": lambda spark, d: sentencepiece_codec.encoded(table(spark, d, "documents"), _public("piece_bpe_32k.model")),
    "op3_edit_aware_counts": lambda spark, d: edit_counts.query(table(spark, d, "documents"), _public("byte_bpe_50k.tiktoken")),
    "op4_chat_format": lambda spark, d: chat_format.query(table(spark, d, "conversations")),
    "op5_toxicity": lambda spark, d: toxicity.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_language_id": lambda spark, d: language_id.query(table(spark, d, "documents")),
    "op7_audio_fingerprint": lambda spark, d: audio_fingerprint.query(table(spark, d, "embeddings")),
    "op8_quality_rules": lambda spark, d: quality_rules.query(table(spark, d, "documents")),
    "op9_arc_to_warc": lambda spark, d: arc_convert.query(table(spark, d, "pages")),
    "op10_ngram_jaccard_join": lambda spark, d: jaccard_join.query(table(spark, d, "documents")),
    "op11_token_alignment": lambda spark, d: token_alignment.query(table(spark, d, "documents"), _public),
    "op12_class_ngrams": lambda spark, d: class_lm.query(table(spark, d, "documents")),
    "op13_hard_negatives": lambda spark, d: hard_negatives.query(table(spark, d, "embeddings")),
}
ORACLE_SQL = {"op4_chat_format": chat_format.ORACLE_SQL, "op8_quality_rules": quality_rules.oracle_sql(), "op13_hard_negatives": hard_negatives.ORACLE_SQL}
