"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, exact_dedup, mixing, ngram_jaccard, quality_classifier, quality_rules, repeats, sentencepieces, url_filters, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_chat_rotation": chat.op2_chat_rotation,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_warc": warc.op4_warc,
    "op5_ngram_jaccard": ngram_jaccard.op5_ngram_jaccard,
    "op6_repeats": repeats.op6_repeats,
    "op7_sentencepiece": sentencepieces.op7_sentencepiece,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_mixing": mixing.op9_mixing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op2_chat_rotation": chat.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
    "op8_url_filters": url_filters.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
