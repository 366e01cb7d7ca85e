"""Queries of the tokenizer."""

from __future__ import annotations

from cellframe.llm.tokens import decode_corpus, encode_corpus
from cellframe.plans.catalogue import table


def register(query):
    @query()
    def p6_ids(spark, folder):
        """Token ids of every document by byte_bpe_50k."""
        return encode_corpus(table(spark, folder, "documents"))

    @query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
    def p6_round_trip(spark, folder):
        """Every text encoded and decoded again."""
        return decode_corpus(encode_corpus(table(spark, folder, "documents")))
