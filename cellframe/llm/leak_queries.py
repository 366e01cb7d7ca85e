"""Query of test items in the corpus."""

from __future__ import annotations

from cellframe.llm.leaks import leaked_items
from cellframe.plans.catalogue import table


def register(query):
    @query()
    def p7_found(spark, folder):
        """Documents that carry at least half of an item's wording, with each item."""
        return leaked_items(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select("doc_id", "item_id")
