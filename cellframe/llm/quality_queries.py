"""Queries of text quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellframe.llm.quality import NAMED, junk_probability, statistics
from cellframe.plans.catalogue import table


CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}"
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLANK = rf"^(?:{SPACE}|[\x{{feff}}\x{{200b}}])*$"
LETTERS = rf"[\p{{L}}\p{{Nl}}\p{{No}}]"
# Characters that are neither space, letter, digit, mark nor punctuation of prose or of lists.
SYMBOLS = rf"[^{SPACE[1:-1]}{CJK}\p{{L}}\p{{Nd}}\p{{Mn}}\p{{Mc}}\p{{Cf}},;/|.:!?()'\"。、，；：！？（）「」-]|[\x{{10000}}-\x{{10ffff}}]"
STATISTICS = rf"""WITH common AS (SELECT DISTINCT lower(word) AS word FROM common_words WHERE word IS NOT NULL AND NOT regexp_matches(word, '[{CJK}]')),
asian AS (SELECT string_agg(word, '|' ORDER BY length(word) DESC, word) AS words FROM (SELECT DISTINCT word FROM common_words WHERE regexp_matches(word, '[{CJK}]'))),
plain AS (SELECT doc_id, regexp_replace(text, '</?[A-Za-z][^<>]{{0,200}}>', ' ', 'g') AS text FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '{BLANK}')),
parts AS (SELECT doc_id, text, trim(regexp_replace(text, '{SPACE}+', ' ', 'g')) AS flat, regexp_matches(text, '[{CJK}]') AS cjk FROM plain),
words AS (SELECT *, regexp_extract_all(lower(flat), CASE WHEN cjk THEN '[{CJK}]|(?:[^{CJK}\P{{L}}]|\p{{Nl}}|\p{{No}})+' ELSE '{LETTERS}+' END) AS w,
  list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^{SPACE}*$')) AS filled FROM parts),
lines AS (SELECT *, CASE WHEN len(filled) > 0 THEN filled ELSE [text] END AS l FROM words),
known AS (SELECT doc_id, count(*) FILTER (word IN (SELECT word FROM common)) AS k FROM (SELECT doc_id, unnest(w) AS word FROM words) GROUP BY doc_id),
asked AS (SELECT doc_id, coalesce(list_sum(list_transform(CASE WHEN cjk THEN regexp_extract_all(flat, words) ELSE [] END, lambda x: length(x))), 0) AS k FROM parts, asian)
SELECT doc_id, len(w)::DOUBLE AS words, round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(1, len(w)), 9) AS mean_word_length,
  round(len(regexp_extract_all(flat, $S${SYMBOLS}$S$)) / greatest(1, length(flat)), 9) AS symbol_ratio,
  round(len(list_filter(l, lambda x: regexp_matches(x, $S$[.!?。！？:：;；,，、…][ \t\r"'”’»」』)\]）]*$$S$))) / len(l), 9) AS punctuated_lines,
  round((coalesce(known.k, 0) + asked.k) / greatest(1, len(w)), 9) AS common_words
FROM lines LEFT JOIN known USING (doc_id) JOIN asked USING (doc_id)
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL FROM documents WHERE regexp_matches(coalesce(text, ''), '{BLANK}')"""


def register(query):
    @query()
    def p8_found(spark, folder):
        """Documents that as a whole are no running text."""
        scored = junk_probability(table(spark, folder, "documents"), table(spark, folder, "common_words"))
        return scored.where("probability > 0.5").select("doc_id").distinct()

    @query(STATISTICS)
    def p8_statistics(spark, folder):
        """Word count, mean word length, symbol ratio, share of punctuated lines and of common words of each text."""
        measured = statistics(table(spark, folder, "documents"), table(spark, folder, "common_words"))
        return measured.select("doc_id", *(F.round(F.col("features")[i], 9).alias(n) for i, n in enumerate(NAMED)))
