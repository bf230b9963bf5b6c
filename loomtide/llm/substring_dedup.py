"""Substring dedup by line, sentence or paragraph hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomtide.llm.lines import remove_repeats

UNIT = "sentence"  # a passage that begins or ends inside a line still has whole sentences
MIN_WORDS = 25  # of a run of consecutive repeated units: a passage of over 50 words without its first and last sentence
MIN_UNIT = 8  # of the run's longest unit: one-word lines in a row are no passage


def substring_dedup(docs: DataFrame, unit: str = UNIT, min_words: int = MIN_WORDS, min_unit: int = MIN_UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep the first occurrence of each unit in the corpus and cut runs of later ones that are long enough.

    A run goes if it has at least ``min_words`` words and one unit of at least
    ``min_unit``; with 1 and 1 every later occurrence goes, whatever its length.
    See :func:`remove_repeats` for columns and special cases.
    """
    return remove_repeats(docs, unit, 1, min_words, min_unit, id_col, text_col)
