"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomtide.llm.lines import remove_repeats

WINDOW = 3


def line_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut what later occurrences of repeated windows cover; see :func:`remove_repeats` for columns and special cases.

    A line that repeats on its own stays: only a repeat of ``window`` consecutive
    lines counts.
    """
    return remove_repeats(docs, "line", window, 1, 1, id_col, text_col)
