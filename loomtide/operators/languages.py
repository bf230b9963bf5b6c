"""Language detection by frequent short words (JVM expressions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common words by language.
WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "with", "for", "was"],
    "fr": ["le", "la", "les", "des", "et", "une", "que", "qui", "dans", "pour"],
    "de": ["der", "die", "und", "das", "nicht", "mit", "ein", "eine", "von", "sich"],
    "es": ["el", "los", "las", "del", "una", "con", "por", "para", "su", "y"],
}


def detect(docs: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(key, language): the language most of whose common words occur in the text, null below ``least``."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{IsAlphabetic}]+"))
    hits = [F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, ws)))).alias("n"), F.lit(lang).alias("lang")) for lang, ws in WORDS.items()]
    best = F.array_max(F.array(*hits))
    return docs.select(key, F.when(best["n"] >= least, best["lang"]).alias("language"))
