"""Language of a text by stop-word votes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.text import let, truncate_text

# Words that vote for a language.
STOP_WORDS = {
    "en": "the and of to in is that for it with as was on are this be from at by not",
    "es": "el los las y del que es por con para una se lo su al como más pero sus está",
    "fr": "le les et des est que du dans pour une sur pas qui au avec ce il sont par plus",
    "de": "der die das und ist nicht ein eine mit für auf von dem den zu sich auch wie an im",
    "it": "il gli e di che è per una con non sono della del si nel alla più come anche dei",
    "pt": "o os as e do da que em para com um uma não é dos mais na no ao se",
}

DEFAULT_LANGUAGE = "en"


def language_votes(text: Column, max_chars: int | None = None) -> Column:
    """Stop words per language, as a struct with one count for each.

    Reads the whole text by default.
    """
    every = list(dict.fromkeys(" ".join(STOP_WORDS.values()).split()))
    words = F.split(F.lower(truncate_text(text, max_chars)), r"[^\p{L}]+", -1)
    # Most words vote for nobody; drop them before counting six times.
    words = F.filter(words, lambda w: w.isin(*every))

    def count(words: Column, language: str) -> Column:
        own = STOP_WORDS[language].split()
        found = F.size(F.filter(words, lambda w: w.isin(*own)))
        return F.coalesce(found, F.lit(0)).alias(language)

    return let(words, lambda words: F.struct(*(count(words, language) for language in STOP_WORDS)))


def best_language(votes: Column) -> Column:
    """The language with most votes; the first listed of equals, English for none."""
    counts = [votes[language] for language in STOP_WORDS]
    top = F.greatest(*counts)
    chosen = F.when(F.coalesce(top, F.lit(0)) == 0, F.lit(DEFAULT_LANGUAGE))
    for language, count in zip(STOP_WORDS, counts):
        chosen = chosen.when(count == top, F.lit(language))
    return chosen


def detect_language(text: Column, max_chars: int | None = None) -> Column:
    """The language of a text, one of `STOP_WORDS`."""
    return let(language_votes(text, max_chars), best_language)
