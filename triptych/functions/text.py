"""Column expressions for tokens and n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two or more word characters. The class form sees accented letters in every engine;
# `\b\w\w+\b` does not.
TOKEN = r"[\p{L}\p{N}_]{2,}"

# Default stop list, a parameter of every operator that drops stop words.
STOP_WORDS = (
    "a about above after again all am an and any are as at be because been before being below "
    "between both but by can could did do does doing down during each few for from further had "
    "has have having he her here hers him his how i if in into is it its itself just me more "
    "most my no nor not now of off on once only or other our ours out over own same she should "
    "so some such than that the their theirs them then there these they this those through to "
    "too under until up very was we were what when where which while who whom why will with "
    "would you your yours"
).split()


def tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-case words of two or more characters, stop words dropped, order and repeats kept."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(*stop_words))


def bigrams(words: Column) -> Column:
    """Pairs of neighbours, in order (neighbours after stop-word removal)."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    # The last word has no right neighbour: its pair is missing.
    return F.array_compact(pairs)
