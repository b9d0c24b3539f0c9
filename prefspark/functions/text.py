"""Text cleaning as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Characters that survive cleaning, and the blanks that separate words.
KEPT_LETTERS = "A-Za-zÀÈÌÒÙÁÉÍÓÚàèìòùáéíóúäöüÄÖÜß"
KEPT_BLANKS = " \\t\\n\\x0B\\f\\r"
WORD_BREAK = "[ \\t\\n\\r\\f]+"

# A short default; pass your own list or a table read with `read_stop_words`.
DEFAULT_STOP_WORDS = (
    # German
    "aber als am an auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen "
    "einer eines er es für hat ich ihr im in ist ja mit nach nicht noch nur oder sich sie sind so "
    "und uns vom von vor war was wie wir zu zum zur "
    # English
    "a and are as at be by for from has he is it its of on or that the they this to was were will with "
    # French
    "au aux avec ce ces dans de du elle en et eux il la le les leur lui mais ne nous ou par pas pour "
    "que qui sa se ses son sur un une vous "
    # Spanish
    "al como con del el ella entre ha hay lo los las más mi muy no nos para pero por se sin sobre su "
    "sus también tiene todo una uno y ya"
)


def stop_word_list(words: str | Iterable[str] = DEFAULT_STOP_WORDS) -> list[str]:
    words = words.split() if isinstance(words, str) else words
    return sorted({w.strip() for w in words if w.strip()})


def strip_bad_chars(text: Column) -> Column:
    """Delete every character that is neither a kept letter nor a blank."""
    return F.regexp_replace(text, f"[^{KEPT_LETTERS}{KEPT_BLANKS}]+", "")


def words(text: Column) -> Column:
    """Array of words: runs between blanks, no empty strings."""
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def remove_stopwords(text: Column, stop_words: str | Iterable[str] = DEFAULT_STOP_WORDS) -> Column:
    """Lower-case, drop stop words, join what is left with single blanks."""
    stop = stop_word_list(stop_words)
    kept = F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: ~w.isin(["", *stop]))
    return F.array_join(kept, " ")


def clean(text: Column, stop_words: str | Iterable[str] = DEFAULT_STOP_WORDS) -> Column:
    return remove_stopwords(strip_bad_chars(text), stop_words)


def has_min_words(text: Column, n: int) -> Column:
    return F.size(words(text)) >= n
