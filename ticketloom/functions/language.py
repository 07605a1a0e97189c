"""Language tag of a raw ticket text: en, hi, hinglish or other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketloom.functions.text import bind, is_blank

# Script blocks, Latin words, and everyday Hindi words in Latin script.
DEVANAGARI = r"[\x{900}-\x{97F}]"
OTHER_INDIC = r"[\x{980}-\x{D7F}]"
LATIN_WORD = "[a-zA-Z']+"
# U+0130 and U+212A lower-case to i and k.
LATIN_LETTERS = r"[a-zA-Z\x{130}\x{212A}]+"
LETTERS = r"\p{L}+"
HINGLISH_LEXICON = [
    "nahi", "nahin", "nai", "nhi", "mera", "meri", "mere", "hai", "hain",
    "kya", "kyun", "kyu", "kaise", "kab", "abhi", "paise", "paisa",
    "kat", "kata", "gaya", "gayi", "gaye", "krdo", "karo", "bhai", "yaar",
    "band", "hogaya", "kyunki", "lekin", "magar", "toh", "tha", "thi",
    "raha", "rahi", "mujhe", "mujhko", "unka", "uska", "yeh", "woh",
    "kripya", "dhanyavad", "shukriya", "jaldi", "bahut", "galat",
    "samjhao", "dikha", "hoon", "sakte", "aap", "aapke", "naya",
]
SHORT_TEXT_TOKENS = 8
MIN_LATIN_RATIO = 0.5


def latin_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LATIN_WORD), F.lit(0))


def _hits(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*HINGLISH_LEXICON)))


def lexicon_hits(text: Column) -> Column:
    """Occurrences of lexicon words, repeats counted."""
    return _hits(latin_tokens(text))


def latin_ratio(text: Column) -> Column:
    """Latin letters over all letters; NULL when the text has no letter.

    Letters come in runs, so removing them takes few matches; their number is the length lost.
    """
    lost = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")
    return F.try_divide(lost(LATIN_LETTERS), lost(LETTERS))


def detect_language(text: Column) -> Column:
    """Cheap script tests first; tokens and hits are computed once, and only if those fail."""

    def by_words(tokens: Column) -> Column:
        n = F.size(tokens)
        return bind(
            _hits(tokens),
            lambda hits: F.when(n == 0, "other")
            .when((hits >= 2) | ((hits == 1) & (n <= SHORT_TEXT_TOKENS)), "hinglish")
            .when(latin_ratio(text) < MIN_LATIN_RATIO, "other")
            .otherwise("en"),
        )

    return (
        F.when(is_blank(text), "other")
        .when(F.regexp_like(text, F.lit(DEVANAGARI)), "hi")
        .when(F.regexp_like(text, F.lit(OTHER_INDIC)), "other")
        .otherwise(bind(latin_tokens(text), by_words))
    )
