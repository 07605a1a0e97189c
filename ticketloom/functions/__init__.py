from ticketloom.functions.language import detect_language, lexicon_hits, latin_ratio
from ticketloom.functions.sla import due_at, sla_hours, sla_remaining_min, urgency_display
from ticketloom.functions.text import (
    is_blank,
    normalize,
    preview,
    snippet,
    token_highlight,
    word_ngrams,
    word_tokens,
)

__all__ = [
    "detect_language",
    "due_at",
    "is_blank",
    "latin_ratio",
    "lexicon_hits",
    "normalize",
    "preview",
    "sla_hours",
    "sla_remaining_min",
    "snippet",
    "token_highlight",
    "urgency_display",
    "word_ngrams",
    "word_tokens",
]
