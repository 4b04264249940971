"""Severity names, their order, and the two ways a line gets one."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Level names in rank order 0..4.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")

# Other spellings of a level token, upper-case form -> level.
ALIASES = {"WARN": "WARNING", "ERR": "ERROR", "CRIT": "CRITICAL", "FATAL": "CRITICAL"}

# Words whose presence anywhere in a line sets its level, the first hit wins.
CONTENT_WORDS = (
    ("CRITICAL", ("CRITICAL", "FATAL", "EMERG")),
    ("ERROR", ("ERROR", "ERR")),
    ("WARNING", ("WARNING", "WARN")),
    ("DEBUG", ("DEBUG",)),
)

DEFAULT_LEVEL = "INFO"


_SPELLINGS = {level: level for level in LEVELS} | ALIASES


def rank_of(name: str) -> int:
    """Rank of a level given by the caller; a name that is no level raises."""
    exact = name if name in (name.upper(), name.lower()) else ""
    level = _SPELLINGS.get(exact.upper())
    if level is None:
        raise ValueError(f"not a severity level: {name!r}")
    return LEVELS.index(level)


def token_rank(token: Column) -> Column:
    """Rank of a level token written all-upper or all-lower; null for any other word.

    A lookup in a constant map, so that the token is computed once.
    """
    ranks = {word: LEVELS.index(level) for word, level in _SPELLINGS.items()}
    both_cases = ranks | {word.lower(): rank for word, rank in ranks.items()}
    table = F.create_map(*[F.lit(x) for pair in both_cases.items() for x in pair])
    return F.try_element_at(table, token)


def to_string(rank: Column) -> Column:
    """Level name of a rank, ``UNKNOWN`` outside 0..4."""
    return F.coalesce(F.get(F.array(*[F.lit(level) for level in LEVELS]), rank), F.lit("UNKNOWN"))


def from_string(token: Column) -> Column:
    """Level name of a token, null when it is none."""
    return F.get(F.array(*[F.lit(level) for level in LEVELS]), token_rank(token))


def content_rank(value: Column, word_boundary: bool = False) -> Column:
    """Rank of the level named by the words of a line, in any ASCII case; null if there is none.

    Lower-casing is used because it is ASCII-exact for these words: no other letter
    lower-cases to a plain a-z letter they contain. ``word_boundary`` asks for whole words, so
    that "transferred" is not an error.
    """
    text = F.lower(value)
    branches = None
    for level, words in CONTENT_WORDS:
        if word_boundary:
            hit = text.rlike(r"\b(?:" + "|".join(w.lower() for w in words) + r")\b")
        else:
            # A word that contains another of the same level adds nothing to the search.
            needed = [w for w in words if not any(o != w and o in w for o in words)]
            hit = text.contains(needed[0].lower())
            for word in needed[1:]:
                hit = hit | text.contains(word.lower())
        rank = LEVELS.index(level)
        branches = F.when(hit, rank) if branches is None else branches.when(hit, rank)
    return branches


def line_rank(value: Column, token: Column, word_boundary: bool = False) -> Column:
    """Rank of a line: its words decide, else its level token, else INFO."""
    return F.coalesce(
        content_rank(value, word_boundary), token_rank(token),
        F.lit(LEVELS.index(DEFAULT_LEVEL)))
