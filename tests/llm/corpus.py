"""Small corpora for the tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


SYLLABLES = ["ba", "ko", "ri", "tu", "men", "sol", "ne", "va", "lim", "do", "gar", "shu"]


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def awkward() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    rng = random.Random(3)
    long = " ".join(prose(rng, 60_000))
    plain = " ".join(prose(rng, 80))
    return [
        (1, plain, "en", "a", 1),
        (2, plain, "en", "a", None),
        (2, plain, "en", "a", None),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n\x0b\f\r ", "en", "b", 7),
        (6, "x" * 300_000, "en", "", 300_000),
        (7, long, "en", None, len(long)),
        (8, "one two three", "en", "b", 13),
        (9, "One  TWO three", "en", "b", 14),
        (10, "a\r\n\r\nb <|endoftext|> \\### c </turn> 🙂 Σ́", "en", "c", 1),
        (None, plain, "en", "c", 1),
        (11, "word " * 5000, "en", "a", 1),
    ]


CLASHES = ["n_words", "kept", "id", "key", "size", "start", "t", "d", "target", "rank", "host", "component_id", "_measures", "N_LINES", "n_dropped", "length", "h"]


def with_clashes(df):
    """The frame with more columns, whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(c).alias(c) for c in CLASHES])
