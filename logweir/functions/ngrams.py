"""Character n-grams inside word boundaries."""

from __future__ import annotations

from .sql import WHITESPACE

# --- fixed values ------------------------------------------------------------------
NGRAM_RANGE = (2, 5)


def char_ngrams(x: str, low: int = NGRAM_RANGE[0], high: int = NGRAM_RANGE[1]) -> str:
    """All n-grams of a text's words, each word lower-cased and padded by a space on both sides.

    A padded word shorter than ``low`` is taken whole, once.
    """
    words = f"filter(split(lower({x}), {_SPACES}), w -> w <> '')"
    sizes = f"sequence(least({low}, length(p)), least({high}, length(p)))"
    grams = f"flatten(transform({sizes}, n -> transform(sequence(1, length(p) - n + 1), i -> substring(p, i, n))))"
    return f"flatten(transform(transform({words}, w -> concat(' ', w, ' ')), p -> {grams}))"


_SPACES = "'[" + "".join(f"\\\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]+'"
