"""The pre-tokens of ``public_tokenizers.PATTERN``, found with array operations.

Equal to ``regex.findall(PATTERN, text)`` for every text; the tests hold both against each other.
"""

from __future__ import annotations

import numpy as np

from textscore.llm.chars import END, LETTER, OTHER, SPACE, Alphabet

# Letters after an apostrophe that the pattern keeps with it.
ONE = "stmd"
TWO = ("re", "ve", "ll")


def split(points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pre-tokens of a chunk read by ``Alphabet.read``.

    Runs of one kind are the pre-tokens, but for two rules. Of white space before
    something else, the last character stands alone, and joins what follows if it is a
    plain space. An apostrophe alone between such runs takes the letters of an English
    contraction with it.
    """
    n = len(kinds)
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:n])
    # adjacent END places each are a run of their own
    start[np.flatnonzero(kinds == END)] = True

    last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & (kinds[1:] != END))
    start[last] = True
    start[last[points[last] == 32] + 1] = False

    quote = np.flatnonzero((points[:-1] == 39) & start[:n][:-1] & (kinds[1:] == LETTER))
    quote = quote[kinds[quote] == OTHER]
    if len(quote):
        # the next two characters; END where the chunk stops, which is no letter
        first, second = points[quote + 1], points[np.minimum(quote + 2, n - 1)]
        taken = np.where(np.isin(first, [ord(c) for c in ONE]), 1, 0)
        for a, b in TWO:
            taken[(taken == 0) & (first == ord(a)) & (second == ord(b)) & (kinds[np.minimum(quote + 2, n - 1)] == LETTER)] = 2
        quote, taken = quote[taken > 0], taken[taken > 0]
        start[quote + 1] = False
        after = quote + 1 + taken
        start[after] = True

    places = np.flatnonzero(start)
    starts, ends = places[:-1], places[1:]
    real = kinds[starts] != END
    return starts[real], ends[real]


def strings(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The given spans as strings."""
    return [points[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


__all__ = ["Alphabet", "split", "strings"]
