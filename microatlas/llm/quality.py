"""Quality rules on repetition: how much of a text lies in duplicated n-grams and lines.

Everything is measured on arrays over the whole text. Words get a 64-bit hash from
prefix sums over their bytes; windows of n words get a rolling hash, and the
next length follows from the last. A window found before marks all its
words; the characters of the marked words over those of all words are the coverage.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microatlas.llm.common import SPACES, by_text, col

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTE_BACK = pow(_BYTE_BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict; a text at a limit is kept.

    ``coverage``: the share of word characters that may lie in words whose n-gram has
    occurred before, by n. ``lines``: the same for repeats of earlier lines.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    coverage: tuple[tuple[int, float], ...] = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    lines: float = 0.20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the byte base and of its inverse, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.back = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.back = _powers(_BYTE_BASE, size), _powers(_BYTE_BACK, size)
        return self.up, self.back


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeats(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows that equal another one: all of them, and those that equal an
    earlier one."""
    order = np.argsort(windows, kind="stable")
    sorted_windows = windows[order]
    same = sorted_windows[1:] == sorted_windows[:-1]
    if not same.any():
        return order[:0], order[:0]
    later = np.concatenate([[False], same])
    return order[later | np.concatenate([same, [False]])], order[later]


def _covered(places: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a window of ``n`` words at one of the places."""
    step = np.zeros(words + 1, np.int64)
    step[places] += 1
    step[places + n] -= 1
    return np.cumsum(step[:-1]) > 0


def measure(text: str | None, rules: Rules, powers: _Powers) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars and
    the covered characters for each length of the rules."""
    nothing = (0,) * (6 + len(rules.coverage))
    if not text:
        return nothing
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    symbols = int(np.count_nonzero(_SYMBOL[raw]))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw], [True]]).view(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    words = len(starts)
    if not words:
        return (0, 0, symbols, *nothing[3:])
    chars_before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    length = chars_before[stops] - chars_before[starts]
    up, back = powers.upto(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=prefix[1:])
    hashes = _mixed((prefix[stops] - prefix[starts]) * back[starts] + (stops - starts).astype(np.uint64))

    rolling, repeat_words, covered = hashes, 0, []
    wanted = dict.fromkeys(n for n, _ in rules.coverage)
    for n in range(2, max([3, *wanted]) + 1):
        if words < n:
            break
        rolling = rolling[:-1] * _WORD_BASE + hashes[n - 1 :]
        if n == 3 or n in wanted:
            every, later = _repeats(rolling)
            if n == 3:
                repeat_words = int(_covered(every, n, words).sum()) if len(every) else 0
            if n in wanted:
                wanted[n] = int(length[_covered(later, n, words)].sum()) if len(later) else 0
            if not len(every):
                break  # longer windows are not repeated either
    covered = [wanted[n] or 0 for n, _ in rules.coverage]
    seen: set[str] = set()
    dup_lines = dup_chars = 0
    for line in text.split("\n"):
        if line in seen:
            if chars := len(line.translate(_DROP_SPACES)):
                dup_lines += 1
                dup_chars += chars
        else:
            seen.add(line)
    return (words, int(length.sum()), symbols, dup_lines, repeat_words, dup_chars, *covered)


_DROP_SPACES = dict.fromkeys(map(ord, SPACES))


def score(docs: DataFrame, text: str = "text", rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """The measures of every row and its verdict, next to the kept columns.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    dup_line_share and dup_<n>gram_share for each n; input columns of these names are
    replaced. Null, empty and wordless texts have zero counts and shares and fail the
    base rule. Rows are measured one by one, so repeated rows get the same result and
    an empty table gives none.
    """
    long, real, flag = T.LongType(), T.DoubleType(), T.BooleanType()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["dup_line_share", *[f"dup_{n}gram_share" for n, _ in rules.coverage]]
    fields = [
        *[T.StructField(c, long) for c in counts], T.StructField("base_failed", flag), T.StructField("kept", flag),
        *[T.StructField(c, real) for c in shares],
    ]
    limits = np.array([rules.lines, *[limit for _, limit in rules.coverage]])

    def compute(texts, powers):
        table = np.array([measure(t, rules, powers) for t in texts], np.int64).reshape(len(texts), 5 + len(limits))
        share = table[:, 5:] / np.maximum(table[:, 1:2], 1)
        failed = (table[:, 0] < rules.min_words) | (100 * table[:, 4] > rules.max_repeat_percent * table[:, 0])
        return [*table[:, :5].T, failed, ~failed & (share <= limits).all(axis=1), *share.T]

    return by_text(docs, text, fields, compute, keep, _Powers)


def keep_good(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows that pass, all their columns unchanged, whatever their names.

    Null and empty texts fail (no words); equal rows pass or fail together; an empty table
    gives none.
    """
    whole = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("whole"), col(text).alias("text"))
    return score(whole, "text", rules, ["whole"]).filter("kept").select("whole.*")
