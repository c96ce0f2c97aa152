"""Quality rules combined by weak supervision (operator 3).

Each rule votes good (1) or bad (-1) or abstains (0) on a document's statistics. No rule decides alone: expectation-maximisation
estimates how often each is right on good and on bad documents, and the posterior probability of good quality decides. The documents
enter as counts of vote patterns, of which there are at most 3 to the number of rules; so the fit sees all documents and
the driver a table of bounded size. Scoring is a sum of log odds in the engine.

Defined results: a null text has no words and fails the base rules; every document is scored; with no documents no rule learns
anything and the initial accuracies stand; input columns named like a result are replaced.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import flat_map
from .common import materialize

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: Common short words of the corpus languages (fixed values).
STOP = (
    "the of and to in is that it was for on are as with be by an at this from or "
    "le la les de des du et un une en que qui dans pour est par sur au ne pas "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch "
    "el los las del y es se lo con una por su para al como"
).split()
_STOP = frozenset(x.encode() for w in STOP for x in (w, w.capitalize(), w.upper()))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_upper", "n_letters", "n_stop", "n_bare")


def repeated(words: list, width: int = 3) -> int:
    """How many words lie in a window of ``width`` words that is found twice or more."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + width - max(at, end)
            end = at + width
    return covered


def statistics(text: str | None) -> tuple[int, ...]:
    """The values of ``STATS`` for one text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    blank = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [x for x in data.split(b"\n") if not x.isspace() and x]
    codes = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return (
        len(words), len(text) - blank, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated(words), len(lines),
        sum(x.rstrip().endswith((b".", b"!", b"?", b":", b";", b'"')) for x in lines), int(codes[_UPPER].sum()), int(codes[_LETTER].sum()),
        sum(w in _STOP for w in words), sum(len(w) == 1 and not w.isalnum() for w in words),
    )


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    rows = docs.select(*keep, text)
    schema = T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in STATS)])

    def make():
        def work(batch):
            for row in zip(*(batch[c] for c in keep), batch[text], strict=True):
                yield (*row[:-1], *statistics(row[-1]))

        return work

    return flat_map(rows, schema, make)


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules, as columns over ``STATS``; a share of nothing is null, and the rule abstains."""
    c = F.col
    share = lambda part, whole: c(part) / F.when(c(whole) > 0, c(whole))
    rule = lambda x, good, bad: _vote(x, good(x), bad(x))
    return {
        "symbols": rule(share("n_symbols", "n_words"), lambda x: x < 0.05, lambda x: x > 0.2),
        "repeats": rule(share("n_repeat_words", "n_words"), lambda x: x < 0.1, lambda x: x > 0.3),
        "lines": rule(F.when(c("n_lines") > 2, share("n_dup_lines", "n_lines")), lambda x: x < 0.1, lambda x: x > 0.3),
        "length": rule(share("word_chars", "n_words"), lambda x: x.between(3, 8), lambda x: (x < 2) | (x > 12)),
        "capitals": rule(share("n_upper", "n_letters"), lambda x: x < 0.15, lambda x: x > 0.4),
        "bare": rule(share("n_bare", "n_words"), lambda x: x < 0.02, lambda x: x > 0.1),
        "stop": rule(F.when(c("n_words") >= 20, share("n_stop", "n_words")), lambda x: x > 0.08, lambda x: x < 0.02),
        "ended": rule(share("n_ended", "n_lines"), lambda x: x > 0.7, lambda x: x < 0.3),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Vote patterns and their counts -> (prior of good, right on good, right on bad by rule).

    The counts of a Beta(8, 2) are added to each accuracy, which keeps good the class that the rules call so.
    """
    prior, on_good, on_bad = 0.8, np.full(patterns.shape[1], 0.9), np.full(patterns.shape[1], 0.7)
    up, down = patterns > 0, patterns < 0
    weight = counts
    for _ in range(rounds):
        p = posterior(patterns, prior, on_good, on_bad)
        g, b = weight * p, weight * (1 - p)
        new = ((g @ up + 8) / (g @ (up | down) + 10), (b @ down + 8) / (b @ (up | down) + 10))
        prior_now = float(np.clip((g.sum() + 8) / (weight.sum() + 10), 0.02, 0.98))
        moved = max(abs(prior_now - prior), np.abs(new[0] - on_good).max(), np.abs(new[1] - on_bad).max())
        prior, (on_good, on_bad) = prior_now, new
        if moved < 1e-9:
            break
    return prior, on_good, on_bad


def posterior(patterns: np.ndarray, prior: float, on_good: np.ndarray, on_bad: np.ndarray) -> np.ndarray:
    odds = math.log(prior / (1 - prior)) + (patterns > 0) @ np.log(on_good / (1 - on_bad)) + (patterns < 0) @ np.log((1 - on_good) / on_bad)
    return 1 / (1 + np.exp(-odds))


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``STATS``, ``base_failed``, ``quality`` (posterior) and ``kept``."""
    measured = materialize(measure(docs, text, keep))
    rules = votes()
    voted = measured.withColumns({f"vote_{k}": v for k, v in rules.items()})
    names = [f"vote_{k}" for k in rules]
    seen = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ** len(rules) rows
    patterns = np.array([r[:-1] for r in seen], dtype=float).reshape(-1, len(names))
    prior, on_good, on_bad = fit(patterns, np.array([r[-1] for r in seen], dtype=float))
    odds = F.lit(math.log(prior / (1 - prior)))
    for k, name in enumerate(names):
        odds = odds + F.when(F.col(name) > 0, math.log(on_good[k] / (1 - on_bad[k]))).when(F.col(name) < 0, math.log((1 - on_good[k]) / on_bad[k])).otherwise(0.0)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = voted.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop(*names)
