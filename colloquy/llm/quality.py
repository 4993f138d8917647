"""Quality rules under weak supervision.

Twelve rules vote on each document: good, bad, or they abstain. Several look at one kind of defect, each in
its own way and sooner than it would be sure. Expectation-maximisation over the votes of all documents
estimates, with no labels, the share of good documents, that of each kind of defect, and how often each
rule's votes are bad in each of these classes. So a bad vote that the other rules of its defect contradict is
put down to the rule, and several together to the document. A document is kept if its posterior probability
of being good is at least one half. The two base limits of :func:`score` (50 words, half of them repeated)
stand beside that verdict in its ``kept``; :func:`keep_good` filters by the posterior alone, so that it keeps
short clean documents. What reaches the driver is the histogram of vote patterns, at most 3^12 rows for any corpus.

An abstention counts for neither class. Nothing in the rules asks for one language: function words are
those of any of the listed languages, and where none fits, the share of a text's own most frequent words
stands in for them; signs that end a sentence are those of several scripts.

Nulls: a null text has no words. A text without words is voted bad by all rules; other short texts are
judged by the rules that can speak. An empty table gives no rows. Ties (a posterior of one half is kept) and
repeated rows: a verdict depends on the text and the corpus's votes alone. Texts of any length are read
whole. Other columns, whatever their names, are ignored by :func:`score` and carried along by :func:`keep_good`.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, stored, text_batches

_WORD = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
_SYMBOL = frozenset(SYMBOLS)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on with as be this by are from was not or",
    "fr": "la le les de des et un une que qui en du dans est pour pas sur par avec au",
    "de": "der die das und ist den mit von zu auf ein eine nicht im für dem des sich es als",
    "es": "el los las de la que y en un una por para con se del no al su lo es",
    "it": "il di che e la un una per non con del della le si da in sono ma come anche",
    "pt": "o de que e do da em um para com uma os no se na por mais as dos como",
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om ook als bij",
    "pl": "i w na z do nie że się to jest o jak po co za od tak ale przez dla",
}
_FUNCTION = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())
_LANGUAGES = [frozenset(words.split()) for words in FUNCTION_WORDS.values()]
#: Signs that end a sentence in Latin, Greek, Arabic, Indic, Chinese and Japanese script.
ENDS = ".!?…;؟۔।。！？"
#: The kinds of defect, each with the rules that look at it.
DEFECTS = {
    "symbols": ("symbols", "marks"),
    "repetition": ("duplicate_lines", "repeats", "runs", "one_word"),
    "shouting": ("capitals", "exclaims"),
    "no prose": ("stopwords", "endings"),
    "garbled": ("word_length", "letters"),
}
RULES = tuple(rule for rules in DEFECTS.values() for rule in rules)
#: How often a rule that votes votes bad at first: in the good class, in that of its own defect, in those of others.
BAD_AT_FIRST = (0.02, 0.7, 0.1)
#: Share of good documents at first; the shares' and each rate's prior weigh so much of the corpus.
GOOD_AT_FIRST, SHARE_PRIOR, RATE_PRIOR = 0.8, 0.02, 0.005

FEATURES = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "pattern")])


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def duplicate_lines(text: str) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, lines with a word)."""
    seen: set[str] = set()
    n = dup = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            n += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return dup, n


def _side(good: bool, bad: bool) -> int:
    return -1 if bad else 1 if good else 0


def function_share(words: list[str]) -> tuple[float, float, float]:
    """Shares of the words: function words of the best language, the five most frequent words of letters, the most frequent one."""
    counts = Counter(w.strip(".,:!?()\"'").lower() for w in words)
    for w in [w for w in counts if not w.isalpha()]:
        del counts[w]
    if not counts:
        return 0.0, 0.0, 0.0
    known = [(w, n) for w, n in counts.items() if w in _FUNCTION]
    best = max(sum(n for w, n in known if w in language) for language in _LANGUAGES)
    top = [n for _, n in counts.most_common(5)]
    return best / len(words), sum(top) / len(words), top[0] / len(words)


def votes(text: str, words: list[str], chars: int, symbols: int, dup: int, lines: int, repeat: int) -> dict[str, int]:
    """One vote for each of RULES: 1 good, -1 bad, 0 abstains."""
    n = len(words)
    if n == 0:
        return dict.fromkeys(RULES, -1)
    mean = chars / n
    function, common, top = function_share(words)
    marked = sum(not _SYMBOL.isdisjoint(w) for w in words) / n
    ends = sum(w[-1] in ENDS for w in words) / n
    upper = sum(map(str.isupper, words)) / n
    letters = sum(map(str.isalpha, words)) / n
    exclaims = text.count("!") / n
    runs = sum(map(eq, words, words[1:])) / n
    some, long = n >= 10, n >= 30  # of fewer words a share says little
    return {
        "symbols": _side(symbols <= 0.02 * n, symbols > 0.1 * n),
        "marks": _side(marked <= 0.02, marked > 0.08),
        "duplicate_lines": _side(lines >= 3 and not dup, dup >= 2 and dup > 0.2 * lines),
        "repeats": _side(long and repeat <= 0.1 * n, long and repeat > 0.25 * n),
        "runs": _side(long and runs <= 0.02, some and runs > 0.1),
        "one_word": _side(long and top <= 0.12, long and top > 0.25),
        "capitals": _side(some and upper <= 0.1 and text != text.upper(), some and upper > 0.25),
        "exclaims": _side(exclaims <= 0.05, exclaims > 0.15),
        "stopwords": _side(function >= 0.12 or (long and common >= 0.1), long and function < 0.02 and common < 0.05),
        "endings": _side(1 / 60 <= ends <= 1 / 3, long and (ends == 0 or ends > 0.5)),
        "word_length": _side(3 <= mean <= 9, mean < 2.5 or mean > 12),
        "letters": _side(some and letters >= 0.6, some and letters < 0.4),
    }


def describe(text: str | None) -> tuple[int, int, int, int, int, int]:
    text = text or ""
    words = _WORD.findall(text)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    dup, lines = duplicate_lines(text)
    repeat = repeated_words(words)
    pattern = 0
    found = votes(text, words, chars, symbols, dup, lines, repeat)
    for rule in RULES:
        pattern = 3 * pattern + found[rule] + 1
    return len(words), chars, symbols, dup, repeat, pattern


@F.pandas_udf(FEATURES)
def features(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([describe(t) for t in text], columns=FEATURES.names)


def unpack(patterns: np.ndarray) -> np.ndarray:
    """Vote patterns to a matrix of votes, a column per rule."""
    return np.stack([patterns // 3 ** (len(RULES) - 1 - j) % 3 - 1 for j in range(len(RULES))], axis=1)


class Model(NamedTuple):
    """Log shares of the classes (good first, then one for each kind of defect), and by class and rule the log rates of bad and good votes."""

    shares: np.ndarray
    bad: np.ndarray
    good: np.ndarray

    def scores(self, v: np.ndarray) -> np.ndarray:
        """Log-likelihood of votes, a row for each pattern and a column for each class."""
        return self.shares + (v < 0) @ self.bad.T + (v > 0) @ self.good.T


def _first() -> tuple[np.ndarray, np.ndarray]:
    of_good, of_own, of_other = BAD_AT_FIRST
    rates = np.array([[of_good] * len(RULES)] + [[of_own if rule in rules else of_other for rule in RULES] for rules in DEFECTS.values()])
    return np.array([GOOD_AT_FIRST, *[(1 - GOOD_AT_FIRST) / len(DEFECTS)] * len(DEFECTS)]), rates


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Model:
    """EM over one class of good documents and one for each kind of defect, since a poor document need not have all.

    In each class a rule that votes votes bad at a rate of its own. The first values serve as priors worth a
    fixed share of the corpus, so that they act alike at every size and keep all rates inside (0, 1).
    """
    v, total = unpack(patterns), counts.sum()
    shares0, rates0 = _first()
    model = Model(np.log(shares0), np.log(rates0), np.log(1 - rates0))
    last = None
    for _ in range(rounds):
        s = model.scores(v)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        mass = p * counts[:, None]
        shares = (mass.sum(axis=0) + SHARE_PRIOR * total * shares0) / (total * (1 + SHARE_PRIOR))
        rates = (mass.T @ (v < 0) + RATE_PRIOR * total * rates0) / (mass.T @ (v != 0) + RATE_PRIOR * total)
        model = Model(np.log(shares), np.log(rates), np.log(1 - rates))
        if last is not None and np.abs(p - last).max() < 1e-9:
            break
        last = p
    return model


def posterior(pattern: Column, model: Model) -> Column:
    """P(good | votes), as an expression over the pattern column."""
    votes = [F.floor(pattern / F.lit(3 ** (len(RULES) - 1 - j))) % 3 - 1 for j in range(len(RULES))]
    odds = F.lit(1.0)
    for c in range(1, len(model.shares)):
        score = F.lit(float(model.shares[c] - model.shares[0]))
        for j, vote in enumerate(votes):
            score = score + F.when(vote < 0, F.lit(float(model.bad[c, j] - model.bad[0, j]))).when(vote > 0, F.lit(float(model.good[c, j] - model.good[0, j]))).otherwise(F.lit(0.0))
        odds = odds + F.exp(score)
    return F.lit(1.0) / odds


def label_model(patterns: DataFrame) -> Model:
    """Fits over a frame with a ``pattern`` column, through its histogram (at most 3^12 rows)."""
    rows = sorted(patterns.groupBy("pattern").count().collect(), key=lambda r: r["pattern"])
    return fit(np.array([r["pattern"] for r in rows], dtype=np.int64), np.array([r["count"] for r in rows], dtype=float)) if rows else fit(np.zeros(1, np.int64), np.ones(1))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and p_good of every document."""
    text_batches(docs.sparkSession)
    found = stored(docs.select("doc_id", features("text").alias("f")).select("doc_id", "f.*"), "quality")
    model = label_model(found)
    out = found.withColumn("base_failed", base_failed()).withColumn("p_good", posterior(F.col("pattern"), model))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("p_good") >= 0.5)).alias("kept"), "p_good", "pattern")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are probably good, with their columns. Features are computed twice rather than shuffled."""
    text_batches(docs.sparkSession)
    model = label_model(docs.select(features("text").alias("f")).select("f.pattern"))
    judged = docs.select(F.struct(*docs.columns).alias("_row"), features("text").alias("f"))
    good = judged.filter(posterior(F.col("f.pattern"), model) >= 0.5)
    return good.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
