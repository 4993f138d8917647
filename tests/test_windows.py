"""The search of many segments at once against single ones, and banded distances against the whole table."""

import random

import numpy as np

from colloquy.functions import edits
from colloquy.operators import spans


def heard(rng, text, letters):
    """A text with letters left out, changed and added."""
    rate = rng.choice([0.05, 0.3, 0.9])
    return "".join(rng.choice([c, "", rng.choice(letters), c + rng.choice(letters)]) if rng.random() < rate else c for c in text)


def test_banded_distances_are_exact_up_to_the_limit():
    rng = random.Random(2)
    for letters in ("ab", "abcdefghij_9 "):
        patterns = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(12)]
        which = np.array([rng.randrange(12) for _ in range(150)])
        texts = [heard(rng, patterns[k], letters) if rng.random() < 0.7 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for k in which.tolist()]
        true = edits.distances([patterns[k] for k in which.tolist()], texts)
        for most in (np.full(150, 1000), np.array([rng.randint(0, 120) for _ in texts])):
            got = edits.within(patterns, which, texts, most)
            assert (np.where(true <= most, got == true, (got > most) & (got <= true))).all()


def thinned(rng, words, at, n, every):
    return " ".join(w for i, w in enumerate(words[at : at + n]) if i % every != every - 1)


def test_many_long_segments_share_their_passes(monkeypatch):
    """Sixty segments of up to 170 words: the spans that all six sizes of all starts give, from as few passes as a single one takes."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    units = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        at, n = rng.randrange(30), rng.randint(5, 200)
        wanted = thinned(rng, words, at, n, rng.choice([5, 7, 500]))
        units.append((wanted, words, len(wanted.split(" ")), rng.randint(20, 60)))
    passes, once = [], spans.within
    monkeypatch.setattr(spans, "within", lambda *a: passes.append(1) or once(*a))
    got = {u: (start, size, score) for u, start, size, score in zip(*spans.Windows(units).found(0.4, 0.95))}
    assert len(passes) <= 40
    for i, (wanted, words, n, starts) in enumerate(units[:20]):
        every = [(s, size) for size in spans.sizes(n) for s in range(min(starts, len(words) - size + 1))]
        texts = [" ".join(words[s : s + size]) for s, size in every]
        values = scores(wanted, texts)
        good = [(v, *e) for v, e in zip(values, every) if v >= 0.4]
        want = min(good, key=lambda x: (0, 0, x[2], x[1]) if x[0] >= 0.95 else (1, -x[0], x[2], x[1])) if good else None
        assert got.get(i) == (want and (want[1], want[2], want[0]))


def scores(wanted, texts):
    """The five measures of each text by their definitions, distances by the whole table."""
    grams = lambda t: {t} if len(t) <= 3 else {t[i : i + 3] for i in range(len(t) - 2)}
    in_order = lambda t: " ".join(sorted(t.split(" ")))
    plain = edits.distances([wanted] * len(texts), texts).tolist()
    by_word = edits.distances([in_order(wanted)] * len(texts), [in_order(t) for t in texts]).tolist()
    out, a, ga = [], set(wanted.split(" ")), grams(wanted)
    for t, p, s in zip(texts, plain, by_word):
        b, gb, longest = set(t.split(" ")), grams(t), float(max(len(wanted), len(t)))
        both = len(ga & gb)
        value = 0.30 * (2.0 * len(a & b) / (len(a) + len(b))) + 0.25 * (1 - s / longest) + 0.20 * (both / float(min(len(ga), len(gb)))) + 0.15 * (1 - p / longest) + 0.10 * (both / float(len(ga | gb)))
        out.append(float(np.floor(value * 1e6 + 0.5) / 1e6))
    return out


def test_texts_of_one_or_two_letters_and_empty_words():
    units = [("a", ["", "a", "b"], 1, 3), ("ab", ["ab", "", "a b"], 1, 3), ("", ["a"], 1, 1), ("a", ["", ""], 1, 2), ("x", [], 1, 1)]
    got = list(zip(*spans.Windows(units).found(0.4)))
    want = [(i, *r) for i, u in enumerate(units) for r in zip(*spans.Windows([u]).found(0.4)[1:])]
    assert sorted(got) == sorted(want) and {g[0] for g in got} == {0, 1}
    assert spans.Windows([]).found(0.4, 0.95) == ([], [], [], [])
