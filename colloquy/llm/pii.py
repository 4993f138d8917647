"""Personal data: fixed patterns, and a character tagger that adds what they miss.

The patterns find e-mail addresses, IP addresses, card and phone numbers; these spans always stay. The
tagger (:mod:`.tagger`) reads overlapping windows. It is trained on labelled spans: those of the patterns
in a bounded sample of documents, and the same numbers and addresses rewritten in ways that the patterns
do not know (other separators, blanks around signs, no leading plus) at their places in the text. Its
spans from all windows of a text are reconciled together: the set of disjoint spans with the highest
total score wins, none of which may touch a span of the patterns, fail its kind's own test (address form,
digits, Luhn) or lie at a window's edge that another window sees past.

Every kind needs a digit or a sign for "at" (@, (at) or [at]) in its span, so windows are laid over the
whole text but one without any is not scored: nothing could come of it. A span that reaches a window's
edge, beyond which there is text, is decided in a window laid around it; one that no window holds is
followed to both its ends and pieced together.

Nulls: a null text is empty; an empty text has no spans. Repeated rows give equal results. Spans that tie
in score: the earlier, then the kind named first. Empty table: no rows, and the tagger is trained on the
rewritten samples of a fixed list alone. Texts of any length are read whole. Other columns are ignored by
:func:`find` and carried along by :func:`mask`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tagger
from .common import hash_key, text_batches

KINDS = ("email", "ip", "card", "phone")
#: At most so many documents are sampled for training.
SAMPLE = 400
WINDOW, STRIDE = 80, 40
#: At most so many labelled windows are trained on.
WINDOWS = 1500
#: Mean score of a span's characters over "no span" from which it counts.
MARGIN = 2.0

#: Forms that give up a run of signs at once, so that a text of one long run is read in linear time.
_PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_TRIGGER = re.compile(r"[0-9@]")
#: What some span of every kind holds; the alternatives are those of the address form in _plausible.
_HELD = re.compile(r"[0-9@]|\(at\)|\[at\]")
_RUN = re.compile(r"[0-9](?:[0-9\x20().+-]*[0-9])?")
#: Used where a corpus gives no samples.
_FALLBACK = ("write to jo.doe7@mail.example.org today", "call +1 (202) 555-0148 or", "host 10.20.30.40 is", "card 4111111111111111 ends", "in 1987 about 3.5 of 120, 44", "id 20240131 v1.2.3")


def digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(number: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _passes(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p) < 4 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in s.split(".")))
    if kind == "card":
        return 14 <= len(d := digits(s)) <= 19 and luhn(d)
    return kind == "email" or 10 <= len(digits(s)) <= 15


def addresses(text: str) -> list[tuple[str, int, int]]:
    """Leftmost disjoint e-mail addresses, found from each @ outwards."""
    found, upto, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            upto = domain.end()
            found.append(("email", start, upto))
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost disjoint matches of each kind that pass, by start, then kind as listed."""
    found = addresses(text)
    if _TRIGGER.search(text):
        found += [(k, *m.span()) for k in KINDS[1:] for m in _PATTERNS[k].finditer(text) if _passes(k, m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _plausible(kind: str, s: str) -> bool:
    """The test that a span of the tagger must pass; it allows more separators than the patterns do."""
    if s != s.strip() or "\n" in s:
        return False
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+ ?(?:@|\(at\)|\[at\]) ?[^\s@]+", s)) and bool(re.search(r"[A-Za-z0-9]\.[A-Za-z]{2,}$", s))
    if kind == "ip":
        parts = re.split(r" ?\. ?|\[\.\]", s)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts)
    if not re.fullmatch(r"\(?[+0-9][0-9\x20()./+-]*[0-9]", s):
        return False
    if kind == "card":
        return len(d := digits(s)) in (15, 16) and luhn(d)
    return 10 <= len(digits(s)) <= 13 and bool(re.search(r"[\x20()./-]", s)) and not re.search(r"[./-]{2}|[0-9]{8}", s) and len(re.findall(r"[0-9]+", s)) <= 5


def rewritten(kind: str, s: str, rng: np.random.Generator) -> str:
    """The same datum in a form that the patterns do not know."""
    d = digits(s)
    if kind == "email":
        return s.replace("@", [" @ ", "(at)", "[at]", "@ "][rng.integers(4)])
    if kind == "ip":
        return s.replace(".", [" . ", "[.]", ". "][rng.integers(3)])
    if kind == "card":
        return ["/", ".", "  "][rng.integers(3)].join(d[i : i + 4] for i in range(0, len(d), 4))
    d = d[-10:]
    return [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}", f"001 {d[:3]}/{d[3:]}"][rng.integers(4)]


def labelled(texts: list[str], rng: np.random.Generator, each: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags (0 none, 1 + 2 kind begins, 2 + 2 kind goes on)."""
    xs, ys = [], []

    def add(text: str, spans: list[tuple[str, int, int]], at: int) -> None:
        x, y = np.zeros(WINDOW, np.int16), np.zeros(WINDOW, np.int64)
        part = tagger.codes(text[max(0, at) : at + WINDOW])
        x[max(0, -at) : max(0, -at) + len(part)] = part
        for kind, a, b in spans:
            a, b, k = a - at, b - at, KINDS.index(kind)
            y[max(a, 0) : max(b, 0)] = 2 + 2 * k
            if 0 <= a < WINDOW:
                y[a] = 1 + 2 * k
        xs.append(x)
        ys.append(y)

    for text in texts:
        spans = base_spans(text)
        for kind, a, b in spans[:20]:
            for i in range(each):
                s = text[a:b] if i == 0 else rewritten(kind, text[a:b], rng)
                if kind == "phone" and i and not rng.integers(3):  # some numbers that only look like one
                    s = f"{rng.integers(1, 99999)} {rng.integers(1, 999)}, {rng.integers(1, 9999)}"
                    add(text[:a] + s + text[b:], [], a - int(rng.integers(5, 50)))
                    continue
                add(text[:a] + s + text[b:], [(kind, a, a + len(s))], a - int(rng.integers(5, 50)))
        for m in list(_RUN.finditer(text))[:6]:
            if not any(a < m.end() and m.start() < b for _, a, b in spans):
                add(text, [], m.start() - int(rng.integers(5, 50)))
    return np.array(xs).reshape(-1, WINDOW), np.array(ys).reshape(-1, WINDOW)


def sample(docs: DataFrame, n: int = SAMPLE) -> list[str]:
    """Up to n texts with a digit or an @, the first in hash order, each cut to the stretch around it."""
    # only what training reads travels: 400 characters around the first long number or address
    at = F.regexp_instr(F.col("text"), F.lit(r"[0-9][0-9 ().+-]{6}|@"))
    texts = docs.select("text", at.alias("at")).filter("at > 0").select(F.col("text").substr(F.greatest(F.lit(1), F.col("at") - 120), F.lit(400)).alias("t")).filter(F.length("t") > 0).select("t", hash_key(1, F.col("t")).alias("key"))
    return [r["t"] for r in texts.orderBy("key", "t").limit(n).collect()]


def train(texts: list[str], seed: int = 11) -> tagger.Tagger:
    rng = np.random.default_rng(seed)
    x, y = labelled([*_FALLBACK, *texts], rng, each=4 if len(texts) >= SAMPLE // 2 else 12)
    model = tagger.Tagger(1 + 2 * len(KINDS))
    at = rng.permutation(len(x))[:WINDOWS]
    model.fit(x[at], y[at])
    return model


def windows(text: str) -> list[int]:
    """Starts of the windows that hold a digit or a sign for "at", at least in part."""
    wanted, last = [], -1
    for m in _HELD.finditer(text):
        for w in range(m.start() // STRIDE - 1, (m.end() - 1) // STRIDE + 1):
            if w >= 0 and w > last:
                wanted.append(w * STRIDE)
                last = w
    return wanted


def reconciled(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """The disjoint spans of the highest total score, by weighted interval scheduling over one text."""
    best_of: dict[tuple[str, int, int], float] = {}
    for k, a, b, s in spans:
        best_of[k, a, b] = max(s, best_of.get((k, a, b), 0))
    order = sorted(best_of, key=lambda s: (s[2], s[1], KINDS.index(s[0])))
    ends = np.array([s[2] for s in order])
    total, choice = [0.0], []
    for i, s in enumerate(order):
        before = int(np.searchsorted(ends, s[1], side="right"))
        gain = total[min(before, i)] + best_of[s] * (s[2] - s[1])
        choice.append((gain > total[-1], min(before, i)))
        total.append(max(total[-1], gain))
    out, i = [], len(order)
    while i:
        take, before = choice[i - 1]
        if take:
            out.append(order[i - 1])
        i = before if take else i - 1
    return out[::-1]


def _decoded(texts: list[str], todo: list[tuple[int, int]], model: tagger.Tagger) -> Iterator[tuple[int, str, int, int, np.ndarray, bool]]:
    """(text, kind, start, end, margins, cut) of what the tagger finds in windows; cut: it reaches an edge that is not the text's."""
    for k in range(0, len(todo), 1024):
        part = todo[k : k + 1024]
        x = np.zeros((len(part), WINDOW), np.int16)
        for row, (i, at) in enumerate(part):
            c = tagger.codes(texts[i][at : at + WINDOW])
            x[row, : len(c)] = c
        tags, margin = model.decode(x)
        for row in np.flatnonzero(tags.any(axis=1)):
            i, at = part[row]
            n = len(texts[i])
            y, a = tags[row], 0
            while a < WINDOW:
                if y[a] == 0:
                    a += 1
                    continue
                kind, b = (y[a] - 1) // 2, a + 1
                while b < WINDOW and y[b] == 2 + 2 * kind:
                    b += 1
                yield i, KINDS[kind], at + a, min(at + b, n), margin[row, a:b], bool((a == 0 and at > 0) or (b == WINDOW and at + b < n))
                a = b


def _pieced(cut: list[tuple[int, str, int, int, np.ndarray]]) -> Iterator[tuple[int, str, int, int, np.ndarray]]:
    """Parts of one text and kind that overlap or meet, as one span each."""
    i = None
    for j, kind, a, b, m in sorted(cut, key=lambda s: s[:4]):
        if i is not None and (j, kind) == (i, k) and a <= end:
            if b > end:
                marks.append(m[end - a : b - a])
                end = b
            continue
        if i is not None:
            yield i, k, start, end, np.concatenate(marks)
        i, k, start, end, marks = j, kind, a, b, [m[: b - a]]
    if i is not None:
        yield i, k, start, end, np.concatenate(marks)


def added_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], model: tagger.Tagger) -> list[list[tuple[str, int, int]]]:
    """What the tagger adds to each text."""
    found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]

    def keep(i: int, kind: str, a: int, b: int, margins: np.ndarray) -> None:
        score = float(margins.mean())
        if score >= MARGIN and _plausible(kind, texts[i][a:b]):
            found[i].append((kind, a, b, score))

    cut: list[tuple[int, str, int, int, np.ndarray]] = []
    whole: set[tuple[int, str, int, int]] = set()
    todo = [(i, at) for i, t in enumerate(texts) for at in windows(t)]
    read = set(todo)
    while todo:
        for i, kind, a, b, margins, edge in _decoded(texts, todo, model):
            if edge:
                cut.append((i, kind, a, b, margins))
            else:
                whole.add((i, kind, a, b))
                keep(i, kind, a, b, margins)
        # what an edge cut is decided in a window around it; where none holds it, it is followed to both ends
        wanted = {(i, max(0, min(at, len(texts[i]) - WINDOW))) for i, _, a, b, _ in _pieced(cut) for at in (((a + b - WINDOW) // 2,) if b - a < WINDOW - 1 else (a - STRIDE, b - STRIDE))}
        todo = sorted(wanted - read)
        read |= wanted
    for i, kind, a, b, margins in _pieced(cut):
        if b - a >= WINDOW - 1 and not any((j, k) == (i, kind) and c < b and a < d for j, k, c, d in whole):
            keep(i, kind, a, b, margins)
    out = []
    for spans, base in zip(found, bases):
        free = [s for s in spans if not any(a < s[2] and s[1] < b for _, a, b in base)]
        out.append(reconciled(free) if free else [])
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _all_spans(texts: list[str], model: tagger.Tagger) -> tuple[list, list]:
    bases = [base_spans(t) for t in texts]
    every = [sorted([*b, *a], key=lambda s: (s[1], KINDS.index(s[0]))) for b, a in zip(bases, added_spans(texts, bases, model))]
    return bases, every


def find(docs: DataFrame, model: tagger.Tagger | None = None) -> DataFrame:
    """doc_id, counts and digest of the patterns' spans, all spans, and how many the tagger added."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or train(sample(docs)))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bases, every = _all_spans([t or "" for t in batch["text"]], shared.value)
            out = pd.DataFrame({"doc_id": batch["doc_id"]})
            for k in KINDS:
                out[f"n_{k}"] = [sum(s[0] == k for s in b) for b in bases]
            out["base_sha256"] = [hashlib.sha256(_joined(b).encode()).hexdigest() for b in bases]
            out["spans"] = [_joined(e) for e in every]
            out["n_added"] = [len(e) - len(b) for e, b in zip(every, bases)]
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(look, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or run of overlapping spans, becomes <KIND> of its first."""
    out, upto = [], 0
    for kind, a, b in spans:
        if a >= upto:
            out += [text[upto:a], f"<{kind.upper()}>"]
        upto = max(upto, b)
    return "".join([*out, text[upto:]])


def mask(docs: DataFrame, model: tagger.Tagger | None = None) -> DataFrame:
    """The documents with their spans masked; n_chars, if there, follows the text."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or train(sample(docs)))

    @F.pandas_udf(T.StringType())
    def cleaned(text: pd.Series) -> pd.Series:
        texts = [t or "" for t in text]
        return pd.Series([masked(t, s) if t is not None else None for t, s in zip(text, _all_spans(texts, shared.value)[1])], dtype=object)

    names = docs.columns
    rows = docs.select(F.struct(*names).alias("_row"), cleaned("text").alias("_text"))
    cols = {c: F.col("_row").getField(c) for c in names} | {"text": F.col("_text")}
    if "n_chars" in names:
        cols["n_chars"] = F.when(F.col("_text").isNull() | (F.col("_text") == F.col("_row.text")), cols["n_chars"]).otherwise(F.length("_text")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[c.alias(n) for n, c in cols.items()])
