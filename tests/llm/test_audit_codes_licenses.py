"""The filter audit, vector codes and the license scan against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import filters, licenses, vectorcodes

WORD = re.compile(r"[^ \t-\r]+")
DOCS = "doc_id long, text string, lang string, source string, mask int, n long, part string, text_ string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 7, 9, "p", "x") for i, t, lang in rows], DOCS)


def failed(rows):
    """The set of failed filters of each row, by the contract's words."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        f = set()
        f |= {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        smaller = [j for j, u, _ in rows if (u or "") == t and j is not None and (i is None or j < i)]
        f |= {"E"} if smaller else set()
        out.append(f)
    return out


def audited(rows, labels):
    out = {}
    fails = failed(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for part in {lang or "" for _, _, lang in rows}:
        here = [(r, f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = here
            for k, c in enumerate(order):
                gone, stay = [x for x in left if c in x[1]], [x for x in left if c not in x[1]]
                shapley[c] += len(gone)
                early = [x for x in here if c in x[1] and x[1] & set(order[:k])]
                out[part, "".join(order), k + 1] = [len(stay), len(gone), len(early), sum(x[1] == {c} for x in here), sum(x[0][0] in good for x in gone), sum(x[0][0] in toxic for x in gone)]
                left = stay
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def some_rows(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Cap", "A", "x$", "y|z"]
    frame_ = " ".join(rng.choice(words) for _ in range(150))
    texts = [" ".join(rng.choice(words[: rng.choice([20, 304])]) for _ in range(rng.choice([3, 150, 260]))) for _ in range(30)]
    texts += [f"{frame_} {t}" for t in texts[:15]] + [frame_] * 8 + ["", None, " \n", "\U0001f600\U0001f600 \x00 z", "CAPS", "a" * 5000, "a" * 5001]
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts)]
    rows += [(rng.randint(40, 400), rng.choice(texts), "en") for _ in range(40)]
    return rows + [(None, texts[0], "en"), (None, texts[0], "de"), (None, "only without id", "en"), (None, "only without id", "en"), rows[3], rows[3], (rows[3][0], rows[3][1], "fr")]


def test_audit_equals_brute_force(spark):
    rows = some_rows()
    labels = [(i, i % 2, (i % 3 == 0) * 1) for i in range(60)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)]
    got = filters.audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got}
    assert len(found) == len(got)
    assert found == audited(rows, labels)
    none = filters.audit(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == 0


def test_prefixes_grow_where_texts_share_them(spark):
    """Texts that share 3000 characters still reach several ranges, and equal texts one."""
    texts = [f"{'same ' * 600}{i:03d}{'tail ' * 20}" for i in range(60)] * 2
    open_ = spark.createDataFrame([(t, len(t) + 64) for t in texts], "text string, size long")
    parts = filters.by_prefix(open_, 6).select("text", F.spark_partition_id().alias("p")).collect()
    assert len(parts) == 120
    where = {}
    for r in parts:
        where.setdefault(r["text"], set()).add(r["p"])
    assert all(len(p) == 1 for p in where.values()) and len(set().union(*where.values())) >= 4


def test_trie_holds_each_text_once():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * n for n in range(40)]
    trie, want = filters.Trie(), {}
    for i, t in enumerate(texts):
        trie.add(trie.terminal(t), i % 997, ("p", 0))
        want.setdefault(t, []).append(i % 997)
    assert {t: (n.least, sorted(r[0] for r in n.rows)) for t, n in trie.terminals()} == {t: (min(v), sorted(v)) for t, v in want.items()}


def test_portions_of_a_task_lose_nothing(monkeypatch):
    rows = some_rows(9)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] or "" for r in rows], "part": [r[2] or "" for r in rows]})
    whole = [r for b in filters.mark(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(filters, "PORTION", 500)
    small = [r for b in filters.mark(iter([batch])) for r in b.to_pylist()]
    assert sum(r["n"] for r in whole) == sum(r["n"] for r in small) == len(rows)
    assert len(small) > len(whole)


# vector codes


def brute_codes(rows):
    """rows: (vec_id, vector, label); codes by the contract's words, with unbounded integers."""
    kept = [(i, [math.floor(4096 * __import__("fractions").Fraction(c)) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 8
    parts = [[r[1][p * width : (p + 1) * width] for r in kept] for p in range(8)]
    books = [[list(x) for x in part[:16]] for part in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(6):
        for p in range(8):
            own = [nearest(x, books[p])[1] for x in parts[p]]
            for e in range(len(books[p])):
                mine = [x for x, o in zip(parts[p], own) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out, by_label = [], {}
    for k, (i, _, label) in enumerate(kept):
        near = [nearest(parts[p][k], books[p]) for p in range(8)]
        error = min(sum(d for d, _ in near), (1 << 63) - 1)
        out.append([i, "".join(f"{n:02x}" for _, n in near), error, label])
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, code, error, min(by_label[label], (1 << 63) - 1), digest) for i, code, error, label in out), key=str)


def codes(spark, rows):
    df = spark.createDataFrame([(i, v, label, "c", 1) for i, v, label in rows], "vec_id long, embedding array<double>, label int, code string, part int")
    return sorted((tuple(r) for r in vectorcodes.encode(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = np.round(rng.normal(size=(90, 16)), 1).tolist()
    rows = [(i + 3, v, [0, 1, None][i % 3]) for i, v in enumerate(vectors)]
    rows += [(200 + i, vectors[0], 5) for i in range(60)]  # a vector repeated
    rows += [rows[4], (7, vectors[30], 1), (None, vectors[31], 2), (300, None, 1), (301, [None] * 16, 1), (302, [math.nan] + [0.0] * 15, 1), (303, [math.inf] + [0.0] * 15, 1), (304, [-0.0] * 16, None)]
    assert codes(spark, rows) == brute_codes(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_codes_of_few_vectors(spark, n):
    rows = [(i, [float(i)] * 8, 1) for i in range(n)]
    assert codes(spark, rows) == (brute_codes(rows) if n else [])


def test_codes_of_large_components(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e300, -1e39, 2.5e8, 0.5, 3e5 + i]) * rng.choice([1, -1]) for _ in range(8)], i % 2) for i in range(40)]
    assert codes(spark, rows) == brute_codes(rows)
    rows = [(i, [float(np.float32(rng.uniform(-1e5, 1e5))) for _ in range(8)], i % 2) for i in range(40)]
    assert codes(spark, rows) == brute_codes(rows)


def test_codes_of_odd_lengths(spark):
    rows = [(i, [float(i), 1.0] * 4, 1) for i in range(20)]
    odd = [(100, [1.0] * 7, 1), (101, [], 1), (102, [2.0] * 16, 1)]
    assert codes(spark, rows + odd) == brute_codes(rows)
    assert codes(spark, [(i, [1.0] * 7, 1) for i in range(9)]) == []


@pytest.mark.parametrize("kind", [np.int64, object])
def test_tree_finds_the_nearest_entry(kind):
    rng = np.random.default_rng(3)
    for spread in (1, 3, 500):
        for n in (1, 2, 5, 16):
            entries = rng.integers(-spread, spread + 1, size=(n, 3)).astype(kind)
            x = rng.integers(-spread, spread + 1, size=(300, 3)).astype(kind)
            tree = vectorcodes.Gnat(entries, list(range(n)))
            best, own = vectorcodes.squared(x, entries[tree.splits[0]]), np.full(len(x), tree.splits[0])
            tree.search(x, np.arange(len(x)), best, own)
            d = np.array([[int(((a - b) ** 2).sum()) for b in entries] for a in x])
            assert (own == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_limbs_add_up():
    for v in (0, 1, -1, (1 << 30), -(1 << 91) + 12345, 10**300):
        assert sum(x << (30 * i) for i, x in enumerate(vectorcodes.limbs(v))) == v


# licences


def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    base = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    line = " " + " ".join(words) + " "
    found = [licenses.Detection(line[: m.start()].count(" ") - 1, line[: m.end()].count(" ") - 1, i) for i, r in enumerate(licenses.rules()) for m in r.pattern.finditer(line)]

    def under(a, b):
        """b suppresses a."""
        p, q = licenses.rules()[a.rule].priority, licenses.rules()[b.rule].priority
        inside = b.first <= a.first and a.last <= b.last
        longer = (b.last - b.first) > (a.last - a.first)
        return inside and (q > p or q == p and (longer or b.rule < a.rule))

    kept = [a for a in found if not any(under(a, b) for b in found if b != a)]
    rules = [licenses.rules()[d.rule] for d in kept]
    labels = sorted({label for _, label in base} | {r.label for r in rules})
    at = [i for i, _ in base]
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in base})), ",".join(labels), max((r.confidence for r in rules), default=0.0))


NOTICES = [
    "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "All rights reserved.",
    "SPDX-License-Identifier: BSD-3-Clause", "© 2019 Someone. Alle Rechte vorbehalten.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "http://www.apache.org/licenses/LICENSE-2.0",
    "https://creativecommons.org/licenses/by-sa/3.0/", "GNU Lesser General Public License v2.1", "cc by cc by", "general public license", "Creative Commons Attribution-ShareAlike License 3.0", "in the public domain",
    "Distributed under the terms of the Mozilla Public License, v. 2.0", "dual licensed under the MIT license or the Apache License 2.0", "Tous droits réservés", "may not be reproduced in any form without prior written permission",
]


def test_scan_equals_all_rules_without_gates(spark):
    rng = random.Random(8)
    texts = [*NOTICES, None, "", " \n", "no notice at all", "ALL\nRIGHTS - reserved", "all rights" * 50, "É cc by É", "x " * 3000 + NOTICES[0] + " y" * 3000]
    texts += [" ".join(rng.choice([*NOTICES, "some", "words", "license", "gpl 3", "cc"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(i if i % 11 else None, t, 1, "l") for i, t in enumerate(texts)] + [(1, texts[1], 1, "l")], "doc_id long, text string, found int, labels string")
    rows = licenses.scan(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    want = [(i if i % 11 else None, *brute_scan(t)) for i, t in enumerate(texts)] + [(1, *brute_scan(texts[1]))]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert licenses.scan(df.filter("false")).count() == 0


def test_notices_get_their_labels():
    def labels(text):
        _, base, found = licenses.scan_text(text)
        return {label for _, label in base} | {licenses.rules()[d.rule].label for d in found}

    assert labels(NOTICES[0]) == {"cc-by", "cc-by-nc-4.0"} and labels(NOTICES[1]) == {"mit"} and labels(NOTICES[2]) == {"gpl", "gpl-3.0"}
    assert labels(NOTICES[3]) == {"apache-2.0"} and labels(NOTICES[5]) == {"bsd-3-clause"} and labels(NOTICES[10]) == {"gpl", "lgpl-2.1"}
    assert labels("dual licensed under the MIT license or the Apache License 2.0") == {"mit", "apache-2.0"} and labels("a plain sentence on ruby and json") == set()


def test_every_rule_is_reached_by_its_keywords():
    """A text that a rule matches holds the rule's keywords: the gate loses none."""
    for r in licenses.rules():
        for text in NOTICES:
            line = licenses.Line(licenses.words_of(text))
            if r.pattern.search(line.text):
                assert r.keywords <= set(licenses.words_of(text)), (r.name, text)
    assert len(licenses.rules()) > 300


def test_detections_are_spans(spark):
    df = spark.createDataFrame([(5, "word " + NOTICES[0])], "doc_id long, text string")
    assert [tuple(r) for r in licenses.detections(df).collect()] == [(5, "notice:cc-by-nc-4.0", "cc-by-nc-4.0", 1, 7, 0.95)]
