"""Licence notices in texts: ordered signature rules behind a keyword prefilter.

A text becomes its words, A-Z in lower case, joined by blanks; rules are regular expressions over that, so
marks, hyphens and line ends between words make no difference. Hand-written signatures of licence names,
addresses and clauses are combined with the forms in which a name is used (alone, after "licensed under
the terms of", as an SPDX tag), each form with a priority. A rule is tried only where all of its keywords are
among the text's words. A detection that lies within another of higher priority, or of the same priority
and longer (or as long and of an earlier rule), is suppressed; those that merely overlap both stay.

Three base phrases count wherever their words stand consecutively, suppressed or not, and their labels are
always among a document's labels. The score is the greatest confidence of the rules that found something
in the end, 0 without.

Nulls and empty texts have no words: no places, empty labels, score 0. Texts of any length are read whole;
patterns have no unbounded repeats. Rows are judged one by one, so ties and repeated rows give equal
results and a null doc_id stays null. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The phrases of the base, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Names of licences: label | keywords, all needed | confidence of the bare name | pattern over words.
NAMES = r"""
mit | mit | 0.7 | (?:the )?mit (?:x11 )?licen[cs]e|mit licensed
mit-0 | mit | 0.8 | mit 0(?: licen[cs]e)?|mit no attribution
x11 | x11 | 0.7 | x11 licen[cs]e
apache-2.0 | apache | 0.9 | apache (?:software )?(?:licen[cs]e )?(?:version )?v?2(?: 0)?(?: licen[cs]e)?
apache-1.1 | apache | 0.9 | apache (?:software )?(?:licen[cs]e )?(?:version )?1 1
apache-1.0 | apache | 0.8 | apache (?:software )?(?:licen[cs]e )?(?:version )?1 0
apache | apache | 0.6 | apache (?:software )?licen[cs]e
gpl-3.0 | general public | 0.95 | (?:gnu )?general public licen[cs]e (?:gpl )?(?:as published by the free software foundation )?(?:either )?(?:version |v)?3(?: 0)?(?: only| or (?:any )?later(?: version)?)?
gpl-2.0 | general public | 0.95 | (?:gnu )?general public licen[cs]e (?:gpl )?(?:as published by the free software foundation )?(?:either )?(?:version |v)?2(?: 0)?(?: only| or (?:any )?later(?: version)?)?
gpl-1.0 | general public | 0.9 | (?:gnu )?general public licen[cs]e (?:gpl )?(?:version |v)?1(?: 0)?
gpl-3.0 | gpl | 0.85 | (?:gnu )?gpl (?:version |v )?3(?: 0)?(?: only| or later)?
gpl-3.0 | gplv3 | 0.9 | (?:gnu )?gplv3
gpl-2.0 | gpl | 0.85 | (?:gnu )?gpl (?:version |v )?2(?: 0)?(?: only| or later)?
gpl-2.0 | gplv2 | 0.9 | (?:gnu )?gplv2
gpl | gnu gpl | 0.8 | gnu gpl
gpl | general public | 0.8 | (?:gnu )?general public licen[cs]e
lgpl-3.0 | lesser general public | 0.95 | (?:gnu )?lesser general public licen[cs]e (?:lgpl )?(?:version |v)?3(?: 0)?
lgpl-2.1 | lesser general public | 0.95 | (?:gnu )?lesser general public licen[cs]e (?:lgpl )?(?:version |v)?2 1
lgpl-2.0 | library general public | 0.95 | (?:gnu )?library general public licen[cs]e (?:lgpl )?(?:version |v)?2(?: 0)?
lgpl | lesser general public | 0.85 | (?:gnu )?lesser general public licen[cs]e
lgpl | library general public | 0.85 | (?:gnu )?library general public licen[cs]e
lgpl-3.0 | lgpl | 0.85 | (?:gnu )?lgpl (?:version |v )?3(?: 0)?
lgpl-2.1 | lgpl | 0.85 | (?:gnu )?lgpl (?:version |v )?2 1
lgpl-3.0 | lgplv3 | 0.9 | (?:gnu )?lgplv3
agpl-3.0 | affero general public | 0.95 | (?:gnu )?affero general public licen[cs]e (?:agpl )?(?:version |v)?3(?: 0)?
agpl | affero general public | 0.85 | (?:gnu )?affero general public licen[cs]e
agpl-3.0 | agpl | 0.85 | (?:gnu )?agpl (?:version |v )?3(?: 0)?
agpl-3.0 | agplv3 | 0.9 | (?:gnu )?agplv3
gfdl-1.3 | free documentation | 0.95 | (?:gnu )?free documentation licen[cs]e (?:version )?1 3
gfdl | free documentation | 0.85 | (?:gnu )?free documentation licen[cs]e
bsd-2-clause | bsd | 0.9 | (?:simplified )?bsd 2 clause(?: licen[cs]e)?|2 clause bsd(?: licen[cs]e)?
bsd-3-clause | bsd | 0.9 | bsd 3 clause(?: licen[cs]e)?|3 clause bsd(?: licen[cs]e)?
bsd-4-clause | bsd | 0.9 | bsd 4 clause(?: licen[cs]e)?|4 clause bsd(?: licen[cs]e)?
bsd-2-clause | simplified bsd | 0.85 | simplified bsd licen[cs]e
bsd-3-clause | bsd new | 0.8 | new bsd licen[cs]e
bsd-3-clause | bsd modified | 0.8 | modified bsd licen[cs]e
0bsd | 0bsd | 0.9 | 0bsd
0bsd | zero clause bsd | 0.9 | zero clause bsd
bsd | bsd | 0.6 | bsd (?:style )?licen[cs]e
isc | isc | 0.75 | isc licen[cs]e
mpl-2.0 | mozilla public | 0.95 | mozilla public licen[cs]e (?:version |v )?2(?: 0)?
mpl-1.1 | mozilla public | 0.95 | mozilla public licen[cs]e (?:version |v )?1 1
mpl | mozilla public | 0.85 | mozilla public licen[cs]e
mpl-2.0 | mpl | 0.8 | mpl (?:version |v )?2 0
epl-2.0 | eclipse public | 0.95 | eclipse public licen[cs]e (?:version |v )?2(?: 0)?
epl-1.0 | eclipse public | 0.95 | eclipse public licen[cs]e (?:version |v )?1(?: 0)?
epl | eclipse public | 0.85 | eclipse public licen[cs]e
cddl-1.0 | common development distribution | 0.9 | common development and distribution licen[cs]e(?: (?:version )?1 0)?
cpl-1.0 | common public | 0.8 | common public licen[cs]e(?: (?:version )?1 0)?
eupl-1.2 | european union public | 0.9 | european union public licen[cs]e(?: (?:version |v )?1 2)?
eupl-1.2 | eupl | 0.85 | eupl (?:v )?1 2
artistic-2.0 | artistic | 0.9 | artistic licen[cs]e (?:version )?2 0
artistic-1.0 | artistic | 0.7 | artistic licen[cs]e
bsl-1.0 | boost software | 0.9 | boost software licen[cs]e(?: (?:version )?1 0)?
zlib | zlib | 0.75 | zlib (?:libpng )?licen[cs]e
unlicense | unlicense | 0.85 | (?:the )?unlicense
wtfpl | wtfpl | 0.9 | wtfpl
python-2.0 | python software foundation | 0.8 | python software foundation licen[cs]e(?: (?:version )?2)?
postgresql | postgresql | 0.75 | postgresql licen[cs]e
openssl | openssl | 0.75 | openssl licen[cs]e
php-3.01 | php | 0.75 | php licen[cs]e (?:version )?3 01
ruby | ruby | 0.6 | ruby licen[cs]e
ms-pl | microsoft public | 0.85 | microsoft public licen[cs]e
ms-rl | microsoft reciprocal | 0.85 | microsoft reciprocal licen[cs]e
ofl-1.1 | sil open font | 0.9 | sil open font licen[cs]e(?: (?:version )?1 1)?
odbl-1.0 | open database | 0.85 | open database licen[cs]e(?: (?:version |v )?1 0)?
odc-by-1.0 | open data commons attribution | 0.9 | open data commons attribution licen[cs]e(?: (?:version |v )?1 0)?
pddl-1.0 | public domain dedication | 0.85 | (?:open data commons )?public domain dedication and licen[cs]e
ogl-uk-3.0 | open government | 0.85 | open government licen[cs]e(?: (?:version |v )?3 0)?
cecill-2.1 | cecill | 0.85 | cecill (?:free software )?(?:licen[cs]e )?(?:agreement )?(?:version |v )?2 1
cecill | cecill | 0.7 | cecill licen[cs]e
elastic-2.0 | elastic | 0.8 | elastic licen[cs]e (?:version |v )?2 0
sspl-1.0 | server side public | 0.9 | server side public licen[cs]e(?: (?:version |v )?1)?
busl-1.1 | business source | 0.85 | business source licen[cs]e(?: (?:version )?1 1)?
upl-1.0 | universal permissive | 0.85 | universal permissive licen[cs]e(?: (?:version |v )?1 0)?
ncsa | ncsa | 0.8 | (?:university of illinois )?ncsa open source licen[cs]e
vim | vim | 0.7 | vim licen[cs]e
json | json | 0.6 | json licen[cs]e
beerware | beerware | 0.8 | beerware(?: licen[cs]e)?
openrail | openrail | 0.8 | (?:creativeml )?openrail(?: m)?(?: licen[cs]e)?
public-domain | public domain | 0.6 | (?:in|into|to) the public domain
cc0-1.0 | cc0 | 0.9 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | creative commons zero | 0.9 | creative commons zero(?: v?1 0)?
pdm-1.0 | public domain mark | 0.85 | public domain mark(?: 1 0)?
cc | creative commons | 0.6 | creative commons licen[cs]e
"""
#: The elements that a Creative Commons licence may add to attribution: label, initials, words.
CC = (("cc-by", "by", "attribution"), ("cc-by-sa", "by sa", "attribution share ?alike"), ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s"), ("cc-by-nc", "by nc", "attribution non ?commercial"),
      ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"))
CC_VERSIONS = (("1.0", "1 0"), ("2.0", "2 0"), ("2.5", "2 5"), ("3.0", "3 0"), ("4.0", "4 0"))

#: Addresses and clauses, which stand for themselves: label | keywords | confidence | pattern.
CLAUSES = r"""
apache-2.0 | apache licenses | 0.98 | apache org licenses licen[cs]e 2 0
gpl-3.0 | gnu licenses gpl | 0.9 | gnu org licenses gpl 3 0
gpl-2.0 | gnu licenses gpl | 0.9 | gnu org licenses (?:old licenses )?gpl 2 0
gpl | gnu licenses gpl | 0.8 | gnu org licenses gpl(?: html)?
lgpl | gnu licenses lgpl | 0.85 | gnu org licenses lgpl(?: html)?
agpl-3.0 | gnu licenses agpl | 0.9 | gnu org licenses agpl(?: 3 0)?(?: html)?
mit | opensource licenses mit | 0.95 | opensource org licenses mit(?: licen[cs]e)?
bsd | opensource licenses bsd | 0.85 | opensource org licenses bsd licen[cs]e
mpl-2.0 | mozilla mpl | 0.9 | mozilla org (?:en us )?mpl 2 0
unlicense | unlicense org | 0.9 | unlicense org
cc0-1.0 | creativecommons publicdomain zero | 0.95 | creativecommons org publicdomain zero 1 0
mit | permission hereby granted charge | 0.95 | permission is hereby granted free of charge to any person obtaining a copy of this software
isc | permission copy modify distribute | 0.9 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution source binary forms | 0.9 | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | neither name endorse promote | 0.9 | neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products
gpl | free redistribute modify general public | 0.9 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
lgpl | free redistribute modify lesser public | 0.9 | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e
zlib | altered source plainly marked | 0.85 | altered source versions must be plainly marked as such
unlicense | free unencumbered public | 0.95 | this is free and unencumbered software released into the public domain
bsl-1.0 | hereby granted charge organization | 0.9 | permission is hereby granted free of charge to any person or organization obtaining a copy
warranty | warranty kind | 0.4 | without warranty of any kind(?: (?:either )?expressed? or implied)?
warranty | warranty implied | 0.3 | without any warranty without even the implied warranty
proprietary | proprietary confidential | 0.6 | proprietary and confidential|confidential and proprietary
proprietary | reproduced permission | 0.6 | (?:may|must) not be reproduced (?:[^ ]+ ){0,12}without (?:the )?(?:prior |express |written ){0,3}permission
proprietary | copying prohibited | 0.7 | unauthori[sz]ed copying (?:[^ ]+ ){0,8}prohibited
copyright | copyright c | 0.5 | copyright c (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
copyright | copyright | 0.4 | copyright (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
copyright | © | 0.5 | © (?:copyright )?(?:19|20)[0-9][0-9]
no-license | license granted | 0.3 | no license (?:is )?granted
reserved | droits réservés | 0.6 | tous droits réservés
reserved | rechte vorbehalten | 0.6 | alle rechte vorbehalten
reserved | derechos reservados | 0.6 | todos los derechos reservados|reservados todos los derechos
reserved | diritti riservati | 0.6 | tutti i diritti (?:sono )?riservati
reserved | direitos reservados | 0.6 | todos os direitos reservados
reserved | rechten voorbehouden | 0.6 | alle rechten voorbehouden
"""
#: How a name is used: form, priority, confidence at least, pattern around the name, keywords besides the name's.
FORMS = (
    ("name", 1, 0.0, "{}", ""),
    ("notice", 3, 0.95, "(?:licen[cs]ed|released|distributed|published|available|provided|shared|governed|covered) (?:under|by|subject to|according to|in accordance with) "
     "(?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?{}(?: licen[cs]e)?", ""),
    ("tag", 4, 1.0, "spdx licen[cs]e identifier {}", "spdx identifier"),
)


class Rule(NamedTuple):
    name: str
    label: str
    keywords: frozenset[str]
    priority: int
    confidence: float
    pattern: re.Pattern


class Detection(NamedTuple):
    """Words ``first`` to ``last`` of a text, both included, as the rule of that place in order has them."""

    first: int
    last: int
    rule: int


def _lines(table: str) -> list[tuple[str, frozenset[str], float, str]]:
    cells = [[c.strip() for c in line.split(" | ", 3)] for line in table.strip().splitlines()]
    return [(label, frozenset(keywords.split()), float(confidence), pattern) for label, keywords, confidence, pattern in cells]


def names() -> list[tuple[str, frozenset[str], float, str]]:
    """The names by table, and those of Creative Commons by element and version, in initials and in words."""
    out = _lines(NAMES)
    for label, initials, words in CC:
        key = frozenset(["creative", "commons", "attribution"])
        for version, digits in CC_VERSIONS:
            out.append((f"{label}-{version}", frozenset(["cc", *initials.split()]), 0.95, f"cc {initials} {digits}"))
            out.append((f"{label}-{version}", key, 0.95, f"creative commons {words}(?: (?:international|unported|generic|licen[cs]e)){{0,3}} {digits}"))
            address = frozenset(["creativecommons", "licenses", *initials.split()])
            out.append((f"{label}-{version}", address, 0.98, f"creativecommons org licenses {initials} {digits}"))
        out.append((label, frozenset(["cc", *initials.split()]), 0.7, f"cc {initials}"))
        out.append((label, key, 0.8, f"creative commons {words}"))
    return out


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: of equal detections the earlier rule's stands."""
    out = []
    whole = "(?<= )(?:{})(?= )"
    for form, priority, least, around, more in reversed(FORMS):
        for label, keywords, confidence, pattern in names():
            out.append(Rule(f"{form}:{label}", label, keywords | set(more.split()), priority, max(least, confidence), re.compile(whole.format(around.replace("{}", f"(?:{pattern})")))))
    for label, keywords, confidence, pattern in _lines(CLAUSES):
        out.append(Rule(f"clause:{label}", label, keywords, 2, confidence, re.compile(whole.format(pattern))))
    for phrase, label in BASE:
        out.append(Rule(f"phrase:{label}", label, frozenset(phrase.split()), 0, 0.5, re.compile(whole.format(phrase))))
    return tuple(out)


@functools.cache
def _gates() -> dict[str, tuple[int, ...]]:
    """Rules by one of their keywords: the longest, as the likeliest to be rare."""
    gates: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        gates.setdefault(max(r.keywords, key=lambda k: (len(k), k)), []).append(i)
    return {k: tuple(v) for k, v in gates.items()}


def words_of(text: str) -> list[str]:
    # bytes.lower touches A-Z alone
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


class Line:
    """Words joined by blanks, with the number of the word at each offset."""

    def __init__(self, words: list[str]):
        self.text = f" {' '.join(words)} "
        self.starts, at = [], 1
        for w in words:
            self.starts.append(at)
            at += len(w) + 1

    def word(self, offset: int) -> int:
        return bisect_right(self.starts, offset) - 1


def base_places(line: Line) -> list[tuple[int, str]]:
    """(word, label) of every place of a phrase, those that overlap another included."""
    out = []
    for phrase, label in BASE:
        at = line.text.find(f" {phrase} ")
        while at >= 0:
            out.append((line.word(at + 1), label))
            at = line.text.find(f" {phrase} ", at + 1)
    return sorted(out)


def detect(line: Line, tried: Iterator[int]) -> list[Detection]:
    found = []
    for i in tried:
        for m in rules()[i].pattern.finditer(line.text):
            found.append(Detection(line.word(m.start()), line.word(m.end() - 1), i))
    return found


def unsuppressed(found: list[Detection]) -> list[Detection]:
    """Those that no other of as high a priority contains."""
    kept, reach = [], {}
    for d in sorted(set(found), key=lambda d: (d.first, -d.last, -rules()[d.rule].priority, d.rule)):
        p = rules()[d.rule].priority
        if all(last < d.last for other, last in reach.items() if other >= p):
            kept.append(d)
        reach[p] = max(d.last, reach.get(p, -1))
    return kept


def scan_text(text: str) -> tuple[list[str], list[tuple[int, str]], list[Detection]]:
    """(words, places of base phrases, detections) of a text."""
    words = words_of(text)
    known, gates = set(words), _gates()
    tried = sorted(i for k in known.intersection(gates) for i in gates[k] if rules()[i].keywords <= known)
    if not tried:
        return words, [], []
    line = Line(words)
    return words, base_places(line), unsuppressed(detect(line, iter(tried)))


FOUND = "found array<struct<rule:string,label:string,first_word:long,last_word:long,confidence:double>>"


def _scanned(docs: DataFrame) -> DataFrame:
    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found_type = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("confidence", pa.float64())]))

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, bases, founds = [], [], []
            for text in batch.column("text"):
                words, base, found = scan_text(text.as_py() or "")
                n_words.append(len(words))
                bases.append([{"word": w, "label": label} for w, label in base])
                founds.append([dict(zip(("rule", "label", "first_word", "last_word", "confidence"), (rules()[d.rule].name, rules()[d.rule].label, d.first, d.last, rules()[d.rule].confidence))) for d in found])
            base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(bases, base_type), pa.array(founds, found_type)], ["doc_id", "n_words", "base", "found"])

    return docs.select("doc_id", "text").mapInArrow(scan_batches, f"doc_id {kind}, n_words long, base array<struct<word:long,label:string>>, {FOUND}")


def detections(docs: DataFrame) -> DataFrame:
    """A row for each detection that stands: doc_id, rule, label, first_word, last_word, confidence."""
    return _scanned(docs).select("doc_id", F.inline("found"))


def scan(docs: DataFrame) -> DataFrame:
    """Counts, base labels, all labels and score of each document."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, found = F.col("base.label"), F.col("found.label")
    return _scanned(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, found)).alias("labels"), F.coalesce(F.array_max("found.confidence"), F.lit(0.0)).alias("score"), F.size("found").cast("long").alias("n_found"),
    )
