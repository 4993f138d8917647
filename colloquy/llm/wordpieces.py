"""Token counts by greedy longest match, from a linear automaton.

The vocabulary is a trie. A failure link leads from a node, once no longer match is possible there, to
the node that is reached when the pieces of the longest matches at the front are taken off, and carries
how many pieces those are. So a word is read once, each character at most once forward, and the count of
its pieces comes out without the pieces.

The vocabulary here is that of a public byte-level tokenizer: a word with a blank before it, in its byte
signs. Every single byte is a piece of it, so every word has pieces. Counts of words are kept by worker,
up to a bound, after which it starts anew.

Nulls and empty texts have no tokens. Repeated rows count alike. Empty table: no rows. Texts and words of
any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import WORD

_WORD = re.compile(WORD)
MEMO = 1_000_000


def byte_signs() -> list[str]:
    """The sign of each byte: itself if it is a visible Latin-1 character, else the next from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in seen}
    signs |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in signs)}
    return [signs[b] for b in range(256)]


class Automaton:
    """Trie, failure links and the count of pieces that each link takes off."""

    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}]
        ends, depth = [False], [0]
        for p in pieces:
            at = 0
            for c in p:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                    depth.append(depth[at] + 1)
                at = self.next[at][c]
            ends[at] = True
        self.link: list[int] = [-1] * len(self.next)
        self.popped: list[int] = [0] * len(self.next)
        # breadth first: a node's link builds on its parent's
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    below.append(v)
                    if ends[v]:
                        self.link[v], self.popped[v] = 0, 1
                        continue
                    z, n = self.link[u], self.popped[u]
                    while z >= 0 and c not in self.next[z]:
                        n += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.next[z][c], n
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word; -1 if greedy matching fails on it."""
        at = n = 0
        for c in word:
            while c not in self.next[at]:
                n += self.popped[at]
                at = self.link[at]
                if at < 0:
                    return -1
            at = self.next[at][c]
        while at:
            n += self.popped[at]
            at = self.link[at]
            if at < 0:
                return -1
        return n


@functools.lru_cache(maxsize=2)
def counter(definition: str) -> tuple[Automaton, list[str], dict[str, int]]:
    """A worker's automaton, byte signs and the counts it has found so far."""
    return Automaton(list(json.loads(definition)["model"]["vocab"])), byte_signs(), {}


def counts(texts: list[str], definition: str) -> list[tuple[int, int]]:
    """(words, tokens) of each text."""
    automaton, signs, memo = counter(definition)
    out = []
    for text in texts:
        words = _WORD.findall(text)
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = automaton.count("".join([signs[b] for b in b" " + w.encode("utf-8", "surrogatepass")]))
        out.append((len(words), sum(map(memo.__getitem__, words))))
    return out


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every document. The vocabulary goes out as a broadcast of fixed size."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = counts([t or "" for t in batch["text"]], shared.value)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": [g[0] for g in got], "n_tokens": [g[1] for g in got]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(count, f"doc_id {kind}, n_words long, n_tokens long")
