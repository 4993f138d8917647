"""Best-fit packing planned on a length histogram.

Each document's token ids (and an end id) are cut, if there are more than ``size``, into pieces of
``size``, the first of which may be shorter. Only the counts of pieces by length, at most ``size``
numbers for any corpus, reach the driver. Best-fit decreasing runs over those counts: equal bins are kept
as runs of bin numbers, and a step puts a run of equal pieces into a run of equal bins. Pieces then take
their planned places by joining on their rank within their length.

Nulls: a null text is empty; an empty text is its end id alone. Repeated rows are separate pieces; ties
in rank are broken by hash, id, piece and CRC, beyond which rows are alike. Rows without an id, or that share
one, are documents of their own. Texts of any length are encoded whole. Empty table: no rows. Other columns
are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import range_bits, hash_key, partitions, prefix_sums, stored, text_batches

SIZE, END_ID = 1024, 2
#: Words of which a worker remembers the ids; when half as many are new, those not met since the last time are forgotten.
MEMO = 250_000
#: Longer words are left to the tokenizer.
LONG = 64

#: Plans of up to so many steps (40 bytes each) are broadcast.
BROADCAST_STEPS = 200_000

#: Texts that split at single blanks into parts that the tokenizer treats alone: known Latin letters and
#: ASCII signs, with single blanks or line ends between words.
_PLAIN = re.compile(r"[!-~¡-¬®-ɏ]+(?:[ \n][!-~¡-¬®-ɏ]+)*")
_SIGNS = bytes([*range(ord("!"), ord("~") + 1), *b" \n"])
#: Words, with what is before them, that fall into tokenizer words at blanks, line ends and between letters and signs alone.
_SIMPLE = re.compile(r'[ \n][A-Za-zÀ-ÖØ-öø-ɏ.,;:!?()"-]+')


class Merges:
    """Byte-pair merges of many words at once: each round merges in every word the leftmost of its pairs of lowest rank."""

    SLOTS = 20
    NONE = 1 << 30
    FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.uint64)
        self.key, self.made = key, np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # a pair stands in the first table where its slot is free
        self.tables, left = [], np.unique(key, return_index=True)[1]
        for factor in self.FACTORS:
            table = np.full(1 << self.SLOTS, -1, dtype=np.int32)
            slot = self._slot(key[left], factor)
            table[slot[::-1]] = left[::-1]
            self.tables.append((factor, table))
            left = left[table[slot] != left]
        if len(left):
            raise ValueError("pairs without a slot")
        # the signs that stand for bytes
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}
        self.of_byte = np.array([vocab.get(sign[b], -1) for b in range(256)], dtype=np.int64)
        # letters 0, signs 1, blank 2, line end 3
        self.kind = np.ones(256, dtype=np.int8)
        self.kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
        self.kind[32], self.kind[10] = 2, 3

    def _slot(self, key: np.ndarray, factor: int) -> np.ndarray:
        return ((key * np.uint64(factor)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` for those that do not merge."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        out, open_ = np.full(len(key), self.NONE, dtype=np.int64), None
        for factor, table in self.tables:
            asked = key if open_ is None else key[open_]
            at = table[self._slot(asked, factor)]
            hit = (at >= 0) & (self.key[at] == asked)
            if open_ is None:
                out[hit] = at[hit]
                open_ = np.flatnonzero((at >= 0) & ~hit)
            else:
                out[open_[hit]] = at[hit]
                open_ = open_[(at >= 0) & ~hit]
            if not len(open_):
                break
        return out

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of simple words, and the byte at which each begins."""
        data = np.frombuffer(raw, np.uint8)
        kind = self.kind[data]
        # a blank goes with what follows
        opens = np.append(True, (kind[1:] >= 2) | ((kind[1:] != kind[:-1]) & (kind[:-1] != 2)))
        ids, alive = self.of_byte[data], np.ones(len(data), dtype=bool)
        at, word = np.arange(len(data)), np.cumsum(opens) - 1
        sym = ids.copy()
        rank = np.full(len(data), self.NONE, dtype=np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(at):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(at)), starts)
            going = (best >> 32) < self.NONE
            k = best[going] & 0xFFFFFFFF
            sym[k] = self.made[rank[k]]
            ids[at[k]] = sym[k]
            alive[at[k + 1]] = False
            keep = np.repeat(going, np.diff(np.append(starts, len(at))))
            keep[k + 1] = False
            place = np.cumsum(keep) - 1
            k = place[k]
            at, word, sym, rank = at[keep], word[keep], sym[keep], rank[keep]
            if not len(at):
                break
            # the pairs on either side of what was merged
            again = np.concatenate([k, k[k > 0] - 1])
            with_next = np.append(word[1:] == word[:-1], False)[again]
            rank[again[~with_next]] = self.NONE
            again = again[with_next]
            rank[again] = self.ranks(sym[again], sym[again + 1])
        begin = np.flatnonzero(alive)
        return ids[begin], begin


class Encoder:
    """Token ids as little-endian 32-bit bytes, from the tokenizer, each distinct word encoded once.

    The tokenizer starts a new token at every single blank or line end that follows a non-blank, so a
    plain text's ids are those of its parts. Parts not seen before are encoded joined, and their ids are
    told apart by the bytes that each id stands for; those of letters and common signs are merged side by side
    (:class:`Merges`), which gives the same ids. Other texts are encoded whole.
    """

    def __init__(self, definition: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.memo, self.older, self.most = Tokenizer.from_str(definition), {}, {}, memo
        read = json.loads(definition)
        special = [t["content"] for t in read.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        # a sign of the vocabulary stands for a byte
        self.bytes = np.zeros(max(read["model"]["vocab"].values()) + 1, dtype=np.int64)
        for sign, i in read["model"]["vocab"].items():
            self.bytes[i] = len(sign)
        merges = Merges(read["model"]) if _byte_pairs(read) else None
        self.merges = merges if merges and (merges.of_byte >= 0).all() else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, parts: list[str]) -> None:
        written = [p if p[0] == "\n" else " " + p for p in parts]
        if self.merges:
            simple = [bool(_SIMPLE.fullmatch(w)) and len(w) <= LONG for w in written]
            if any(simple):
                self._merge([*compress(parts, simple)], [*compress(written, simple)])
                parts, written = ([x for x, s in zip(of, simple) if not s] for of in (parts, written))
            if not parts:
                return
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(written)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(p.encode()) for p in written])) + 1
        raw, a = ids.tobytes(), 0
        for part, b in zip(parts, (4 * ends).tolist()):
            self.memo[part] = raw[a:b]
            a = b

    def _merge(self, parts: list[str], written: list[str]) -> None:
        spelt = [w.encode() for w in written]
        ids, begin = self.merges(b"".join(spelt))
        ends = np.searchsorted(begin, np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt))))
        raw, a = ids.astype("<u4").tobytes(), 0
        for part, b in zip(parts, (4 * ends).tolist()):
            self.memo[part] = raw[a:b]
            a = b

    def plain(self, text: str) -> bool:
        if self.special and self.special.search(text):
            return False
        if not text.isascii():
            return bool(_PLAIN.fullmatch(text))
        # the same for ASCII: signs, and no blank or line end at an edge or beside another
        blanks = text.replace("\n", " ")
        return text != "" and not text.encode().translate(None, _SIGNS) and blanks[0] != " " and blanks[-1] != " " and "  " not in blanks

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; what is new to all of them is learnt at once."""
        split = [_parts(t) if self.plain(t) else None for t in texts]
        out = [self.known(p) if p else self.whole(t) if t else b"" for p, t in zip(split, texts)]
        open_ = [i for i, ids in enumerate(out) if ids is None]
        if open_:
            new = set().union(*[split[i] for i in open_]).difference(self.memo)
            if len(self.memo) + len(new) > self.most // 2:
                self.older, self.memo = self.memo, {}
                new = set().union(*[split[i] for i in open_])
            again = new.intersection(self.older)
            self.memo.update(zip(again, map(self.older.__getitem__, again)))
            if len(again) < len(new):
                self.learn(list(new - again))
            for i in open_:
                out[i] = self.known(split[i])
        return out

    def known(self, parts: list[str]) -> bytes | None:
        """Ids of a plain text's parts; None if one is not known yet."""
        try:
            # the line end put before a text's first word is one id
            return b"".join(map(self.memo.__getitem__, parts))[4:]
        except KeyError:
            return None


def _byte_pairs(read: dict) -> bool:
    """Whether a tokenizer is byte-level pairs and nothing else, so that :class:`Merges` gives its ids."""
    model, cut = read["model"], read.get("pre_tokenizer") or {}
    more = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    return model.get("type", "BPE") == "BPE" and not any(model.get(m) for m in more) and not read.get("normalizer") and cut.get("type") == "ByteLevel" and bool(cut.get("use_regex", True)) and not cut.get("add_prefix_space")


def _parts(text: str) -> list[str]:
    """Words of a plain text, each after a line end with that; the first gets one."""
    return ("\n" + text).replace("\n", " \n").split(" ")[1:]


@functools.lru_cache(maxsize=2)
def encoder(definition: str) -> Encoder:
    """A worker's encoder; what it has learnt serves all tasks of the worker."""
    return Encoder(definition)


def definition(path: str) -> str:
    """The tokenizer's file, read on the driver; it is of fixed size and goes out as a broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _portions(ids: pd.Series, texts: pd.Series, chars: int = 500_000) -> Iterator[tuple[list, list[str]]]:
    """Rows in portions of about so many characters."""
    some: tuple[list, list[str]] = ([], [])
    held = 0
    for i, t in zip(ids, texts):
        some[0].append(i)
        some[1].append(t or "")
        held += len(some[1][-1])
        if held >= chars:
            yield some
            some, held = ([], []), 0
    yield some


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(definition(tokenizer))
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(shared.value)
        for batch in batches:
            rows: list[tuple] = []
            for docs_at_once in _portions(batch["doc_id"], batch["text"]):
                for doc, ids in zip(docs_at_once[0], encode(docs_at_once[1])):
                    ids += end
                    n = len(ids) // 4
                    bounds = [0, n] if n <= size else [0, *range(n % size or size, n, size), n]
                    rows += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": batch["doc_id"].dtype, "piece": "int32"})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts by length.

    Steps (length, first rank, pieces, first bin, offset): the pieces of that length with ranks from the
    first on go, one each, to the bins from the first bin on, at the offset.
    """
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs (first bin, bins)
    steps: list[tuple[int, int, int, int, int]] = []
    bins = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def fill(first: int, n: int, room: int) -> None:
            """Puts as many pieces as fit into each bin of a run in turn; the last bin may get fewer."""
            nonlocal rank, left
            per = room // length
            full = min(n, left // per)
            for each, run in ((per, full), (left % per if full < n and left - full * per < per else 0, 1)):
                if each and run:
                    for k in range(each):
                        steps.append((length, rank, run, first, size - room + k * length))
                        rank += run
                    left -= each * run
                    if room > each * length:
                        open_bins[room - each * length].append((first, run))
                    first, n = first + run, n - run
            if n:
                open_bins[room].append((first, n))

        for room in sorted(r for r in open_bins if r >= length and open_bins[r]):
            runs, open_bins[room] = open_bins[room], []
            for first, n in runs:
                if left:
                    fill(first, n, room)
                else:
                    open_bins[room].append((first, n))
        if left:
            new = -(-left // (size // length))
            fill(bins, new, size)
            bins += new
    return steps


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, size, end_id)
    cut = stored(cut.withColumn("key", hash_key(10, F.col("doc_id"), F.col("piece"))).withColumn("one", F.lit(1)), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    return placed(spark, cut, plan(counts, size)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def placed(spark: SparkSession, cut: DataFrame, steps: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Joins each piece, by its length and its rank within the length, to the step that holds the rank."""
    counts = defaultdict(int)
    for length, _, n, _, _ in steps:
        counts[length] += n
    n = sum(counts.values())
    known = F.create_map(*[F.lit(v) for item in counts.items() for v in item]) if counts else F.create_map().cast("map<int,int>")
    bits = range_bits(F.element_at(known, F.col("length").cast("int")), n, partitions(spark))
    ranked = prefix_sums(cut, ["length"], "key", ["doc_id", "piece", "ids_crc32", "start"], {"rank": "one"}, bits)
    # at most a few steps per pair of lengths, whatever the corpus
    table = stored(spark.createDataFrame(pd.DataFrame(steps, columns=["_length", "_rank", "_n", "_bin", "offset"]) if steps else [], "_length long, _rank long, _n long, _bin long, offset long"), "plan")
    on = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_rank")) & (F.col("rank") < F.col("_rank") + F.col("_n"))
    return ranked.join(F.broadcast(table) if len(steps) <= BROADCAST_STEPS else table, on).withColumn("sequence_id", F.col("_bin") + F.col("rank") - F.col("_rank"))
