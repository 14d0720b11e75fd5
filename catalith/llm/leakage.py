"""Evaluation passages that occur in a training corpus, whole or in part.

Q-gram lemma filtering.  Texts are folded to lower-case words with single blanks.
All q-grams of the passages form an index that every task holds; a text's q-grams
are hashed in one vectorised sweep and held against it.  Shared q-grams are
counted in overlapping diagonal bands (text position minus passage position).
A band that holds fewer of them than the lemma leaves of the shortest piece of an
occurrence within its edit budget is dropped; of the regions that remain, those
are retained whose shared q-grams cover enough of some window of the passage as
long as the shortest case.  All of that runs in vectorised steps over many texts.

Retained regions are verified by banded alignment of characters: runs of shared
q-grams are exact matches, and between two of them the alignment moves along the
furthest points of the diagonals of a band whose width is the edit budget that
the stretch has earned, so an edit costs ``EDIT_COST`` matched characters.  The
longest stretch of the passage that the text follows this way, in one piece or
in pieces that continue each other, must hold the asked share of its words.

Passages are the query set.  They are taken in blocks of ``BLOCK_CHARS`` that are
broadcast one after the other; all texts run past a block where they are read,
whole and without a shuffle.  The driver never holds more than a block.

Defined cases: null and empty texts and passages give nothing; a sentence that
several passages share at their start (an instruction) is no part of them; a
passage shorter than a q-gram gives nothing; repeated documents each count, and
so do repeated items.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.util import Scratch, broadcast_if_small, spread, table

#: Characters of the passages of a block: the size of what is broadcast (an index takes 16 bytes a character).
BLOCK_CHARS = 16_000_000
#: Characters of texts, and shared q-grams, that are worked on at a time.
STEP, EXPANDED = 1_000_000, 20_000_000
#: Length of a q-gram, characters.
Q = 9
#: Share of a passage's words that makes a case.
SHARE = 0.3
#: Width of a diagonal band; bands overlap by half.
BAND = 32
#: Characters of the shortest piece and edits that it may carry; by the lemma a band shares so many q-grams with it.
LEAST_PIECE, PIECE_EDITS = 32, 2
LEAST_IN_BAND = LEAST_PIECE - Q + 1 - Q * PIECE_EDITS
#: Share of the shortest case's characters that shared q-grams must cover.
COVERED = 0.7
#: Matched characters that an edit costs: a stretch must hold three quarters of its characters.
EDIT_COST = 3
#: Words of the shortest piece; words that may be missing or doubled between pieces.
LEAST_WORDS, GAP, OVERLAP = 5, 3, 2
#: Passages that must share their first sentence for it to be an instruction.
SHARED_BY = 3

_TAG = re.compile(r"<[^<>\n]{1,60}>")
_WORD = re.compile(r"[^\W_]+")
_FIRST = re.compile(r"^\s*([^.!?\n]{12,300}[.!?\n])\s*")


def fold(text: str) -> str:
    """Lower-case words with single blanks; tags are blanks."""
    text = _TAG.sub(" ", text)
    return " ".join(_WORD.findall((html.unescape(text) if "&" in text else text).casefold()))


def head(passage: str) -> str:
    """The folded first sentence, '' if there is none to cut."""
    m = _FIRST.match(passage)
    return fold(m.group(1)) if m else ""


def own_passages(items: DataFrame, item_id: str, passage: str) -> DataFrame:
    """(item_id, passage): folded, without a first sentence that several share; only the sentences are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, head(p), fold(p), fold(_FIRST.sub("", p, count=1))) for i, p in zip(pdf["item_id"], pdf["passage"], strict=True)]
            yield pd.DataFrame(rows, columns=["item_id", "head", "whole", "rest"])

    said = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(passage).alias("passage")).where("item_id IS NOT NULL AND passage <> ''")
    cut = said.mapInPandas(run, "item_id long, head string, whole string, rest string")
    shared = cut.where("head <> ''").groupBy("head").count().where(F.col("count") >= SHARED_BY).select("head", F.lit(True).alias("shared"))
    both = cut.join(broadcast_if_small(shared), "head", "left")
    return both.select("item_id", F.when(F.col("shared"), F.col("rest")).otherwise(F.col("whole")).alias("passage")).where(F.length("passage") >= Q)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of each q-gram; the position is that of its first character."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    wide, out = codes.astype(np.uint64), np.zeros(n, dtype=np.uint64)
    for k in range(Q):
        out = out * np.uint64(1_000_003) + wide[k : k + n]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0x9E3779B97F4A7C15)


def _begins(words: list[str]) -> list[int]:
    """Where each word begins in the folded text."""
    return [0, *accumulate(len(w) + 1 for w in words[:-1])]


def _counted(keys: np.ndarray, weights: np.ndarray | None = None, parts: int = 1) -> list[np.ndarray]:
    """The total of each key, in ``parts`` equal pieces; keys that share a slot count together, so a total is never too small."""
    slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)
    return np.split(np.bincount(slots, weights=weights, minlength=1 << 22)[slots], parts)


class Index:
    """All q-grams of a block of passages."""

    def __init__(self, passages: list[tuple[int, str]], share: float = SHARE):
        self.ids, self.texts = [i for i, _ in passages], [p for _, p in passages]
        self.words = [p.split(" ") for p in self.texts]
        self.starts = [_begins(ws) for ws in self.words]
        self.ends = [[a + len(w) for a, w in zip(s, ws, strict=True)] for s, ws in zip(self.starts, self.words, strict=True)]
        self.shortest = np.array([self._shortest(k, share) for k in range(len(passages))], dtype=np.int64)
        hashes = [_hashes(_codes(p)) for p in self.texts]
        key = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        order = np.argsort(key, kind="stable")
        self.item = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes])[order]
        self.place = (np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes]) if hashes else np.empty(0, dtype=np.int32))[order]
        self.keys, self.first = np.unique(key[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.width = max(map(len, self.texts), default=0) + 1
        self.bits = 22
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def _shortest(self, k: int, share: float) -> int:
        """Characters of the shortest run of words that makes a case."""
        n = max(1, math.ceil(share * len(self.words[k])))
        return min(e - s for s, e in zip(self.starts[k], self.ends[k][n - 1 :], strict=False))

    def sweep(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the q-grams that the index holds, and where it holds them; in steps of bounded memory."""
        slots, found = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for a in range(0, max(0, len(codes) - Q + 1), STEP):
            hashes = _hashes(codes[a : a + STEP + Q - 1])
            near = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
            hit = self.keys[at] == hashes[near]
            slots.append(near[hit] + a)
            found.append(at[hit])
        return np.concatenate(slots), np.concatenate(found)

    def runs(self, slots: np.ndarray, entries: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, passage, runs) of the retained regions; a run is (diagonal, first passage position, shared q-grams).

        Passages are independent, so many shared q-grams are worked off in ranges of passages.
        """
        reps = self.last[entries] - self.first[entries]
        total = int(reps.sum())
        parts = max(1, math.ceil(total / EXPANDED))
        edges = np.linspace(0, len(self.ids), min(parts, len(self.ids)) + 1).astype(np.int64)
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            held: list[tuple[np.ndarray, ...]] = []
            for a, b in self._slices(reps):
                n = reps[a:b]
                flat = np.repeat(self.first[entries[a:b]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                item, at = self.item[flat], np.repeat(slots[a:b], n)
                mine = slice(None) if parts == 1 else (item >= low) & (item < high)
                held.append((item[mine].astype(np.int64), self.place[flat][mine].astype(np.int64), at[mine]))
            if held:
                yield from self._retained(*(np.concatenate(x) for x in zip(*held, strict=True)), begins)

    @staticmethod
    def _slices(reps: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of hits that expand to about EXPANDED rows each."""
        upto = np.cumsum(reps)
        a = 0
        while a < len(reps):
            base = upto[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(upto, base + EXPANDED, side="right")))
            yield a, b
            a = b

    def _retained(self, item: np.ndarray, place: np.ndarray, at: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        pair = (np.searchsorted(begins, at, side="right") - 1) * len(self.ids) + item
        # a case has at least one shared q-gram for Q of its covered characters
        asked = np.maximum(1, (COVERED * self.shortest / Q).astype(np.int64))
        kept = _counted(pair)[0] >= asked[item]
        pair, place, at = pair[kept], place[kept], at[kept]
        if not len(pair):
            return
        # order by pair, diagonal, place; runs are consecutive places of a diagonal
        span, wide = np.int64(at.max() + self.width + 1), np.int64(self.width + Q)
        line = pair * span + (at - place + self.width)
        if float(line.max()) * float(wide) < 2**62:
            key = np.sort(line * wide + place)
            begin = np.flatnonzero(np.diff(key, prepend=-2) != 1)
            line, place = np.divmod(key[begin], wide)
            length = np.diff(np.append(begin, len(key)))
        else:
            order = np.lexsort((place, line))
            line, place = line[order], place[order]
            begin = np.flatnonzero((np.diff(line, prepend=-1) != 0) | (np.diff(place, prepend=-2) != 1))
            length = np.diff(np.append(begin, len(line)))
            line, place = line[begin], place[begin]
        pair, diagonal = np.divmod(line, span)
        # shared q-grams of overlapping bands
        cell, cells = diagonal // (BAND // 2), span // (BAND // 2) + 2
        low, high = _counted(np.concatenate((pair * cells + cell, pair * cells + cell + 1)), np.concatenate((length, length)), 2)
        kept = np.maximum(low, high) >= LEAST_IN_BAND
        diagonal, place, pair, length = diagonal[kept], place[kept], pair[kept], length[kept]
        if not len(pair):
            return
        # characters that the runs cover in the best window as long as the shortest case
        new = np.diff(pair, prepend=-1) != 0
        first, row = np.flatnonzero(new), np.cumsum(new) - 1
        pairs = pair[first]
        order = np.argsort(row * wide + place)
        left = (row * wide + place)[order]
        reach = np.maximum.accumulate(left + length[order] + Q - 1)
        left = np.maximum(left, np.concatenate(([0], reach[:-1])))
        size = np.maximum(reach - left, 0)
        before = np.cumsum(size) - size
        window = left + self.shortest[pairs % len(self.ids)][row[order]]
        last = np.searchsorted(left, window, side="right") - 1
        covered = before[last] + np.minimum(window - left[last], size[last]) - before
        best = np.maximum.reduceat(covered, first)  # each pair has as many runs in either order
        runs = np.stack((diagonal - self.width, place, length), axis=1)
        ends = np.append(first[1:], len(pair))
        for k in np.flatnonzero(best >= COVERED * self.shortest[pairs % len(self.ids)]):
            t, i = divmod(int(pairs[k]), len(self.ids))
            shifted = runs[first[k] : ends[k]].copy()
            shifted[:, 0] -= begins[t]
            yield t, i, shifted

    def verified(self, k: int, runs: np.ndarray, text: str) -> float:
        """Share of passage k in the longest stretch that the text follows."""
        pieces = []
        starts, ends = self.starts[k], self.ends[k]
        cuts = np.flatnonzero(np.diff(runs[:, 0]) > BAND // 2) + 1  # runs are ordered by diagonal
        for near in np.split(runs, cuts):
            if near[:, 2].sum() + (Q - 1) * len(near) < COVERED * LEAST_PIECE:
                continue
            matches = sorted((int(p), int(p) + int(n) + Q - 1, int(d)) for d, p, n in near)
            for a, b, ta, tb in aligned_pieces(matches, self.texts[k], text):
                i, j = bisect_left(starts, a), bisect_right(ends, b) - 1
                if j - i + 1 >= LEAST_WORDS:
                    pieces.append((i, j, ta, tb))
        return longest_chain(pieces) / len(self.words[k])


def edits_within(a: str, b: str, budget: int) -> int | None:
    """The edits between two strings, None if they exceed ``budget``.

    The furthest point that each diagonal reaches with 0, 1, 2 ... edits; only a
    band of ``budget`` diagonals on either side is ever looked at.
    """
    goal, n, m = len(b) - len(a), len(a), len(b)
    if abs(goal) > budget:
        return None
    far = [-9] * (2 * budget + 5)  # by diagonal, with two unreachable ones on either side
    mid = budget + 2
    far[mid] = -1
    for e in range(budget + 1):
        new = far[:]
        for d in range(max(-e, goal - (budget - e)), min(e, goal + (budget - e)) + 1):
            at = mid + d
            i = max(far[at] + 1, far[at - 1], far[at + 1] + 1)
            if i < 0:
                continue
            i = min(i, n, m - d)
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            new[at] = i
        far = new
        if far[mid + goal] >= n:
            return e
    return None


def aligned_pieces(matches: list[tuple[int, int, int]], passage: str, text: str) -> list[tuple[int, int, int, int]]:
    """(first, last passage position, first, last text position) of the stretches that a text follows.

    ``matches`` are exact: (begin, end, diagonal), by begin.  A match continues
    another if what lies between them costs less than the other has earned.
    """
    score, link, origin = [], [], []
    for j, (a, b, d) in enumerate(matches):
        best, via, own = b - a, -1, a
        for i in range(j - 1, -1, -1):
            a0, b0, d0 = matches[i]
            lap = max(b0 - a, b0 + d0 - a - d, 0)  # the later match gives way where both overlap
            room = (score[i] - 1) // EDIT_COST
            if b - a - lap <= 0 or abs(d - d0) > room or score[i] + b - a - lap <= best:
                continue
            gap, across = passage[b0 : a + lap], text[b0 + d0 : a + d + lap]
            e = max(len(gap), len(across)) if min(len(gap), len(across)) == 0 else edits_within(gap, across, room)
            if e is None or e > room:
                continue
            gained = score[i] + b - a - lap + max(0, len(gap) - e) - EDIT_COST * e
            if gained > best:
                best, via, own = gained, i, origin[i]
        score.append(best)
        link.append(via)
        origin.append(own)
    out, used = [], set()
    for j in sorted(range(len(matches)), key=lambda j: -score[j]):
        path, at = [], j
        while at >= 0 and at not in used:
            path.append(at)
            at = link[at]
        used.update(path)
        if path:
            first, last = matches[path[-1]], matches[path[0]]
            out.append((first[0], last[1], first[0] + first[2], last[1] + last[2]))
    return out


def longest_chain(pieces: list[tuple[int, int, int, int]]) -> int:
    """Words from the first to the last of the longest chain of pieces that continue each other."""
    pieces = sorted(pieces)
    begins = []
    best = 0
    for n, (a, b, ja, _) in enumerate(pieces):
        begin = a
        for m in range(n):
            b0, jb0 = pieces[m][1], pieces[m][3]
            if pieces[m][0] < a and b > b0 and b0 - OVERLAP < a <= b0 + 1 + GAP and jb0 < ja + 8 * OVERLAP:
                begin = min(begin, begins[m])
        begins.append(begin)
        best = max(best, b - begin + 1)
    return best


def scan(index: Index, ids: list, texts: list[str], share: float = SHARE) -> list[tuple]:
    """(id, passage id, share) of every occurrence in a batch of texts."""
    if not len(index.keys):
        return []
    out, batch, chars = [], [], 0
    for n, text in enumerate(texts):
        folded = fold(text) if text else ""
        batch.append((ids[n], folded))
        chars += len(folded) + 1
        if chars >= STEP or n + 1 == len(texts):
            out += _scan_batch(index, batch, share)
            batch, chars = [], 0
    return out


def _scan_batch(index: Index, batch: list[tuple], share: float) -> list[tuple]:
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for _, t in batch])))[:-1]
    slots, entries = index.sweep(_codes("\n".join(t for _, t in batch)))
    out = []
    for n, k, runs in index.runs(slots, entries, begins):
        held = index.verified(k, runs, batch[n][1])
        if held >= share:
            out.append((batch[n][0], int(index.ids[k]), float(held)))
    return out


def _blocks(own: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Passages in blocks; the driver holds one at a time."""
    block, chars = [], 0
    for item, passage in own.toLocalIterator():
        block.append((item, passage))
        chars += len(passage)
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, share): the documents that hold at least ``share`` of an item's own passage."""
    spark = docs.sparkSession
    source = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL"))
    schema = f"doc_id {dict(source.dtypes)['doc_id']}, item_id long, share double"

    def against(block: list[tuple[int, str]]) -> tuple[DataFrame, object]:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Index(sent.value, share)
            for pdf in batches:
                yield pd.DataFrame(scan(index, pdf["doc_id"].tolist(), pdf["text"].tolist(), share), columns=["doc_id", "item_id", "share"])

        return source.mapInPandas(run, schema), sent

    blocks = _blocks(own_passages(items, item_id, passage))
    out, scratch, block = None, None, next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        found, sent = against(block)
        if following is not None or out is not None:  # several blocks: each is done and freed before the next is sent
            scratch = scratch or Scratch(spark, "leakage")
            found = scratch.keep(found, "found")
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
        block = following
    return out if out is not None else spark.createDataFrame([], schema)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every leaked item and the documents that hold it."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return find_leaks(docs, "doc_id", "text", items, "item_id", "passage").select("doc_id", "item_id")
