"""Test passages leaking into a corpus: found through an FM-index per shard of documents."""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.fmindex import FMIndex
from pathloom.llm.tokens import share
from pathloom.llm.words import TEXT_END, counted_words, folded, replace_lookalikes

#: Words in a row that make a leak, and the share of a passage's words (in order) that makes one.
RUN_WORDS, SHARE = 12, 0.8
#: Words of a searched phrase.
PHRASE = 3
#: Words of an index, about, and of the texts that it stands for; bytes of test passages that a task holds at once, beyond which several passes are made.
SHARD_WORDS, SHARD_TEXT, PASS_BYTES = 400_000, 2_000_000, 32 << 20
#: Characters of texts that are folded as one string; words a task remembers; cells of a comparison made at once.
FOLDED_CHARS, REMEMBERED, CELLS = 1 << 20, 1 << 20, 1 << 22
#: Symbols below the passages' words: a document's end, words no passage has.
DOCUMENT_END, OTHER, FIRST = 1, 2, 3
#: Bits of the table of pairs of neighbours.
PAIR_BITS = 24

TOKEN = re.compile(r"[^\W_]+|\x1d")
_RESULT = "run_words long, share double, spans array<struct<first_word:long,last_word:long>>"
_COLUMNS = ["doc", "item_id", "run_words", "share", "spans"]


def passage_of(text: str | None) -> str:
    """An item's text after its instruction line, if it has one (a first line ended by a line break)."""
    return (text or "").split("\n", 1)[-1]


def edits(n: int) -> int:
    """Words of a passage of n words that may be missing from a copy."""
    return n - math.ceil(SHARE * n - 1e-9)


def chosen(frequency: list[int], n: int) -> list[int]:
    """Which of a passage's phrases must be searched, the rarest where there is a choice: one stands unchanged in every run of RUN_WORDS words, and in
    every copy with up to edits(n) words changed (e changes spoil 3e of the phrases at most, so of 3e + 1 one is left)."""
    by_rarity = sorted(range(len(frequency)), key=lambda p: (frequency[p], p))
    picked = set(by_rarity[: PHRASE * edits(n) + 1])
    width = min(RUN_WORDS, n) - PHRASE + 1
    for start in range(len(frequency) - width + 1):
        window = range(start, start + width)
        if picked.isdisjoint(window):
            picked.add(min(window, key=lambda p: (frequency[p], p)))
    return sorted(picked)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - PAIR_BITS)


class Passages:
    """The passages' words as numbers, and the searched phrases (of each length) with the places they have in them."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids, said, counted = [], [], []
        for item, text in items:
            words, of = counted_words(passage_of(text))
            if words:
                self.ids.append(item)
                said.append([self.vocabulary.setdefault(x, len(self.vocabulary) + FIRST) for x in words])
                counted.append(of)
        self.n = np.array([len(w) for w in said], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.words = np.array([x for w in said for x in w], np.int64)
        self.counted = np.array([x for c in counted for x in c], np.int64)
        phrases = [[tuple(w[p : p + PHRASE]) for p in range(max(1, len(w) - PHRASE + 1))] for w in said]
        held_by = Counter(x for found in phrases for x in set(found))
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, found in enumerate(phrases):
            for p in chosen([held_by[x] for x in found], len(said[k])) if len(said[k]) >= PHRASE else [0]:
                places.setdefault(found[p], []).append((k, p))
        self.searched = []
        for size in sorted({len(x) for x in places}):
            of_size = [x for x in places if len(x) == size]
            self.searched.append((np.array(of_size, np.int64), np.array([len(places[x]) for x in of_size]), np.array([y for x in of_size for y in places[x]], np.int64)))
        # what may begin a phrase: pairs of neighbours, and passages of a word
        self.pairs = np.unique(np.concatenate([_pair(p[:, i], p[:, i + 1]) for p, _, _ in self.searched for i in range(p.shape[1] - 1)] or [np.zeros(0, np.uint64)]))
        self.single = np.array([p[0] for p in places if len(p) == 1], np.int64)
        self.two = any(len(p) == 2 for p in places)
        # each passage's distinct words
        self.bag = np.unique(np.repeat(np.arange(len(self.n)), self.n) << 32 | self.words)


class _Numbers(dict):
    """Numbers of words as they are met."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__({TEXT_END: DOCUMENT_END})
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        n = self[word] = self.vocabulary.get(replace_lookalikes(word), OTHER)
        return n


def _runs(p: Passages, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Where passages laid at places agree with the text in enough words in a row: row, first word, last word, counted words."""
    for rows, offset, inside in _windows(p.n[k], at, lo, hi):
        passage = p.start[k[rows]][:, None] + offset
        mine = offset < p.n[k[rows]][:, None]
        same = np.zeros((len(rows), offset.shape[1] + 2), bool)
        same[:, 1:-1] = inside & mine & (words[np.where(inside, at[rows][:, None] + offset, 0)] == p.words[np.where(mine, passage, 0)])
        r, first = np.nonzero(same[:, 1:] & ~same[:, :-1])
        _, last = np.nonzero(same[:, :-1] & ~same[:, 1:])
        last -= 1
        which = rows[r]
        of = p.start[k[which]]
        n = p.counted[of + last] - p.counted[of + first] + 1
        enough = n >= np.minimum(RUN_WORDS, p.counted[of + p.n[k[which]] - 1] + 1)
        yield which[enough], at[which[enough]] + first[enough], at[which[enough]] + last[enough], n[enough]


def _windows(n: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of n words from each place, some of like length at a time: rows, offsets and which of them lie in the document."""
    order, i = np.argsort(n, kind="stable"), 0
    while i < len(order):
        # as many as fit, by the longest of them
        j = min(len(order), i + max(1, CELLS // int(n[order[i]] + 1)))
        while j - i > 1 and (j - i) * int(n[order[j - 1]]) > 2 * CELLS:
            j = i + (j - i) // 2
        rows = order[i:j]
        offset = np.arange(int(n[rows[-1]]))[None, :]
        place = at[rows][:, None] + offset
        yield rows, offset, (place >= lo[rows][:, None]) & (place < hi[rows][:, None]) & (offset < n[rows][:, None])
        i = j


def _copies(p: Passages, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """How much of each passage stands in order in a window: row, first word, last word, share. Windows that lack the words are passed over."""
    likely = []
    for rows, offset, inside in _windows(size, at, lo, hi):
        w = words[np.where(inside, at[rows][:, None] + offset, 0)]
        key = k[rows][:, None] << 32 | w
        found = np.minimum(np.searchsorted(p.bag, key), len(p.bag) - 1)
        n = (inside & (p.bag[found] == key)).sum(axis=1)
        likely.append(rows[n >= SHARE * p.n[k[rows]] - 1e-9])
    likely = np.concatenate([*likely, np.zeros(0, np.int64)])
    for part, offset, inside in _windows(size[likely], at[likely], lo[likely], hi[likely]):
        rows = likely[part]
        w = np.where(inside, words[np.where(inside, at[rows][:, None] + offset, 0)], -1)
        n = p.n[k[rows]]
        # longest common subsequence, row by row of the passage: its length in the upper bits, where it began in the lower ones
        line = np.zeros((len(rows), w.shape[1] + 1), np.int64)
        for i in range(int(n.max())):
            said = np.where(i < n, p.words[np.minimum(p.start[k[rows]] + i, len(p.words) - 1)], -2)
            before = line[:, :-1]
            longer = np.where(before >> 32 == 0, np.int64(1) << 32 | offset, before + (np.int64(1) << 32))
            line[:, 1:] = np.maximum(line[:, 1:], np.where(w == said[:, None], longer, 0))
            np.maximum.accumulate(line, axis=1, out=line)
        length = line[:, -1] >> 32
        end = (line >> 32 == length[:, None]).argmax(axis=1)
        start = line[np.arange(len(rows)), end] & 0xFFFFFFFF
        good = length >= SHARE * n - 1e-9
        yield rows[good], (at[rows] + start)[good], (at[rows] + end - 1)[good], (length / n)[good]


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans in order, one where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"first_word": a, "last_word": b} for a, b in out]


def _leaks(p: Passages, keys: list, words: np.ndarray) -> pd.DataFrame:
    """The leaks of a shard: its documents' words, each document ended by DOCUMENT_END."""
    none = pd.DataFrame([], columns=_COLUMNS)
    known = words >= FIRST
    pair = _pair(words[:-1], words[1:])
    at = np.minimum(np.searchsorted(p.pairs, pair), len(p.pairs) - 1) if len(p.pairs) else np.zeros(len(pair), np.int64)
    pair = known[:-1] & known[1:] & (p.pairs[at] == pair) if len(p.pairs) else np.zeros(len(pair), bool)
    keep = np.isin(words, p.single) if len(p.single) else np.zeros(len(words), bool)
    if p.two:
        keep[:-1] |= pair
        keep[1:] |= pair
    else:
        both = pair[:-1] & pair[1:]
        for i in range(PHRASE):
            keep[i : i + len(both)] |= both
    place = np.flatnonzero(keep)
    if not len(place):
        return none
    # what no phrase can hold, a document's end among it, is one symbol between what some may
    gap = np.flatnonzero(np.diff(place) > 1) + 1
    index = FMIndex(np.insert(words[place], gap, OTHER))
    place = np.insert(place, gap, -1)
    hits, starts, ks = [], [], []
    for phrases, sizes, places in p.searched:
        lo, hi = index.search(phrases)
        hit = np.flatnonzero(hi > lo)
        n = (hi - lo)[hit]
        rows = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        where = place[index.locate(rows)]
        # each occurrence with each place that its phrase has in passages
        times = sizes[np.repeat(hit, n)]
        entry = np.repeat((np.cumsum(sizes) - sizes)[np.repeat(hit, n)] - np.cumsum(times) + times, times) + np.arange(times.sum())
        hits.append(np.repeat(where, times))
        starts.append(np.repeat(where, times) - places[entry, 1])
        ks.append(places[entry, 0])
    hit, start, k = np.concatenate(hits), np.concatenate(starts), np.concatenate(ks)
    ends = np.flatnonzero(words == DOCUMENT_END)
    doc = np.searchsorted(ends, hit)
    begins = np.r_[0, ends[:-1] + 1]
    many = len(p.n) + 1
    # passages laid where their phrases were found: what agrees word for word
    doc_k, start = np.unique(np.stack([doc * many + k, start]), axis=1) if len(hit) else (hit, hit)
    doc, k = np.divmod(doc_k, many)
    out: dict[int, list] = {}

    def add(which: np.ndarray, first: np.ndarray, last: np.ndarray, run: np.ndarray, part: np.ndarray) -> None:
        for key, begin, a, b, n, s in zip(which.tolist(), begins[which // many].tolist(), first.tolist(), last.tolist(), run.tolist(), part.tolist()):
            got = out.setdefault(key, [0, 0.0, []])
            got[0], got[1] = max(got[0], n), max(got[1], s)
            got[2].append((a - begin, b - begin))

    for rows, first, last, n in _runs(p, words, begins[doc], ends[doc], k, start):
        add(doc_k[rows], first, last, n, (last - first + 1) / p.n[k[rows]])
    # and copies with changed words, in windows with room for what was added
    room = np.maximum(4, p.n // 4)
    doc_k, window = np.unique(np.stack([doc_k, start // room[k]]), axis=1) if len(k) else (k, k)
    doc, k = np.divmod(doc_k, many)
    room = room[k]
    for rows, first, last, s in _copies(p, words, begins[doc], ends[doc], k, (window - 1) * room, p.n[k] + 3 * room):
        add(doc_k[rows], first, last, np.zeros(len(rows), np.int64), s)
    return pd.DataFrame([(keys[x // many], p.ids[x % many], run, s, _merged(spans)) for x, (run, s, spans) in out.items()], columns=_COLUMNS)


def _find(name: str, limit: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(SparkFiles.get(name), "rb") as f:
            p: Passages = pickle.load(f)
        numbers = _Numbers(p.vocabulary)
        keys, parts, kept, read = [], [], 0, 0
        for key_of, text_of in _portions(batches):
            if len(numbers) > REMEMBERED:
                numbers = _Numbers(p.vocabulary)
            tokens = TOKEN.findall(folded(text_of))
            words = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
            keys += key_of
            parts.append(words)
            kept += int((words >= FIRST).sum())
            read += len(words)
            if kept >= limit or read >= SHARD_TEXT:
                yield _leaks(p, keys, np.concatenate(parts))
                keys, parts, kept, read = [], [], 0, 0
        if keys:
            yield _leaks(p, keys, np.concatenate(parts))

    return run


def _portions(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    """Documents in portions of about FOLDED_CHARS characters, those of plain ASCII apart from others, which take longer to fold."""
    held: dict[bool, tuple[list, list[str]]] = {True: ([], []), False: ([], [])}
    size = {True: 0, False: 0}
    for batch in batches:
        for key, text in zip(batch["doc"], batch["text"]):
            plain = text.isascii()
            held[plain][0].append(key)
            held[plain][1].append(text)
            size[plain] += len(text)
            if size[plain] >= FOLDED_CHARS:
                yield held[plain]
                held[plain], size[plain] = ([], []), 0
    yield from (x for x in held.values() if x[0])


def leaked_items(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every document with each test item whose passage it holds: key, item, run_words, share, spans.

    It holds a passage if RUN_WORDS of its words stand in a row (a shorter passage: all of them), or if SHARE of its words stand
    in order in a window of about its length. Words are compared as words.fold leaves them. spans are what must be removed: first_word and last_word
    (numbers of the document's folded words) of every occurrence, one where they overlap or touch. run_words is the longest run, 0 where
    only changed copies were found; share is that of the best occurrence.

    Defined cases: null and empty texts hold nothing; items with a null text, or a passage without words, have no cases; items of one or two words are
    found like others; rows of one document count together; repeated items count once; empty tables give an empty result; other columns are ignored.

    Method: each task cuts its documents into shards of about shard_words words (of the passages) and builds an FM-index of each shard, in which a row of words that
    can't be part of a phrase is one symbol; phrases of PHRASE words of the passages are searched backwards through the wavelet matrix, their
    occurrences located by sampled suffix positions. Of a passage so many phrases are searched, the rarest ones, that one stands in every
    run and in every copy with up to 1 - SHARE of its words changed; where they are found, the passage is laid and verified word by word. A phrase that thousands of
    passages share is thus passed over where a passage has others. Documents aren't shuffled. The passages are a file that executors
    fetch; beyond PASS_BYTES of them several passes over the corpus are made, one after another put together by the driver.
    """
    spark = documents.sparkSession
    kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    tests = items.select(F.col(item).alias("i"), F.col(passage).alias("t")).where("i is not null and t is not null").distinct()
    size = tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, math.ceil(size / PASS_BYTES))
    docs = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    out = None
    for k in range(passes):
        part = tests.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == k) if passes > 1 else tests
        p = Passages([(r["i"], r["t"]) for r in part.orderBy("i", "t").collect()])  # about PASS_BYTES
        if not p.searched:
            continue
        name = share(spark, pickle.dumps(p), "passages")
        one = docs.mapInPandas(_find(name, shard_words), f"doc {kind}, item_id {item_kind}, {_RESULT}")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], f"doc {kind}, item_id {item_kind}, {_RESULT}").withColumnsRenamed({"doc": key, "item_id": item})
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")
    merged = out.groupBy("doc", "item_id").agg(F.max("run_words").alias("run_words"), F.max("share").alias("share"), spans)
    return merged.withColumnsRenamed({"doc": key, "item_id": item})
