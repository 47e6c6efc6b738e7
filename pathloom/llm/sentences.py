"""Sentences of many texts at once, whatever their layout, and the terms in them as numbers."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex
import xxhash

from pathloom.llm.words import ESCAPED, HYPHEN, LOOKALIKES, unescaped, visible

#: What ends a text and a sentence while texts are worked on as one string; in a text they count as line ends.
TEXT_END, SENTENCE_END = "\x1d", "\x1e"
BREAKS = re.compile(r"\r\n?|[\v\f\x1c\x1e\x85\u2028\u2029]")
#: Tags within one text: those that may stand inside a word, and others.
INLINE = re.compile(r"</?(?:a|abbr|b|code|del|em|font|i|ins|mark|s|small|span|strong|sub|sup|u)(?:\s[^<>\x1d]{0,300})?>", re.I)
TAG = re.compile(r"</?[a-z!][^<>\x1d]{0,300}>", re.I)
LINK = re.compile(r"(?:https?://|www\.)\S+")
#: The end of a sentence: its mark, with closing quotes and brackets.
END = re.compile(r"[.!?…]['\"”’»)\]]{0,3}\s")
END_UNSPACED = re.compile(r"[。！？؟।]")
#: What lists, quotes, headings and table rows put before a line.
BEFORE = re.compile(r"^(?:[^\S\n\x1d]|[>*•#|\-–])*+(?:\d++[;,|\t][^\S\n\x1d]*(?:[^\W\d_]{1,3}[;,|\t][^\S\n\x1d]*)?)?[\"']*", re.M)
#: A line that begins with a letter; what ends a line before it; what may stand behind that.
NEXT_LINE, LINE_ENDS, BEHIND = re.compile(r"\n(?=[^\W\d_])"), ".!?…。！？؟\n\x1d", " \t\"'|"
CONTROLS = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]+")
TOKEN = re.compile(r"[^\W_]+|[\n\x1d\x1e]")
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
LETTERS = re.compile(r"[^\W\d_]{2,}")
#: A sentence longer than this many words has lost its punctuation; it is cut into pieces of about PIECE words.
RUN_ON, PIECE = 24, 13
#: Fewer words (of two letters or more; letters of scripts that don't space words) are no sentence.
LEAST_WORDS, LEAST_LETTERS = 3, 4



def _wrapped(m: re.Match) -> str:
    """A line that goes on in lower case where the one before has no end is joined to it."""
    s, i = m.string, m.start()
    if not s[i + 1].islower():
        return "\n"
    while i and s[i - 1] in BEHIND:
        i -= 1
    return "\n" if not i or s[i - 1] in LINE_ENDS else " "


def _without_mail(s: str) -> str:
    """Without the words that have an @ inside."""
    out, done, at = [], 0, s.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a > done and not s[a - 1].isspace():
            a -= 1
        while b < len(s) and not s[b].isspace():
            b += 1
        if a < at and b > at + 1:
            out.append(s[done:a])
            done = b
        at = s.find("@", b)
    return " ".join([*out, s[done:]])


def _plain(texts: list[str]) -> str:
    """The texts as one plain string: each ends with TEXT_END, each sentence and line with SENTENCE_END or a line break."""
    if any(TEXT_END in t for t in texts):
        texts = [t.replace(TEXT_END, "\n") for t in texts]
    s = BREAKS.sub("\n", f"\n{TEXT_END}\n".join([*texts, ""]))
    if "&" in s:
        s = html.unescape(s)
    if "<" in s:
        s = TAG.sub("\n", INLINE.sub("", s))
    if "@" in s:
        s = _without_mail(s)
    if "://" in s or "www." in s:
        s = LINK.sub(" ", s)
    s = END.sub(SENTENCE_END, NEXT_LINE.sub(_wrapped, BEFORE.sub("", HYPHEN.sub("", s))))
    if "\\" in s:
        s = ESCAPED.sub(unescaped, s)
    if s.isascii():
        return CONTROLS.sub("", s).lower()
    return visible(unicodedata.normalize("NFKD", END_UNSPACED.sub(SENTENCE_END, s))).lower()


class Words(dict):
    """Numbers of words (0 and 1 are the ends of sentences and texts) with what the terms need of each."""

    #: Words that a task should remember at most.
    REMEMBERED = 1 << 20

    def __init__(self) -> None:
        super().__init__({"\n": 0, SENTENCE_END: 0, TEXT_END: 1})
        self.hashes, self.letters, self.unspaced, self.plain = [0, 0], [0, 0], [0, 0], [False, False]
        self.inner: dict[int, list[int]] = {}

    def __missing__(self, word: str) -> int:
        seen, word = word, word.translate(LOOKALIKES)
        if seen != word:
            n = self[seen] = self[word]
            return n
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")))
        self.letters.append(len(LETTERS.findall(word)))
        odd = not word.isascii()
        self.unspaced.append(len(UNSPACED.findall(word)) if odd else 0)
        plain = not any(map(str.isdigit, word))
        if plain and self.unspaced[n]:
            self.inner[n] = [xxhash.xxh64_intdigest(word[i : i + 2].encode("utf-8", "surrogatepass")) for i in range(len(word) - 1)]
            plain = False
        self.plain.append(plain)
        return n

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words of all sentences, each one's sentence, and each sentence's text. ASCII texts come before others."""
        order = sorted(range(len(texts)), key=lambda i: not texts[i].isascii())
        split = next((k for k, i in enumerate(order) if not texts[i].isascii()), len(order))
        tokens = [t for part in (order[:split], order[split:]) if part for t in TOKEN.findall(_plain([texts[i] for i in part]))]
        ids = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        ends = ids < 2
        text = np.cumsum(ids == 1)[~ends]
        segment = np.cumsum(ends)[~ends]
        w = ids[~ends]
        if not len(w):
            return w, w, w
        # only sentences with words, numbered from 0
        new = np.r_[True, np.diff(segment) != 0]
        segment = np.cumsum(new) - 1
        n = np.bincount(segment)
        enough = (np.bincount(segment, np.array(self.letters)[w]) >= LEAST_WORDS) | (np.bincount(segment, np.array(self.unspaced)[w]) >= LEAST_LETTERS)
        at = np.arange(len(w)) - np.flatnonzero(new)[segment]
        pieces = np.where(n > RUN_ON, np.maximum(1, np.rint(n / PIECE)), 1).astype(np.int64)
        piece = ((at + 1) * pieces[segment] - 1) // n[segment]
        keep = enough[segment]
        w, segment, piece, text = w[keep], segment[keep], piece[keep], text[keep]
        if not len(w):
            return w, w, w
        new = np.r_[True, (np.diff(segment) != 0) | (np.diff(piece) != 0)]
        return w, np.cumsum(new) - 1, np.array(order)[text[new]]

    def terms(self, w: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The terms of sentences (words without digits, pairs of neighbours, pairs of letters of unspaced scripts): the hashes of all distinct ones, and
        of each entry the sentence and the place of its hash. An entry comes once a sentence; entries are in the order of sentences."""
        if not len(w):
            return w, w, w
        hashes, plain = np.array(self.hashes, np.uint64), np.array(self.plain)[w]
        single = w[plain]
        seen = np.flatnonzero(np.bincount(single, minlength=len(hashes)))
        place = np.zeros(len(hashes), np.int64)
        place[seen] = np.arange(len(seen))
        both = np.flatnonzero(plain[1:] & plain[:-1] & (row[1:] == row[:-1]))
        pairs, at = np.unique(w[both] * len(hashes) + w[both + 1], return_inverse=True)
        first, second = np.divmod(pairs, len(hashes))
        odd = [k for k in np.flatnonzero(~plain) if w[k] in self.inner]
        inner, at_inner = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.array(self.inner[w[k]], np.uint64) for k in odd]]), return_inverse=True)
        distinct = np.concatenate([hashes[seen], _mixed(hashes[first] * np.uint64(0x9E3779B97F4A7C15) + hashes[second]), inner]).view(np.int64)
        of_inner = np.repeat(row[odd], [len(self.inner[w[k]]) for k in odd]) if odd else row[:0]
        rows = np.concatenate([row[plain], row[both], of_inner])
        cols = np.concatenate([place[single], len(seen) + at, len(seen) + len(pairs) + at_inner])
        key = np.sort(rows * len(distinct) + cols)
        return distinct, *np.divmod(key[np.r_[True, key[1:] != key[:-1]]], len(distinct))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sentences_of(text: str | None) -> Iterator[list[str]]:
    """Each sentence as its folded words; fragments too short to say anything are left out."""
    words = Words()
    w, row, _ = words.sentences([text or ""])
    names = {n: word for word, n in reversed(words.items())}
    for k in range(int(row[-1]) + 1 if len(row) else 0):
        yield [names[n] for n in w[row == k]]


def terms_of(words_said: list[str]) -> set[int]:
    """Hashes of the terms of one sentence, given as its words."""
    words = Words()
    w = np.array([words[x] for x in words_said], np.int64)
    return set(words.terms(w, np.zeros(len(w), np.int64))[0].tolist())
