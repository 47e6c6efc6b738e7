"""Words of a text, the same however it is cased, spaced, punctuated, marked up or disguised."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

#: Letters of other scripts that look like Latin ones, and the Latin ones.
LOOKALIKES = str.maketrans(
    "авеёзіјкмнорсԁѕтухһԛԝѵցսոօαβεηικμνορτυχωıɡɑℓ",
    "abee3ijkmhopcdstyxhqwvgunoabenikmvoptuxwigal",
)
#: Tags that may stand inside a word; others end one.
INLINE = regex.compile(r"</?(?:a|abbr|b|code|del|em|font|i|ins|mark|s|small|span|strong|sub|sup|u)(?:\s[^<>]{0,300})?>", regex.I)
TAG = regex.compile(r"</?[a-z!][^<>]{0,300}>", regex.I)
#: A hyphen at the end of a line, with what quoting or lists put before the next one.
HYPHEN = regex.compile(r"[-‐‑­][ \t]*\r?\n[ \t>*•#|]*")
ESCAPED = regex.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt]")
#: Invisible characters: formats, marks on letters, halves of characters, controls that aren't white space. Those of the first 65,536 code points are one
#: table, which is searched fast.
HIDDEN_ANY = regex.compile(r"(?:[\p{Cf}\p{Mn}\p{Me}\p{Cs}]|(?![\s\x1c-\x1f])\p{Cc})+")
HIDDEN = re.compile("[" + re.escape("".join(c for c in map(chr, range(0x10000)) if HIDDEN_ANY.match(c))) + "]+")
BEYOND = re.compile("[\U00010000-\U0010ffff]+")
WORD = regex.compile(r"[^\W_]+")


def unescaped(m: regex.Match) -> str:
    return chr(int(m[1], 16)) if m[1] else " "


def visible(text: str) -> str:
    """The text without invisible characters."""
    return HIDDEN.sub("", text if text.isascii() else BEYOND.sub(lambda m: HIDDEN_ANY.sub("", m[0]), text))


def fold(text: str) -> str:
    """Lower-case plain text: markup, invisible characters, accents and line-end hyphens removed, look-alike letters replaced."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", INLINE.sub("", text))
    if "\\" in text:
        text = ESCAPED.sub(unescaped, text)
    text = HYPHEN.sub("", text)
    if text.isascii():
        return visible(text).lower() if not text.isprintable() else text.lower()
    return visible(unicodedata.normalize("NFKD", text)).lower().translate(LOOKALIKES)


#: What ends a text where several are folded as one string; in a text it counts as white space.
TEXT_END = "\x1d"
_TAG_INSIDE = re.compile(r"</?[a-z!][^<>\x1d]{0,300}>", re.I)
_INLINE_INSIDE = re.compile(INLINE.pattern.replace("[^<>]", "[^<>\x1d]"), re.I)


def folded(texts: list[str]) -> str:
    """Many texts as fold leaves them, each ended by TEXT_END; look-alike letters are left to replace_lookalikes."""
    if any(TEXT_END in t for t in texts):
        texts = [t.replace(TEXT_END, " ") for t in texts]
    text = TEXT_END.join([*texts, ""])
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG_INSIDE.sub(" ", _INLINE_INSIDE.sub("", text))
    if "\\" in text:
        text = ESCAPED.sub(unescaped, text)
    text = HYPHEN.sub("", text)
    return visible(text if text.isascii() else unicodedata.normalize("NFKD", text)).lower()


def replace_lookalikes(word: str) -> str:
    return word if word.isascii() else word.translate(LOOKALIKES)


def words_of(text: str | None) -> list[str]:
    """The words of a text (letters and digits in a row) after folding; none for a null."""
    return WORD.findall(fold(text)) if text else []


def counted_words(text: str | None) -> tuple[list[str], list[int]]:
    """Words, and for each the number of the word between white space that it belongs to ('12:36' is one of two)."""
    words, of = [], []
    for k, chunk in enumerate(fold(text or "").split()):
        for w in WORD.findall(chunk):
            words.append(w)
            of.append(k)
    return words, of
