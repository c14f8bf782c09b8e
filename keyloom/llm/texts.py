"""Words of a text without what does not count: case, punctuation, spacing, accents, Unicode form."""

from __future__ import annotations

import html
import re
import unicodedata

#: A CJK character is a word of its own, as these scripts set no blanks.
_WORD = re.compile(r"[぀-ヿ㐀-䶿一-鿿]|[^\W_぀-ヿ㐀-䶿一-鿿]+")


#: Combining marks of the Latin, Greek and Cyrillic scripts; soft hyphens, zero-width and direction marks, variation selectors.
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]+")


def fold(text: str) -> str:
    """Case, accents, invisible characters and Unicode form removed."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", text).casefold())


def words(text: str | None) -> list[str]:
    """The folded words in order; none for null."""
    return _WORD.findall(fold(text)) if text else []


_MARKUP = re.compile(r"<!--.*?-->|<[a-zA-Z/!][^<>]{0,500}>", re.S)
_ENTITY = re.compile(r"&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]{0,40});?")


def plain_words(text: str | None) -> list[str]:
    """The words of a text without markup, line marks and invisible characters."""
    if not text:
        return []
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
        if "<" in text:
            text = _MARKUP.sub(" ", text)
    return words(text)


def plain_word_spans(text: str) -> list[tuple[int, int]]:
    """Where each of plain_words lies in the text as it is: first character and the one after the last."""
    blank = lambda m: " " * len(m.group())
    text = _MARKUP.sub(blank, text)
    chars: list[str] = []
    where: list[tuple[int, int]] = []
    at = 0
    for m in [*_ENTITY.finditer(text), None]:
        end = m.start() if m else len(text)
        chars += text[at:end]
        where += [(i, i + 1) for i in range(at, end)]
        if m:
            one = html.unescape(m.group())
            chars += one
            where += [m.span()] * len(one)
            at = m.end()
    plain = _MARKUP.sub(blank, "".join(chars))
    folded: list[str] = []
    source: list[int] = []
    for i, c in enumerate(plain):
        f = c.lower() if c.isascii() else fold(c)
        folded.append(f)
        source += [i] * len(f)
    return [(where[source[m.start()]][0], where[source[m.end() - 1]][1]) for m in _WORD.finditer("".join(folded))]
