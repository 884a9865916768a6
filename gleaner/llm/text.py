"""Text folding shared by the text operators: markup, accents, look-alikes and words."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters that look like, or stand for, a Latin letter, each followed by it.
LOOKALIKES = {
    ord(p[0]): p[1:]
    for p in (
        "аa вb сc ԁd еe ґr һh іi јj кk ӏl мm нh оo рp ԛq ѕs тt уy ԝw хx "
        "αa εe ιi κk νv οo ρp ςσ τt υu χx ωw ıi łl øo đd ɡg ɑa ʏy ßss æae œoe"
    ).split()
}
#: Characters of no width and the soft hyphen.
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\u180e\ufe00-\ufe0f]")
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|mark|code|small|sub|sup|font|a)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<[/!]?[a-zA-Z][^<>]*>")
_HYPHENATED = re.compile(r"(?<=[^\W\d_])[-\u2010\u2011]\s*\r?\n[\s>|*]*(?=[^\W\d_])")
_EMPHASIS = re.compile(r"[*`~]+")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower-case text without accents, look-alikes, compatibility forms and invisible characters."""
    text = unicodedata.normalize("NFKD", INVISIBLE.sub("", text))
    text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    return text.lower().translate(LOOKALIKES)


def unmark(text: str) -> str:
    """Text without tags, entities, signs of emphasis and the hyphens of line breaks."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "\n" in text:
        text = _HYPHENATED.sub("", text)
    return _EMPHASIS.sub("", text)


def words(text: str) -> list[str]:
    return _WORD.findall(fold(unmark(text)))


_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def located_words(text: str) -> list[tuple[str, int, int]]:
    """words(text), each with the place in the text itself where it begins and ends."""
    at = list(range(len(text)))

    def swap(pattern: re.Pattern, new) -> None:
        nonlocal text, at
        parts, places, last = [], [], 0
        for m in pattern.finditer(text):
            value = new(m.group())
            parts += [text[last : m.start()], value]
            places += at[last : m.start()] + [at[m.start()]] * len(value)
            last = m.end()
        text, at = "".join([*parts, text[last:]]), places + at[last:]

    swap(_ENTITY, html.unescape)
    for pattern, value in ((_INLINE, ""), (_TAG, " "), (_HYPHENATED, ""), (_EMPHASIS, "")):
        swap(pattern, lambda _, value=value: value)
    folded = [fold(c) for c in text]
    places = [place for c, place in zip(folded, at) for _ in c]
    return [(m.group(), places[m.start()], places[m.end() - 1] + 1) for m in _WORD.finditer("".join(folded))]


def edits(a: str, b: str) -> int:
    """Edit distance with transpositions of neighbours (each substring edited once)."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]
