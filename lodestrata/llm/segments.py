"""Texts as segments: prose and data on one side, list items, links and tags on the other.

A plain scanner that the list-density evidence rests on. It knows no words:
which words join sentences and which endings name hosts is learned from the
corpus (``spam.connectives``, ``spam.endings``) and handed in. It keeps no
state between texts, takes every text whole, and tests every piece of a text
alike, whatever its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Set
from functools import lru_cache

from lodestrata.functions.shipping import ship

ship(__name__)

#: Letters and figures that stand for Latin letters they look like.
LOOKALIKES = str.maketrans("авекмнорстухіјѕ", "abekmhopctyxijs")
FIGURES = str.maketrans("03", "oe")

FULL = re.compile(r"(?:https?://|www\.)[^\s<>()\[\]\"']+", re.I)
BARE = re.compile(r"(?<![\w@./-])(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+([a-z]{2,})\b(?:/[^\s<>()\[\]\"']*)?", re.I)
HREF = re.compile(r"href=[\"']?([^\"'> ]+)")
MARKUP = re.compile(r"</?[a-zA-Z!][^<>]*>")
BREAK = re.compile("[\r\n\x0b\x0c\x85\u2028\u2029]+|<br\\s*/?>|</(?:li|p|h\\d|div|td|tr)>", re.I)
HIDDEN = re.compile("(?<=\\s)[\u200b\u2060]+|[\u200b\u2060]+(?=\\s)")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
SPLIT = re.compile(r"[•·|;,:\t►»★✓]+|\s[-–—/*+]\s|->")
BULLET = re.compile(r"^(?:[-*+>•·]+|\d+[.)]|\[\d+\])\s+|^#{1,6}\s+")
BRACKETS = re.compile(r"[\[\]()<>]+")
TRIM = " .:!?\"'*-\u2013\u2014[]()<>#"
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
PLAIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*0?|0")
FIGURE = re.compile("[0-9]")
ODD = re.compile(r"\d|[\u0400-\u04ff]")
HEXED = re.compile(r"[0-9a-f]+|[^\W\d_]\d+")
MIXED = re.compile(r"(?<![124-9])[03](?=[^\W\d_])|[^\W\d_][03]{2,}$")
NUMBER = re.compile(r"(?<!\w)(?!\d{4}\b)\d+\b")
RUN = re.compile(r"\d+")
CODE = re.compile(r"[{}=_\\@^~`]|::|//|/\*|\b0x[0-9a-f]+|\+0x|\b(?=[0-9A-Fa-f]*\d)[0-9A-Fa-f]{8}\b|\w\(|\|-|--", re.I)
ROW = re.compile(r"^\s*[\"'{}\[\]|]")
PRICE = re.compile(r"(?:\b[A-Z]{3}|[$€£¥])\s?\d+[.,]\d\d\b|[★☆]{2,}")
HASHTAG = re.compile(r"#[^\W\d_]\w{2,}")


def weight(text: str) -> int:
    """Characters that are no blanks."""
    return len("".join(text.split()))


def folded(text: str) -> list[str]:
    """The words of a text in lower case, look-alikes as the letters they stand for (0 and 3 only before a letter or doubled at the end), other figures as 0."""
    words = WORD.findall(text.lower())
    return words if text.isascii() and not FIGURE.search(text) else list(map(spelled, words))


@lru_cache(maxsize=100_000)
def spelled(word: str) -> str:
    if not ODD.search(word):
        return word
    word = word.translate(LOOKALIKES)
    if not HEXED.fullmatch(word) and MIXED.search(word):
        word = word.translate(FIGURES)
    return RUN.sub("0", word)


def links_of(line: str, endings: Set[str]) -> list[str]:
    """Links in a line: full ones, and bare hosts whose last label ends hosts elsewhere in the corpus."""
    found = FULL.findall(line)
    if "." in line:
        rest = FULL.sub(" ", line) if found else line
        found += [m.group() for m in BARE.finditer(rest) if m.group(1).lower() in endings]
    return found


def link_phrase(link: str) -> str:
    """A link without its host, as words."""
    return "§ " + " ".join(folded(re.sub(r"^(?:https?://)?[^/?#]*", "", link, flags=re.I)))


def listing(parts: list[str], connectives: Set[str], found: list) -> int:
    """Parts of a list go to ``found`` as items where they are plain words; the weight of the others."""
    told = 0
    for p in parts:
        p = p.strip(TRIM)
        own = folded(p)
        if not own:
            continue
        plain = sum(PLAIN.fullmatch(w) is not None for w in own) - len(NUMBER.findall(p))
        joined = sum(map(connectives.__contains__, own))
        if 10 * plain >= 9 * len(own) and 2 * joined <= len(own) and 10 * len(own) >= 9 * len(p.split()):
            found.append(("item", " ".join(own), weight(p)))
        else:
            told += weight(p)
    return told


def scan(text: str, connectives: Set[str], endings: Set[str]) -> tuple[int, list[tuple[str, str, int]]]:
    """(weight of prose and data, segments); a segment is (kind, phrase, weight).

    Kinds: ``link`` (bare links), ``tag`` (hashtags, priced lines), ``stuffed``
    (sentences that press one word of the page), ``item`` (plain words without
    a sentence).
    """
    text = text.replace("\u00a0", " ")
    if not text.isascii():
        text = INVISIBLE.sub("", HIDDEN.sub("\u2022", text))
    counts = Counter(folded(text))
    least = max(6, 0.06 * counts.total())
    pressed = {w for w, n in counts.items() if n >= least and len(w) > 2 and w not in connectives and w != "0"}
    told, found = 0, []
    for line in BREAK.split(text):
        line = line.strip()
        if not line:
            continue
        hidden = []
        if "<" in line:
            hidden = HREF.findall(line)
            line = MARKUP.sub(" ", line)
        links = links_of(line, endings)
        bare = line
        for link in links:
            bare = bare.replace(link, " ", 1)
        links += hidden
        if links:
            bare = BRACKETS.sub(" ", bare)
        bare = BULLET.sub("", bare.strip())
        before = told
        if not links and ROW.search(bare):
            told += weight(bare)
            continue
        if bare.count("#") >= 3 and len(tags := HASHTAG.findall(bare)) >= 3:
            found.extend(("tag", " ".join(folded(t)), len(t)) for t in tags)
            bare = HASHTAG.sub(" ", bare)
        for piece in SENTENCE.split(bare):
            own = folded(piece)
            if not own:
                continue
            n, marks = len(own), len(CODE.findall(piece))
            joined = sum(map(connectives.__contains__, own)) / n
            parts = SPLIT.split(piece)
            listed = len(parts) >= 5 and n <= 6 * len(parts)
            press = max(map(own.count, pressed), default=0) if pressed else 0
            if marks * 8 >= n:
                told += weight(piece)
            elif listed and joined < 0.5:
                told += listing(parts, connectives, found)
            elif PRICE.search(piece) and joined < 0.25:
                found.append(("tag", " ".join(own), weight(piece)))
            elif press >= 2 and press >= 0.16 * n:
                found.append(("stuffed", " ".join(own), weight(piece)))
            elif (joined >= 0.25 and n >= 4) or (n >= 5 and joined >= 0.1 and piece.rstrip()[-1] in ".!?" and piece.lstrip()[0].isupper()):
                told += weight(piece)
            else:
                told += listing(parts, connectives, found)
        # A link that the line says something about is told, not bare.
        if links:
            if told - before >= 20:
                told += sum(map(weight, links))
            else:
                found.extend(("link", link_phrase(x), weight(x)) for x in links)
    return told, found
