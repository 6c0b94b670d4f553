"""Personal data in texts, disguises included, as spans of the original characters.

Base detection scans the text itself.  For disguises a chain of transducers
rewrites the text (look-alike letters and digits, invisible characters, spelled
digits, "at" and "dot"); every rewritten character remembers which source
characters it stands for, detection runs again on the rewritten text, and what
it finds is mapped back to source spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from flowloom.llm.frames import map_texts, pick

KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterable[tuple[int, int]]:
    free = 0  # matches don't overlap: the next begins here at the earliest
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and _LOCAL_END.match(text, begin - 1):
            begin -= 1
        if begin < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield begin, free
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterable[tuple[int, int]]:
    """Four parts of a dotted chain of numbers at a time; failing ones are dropped, not retried."""
    for chain in _DOTTED.finditer(text):
        parts = chain.group().split(".")
        begin = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield begin, end
            begin = end + 1


def cards(text: str) -> Iterable[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterable[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


_DETECTORS = (emails, ips, cards, phones)


def base_spans(text: str) -> list[Span]:
    """What the text shows openly, by start, then kind."""
    return sorted(Span(b, k, e) for k, detect in enumerate(_DETECTORS) for b, e in detect(text))


# --- transducers -----------------------------------------------------------

# Letters and digits that look like ASCII ones.
_LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3", "б": "6",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "–": "-", "․": ".", "。": ".",
    "﹫": "@", "．": ".", " ": " ", " ": " ", " ": " ",
}
_INVISIBLE = "­​‌‍⁠﻿"
# Full-width forms and mathematical digits follow ASCII in blocks.
_LOOK_ALIKES |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
_LOOK_ALIKES |= {chr(0x1D7CE + k): str(k % 10) for k in range(50)}
_LOOK_ALIKES |= dict.fromkeys(_INVISIBLE, "")
_ODD = re.compile("[" + "".join(map(re.escape, _LOOK_ALIKES)) + "]")

# Spelled digits, and words for the two signs of an address.
_DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_AT_WORDS = ("at", "arobase", "arroba", "ät")
_DOT_WORDS = ("dot", "punkt", "point", "punto")

_SPELLED = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
# Only a run of spelled digits is a number; a single word is prose.
_SPELLED_RUN = re.compile(
    rf"(?<!\w)(?:(?:{_SPELLED})|(?<!\w)[0-9])(?:(?:[ ,-]{{1,2}}|[ ]?[.()]{{1,2}}[ ]?)(?:(?:{_SPELLED})(?!\w)|[0-9](?![0-9]))){{3,}}", re.I
)
_DIGIT_WORD = re.compile(rf"(?<!\w)(?:{_SPELLED})(?!\w)", re.I)
_JOINT = re.compile(r"(?<=[0-9])(?:[ ]?[,.-][ ]?|[ ]+)(?=[0-9])")
_PLUS_WORD = re.compile(r"(?<!\w)plus[ ](?=[0-9])", re.I)

_at, _dot = "|".join(_AT_WORDS), "|".join(_DOT_WORDS)
_BRACKETED_AT = re.compile(rf"\s?[\[({{<]\s?(?:{_at}|@)\s?[\])}}>]\s?", re.I)
_BRACKETED_DOT = re.compile(rf"\s?[\[({{<]\s?(?:{_dot}|\.)\s?[\])}}>]\s?", re.I)
# In plain words both signs must be spelled, or one of them be there already.
_SPELLED_ADDRESS = re.compile(
    rf"(?<![\w.%+-])[a-z0-9_%+-]+(?:(?:\.|[ ](?:{_dot})[ ])[a-z0-9_%+-]+)*(?:[ ](?:{_at})[ ]|[ ]?@[ ]?)"
    rf"[a-z0-9-]+(?:(?:[ ](?:{_dot})[ ]|[ ]?\.(?=[a-z0-9]))[a-z0-9-]+)+(?![\w-])", re.I
)
_PLAIN_AT = re.compile(rf"[ ](?:{_at})[ ]|[ ]?@[ ]?", re.I)
_PLAIN_DOT = re.compile(rf"[ ](?:{_dot})[ ]|[ ]?\.", re.I)
_SPOKEN_DOT = re.compile(rf"[ ](?:{_dot})[ ]", re.I)
_DOT_WORD_BETWEEN = re.compile(rf"(?<=[0-9])\s(?:{_dot})\s(?=[0-9])", re.I)
_BRACKETED = re.compile(rf"[\[({{<]\s?(?:{_at}|{_dot}|[@.])\s?[\])}}>]", re.I)
# Words after a spoken "at" that make it prose.
_PROSE_AFTER_AT = ("the", "a", "an", "this", "that", "our", "your", "my", "its", "their", "his", "her")
_PROSE_AT = re.compile(rf"[ ](?:{_at})[ ](?:{'|'.join(_PROSE_AFTER_AT)})[ ]", re.I)
# A spelled "at" before a written domain, and what shows a name in front of it.
_AT_DOMAIN = re.compile(rf"[ ](?:{_at})[ ][a-z0-9-]+\.[a-z0-9]", re.I)
_NAME = re.compile(r"(?=.*[a-z])(?=.*[._0-9])", re.I)
_NAMED_TOP = re.compile(r"\.[a-z]{2,}$", re.I)
_DASHES = str.maketrans({c: " " for c in "-,.;:()[]{}<>\n\t"})
# "un" is an article far more often than a digit and starts no search by itself.
_TELLING_DIGITS = frozenset(_DIGIT_WORDS) - {"un"}


def hints(text: str) -> tuple[bool, bool, bool]:
    """Cheap signs of look-alike characters, of disguised addresses, and of spelled digits."""
    words = set(text.lower().translate(_DASHES).split())
    signs = not words.isdisjoint(_DOT_WORDS) or " @" in text or "@ " in text or _BRACKETED.search(text) is not None
    signs = signs or (not words.isdisjoint(_AT_WORDS) and _AT_DOMAIN.search(text) is not None)
    odd = not text.isascii() and _ODD.search(text) is not None
    return odd, signs, not words.isdisjoint(_TELLING_DIGITS)


class View:
    """A rewritten text; each character knows the source span it stands for."""

    def __init__(self, text: str, begins: np.ndarray | None = None, ends: np.ndarray | None = None) -> None:
        self.text = text
        self.begins = np.arange(len(text)) if begins is None else begins
        self.ends = np.arange(1, len(text) + 1) if ends is None else ends

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> "View":
        """Replace disjoint ascending spans; a replacement stands for its whole span."""
        texts, begins, ends, done = [], [], [], 0
        for start, end, new in edits:
            texts += [self.text[done:start], new]
            begins += [self.begins[done:start], np.full(len(new), self.begins[start])]
            ends += [self.ends[done:start], np.full(len(new), self.ends[end - 1])]
            done = end
        if not texts:
            return self
        texts.append(self.text[done:])
        return View(
            "".join(texts), np.concatenate([*begins, self.begins[done:]]), np.concatenate([*ends, self.ends[done:]])
        )

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.begins[start]), int(self.ends[end - 1])


def unmask(view: View) -> View:
    """Look-alike characters to ASCII; invisible ones vanish."""
    return view.rewrite((m.start(), m.end(), _LOOK_ALIKES[m.group()]) for m in _ODD.finditer(view.text))


def _is_address(found: str) -> bool:
    """Whether what reads as an address in words is one.

    "meet at x.com" is prose: a spelled "at" needs a spelled "dot" with it, or a
    name that no plain word is, with a dot, digit or underscore.
    """
    if "@" in found:
        return True
    if _PROSE_AT.search(found):
        return False
    name = _PLAIN_AT.split(found, maxsplit=1)[0]
    return _SPOKEN_DOT.search(found) is not None or (_NAME.match(name) is not None and _NAMED_TOP.search(found) is not None)


def join_signs(view: View) -> View:
    """"(at)", "[dot]" and addresses in words to their signs."""
    view = view.rewrite((m.start(), m.end(), "@") for m in _BRACKETED_AT.finditer(view.text))
    view = view.rewrite((m.start(), m.end(), ".") for m in _BRACKETED_DOT.finditer(view.text))
    view = view.rewrite((m.start(), m.end(), ".") for m in _DOT_WORD_BETWEEN.finditer(view.text))
    edits = []
    for m in _SPELLED_ADDRESS.finditer(view.text):
        found = m.group()
        if not _is_address(found):
            continue
        signs = [(a.start(), a.end(), "@") for a in _PLAIN_AT.finditer(found)]
        signs += [(d.start(), d.end(), ".") for d in _PLAIN_DOT.finditer(found)]
        edits += [(m.start() + b, m.start() + e, s) for b, e, s in sorted(signs)]
    return view.rewrite(edits)


def read_digits(view: View) -> View:
    """Runs of spelled digits to numerals written together."""
    edits = []
    for run in _SPELLED_RUN.finditer(view.text):
        if not _DIGIT_WORD.search(run.group()):
            continue
        edits += [(run.start() + w.start(), run.start() + w.end(), _DIGIT_WORDS[w.group().lower()]) for w in _DIGIT_WORD.finditer(run.group())]
    if not edits:
        return view
    view = view.rewrite(edits)
    return view.rewrite((m.start(), m.end(), "+") for m in _PLUS_WORD.finditer(view.text))


def tighten(view: View) -> View:
    """Numerals apart by one separator written together, for cards and phones only."""
    return view.rewrite((m.start(), m.end(), "") for m in _JOINT.finditer(view.text))


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that show only after rewriting, as source spans apart from the base ones."""
    odd, signs, spelled = hints(text)
    if not (odd or signs or spelled):
        return []
    view = View(text)
    if odd:
        view = unmask(view)
    if spelled or odd:
        view = read_digits(view)
    if signs or odd:
        view = join_signs(view)
    passes = [(view, _DETECTORS)]
    if spelled or odd:
        passes.append((tighten(view), (None, None, cards, phones)))
    taken = list(base)
    for seen, detectors in passes:
        for kind, detect in enumerate(detectors):
            for b, e in detect(seen.text) if detect else ():
                start, end = seen.source(b, e)
                if end - start == e - b and text[start:end] == seen.text[b:e]:
                    continue  # nothing in it was disguised, so the base pass has judged it
                if all(end <= t.start or t.end <= start for t in taken):
                    taken.append(Span(start, kind, end))
    return taken[len(base) :]


def find_private(docs: DataFrame, hidden: bool = True, masked: bool = True) -> DataFrame:
    """Per document: base counts, the hash of the base spans, all spans, and on demand the masked text.

    Takes ``doc_id`` and ``text``; other columns are left out.  Null and empty
    texts have no spans (the hash is that of the empty string).  ``spans`` holds
    ``kind:start:end`` in code points, by start, then kind, comma-joined; base ones
    always stay, disguised ones are added where they overlap none of them.
    ``n_hidden`` counts the added ones; the first four count base spans.  Equal
    rows and null ids are treated one by one.  A map over rows: no shuffle.
    """

    def prepare():
        def work(texts):
            out = [[] for _ in range(8 if masked else 7)]
            for text in texts:
                base = base_spans(text)
                added = hidden_spans(text, base) if hidden else []
                everything = sorted(base + added)
                for kind in range(len(KINDS)):
                    out[kind].append(sum(s.kind == kind for s in base))
                out[4].append(hashlib.sha256(",".join(map(str, base)).encode()).hexdigest())
                out[5].append(",".join(map(str, everything)))
                out[6].append(len(added))
                if masked:
                    out[7].append(mask(text, everything))
            return out

        return work

    added = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_hidden long"
    added += ", masked string" if masked else ""
    return map_texts(pick(docs, "doc_id", "text"), "text", added, prepare)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans by that of the first."""
    parts, done = [], 0
    for s in spans:
        if s.end <= done:
            continue
        parts += [text[done : max(s.start, done)], f"<{KINDS[s.kind]}>"] if s.start >= done else []
        done = s.end
    return "".join([*parts, text[done:]])
