"""Text that was decoded with a wrong encoding: finding it, and undoing it where that is possible.

Method: best-first search. A node is a spelling of one passage (a run of non-ASCII characters and
character references); an edge encodes it in one encoding and decodes the bytes in another, or resolves
character references, or decodes bytes of which some were lost: traces of these become a character that
stands for an unknown one. A visited set of spellings keeps the graph finite. A plausibility cost of the
characters and of their neighbours, in which such traces weigh much, guides the search; the cheapest
spelling reached, counting the steps, is the restoration, unknown characters being written as the traces
they were read from. A passage is garbled if that spelling lies behind a decoding.

The search ends when no node left can lead to a cheaper spelling: each step costs something and no
spelling costs less than nothing. Decoding and resolving make a spelling shorter, so it does end.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from tallyflow.sources.tables import spread

#: A passage: non-ASCII characters and character references that touch.
PASSAGE = re.compile(r"(?:[^\x00-\x7f]|&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)+")
#: Encodings as which UTF-8 bytes were read one by one; the first one stands for cp1252 and Latin-1.
SINGLE_BYTE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp866", "koi8_r")
#: Encodings that read two bytes at a time, and pairs of single-byte encodings, tried on whole passages.
WHOLE = (("gb18030", "utf-8"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1251", "koi8_r"), ("cp1251", "cp866"))
STEP_COST, UNCOVERED_COST, LEAST_GAIN = 0.5, 1.2, 0.8
#: A trace of lost bytes, the step that reads it as an unknown character, and such a character.
TRACE_COST, LOSSY_COST, UNKNOWN_COST = 6.0, 1.0, 2.0
#: A Cyrillic or Greek letter at the edge of a passage right beside an ASCII letter.
GLUED_COST = 0.6
#: Unknown characters: code points that never stand for a character.
UNKNOWN = tuple(map(chr, range(0xFDD0, 0xFDF0)))

_COMMON_LOWER = set("àâäáãåæçéèêëíìîïñóòôöõøúùûüýÿßœ")
_PUNCTUATION = set("‘’“”„‚–—…«»¿¡‹›†‡•·‰")
_SYMBOLS = set("€£¥¢§°±×÷²³¹½¼¾µªº™©®¶≤≥≈≠∞∑∏√∫∂→←↑↓⇒∈−¬")
_FORMAT = set("\xa0\xad​‌‍‎‏‪‫‬‭‮⁠﻿　️")


def _other_letter(ch: str, o: int) -> float:
    """Letters outside Latin, Greek and Cyrillic: common scripts cost 1, Han by how common the character is."""
    if 0x3400 <= o <= 0x9FFF:
        try:
            # The first level of the Chinese character set (lead bytes B0 to D7) holds the common ones.
            return 1.0 if ch.encode("gb2312")[0] <= 0xD7 else 1.8
        except UnicodeEncodeError:
            return 2.5
    return 1.0 if 0x590 <= o <= 0x6FF or 0x3040 <= o <= 0x30FF or 0xAC00 <= o <= 0xD7A3 or 0x900 <= o <= 0x97F or 0xE00 <= o <= 0xE7F else 3.0


@lru_cache(maxsize=100_000)
def _kind(ch: str) -> tuple[str, str, float]:
    """(class, script or case, cost) of a character."""
    o = ord(ch)
    if o < 0x80:
        return ("A", "", 0.3)
    if ch in UNKNOWN:
        return ("X", "", UNKNOWN_COST)
    if ch == "�" or 0x80 <= o <= 0x9F:
        return ("C", "", 6.0)
    if ch in _COMMON_LOWER:
        return ("L", "latin-", 1.0)
    if ch in _PUNCTUATION:
        return ("P", "", 1.0)
    if ch in _SYMBOLS:
        return ("S", "", 1.1)
    if ch in _FORMAT:
        return ("X", "", 1.5)
    if 0x2500 <= o <= 0x259F:
        return ("B", "-" if ch in "─━═" else ch, 1.0)
    category = unicodedata.category(ch)
    if category in ("Cn", "Co", "Cs"):
        return ("C", "", 8.0)
    if category[0] == "L":
        case = "+" if category == "Lu" else "-"
        if 0xC0 <= o <= 0xFF or o in (0x152, 0x178):
            return ("L", "latin" + case, 1.3)
        if o < 0x250 or 0x1E00 <= o <= 0x1EFF:
            return ("L", "latin" + case, 1.6)
        if 0x370 <= o <= 0x3FF:
            return ("L", "greek" + case, 1.0)
        if 0x400 <= o <= 0x52F:
            return ("L", "cyrillic" + case, 0.5 if 0x410 <= o <= 0x44F or o in (0x401, 0x451) else 1.8)
        return ("L", "other-", _other_letter(ch, o))
    if category[0] == "M":
        return ("M", "", 2.0)
    if 0x1F000 <= o <= 0x1FAFF or 0x2600 <= o <= 0x27BF or 0xFF00 <= o <= 0xFFEF or 0x3001 <= o <= 0x303F:
        return ("P", "", 1.0)
    return ("S", "", 1.5 if o < 0x3000 else 2.0)


def _between(a: tuple[str, str, float], b: tuple[str, str, float]) -> float:
    x, y = a[0], b[0]
    if "A" in (x, y) or "M" in (x, y):
        return 0.0
    if x == "L" and y == "L":
        if a[1][:-1] != b[1][:-1]:
            return 2.0
        if a[1][-1] == "+" and a[1] != "cyrillic+" and a[1][:5] == "latin":
            return 0.5
        return 1.5 if a[1][-1] == "-" and b[1][-1] == "+" else 0.0
    if "B" in (x, y):
        # A table has a line between its junctions.
        return 2.0 if x != y else 0.0 if a[1] == b[1] or "-" in (a[1], b[1]) else 1.2
    if {x, y} == {"L", "S"}:
        return 1.5
    if {x, y} == {"L", "X"}:
        return 1.0
    if {x, y} == {"L", "P"}:
        return 0.2 if a[1][:5] in ("other", "") and b[1][:5] in ("other", "") else 0.6
    return 0.0 if x == y == "P" else 0.7


def plausibility_cost(text: str) -> float:
    """The lower, the likelier that a person wrote these characters side by side."""
    kinds = [_kind(ch) for ch in text]
    # No language sets more than two accented Latin letters in a row as a habit.
    crowded = sum(a[1][:5] == b[1][:5] == c[1][:5] == "latin" for a, b, c in zip(kinds, kinds[1:], kinds[2:]))
    return sum(k[2] for k in kinds) + sum(map(_between, kinds, kinds[1:])) + crowded


def _reader(encoding: str) -> tuple[dict[str, int], re.Pattern[str]]:
    """Character -> byte from 0x80 on, and the pattern of UTF-8 sequences as they look in ``encoding``.

    Bytes without a character stand for the control character of the same number, as many decoders
    have it; for the first encoding these numbers are read beside its own characters.
    """
    to_byte: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            to_byte[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            to_byte.setdefault(chr(b), b)
    if encoding == SINGLE_BYTE[0]:
        for b in range(0x80, 0xA0):
            to_byte.setdefault(chr(b), b)
    chars = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in to_byte.items() if lo <= b <= hi) + "]"
    tail = chars(0x80, 0xBF)
    return to_byte, re.compile(f"{chars(0xC2, 0xDF)}{tail}|{chars(0xE0, 0xEF)}{tail}{{2}}|{chars(0xF0, 0xF4)}{tail}{{3}}")


@lru_cache(maxsize=None)
def _readers() -> tuple:
    return tuple(_reader(e) for e in SINGLE_BYTE)


def _edges(text: str) -> Iterator[tuple[str, bool, float]]:
    """(spelling reached, is it a decoding, cost of the step)."""
    for to_byte, pattern in _readers():
        covered = 0

        def undo(m: re.Match[str]) -> str:
            nonlocal covered
            try:
                new = bytes(to_byte[c] for c in m.group()).decode("utf-8")
            except UnicodeDecodeError:
                return m.group()
            covered += len(m.group())
            return new

        new = pattern.sub(undo, text)
        if covered:
            left = sum(c > "\x7f" for c in text) - covered
            yield new, True, STEP_COST + UNCOVERED_COST * left
    for source, target in WHOLE:
        try:
            new = text.encode(source).decode(target)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        # Bytes of one alphabet read in another keep their number: only longer words are convincing.
        kinds = {_kind(c)[1][:8] if _kind(c)[0] == "L" else _kind(c)[0] for c in new}
        if target == "utf-8" or len(text) >= 3 and (kinds == {"B"} or kinds == {"cyrillic"} and plausibility_cost(new) < 0.7 * len(new)):
            yield new, True, STEP_COST
    if "&" in text and (new := html.unescape(text)) != text:
        yield new, False, STEP_COST


#: Traces of lost bytes: a replacement character, a control character of 0x80 to 0x9F (but not the line
#: end 0x85 alone), an accented small letter right before a symbol it can't stand by, and repeated leads.
_LOST = re.compile("�|[\x80-\x84\x86-\x9f]|[à-ïÃÂÎÏ][¡-¦¨¬¯±´-¶¸¼-¿]|â{3}|[ÃÎÏ][à-ïÂÃ]|â€|ÅÄ(?!Ö)|Å\xa0|×[©-¿×Ø]|Ø[§-ª±-³]")
#: The same where only a lead was left: of ’ between the letters of a contraction or an elision, of a dash or a
#: sign between numbers, and of a pair of quotes around ASCII words.
_LOST_APOSTROPHE = re.compile(r"â(?<=[a-z]nâ)(?=t\b)|â(?<=[A-Za-z][a-z]â)(?=(?:s|re|ll|ve)\b)|â(?<=\bIâ)(?=(?:m|ve|ll|d)\b)|â(?:(?<=\b[cdjlmnstCDJLMNST]â)|(?<=\b[Qq]uâ))(?=[aeiouhy])|[âÂÃ](?<=[0-9].)(?=[0-9])")
_LOST_QUOTES = re.compile(r"â(?<![^\s(]â)(?=[A-Za-z0-9])[\x20-\x7e]{1,200}?(?<=[A-Za-z0-9.,!?])â(?![^\s).,;:!?])")
#: A lead as a word of its own between ASCII words; no language written in Latin letters has these words.
#: Like those above it begins with the lead, so that a text is scanned for the lead and not tried at every place.
_LONE_LEAD = re.compile(r"[âãïÂÃÎÏ](?<=[!-~]\s.)(?=\s[0-9A-Za-z])")
#: What stands before a letter that is spoken of: a word for letters, or another letter of a list.
_MENTION = re.compile(r"(?:\b(?:Zeichen|Buchstaben?|Umlaut|Vokal|letters?|characters?|symbols?|signs?|vowels?|letras?|vogal|vocal|s[ií]mbolos?|lettres?|voyelle|caract[eè]res?|car[aá]cter|lettera|carattere|буквы?|знак|символ)|(?<!\w)[^\W\d_\x00-\x7f](?:,|\s(?:und|oder|and|or|e|o|ou|et|y|og|och)))\s$", re.IGNORECASE)


def lost_leads(text: str) -> set[int]:
    """Where a letter's surroundings show it to be the lead of a character whose other bytes were lost."""
    at = {m.start() for m in _LONE_LEAD.finditer(text) if not _MENTION.search(text, max(0, m.start() - 40), m.start())}
    at.update(m.start() for m in _LOST_APOSTROPHE.finditer(text))
    for m in _LOST_QUOTES.finditer(text):
        at.update((m.start(), m.end() - 1))
    return at


def _lossy(text: str, leads: tuple[int, ...], known: list[str]) -> str | None:
    """The spelling with every trace of lost bytes read as an unknown character, which ``known`` maps back; None without traces."""
    out, last = [], 0
    spans = sorted([(m.start(), m.end()) for m in _LOST.finditer(text)] + [(k, k + 1) for k in leads])
    for a, b in spans:
        if a < last:
            continue
        trace = text[a:b]
        if trace not in known:
            if len(known) == len(UNKNOWN) or UNKNOWN[len(known)] in text:
                return None
            known.append(trace)
        out += [text[last:a], UNKNOWN[known.index(trace)]]
        last = b
    return "".join([*out, text[last:]]) if out else None


@lru_cache(maxsize=50_000)
def repair_passage(text: str, leads: tuple[int, ...] = (), glued: tuple[bool, bool] = (False, False)) -> tuple[str, bool, int, bool]:
    """(cheapest spelling, was the passage garbled, decodings undone, are bytes lost) by best-first search.

    ``leads``: the places of letters that their surroundings show to be traces (``lost_leads``); ``glued``: does an
    ASCII letter stand right before and right behind the passage?
    """

    def cost(spelling: str, marked: tuple[int, ...] = ()) -> float:
        foreign = sum(bool(beside and spelling) and _kind(spelling[k])[1][:-1] in ("cyrillic", "greek") for beside, k in zip(glued, (0, -1)))
        return plausibility_cost(spelling) + GLUED_COST * foreign + TRACE_COST * (len(_LOST.findall(spelling)) + len(marked))

    known: list[str] = []
    start = cost(text, leads)
    best, best_cost, best_steps, best_lost = text, start, 0, False
    # (estimate, tie, spelling, paid, decodings, were bytes lost on the way)
    heap = [(start, 0, text, 0.0, 0, False)]
    visited, tie = {text}, 0
    while heap:
        _, _, node, paid, steps, lost = heapq.heappop(heap)
        if paid + STEP_COST >= best_cost:
            continue
        edges = [(new, int(decoding), step, lost) for new, decoding, step in _edges(node)]
        unknown = _lossy(node, leads if node is text else (), known)
        if unknown is not None:
            edges.append((unknown, 0, LOSSY_COST, True))
        for new, decoding, step, gone in edges:
            if new in visited:
                continue
            visited.add(new)
            g, n = paid + step, steps + decoding
            total = cost(new) + g
            if (n or gone) and total < best_cost:
                best, best_cost, best_steps, best_lost = new, total, n, gone
            tie += 1
            heapq.heappush(heap, (total, tie, new, g, n, gone))
    if start - best_cost < LEAST_GAIN:
        best, best_steps, best_lost = text, 0, False
    for mark, trace in zip(UNKNOWN, known):
        best = best.replace(mark, trace) if best_lost else best
    # What can't be read otherwise at all (more kinds of traces than there are unknown characters) is lost too.
    hopeless = bool(_LOST.search(best))
    return best, bool(best_steps) or best_lost or hopeless, best_steps, best_lost or hopeless


def repair(text: str | None) -> tuple[str | None, str, int, int]:
    """(restored text, status, garbled passages, most decodings undone in one passage).

    Status: ``clean``; ``restored``; ``partial`` if some passages keep traces of lost bytes; ``lost`` if all do.
    """
    if not text or text.isascii() and "&" not in text:
        return text, "clean", 0, 0
    garbled = kept = depth = 0
    leads = lost_leads(text)

    def one(m: re.Match[str]) -> str:
        nonlocal garbled, kept, depth
        passage, at = m.group(), m.start()
        marked = tuple(k - at for k in range(at, m.end()) if k in leads) if leads else ()
        if len(passage) == 1 and not marked and not _LOST.match(passage):
            return passage
        before, behind = text[max(0, at - 1) : at], text[m.end() : m.end() + 1]
        glued = (before.isascii() and before.isalpha(), behind.isascii() and behind.isalpha())
        new, bad, steps, lost = repair_passage(passage, marked, glued)
        if bad:
            garbled += 1
            depth = max(depth, steps)
            kept += lost
            return new
        return passage

    out = PASSAGE.sub(one, text)
    status = "clean" if not garbled else "restored" if not kept else "lost" if kept == garbled else "partial"
    return out, status, garbled, depth


def repair_documents(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The garbled documents: ``key, status, passages, steps, restored``.

    Each document is read whole and by itself, so nothing is shuffled; spellings met before are looked
    up in a bounded table of the worker. Null, empty and plain ASCII texts are clean and give no row.
    """
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                new, status, n, steps = repair(t)
                if n:
                    rows.append((k, status, n, steps, new))
            yield pd.DataFrame(rows, columns=[key, "status", "passages", "steps", "restored"])

    return spread(documents.select(key, text), key).mapInPandas(run, f"{key} {kind}, status string, passages int, steps int, restored string")
