"""Finds text decoded with the wrong character encoding and restores it.

Best-first search over texts: an edge encodes a text in the encoding it may have been decoded with
and decodes it anew (or takes back an escape); texts already seen are not entered again; the queue
is ordered by a cost of how implausible the characters are, so the cheapest reachable text is found
without trying every chain. The same search runs twice. On tokens between white space, each distinct
token once per worker, the edges are UTF-8 readings and escapes: each shortens its token, so every
chain ends by itself. On pages, whose state is the tuple of their odd tokens, the edges are readings
of one single-byte encoding as another, of which one token proves little; after each of them the
tokens are searched anew, so chains of both kinds are undone in any order.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings in which UTF-8 bytes are commonly misread.
MISREAD = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859-2", "cp1253", "iso8859-7", "cp1254", "koi8-r", "cp866")
#: (misread as, was) of single-byte encodings.
SINGLE = tuple((a, b) for a in ("cp1252", "latin-1", "cp1251", "koi8-r", "cp1250") for b in ("cp1250", "iso8859-2", "cp1251", "koi8-r", "cp1253", "iso8859-7", "cp1252", "cp866") if a != b)
#: Encodings of more than one byte in which UTF-8 is misread.
WIDE = ("gbk", "shift_jis", "big5", "cp949")
#: States one search may enter: bounds its work, whatever the length of the chain.
STATES = 2_000
#: States of a page; each has up to ``len(SINGLE)`` others.
PAGES = 40
#: What a token must gain by a strict UTF-8 reading, and a page by another single-byte one: in all, or
#: less if hardly anything implausible is left.
TOKEN_GAIN, PAGE_GAIN, SURE_GAIN = 0.8, 6.0, 2.0

_USUAL = set("áàâäãåæçéèêëíìîïñóòôöõøœúùûüýßÿąćęłńóśźżčďěňřšťůžăâîșțşğıőűđ" "ÁÀÂÄÃÅÆÇÉÈÊËÍÎÏÑÓÔÖÕØŒÚÙÛÜÝĄĆĘŁŃŚŹŻČĎĚŇŘŠŤŮŽĂȘȚŞĞİŐŰĐ")
#: Letters beside a to z of alphabets, each of one or of a few languages.
_ALPHABETS = [set(x) for x in "áâàãçéêíóôõúü áéíóúñü àâæçéèêëîïôœùûüÿ äöüßé åäöæøé ąćęłńóśźż áčďéěíňóřšťúůýž áéíóöőúüű ăâîșțşţ çğıöşüİâ čćđšž".split()]
#: Letters of Russian by how often they occur; the rank gives the cost.
_RUSSIAN = {c: i / 24 for i, c in enumerate("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё")}
_RUSSIAN["ё"] = 0.5
#: Greek letters likewise.
_GREEK = {c: i / 22 for i, c in enumerate("αοιετνσηρπκυςλμδγθωχφβξζψ")} | dict.fromkeys("όάίέήύώ", 0.3) | dict.fromkeys("ϊϋΐΰ", 1.4)
#: Letters of other scripts that may stand before Latin ones: in units and names of quantities, or taken for a Latin letter.
_BEFORE = set("μΔΩλσπθφωαβγδετ")
#: What the first byte of a letter or sign in UTF-8 is usually taken for.
_LEADS = set("ÂÃÎÏÐÑĂ")
_LIKE = set("асеорхуіѕјһАВЕКМНОРСТХІЅЈ")
_OPEN = set("“”‘’„‚«»‹›—–…-'\"()[]{}.,;:!?/")


def _tables() -> tuple[dict[str, dict[int, int]], dict[str, list[str]]]:
    """Byte of each character and character of each byte; bytes an encoding leaves open stand for
    the control characters of the same number, as lenient decoders have it."""
    to, back = {}, {}
    for name in {*MISREAD, *(x for p in SINGLE for x in p)}:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                chars.append(chr(b))
        back[name] = chars
        to[name] = {ord(c): b for b, c in reversed(list(enumerate(chars)))}
    return to, back


_TO, _BACK = _tables()


def _encode(text: str, name: str) -> bytes | None:
    table = _TO[name]
    try:
        return bytes([table[ord(c)] for c in text])
    except KeyError:
        return None


def cost(text: str) -> float:
    """How implausible the characters of a token are; plain ASCII costs nothing."""
    total, n = 0.0, len(text)
    for i, c in enumerate(text):
        o = ord(c)
        if o < 128:
            continue
        before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < n else " "
        if o < 0xA0 or c == "�" or 0xE000 <= o < 0xF900:
            total += 4
        elif c.isalpha():
            low = c.lower()
            if c in _LIKE and (before + after).isascii() and (before + after).strip():
                total += 0.3  # another fault, not a wrong encoding
                continue
            if c in _USUAL:
                total += 0.5
            elif low in _RUSSIAN:
                total += _RUSSIAN[low]
            elif low in _GREEK:
                total += _GREEK[low]
            elif c in "ªº":
                total += 2 if before.isalpha() or after.isalpha() else 0.5
            else:
                total += 1.3 if o < 0x530 else 2.0
            if c.isupper():
                total += 1.5 if before.islower() else 0.15 if before.isupper() else 0
            # letters of two scripts side by side
            if before.isalpha() and (ord(before) >= 0x370) != (o >= 0x370) and before not in "µ":
                total += 0.8
            # nor does a word begin with a letter of another script, but for signs of units and look-alikes
            if not before.isalpha() and after.isascii() and after.isalpha() and o >= 0x370 and c not in _BEFORE:
                total += 0.8
        elif c in _OPEN or c in "’":
            quote = c in "“”„‚«»‹›" and before.isalpha() and after.isalpha()
            total += 0.1 if not (quote or c in "‚„" and before.isalnum() or o > 127 and c != "’" and before in _LEADS) else 1.5
        elif c in "²³" and before.isascii() and not after.isalpha() or c == "°" and not before.isalpha() and after in "CF":
            total += 0.05
        elif c in "°€£§©®™±×²³¹·":
            total += 0.3 if before not in _LEADS and not (before.isalpha() and after.isalpha()) and not (c in "©®§£¹·" and before.isalpha()) and not (c in "¹²³" and after.isalpha()) else 2.5
        elif c in "­​‌‍⁠﻿     　" or 0xFB00 <= o <= 0xFB06 or o >= 0xFF00:
            total += 0.2
        elif c in "¬‐" and before.isalpha() and after == " ":
            total += 0.2  # joins a word broken over the line end
        elif 0x300 <= o < 0x370:
            total += 0.8
        elif c in "¡¿":
            total += 0.3 if not before.isalpha() and after.isalpha() else 2.5
        else:
            total += 2 if before.isalpha() or after.isalpha() else 1.2
    return total


_ESCAPE = re.compile(r"&(?:#\d{2,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{2,8}\d?);|\\u[0-9a-fA-F]{4}")
_BYTES = re.compile(r"\\u([0-9a-fA-F]{4})")


def _unescape(text: str) -> str:
    return _BYTES.sub(lambda m: chr(int(m.group(1), 16)), html.unescape(text))


def search(start, cost, edges, states: int = STATES):
    """(cheapest state reachable, edges to it): best-first over ``edges(state)``, which gives (edge, state)
    pairs, no state twice; at most ``states`` are entered."""
    heap, seen, n = [(cost(start), 0, start, ())], {start}, 0
    best = (heap[0][0], start, ())
    while heap:
        c, _, t, way = heapq.heappop(heap)
        if c < best[0]:
            best = (c, t, way)
        if c == 0 or len(seen) >= states:
            break
        for edge, u in edges(t):
            if u not in seen:
                seen.add(u)
                n += 1
                heapq.heappush(heap, (cost(u) + 0.1 * (len(way) + 1), n, u, (*way, edge)))
    return best[1], best[2]


def _escaped(text: str) -> float:
    """Cost of a token, signs written as escapes included."""
    return cost(text) + 2.0 * len([m for m in _ESCAPE.findall(text) if not _unescape(m).isascii()])


def _readings(text: str) -> Iterator[tuple[str, str]]:
    if _ESCAPE.search(text):
        yield "unescape", _unescape(text)
    if text.isascii():
        return
    for name in MISREAD:
        raw = _encode(text, name)
        if raw is not None:
            try:
                yield f"{name}>utf-8", raw.decode("utf-8")
            except UnicodeDecodeError:
                pass
    if any("\u2e80" <= c for c in text):
        for name in WIDE:
            try:
                yield f"{name}>utf-8", text.encode(name).decode("utf-8")
            except UnicodeError:
                pass


def _plausible(text: str) -> bool:
    return cost(text) <= 0.9 * len(text)


@lru_cache(maxsize=300_000)
def _token(t: str) -> tuple[str, tuple[str, ...], float]:
    """(text the token was, edges to it, cost gained); the token itself if nothing better is reached."""
    u, way = search(t, _escaped, _readings)
    g = _escaped(t) - cost(u)
    # four or more bytes that happen to be valid UTF-8 are no accident, however little is gained
    if way and (g >= TOKEN_GAIN and _plausible(u) or g > 0.2 and sum(c > "\x7f" for c in t) >= 4):
        return u, way, g
    return t, (), 0.0


@lru_cache(maxsize=300_000)
def _single(t: str) -> tuple[tuple[tuple[str, str], str], ...]:
    """What each single-byte reading, and then the UTF-8 readings, make of a token, where it is not worse."""
    was = _cost(t)
    out = []
    for name, to in SINGLE:
        raw = _encode(t, name)
        if raw is not None:
            u = "".join([_BACK[to][b] for b in raw])
            if u != t:
                u = _token(u)[0]
                if _cost(u) - was < 0.15:
                    out.append(((name, to), u))
    return tuple(out)


@lru_cache(maxsize=300_000)
def _cost(t: str) -> float:
    """Cost of a token among others: letters of one Latin alphabet cost little where they are few, those
    of several in one word more."""
    usual = [c.lower() for c in t if c in _USUAL]
    if usual and 2 * len(usual) <= sum(map(str.isalpha, t)):
        return cost(t) - 0.4 * len(usual) + min(sum(c not in a for c in usual) for a in _ALPHABETS)
    return cost(t)


def _page_cost(tokens: tuple[str, ...]) -> float:
    return sum(map(_cost, tokens))


def _page_readings(tokens: tuple[str, ...]) -> Iterator[tuple[str, tuple[str, ...]]]:
    """Readings of one single-byte encoding as another that make the page no worse."""
    by: dict[tuple[str, str], dict[int, str]] = {}
    for i, t in enumerate(tokens):
        for pair, u in _single(t):
            by.setdefault(pair, {})[i] = u
    for pair, new in by.items():
        if sum(_cost(u) - _cost(tokens[i]) for i, u in new.items()) < 0:
            yield f"{pair[0]}>{pair[1]}", tuple(new.get(i, t) for i, t in enumerate(tokens))


#: Question marks where letters were: inside a word (before a capital a sentence may begin), in a row beside letters, before a letter, or alone among numbers.
_ASKED = re.compile(r"[^\W_]\?+(?:[^\W_A-Z]|[A-Z](?![a-z]))|(?<![^\W_])\?+(?=[^\W\d_])|[^\W_]\?\?|(?<=\d )\?(?= |$)|(?<= )\?(?= \d)")
_LINKED = re.compile(r"\S*[/=&]\S*")
_PIECES = re.compile(r"([ \t\r\n\f\v]+)")


def repair(text: str) -> tuple[str | None, str]:
    """(state, text restored as far as it can be): state is None for text that is not garbled,
    ``restorable``, or ``lost`` where characters were replaced for good."""
    lost = "�" in text or "?" in text and bool(_ASKED.search(_LINKED.sub(" ", text)))
    if text.isascii() and not _ESCAPE.search(text):
        return ("lost" if lost else None), text
    parts = _PIECES.split(text)
    # a joiner of a broken word or an invisible sign is no sign of a wrong encoding
    odd = [i for i, p in enumerate(parts) if p and (not p.isascii() or "&" in p or "\\u" in p)]
    was = {}
    for i in odd:
        u, way, _ = _token(parts[i])
        if way:
            was[i], parts[i] = parts[i], u
    start = tuple(parts[i] for i in odd)
    if any(_cost(t) >= 0.9 and "?" not in t and "\ufffd" not in t for t in start):
        best, way = search(start, _page_cost, _page_readings, PAGES)
        changed = [k for k, (a, b) in enumerate(zip(start, best)) if a != b]
        worst = [k for k in changed if _cost(start[k]) >= 0.9]
        before, after = (_page_cost(tuple(x[k] for k in worst)) for x in (start, best))
        # signs that stand alone in their words (a joiner, a look-alike letter) prove less
        signs = sum(a != b for k in changed for a, b in zip(start[k], best[k]))
        sure = after <= 0.35 * before and signs >= max(6, 2 * len(changed))
        if way and before - after >= max(0.4 * len(worst), SURE_GAIN if sure else PAGE_GAIN):
            for k in changed:
                was.setdefault(odd[k], parts[odd[k]])
                parts[odd[k]] = best[k]
    # what is implausible still is not restored
    for i in [i for i in was if not _plausible(parts[i])]:
        parts[i] = was.pop(i)
    if lost:
        return "lost", "".join(parts)
    return ("restorable" if was else None), "".join(parts)


def restore(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys..., state, restored) of the garbled texts alone; see :func:`repair`. Null and empty
    texts are not garbled. Plain ASCII without an escape or a question mark never leaves the JVM."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes) + ", state string, restored string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, state, fixed = [], [], []
            for i, t in enumerate(b.column(len(keys)).to_pylist()):
                s, u = repair(t)
                if s:
                    rows.append(i)
                    state.append(s)
                    fixed.append(u)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(at) for i in range(len(keys))], pa.array(state, pa.string()), pa.array(fixed, pa.string())], [*keys, "state", "restored"])

    return df.select(*keys, text).filter(F.col(text).rlike(r"[^\x00-\x7f]|\?|&#?\w+;|\\u")).mapInArrow(run, schema)
