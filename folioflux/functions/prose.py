"""Words by which two readings of a page are compared: a transcription with markup and a plain reading."""

from __future__ import annotations

import unicodedata
from itertools import groupby


def without_formulas(text: str) -> str:
    """The text with a space for each formula. A display formula stands between two pairs of dollar
    signs. An inline one stays on its line, touches both its signs, and is not closed by a sign before a
    digit, so that two prices are no formula; a sign after a backslash is a sign of money."""
    kept, done, at = [], 0, text.find("$")
    while at >= 0:
        end = -1
        if text.startswith("$$", at):
            close = text.find("$$", at + 2)
            end = close + 2 if close >= 0 else -1
        if end < 0 and text[at - 1 : at] not in ("\\", "$"):
            close = text.find("$", at + 1)
            inner = text[at + 1 : close]
            if close > at + 1 and "\n" not in inner and not inner[0].isspace() and not inner[-1].isspace() and inner[-1] != "\\" and not text[close + 1 : close + 2].isdigit():
                end = close + 1
        if end > 0:
            kept += (text[done:at], " ")
            done = end
        at = text.find("$", max(end, at + 1))
    return "".join(kept) + text[done:]


def without_notes(text: str) -> str:
    """The text without footnote marks: a name between ``[^`` and ``]``."""
    head, *rest = text.split("[^")
    for piece in rest:
        name, closed, after = piece.partition("]")
        head += f" {after}" if closed and name else f"[^{piece}"
    return head


def mended(text: str) -> str:
    """The text with words broken over line ends in one piece."""
    whole, *rest = text.split("-\n")
    for piece in rest:
        inside = whole[-1:].isalnum() and piece[:1].isalnum()
        whole += piece if inside else f"-\n{piece}"
    return whole


def plain_words(text: str) -> list[str]:
    """Letters and digits without accents and case; an apostrophe or hyphen between two of them belongs
    to the word."""
    letters = (c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    rough = "".join(c if c.isalnum() else "'" if c in "'’" else c if c == "-" else " " for c in letters)
    out = []
    for chunk in rough.split():
        if chunk.isalnum():
            out.append(chunk.casefold())
            continue
        word = ""
        for joins, run in groupby(chunk, lambda c: c in "'-"):
            part = "".join(run)
            if joins and (len(part) > 1 or not word):  # a dash, or nothing to join to
                if word:
                    out.append(word.casefold())
                word = ""
            else:
                word += part
        out += [word.rstrip("'-").casefold()] if word else []
    return out


def prose(text: str, markup: bool) -> list[str]:
    """The words of a transcription (``markup``: without formulas and footnote marks) or of a plain reading."""
    return plain_words(without_notes(without_formulas(text)) if markup else mended(text))
