"""Subtitle text reduced to words that survive character recognition and wrong encodings."""

from __future__ import annotations

import html
import re
import unicodedata

#: Signs that recognition takes for one another share a letter; fixed values.
LOOKALIKE = {"e": "c", "l": "i", "1": "i", "|": "i", "0": "o", "t": "f", "h": "b", "8": "b", "5": "s"}
#: Letters that recognition takes apart, as the strokes it reads, in the letters that LOOKALIKE leaves; fixed values.
STROKES = (("m", "rn"), ("n", "ri"), ("u", "ii"), ("d", "ci"), ("w", "vv"))

LINE_ENDS = re.compile(r"\r\n?")
TIMING = re.compile(r"(?m)(?:^[^\S\n]*\W{0,3}\d+[^\S\n]*\n)?^.*-->.*$")
TAGS = re.compile(r"<[^<>\n]+>|\{[^{}\n]+\}")
#: Descriptions end where they began: in their cue (before a blank line) or, between other signs, in their line.
SOUNDS = re.compile(r"\[[^\[\]\n]*+(?:\n(?![^\S\n]*\n)[^\[\]\n]*+)*+\]|\([^()\n]*+(?:\n(?![^\S\n]*\n)[^()\n]*+)*+\)|\*[^*\n]++\*|♪[^♪\n]*+♪|#[^#\n]++#")
#: Music between two signs, whatever an encoding has made of them, at the start of a line.
MUSIC = re.compile(r"(?m)^((?:[^\S\n]|[-–—>\"'])*+)((?=[^\x00-\x7f\s]*[♪™ªЄ�\x80-\x9f])[^\x00-\x7f\s]+|\?)[^\S\n]+[^\n?]+?[^\S\n]+\2(?!\S)")
ALONE = re.compile(r"(?<!\S)[^\x00-\x7f\s]+(?!\S)")
LOST = re.compile(r"(?<=[A-Za-z])\?(?=[A-Za-z])")
APOSTROPHES = b"'`"


def _letters(digits: str | None = None) -> bytes:
    """A table from each byte to its folded letter or digit; other signs become a blank, line ends stay."""
    table = bytearray(b" " * 256)
    table[ord("\n")] = ord("\n")
    for c in "abcdefghijklmnopqrstuvwxyz0123456789|":
        to = ord(digits if digits and c.isdigit() else LOOKALIKE.get(c, c if c != "|" else " "))
        table[ord(c)] = table[ord(c.upper())] = to
    return bytes(table)


FOLDED, ROUGH = _letters(), _letters(digits="9")


def _alone(m: re.Match) -> str:
    """A word of letters beyond ASCII only keeps its place; signs don't."""
    return "q" if any(c.isalpha() or c == "�" for c in m[0]) else " "


def fold(text: str) -> str:
    """Folded text: equal for a word and what recognition errors, lost accents or a wrong encoding make of it.

    Whatever isn't ASCII is left out, so an accented letter, its replacement sign and its mojibake agree;
    look-alike letters become one, and letters read as two are written as their strokes. Different words may agree too; callers compare many in a row.
    """
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = ALONE.sub(_alone, text.replace("–", " ").replace("—", " ").replace("…", " "))
    return _strokes(text, FOLDED)


def rough(text: str) -> str:
    """As :func:`fold`, but all digits are 9; cheaper, to sort out what needs no closer look."""
    return _strokes(text, ROUGH)


def _strokes(text: str, table: bytes) -> str:
    if "?" in text:
        text = LOST.sub("", text)
    # capitals write a sharp s as two
    text = text.encode("ascii", "ignore").lower().replace(b"ss", b"").translate(table, APOSTROPHES).decode("ascii")
    for letter, strokes in STROKES:
        text = text.replace(letter, strokes)
    return text


def spoken(text: str) -> str:
    """The text without cue numbers, times, markup and sound descriptions."""
    if "\r" in text:
        text = LINE_ENDS.sub("\n", text)
    text = TIMING.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "{" in text:
        text = TAGS.sub("", text)
    return SOUNDS.sub(" ", MUSIC.sub(r"\1 ", text))


def words(text: str) -> list[str]:
    """Folded words of the spoken text."""
    return fold(spoken(text)).split()
