"""Cutting a text where the byte-level pattern certainly ends one pre-token and begins the next."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc

#: ASCII punctuation without the apostrophe, which the pattern may bind to the letters after it.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space next to white space: there the pattern looks further than one character.
_RUN = re.compile(r"\s\s")


def lone_spaces(text: str) -> bool:
    """Whether every white-space character of a text stands alone between two others."""
    return bool(text) and not text[0].isspace() and not text[-1].isspace() and not _RUN.search(text)


_SPACES = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace()) + "]"


def have_lone_spaces(texts: pa.Array) -> pa.Array:
    """lone_spaces of an Arrow string column."""
    return pc.invert(pc.match_substring_regex(texts, f"{_SPACES}{_SPACES}|^{_SPACES}|{_SPACES}$|^$"))


def units(text: str) -> list[str] | None:
    """The text cut before every space and around every newline, or None.

    Where each white-space character stands alone between two others, no
    pre-token holds a visible character and then a space, and a lone newline is
    a pre-token; so the pattern splits each unit as it splits the whole text.
    None means that white space meets white space, and the text needs the pattern.
    """
    if not lone_spaces(text):
        return None
    out: list[str] = []
    for k, line in enumerate(text.split("\n")):
        if k:
            out.append("\n")
        first, *rest = line.split(" ")
        out.append(first)
        out.extend([" " + x for x in rest])
    return out


def head_and_tail(unit: str) -> tuple[str, str] | None:
    """A unit cut before the punctuation that ends it, where a letter stands before it; the pattern keeps such a run in one piece."""
    head = unit.rstrip(TAIL)
    if len(head) < len(unit) and head and head[-1].isalpha():
        return head, unit[len(head) :]
    return None
