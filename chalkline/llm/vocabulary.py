"""Reading of byte-pair vocabularies (JSON of the tokenizers library) and the text splitting they declare."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import regex

#: White space of Unicode, as a character class (fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@dataclass(frozen=True)
class Vocabulary:
    ids: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int]
    suffix: str


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Vocabulary(model["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]}, model.get("end_of_word_suffix") or "")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others
    follow from U+0100 in order."""
    shown = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else "" for b in range(256)]
    extra = iter(range(256, 512))
    return [s or chr(next(extra)) for s in shown]


def special_pattern(special: dict[str, int]) -> re.Pattern | None:
    """Finds special strings, longer ones first; the group keeps them in a split."""
    return re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None


def splitter(pattern: str) -> regex.Pattern:
    """A split pattern with the white space class written out."""
    return regex.compile(pattern.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]"))
