"""Detection of personal data and secrets in text, and keyed surrogates of the same type and format."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from dataclasses import dataclass

import ahocorasick

#: Titles and given names by the gender they tell (f, m, n: either).
TITLES = {"Mrs": "f", "Ms": "f", "Miss": "f", "Mr": "m", "Dr": "n", "Prof": "n", "Frau": "f", "Herr": "m", "Mme": "f", "Mlle": "f", "Madame": "f", "Monsieur": "m",
          "Sra": "f", "Srta": "f", "Sr": "m", "Señora": "f", "Señor": "m", "Госпожа": "f", "Господин": "m", "Κυρία": "f", "Κύριος": "m"}
GIVEN = {
    "f": """Anna Maria Emma Laura Julia Sarah Emily Olivia Sophia Isabella Charlotte Amelia Alice Claire Camille Chloé Marie Jeanne Louise Ingrid Greta Heike Sabine Ursula
Katharina Lucía Carmen Sofía Elena Isabel Paula Rosa Susan Linda Mary Patricia Jennifer Elizabeth Barbara Margaret Анна Мария Елена Ольга Наталья Ελένη Μαρία Σοφία""".split(),
    "m": """John James Robert Michael William David Richard Thomas Daniel Matthew Andrew Peter Paul Mark George Henry Oliver Jack Pierre Jean Jacques Antoine Louis Hans Klaus Jürgen
Stefan Wolfgang Heinrich Carlos José Miguel Javier Fernando Diego Pablo Juan Luis Иван Пётр Алексей Сергей Дмитрий Γιώργος Νίκος Δημήτρης""".split(),
}
_GENDER = {n: g for g, names in GIVEN.items() for n in names}
_SYLLABLES = {"LATIN": "ba ne lo mi ra su te vo ka del mar tin lan ro vi sen dor gal per hol".split(), "CYRILLIC": "ба не ло ми ра су те во ка дел мар тин лан ро ви сен дор гал".split(),
              "GREEK": "βα νε λο μι ρα σου τε βο κα δελ μαρ τιν λαν ρο βι σεν".split()}

_NAME = r"[^\W\d_a-zß-öø-ÿа-яёα-ω][\w'’-]+"
PATTERNS = [
    ("email", re.compile(r"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@(?:[\w-]+\.)+[^\W\d_]{2,}")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", re.compile(r"(?<![\d(+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)|(?<![\w.+-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w.-])(?:\d{4}[ -]){3}\d{1,7}(?![\w-])|(?<![\w.-])\d{13,19}(?![\w-])")),
    ("secret", re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{30,}|\bsk-[A-Za-z0-9_-]{20,}|\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("secret", re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api_?key|access_?key)\b[\"']?[^\w=:]{0,5}[=:][^\w]{0,5}(?P<value>[^\s\"']*[0-9][^\s\"']*)")),
]
_DIGIT = re.compile("[0-9]")
#: What every match of a kind holds (fixed by the patterns above), so texts without it need no search.
_HOLDS = {"email": "@", "iban": "0", "ip": "0", "ssn": "0", "phone": "0", "card": "0"}


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str
    value: str  # the entity, whatever the mention's format


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdecimal())


def _canonical(kind: str, found: str) -> str | None:
    """The entity of a match, or None if it is none after all."""
    if kind == "email":
        return found.lower()
    if kind == "ip":
        return ".".join(str(int(p)) for p in found.split(".")) if all(int(p) < 256 for p in found.split(".")) else None
    if kind == "card":
        d = _digits(found)
        return d if 13 <= len(d) <= 19 and luhn(d) and len(set(d)) > 1 else None
    if kind == "iban":
        bare = found.replace(" ", "")
        return bare if 15 <= len(bare) <= 34 and _iban_rest(bare) == 1 else None
    if kind == "phone":
        d = _digits(found)
        d = d[1:] if len(d) == 11 and d[0] == "1" else d
        return d if 7 <= len(d) <= 15 else None
    return _digits(found) if kind == "ssn" else found


class Finder:
    """Finds mentions; of overlapping ones the first stays, of those with the same start that of the earlier pattern."""

    def __init__(self) -> None:
        self.cues = ahocorasick.Automaton()
        for t in TITLES:
            for end in (". ", " "):
                self.cues.add_word(t + end, (t, TITLES[t], True))
        for n, g in _GENDER.items():
            self.cues.add_word(n + " ", (n, g, False))
        self.cues.make_automaton()
        self.name = re.compile(rf"{_NAME}(?: {_NAME})?")

    def names(self, text: str) -> list[Mention]:
        """Given names and surnames after a title, and a known given name with the surname after it."""
        out = []
        for last, (cue, gender, title) in self.cues.iter(text):
            at = last + 1
            start = text.rfind(cue, 0, at)
            if start and (text[start - 1].isalnum() or text[start - 1] in "_-'"):
                continue
            m = self.name.match(text, at)
            if not m:
                continue
            parts = [(m.start() + p.start(), m.start() + p.end(), p[0]) for p in re.finditer(r"\S+", m[0])]
            if len(parts) > 1 and (parts[0][2].endswith(("'s", "’s")) or len(parts[1][2]) > 1 and parts[1][2].isupper() and not parts[0][2].isupper()):
                del parts[1:]  # a possessive ends the name, and a word in capitals is none of its parts
            if title:
                *given, surname = parts
                if not given and surname[2] in _GENDER:  # the name itself is a cue
                    continue
                out += [Mention(a, b, f"given_{_GENDER.get(v, gender)}", v.lower()) for a, b, v in given]
            else:
                surname = parts[0]
                if surname[2] in _GENDER or surname[2].isupper() and len(surname[2]) > 1 and not cue.isupper():
                    continue
                out.append(Mention(start, start + len(cue), f"given_{gender}", cue.lower()))
            out.append(Mention(surname[0], surname[1], "surname", surname[2].removesuffix("'s").removesuffix("’s").lower()))
        return out

    def again(self, text: str, named: list[Mention]) -> list[Mention]:
        """Bare mentions of the names that the text has given in full elsewhere, in their form or in capitals."""
        forms: dict[str, tuple[str, str]] = {}
        for m in named:
            form = text[m.start:m.start + len(m.value)]
            for f in (form, form.upper()):
                if len(f) > 1:
                    forms.setdefault(f, (m.kind, m.value))
        if not forms:
            return []
        bare = re.compile(rf"(?<![\w'’-])(?:{'|'.join(map(re.escape, sorted(forms, key=len, reverse=True)))})(?![\w-])")
        return [Mention(m.start(), m.end(), *forms[m[0]]) for m in bare.finditer(text)]

    def find(self, text: str) -> list[Mention]:
        found: list[Mention] = []
        digit = _DIGIT.search(text) is not None
        for kind, pattern in PATTERNS:
            needs = _HOLDS.get(kind)
            if needs == "0" and not digit or needs == "@" and "@" not in text:
                continue
            for m in pattern.finditer(text):
                group = "value" if "value" in m.groupdict() else 0
                value = _canonical(kind, m[group])
                if value is not None:
                    found.append(Mention(m.start(group), m.end(group), kind, value))
        named = self.names(text)
        found += [*named, *self.again(text, named)]
        out: list[Mention] = []
        for _, m in sorted(enumerate(found), key=lambda x: (x[1].start, x[0])):
            if not out or m.start >= out[-1].end:
                out.append(m)
        return out


class _Stream:
    """Endless keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, *what: object):
        self.seed, self.n, self.left = "\x1f".join(map(str, what)).encode("utf-8", "surrogatepass"), 0, b""
        self.key = key

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.seed + b"\x1e%d" % self.n, hashlib.sha256).digest()
            self.n += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n

    def like(self, s: str) -> str:
        """Digits for digits, letters for letters (hexadecimal ones where `s` is), the rest as it is."""
        hexadecimal = all(c in "0123456789abcdefABCDEF" for c in s)
        small, large = ("abcdef", "ABCDEF") if hexadecimal else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return "".join(str(self.below(10)) if c.isdecimal() else large[self.below(len(large))] if c.isupper() else small[self.below(len(small))] if c.isalpha() else c for c in s)


def _script(value: str) -> str:
    c = value[:1]
    return "CYRILLIC" if "Ѐ" <= c <= "ӿ" else "GREEK" if "Ͱ" <= c <= "Ͽ" else "LATIN"


SAME_FORM = 12  # attempts that keep the value's length


def _widened(value: str, more: int) -> str:
    """`value` with room for `more` digits after its last letter or digit."""
    at = next((k for k in range(len(value), 0, -1) if value[k - 1].isalnum()), len(value))
    return value[:at] + "0" * more + value[at:]


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The replacement entity, in canonical form. Later attempts draw anew, names from ever more syllables; from SAME_FORM on emails, secrets and
    phones get a digit more each time (phones up to 15 digits) and IPs any four bytes, so that a small form cannot run out."""
    s = _Stream(key, kind, value, attempt)
    more = max(0, attempt - SAME_FORM + 1)
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        d = _Stream(key, "domain", domain, attempt)
        return f"{s.like(_widened(local, more))}@{'.'.join([*[d.like(p) for p in labels[:-1]], labels[-1]])}"
    if kind == "ip":
        parts = []
        for p in value.split("."):
            low, high = (0, 10) if len(p) == 1 else (10, 100) if len(p) == 2 else (100, 256)
            low, high = (0, 256) if more else (low, high)
            parts.append(str(low + s.below(high - low)))
        return ".".join(parts)
    if kind == "card":
        body = value[0] + "".join(str(s.below(10)) for _ in value[1:-1])
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "iban":
        body = s.like(value[4:])
        rest = _iban_rest(value[:2] + "00" + body)
        return f"{value[:2]}{98 - rest:02d}{body}"
    if kind == "phone":
        if more:  # no 1 in front, which would read as a country code
            return "".join([str(2 + s.below(8)), *[str(s.below(10)) for _ in range(min(15, len(value) + more) - 1)]])
        return "".join(c if k == 0 and c == "0" else str(1 + s.below(9)) if k == 0 else str(s.below(10)) for k, c in enumerate(value))
    if kind == "secret":
        head = re.match(r"(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-)?", value)[0]
        return head + s.like(_widened(value[len(head):], more))
    if kind == "surname" or kind.startswith("given_"):
        gender, script = kind[-1], _script(value)
        known = [n.lower() for n in GIVEN.get(gender, []) if _script(n.lower()) == script] if kind != "surname" else []
        if known and attempt < 3:
            return known[s.below(len(known))]
        name = "".join(_SYLLABLES[script][s.below(len(_SYLLABLES[script]))] for _ in range(2 + s.below(2) + attempt // 2))
        ending = {"f": {"LATIN": "a", "CYRILLIC": "а", "GREEK": "α"}, "m": {"LATIN": "o", "CYRILLIC": "ий", "GREEK": "ος"}}.get(gender if kind != "surname" else "", {}).get(script, "")
        return name + ending
    return s.like(value)


def rendered(kind: str, mention: str, value: str, replacement: str) -> str:
    """The replacement entity in the format of the mention it stands for."""
    if kind in ("card", "ssn", "phone", "iban"):
        keep = len([c for c in mention if c.isalnum()]) - len(replacement)  # a country code that is no part of the entity
        rest = iter(replacement)
        out = []
        for c in mention:
            if c.isalnum() and keep > 0:
                keep -= 1
                out.append(c)
            else:
                out.append(next(rest, "") if c.isalnum() else c)
        return "".join([*out, *rest])
    if kind == "surname" or kind.startswith("given_"):
        tail = mention[len(value):]
        body = replacement.upper() if mention.isupper() and len(mention) > 1 else "-".join(p[:1].upper() + p[1:] for p in replacement.split("-"))
        return body + tail
    if kind == "email" and mention.isupper():
        return replacement.upper()
    return replacement
