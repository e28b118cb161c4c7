"""Keyed, type-consistent replacements for personal items.

Every replacement is a keyed permutation of the item's own form: digits go to digits, letters to letters of the same script, case and sound class (vowel,
consonant), separators stay. Within a form that is one to one, so different items stay different, and one item gets the same replacement
wherever it stands, in any case or order of its parts, so who is who can still be followed. A name's parts are exchanged for parts of other
names of the same last letter (or, for rare ones, the same sound class of it), which is all that a list of names tells of gender.

A replacement that equals its item, another item or another replacement is not taken: the item is permuted again under the next key, and after ``TWEAKS`` keys it gets
a sealed placeholder, its kind and a keyed code. So nothing is ever left as it was. What it must differ from is the caller's to say: one text's items (:meth:`Surrogates.of`)
or the whole corpus's (``privacy.assigned``).
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from functools import lru_cache

from seqloom.llm.names import NameModel, parts
from seqloom.llm.pii import STREET

VOWELS = "aeiou"
OTHER_VOWELS = set("аеёиоуыэюяіїєαεηιουωæøœıəɨ")
"""Vowels of further alphabets (fixed values)."""

EVERYDAY = [(0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA)]
"""Ranges of the letters in daily use of Greek, Cyrillic and Hebrew (fixed values); they are exchanged among themselves."""

TWEAKS = 8
"""Keys tried for one item."""

KEPT_WORDS = re.compile(rf"^(?:{STREET}|Flat|Apt|Unit|Suite|Calle|C|Avda|Avenida|Paseo|Plaza|Straße|Str|Weg|Gasse|Ring|Allee|Platz|Am|Unter|Auf|Alt|Bad|Port|Little|Upper)$")
STREET_ENDING = re.compile(r"(straße|strasse|str|weg|gasse|ring|allee|platz|damm|ufer)$")


class Surrogates:
    """Replacements under one secret ``key``."""

    def __init__(self, key: str, model: NameModel):
        self._key = key.encode()
        heads, tails = parts(set(model.given_words))
        self._given = _Exchange(self._order, "given", heads, tails)
        heads, tails = parts(set(model.family_words))
        self._family = _Exchange(self._order, "family", heads, tails)
        self._permute = lru_cache(1 << 16)(self._permuted)

    def _number(self, *what: object) -> int:
        return int.from_bytes(hmac.new(self._key, repr(what).encode(), hashlib.sha256).digest()[:8], "big")

    def _order(self, label: str, items: list[str]) -> dict[str, str]:
        """A keyed permutation of the items without fixed points, where there are two or more."""
        ranked = sorted(items, key=lambda x: (self._number(label, x), x))
        return dict(zip(ranked, ranked[1:] + ranked[:1], strict=True))

    def digits(self, text: str, tweak: object = 0) -> str:
        """A keyed permutation of the digit strings of this length (four Feistel rounds), first digits staying non-zero."""
        n = len(text)
        if n < 2:
            return str((int(text) + self._number("digit", tweak) % 9 + 1) % 10) if n else text
        lead = text[0] == "0"
        while True:
            half = n // 2
            left, right = int(text[:half]), int(text[half:])
            for r in range(4):
                if r % 2:
                    right = (right + self._number(n, r, left, tweak)) % 10 ** (n - half)
                else:
                    left = (left + self._number(n, r, right, tweak)) % 10**half
            text = f"{left:0{half}d}{right:0{n - half}d}"
            if (text[0] == "0") == lead or lead:
                return text  # else walk on until the form fits, which keeps it one to one

    def letters(self, text: str, tweak: object = 0) -> str:
        """Letters exchanged one to one by sound class; case, marks and everything else stay."""
        vowels, others = self._sounds(tweak)
        out = []
        for c in text:
            base = unicodedata.normalize("NFD", c)
            low = base[0].lower()
            new = vowels.get(low) or others.get(low)
            if new is None:
                out.append(self._foreign(c, tweak))
            else:
                out.append(unicodedata.normalize("NFC", (new.upper() if base[0].isupper() else new) + base[1:]))
        return "".join(out)

    def _foreign(self, c: str, tweak: object) -> str:
        """A letter of another alphabet goes to one of the same letters in daily use, or block of 256 characters, of the same category and sound class; everything else stays."""
        if not c.isalpha():
            return c
        low = c.lower() if len(c.lower()) == 1 and c.lower().upper() == c else c
        at = next((x for x in EVERYDAY if x[0] <= ord(low) <= x[1]), (ord(low) & ~0xFF, ord(low) | 0xFF))
        new = self._alphabet(at, unicodedata.category(low), low in OTHER_VOWELS, tweak).get(low, low)
        return new.upper() if low != c else new

    @lru_cache(1024)  # noqa: B019
    def _alphabet(self, at: tuple[int, int], category: str, vowel: bool, tweak: object) -> dict[str, str]:
        letters = [c for c in map(chr, range(at[0], at[1] + 1)) if unicodedata.category(c) == category and not unicodedata.decomposition(c)]
        letters = [c for c in letters if at in EVERYDAY or not any(a <= ord(c) <= b for a, b in EVERYDAY)]
        if category == "Ll":
            letters = [c for c in letters if len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c and c not in "abcdefghijklmnopqrstuvwxyz"]
        return self._order(f"{at} {category} {vowel} {tweak}", [c for c in letters if (c in OTHER_VOWELS) == vowel])

    @lru_cache(64)  # noqa: B019
    def _sounds(self, tweak: object) -> tuple[dict, dict]:
        return self._order(f"vowels{tweak}", list(VOWELS)), self._order(f"others{tweak}", list("bcdfghjklmnpqrstvwxyz"))

    def _word(self, word: str, family: bool, tweak: object) -> str:
        plain = word.title() if word.isupper() and len(word) > 1 else word
        new = None if tweak else (self._family if family else self._given)(plain)
        new = new or self.letters(plain, tweak)
        return new.upper() if word.isupper() and len(word) > 1 else new

    def name(self, value: str, known: dict[str, str], tweak: object = 0) -> str:
        """``known`` maps an initial and family name of the text to the initial its full form gets."""
        flipped = "," in value
        words = re.split(r"([ ,.'’-]+)", value)
        bare = [i for i, w in enumerate(words) if w and w[0].isalpha()]
        out = list(words)
        single = len([i for i in bare if words[i][0].isupper()]) == 1
        first_family = len(value.partition(",")[0]) if flipped else None
        at = 0
        for i, w in enumerate(words):
            here, at = at, at + len(w)
            if i not in bare or w[0].islower():
                continue
            if len(w) == 1:
                out[i] = w if words[i + 1 : i + 2] and words[i + 1].strip() in ("'", "’") else known.get(f"{w}|{words[bare[-1]]}", self.letters(w, tweak))
            elif flipped:
                out[i] = self._word(w, here < first_family, tweak)
            else:
                given = single or here < (value.find(" ") if " " in value else len(value))
                out[i] = self._word(w, not given, tweak)
        return "".join(out)

    def _permuted(self, kind: str, value: str, tweak: int) -> str:
        if kind == "phone":
            keep = 2 if value[0] == "+" else 1 if value[0] == "0" else 0
            head = re.match(r"\+?\d" if keep else r"", value).group()
            return self._fill(value, lambda s: s[: len(re.sub(r"\D", "", head))] + self.digits(s[len(re.sub(r"\D", "", head)) :], (kind, tweak)))
        if kind == "idnum":
            return self.letters(self._fill(value, lambda s: self.digits(s, (kind, tweak))), (kind, tweak))
        if kind == "email":
            local, mark, host = re.match(r"(.*?)(@| ?[\[({<]at[\])}>] ?| ?[\[(]@[\])] ?| at |%40|&#64;|&commat;)(.*)$", value, re.I | re.S).groups()
            labels = re.split(r"(\.| ?[\[({]dot[\])}] ?| dot )", host, flags=re.I)
            labels[:-1] = [self.letters(x, ("host", tweak)) if i % 2 == 0 else x for i, x in enumerate(labels[:-1])]
            local = re.sub(r"\d+", lambda m: self.digits(m.group(), (kind, tweak)), self.letters(local, ("local", tweak)))
            return local + mark + "".join(labels)
        if kind == "address":
            return re.sub(r"\d+|[^\W\d_]+", lambda m: self._place(m.group(), tweak), value)
        return value

    def _place(self, word: str, tweak: int) -> str:
        if word.isdigit():
            return self.digits(word, ("address", tweak))
        if word[0].islower() or KEPT_WORDS.match(word):
            return word
        ending = STREET_ENDING.search(word)
        cut = ending.start() if ending and ending.start() else len(word)
        return self.letters(word[:cut], ("address", tweak)) + word[cut:]

    @staticmethod
    def _fill(value: str, change) -> str:
        """``value`` with its digits, taken together, changed and put back in place."""
        new = iter(change(re.sub(r"\D", "", value)))
        return "".join(next(new) if c.isdigit() else c for c in value)

    def candidate(self, kind: str, value: str, hint: str = "", tweak: int = 0) -> str | None:
        """The replacement under the ``tweak``-th key; None where it would be the value itself. ``hint`` is the given name that an initial stands for."""
        if kind == "name":
            words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", value)
            known = {f"{hint[0]}|{words[-1]}": self._word(hint, False, 0)[0]} if hint and words else {}
            new = self.name(value, known, tweak)
        else:
            new = self._permute(kind, value, tweak)
        return new if new != value else None

    def sealed(self, kind: str, value: str, hint: str = "") -> str:
        """Placeholder of an item that no permutation of its form hides."""
        return f"[{kind.upper()}-{hmac.new(self._key, repr(('sealed', kind, value, hint)).encode(), hashlib.sha256).hexdigest()[:20]}]"

    def of(self, items: list[tuple[str, str]]) -> dict[tuple[str, str], str]:
        """Replacement of each (kind, value) of one text, apart from all its items and from each other."""
        hints = hints_of(items)
        own = {v for _, v in items}
        out: dict[tuple[str, str], str] = {}
        used: set[str] = set()
        for kind, value in items:
            hint = hints.get(value, "") if kind == "name" else ""
            tries = (self.candidate(kind, value, hint, tweak) for tweak in range(TWEAKS))
            new = next((x for x in tries if x is not None and x not in own and x not in used), None) or self.sealed(kind, value, hint)
            out[kind, value] = new
            used.add(new)
        return out


def hints_of(items: list[tuple[str, str]]) -> dict[str, str]:
    """For names of one text that give an initial (``R. Holmvale``): the given name that a full form in the text has for it."""
    full: dict[tuple[str, str], str] = {}
    for kind, value in items:
        words = re.findall(r"[^\W\d_]+", value)
        if kind == "name" and len(words) > 1 and len(words[0]) > 1 and "," not in value:
            full.setdefault((words[0][0], words[-1]), words[0])
    out = {}
    for kind, value in items:
        words = re.findall(r"[^\W\d_]+", value)
        if kind == "name" and len(words) > 1 and len(words[0]) == 1 and (words[0], words[-1]) in full:
            out[value] = full[words[0], words[-1]]
    return out


class _Exchange:
    """Exchanges the parts of name words one to one, endings within their class."""

    def __init__(self, order, label: str, heads: set[str], tails: set[str]):
        self._heads = order(f"{label} heads", sorted(heads))
        by: dict[str, list[str]] = {}
        for t in sorted(tails):
            by.setdefault(t[-1], []).append(t)
        rare = [t for ts in by.values() if len(ts) == 1 for t in ts]
        groups = [ts for ts in by.values() if len(ts) > 1] + [[t for t in rare if (t[-1] in VOWELS) == soft] for soft in (True, False)]
        self._tails: dict[str, str] = {}
        for i, group in enumerate(groups):
            self._tails |= order(f"{label} tails {i}", group)

    def __call__(self, word: str) -> str | None:
        for i in range(2, len(word) - 1):
            if word[:i] in self._heads and word[i:] in self._tails:
                return self._heads[word[:i]] + self._tails[word[i:]]
        return None
