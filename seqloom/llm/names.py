"""A model of personal names, fitted on a bounded list of known people.

Names of one community are built from recurring parts. The model learns, from full names, the beginnings and endings that several known given names
(and family names) share, and takes a word for a name if it is one of the known ones or a known beginning followed by a known ending. It is a pair of
regular expressions, so it runs over whole texts at the speed of a search.
"""

from __future__ import annotations

import re
from collections import defaultdict

SAMPLE = 20_000
"""At most so many known people, lowest id first, are used for fitting; this bounds the model."""

PARTICLES = ["van der", "van den", "van de", "van", "von der", "von", "de la", "de los", "de las", "de", "del", "della", "di", "da", "dos", "das", "do", "du", "la", "le", "ter", "ten", "zu", "af", "bin", "ibn", "al", "el"]
"""Words that may stand between given and family name (fixed values)."""


def parts(words: set[str], shared: int = 3) -> tuple[set[str], set[str]]:
    """Beginnings and endings of the words, each found with at least ``shared`` of the other kind."""
    heads, tails = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(2, len(w) - 1):
            heads[w[:i]].add(w[i:])
            tails[w[i:]].add(w[:i])
    for _ in range(3):  # keep what supports each other
        heads = {h: {t for t in ts if len(tails.get(t, ())) >= shared} for h, ts in heads.items()}
        heads = {h: ts for h, ts in heads.items() if len(ts) >= shared}
        tails = {t: {h for h in hs if h in heads} for t, hs in tails.items()}
        tails = {t: hs for t, hs in tails.items() if len(hs) >= shared}
    # of the ways to split a word the one whose halves are best supported counts
    best_heads, best_tails = defaultdict(int), defaultdict(int)
    for w in words:
        ways = [(len(heads[w[:i]]) * len(tails[w[i:]]), i) for i in range(2, len(w) - 1) if w[:i] in heads and w[i:] in tails]
        if ways:
            i = max(ways)[1]
            best_heads[w[:i]] += 1
            best_tails[w[i:]] += 1
    return {h for h, n in best_heads.items() if n >= 2}, {t for t, n in best_tails.items() if n >= 2}


def split_name(full: str) -> tuple[str, str] | None:
    """(given, family) of a full name; None for a single word."""
    words = full.split()
    return (words[0], words[-1]) if len(words) > 1 else None


def _any(words: set[str]) -> str:
    return "|".join(sorted(map(re.escape, words), key=lambda w: (-len(w), w))) or r"(?!)"


def _class(words: set[str]) -> str:
    heads, tails = parts(words)
    built = f"(?:{_any(heads)})(?:{_any(tails)})" if heads and tails else r"(?!)"
    rest = {w for w in words if len(w) > 2 and not re.fullmatch(built, w)}
    return f"(?:{built}|{_any(rest)})"


def _by_letter(kinds: list[set[str]]) -> str:
    """Pattern of the words of all kinds with one branch per first letter."""
    branches = defaultdict(list)
    for words in kinds:
        heads, tails = parts(words)
        tail = f"(?:{_any(tails)})"
        grouped = defaultdict(set)
        for h in heads:
            grouped[h[0]].add(h[1:])
        for letter, rest in grouped.items():
            branches[letter].append(f"(?:{_any(rest)}){tail}")
        for w in words:
            if len(w) > 2 and not (heads and tails and re.fullmatch(f"(?:{_any(heads)}){tail}", w)):
                branches[w[0]].append(re.escape(w[1:]))
    return "|".join(f"{re.escape(letter)}(?:{'|'.join(rest)})" for letter, rest in sorted(branches.items()))


class NameModel:
    """Patterns of given names, family names and whole names, from a list of full names."""

    def __init__(self, full_names: list[str]):
        given, family = set(), set()
        for name in full_names:
            pair = split_name(name or "")
            if pair:
                given.update(w for w in pair[0].split("-") if w[:1].isupper())
                family.update(re.sub("^[OD]['’]", "", w) for w in pair[1].split("-") if w[:1].isupper())
        self.given_words, self.family_words = sorted(given), sorted(family)
        g, f = _class(given), _class(family)
        gu, fu = _class({w.upper() for w in given}), _class({w.upper() for w in family})
        particle = f"(?:(?:{_any(set(PARTICLES))}) )?"
        particle_u = f"(?:(?:{_any({p.upper() for p in PARTICLES} | set(PARTICLES))}) )?"
        one_family, one_upper = rf"(?:[OD]['’])?{f}", rf"(?:[OD]['’])?{fu}"
        self.given = rf"{g}(?:-{g})?"
        self.family = rf"{particle}{one_family}(?:-{one_family})?"
        given_u, family_u = rf"{gu}(?:-{gu})?", rf"{particle_u}{one_upper}(?:-{one_upper})?"
        whole = rf"{self.given}(?: [A-Z]\.)?(?: {self.family})?|(?:\b[^\W\d_]\.[ -]?){{1,2}} ?{self.family}|{self.family}, (?:{self.given}|[^\W\d_]\.)|{given_u} {family_u}|{family_u}, {given_u}"
        #: not inside a longer word, an address, a path or a handle; a plus or minus may only be a diff's mark at a line's start
        self.pattern = re.compile(rf"(?<![\w@./'’&=])(?<![^\r\n][+-])(?:{whole})(?![\w@]|['’](?!s\b)\w|[._-]\w|\[|\()") if given and family else None
        #: any name word, for finding the few lines that hold names; its branches differ in their first letters
        self.word = re.compile(_by_letter([given, family, {w.upper() for w in given}, {w.upper() for w in family}])) if given and family else None
