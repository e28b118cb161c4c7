"""Personal items in free text: emails, phone numbers, identity numbers, street addresses and names.

Each kind has a cheap trigger that is searched in the whole text and a full grammar that is tried only where a trigger was
found, so that the cost of text without personal items is one linear scan. Spans never overlap: an email outranks an address, that a number, that
a name. Parts of binary patches are no text and are left out.

Defined results: null, empty and blank text hold nothing; an item is reported exactly as it stands; a text of any length is read whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

from seqloom.llm.names import PARTICLES, NameModel

# ---- email ----

LOCAL, HOST = r"[A-Za-z0-9](?:[\w.+'-]*[\w+-])?", r"[A-Za-z0-9](?:[\w-]*\w)?"
LOCAL_RUN = re.compile(r"[\w.+'-]+\Z")
EMAIL_HOST = re.compile(rf"@{HOST}(?:\.{HOST})*\.[A-Za-z]{{2,}}(?![\w@])")
FOREIGN_HOST = re.compile(r"@[^\W_](?:[\w-]*\w)?(?:\.[^\W_](?:[\w-]*\w)?)*\.[^\W\d_]{2,}(?![\w@])")
DISGUISES = [" at ", " AT ", "[at]", "[AT]", "(at)", "(AT)", "{at}", "<at>", "[@]", "(@)", "%40", "&#64;", "&commat;"]
AT = r"(?: ?(?:\[at\]|\(at\)|\{at\}|<at>|\[@\]|\(@\)) ?| at |%40|&#64;|&commat;)"
SPELLED = r"(?: ?(?:\[dot\]|\(dot\)|\{dot\}) ?| dot )"
DOT = r"(?:\.| ?(?:\[dot\]|\(dot\)|\{dot\}|\[\.\]) ?| dot )"
DISGUISED = re.compile(rf"(?P<local>{LOCAL}(?:{SPELLED}{LOCAL})*)(?:(?P<plain> at )|{AT})(?P<host>{HOST}(?:{DOT}{HOST})*{DOT}[A-Za-z]{{2,}})(?![\w@])", re.I)
NOBODY = re.compile(r"(?:no[-_.]?reply|do[-_.]?not[-_.]?reply|mailer-daemon|postmaster|bounces?|notifications?|[\w.-]*\bbot)(?:[+._-].*)?$", re.I)
LOGIN_COMMANDS = {"ssh", "scp", "sftp", "rsync"}
LOGIN_AFTER = re.compile(r":(?!\s)[\w~/]")
OPENED = re.compile(r"(?:[<(\[:=\"'“]\s*|\b(?:mail|email|e-mail|contact|from|by|to|write to|reach)\s)$", re.I)

# ---- numbers ----

DIGITS = re.compile(r"[+(]?\d[\d .()/ ‑-]{6,24}\d")
EXTENSION = re.compile(r",? ?(?:ext\.?|extension|x|Durchwahl|DW|poste) ?\d{1,6}(?!\w)", re.I)
NATIONAL = re.compile(
    r"(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"  # three, three and four
    r"|\(?0\d{1,4}\)?[ /-]\d{3,4}[ -]?\d{3,5}"  # area code, number
    r"|0\d{2,5}/\d{4,9}"
    r"|0\d(?:[ .]\d{2}){4}"  # pairs
    r"|00[1-9]\d{0,2}[ .-](?:\(0\))?\d{1,5}(?:[ ./-]\d{2,5}){1,5}"  # international, dialled
)
PHONE = re.compile(r"\+\d{1,3}(?:[ .-]?\(0\))?(?:[ ./-]?\(?\d{1,5}\)?){1,6}|" + NATIONAL.pattern)
"""International with prefix, or one of the national forms."""
IDENTITY = [
    re.compile(r"\d{3}-\d{2}-\d{4}"),
    re.compile(r"\d{2} \d{3} \d{3} \d{3}"),
]
LETTERED = re.compile(r"[0-9A-Z](?:(?<=\b\d)\d{5}(?:-[A-Z]\d{3}|\d\d-?[A-Z])|(?<=\b[A-Z])[A-Z](?:\d{7}| ?\d{2} ?\d{2} ?\d{2} ?[A-D])|(?<=\b[XYZ])-?\d{7}-?[A-Z])\b(?![-\w])")
LABELS = ["SSN", "ocial security", "Steuer", "national id", "passport", "tax id", "TIN", "IdNr", "INSEE", "NIR", "de sécu"]
LABELLED = re.compile(r"(?:SSN|social security(?: number| no\.?)?|Steuer-?ID|Steuernummer|national id|passport(?: no\.?| number)?|Reisepass|DNI|NIE|NIF|NI number|NINO|tax id|TIN|IdNr\.?|INSEE|NIR|n° de sécu(?:rité sociale)?)[\"':,.# ]{1,4}(?P<v>[A-Z]{0,2} ?\d[\dA-Z]*(?:[ -][\dA-Z]*\d[\dA-Z]*)*(?:[ -][A-Z]\b)?)")

# ---- address ----

CAP = r"[A-ZÀ-ÖØ-ÞĀ-ſ][\w'’-]*\.?"
TOWN = rf"{CAP.replace(chr(92) + '.?', '')}(?:[ -](?:(?:del|de|la|los|las|le|les|du|des|am|an der|im|in der|bei|sur|sous|upon|on|under|y|d['’])[ -]){{0,2}}(?:{CAP.replace(chr(92) + '.?', '')}))*"
STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Way|Row|Close|Court|Ct|Terrace|Ter|Boulevard|Blvd|Avenue|Ave|Drive|Dr|Place|Pl|Square|Sq|Crescent|Cres|Gardens|Gdns|Grove|Hill|Mews|Walk|Parade|Quay|Alley|Wharf|Highway|Hwy|Parkway|Pkwy|Circle|Cir|Trail|Green|Rise|Yard)"
FLAT = r"(?:, (?:Flat|Apt\.?|Apartment|Unit|Suite|Ste\.?|Room|No\.?|#) ?\d*[A-Za-z]?)?"
ENGLISH = rf"\d{{1,5}}[A-Za-z]?(?:[-/]\d+)? (?:{CAP} ){{1,4}}{STREET}\b(?:\.(?=[,\"']|$))?{FLAT}(?:, {TOWN}(?:,? \d{{5}}(?!\d))?)?"
GERMAN_STREET = r"(?:[A-ZÄÖÜ][\wäöüß]*(?:straße|strasse|str\.|weg|gasse|ring|allee|platz|damm|ufer|steig|pfad|chaussee|markt|hof|berg|graben)|[A-ZÄÖÜ][\wäöüß-]*(?:er|en|es)? (?:Straße|Strasse|Str\.|Weg|Gasse|Ring|Allee|Platz|Damm|Ufer|Steig|Pfad|Chaussee|Markt|Graben)|(?:Am|An der|An den|Auf der|Auf dem|Unter den|Unter der|Im|In der|In den|Zum|Zur|Hinter der|Hinter dem|Vor dem|Bei der|Beim) (?:[A-ZÄÖÜ][\wäöüß]+[ -]?){1,3})"
GERMAN = rf"{GERMAN_STREET} ?\d{{1,4}}[a-z]?(?:[-–/]\d+[a-z]?)?\b(?:, \d{{5}} {TOWN}|, {TOWN})?"
FRENCH_STREET = r"(?:rue|place|impasse|avenue|av\.|chemin|boulevard|bd|allée|allee|quai|cours|passage|square|route|ruelle|sentier|villa|cité|faubourg)"
FRENCH = rf"\d{{1,4}}(?: ?(?:bis|ter|quater))?,? {FRENCH_STREET} (?:(?:de la|de l['’]|des|du|de|d['’]|la|le|les|aux|au) ?)?{CAP}(?:[ -](?:de |du |des |la |le |les )?{CAP})*(?:, (?:appt?\.?|bât\.?|étage) ?\w+)?(?:, \d{{5}} {TOWN}|, {TOWN})?"
SPANISH_STREET = r"(?:Calle|C/|C\.|Avda\.?|Avenida|Av\.|Paseo|P\.º|Plaza|Pza\.?|Camino|Carretera|Ctra\.?|Ronda|Travesía|Callejón|Cuesta|Glorieta)"
SPANISH = rf"{SPANISH_STREET} (?:(?:del|de la|de los|de las|de|la|el|los|las) )?{CAP}(?: (?:(?:del|de|la|los|las|y) )*{CAP})*,? (?:n\.?º ?)?\d{{1,4}}[a-z]?(?:, \d{{1,2}}\.?[ºª°](?: ?[A-Z]\b| ?(?:izq|dcha)\.?)?)?(?:, \d{{5}} {TOWN}|, {TOWN})?"
ADDRESS = re.compile(rf"(?<![\w./])(?<![^\r\n][+-])(?:{SPANISH}|{FRENCH}|{GERMAN}|{ENGLISH})")
AFTER_STREET = r"\b\.?[,\"'\s)]"
ADDRESS_TRIGGER = re.compile(
    r"[SRLWCTBADPGHMQYIUZV](?:(?:(?<=S)(?:treet|t|quare|q)|(?<=R)(?:oad|d|ow|ise)|(?<=L)(?:ane|n)|(?<=W)(?:ay|alk|harf)|(?<=C)(?:lose|ourt|t|resc|rescent|ircle)|(?<=T)(?:errace|er|rail)"
    r"|(?<=B)(?:oulevard|lvd)|(?<=A)(?:venue|ve)|(?<=D)(?:rive|r)|(?<=P)(?:lace|l|arade|arkway)|(?<=G)(?:ardens|dns|rove|reen)|(?<=H)(?:ill|ighway|wy)|(?<=M)ews|(?<=Q)uay|(?<=Y)ard)" + AFTER_STREET +
    r"|(?:(?<=A)[mnu]f?|(?<=U)nter|(?<=I)[mn]|(?<=Z)u[mr]|(?<=H)inter|(?<=V)or|(?<=B)eim?) (?:der |den |dem )?[A-ZÄÖÜ][^\n\d]{2,30} \d{1,3}[a-z]?\b"
    r"|(?:(?<=C)(?:alle|/|\.|amino|arretera|tra\.?|allejón|uesta)|(?<=A)(?:vda\.?|venida|v\.)|(?<=P)(?:aseo|\.º|laza|za\.?)|(?<=R)onda|(?<=T)ravesía|(?<=G)lorieta) )"
)
WITHIN = [
    "straße ", "strasse ", "str. ", "weg ", "gasse ", "ring ", "allee ", "platz ", "damm ", "ufer ", "steig ", "pfad ", "markt ", "graben ", "Straße ", "Str. ", "Weg ", "Gasse ", "Ring ", "Allee ", "Platz ",
    " rue ", " place ", " impasse ", " avenue ", " chemin ", " boulevard ", " bd ", " allée ", " quai ", " cours ", " passage ", " square ", " route ", " ruelle ",
]
"""Endings of German street names and French kinds of street; a line with one of them is looked at."""
PLACED = re.compile(r"(?:(?:ship|bill|send|deliver)_?to|address|addr|street|adresse|anschrift|direccion|dirección)[\"']?\s*[:=]\s*(?P<q>[\"'])(?P<v>[^\"\n]*\d[^\"\n]*?)(?P=q)|\bVALUES ?\((?:[^'\n]|'(?:[^'\n]|'')*'(?= ?,))*'(?P<w>(?:(?!' ?[,)])[^\n])*)' ?\)", re.I)

# ---- names in places where only a person can stand ----

LETTER = r"[A-ZÀ-ÖØ-ÞĀ-ſ]"
NAME_WORD = rf"{LETTER}(?:[^\W\d_]|['’])*(?:-{LETTER}[^\W\d_]*)*\.?"
PARTICLE = rf"(?:(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))}) )?"
FULL = rf"{NAME_WORD}(?: {PARTICLE}{NAME_WORD}){{1,3}}|{PARTICLE}{NAME_WORD}, {NAME_WORD}"
TRAILERS = r"(?:[A-Z][a-z]+(?:-[a-z]+)*-by|Author|Committer|Co-authored-by|From|Cc|To|Reply-To|maintainer|owner|Thanks-to)"
ROLES = "applicant|author|assignee|candidate|client|contact|customer|employee|member|owner|patient|person|recipient|resident|reviewer|signatory|subscriber|tenant|user"
"""Names of calls whose text is a person (fixed values)."""
PLACE = re.compile(
    rf"(?<![^\r\n])[ \t+-]*{TRAILERS}: *(?P<a>{FULL})(?= *(?:<|\r|\n|$))|Copyright (?:\(c\)|©) \d{{4}}(?:-\d{{4}})?,? (?P<b>{FULL})(?= *(?:\r|\n|$))"
    rf"|@author (?P<c>{FULL})(?= *(?:\r|\n|<|$))|\bTODO\((?P<d>{FULL})\)|\"name\": \"(?P<e>{FULL})\"|\b(?:{ROLES})\(\"(?P<f>{FULL})\""
)
PLACES = ["-by: ", "Author: ", "Committer: ", "From: ", "Cc: ", "To: ", "maintainer: ", "owner: ", "Thanks-to: ", "Copyright ", "@author ", "TODO(", '"name": ', *(f'{role}("' for role in ROLES.split("|"))]
ROBOT = re.compile(r"\b(?:bot|robot|ci|sync|build|release|format|nightly|automation|pipeline|team|group|inc|ltd|gmbh|project|authors|contributors)\b|\[bot\]", re.I)

BINARY = re.compile(r"GIT binary patch[\s\S]*?(?=[\r\n]diff --git|\Z)")

KINDS = ("email", "address", "idnum", "phone", "name")


class Detector:
    """Finds personal items; ``people`` are full names the model of names is fitted on (may be empty)."""

    def __init__(self, people: list[str]):
        self.names = NameModel(people)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of all items, in order, without overlaps."""
        if not text:
            return []
        found: list[tuple[int, int, str]] = []
        if "@" in text:
            found += _emails(text)
        found += _disguised(text)
        found += _addresses(text)
        found += _numbers(text)
        found += self._names(text)
        if "GIT binary patch" in text:
            parts = [m.span() for m in BINARY.finditer(text)]
            found = [f for f in found if not any(a <= f[0] < b for a, b in parts)]
        if len(found) < 2:
            return found
        order = {k: i for i, k in enumerate(KINDS)}
        found.sort(key=lambda f: (order[f[2]], f[0], -f[1]))
        taken: list[tuple[int, int, str]] = []
        for f in found:
            if all(f[1] <= a or b <= f[0] for a, b, _ in taken):
                taken.append(f)
        return sorted(taken)

    def _names(self, text: str) -> list[tuple[int, int, str]]:
        out = []
        if self.names.word is not None:
            for a, b in _lines(text, self.names.word):
                out += [(m.start(), m.end(), "name") for m in self.names.pattern.finditer(text, a, b)]
        for line in _lines_with(text, PLACES):
            for m in PLACE.finditer(text, *line):
                k = m.lastgroup
                start, end = m.span(k)
                if not ROBOT.search(m.group(k)):
                    inside = [x for x in out if start <= x[0] and x[1] <= end]
                    if sum(x[1] - x[0] for x in inside) < end - start and not any(a < end and start < b for a, b, _ in out if not (start <= a and b <= end)):
                        out = [x for x in out if x not in inside] + [(start, end, "name")]
        return out


def _lines(text: str, trigger: re.Pattern) -> list[tuple[int, int]]:
    """Borders of the lines that a trigger is found in."""
    out = []
    at = 0
    while (m := trigger.search(text, at)) is not None:
        out.append(_border(text, m.start(), m.end()))
        at = max(out[-1][1], m.end())
    return out


def _starts_line(text: str, at: int) -> bool:
    return not at or text[at - 1] in "\r\n"


def _border(text: str, start: int, end: int) -> tuple[int, int]:
    a = max(text.rfind("\n", 0, start), text.rfind("\r", 0, start)) + 1
    ends = [x for x in (text.find("\n", end - 1), text.find("\r", end - 1)) if x >= 0]
    return a, min(ends) if ends else len(text)


def _lines_with(text: str, words: list[str]) -> list[tuple[int, int]]:
    """Borders of the lines that hold one of the words, each once, in order."""
    out = set()
    for word in words:
        at = text.find(word)
        while at >= 0:
            line = _border(text, at, at + len(word))
            out.add(line)
            at = text.find(word, max(line[1], at + 1))
    return sorted(out)


def _before(text: str, end: int, pattern: re.Pattern) -> str:
    """What ``pattern``, which takes a run of characters up to the end, finds right before ``end``; however long, and in time in proportion to its length."""
    size = 64
    while True:
        start = max(0, end - size)
        m = pattern.search(text[start:end])
        if m is None:
            return ""
        if m.start() or not start:
            return m.group()
        size *= 4


WORD_RUN = re.compile(r"[^\s@]+\Z")
SPACE_RUN = re.compile(r"[ \t]+\Z")
TOKEN_RUN = re.compile(r"\S+\Z")


def _is_login(text: str, start: int) -> bool:
    """Whether what starts here stands in the user's place of a network address or of a command that logs in."""
    if "://" in _before(text, start, WORD_RUN):
        return True
    while space := _before(text, start, SPACE_RUN):
        word = _before(text, start - len(space), TOKEN_RUN)
        if not word.startswith("-"):
            return re.search(r"\w*\Z", word).group() in LOGIN_COMMANDS
        start -= len(space) + len(word)
    return False


def _emails(text: str) -> list[tuple[int, int, str]]:
    out = []
    at = text.find("@")
    while at >= 0:
        here, at = at, text.find("@", at + 1)
        if not here or not (text[here - 1].isalnum() or text[here - 1] in "_+-"):
            continue
        host, first = EMAIL_HOST.match(text, here), "[A-Za-z0-9]"
        if host is None:
            host, first = FOREIGN_HOST.match(text, here), r"[^\W_]"
        if host is None or not (local := re.search(first, run := _before(text, here, LOCAL_RUN))):
            continue
        name = run[local.start() :]
        a, b = here - len(name), host.end()
        before = text[a - 1 : a] if a else ""
        if NOBODY.match(name) or name == "git" or before in ("@", "/") or _is_login(text, a):
            continue
        if LOGIN_AFTER.match(text, b) and text[max(0, a - 7) : a] != "mailto:":
            continue
        out.append((a, b, "email"))
    return out


def _disguised(text: str) -> list[tuple[int, int, str]]:
    out = []
    for a, b in _lines_with(text, DISGUISES):
        for m in DISGUISED.finditer(text, a, b):
            local = m.group("local")
            if NOBODY.match(local):
                continue
            # words around a plain "at" are an address only where one is announced or the local part looks like one
            if m.group("plain") and not (re.search(r"[\d._+-]", local) or OPENED.search(text[max(a, m.start() - 12) : m.start()])):
                continue
            out.append((*m.span(), "email"))
    return out


def _numbers(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in DIGITS.finditer(text):
        a, b = m.span()
        if a and (text[a - 1].isalnum() or text[a - 1] in "_.@#" or (text[a - 1] in "+-" and not _starts_line(text, a - 1))):
            continue
        if text[a] == "+" and _starts_line(text, a) and NATIONAL.fullmatch(text[a + 1 : b]):
            a += 1  # a diff's mark, not a prefix
        value = text[a:b].rstrip(" .-(/")
        if value[0] == "(" and ")" not in value:
            a, value = a + 1, value[1:]
        for kind in ("idnum", "phone"):
            hit = _number(value, kind)
            if hit:
                end = a + len(hit)
                after = text[end : end + 2]
                if after[:1].isalnum() or after[:1] == "_" or (after[:1] in "-." and after[1:].isalnum()):
                    continue
                if kind == "phone" and (x := EXTENSION.match(text, end)):
                    end = x.end()
                out.append((a, end, kind))
                break
    out += [(*m.span(), "idnum") for m in LETTERED.finditer(text) if not (m.start() and (text[m.start() - 1] in "_./" or (text[m.start() - 1] == "-" and not _starts_line(text, m.start() - 1))))]
    for a, b in _lines_with(text, LABELS):
        out += [(*m.span("v"), "idnum") for m in LABELLED.finditer(text, a, b) if sum(map(str.isdigit, m.group("v"))) >= 6]
    return out


@lru_cache(1 << 16)
def _number(value: str, kind: str) -> str | None:
    """The part of a run of digits and separators, from its start, that is a number of the kind."""
    if kind == "idnum":
        return value if any(p.fullmatch(value) for p in IDENTITY) else None
    digits = sum(map(str.isdigit, value))
    if not 9 <= digits <= 15 or not PHONE.fullmatch(value):
        return None
    return value


def _addresses(text: str) -> list[tuple[int, int, str]]:
    out = []
    lines = _lines(text, ADDRESS_TRIGGER)
    lines += [x for x in _lines_with(text, WITHIN) if x not in lines]
    for a, b in lines:
        # a place that can only hold an address gives its whole value
        whole = [m.span("v") if m.group("v") else m.span("w") for m in PLACED.finditer(text, a, b)]
        out += [(s, e, "address") for s, e in whole if ADDRESS.search(text, s, e)]
        out += [(m.start(), m.end(), "address") for m in ADDRESS.finditer(text, a, b) if not any(s <= m.start() < e for s, e in whole)]
    return out


@lru_cache(2)
def detector(people: tuple[str, ...]) -> Detector:
    """The detector of a list of people, built once in each worker process."""
    return Detector(list(people))
