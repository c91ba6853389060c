"""Personal data: detection and keyed surrogates.

Each entity is replaced by the outcome of a keyed permutation of all strings of its type and format: a
Feistel network over its characters, each within its own class (digits, hexadecimal digits, vowels
and consonants by script and case, and for other letters those of the same script and block).  So replacements keep length,
punctuation, script, case and, for names, the last letter, which carries gender in many languages; names from the
lexicon stay within their gender's list, and other given names have a permutation for each gender that a title tells.
The network stands between a step to the next string and its own inverse, so that no string is replaced by itself.
A permutation maps different entities to different surrogates, and equal entities to equal ones in
all documents, without a table of them.  Where a surrogate would break its type (a card number whose checksum
changes, a name that falls into the lexicon), the permutation is applied again, which keeps it one to one; check digits
of an account number are computed anew.  Every other mention of a found name in its text is replaced too.
Distinctness is checked within each text as it is rewritten, and by ``checked`` over the corpus.

Who has the key can undo all surrogates, so it comes from the caller.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import materialise, slices

ROUNDS = 6
ENTITIES = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("surrogate", pa.string())]))
KINDS = ("email", "phone", "card", "ssn", "iban", "ipv6", "ip", "secret", "name")

#: Honorifics by the gender they tell, and given names by gender.
HONORIFICS = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "господин", "г-н", "κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Signora", "госпожа", "г-жа", "κυρία"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    "m": ("Adam", "Albert", "Carlos", "Daniel", "David", "Edward", "Felix", "Frank", "Georg", "Henri", "Hugo", "Ivan", "James", "Javier", "John", "Joseph", "Karl", "Louis", "Lucas", "Marco", "Mark", "Martin", "Michael", "Miguel", "Oliver", "Oscar", "Paul", "Peter", "Pierre", "Robert", "Simon", "Stefan", "Thomas", "Victor", "Walter", "William"),
    "f": ("Alice", "Amelia", "Anna", "Barbara", "Carmen", "Clara", "Claire", "Diana", "Elena", "Elizabeth", "Emma", "Eva", "Greta", "Hannah", "Helen", "Ines", "Irene", "Jane", "Julia", "Karen", "Laura", "Linda", "Lucia", "Margaret", "Maria", "Marie", "Martha", "Mary", "Nina", "Olivia", "Paula", "Rosa", "Sarah", "Sofia", "Susan", "Teresa"),
}
#: Classes of letters within which a surrogate's letters stay.
CLASSES = (
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "áàâäãåéèêëíìîïóòôöõúùûü",
    "çñ",
    "аеиоуыэюя",
    "бвгджзклмнпрстфхцчшщ",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψ",
)
#: Scripts of many letters: each is one class.
RANGES = ((0x4E00, 0x9FA5), (0x3041, 0x3094), (0x30A1, 0x30F4), (0xAC00, 0xD7A3), (0x05D0, 0x05EA), (0x0621, 0x063A), (0x0905, 0x0939))

_ANY = "|".join(re.escape(h) for hs in HONORIFICS.values() for h in sorted(hs, key=len, reverse=True))


def marks() -> str:
    """Combining marks, as a character class's ranges."""
    at = [c for c in range(0x300, 0x3100) if unicodedata.category(chr(c))[0] == "M"]
    ends = [i for i in range(len(at)) if i + 1 == len(at) or at[i + 1] != at[i] + 1]
    return "".join(f"{chr(at[a])}-{chr(at[b])}" for a, b in zip([0, *(e + 1 for e in ends)], ends))


_NAME = rf"[^\W\d_][\w'’{marks()}-]*"
_COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d\d)"
_GAPS = r"(?:[ ./-]|[ -]?\(|\)[ -]?)?"  # between two digits of a phone number
PHONES = (
    # international: 7 to 15 digits, 11 with country code 1
    rf"(?<![\w.])(?:\+|00(?=[1-9]\d{{0,2}}[ .-]))(?:1{_GAPS}[2-9](?:{_GAPS}\d){{9}}|[2-9](?:{_GAPS}\d){{6,14}})(?![\w-])",
    r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])",
    # national: pairs, threes and pairs, an area and an unbroken number, all unbroken
    r"(?<![\w.:/+-])(?<!\b\d\d[ .])0[1-9](?:[ .-]\d\d){4}(?![\w-]|[ .]\d\d(?!\d))",
    r"(?<![\w.:/+-])0[1-9]\d[ .-]\d{3}[ .-]\d\d[ .-]\d\d(?![\w-])",
    r"(?<![\w.:/+-])(?:\(\d{2,5}\)[ .-]?|0[1-9]\d{0,3}[ /-])\d{5,9}(?![\w-]|[.,:]\d)",
    r"(?<![\w.:/+-])0[1-9]\d{8,9}(?![\w-]|[.,:]\d)",
)
_INITIAL = r"[^\W\d_]\."
PATTERNS: tuple[tuple[str, re.Pattern], ...] = (
    ("email", re.compile(r"(?<![\w.%+-])[\w%+-][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    ("secret", re.compile(r"(?i:\b(?:token|secret|password|passwd|api[_ -]?key|access[_ -]?key)\b\s*[=:]\s*[\"']?)([A-Za-z0-9_\-/+]{8,})|(?<![\w-])((?=[0-9a-fA-F]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,}))(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.+-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("ipv6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f]{1,4}|(?<=::))(?!\w|:[\w:]|\.\d)")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")),
    ("phone", re.compile("|".join(PHONES))),
    ("name", re.compile(rf"(?<!\w)(?:{_ANY})\.?\s+((?:{_INITIAL}\s*)*{_NAME}(?:\s+(?:{_INITIAL}\s*)*{_NAME})?)")),
)
#: What a text must contain for a pattern to be tried.
HINTS: dict[str, Callable[[str], bool]] = {
    "email": lambda t: "@" in t,
    "ipv6": lambda t: t.count(":") > 1,
    "name": lambda t: _HAS_NAME.search(t) is not None,
}
_HAS_NAME = re.compile(rf"(?<!\w)(?:{_ANY})\.?\s")
_HAS_DIGIT = re.compile(r"\d")
_PART = re.compile(rf"{_INITIAL}|{_NAME}")
_TAIL = re.compile(r"(?:['’][sS])?['’-]*$")  # a possessive's ending
_CAPITALISED = re.compile(rf"(?<!\w)(?![a-z]){_NAME}")  # or of a script without case, which is_name tells
_GAP = re.compile(r"\s+")
_UNSPACED = re.compile(r"[\u0e01-\u0e4e\u4e00-\u9fa5\u3041-\u3094\u30a1-\u30f4\uac00-\ud7a3]{2,}")  # of scripts that don't part words


def is_name(word: str) -> bool:
    return word[:1].isupper() or unicodedata.category(word[0]) == "Lo"


def is_ipv6(value: str) -> bool:
    """Whether it is an address of two groups at least and a digit, which a mere '::' or '::add' isn't."""
    if not _HAS_DIGIT.search(value) or sum(map(bool, value.split(":"))) < 2:
        return False
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return True


def name_end(value: str) -> int:
    """Where a name ends of the words that follow an honorific; 0 if there is none."""
    end = 0
    for m in _PART.finditer(value):
        if not is_name(m.group()):
            break
        bare = _TAIL.sub("", m.group())
        end = m.start() + len(bare)
        if bare != m.group():
            break
    return end


def mentions(text: str, names: dict[str, str], taken: bytearray) -> list[tuple[int, int, str]]:
    """Where words of found names, lower-cased and with their genders, stand in a text, ``taken`` places left out.

    A given name of the lexicon before one belongs to the name, and so is a word of it.
    """
    known = given_names()
    hits: list[tuple[int, int, str]] = []
    more: dict[str, str] = {}
    before: tuple[int, int] | None = None  # a given name that may belong to what follows
    for m in _CAPITALISED.finditer(text):
        if not is_name(m.group()):
            continue
        whole = _TAIL.sub("", m.group())
        at, found = m.start(), []
        for w in [whole] if whole.lower() in names else re.split("(['’-])", whole):
            if w.lower() in names and is_name(w):
                found.append((at, at + len(w), names[w.lower()]))
            at += len(w)
        if found and found[0][0] == m.start() and before and _GAP.fullmatch(text, before[1], m.start()):
            more[text[slice(*before)].lower()] = found[0][2]
        hits += found
        before = (m.start(), m.start() + len(whole)) if whole.lower() in known and whole.lower() not in names else None
    if more:
        return mentions(text, names | more, taken)
    for w in names:
        if _UNSPACED.fullmatch(w):
            hits += [(m.start(), m.end(), names[w]) for m in re.finditer(w, text)]
    joined: list[tuple[int, int, str]] = []
    for a, b, g in sorted(h for h in hits if not any(taken[h[0] : h[1]])):
        if joined and joined[-1][1] < a and _GAP.fullmatch(text, joined[-1][1], a):
            joined[-1] = (joined[-1][0], b, g)
        elif not joined or a >= joined[-1][1]:
            joined.append((a, b, g))
    return joined


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Entities as (start, end, kind, gender), in order and without overlap; earlier kinds go first."""
    digits = _HAS_DIGIT.search(text) is not None
    found: list[tuple[int, int, str, str]] = []
    names: dict[str, str] = {}
    taken = bytearray()

    def add(a: int, b: int, kind: str, gender: str) -> bool:
        nonlocal taken
        taken = taken or bytearray(len(text))
        free = not any(taken[a:b])
        if free:
            found.append((a, b, kind, gender))
            taken[a:b] = b"\1" * (b - a)
        return free

    for kind, pattern in PATTERNS:
        if kind in HINTS and not HINTS[kind](text) or kind not in ("email", "name", "secret") and not digits:
            continue
        for m in pattern.finditer(text):
            group = m.lastindex or 0
            a, b = m.span(group)
            gender = ""
            if kind == "ipv6" and not is_ipv6(text[a:b]):
                continue
            if kind == "name":
                b = a + name_end(text[a:b])
                if a == b:
                    continue
                title = m.group()[: a - m.start()].strip().rstrip(".")
                gender = next((g for g, hs in HONORIFICS.items() if title in hs), "n")
            if add(a, b, kind, gender) and kind == "name":
                words = [w.lower() for w in _PART.findall(text[a:b]) if len(w) > 1 and not w.endswith(".")]
                names |= {w: names.get(w, "") for w in words}
                if len(words) > 1 and gender != "n":
                    names[words[0]] = names[words[0]] or gender  # a given name, by the first title that tells
    if names:
        for a, b, gender in mentions(text, names, taken):
            add(a, b, "name", gender)
    # of each name the genders of its words, which are one through the text but for what its own title tells
    return sorted((a, b, kind, genders(text[a:b], gender, names) if kind == "name" else gender) for a, b, kind, gender in found)


def genders(name: str, titled: str, names: dict[str, str]) -> str:
    """For each word of a name m or f if it is a given name of known gender, else -."""
    words = re.findall(r"\S+", name)
    out = [names.get(_TAIL.sub("", w).lower(), "") for w in words]
    if len(words) > 1 and out[0] and titled in ("m", "f"):
        out[0] = titled
    return "".join(g or "-" for g in out)


@functools.lru_cache(maxsize=1)
def letters() -> dict[str, tuple[int, int, str]]:
    """Of each character: class, index in it, and the class's letters."""
    classes = [*CLASSES, *("".join(map(chr, range(a, b + 1))) for a, b in RANGES)]
    known = {c for chars in classes for c in chars}
    more: dict[tuple, str] = {}  # letters of the same script and case in a block of 128
    for code in range(0x80, 0x30000):
        c = chr(code)
        kind = unicodedata.category(c)
        if c in known or kind not in ("Ll", "Lo") or kind == "Ll" and not (len(c.upper()) == 1 and c.upper().lower() == c):
            continue
        place = (unicodedata.name(c, "").split(" ")[0], kind, code >> 7)
        more[place] = more.get(place, "") + c
    return {c: (k, i, chars) for k, chars in enumerate([*classes, *(chars for chars in more.values() if len(chars) > 1)]) for i, c in enumerate(chars)}


def shifts(key: bytes, tweak: str, other: list[int], n: int) -> Iterator[int]:
    """A keyed stream of n numbers that depends on the other half."""
    seed = tweak.encode() + b"|" + ",".join(map(str, other)).encode()
    block = b""
    for i in range(n):
        if i % 8 == 0:
            block = hashlib.blake2b(seed + b"|%d" % (i // 8), key=key, digest_size=64).digest()
        yield int.from_bytes(block[i % 8 * 8 : i % 8 * 8 + 8], "big")


def network(values: list[int], radix: list[int], key: bytes, tweak: str, back: bool = False) -> list[int]:
    """A keyed permutation of all number strings of these radixes, or its inverse: each half is shifted by a function of the other."""
    half = (len(values) + 1) // 2
    halves, limits = [values[:half], values[half:]], [radix[:half], radix[half:]]
    sign = -1 if back else 1
    for r in sorted(range(ROUNDS), reverse=back):
        k = r % 2
        halves[k] = [(v + sign * s) % m for v, m, s in zip(halves[k], limits[k], shifts(key, f"{tweak}/{r}", halves[1 - k], len(halves[k])))]
    return halves[0] + halves[1]


def permute(values: list[int], radix: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of all number strings of these radixes that leaves none where it is, if there are two at least."""
    out = network(values, radix, key, tweak)
    for i, m in enumerate(radix):  # the next string, round and round
        out[i] = (out[i] + 1) % m
        if out[i]:
            break
    return network(out, radix, key, tweak, back=True)


def permute_text(text: str, key: bytes, tweak: str, keep: Callable[[int, str], bool] = lambda i, c: False) -> str:
    """Each letter and digit within its class; case, other characters and those that ``keep`` names stay."""
    table = letters()
    at = [(i, *table[c.lower()]) for i, c in enumerate(text) if c.lower() in table and len(c.lower()) == 1 and (c.lower() == c or c.lower().upper() == c) and not keep(i, c)]
    # without the case of what stays, so that coreference ignores it
    form = "".join("\1" if j else c.lower() for c, j in zip(text, _mask(len(text), [a[0] for a in at])))
    new = permute([a[2] for a in at], [len(a[3]) for a in at], key, f"{tweak}|{'.'.join(str(a[1]) for a in at)}|{form}")
    out = list(text)
    for (i, _, _, chars), v in zip(at, new):
        c = chars[v]
        up = c.upper()
        out[i] = up if text[i] != text[i].lower() and len(up) == 1 else c
    return "".join(out)


def _mask(n: int, at: list[int]) -> list[bool]:
    out = [False] * n
    for i in at:
        out[i] = True
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def walk(value: str, step: Callable[[str], str], fits: Callable[[str], bool]) -> str:
    """Apply a permutation until its outcome fits as ``value`` does: one to one on the values that fit."""
    out = step(value)
    while not fits(out):
        out = step(out)
    return out


@functools.lru_cache(maxsize=8)
def lexicon(key: bytes, gender: str) -> dict[str, str]:
    """A keyed cyclic order of a gender's given names: each name's successor replaces it."""
    names = sorted(GIVEN[gender], key=lambda n: hashlib.blake2b(n.encode(), key=key, digest_size=16).digest())
    return dict(zip(names, names[1:] + names[:1]))


@functools.lru_cache(maxsize=1)
def given_names() -> dict[str, str]:
    return {n.lower(): g for g, ns in GIVEN.items() for n in ns}


def cased(like: str, name: str) -> str:
    return name.upper() if like.isupper() and len(like) > 1 else name.lower() if like.islower() else name


def new_name(word: str, key: bytes, gender: str = "-") -> str:
    """For a word of a name; ``gender`` is m or f for a given name."""
    known, tweak = given_names(), f"name{gender.strip('-')}"
    listed = known.get(word.lower())
    if listed:
        return cased(word, lexicon(key, listed)[word.capitalize()])
    last = len(word) - 1 if len(word) > 3 else -1
    return walk(word, lambda w: permute_text(w, key, tweak, lambda i, c: i == last), lambda w: w.lower() not in known)


def new_ipv6(value: str, key: bytes) -> str:
    """An address whose groups of zero are where they were, written alike; of all spellings of an address equal ones."""
    packed = ipaddress.IPv6Address(value).packed
    groups = [int.from_bytes(packed[i : i + 2], "big") for i in range(0, 16, 2)]
    at = [i for i, g in enumerate(groups) if g]
    for i, v in zip(at, permute([groups[i] - 1 for i in at], [0xFFFF] * len(at), key, f"ipv6{at}")):
        groups[i] = v + 1
    head, gap, tail = value.partition("::")
    sides = [[p for p in side.split(":") if p] for side in (head, tail)]
    width = lambda side: sum(1 + ("." in p) for p in side)
    out = []
    for side, rest in zip(sides, (iter(groups), iter(groups[8 - width(sides[1]) :]))):
        new = []
        for p in side:
            g = next(rest)
            if "." in p:
                low = next(rest)
                new.append(f"{g >> 8}.{g & 255}.{low >> 8}.{low & 255}")
            else:
                new.append(f"{g:0{len(p) if p[0] == '0' else 1}x}")
        out.append(":".join(new))
    text = gap.join(out) if gap else out[0]
    return text.upper() if value != value.lower() else text


def iban_check(country: str, rest: str) -> str:
    """The two check digits of an account number."""
    digits = "".join(str(int(c, 36)) for c in f"{rest}{country}00".upper())
    return f"{98 - int(digits) % 97:02d}"


def surrogate(value: str, kind: str, gender: str = "", *, key: bytes) -> str:
    """The replacement of an entity, which is never the entity itself.  ``gender`` has a letter for each word of a name."""
    new = _surrogate(value, kind, gender, key)
    # what holds no letter or digit that can be changed
    return new if new != value else f"{kind}-{hashlib.blake2b(value.encode(), key=key, digest_size=8).hexdigest()}"


def _surrogate(value: str, kind: str, gender: str, key: bytes) -> str:
    if kind == "email":
        local, _, domain = value.rpartition("@")
        head, _, top = domain.rpartition(".")
        # case is set again afterwards, so that coreference ignores it
        return f"{permute_text(local, key, 'local')}@{'.'.join(permute_text(x, key, 'domain') for x in head.split('.'))}.{top}"
    if kind == "card":
        plain = re.sub(r"\D", "", value)
        good = luhn(plain)
        new = iter(walk(plain, lambda v: permute_text(v, key, "card"), lambda v: luhn(v) == good))
        return re.sub(r"\d", lambda _: next(new), value)
    if kind == "ip":
        return ".".join(map(str, permute([int(x) for x in value.split(".")], [256] * 4, key, "ip")))
    if kind == "ipv6":
        return new_ipv6(value, key)
    if kind == "phone":
        country = re.match(rf"(?:\+|00){_COUNTRY}(?=\D*\d)|\(?0+(?=\D*[1-9])", value)
        fixed = country.end() if country else 0
        plain = re.sub(r"\D", "", value[fixed:])
        prefix = re.sub(r"\D", "", value[:fixed]) if "+" not in value else value[:fixed]
        # a first digit 0 or 1 stays one, and no other becomes one: some plans forbid them
        new = iter(walk(plain, lambda v: permute_text(v, key, f"phone{prefix}"), lambda v: min(v[0], "2") == min(plain[0], "2")))
        return value[:fixed] + re.sub(r"\d", lambda _: next(new), value[fixed:])
    if kind == "iban":
        plain = value.replace(" ", "")
        country, check, rest = plain[:2], plain[2:4], plain[4:]
        if iban_check(country, rest) == check:
            rest = permute_text(rest, key, f"iban{country}")
            new = iter(country + iban_check(country, rest) + rest)
        else:
            step = lambda v: permute_text(v, key, "account", lambda i, c: i < 2)
            new = iter(walk(plain, step, lambda v: iban_check(v[:2], v[4:]) != v[2:4]))
        return "".join(c if c == " " else next(new) for c in value)
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        new = "".join("0123456789abcdef"[v] for v in permute([int(c, 16) for c in value], [16] * len(value), key, f"hex{len(value)}"))
        return new if value == value.lower() else new.upper()
    if kind == "name":
        each = iter(gender)
        return re.sub(r"\S+", lambda m: new_name(m.group(), key, next(each, "-")), value)
    return permute_text(value, key, kind)


def replace(text: str, key: bytes, found: list[tuple[int, int, str, str]] | None = None) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and its entities as (kind, value, surrogate)."""
    out, done, pairs = [], 0, []
    back: dict[tuple[str, str], str] = {}
    for a, b, kind, gender in find(text) if found is None else found:
        value = text[a:b]
        new = surrogate(value, kind, gender, key=key)
        while back.setdefault((kind, new), value).lower() != value.lower():  # taken by another entity
            new = surrogate(new, kind, gender, key=key)
        pairs.append((kind, value, new))
        out += [text[done:a], new]
        done = b
    return "".join([*out, text[done:]]), pairs


def replace_pii(docs: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents: key, ``text`` with surrogates, ``n_entities``, ``kinds`` (a comma-separated list), ``entities``.

    ``entities`` lists kind, value and surrogate of each occurrence; keep it apart from the texts.

    null text: stays null, without entities.  Empty text: as it is.  Very long texts are taken whole.  Where
    patterns overlap, the first in KINDS' order of detection holds.  A name is found by an honorific before it: initials and
    up to two words; then all its words, capitalised, are replaced in the whole text.  Repeated rows give a row each; a null key
    is kept.  Other columns aren't read.  Empty table: empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{text}` string, n_entities bigint, kinds string, entities array<struct<kind:string,value:string,surrogate:string>>"

    def run(batches):
        for part in slices(batches):
            new, pairs = [], []
            for t in part.column("text").to_pylist():
                own = find(t) if t else []
                done, found = replace(t, secret, own) if own else (t, [])
                new.append(done)
                pairs.append(found)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(key),
                    pa.array(new, pa.string()),
                    pa.array([len(p) for p in pairs], pa.int64()),
                    pa.array([",".join(sorted({x[0] for x in p})) for p in pairs], pa.string()),
                    pa.array([[dict(zip(("kind", "value", "surrogate"), x)) for x in p] for p in pairs], ENTITIES),
                ],
                [key, text, "n_entities", "kinds", "entities"],
            )

    return docs.select(key, docs[text].alias("text")).mapInArrow(run, schema)


def collisions(replaced: DataFrame) -> DataFrame:
    """Surrogates that stand for more than one value of a kind; empty, as permutations are one to one."""
    pairs = replaced.select(F.explode("entities").alias("e")).select("e.*").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("values")).where("values > 1")


def checked(replaced: DataFrame) -> DataFrame:
    """The outcome of ``replace_pii``, written once, after a check of all its surrogates; an error if two values share one."""
    done = materialise(replaced, "surrogates")
    clash = collisions(done).first()
    if clash:
        raise ValueError(f"{clash['values']} entities of kind {clash.kind} share a surrogate")
    return done


def anonymise(docs: DataFrame, secret: bytes, text: str = "text") -> DataFrame:
    """The documents, all columns as they are but ``text``, which has surrogates; they are checked over the corpus.

    null and empty texts stay, very long ones are taken whole, repeated rows give a row each, and columns of any name are kept.
    Empty table: empty result.
    """
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names that can't clash
    at = docs.columns.index(text)
    plain = docs.select(*(docs[c].alias(p) for c, p in place.items()))
    schema = T.StructType([*plain.schema.fields, *T.StructType.fromDDL("entities array<struct<kind:string,value:string,surrogate:string>>").fields])

    def run(batches):
        for part in slices(batches, place[text]):
            done = [replace(t, secret) if t else (t, []) for t in part.column(at).to_pylist()]
            columns = [*part.columns, pa.array([[dict(zip(("kind", "value", "surrogate"), x)) for x in pairs] for _, pairs in done], ENTITIES)]
            columns[at] = pa.array([new for new, _ in done], part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "entities"])

    return checked(plain.mapInArrow(run, schema)).select(*(F.col(p).alias(c) for c, p in place.items()))
