"""PII replaced by keyed surrogates.

Entities (e-mail addresses, phone numbers, IPv4 and IPv6 addresses, card numbers, IBANs, social security numbers and names) are found
in whole texts. A surrogate follows from the key, the entity's kind and its canonical value alone, so an entity has one surrogate
wherever it stands (coreference), and each part of a name its own. It keeps what the kind shows: a number's punctuation, country code,
issuer digit and validity by check digits, an address's range, a name's script, gender and case.

Distinctness. Numbers move within the finite space of their format (``moved``): a keyed permutation without fixed points, so no two can
meet and none stays, even where a corpus uses every value of a format. The price is that a surrogate number may be another entity's old
number. Names, mail domains and the local parts of mail addresses are drawn from an endless supply, and checked over the corpus: the
distinct entities (never the texts) are gathered, and one whose surrogate another entity has, or that is itself an entity of the
corpus, tries its next one, round by round, until none collides; each second try is a syllable longer, so that this ends for any number
of entities. Entities that are not on their first try are ``overrides``; they are rare, and they are broadcast while at most
``BROADCAST_OVERRIDES``; beyond that each row's own overrides are joined to it.

Names are found after a form of address, and as a known given name before a capitalised word. Later in the text each part alone is a
mention too, but for a word that begins a sentence and is also an ordinary one (``Will``). A given name after a title that shows no
gender takes the gender that another title in the text shows for it. Names in other places are left: there is no list of all names.

Phone numbers are: + and 8 to 15 digits, in one run or in groups; national numbers with a trunk 0 and 9 to 12 digits, ten bare
digits that 0 or 1 does not lead, and 3-3-4 groups. Thousands after + and three digits that are no country code, decimal fractions,
dates and other bare runs are spared; national numbers without a trunk 0 in other groups (912 345 678) cannot be told from plain numbers and stay.

Defined results: null and empty texts stay as they are; texts without entities stay; repeated rows are
changed alike; an empty table gives no rows; all columns stay. Text between entities is never changed.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common

#: The key of the registered query and of the pipeline; a real job passes its own.
DEMO_KEY = b"bidloom demonstration key"
BROADCAST_OVERRIDES = 100_000
#: Kinds whose surrogates are drawn and checked; all others are permuted within their format.
DRAWN = ("email", "domain", "name", "namem", "namef", "nameu")
FEISTEL_ROUNDS = 6

# Forms of address by the gender that they show.
TITLES = {
    "m": "Mr Mister Herr Señor Sr Don Monsieur Sir Signor Господин Κύριος",
    "f": "Mrs Ms Miss Frau Señora Sra Señorita Doña Madame Mme Mlle Mademoiselle Signora Госпожа Κυρία",
    "u": "Dr Prof Professor Doctor Docteur Doctora Доктор",
}
# Syllables of surrogate names by script; the ends of given names by gender.
SYLLABLES = {
    "LATIN": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo".split(),
    "CYRILLIC": "ба бе бо да де до фа га го ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве во зу".split(),
    "GREEK": "βα βε βο δα δε δο φα φε γα γο κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε το ζα ζε ζο".split(),
}
ENDS = {
    "LATIN": {"m": "n", "f": "ia", "u": "l", "": "r"},
    "CYRILLIC": {"m": "н", "f": "ия", "u": "л", "": "р"},
    "GREEK": {"m": "ν", "f": "ια", "u": "λ", "": "ρ"},
}

# Common given names by gender, without those that are ordinary words too.
GIVEN = {
    "m": (
        "Alexander Andrew Anthony Antonio Benjamin Carlos Charles Christopher Daniel David Diego Dmitri Edward Fernando François Friedrich George Gerhard "
        "Giovanni Günther Hans Heinrich Henry Ivan Jakob James Jason Javier Jean Jeffrey Johann John Jonathan Jorge José Joseph Joshua Juan Jürgen Karl "
        "Kenneth Klaus Kevin Lars Luis Manuel Marco Matthew Michael Miguel Nicholas Olivier Pablo Patrick Paul Pedro Peter Philippe Pierre Richard Robert "
        "Ronald Sergei Stefan Stephen Steven Thomas Timothy Walter William Wolfgang"
    ),
    "f": (
        "Alice Amanda Ana Andrea Angela Anna Barbara Brigitte Camille Carmen Catherine Charlotte Christine Claudia Deborah Elena Elisabeth Elizabeth Emily "
        "Emma Erika Franziska Gabriele Hannah Heike Helen Ingrid Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Lucía Margaret Maria "
        "María Marie Martina Mary Melissa Monika Natalia Nicole Olga Patricia Petra Rachel Rebecca Renate Sabine Sandra Sarah Sofia Sophie Stephanie Susan "
        "Svetlana Teresa Ursula Valérie Vanessa Yvonne"
    ),
}
# Names that are also ordinary words at the start of a sentence.
ORDINARY = frozenset(
    "art best bill black brown chase cook day drew faith frank good grace grant green hope joy king little long major mark may miles pat price rich rob rose "
    "short small sue white will young".split()
)

_GENDER = {t.lower(): g for g, ts in TITLES.items() for t in ts.split()}
_UPPER = r"[^\W\d_a-zа-яα-ωßàâäæçèéêëîïñóôöùûüÿœíáú]"
_NAME = re.compile(rf"(?<!\w)({'|'.join(sorted(_GENDER, key=len, reverse=True))})\.?[  ]+((?-i:{_UPPER})[^\W\d_]+(?:-[^\W\d_]+)?)(?:[  ]+((?-i:{_UPPER})[^\W\d_]+(?:-[^\W\d_]+)?))?", re.I)
_PART = rf"(?-i:{_UPPER})[^\W\d_]+(?:-[^\W\d_]+)?"
_NAMES = {n: g for g, names in GIVEN.items() for n in names.split()}
_UNTITLED = re.compile(rf"(?<![\w.@-])({'|'.join(sorted(_NAMES, key=len, reverse=True))})[  ]+({_PART})")
_IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A)
_SENTENCE = re.compile(r"(?:\A|[.!?:;\n])[\s\"'»«„“”(]*\Z")
_LOCAL = re.compile(r"[\w.+-]{1,64}\Z")
_DOMAIN = re.compile(r"[^\W_][\w-]*(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)", re.A)
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)
_CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w]|[-.]\d)", re.A)
_PHONE = re.compile(r"(?<![\w.])(?:\+(\d{1,3})[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w]|-\d)|\+(\d{1,2})(?:[ .-]\d{2,4}){2,5}(?![\w]|-\d)", re.A)

# Further phone forms: + and groups, of which the first is a country code, or one run of 8 to 15 digits; national numbers with a
# trunk 0; and ten bare digits that 0 or 1 does not lead.
_PLUS = re.compile(r"(?<![\w+])\+(?:(\d{1,3})(?:[ ./-]?\(\d{1,5}\)[ ./-]?|[ ./-])\d{1,8}(?:[ ./-]\d{1,8})*|\d{1,3}\.\d{9,12}|\d{4,7}(?:[ ./-]\d{1,8})+|\d{8,15})(?!\w)", re.A)
_NATIONAL = re.compile(r"(?<![\w.,+/$€£-])(?!\d{3}-\d\d-\d{4}(?![\w-])|\d\d([ ./-])\d\d\1\d{4})(?:0\d{1,4}[ ./-]\d{2,8}(?:([ .-])\d{2,4}(?:\2\d{2,4}){0,3})?|0\d{9,10}|[2-9]\d{9})(?!\w|[.,/-]\d)", re.A)
_LONGER = re.compile(r"[ ./-]\d+\Z", re.A)
# Country codes of one and two digits, and the first two digits of those of three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_CODES_OF_3 = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())


def country_code(digits: str) -> str:
    """The country code at the start of an international number, empty where no country has it."""
    return next((digits[:n] for n in (1, 2) if digits[:n] in _CODES), digits[:3] if digits[:2] in _CODES_OF_3 else "")


def _plus(m: re.Match, others: list[int]) -> tuple[int, str] | None:
    """End and canonical value of a ``_PLUS`` match, without groups beyond 15 digits or from the start of another entity on.

    None where it is a plain number.
    """
    own = m.string[m.start() : min([m.end(), *(x for x in others if x > m.start())])].rstrip(" ./-")
    while sum(map(str.isdigit, own)) > 15 and (tail := _LONGER.search(own)):
        own = own[: tail.start()]
    digits, groups = re.sub(r"\D", "", own), re.findall(r"\d+", own)
    if not 8 <= len(digits) <= 15:
        return None
    code = country_code(digits)
    if m[1] and code != m[1]:
        if all(len(x) == 3 for x in groups[1:]):  # thousands
            return None
        code = m[1]
    if len(groups) == 2 and own.count(".") == 1 and len(groups[1]) < 9:  # a decimal fraction
        return None
    return m.start() + len(own), f"{code} {digits[len(code):]}"


def luhn(digits: str) -> bool:
    total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def script(word: str) -> str:
    c = ord(next((c for c in word if c.isalpha()), "a"))
    return "LATIN" if c < 0x250 else "GREEK" if 0x370 <= c < 0x400 else "CYRILLIC" if 0x400 <= c < 0x530 else "OTHER"


class Stream:
    """A keyed, endless and reproducible supply of numbers for one entity and try."""

    def __init__(self, key: bytes, *parts: str):
        h = hashlib.blake2b("\x1f".join(parts).encode("utf-8", "replace"), key=key[:64], digest_size=32)
        self.state, self.n = h, int.from_bytes(h.digest(), "big")
        self.left = 1 << 256

    def below(self, k: int) -> int:
        if self.left < k << 64:
            self.state.update(b"+")
            self.n, self.left = int.from_bytes(self.state.digest(), "big"), 1 << 256
        self.n, out = divmod(self.n, k)
        self.left //= k
        return out

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))

    def word(self, kind: str, n: int = 4) -> str:
        return "".join(SYLLABLES[kind][self.below(len(SYLLABLES[kind]))] for _ in range(n))


def _shuffled(key: bytes, space: str, n: int, x: int, back: bool = False) -> int:
    """A keyed permutation of the numbers below n, or its inverse: a Feistel network on two mixed digits, walked until below n."""
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    own = hashlib.blake2b(f"{space} {n}".encode("utf-8", "replace"), key=key[:64], digest_size=16).digest()
    mix = lambda i, v: int.from_bytes(hashlib.blake2b(own + bytes([i]) + v.to_bytes(20, "big"), digest_size=24).digest(), "big")
    while True:
        left, right = divmod(x, b)
        for i in reversed(range(FEISTEL_ROUNDS)) if back else range(FEISTEL_ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * mix(i, left)) % b
            else:
                left = (left + sign * mix(i, right)) % a
        x = left * b + right
        if x < n:
            return x


def moved(key: bytes, space: str, n: int, x: int, alike: Callable[[int], bool] = lambda y: True) -> int:
    """Another number below n that is ``alike``: a keyed permutation of the numbers that are alike, one cycle through all of them."""
    at = _shuffled(key, space, n, x)
    while True:
        at = (at + 1) % n
        y = _shuffled(key, space, n, at, back=True)
        if alike(y):
            return y


def _valid_ssn(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _check(body: str) -> int:
    """The last digit that makes a number valid by Luhn's rule."""
    return next(d for d in range(10) if luhn(body + str(d)))


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


# Ranges of IPv4 addresses that keep to themselves.
_RANGES = [ipaddress.ip_network(x) for x in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")]


def _public(x: int) -> bool:
    return 1 << 24 <= x < 224 << 24 and not any(int(r.network_address) <= x <= int(r.broadcast_address) for r in _RANGES)


def permuted(key: bytes, kind: str, value: str) -> str:
    """The canonical surrogate of a number, within the space of its format."""
    if kind == "phone":  # the code and a leading 0 or 1 stay
        code, _, rest = value.rpartition(" ")
        low, rest = (rest[0], rest[1:]) if rest[0] in "01" and len(rest) > 1 else ("", rest)
        n, base = (10 ** len(rest), 0) if low or rest[0] in "01" else (8 * 10 ** (len(rest) - 1), 2 * 10 ** (len(rest) - 1))
        return f"{code} {low}{base + moved(key, f'phone {code} {low}', n, int(rest) - base):0{len(rest)}d}"
    if kind == "ip":
        x = int(ipaddress.IPv4Address(value))
        for r in _RANGES:
            if int(r.network_address) <= x <= int(r.broadcast_address):
                return str(r.network_address + moved(key, f"ip {r}", r.num_addresses, x - int(r.network_address)))
        return str(ipaddress.IPv4Address(moved(key, "ip", 1 << 32, x, lambda y: _public(y) == _public(x) and not any(ipaddress.IPv4Address(y) in r for r in _RANGES))))
    if kind == "ip6":  # the first group stays
        high, low = divmod(int(ipaddress.IPv6Address(value)), 1 << 112)
        return str(ipaddress.IPv6Address((high << 112) + moved(key, f"ip6 {high}", 1 << 112, low)))
    if kind == "card":  # the first digit stays, and how far the last is from the valid one
        off, n = (int(value[-1]) - _check(value[:-1])) % 10, len(value) - 2
        body = f"{value[0]}{moved(key, f'card {value[0]} {off}', 10**n, int(value[1:-1])):0{n}d}"
        return f"{body}{(_check(body) + off) % 10}"
    if kind == "ssn":
        x = int(value)
        return f"{moved(key, 'ssn', 10**9, x, lambda y: _valid_ssn(y) == _valid_ssn(x)):09d}"
    # IBAN: the country stays, digits stay digits and letters letters, the check digits follow.
    sizes, x = [10 if c.isdigit() else 26 for c in value[4:]], 0
    for c, size in zip(value[4:], sizes, strict=True):
        x = x * size + (int(c) if size == 10 else ord(c) - 65)
    n = 1
    for size in sizes:
        n *= size
    x, out = moved(key, f"iban {value[:2]} {sizes}", n, x), []
    for size in reversed(sizes):
        x, d = divmod(x, size)
        out.append(str(d) if size == 10 else chr(65 + d))
    body = "".join(reversed(out))
    return f"{value[:2]}{98 - mod97(f'{value[:2]}00{body}'):02d}{body}"


def surrogate(key: bytes, kind: str, value: str, tried: int = 0) -> str:
    """The canonical surrogate of a canonical value; an e-mail address keeps its domain, whose surrogate is its own."""
    if kind not in DRAWN:
        return permuted(key, kind, value)
    s, more = Stream(key, kind, value, str(tried)), tried // 2
    if kind == "email":
        local, _, domain = value.partition("@")
        return f"{s.word('LATIN', 5 + more)}{s.digits(min(3, sum(c.isdigit() for c in local)))}@{domain}"
    if kind == "domain":
        return f"{s.word('LATIN', 5 + more)}.{value.rpartition('.')[2]}"
    gender, word = kind[4:], value
    alphabet = script(word)
    if alphabet in SYLLABLES:
        return s.word(alphabet, 4 + more) + ENDS[alphabet][gender]
    # Other scripts: letters of the same page of the code table.
    page = lambda c: [x for x in map(chr, range(ord(c) // 256 * 256, ord(c) // 256 * 256 + 256)) if x.isalpha()]
    letters = [c for c in word if c.isalpha()]
    return "".join(p[s.below(len(p))] for p in (page(c) for c in letters + letters[-1:] * more))


def _fill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() and c.isascii() else c for c in shape)


def _cased(shape: str, word: str) -> str:
    return word.upper() if len(shape) > 1 and shape.isupper() else word[:1].upper() + word[1:]


def rendered(kind: str, shape: str, new: str) -> str:
    """A canonical surrogate in the outer form of what it replaces."""
    if kind == "phone":
        code = new.partition(" ")[0]
        return _fill(shape, code + new.partition(" ")[2])
    if kind in ("card", "ssn"):
        return _fill(shape, new)
    if kind == "iban":
        it = iter(new)
        return "".join(next(it) if c.isalnum() else c for c in shape)
    return _cased(shape, new) if kind.startswith("name") else new


def _words(text: str) -> set[str]:
    """The words of a text as they are written, and those of two that a hyphen joins."""
    return {*re.findall(r"\w+", text), *(m[1] for m in re.finditer(r"(?<!\w)(?=(\w+-\w+))", text))}


def _names(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Names of a text, and the later mentions of their parts."""
    titled = [(m, 2 if m[3] else 0, 3 if m[3] else 2, _GENDER[m[1].lower()]) for m in _NAME.finditer(text)]
    taken = {m.end() for m, *_ in titled}
    titled += [(m, 1, 2, _NAMES[m[1]]) for m in _UNTITLED.finditer(text) if m.end() not in taken]
    if not titled:
        return
    shown = defaultdict(set)
    for m, given, _, gender in titled:
        if given and gender != "u":
            shown[m[given].lower()].add(gender)
    parts: dict[str, str] = {}
    for m, given, family, gender in titled:
        if given:
            known = shown[m[given].lower()]
            kind = "name" + (min(known) if gender == "u" and len(known) == 1 else gender)
            yield *m.span(given), kind, m[given].lower()
            parts.setdefault(m[given], kind)
        yield *m.span(family), "name", m[family].lower()
    for m, _, family, _ in titled:
        parts[m[family]] = "name"
    before, words = None, None
    for m in re.finditer(r"[^\W\d_]+(?:-[^\W\d_]+)?", text):
        if m[0] in parts:
            low, after = m[0].lower(), re.match(rf"[  ]+({_PART})", text[m.end() : m.end() + 99])
            alone = before != m.start() - 1 and not (after and after[1] in parts)
            if plain := alone and bool(_SENTENCE.search(text, max(0, m.start() - 9), m.start())):
                words = _words(text) if words is None else words
                plain = low in ORDINARY or low in words
            if not plain:
                yield *m.span(), parts[m[0]], low
                before = m.end()


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of the entities of a whole text, apart from each other, by start.

    Kinds of name parts are ``name`` (family) and ``namem``, ``namef``, ``nameu`` (given, by gender).
    """
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        left, right = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if left and right:
            start = left.start() + len(left[0]) - len(left[0].lstrip(".-+"))
            if start < at:
                found.append((start, right.end(), "email", text[start : right.end()].lower()))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(x) < 256 for x in m[0].split(".")):
                found.append((*m.span(), "ip", ".".join(str(int(x)) for x in m[0].split("."))))
        found += [(*m.span(), "ssn", m[0].replace("-", "")) for m in _SSN.finditer(text)]
        for m in _IP6.finditer(text):
            if sum(bool(x) for x in m[0].split(":")) >= 3 and _DIGIT.search(m[0]):
                try:
                    found.append((*m.span(), "ip6", ipaddress.IPv6Address(m[0]).compressed))
                except ValueError:
                    pass
        for m in _IBAN.finditer(text):
            own = m[0]
            while own and mod97(own.replace(" ", "")) != 1:  # a group of letters behind it is a word
                own = own.rpartition(" ")[0]
            if 15 <= len(own.replace(" ", "")) <= 34:
                found.append((m.start(), m.start() + len(own), "iban", own.replace(" ", "")))
        cards = ((m, re.sub(r"\D", "", m[0])) for m in _CARD.finditer(text))
        found += [(*m.span(), "card", d) for m, d in cards if _check(d[:-1]) == int(d[-1])]  # other long numbers are articles, orders or times
        others, whole = [x[0] for x in found if x[2] in ("ip", "ssn")], set()
        for m in _PHONE.finditer(text):
            code, digits = m[1] or m[2] or "", re.sub(r"\D", "", m[0])
            found.append((*m.span(), "phone", f"{code} {digits[len(code):]}"))
            if len(digits) >= 8:
                whole.add(m.start())
        if "+" in text:
            plus = (m for m in _PLUS.finditer(text) if m.start() not in whole)
            found += [(m.start(), x[0], "phone", x[1]) for m in plus if (x := _plus(m, others))]
        for m in _NATIONAL.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 9 <= len(digits) <= 12:
                trunk = "0" if digits[0] == "0" else ""
                found.append((*m.span(), "phone", f"{trunk} {digits[len(trunk):]}"))
    found += _names(text)
    out, end = [], 0
    for x in sorted(set(found), key=lambda x: (x[0], -x[1], x[2] == "name", x[2])):
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def replace(text: str | None, key: bytes, tries: Callable[[str, str], int]) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and its entities."""
    found, out, at = find(text), [], 0
    for start, end, kind, value in found:
        new = surrogate(key, kind, value, tries(kind, value))
        if kind == "email":
            local, _, domain = new.partition("@")
            new = f"{local}@{surrogate(key, 'domain', domain, tries('domain', domain))}"
        out += [text[at:start], rendered(kind, text[start:end], new)]
        at = end
    return ("".join([*out, text[at:]]) if found else text), found


def drawn(text: str | None) -> set[tuple[str, str]]:
    """(kind, value) of the entities of a text whose surrogates are drawn, mail domains among them."""
    own = {x[2:] for x in find(text) if x[2] in DRAWN}
    return own | {("domain", v.partition("@")[2]) for k, v in own if k == "email"}


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct ``(kind, value)`` of the corpus, of the kinds ``DRAWN``."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = sorted({x for t in b.column(0).to_pylist() for x in drawn(t)})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in own], pa.string()) for i in range(2)], names=["kind", "value"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, value string").distinct()


def overrides(found: DataFrame, key: bytes) -> DataFrame:
    """``(kind, value, tried)`` of the entities whose first surrogate collides; ``found`` is what ``entities`` gives."""
    spark = found.sparkSession
    found = common.cut(found, "entities")

    def made(tried: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = [surrogate(key, k, v, tried) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string())], names=["kind", "value", "new"])

        return run

    pool = F.when(F.col("kind").startswith("name"), "name").otherwise(F.col("kind"))  # what must differ from what
    known = found.select(pool.alias("pool"), F.col("value").alias("new")).distinct()
    taken, pending, out = None, found, []
    for tried in count():
        tries = pending.mapInArrow(made(tried), "kind string, value string, new string").withColumn("pool", pool)
        tries = common.cut(tries, "tries")
        first = tries.groupBy("pool", "new").agg(F.min(F.struct("kind", "value")).alias("first"), F.count("*").alias("n"))
        lost = tries.join(first.where("n > 1"), ["pool", "new"]).where(F.struct("kind", "value") != F.col("first")).select("kind", "value")
        lost = lost.union(tries.join(known, ["pool", "new"], "left_semi").select("kind", "value"))
        if taken is not None:
            lost = lost.union(tries.join(taken, ["pool", "new"], "left_semi").select("kind", "value"))
        lost = common.cut(lost.distinct(), "lost")
        won = tries.join(lost, ["kind", "value"], "left_anti")
        taken = won.select("pool", "new") if taken is None else common.cut(taken.union(won.select("pool", "new")), "taken")
        if tried:
            out.append(won.select("kind", "value", F.lit(tried).alias("tried")))
        if lost.isEmpty():
            break
        pending = lost
    none = spark.createDataFrame([], "kind string, value string, tried int")
    for x in out:
        none = none.union(x)
    return common.cut(none, "overrides")


def anonymise(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str | None = None, most: int = BROADCAST_OVERRIDES) -> DataFrame:
    """``docs`` with surrogates in ``text_col``; ``spans_col`` adds the entities as kind:start:end of the old text."""
    spark = docs.sparkSession
    over = overrides(entities(docs, text_col), key)
    names = docs.columns
    at, beside = names.index(text_col), None
    if over.count() <= most:
        table = spark.sparkContext.broadcast({(r.kind, r.value): r.tried for r in over.collect()})
        own = docs
    else:  # each row brings its own overrides
        table, row, mine = None, common.unused(names, "row"), common.unused(names, "overrides")
        kept = common.cut(docs.withColumn(row, F.monotonically_increasing_id()), "texts")

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in sorted(drawn(t))]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["row", "kind", "value"])

        each = kept.select(row, text_col).mapInArrow(held, "row long, kind string, value string")
        each = common.cut(each, "mentions").join(over, ["kind", "value"])
        each = each.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("kind", "value", "tried")).alias(mine))
        own = kept.join(common.cut(each, "row-overrides"), row, "left").select(*[F.col(f"`{c}`") for c in names], mine)
        beside = len(names)
    schema = docs.select("*").schema
    out = schema if spans_col is None else schema.add(spans_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = b.column(beside).to_pylist() if beside is not None else [None] * b.num_rows
            done = []
            for t, x in zip(b.column(at).to_pylist(), each, strict=True):
                tries = table.value if table is not None else {(y["kind"], y["value"]): y["tried"] for y in x or ()}
                done.append(replace(t, key, lambda k, v, tries=tries: tries.get((k, v), 0)))
            cols = b.columns[: len(names)]
            cols[at] = pa.array([x[0] for x in done], pa.string())
            if spans_col is not None:
                cols.append(pa.array([",".join(f"{k}:{s}:{e}" for s, e, k, _ in x[1]) for x in done], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    common.small_batches(spark)
    return own.mapInArrow(run, out)


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities, spans (kind:start:end in the old text) of all documents."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = anonymise(docs, DEMO_KEY, spans_col="spans")
    count = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ",")))
    return found.select("doc_id", "text", count.cast("long").alias("n_entities"), "spans")


QUERIES = {"op7_pii_surrogates": op7_pii_surrogates}
ORACLE: dict[str, str] = {}
