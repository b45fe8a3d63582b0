"""Personal information in free text: places, typed placeholders and linked pseudonyms.

Numbers are found by format and validated; addresses by street, unit, postal code and town; names
by a dictionary that completes the given staff list from the corpus: parts that many listed family
names share, given names that precede families, families that follow given names, and towns that
stand beside postal codes. Entries follow from rates of such evidence, so they need no share of the
corpus, and chance neighbours do not add up as it grows. They are a table of any size: below a count
it is sent to the workers, beyond it the words of each text are joined with it by key.

Replacement keeps format: digits and letters of a number are permuted within their format by a
keyed Feistel network, birth dates as numbers of days, so equal values get equal pseudonyms in every document and different
values different ones. Names, addresses and e-mail addresses get a keyed tag instead.

Defined results: null and empty texts have no occurrence and stay as they are; texts of any length
are read whole; overlapping finds keep the one of the kind that comes first in KINDS; positions
count code points from 0, end exclusive; repeated rows are found in each.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Kinds in order of precedence where finds overlap.
KINDS = ["email", "idnum", "phone", "address", "name"]

# Words of street names, units, greetings, name particles, and what is no person's.
_EN_STREET = r"(?:Lane|Ln\.?|Street|St|Road|Rd|Drive|Dr|Court|Ct|Avenue|Ave\.|Ave|Row|Way|Close|Hill|Mews|Terrace|Place|Square|Crescent|Boulevard|Blvd\.?|Grove|Walk|Yard|Alley|Parkway|Highway)"
_UNIT = r"(?:,? (?:Apartment|Apt\.?|Unit|Suite|Ste\.?|Flat|Floor|Room|Rm\.?|#) ?#?\w+)?"
_DE_STREET = r"(?:str\.|straße|strasse|weg|allee|gasse|platz|damm|ufer|ring|steig|pfad|hof|graben|markt)"
_DE_FIRST = r"(?:(?:Neue[rsn]?|Alte[rsn]?|Große[rsn]?|Kleine[rsn]?|Obere[rsn]?|Untere[rsn]?|Hintere[rsn]?|Vordere[rsn]?|Lange[rsn]?|Hohe[rsn]?) )?"
_IT_STREET = r"(?:Via|Viale|Piazza|Piazzale|Largo|Corso|Vicolo|Vico|Strada|Contrada|Salita|Borgo)"
_GREETINGS = r"(?:Hi|Hello|Hey|Dear|Hallo|Liebe[rs]?|Guten Tag|Moin|Ciao|Caro|Cara|Gentile|Buongiorno|Salve|Bonjour|Cher|Chère|Hola)"
_PARTICLES = ["van der", "van den", "van de", "von der", "von dem", "de la", "de los", "van", "von", "vom", "de", "di", "del", "della", "dello", "dei", "degli", "da", "dal", "du", "des", "la", "le", "lo", "ter", "ten", "zu", "zur", "zum", "af", "el", "al", "bin"]
_NOT_PERSONS = {"the", "cluster", "gruppo", "gruppe", "group", "project", "progetto", "projekt", "codename"}
#: Words after which von or da say by whom, and belong to no name.
_BY = {"gemeldet", "segnalato", "geschrieben", "riscritto", "bearbeitet", "erstellt", "scritto"}

#: Share of a word's places, of all in any text, that must be behind given names if it is a family.
FAMILY_SHARE = 0.25
#: Learned entries that are sent to every worker at most; more are joined with the texts by key.
SENT_ENTRIES = 200_000

_WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)*(?:-[^\W\d_]+)*"
_CAP = r"[^\W\d_a-zà-öø-ÿ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_PARTICLE = "(?:" + "|".join(p.replace(" ", " +") for p in _PARTICLES) + ")"

_DOT = r"(?:\[ ?dot ?\]|\( ?dot ?\)|\{ ?dot ?\}|<dot>|\.)"
# What follows the local part of an e-mail address; the local part is read back from there.
_EMAIL_DOMAIN = re.compile(r"@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w@])")
_EMAIL_SPELT = re.compile(rf"(?:\[ ?at ?\]|\( ?at ?\)|\{{ ?at ?\}}|<at>) ?[\w-]+(?: ?{_DOT} ?[\w-]+)*(?: ?{_DOT} ?[^\W\d_]{{2,}})", re.I)
_EMAIL_SAID = re.compile(r" at [\w-]+(?: dot [\w-]+)* dot [^\W\d_]{2,}\b", re.I)
# Identity numbers from a character that is quick to look for; what stands before is tested behind.
_ID_DIGITS = re.compile(r"9\d\d([ -])\d\d\1\d{4}(?![\w-])")
_ID_LETTERS = re.compile(r"\d\d ?\d\d ?\d\d ?[A-Da-d](?![\w-])")
_ID_PREFIX = re.compile(r"(?<![\w-])[A-Za-z]{2} ?$")
_ID_CODE = re.compile(r"\b[A-Z]{6}[\dL-NP-V]{2}[A-EHLMPRST][\dL-NP-V]{2}[A-Z][\dL-NP-V]{3}[A-Z](?![\w-])", re.I)
_PHONE = re.compile(
    r"(?=[+(02-9])(?<![\w+./-])(?:\+\d{1,4}(?:[ .]?\(0\))?(?:[ ./-]?\d{1,6}){2,6}"
    r"|\+\d{1,4}[ .-]?\(\d{1,5}\)(?:[ ./-]?\d{2,6}){1,4}"
    r"|(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}"
    r"|[2-9]\d\d[2-9]\d{6}"
    r"|07\d{3} ?\d{6}|\(?02\d\)? ?\d{4} ?\d{4}|01\d{3} ?\d{6}"
    r"|0\d{1,4}/\d{3,8}(?:-\d{1,5})?"
    r"|0\d(?:[ .]\d\d){4})(?![\w/]|[.-]\d)"
)
_EN = rf"(?<![\w.-])\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}{_EN_STREET}(?!\w){_UNIT}"
_IT = rf"\b{_IT_STREET}(?: (?:dei|degli|delle|della|dello|del|dell['’]|di|da|la|{_CAP})){{1,4}},? (?:n\.? ?|n° ?)?\d{{1,4}}(?:/?[A-Za-z]\b)?{_UNIT}"
_DE = rf"(?<![\w-])(?:{_DE_FIRST}[A-ZÄÖÜ][\wäöüß-]*{_DE_STREET}|[A-ZÄÖÜ][\wäöüß-]+ (?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse)|(?:Am|Im|An der|An den|Auf der|Auf dem|In der|Zum|Zur|Hinter der|Unter den) [A-ZÄÖÜ][\wäöüß-]+) \d{{1,4}}(?: ?[a-z]\b)?{_UNIT}"
# Each by itself behind a look at its first character, which is quicker than one pattern of all.
_STREETS = [re.compile(rf"(?=\d){_EN}"), re.compile(rf"(?=[VPLCSB]){_IT}"), re.compile(rf"(?=[A-ZÄÖÜ]){_DE}")]
_TOWN = rf"{_CAP}(?: (?:am|an der|im|in|sul|sur|on|upon|bei|ob der|le|la|di|del|de|{_CAP})){{0,3}}"
_AFTER_CODE = re.compile(rf"(?:, ?|,?\n)(\d{{4,5}}) ({_TOWN})")
_BEFORE_CODE = re.compile(rf"(?:, ?|,?\n)({_TOWN}) (\d{{5}})(?!\w|[.-]\d)")
_BARE_TOWN = re.compile(rf"(?:, ?|,?\n)({_TOWN})")
_PAIR = re.compile(rf"(?<![\w@.-])({_CAP}) (?:[^\W\d_]\. )?(?:(?i:{_PARTICLE}) +)*({_CAP})(?![\w@])")
_BEHIND = re.compile(rf",\s({_WORD})(?: [^\W\d_]\.(?= {_WORD}|[,;:<(]))?(?![\w@])")
_BEHIND_INITIAL = re.compile(r", ([^\W\d_]\.)(?!\w)")
_WHOLE = re.compile(r"(?<![\w@.+=/-])[^\W\d_]+(?![\w@/=-])")
_TOKEN = re.compile(r"(?<![\w@.+-])[^\W\d_]+(?:-[^\W\d_]+)*(?![\w@])")
_RUN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_GREETED = re.compile(rf"(?=[HDLGMCBS])(?<!\w){_GREETINGS} ({_CAP})(?=[,!.:;\n])")


def _key(word: str) -> str:
    return unicodedata.normalize("NFC", word).lower()


def name_stems(families: list[str]) -> tuple[set[str], set[str]]:
    """Stems and endings that many listed family names share, in lower case.

    An ending belongs to five stems or more, a stem has three such endings or more.
    """
    splits = [(w[:i], w[i:]) for w in {_key(f) for f in families} for i in range(3, len(w) - 2)]
    ends = {e for e, n in Counter(e for _, e in splits).items() if n >= 5}
    stems = {s for s, n in Counter(s for s, e in splits if e in ends).items() if n >= 3}
    good = {e for s, e in splits if s in stems and e in ends}
    return stems, good


@dataclass
class Dictionary:
    """Known names and towns, all in lower case."""

    given: set[str] = field(default_factory=set)
    family: set[str] = field(default_factory=set)
    stems: set[str] = field(default_factory=set)
    ends: set[str] = field(default_factory=set)
    towns: set[str] = field(default_factory=set)

    @cached_property
    def built(self) -> re.Pattern | None:
        if not self.stems or not self.ends:
            return None
        alternatives = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
        return re.compile(rf"(?:{alternatives(self.stems)})(?:{alternatives(self.ends)})")

    def strong(self, word: str) -> bool:
        """Whether a word is built as the listed family names are."""
        return bool(self.built and self.built.fullmatch(_key(word)))

    def is_family(self, word: str) -> tuple[bool, bool]:
        """(a family, one that is no ordinary word), for double names by all parts."""
        parts = word.split("-")
        strong = [self.strong(p) for p in parts]
        return all(s or _key(p) in self.family for s, p in zip(strong, parts)), any(strong)

    @cached_property
    def seen(self) -> dict[str, tuple[bool, bool]]:
        return {}

    def known(self, word: str) -> tuple[bool, bool]:
        """``is_family``, remembered for the words seen last, since texts repeat their words."""
        out = self.seen.get(word)
        if out is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            out = self.seen[word] = self.is_family(word)
        return out


def _streets(text: str) -> Iterator[re.Match]:
    """Street and number in any of the known forms, from left to right, none overlapping another."""
    last = 0
    for m in sorted((m for p in _STREETS for m in p.finditer(text)), key=lambda m: m.start()):
        if m.start() >= last:
            last = m.end()
            yield m


def _town_end(text: str, at: int, words: Dictionary) -> int:
    """End of the postal code and town that follow an address' street, or ``at``."""
    if m := _AFTER_CODE.match(text, at):
        known = _known_prefix(m[2], words)
        town = known or re.match(rf"{_CAP}(?: (?:am|an der|im|in|sul|di|del|della|bei|ob der) {_CAP})?", m[2])
        if town:
            return m.start(2) + (len(known) if known else town.end())
    if m := _BEFORE_CODE.match(text, at):
        known = _known_prefix(m[1], words)
        if known == m[1] or not known and "\n" not in m[0][:2]:
            return m.end()
    if m := _BARE_TOWN.match(text, at):
        if known := _known_prefix(m[1], words):
            return m.start(1) + len(known)
    return at


def _known_prefix(phrase: str, words: Dictionary) -> str:
    parts = phrase.split(" ")
    for n in range(len(parts), 0, -1):
        if _key(" ".join(parts[:n])) in words.towns:
            return " ".join(parts[:n])
    return ""


def _word_char(c: str) -> bool:
    return c == "_" or c.isalnum()


def _word_before(text: str, at: int, gap: int | None = None) -> str:
    """The word that stands before a place, after at most ``gap`` other characters; '' if none."""
    end = at
    while end > 0 and not _word_char(text[end - 1]):
        end -= 1
    if gap is not None and at - end > gap:
        return ""
    start = end
    while start > 0 and (text[start - 1].isalpha() or text[start - 1] in "'’-"):
        start -= 1
    return text[start:end].lstrip("'’-")


def _ended(text: str, end: int, letters: str = "") -> int | None:
    """Where the word that ends at ``end`` begins, if it is letters standing by themselves."""
    start = end
    while start > 0 and (text[start - 1].isalpha() or text[start - 1] in letters):
        start -= 1
    while start < end and text[start] in letters:
        start += 1
    return start if start < end and not (start and (_word_char(text[start - 1]) or text[start - 1] in "@.+-")) else None


def _spaces_before(text: str, at: int) -> int:
    while at > 0 and text[at - 1] == " ":
        at -= 1
    return at


def _left(text: str, start: int) -> tuple[int | None, int | None, int | None]:
    """Starts of the given name, initial and particles that stand before a family name."""
    at, particle = start, None
    while (end := _spaces_before(text, at)) < at and (word := _ended(text, end)) is not None:
        one = text[word:end].lower()
        gap = _spaces_before(text, word)
        first = _ended(text, gap) if gap < word else None
        if first is not None and f"{text[first:gap].lower()} {one}" in _PARTICLES:
            at = particle = first
        elif one in _PARTICLES:
            at = particle = word
        else:
            break
    initial = None
    dot = at - 1 if at > 0 and text[at - 1] == " " else at
    if dot > 1 and text[dot - 1] == "." and text[dot - 2].isalpha() and _ended(text, dot - 1) == dot - 2:
        at = initial = dot - 2
    end = _spaces_before(text, at)
    given = _ended(text, end, "'’-") if end < at else None
    return given, initial, particle


def _names(text: str, words: Dictionary) -> Iterator[tuple[int, int]]:
    seen, known = words.seen, words.known
    for m in _TOKEN.finditer(text):
        word = m[0]
        family, strong = seen.get(word) or known(word)
        if not family:
            continue
        start, end = m.span()
        first, initial, particle = _left(text, start)
        given = text[first : _spaces_before(text, start if initial is None and particle is None else initial if initial is not None else particle)] if first is not None else ""
        lower = word == word.lower()
        behind = (m for m in [_BEHIND.match(text, end)] if m and _key(m[1]) in words.given and (lower or m[1] != m[1].lower()))
        if _key(given) in words.given and (lower or given != given.lower()):
            if not strong and _key(_word_before(text, first)) in _NOT_PERSONS:
                continue
            start = first
        elif initial is not None and (strong or text[initial].isupper()):
            start = initial
        elif (found := next(behind, None)) or strong and not lower:
            if particle is not None:
                said = text[particle:start].strip().lower()
                if said != "da" and not (said == "von" and _key(_word_before(text, particle)) in _BY):
                    start = particle
            if found:
                end = found.end()
            elif n := _BEHIND_INITIAL.match(text, end):
                end = n.end()
        else:
            continue
        yield start, end
    for m in _GREETED.finditer(text):
        if _key(m[1]) in words.given:
            yield m.span(1)


def _emails(text: str) -> list[tuple[int, int]]:
    """Addresses by what follows their local part, which is a run of its characters read back."""
    ends: list[tuple[int, int]] = []
    if "@" in text:
        ends += [m.span() for m in _EMAIL_DOMAIN.finditer(text)]
    ends += [(m.start() - (m.start() > 0 and text[m.start() - 1] == " "), m.end()) for m in _EMAIL_SPELT.finditer(text)]
    if " dot " in text.lower():
        ends += [m.span() for m in _EMAIL_SAID.finditer(text)]
    out = []
    for at, end in sorted(ends):
        start = at
        while start > 0 and (_word_char(text[start - 1]) or text[start - 1] in ".+%-"):
            start -= 1
        if start < at and _word_char(text[at - 1]):
            out.append((start, end))
    return out


def _idnums(text: str) -> Iterator[tuple[int, int]]:
    for m in _ID_DIGITS.finditer(text):
        before = text[max(0, m.start() - 7) : m.start()].lower()
        if not (before and (_word_char(before[-1]) or before[-1] in ".-")) and before != "ticket ":
            yield m.span()
    for m in _ID_LETTERS.finditer(text):
        if n := _ID_PREFIX.search(text, max(0, m.start() - 4), m.start()):
            yield n.start(), m.end()
    for m in _ID_CODE.finditer(text):
        if m.start() == 0 or text[m.start() - 1] != "-":
            yield m.span()


def find(text: str | None, words: Dictionary) -> list[tuple[str, int, int]]:
    """Occurrences (kind, start, end) in order of position, none overlapping another."""
    if not text:
        return []
    spans: list[tuple[str, int, int]] = []
    taken = bytearray(len(text))

    def add(kind: str, start: int, end: int) -> None:
        if start < end and not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            spans.append((kind, start, end))

    for start, end in _emails(text):
        add("email", start, end)
    for start, end in _idnums(text):
        add("idnum", start, end)
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            add("phone", *m.span())
    for m in _streets(text):
        add("address", m.start(), _town_end(text, m.end(), words))
    for start, end in _names(text, words):
        add("name", start, end)
    return sorted(spans, key=lambda s: s[1])


def _rounds(key: bytes, digits: list[int], radix: int, tweak: bytes) -> list[int]:
    """Balanced Feistel network over numbers below radix; a permutation for each length."""
    n = len(digits)
    if n < 2:
        shift = hashlib.blake2b(tweak, key=key, digest_size=8).digest()
        return [(d + int.from_bytes(shift, "big")) % radix for d in digits]
    u = n // 2
    a, b = digits[:u], digits[u:]
    for i in range(10):
        block = hashlib.blake2b(bytes([i, radix, n]) + tweak + bytes(b), key=key, digest_size=32).digest()
        size = len(a)
        total = (sum(d * radix**k for k, d in enumerate(reversed(a))) + int.from_bytes(block, "big")) % radix**size
        mixed = []
        for _ in range(size):
            total, d = divmod(total, radix)
            mixed.append(d)
        a, b = b, mixed[::-1]
    return a + b


def permuted(value: str, key: bytes, keep: int = 0) -> str:
    """``value`` with its digits and letters permuted in place: separators, case and length stay.

    ``keep``: so many leading digits (a country code) stay as they are. Equal digits and letters
    give equal results whatever the separators.
    """
    spots = [i for i, c in enumerate(value) if c in "0123456789"][keep:]
    letters = [i for i, c in enumerate(value) if c.isascii() and c.isalpha()]
    out = list(value)
    for i, d in zip(spots, _rounds(key, [int(value[i]) for i in spots], 10, b"d")):
        out[i] = str(d)
    for i, d in zip(letters, _rounds(key, [ord(value[i].lower()) - 97 for i in letters], 26, b"l")):
        out[i] = chr(d + (65 if value[i].isupper() else 97))
    return "".join(out)


def _country_digits(phone: str) -> int:
    m = re.match(r"\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})", phone)
    return len(m[1]) if m else 0


# First day, number of days and forms of the dates that are permuted.
_FIRST_DAY, _DAYS = date(1900, 1, 1), 73_049
_DATE = r"\d{4}-\d\d-\d\d|\d\d?[./]\d\d?[./]\d{4}"
_BORN = re.compile(rf"\b(?:born|date of birth|DOB|geboren|Geburtsdatum|nato|nata|data di nascita)(?: on| am| il)?[ :=]{{1,3}}({_DATE})(?!\w)", re.I)


def birth_dates(text: str) -> list[tuple[str, int, int]]:
    """Dates that a text says someone was born at; other dates are nobody's."""
    return [("birthdate", *m.span(1)) for m in _BORN.finditer(text or "")]


def permuted_date(value: str, key: bytes) -> str:
    """A day of 1900 to 2099 as another one in the same form; what is no such day stays.

    The Feistel network permutes six-digit numbers; a number beyond the last day is permuted
    again until it is one, which makes it a permutation of the days.
    """
    marks = [c for c in value if not c.isdigit()]
    parts = [int(p) for p in re.split(r"\D", value)]
    try:
        day = (date(*parts) if marks[0] == "-" else date(*parts[::-1])) - _FIRST_DAY
    except ValueError:
        return value
    n = day.days
    if not 0 <= n < _DAYS:
        return value
    while True:
        n = int("".join(map(str, _rounds(key, [int(c) for c in f"{n:06d}"], 10, b"day"))))
        if n < _DAYS:
            break
    out = _FIRST_DAY + timedelta(days=n)
    return out.isoformat() if marks[0] == "-" else marks[0].join([f"{out.day:02d}", f"{out.month:02d}", str(out.year)])


def placeholder(kind: str, value: str, key: bytes) -> str:
    """The typed placeholder of a value; the same for the same value in any document."""
    if kind == "birthdate":
        return f"[BIRTHDATE {permuted_date(value, key)}]"
    if kind in ("phone", "idnum"):
        return f"[{kind.upper()} {permuted(value, key, _country_digits(value) if kind == 'phone' else 0)}]"
    plain = re.sub(r"\W+", " ", _key(value)).strip()
    return f"[{kind.upper()} {hashlib.blake2b(plain.encode(), key=key, digest_size=16).hexdigest()}]"


def replaced(text: str | None, spans: list[tuple[str, int, int]], key: bytes) -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        out += [text[at:start], placeholder(kind, text[start:end], key)]
        at = end
    return "".join(out + [text[at:]])


def _evidence(column: str):
    """Per batch: how often words stand in places of names and towns, and anywhere, combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            whole: Counter = Counter()
            for text in batch.column(column).to_pylist():
                if not text:
                    continue
                whole.update(_WHOLE.findall(_key(text)))
                for m in _PAIR.finditer(text):
                    at = m.start()
                    if at > 2 and text[at - 1].isspace() and text[at - 2] == "," and text[at - 3].isalpha():
                        continue  # the given name behind "family, given" belongs to what stands before it
                    if _key(_word_before(text, at, 2)) not in _NOT_PERSONS:
                        seen["pair", _key(m[1]), _key(m[2])] += 1
                for m in _streets(text):
                    if n := _AFTER_CODE.match(text, m.end()):
                        parts = n[2].split(" ")
                        for k in range(1, len(parts) + 1):
                            seen["town", _key(" ".join(parts[:k])), _key(" ".join(parts[: k - 1]))] += 1
                    elif n := _BEFORE_CODE.match(text, m.end()):
                        seen["town", _key(n[1]), ""] += 1
            for word, n in whole.items():
                seen["word", word, ""] = n
            if seen:
                keys = list(seen)
                yield pa.RecordBatch.from_pydict(
                    {"kind": pa.array([k[0] for k in keys], pa.string()), "a": pa.array([k[1] for k in keys], pa.string()), "b": pa.array([k[2] for k in keys], pa.string()), "n": pa.array(seen.values(), pa.int64())}
                )

    return run


def entries(documents: DataFrame, parts: DataFrame, column: str = "text") -> tuple[Dictionary, DataFrame]:
    """The staff list, and what completes it from all documents as a table (role, word).

    A given name precedes three families or more, in at least half of the places where it
    precedes a capitalised word. A family follows three such given names or more, and in at least
    FAMILY_SHARE of all places where the word stands in any text, in whatever case: chance
    neighbours of given names grow with the corpus, but so do their other places. What follows a
    postal code is a town as far as it goes on in half of the cases.

    The staff list is gathered: it does not grow with the documents.
    """
    listed = [(r["name_part"], r["part_kind"]) for r in parts.where("name_part is not null").select("name_part", "part_kind").collect()]
    base = Dictionary({_key(n) for n, k in listed if k == "given"}, {_key(n) for n, k in listed if k == "family"})
    base.stems, base.ends = name_stems(sorted(base.family))
    found = documents.select(column).mapInArrow(_evidence(column), "kind string, a string, b string, n bigint")
    seen = written(found.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")), "evidence")
    pairs = seen.where("kind = 'pair'")
    first = F.split_part(F.col("b"), F.lit("-"), F.lit(1))
    families = F.col("b").isin(*sorted(base.family)) | first.rlike(f"^{base.built.pattern}$" if base.built else "^$")
    named = pairs.groupBy("a").agg(F.countDistinct(F.when(families, first)).alias("kinds"), F.sum(F.when(families, F.col("n")).otherwise(0)).alias("named"), F.sum("n").alias("n"))
    given = written(named.where((F.col("kinds") >= 3) & (F.col("named") * 2 >= F.col("n")) & ~F.col("a").isin(*_PARTICLES)).select(F.col("a").alias("word")), "given")
    listed_given = lambda c: F.col(c).isin(*sorted(base.given))
    beside = pairs.where(~listed_given("b") & ~F.col("b").contains("-")).join(given.select(F.col("word").alias("a"), F.lit(True).alias("is_given")), "a", "left")
    follow = beside.where(F.coalesce("is_given", F.lit(False)) | listed_given("a")).join(given.withColumnRenamed("word", "b"), "b", "left_anti").groupBy("b").agg(F.countDistinct("a").alias("kinds"), F.sum("n").alias("named"))
    often = follow.where((F.col("kinds") >= 3) & ~F.col("b").isin(*_PARTICLES)).join(seen.where("kind = 'word'").select(F.col("a").alias("b"), F.col("n").alias("n_all")), "b")
    family = often.where(F.col("named") >= FAMILY_SHARE * F.col("n_all")).select(F.col("b").alias("word"))
    roles = [given.select(F.lit("given").alias("role"), "word"), family.select(F.lit("family"), "word"), _towns(seen.where("kind = 'town'")).select(F.lit("town"), "word")]
    return base, written(roles[0].unionAll(roles[1]).unionAll(roles[2]), "entries")


def _towns(seen: DataFrame) -> DataFrame:
    """(word): phrases beside postal codes that are a town, by comparing each with its beginnings."""
    often = written(seen.groupBy("a").agg(F.sum("n").alias("n"), F.max("b").alias("b")), "phrases")
    longer = often.join(often.select(F.col("a").alias("b"), F.col("n").alias("n_b")), "b", "left")
    good = longer.where((F.col("b") == "") | F.col("n_b").isNull() | (2 * F.col("n") >= F.col("n_b"))).select("a", "n")
    heads = F.expr("transform(sequence(1, size(split(a, ' ')) - 1), k -> substring_index(a, ' ', k))")
    starts = lambda df: df.where(F.col("a").contains(" ")).select(F.col("a").alias("long"), F.col("n").alias("n_long"), F.explode(heads).alias("a"))
    common = starts(good).join(often.select("a", "n"), "a").where(F.col("n") >= 10 * F.col("n_long")).select(F.col("long").alias("a"))
    towns = written(good.join(common, "a", "left_anti"), "towns")
    carried = starts(towns).join(towns, "a").where(2 * F.col("n_long") >= F.col("n")).select("a")
    return towns.join(carried, "a", "left_anti").select(F.col("a").alias("word"))


def learned(documents: DataFrame, parts: DataFrame, column: str = "text") -> Dictionary:
    """The staff list with all ``entries``, gathered; for few."""
    base, more = entries(documents, parts, column)
    return _completed(base, [(r["role"], r["word"]) for r in more.collect()])


def _completed(base: Dictionary, more: Iterable[tuple[str, str]]) -> Dictionary:
    sets = {"given": set(), "family": set(), "town": set()}
    for role, word in more:
        sets[role].add(word)
    out = Dictionary(base.given | sets["given"], base.family | sets["family"], base.stems, base.ends, base.towns | sets["town"])
    out.__dict__["built"] = base.built
    return out


def _asked(text: str, most: int) -> set[str]:
    """All words that ``find`` may look up in a text; ``most``: parts of the longest entry."""
    out = set()
    for run in set(_RUN.findall(text)):
        at = [0, *(m.end() for m in re.finditer(r"['’-]", run))]
        end = [*(i - 1 for i in at[1:]), len(run)]
        out.update(_key(run[i:j]) for k, i in enumerate(at) for j in end[k : k + most])
    for m in _streets(text):
        for pattern, group in ((_AFTER_CODE, 2), (_BEFORE_CODE, 1), (_BARE_TOWN, 1)):
            if n := pattern.match(text, m.end()):
                words = n[group].split(" ")
                out.update(_key(" ".join(words[:k])) for k in range(1, len(words) + 1))
    return out


def with_entries(documents: DataFrame, more: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``entries``: those of the learned ones that a text's words may need, joined by key."""
    most = more.agg(F.max(F.size(F.split("word", "['’-]")))).collect()[0][0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, text in zip(batch.column("_text").to_pylist(), batch.column(column).to_pylist()):
                words = list(_asked(text, most))
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array([ident] * len(words), pa.string()), pa.array(words, pa.string())], names=["_text", "word"])

    marked = documents.withColumn("_text", F.sha2(column, 256))
    asked = marked.where(F.length(column) > 0).select("_text", column).mapInArrow(run, "_text string, word string")
    known = asked.join(more, "word").groupBy("_text").agg(F.collect_set(F.struct("role", "word")).alias("entries"))
    return marked.join(known, "_text", "left").drop("_text")


def _searched(batch: pa.RecordBatch, words: Dictionary, column: str) -> list[list[tuple[str, int, int]]]:
    """Finds in each text of a batch, with the learned entries of its texts if they are joined."""
    if "entries" in batch.schema.names:
        words = _completed(words, {(e["role"], e["word"]) for row in batch.column("entries").to_pylist() for e in row or ()})
    return [find(text, words) for text in batch.column(column).to_pylist()]


def _with_dates(text: str | None, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    dates = [d for d in birth_dates(text) if not any(a < d[2] and d[1] < b for _, a, b in spans)]
    return sorted(spans + dates, key=lambda s: s[1]) if dates else spans


def _columns(documents: DataFrame, ident: str, column: str, words: Dictionary, more: DataFrame | None, sent: int) -> tuple[DataFrame, Dictionary]:
    """What is read of the documents, and the words sent along: few entries are, by their count; more are joined."""
    read = documents.select(F.col(ident).cast("long"), column)
    if more is None:
        return read, words
    few = more.limit(sent + 1).collect()
    if len(few) <= sent:
        return read, _completed(words, [(r["role"], r["word"]) for r in few])
    return with_entries(read, more, column), words


def occurrences(documents: DataFrame, words: Dictionary, ident: str = "doc_id", column: str = "text", more: DataFrame | None = None, sent: int = SENT_ENTRIES) -> DataFrame:
    """(ident, pii_kind, start_pos, end_pos): each occurrence in each text. ``more``: learned entries as a table."""
    read, words = _columns(documents, ident, column, words, more, sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *s) for i, spans in zip(batch.column(ident).to_pylist(), _searched(batch, words, column)) for s in spans]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=[ident, "pii_kind", "start_pos", "end_pos"])

    return read.mapInArrow(run, f"{ident} bigint, pii_kind string, start_pos bigint, end_pos bigint")


def redacted(documents: DataFrame, words: Dictionary, key: bytes, ident: str = "doc_id", column: str = "text", more: DataFrame | None = None, sent: int = SENT_ENTRIES) -> DataFrame:
    """(ident, text, n_found): the texts with placeholders instead of what was found, and of birth dates."""
    read, words = _columns(documents, ident, column, words, more, sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).to_pylist()
            spans = [_with_dates(t, found) for t, found in zip(texts, _searched(batch, words, column))]
            out = [replaced(t, s, key) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(ident), pa.array(out, pa.string()), pa.array([len(s) for s in spans], pa.int64())], names=[ident, column, "n_found"])

    return read.mapInArrow(run, f"{ident} bigint, {column} string, n_found bigint")
