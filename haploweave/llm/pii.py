"""Personal data replaced by surrogates.

Each entity, in a normal form that is the same however it is written, is permuted
under a key within the classes its characters belong to (digits, vowels and
consonants of a script and case, octets of public addresses, names of a gender and
script), and the result is written in the format of the place. The permutation is
one-to-one and can be undone, so different entities keep different surrogates and
one entity has one surrogate wherever it stands. Check digits are made anew.

Collisions with real values: a first pass files every entity of the corpus in a
filter. A surrogate that the filter knows is not used; the entity tries further
permutations. What a later permutation gives is used only if no entity of the
filter would get it from an earlier one, which the inverse permutations tell, so
surrogates stay distinct without a table of them. An entity that finds no free
value (short names, whose every variant is taken) gets the first permutation's,
which may be another's real value but never another's surrogate.

Found: the kinds of KINDS. Persons are found after an honorific (TITLES), after a
phrase that names them (CUES), or by a listed given name (GIVEN); other persons
stay in clear, as do unlisted formats of phone numbers.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haploweave.llm._io import Filter, as_bytes, pieces, table, text_column

#: The kinds of entity, in order of precedence, and how each is written.
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?i:password|passwd|token|secret|api_?key)[ ]?[=:][ ]?(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"']{6,})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[23][0-9A-Fa-f]{3}|[Ff][CcDdEe][0-9A-Fa-f]{2})(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:]|\.\d)",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d]|\.\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.,-])(?<!\d )\d{3}[ ]\d{3}[ ]\d{4}(?![\w.,-]|[ ]\d)|(?<![\w.,-])(?<!\d )0\d{2,4}[ /]\d{5,8}(?![\w.,-]|[ ]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
}
#: Honorifics, and given names by script and gender.
TITLES = (
    "Mr", "Mrs", "Ms", "Miss", "Mx", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Господин", "Госпожа", "Доктор", "Κύριος", "Κυρία",
)
GIVEN = {
    ("latin", "m"): ("James", "Robert", "John", "Michael", "David", "William", "Thomas", "Hans", "Klaus", "Pierre", "Jean", "Carlos", "Miguel", "Antonio"),
    ("latin", "f"): ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Petra", "Sabine", "Marie", "Camille", "Carmen", "Lucia", "Isabel"),
    ("cyrillic", "m"): ("Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай"),
    ("cyrillic", "f"): ("Анна", "Мария", "Елена", "Ольга", "Татьяна", "Наталья"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Κώστας", "Δημήτρης", "Γιάννης"),
    ("greek", "f"): ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Άννα"),
}
#: Phrases that a name follows.
CUES = ("my name is ", "My name is ", "je m'appelle ", "Je m'appelle ", "ich heiße ", "Ich heiße ", "me llamo ", "Me llamo ", "меня зовут ", "Меня зовут ", "με λένε ", "Με λένε ")
#: Endings of a name that tell a gender; they stay.
ENDINGS = ("ович", "евич", "овна", "евна", "ский", "ская", "цкий", "цкая", "ова", "ева", "ина", "ов", "ев", "ин", "ίδης", "ίδου", "όπουλος", "οπούλου", "άκης", "άκη")
#: Country calling codes of one and two digits; all others have three.
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞΆΈ-ΊΌΎΏΑ-ΡΣ-ΫА-ЯЁ", "a-zß-öø-ÿά-ώа-яё"
_WORD = rf"[{_UPPER}][{_LOWER}]+(?:-[{_UPPER}][{_LOWER}]+)?"
_GENDER = {name: gender for (_, gender), names in GIVEN.items() for name in names}
KINDS["name"] = rf"(?<!\w)(?:(?:{'|'.join(TITLES)})\.?[ ]{_WORD}(?:[ ]{_WORD}){{0,2}}|(?:{'|'.join(f'(?<={c})' for c in CUES)}){_WORD}(?:[ ]{_WORD})?|(?:{'|'.join(_GENDER)})[ ]{_WORD}(?:[ ]{_WORD})?)(?!\w)"
ENTITY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))

_DIGITS = re.compile("[@0-9]")
_NAMES = re.compile("|".join([*TITLES, *CUES, *_GENDER]))
_SECRETS = ("passw", "token", "secret", "api_key", "apikey")
_TITLE = re.compile(rf"(?:{'|'.join(TITLES)})\.?[ ]")
_VALUE = re.compile(r"(\w+[ ]?[=:][ ]?[\"']?)(.*?)([\"']?)", re.S)


def _hint(text: str) -> bool:
    """Whether a text may hold an entity other than a secret. Searched one by one, as each search alone is fast."""
    return bool(_DIGITS.search(text)) or "AKIA" in text or "::" in text or bool(_NAMES.search(text))


def _is_address(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def find_entities(text: str):
    """The matches of ENTITY in a text, as (start, end, kind). No entity goes over the end of a line, so only lines that may hold one are searched."""
    low = text.lower()
    secret = any(s in low for s in _SECRETS)
    if not secret and not _hint(text):
        return
    at = 0
    for line in text.split("\n"):
        if (secret and ("=" in line or ":" in line)) or _hint(line):
            for m in ENTITY.finditer(line):
                if m.lastgroup != "ipv6" or _is_address(m[0]):
                    yield at + m.start(), at + m.end(), m.lastgroup
        at += len(line) + 1


_CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâäèéêëìíîïòóôöùúûüæœ", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ", "çñß", "ÇÑ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ", "αειουωη", "βγδζθκλμνξπρστφχψς", "άέίόύώή", "ΑΕΙΟΥΩΗ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "ΆΈΊΌΎΏΉ"]
_CLASS = {c: cls for cls in _CLASSES for c in cls}
_HEX, _BASE36 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_OCTETS = [str(i) for i in range(256)]
_PUBLIC = [str(i) for i in range(1, 224) if i not in (10, 100, 127, 169, 172, 192, 198, 203)]


def _group(c: str) -> str:
    """Marks of all kinds are one group; letters are told apart by case."""
    kind = unicodedata.category(c)
    return "P" if kind[0] in "PS" else kind if kind[0] == "L" else kind[0]


@lru_cache(1 << 14)
def class_of(c: str) -> str | None:
    """The characters that ``c`` may become: of its class, or those like it among the 128 around it. None for white space, quotes and what isn't text."""
    if (own := _CLASS.get(c)) is not None:
        return own
    if c.isspace() or c in "\"'" or unicodedata.category(c) == "Cs":
        return None
    first = ord(c) // 128 * 128
    word = re.compile(f"[{_LOWER}{_UPPER}]")
    like = [x for x in map(chr, range(first, first + 128)) if x not in _CLASS and not x.isspace() and x not in "\"'" and _group(x) == _group(c) and bool(word.match(x)) == bool(word.match(c))]
    return "".join(like) if len(like) > 1 else None


def luhn(digits: str) -> str:
    """The check digit that ends ``digits``."""
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def normal(kind: str, text: str) -> str:
    """What makes two writings one entity."""
    if kind == "email":
        return text.lower()
    if kind in ("card", "ssn"):
        return "".join(c for c in text if c.isdigit())
    if kind == "phone":
        return "".join(c for c in text if c.isdigit() or c == "+")
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(p)) for p in text.split("."))
    if kind == "ipv6":
        return ipaddress.IPv6Address(text).exploded
    if kind == "secret":
        return _VALUE.fullmatch(text)[2]
    return _TITLE.sub("", text, count=1) if kind == "name" and _TITLE.match(text) else text


def written(kind: str, text: str, new: str) -> str:
    """``new``, a normal form, in the format of ``text``."""
    if kind == "email":
        return "".join(c.upper() if o.isupper() else c for c, o in zip(new, text, strict=True))
    if kind in ("card", "ssn", "phone"):
        digits = iter(new.lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in text)
    if kind == "iban":
        rest = iter(new)
        return "".join(next(rest) if c != " " else c for c in text)
    if kind == "ipv6":
        out = new if len(text) == 39 else str(ipaddress.IPv6Address(new))
        return out.upper() if any(c.isupper() for c in text) else out
    if kind == "secret":
        m = _VALUE.fullmatch(text)
        return m[1] + new + m[3]
    return text[: len(text) - len(normal(kind, text))] + new


class Surrogates:
    """One-to-one replacements of normal forms under a key. ``filter``: knows the hashes of the corpus' entities."""

    #: Permutations that an entity tries.
    TRIES = 6

    def __init__(self, key: bytes, filter: Filter | None = None):
        self.key, self.filter = key, filter
        self.known: dict[tuple[str, str], str] = {}

    def _round(self, i: int, half: int, tweak: bytes, bits: int) -> int:
        got = hashlib.blake2b(b"%d|%d|" % (i, half) + tweak, key=self.key, digest_size=32).digest()
        return int.from_bytes(got * (bits // 256 + 1), "big") & ((1 << bits) - 1)

    def _permute(self, x: int, size: int, tweak: bytes, back: bool) -> int:
        """A Feistel permutation of numbers below ``size``: steps again while it lands outside."""
        bits = (max(size - 1, 1).bit_length() + 1) // 2
        mask = (1 << bits) - 1
        while True:
            a, b = x >> bits, x & mask
            for i in reversed(range(6)) if back else range(6):
                if back:
                    a, b = b ^ self._round(i, a, tweak, bits), a
                else:
                    a, b = b, a ^ self._round(i, b, tweak, bits)
            x = a << bits | b
            if x < size:
                return x

    def move(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        """A permutation of numbers below ``size`` (2 or more) that leaves none in place: permute, add one, permute back. ``back``: its inverse."""
        t = tweak.encode("utf-8", "surrogatepass")
        return self._permute((self._permute(x, size, t, False) + (-1 if back else 1)) % size, size, t, True)

    def spell(self, parts: list[str], alphabets: list, tweak: str, back: bool) -> list[str]:
        """``parts``, each of its alphabet (a sequence), moved together; parts without an alphabet stay."""
        size, x = 1, 0
        for p, a in zip(parts, alphabets, strict=True):
            if a:
                size, x = size * len(a), x * len(a) + a.index(p)
        if size < 2:
            return parts
        x, out = self.move(x, size, tweak, back), []
        for p, a in reversed(list(zip(parts, alphabets, strict=True))):
            if a:
                x, at = divmod(x, len(a))
                p = a[at]
            out.append(p)
        return out[::-1]

    def shaped(self, text: str, tweak: str, back: bool, alphabet: str | None = None, all_kinds: bool = False) -> str:
        """``text`` with each character moved within its class, or within ``alphabet``; the shape is part of the tweak."""
        own = [alphabet if alphabet and c in alphabet else class_of(c) if all_kinds else _CLASS.get(c) for c in text]
        shape = "".join(c if not a else a[0] for c, a in zip(text, own, strict=True))
        return "".join(self.spell(list(text), own, f"{tweak}|{shape}", back))

    @staticmethod
    def _until(step, text: str, holds) -> str:
        """Steps until ``holds``, as it does for ``text``: of a permutation's cycle, the next that does, which keeps it one-to-one."""
        new = step(text)
        while not holds(new):
            new = step(new)
        return new

    def email(self, text: str, t: str, back: bool) -> str:
        local, _, domain = text.partition("@")
        labels = domain.split(".")
        fixed = 2 if labels[-2:-1] == ["example"] else 1
        host = self.shaped(".".join(labels[:-fixed]), f"{t}host", back) if len(labels) > fixed else ""
        new = ".".join([*([host] if host else []), *labels[-fixed:]])
        return f"{self.shaped(local, f'{t}local@{new if back else domain}', back)}@{new}"

    def ssn(self, text: str, t: str, back: bool) -> str:
        return self.shaped(text, f"{t}ssn", back)

    def card(self, text: str, t: str, back: bool) -> str:
        if luhn(text[:-1]) != text[-1]:
            return self._until(lambda x: self.shaped(x, f"{t}number", back), text, lambda x: luhn(x[:-1]) != x[-1])
        body = self.shaped(text[1:-1], f"{t}card{text[0]}", back)
        return text[0] + body + luhn(text[0] + body)

    def iban(self, text: str, t: str, back: bool) -> str:
        country, check, body = text[:2], text[2:4], text[4:]
        if _iban_check(country, body) != check:
            return self._until(lambda x: country + self.shaped(x[2:], f"{t}account{country}", back), text, lambda x: _iban_check(country, x[4:]) != x[2:4])
        body = self.shaped(body, f"{t}iban{country}", back)
        return country + _iban_check(country, body) + body

    def ip(self, text: str, t: str, back: bool) -> str:
        parts = text.split(".")
        public = parts[0] in _PUBLIC
        return ".".join(self.spell(parts, [_PUBLIC, _OCTETS, _OCTETS, _OCTETS] if public else [None, None, _OCTETS, _OCTETS], f"{t}ip" if public else f"{t}ip{parts[0]}.{parts[1]}", back))

    def ipv6(self, text: str, t: str, back: bool) -> str:
        return text[:4] + self.shaped(text[4:], f"{t}ipv6{text[:4]}", back, _HEX)

    def phone(self, text: str, t: str, back: bool) -> str:
        code = next((text[: n + 1] for n in (1, 2) if text[1 : n + 1] in CALLING), text[:4]) if text[0] == "+" else ""
        rest = text[len(code) :]
        # a trunk zero stays, and no other first digit becomes one
        alphabets = [None if rest[:1] == "0" else "123456789", *["0123456789"] * (len(rest) - 1)][: len(rest)]
        return code + "".join(self.spell(list(rest), alphabets, f"{t}phone{code}|{len(rest)}|{rest[:1] == '0'}", back))

    def aws(self, text: str, t: str, back: bool) -> str:
        return text[:4] + self.shaped(text[4:], f"{t}key", back, _BASE36)

    def secret(self, text: str, t: str, back: bool) -> str:
        if text.isascii() and text.isdigit():
            return self.shaped(text, f"{t}pin", back)
        if not set(text) - set(_HEX):
            return self._until(lambda x: self.shaped(x, f"{t}hex", back, _HEX), text, lambda x: not x.isdigit())
        return self._until(lambda x: self.shaped(x, f"{t}secret", back, all_kinds=True), text, lambda x: set(x) - set(_HEX))

    def _name_word(self, word: str, t: str, back: bool) -> str:
        if word in _GENDER:
            names = next(n for n in GIVEN.values() if word in n)
            return names[self.move(names.index(word), len(names), f"{t}given{names[0]}", back)]
        ending = _ending(word)

        def step(x: str) -> str:
            return self.shaped(x[: len(x) - len(ending)], f"{t}name-{ending}", back, all_kinds=True) + ending

        return self._until(step, word, lambda x: x not in _GENDER and _ending(x) == ending)

    def name(self, text: str, t: str, back: bool) -> str:
        return " ".join(self._name_word(w, t, back) for w in text.split(" "))

    def swap(self, kind: str, entity: str, turn: int = 0, back: bool = False) -> str:
        """The permutation number ``turn`` of normal forms of a kind, or its inverse."""
        return (self.aws if kind == "key" else getattr(self, kind))(entity, f"{turn}|" if turn else "", back)

    def _taken(self, kind: str, entity: str) -> bool:
        return self.filter is not None and self.filter.has(entity_hash(kind, entity))

    def of(self, kind: str, entity: str) -> str:
        """The surrogate of a normal form, in normal form."""
        if (got := self.known.get((kind, entity))) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            for turn in range(self.TRIES):
                got = self.swap(kind, entity, turn)
                if not self._taken(kind, got) and not any(self._taken(kind, self.swap(kind, got, earlier, True)) for earlier in range(turn)):
                    break
            else:
                got = self.swap(kind, entity)
            self.known[kind, entity] = got
        return got

    def __call__(self, kind: str, text: str) -> str:
        return written(kind, text, self.of(kind, normal(kind, text)))


def _ending(word: str) -> str:
    """The ending that tells a gender, where two letters or more stand before it."""
    return max((e for e in ENDINGS if word.endswith(e) and len(word) >= len(e) + 2), key=len, default="")


def entity_hash(kind: str, entity: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}|{entity}".encode("utf-8", "surrogateescape"))


def _decoded(batch: pa.RecordBatch) -> list[str]:
    """Texts, null as empty; a byte that isn't UTF-8 is a character of its own."""
    return [x.decode("utf-8", "surrogateescape") for x in as_bytes(batch.column("text"))]


def entity_filter(docs: DataFrame) -> Filter:
    """A filter over all entities of the texts."""

    def hashes(batches):
        seen: set[int] = set()
        for batch in pieces(batches):
            here = {entity_hash(k, normal(k, text[a:b])) for text in _decoded(batch) for a, b, k in find_entities(text)}
            if fresh := here - seen:
                seen = seen | fresh if len(seen) < 200_000 else fresh
                yield np.fromiter(fresh, np.uint64, len(fresh))

    return Filter.gather(docs.select(F.col("text").cast("string")), hashes)


_SHAPE = "array<struct<kind: string, start: long, surrogate: string>>"


def replace_pii(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, entities (kind, start, surrogate; in characters of the new text) for each row of ``docs``.

    A null text stays null, without entities. Texts without entities come back as
    they are, invalid UTF-8 too; each byte that isn't UTF-8 counts as a character.
    Values that can't be changed (a secret of quotes only) stay. Repeated rows are
    rewritten alike; identifiers, null or not, are only carried. Other columns are
    not read. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(entity_filter(docs))  # of fixed size

    def rewrite(batches):
        make = Surrogates(key, shared.value)
        for batch in pieces(batches):
            texts, kinds, starts, values, ends = as_bytes(batch.column("text")), [], [], [], [0]
            for i, text in enumerate(_decoded(batch)):
                out, at, size = [], 0, 0
                for start, end, kind in find_entities(text):
                    new = make(kind, text[start:end])
                    out += [text[at:start], new]
                    kinds.append(kind)
                    starts.append(size + start - at)
                    values.append(new.encode("utf-8", "surrogateescape"))
                    size += start - at + len(new)
                    at = end
                if out:
                    texts[i] = "".join([*out, text[at:]]).encode("utf-8", "surrogateescape")
                ends.append(len(kinds))
            missing = batch.column("text").is_null().to_pylist()
            found = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), text_column(values)], names=["kind", "start", "surrogate"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text_column([None if m else t for m, t in zip(missing, texts, strict=True)]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], names=["doc_id", "text", "entities"])

    return docs.mapInArrow(rewrite, f"doc_id long, text string, entities {_SHAPE}")


#: The key of the query, whose results are to be the same on every run; a service passes its own.
KEY = b"surrogates of the query"


def op4_pii_surrogates(spark, sf_dir):
    return replace_pii(table(spark, sf_dir, "documents"), KEY)
