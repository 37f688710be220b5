"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, ``+`` before a digit, digits, schemes and identifier cues.  From each anchor
a deterministic parser expands to the left and right and validates what it found:

* email - the local part to the left of an at-sign, labels joined by dots to its right;
* ip - four runs of digits joined by dots, each at most 255;
* card - digits with single blanks or hyphens between them, 13 to 19 of them, passing Luhn;
* phone - ``+``, a digit, then digits and ``().- `` up to the last digit, 9 to 15 digits.

These four are the base kinds: leftmost, non-overlapping for each kind, a match that fails validation is dropped with all its
characters.  The method adds kinds of its own:

* url - behind a scheme cue, only where the address carries credentials (``user:password@host``) or an address as its host;
* account - an IBAN behind its country code and two check digits, valid by modulo 97;
* secret - behind a cue such as ``token`` or ``password`` and ``=`` or ``:``, a run of at least 16 letters and digits holding both.

Spans are (kind, start, end) in code points, end exclusive.  Defined results: a null or empty text has no spans; repeated rows
are searched one by one; other columns are ignored; a text is searched whole, and no expansion crosses its ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_KEY = _ALNUM | frozenset("+/_=-")
#: Cues, all in lower case.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://")
SECRETS = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key")
IBANS = ("ad", "at", "be", "bg", "ch", "cy", "cz", "de", "dk", "ee", "es", "fi", "fr", "gb", "gr", "hr", "hu", "ie", "is", "it", "li", "lt", "lu", "lv", "mc", "mt", "nl", "no", "pl", "pt", "ro", "se", "si", "sk", "sm")
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("url", "account", "secret")
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
        a.add_word("+" + d, ("+", 2))
    for w in SCHEMES:
        a.add_word(w, ("scheme", len(w)))
    for w in SECRETS:
        a.add_word(w, ("secret", len(w)))
    for w in IBANS:
        for d in "0123456789":
            a.add_word(w + d, ("iban", 3))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """Lower case of the same length, code point for code point."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Parser:
    """Expansions inside one text; each base kind remembers where its last match ended."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self.done = dict.fromkeys((*BASE_KINDS, *MORE_KINDS), 0)
        self.found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE_KINDS, *MORE_KINDS)}
        #: The runs that were read last behind a scheme and behind a secret's cue: a later cue inside one doesn't read it again.
        self.address = (0, 0)
        self.value = (0, -1, -1)

    def run(self, i: int, among: frozenset) -> int:
        t, n = self.text, self.n
        while i < n and t[i] in among:
            i += 1
        return i

    def email(self, at: int) -> None:
        t, floor = self.text, self.done["email"]
        a = at
        while a > floor and t[a - 1] in _LOCAL:
            a -= 1
        if a == at:
            return
        b = self.run(at + 1, _LABEL)
        if b == at + 1:
            return
        labels = 0
        while b < self.n and t[b] == "." and (c := self.run(b + 1, _LABEL)) > b + 1:
            b, labels = c, labels + 1
        if labels:
            self.found["email"].append((a, b))
            self.done["email"] = b

    def digits(self, i: int) -> None:
        """From a digit to the chains for addresses and cards that begin there; ``done`` skips digits that a chain has covered."""
        t = self.text
        if i >= self.done["card"]:
            b = i + 1
            while b < self.n:
                if t[b] in _DIGITS:
                    b += 1
                elif t[b] in " -" and b + 1 < self.n and t[b + 1] in _DIGITS:
                    b += 2
                else:
                    break
            self.done["card"] = b
            if b - i >= 13:
                only = t[i:b].replace(" ", "").replace("-", "")
                if 13 <= len(only) <= 19 and luhn(only):
                    self.found["card"].append((i, b))
        if i >= self.done["ip"]:
            b, parts = self.run(i, _DIGITS), 1
            bounds = [(i, b)]
            while parts < 4 and b + 1 < self.n and t[b] == "." and t[b + 1] in _DIGITS:
                c = self.run(b + 1, _DIGITS)
                bounds.append((b + 1, c))
                b, parts = c, parts + 1
            # fewer than four parts can't be the start of a match, nor can any later part of this chain
            self.done["ip"] = b
            if parts == 4 and all(len(p := t[x:y].lstrip("0")) <= 3 and int(p or "0") <= 255 for x, y in bounds):
                self.found["ip"].append((i, b))

    def phone(self, plus: int) -> None:
        if plus < self.done["phone"]:
            return
        t, b = self.text, self.run(plus + 2, _PHONE)
        while b > plus + 2 and t[b - 1] not in _DIGITS:
            b -= 1
        if b < plus + 4:
            return
        self.done["phone"] = b
        if 9 <= sum(c in _DIGITS for c in t[plus:b]) <= 15:
            self.found["phone"].append((plus, b))

    def url(self, a: int, b: int) -> None:
        t, (end, e) = self.text, self.address
        if b >= end:
            end = b
            while end < self.n and t[end] not in " \t\n\v\f\r\"'<>|" and t[end].isprintable():
                end += 1
            e = end
            while e > b and t[e - 1] in ".,;:!?)]}":
                e -= 1
            self.address = end, e
        e = max(e, b)
        slash = t.find("/", b, e)
        host = t[b : e if slash < 0 else slash]
        name, at, _ = host.rpartition("@")
        bare = host.rpartition("@")[2].split(":")[0].split(".")
        if (at and name) or (len(bare) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in bare)):
            if a >= self.done["url"]:
                self.found["url"].append((a, e))
                self.done["url"] = e

    def iban(self, a: int) -> None:
        t = self.text
        if a < self.done["account"] or (a and t[a - 1] in _ALNUM) or not (t[a].isupper() and t[a + 1].isupper()):
            return
        b, chars = a, []
        while b < self.n and len(chars) < 34:
            if t[b] in _ALNUM and not t[b].islower():
                chars.append(t[b])
                b += 1
            elif t[b] == " " and len(chars) % 4 == 0 and b + 1 < self.n and t[b + 1] in _ALNUM and not t[b + 1].islower():
                b += 1
            else:
                break
        if (b < self.n and t[b] in _ALNUM) or len(chars) < 15 or chars[2] not in _DIGITS or chars[3] not in _DIGITS:
            return
        number = "".join(str(int(c, 36)) for c in chars[4:] + chars[:4])
        if int(number) % 97 == 1:
            self.found["account"].append((a, b))
            self.done["account"] = b

    def secret(self, b: int) -> None:
        t = self.text
        i = self.run(b, frozenset("\"' \t"))
        if i >= self.n or t[i] not in "=:":
            return
        i = self.run(i + 1, frozenset("\"' \t"))
        e, digit, letter = self.value
        if i >= e:
            e, digit, letter = i, -1, -1
            while e < self.n and t[e] in _KEY:
                if t[e] in _DIGITS:
                    digit = e
                elif t[e] in _ALNUM:
                    letter = e
                e += 1
            self.value = e, digit, letter
        # the last digit and the last letter of the run tell whether the value from here on holds any
        if e - i >= 16 and i >= self.done["secret"] and digit >= i and letter >= i:
            self.found["secret"].append((i, e))
            self.done["secret"] = e


def search(text: str, a: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind, each kind in order of its starts."""
    p = Parser(text)
    done = p.done
    for end, (what, length) in a.iter(lowered(text)):
        at = end - length + 1
        if what == "digit":
            if at >= done["card"] or at >= done["ip"]:
                p.digits(at)
        elif what == "@":
            p.email(at)
        elif what == "+":
            p.phone(at)
        elif what == "secret":
            p.secret(end + 1)
        elif what == "iban":
            p.iban(at)
        else:
            p.url(at, end + 1)
    return p.found


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = automaton()
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = []
            for text in part.column(1):
                found = search(text.as_py() or "", a)
                rows.append((*(len(found[k]) for k in BASE_KINDS), hashlib.sha256(listed(found, BASE_KINDS).encode()).hexdigest(), listed(found, (*BASE_KINDS, *MORE_KINDS))))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 2, strict=True))], names)


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of SCHEMA for each row of ``docs``; one narrow pass, no shuffle."""
    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(searched, SCHEMA)


def redacted(text: str, a: ahocorasick.Automaton | None = None) -> str:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the earliest, then the longest stands."""
    found = search(text, a or automaton())
    out, at = [], 0
    for start, minus, kind in sorted((s, -e, k) for k, spans in found.items() for s, e in spans):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = -minus
    return "".join([*out, text[at:]])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
