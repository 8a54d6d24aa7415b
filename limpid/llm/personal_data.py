"""Personal data in texts, also where it is disguised.

Identifiers are searched twice: in the text as it stands, and in a normalised form of it. The
normalised form is made by transducers, each of which rewrites a text and keeps, for every character
it emits, the source characters it stands for: look-alike letters and digits become ASCII and
invisible characters vanish, spelled digits become digits, and written-out or bracketed "at" and "dot"
become signs. What is found there is mapped back through all transducers to the source, so every span
counts characters (code points) of the untouched text.

All scans are linear in the length of a text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and a domain with a dot, leftmost first, without overlap.

    Only an @ can make a match, and no part holds a second one, so each @ is tried once and the local
    part is read backwards from it, not beyond the match before.
    """
    done = 0
    at = text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        start = at - _LOCAL_RUN.match(text[done:at][::-1]).end() if found else at
        if start < at:
            yield start, found.end()
        # without a match the next local part may begin behind this sign
        done = found.end() if start < at else at + 1
        at = text.find("@", done)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers of at most 255; a run of more numbers is cut into fours from its left."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        at, parts = run.start(), run.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def passes_luhn(digits: str) -> bool:
    """Checksum of card numbers: every second digit from the right counts double, digit sums added."""
    odd, even = digits[::-1][0::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digits with single gaps or hyphens: 13 to 19 digits that pass the checksum."""
    for run in _DIGITS.finditer(text):
        digits = _NOT_DIGITS.sub("", run.group()) if len(run.group()) <= 37 else ""
        if 13 <= len(digits) <= 19 and passes_luhn(digits):
            yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    """Numbers that begin with a plus sign and have 9 to 15 digits."""
    for run in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGITS.sub("", run.group())) <= 15:
            yield run.span()


_FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def find_plain(text: str) -> list[Span]:
    """(kind, start, end) of the identifiers that stand openly, by kind and start."""
    return [(kind, *span) for kind in KINDS for span in _FINDERS[kind](text)]


class Mapped:
    """A text whose every character stands for source characters from ``starts`` to before ``ends``."""

    def __init__(self, text: str, starts: list[int] | range, ends: list[int] | range):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, text: str) -> Mapped:
        return cls(text, range(len(text)), range(1, len(text) + 1))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace each (start, end, output), in order and without overlap.

        Every character of an output stands for the whole part it replaces; an empty output deletes.
        """
        texts, starts, ends, at = [], [], [], 0
        for start, end, output in [*edits, (len(self.text), len(self.text), "")]:
            texts.append(self.text[at:start])
            starts.extend(self.starts[at:start])
            ends.extend(self.ends[at:start])
            if output:
                texts.append(output)
                starts.extend([self.starts[start]] * len(output))
                ends.extend([self.ends[end - 1]] * len(output))
            at = end
        return Mapped("".join(texts), starts, ends)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


# Cyrillic and Greek letters that look like an ASCII letter, and that letter.
CYRILLIC = ("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅ", "aeopcyxijshdqwABEKMHOPCTXIJS")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυ", "ABEZHIKMNOPTYXaivopu")
HOMOGLYPHS = dict(zip(*CYRILLIC, strict=True)) | dict(zip(*GREEK, strict=True))
# Signs that look like a dot, a hyphen or a space (U+2024 one-dot leader, U+2027 hyphenation point, U+3002
# ideographic full stop; U+2010 to U+2013 and U+2212 dashes; U+00A0, U+2007, U+2009, U+202F, U+3000 spaces).
SIGNS = ({c: "." for c in "\u2024\u2027\u3002"} | {c: "-" for c in "\u2010\u2011\u2012\u2013\u2212"}
         | {c: " " for c in "\u00a0\u2007\u2009\u202f\u3000"})
# Characters that leave no mark (soft hyphen, zero-width space and joiners, word joiner, byte order mark).
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _plain(c: str) -> str | None:
    """ASCII form of a look-alike, "" for an invisible character, None for all others."""
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c in SIGNS:
        return SIGNS[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    # wide, circled and mathematical forms of ASCII characters
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded != c and len(folded) == 1 and "!" <= folded <= "~" else None


_REWRITTEN: dict[str, str | None] = {}
# beyond the accented letters of Latin scripts, which stand for themselves
_OTHER = re.compile("[^\\x00-\u017f]|[\u00a0\u00ad]")


def look_alikes(source: Mapped) -> Mapped:
    """Homoglyphs to ASCII; invisible characters go."""
    edits = []
    for found in _OTHER.finditer(source.text):
        c = found.group()
        if c not in _REWRITTEN:
            _REWRITTEN[c] = _plain(c)
        if _REWRITTEN[c] is not None:
            edits.append((found.start(), found.end(), _REWRITTEN[c]))
    return source.rewritten(edits) if edits else source


# Names of the digits 0 to 9, per language, and other names of zero.
DIGIT_NAMES = (
    "zero one two three four five six seven eight nine",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_DIGIT = {name: str(k) for names in DIGIT_NAMES for k, name in enumerate(names.split())} | {"oh": "0", "zwo": "2"}
# Names of the signs.
AT_NAMES = ("at", "ät", "arobase", "arroba", "klammeraffe")
DOT_NAMES = ("dot", "punkt", "point", "punto")
PLUS_NAMES = ("plus", "más")

_names = lambda names: "|".join(sorted(names, key=len, reverse=True))
_ONE = rf"(?:(?<!\w)(?:{_names(_DIGIT)})(?!\w)|[0-9])"
_BETWEEN = rf"(?:\x20(?:{_names(DOT_NAMES)})\x20|[\x20.-])"
_ROW = re.compile(rf"(?P<plus>(?<!\w)(?:{_names(PLUS_NAMES)})\x20?)?(?P<row>{_ONE}(?:{_BETWEEN}?{_ONE})++)", re.I)
_STEP = re.compile(rf"(?P<gap>{_BETWEEN})?(?P<one>{_ONE})", re.I)


def spelled_digits(source: Mapped) -> Mapped:
    """Names of digits become digits, and single gaps or hyphens beside them go.

    Only rows with three names after one another are rewritten, so that a lone "one" beside a number
    stays a word; a named dot inside a row becomes a dot, a named plus before it a plus sign.
    """
    edits = []
    for found in _ROW.finditer(source.text):
        steps = list(_STEP.finditer(source.text, *found.span("row")))
        named = [s["one"].lower() in _DIGIT for s in steps]
        if not any(all(named[k:k + 3]) for k in range(len(named) - 2)):
            continue
        if found["plus"]:
            edits.append((*found.span("plus"), "+"))
        for k, step in enumerate(steps):
            if step["gap"] and len(step["gap"]) > 1:
                edits.append((*step.span("gap"), "."))
            elif step["gap"] and step["gap"] != "." and (named[k] or named[k - 1]):
                edits.append((*step.span("gap"), ""))
            if named[k]:
                edits.append((*step.span("one"), _DIGIT[step["one"].lower()]))
    return source.rewritten(edits) if edits else source


_WORD = r"[A-Za-z0-9%+_-]"
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
# in brackets the name of a sign, or the sign itself, needs nothing else
_BRACKETED = re.compile(rf"\x20?{_OPEN}\x20?(?:(?P<at>{_names(AT_NAMES)}|@)|(?P<dot>{_names(DOT_NAMES)}|\.))\x20?{_SHUT}\x20?", re.I)
# without brackets both signs must be named, in a row: name at host dot domain
_NAMED = re.compile(rf"(?<=[A-Za-z0-9])\x20(?P<at>{_names(AT_NAMES)})\x20(?P<host>{_WORD}{{1,63}}(?:(?:\x20(?:{_names(DOT_NAMES)})\x20|\.){_WORD}{{1,63}}){{0,6}}?)"
                    rf"\x20(?P<dot>{_names(DOT_NAMES)})\x20(?=[A-Za-z]{{2,24}}(?![A-Za-z0-9]))", re.I)
_DOT_INSIDE = re.compile(rf"\x20(?:{_names(DOT_NAMES)})\x20", re.I)


def named_signs(source: Mapped) -> Mapped:
    """Disguised @ and dots become signs: in brackets, or named one after the other as in an address."""
    edits = [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(source.text)]
    step = source.rewritten(edits) if edits else source
    edits = []
    for m in _NAMED.finditer(step.text):
        edits.append((m.start(), m.end("at") + 1, "@"))
        edits += [(d.start(), d.end(), ".") for d in _DOT_INSIDE.finditer(step.text, m.start("host"), m.end("host"))]
        edits.append((m.start("dot") - 1, m.end(), "."))
    return step.rewritten(edits) if edits else step


TRANSDUCERS = (look_alikes, named_signs, spelled_digits)
# a text in lower case without any of these has no disguised identifier: characters beyond Latin scripts, signs in
# brackets, a named dot, two names of digits after a gap
_FIRST = "".join(sorted({name[0] for name in _DIGIT}))
_HINTS = (
    _OTHER, re.compile(rf"{_OPEN}\x20?(?:{_names(AT_NAMES + DOT_NAMES)}|[@.])"), re.compile(rf"\x20(?:{_names(DOT_NAMES)})\x20"),
    re.compile(rf"[\x20.-](?=[{_FIRST}])(?:{_names(_DIGIT)})[\x20.-](?=[{_FIRST}])(?:{_names(_DIGIT)})"),
)
_TOP = re.compile(r"\.[A-Za-z]{2,24}\Z")


def find_disguised(text: str, transducers: tuple[Callable[[Mapped], Mapped], ...] = TRANSDUCERS) -> list[Span]:
    """(kind, start, end) in characters of ``text`` of identifiers seen only after normalisation.

    A finding counts if a transducer wrote part of it and no open identifier of its kind covers it. An
    e-mail must end in a domain of letters.
    """
    lowered = text.lower()
    if not any(hint.search(lowered) for hint in _HINTS):
        return []
    mapped = Mapped.of(text)
    for transducer in transducers:
        mapped = transducer(mapped)
    if mapped.text is text:
        return []
    found = []
    for kind in KINDS:
        for start, end in _FINDERS[kind](mapped.text):
            first, last = mapped.source(start, end)
            if text[first:last] != mapped.text[start:end] and (kind != "email" or _TOP.search(mapped.text, start, end)):
                found.append((kind, first, last))
    return found


def find_personal_data(text: str | None) -> tuple[list[Span], list[Span]]:
    """(open, all) spans, each by kind and start. A null text has none."""
    base = find_plain(text or "")
    added = find_disguised(text or "")
    if not added:
        return base, base
    covered = {kind: [s for s in base if s[0] == kind] for kind in KINDS}
    fresh = {s for s in added if not any(b[1] <= s[1] and s[2] <= b[2] for b in covered[s[0]])}
    return base, sorted([*base, *fresh], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def with_spans(docs: DataFrame, text: str = "text", to: str = "personal") -> DataFrame:
    """Add ``to``: struct of ``open`` and ``all``, lists of (kind, start, end) by kind and start.

    Starts and ends count code points of the whole text, the end is exclusive. Null and empty texts
    have empty lists; repeated rows stay; ``to`` replaces a column of that name, all others are kept.
    """
    @F.pandas_udf(f"struct<open:{_SPANS},all:{_SPANS}>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        for texts in batches:
            found = [find_personal_data(t) for t in texts]
            yield pd.DataFrame({"open": [as_rows(b) for b, _ in found], "all": [as_rows(a) for _, a in found]})

    return docs.withColumn(to, of(F.col(text)))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text``, open or disguised, replaced by its kind in angle brackets.

    Spans that overlap are replaced together, under the kind of the first. Texts without any are unchanged.
    """
    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([mask(t) for t in texts], dtype="object")

    return docs.withColumn(text, of(F.col(text)))


def mask(text: str | None) -> str | None:
    """``text`` with its spans replaced by their kinds."""
    if not text:
        return text
    parts, at = [], 0
    for kind, start, end in sorted(find_personal_data(text)[1], key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def op12_personal_data(spark, folder: str) -> DataFrame:
    """Counts and digest of the open identifiers and the list of all spans, for all documents."""
    found = with_spans(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")).select("doc_id", "personal")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("personal.open", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *[number(kind).alias(f"n_{kind}") for kind in KINDS],
                        F.sha2(listed("personal.open"), 256).alias("base_sha256"), listed("personal.all").alias("spans"))


QUERIES = {"op12_personal_data": op12_personal_data}
