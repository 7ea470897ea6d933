"""Personal information in free text: found by a skip-chain conditional random field, replaced by typed placeholders.

The field's variables are the labels of the tokens of a document: the lines of a file, the originals of a pipeline's mappings.
Besides each token's own features (its word, shape, place in a name lexicon, the number or address form it is part of, and those
of its neighbours) there are potentials between neighbouring tokens and between distant tokens with the same word (skip edges, in
a record and between the records of a document), so that a name that is clear in one place is labelled alike in another. A word
is linked with its place before in the record, a capitalised one also with its last place in the document's records before,
however far that is. Labels come from loopy sum-product message passing. It is fitted by pseudo-likelihood on a
bounded sample whose marks come from the forms below and from names of the samples table (distant supervision). Which tokens
are a name is the field's decision; the lexicon is one of its features, which the fit hides at every third name, so that names that
stand in no lexicon are found by their shape, their neighbours and their other places.

Only lines that hold something like a candidate (one cheap test each, which lets unknown pairs of capitalised words through) are
passed through the field; the test looks at whole lines, and the texts are scanned once. Lines that may be linked with others are
shuffled by document; those of a large document by ranges of its order (blocks of bounded size), which send each other a message a sweep for each
link between them. So no task holds a large document, and neither that nor how the tables are split changes a result. A label
counts only if what it covers also has the form of its kind.

Defined results: null and blank texts hold nothing; repeated rows are each found; a record with several of one kind gives one
row for that kind.
"""

from __future__ import annotations

import marshal
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import cut
from . import share_of

KINDS = ("EMAIL", "PHONE", "NATIONAL_ID", "ADDRESS", "NAME")
LABELS = ("O", *KINDS)
#: At most so many records are marked for the fit.
TRAIN_RECORDS = 3_000
#: A word is a name of the lexicon if it is one in at least two of all rows, and in this share of them: at most 1 / share words a role.
LEXICON_SHARE = 1e-5
SIZE = 1 << 15
STEPS, SWEEPS = 100, 4
#: About so many records go through the field at a time; a document's, or block's, are not parted.
AT_A_TIME = 400
#: A document with more linkable records than this is several blocks.
BLOCK = 4096
#: What has the form of a kind counts as it unless another label is likelier by more than this (log odds).
NEAR = 4.0
#: And so it is with names that have a name's form by the lexicon; other tokens are names only where no label is likelier.
NEAR_NAME = 1.5

# Titles, and forms of addresses and numbers.
TITLES = {"mr", "mrs", "ms", "miss", "mx", "dr", "prof", "herr", "frau", "sir", "madam", "señor", "señora", "sr", "sra", "monsieur", "madame", "mme", "mlle"}
_STREETS = "street|str|st|avenue|ave|lane|ln|court|ct|road|rd|drive|dr|boulevard|blvd|way|place|pl|terrace|ter|square|sq|close|crescent|cres|walk|parkway|pkwy|highway|hwy|circle|cir|trail|trl|alley"
_WORD = r"[^\W\d_][^\W\d_'’\-]*"
_DOM = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"[^\W_](?:[\w.+\-]*[^\W_])?"
_AT = r"(?:\s?@\s?|%40|\s?[\(\[\{<]\s?at\s?[\)\]\}>]\s?|\s+AT\s+|\s+at\s+(?=\S+\s+dot\s))"
_DOT = r"(?:\.|\s?[\(\[\{<]\s?dot\s?[\)\]\}>]\s?|\s+DOT\s+|\s+dot\s+)"
EMAIL = re.compile(rf"(?<![\w.+%-]){_LOCAL}{_AT}{_DOM}(?:{_DOT}{_DOM})*{_DOT}[A-Za-z]{{2,24}}(?![\w-])", re.I)
PHONE = re.compile(
    r"(?<![\w.+/:-])(?:"
    r"(?:\+|00)\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,4}"
    r"|(?:1[-. ])?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}"
    r"|0\d{1,4}[ /]\d{3,8}(?:[ -]\d{2,5}){0,3}|0\d(?:[ .]\d\d){4}"
    r"|[2-9]\d{2}[2-9]\d{6}"
    r")(?:\s?(?:ext|x|extension|durchwahl)\.? ?\d{1,5})?(?![\w/]|[.-]\w|:\d)"
)
_TAXWORD = r"(?:tax[ _-]?(?:id|no|number)|steuer(?:[ _-]?id(?:entifikations)?(?:nr|nummer)?|nummer)|tin|itin|vat[ _-]?id|ust-?id(?:nr)?|nif|dni|nie|curp|insee|svnr|ahv)"
_PASSWORD = r"(?:passport|reisepass|passeport|pasaporte|ausweis|personalausweis|id[ _-]card)(?:[ _-]?(?:no\.?|number|nr\.?|num|nummer|#))?"
_SSNWORD = r"(?:ssn|social[ _-]security(?:[ _-](?:no\.?|number|nr\.?|num|#))?|national[ _-](?:id|insurance)(?:[ _-](?:no\.?|number|nr\.?))?|nino|sozialversicherungs\w*|seguridad social)"
NATIONAL_ID = re.compile(
    rf"(?<![\w-])(?:\d{{3}}[- ]\d{{2}}[- ]\d{{4}}(?![\w-])|(?-i:[A-Z]{{2}}) ?\d\d ?\d\d ?\d\d ?(?-i:[A-D])(?![\w-])"
    rf"|{_SSNWORD}\s?[:#=]?\s?[#:]?\s?\d{{3}}[ -]?\d{{2}}[ -]?\d{{4}}(?!\w)|{_TAXWORD}\s?[:#=]?\s?[A-Z]{{0,2}}\d(?:[ /-]?\d){{7,11}}[A-Z]?(?!\w)|{_PASSWORD}\s?[:#=]?\s?[A-Z]{{0,3}}\d{{6,9}}[A-Z]?(?!\w))",
    re.I,
)
ADDRESS = re.compile(
    rf"(?<![\w.-])(?:(?:flat|apt|apartment|unit|suite|ste)\.? \d+\w?, )?\d{{1,5}}[A-Za-z]? (?:{_WORD} ){{1,4}}(?:{_STREETS})\b\.?(?!\w)"
    r"|\bp\.? ?o\.? ?box \d+|\bpostfach \d[\d ]*|\bapartado \d+"
    rf"|\b{_WORD} (?:straße|strasse) \d{{1,4}} ?[a-z]?\b"
    rf"|\b[^\W\d_]{{2,}}(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer|steig|chaussee|graben) \d{{1,4}} ?[a-z]?\b(?! (?:von|of|mal|ms|lines))"
    rf"|\b(?:am|an der|an den|im|in der|auf dem|auf der|zum|zur|unter den|calle|avenida|plaza|rue|avenue|via|piazza) {_WORD}(?: {_WORD})?,? \d{{1,4}} ?[a-z]?(?=,|$|[^\w]|\Z)",
    re.I,
)
_FORMS = ((EMAIL, 1), (NATIONAL_ID, 3), (ADDRESS, 4), (PHONE, 2))
_NINO = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2} ?\d\d ?\d\d ?\d\d ?[A-Da-d](?![\w-])")
#: How the id words of NATIONAL_ID begin.
_ID_STARTS = ("ssn", "social", "national", "nino", "sozialversicherungs", "seguridad", "tax", "steuer", "tin", "itin", "vat", "ust", "nif", "dni", "nie", "curp", "insee", "svnr", "ahv", "passport", "reisepass", "passeport", "pasaporte", "ausweis", "personalausweis")
#: Letters and digits that the patterns take for ASCII ones, but lower() or the digit mask doesn't.
_ODD = re.compile("(?![0-9])\\d|[\u0131\u0130\u017f\u212a]")
_AT_WORD = re.compile(r"at(?<=[\s(\[{<]at)[\s)\]}>]")
#: How the forms of a phone number that begin with 0 do.
_ZERO = re.compile(r"0(?<![\w.+/:-]0)(?:0\d|\d{1,4}[ /]\d{3}|\d(?:[ .]\d\d){4})")
_DIGIT_MASK = bytes.maketrans(b"123456789", b"000000000")
_ADDRESS_WORDS = set(_STREETS.split("|")) | {"box", "pobox", "obox", "postfach", "apartado", "am", "im", "zum", "zur", "calle", "avenida", "plaza", "rue", "via", "piazza", "straße", "strasse"}
_AFTER_AT = re.compile(r"\s?[A-Za-z0-9][A-Za-z0-9-]*(?:\s?[.(\[{<\s])")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_ASCII_LETTERS = re.compile("[a-z]{2,}")
_TITLED = re.compile(rf"\b(?i:{'|'.join(sorted(TITLES))})(?:\.\s*|\s+)[^\W\d_a-z]")
_INITIAL = re.compile(r"(?<![\w.])[A-Z]\. ?[A-Z][^\W\d_]{2,}")
#: Two or more capitalised words in a row, as a name in full has; a first word and an initial count too.
_PAIR = re.compile(r"(?<![\w.])[A-Z][^\W\d_A-Z]+(?:[-'][A-Z][^\W\d_]+)?,? (?:[A-Z]\. )?[A-Z][^\W\d_A-Z]+")


def _words(low: str) -> list[str]:
    """The words of a text in lower case."""
    return (_ASCII_LETTERS if low.isascii() else _LETTERS).findall(low)


def _possible(text: str, low: str, words: list[str]) -> int:
    """A bit for each form that a text may hold; a cheap look before the patterns that passes all they match."""
    if not text.isascii() and _ODD.search(text):
        return 2 | 4 | 8 | 16
    out = 0
    if "%40" in text or "at" in low and _AT_WORD.search(low):
        out = 2
    else:
        at = text.find("@")
        while at >= 0:
            if _AFTER_AT.match(text, at + 1):
                out = 2
                break
            at = text.find("@", at + 1)
    m = text.encode("utf-8", "replace").translate(_DIGIT_MASK).decode("latin-1")  # a look into bytes takes longer
    if "00" in m:
        # What each form of a phone number holds somewhere, with every digit as 0, or begins with.
        if "000-0000" in m or "000.0000" in m or "000 0000" in m or "+0" in m or "0000000000" in m or _ZERO.search(text):
            out |= 4
        if "00-0000" in m or "00 0000" in m or ("00 00 00" in m or "0000" in m) and _NINO.search(text):
            out |= 8
    if not out & 8 and "0" in m and ("id" in words or any(w.startswith(_ID_STARTS) for w in words)):
        out |= 8
    if not _ADDRESS_WORDS.isdisjoint(words) or (
        "str" in low and ("straße" in low or "strasse" in low or "str." in low) or "gasse" in low or "weg " in low or "allee" in low or "platz" in low or "ring " in low or "damm " in low
        or "ufer" in low or "steig" in low or "graben" in low or "chaussee" in low or "in der " in low or "an der " in low or "an den " in low or "auf de" in low or "unter den" in low
    ):
        out |= 16
    return out


def forms(text: str) -> list[tuple[int, int, int]]:
    """(start, end, label) of what has the form of an address or number, without overlaps; URLs' user parts are none."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    may = _possible(text, low, _words(low))
    for rx, label in _FORMS:
        if not may >> label & 1:
            continue
        for m in rx.finditer(text):
            a, b = m.span()
            if label == 1:
                # What stands before it without a space tells a URL's user from a mailbox.
                before = text[:a]
                cut = max(before.rfind(" "), before.rfind('"'), before.rfind("'"), before.rfind("="), before.rfind("`"), before.rfind("<"), before.rfind("("))
                if "://" in before[cut + 1 :] or text[b : b + 2] == ":/":
                    continue
            elif label == 2 and not _plausible_phone(m[0]):
                continue
            elif label == 4 and not _plausible_address(m[0]):
                continue
            if all(b <= x or a >= y for x, y, _ in out):
                out.append((a, b, label))
    return sorted(out)


def _plausible_phone(s: str) -> bool:
    digits = "".join(c for c in s if c.isdigit())
    return 7 <= len(digits) <= 20 and len(set(digits)) > 2 and not re.match(r"\d{4}[-/.]\d\d[-/.]\d\d", s)


def _plausible_address(s: str) -> bool:
    words = re.findall(r"[^\W\d_]{2,}", s)
    low = [w.lower() for w in words]
    if "box" in low or low[:1] in (["postfach"], ["apartado"]):
        return True
    if low[0] in ("am", "an", "im", "in", "auf", "zum", "zur", "unter", "calle", "avenida", "plaza", "rue", "avenue", "via", "piazza"):
        return words[0][0].isupper() and words[-1][0].isupper() and len(words[-1]) > 2
    return all(w[0].isupper() for w in words) or not {"of", "the", "for", "in", "at", "to", "on", "after", "and", "with", "is", "per", "by", "from", "a", "an"} & set(low)


@dataclass
class Lexicon:
    given: set[str] = field(default_factory=set)
    family: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.all = self.given | self.family

    def of(self, word: str) -> int:
        """0 unknown, 1 given name, 2 family name, 3 title, 4 initial."""
        w = word.lower()
        if w in self.given:
            return 1
        if w in self.family:
            return 2
        return 3 if w in TITLES else 4 if len(word) == 1 and word.isupper() else 0


def name_words(names: list[str]) -> tuple[Counter, Counter]:
    """Counts of given and of family names in free-text names: ``Given Family``, ``Family, Given``, ``Title Family``, ``I. Family``."""
    given: Counter = Counter()
    family: Counter = Counter()
    for n in names:
        parts = [p for p in re.split(r"\s+", n.replace(",", " , ").strip()) if p]
        if "," in parts:
            k = parts.index(",")
            first, last = parts[k + 1 :], parts[:k]
        else:
            first, last = parts[:-1], parts[-1:]
        if len(parts) < 2 or any(re.search(r"[\d@]", p) for p in parts):
            continue
        for p in first:
            w = p.strip(".").lower()
            if len(w) > 2 and w not in TITLES and w.isalpha():
                given[w] += 1
        for p in last:
            for w in p.lower().split("-"):
                if len(w) > 2 and w.isalpha():
                    family[w] += 1
    return given, family


def lexicon(names: list[str], least: int = 2) -> Lexicon:
    return lexicon_of(*name_words(names), least)


def lexicon_of(given: dict[str, int], family: dict[str, int], least: float = 2) -> Lexicon:
    return Lexicon({w for w, c in given.items() if c >= least and c >= family.get(w, 0)}, {w for w, c in family.items() if c >= least and c > given.get(w, 0)})


def candidate(text: str, lex: Lexicon) -> bool:
    """Whether a line can hold personal information at all."""
    low = text.lower()
    words = _words(low)
    if not lex.all.isdisjoint(words):
        return True
    may = _possible(text, low, words)
    if may & 4 and any(_plausible_phone(m[0]) for m in PHONE.finditer(text)) or may & 2 and EMAIL.search(text) or may & 8 and NATIONAL_ID.search(text) or may & 16 and ADDRESS.search(text):
        return True
    return bool(not TITLES.isdisjoint(words) and _TITLED.search(text) or ". " in text and _INITIAL.search(text) or _PAIR.search(text))


def _shape(w: str) -> str:
    if w.isdigit():
        return "9" * min(len(w), 6)
    if w.isalpha():
        return "A" if len(w) == 1 and w.isupper() else "AA" if w.isupper() else "Aa" if w[0].isupper() else "a"
    return "a9" if w.isalnum() else w


def _slot(*parts: object) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode()) & (SIZE - 1)


class Record:
    """A record's tokens: where they stand, the form each is part of, and the edges between them."""

    __slots__ = ("text", "words", "at", "form", "skips", "spans", "doc", "capitals")

    def code(self) -> np.ndarray:
        """The form of each token; that of a token which is one by itself counts as another."""
        f = self.form
        same_left, same_right = np.zeros(len(f), bool), np.zeros(len(f), bool)
        same_left[1:], same_right[:-1] = f[1:] == f[:-1], f[1:] == f[:-1]
        return f + (len(LABELS) - 1) * ((f > 0) & ~same_left & ~same_right)

    def __init__(self, text: str, doc: object = None, lex: Lexicon | None = None, known: tuple[list, np.ndarray] | None = None) -> None:
        """known: the record's spans and form, if they have been worked out before."""
        self.text, self.doc = text, doc
        found = list(_TOKEN.finditer(text))
        self.words, self.at = [m[0] for m in found], [m.span() for m in found]
        self.spans, self.form = known or (forms(text), np.zeros(len(found), np.int64))
        if known is None:
            k = 0
            for i, (a, b) in enumerate(self.at):
                while k < len(self.spans) and self.spans[k][1] <= a:
                    k += 1
                if k < len(self.spans) and self.spans[k][0] <= a and b <= self.spans[k][1]:
                    self.form[i] = self.spans[k][2]
            if lex is not None:
                self.form[name_marks(self, lex)] = 5  # a feature as the other forms are, and as open to doubt
        last: dict[str, int] = {}
        self.skips: list[tuple[int, int]] = []
        self.capitals: list[tuple[int, str]] = []
        for i, w in enumerate(self.words):
            if len(w) > 2 and w.isalpha():
                low = w.lower()
                if low in last and i - last[low] > 1:
                    self.skips.append((last[low], i))
                last[low] = i
                if doc is not None and w[0].isupper():
                    self.capitals.append((i, low))


def name_marks(r: Record, lex: Lexicon) -> np.ndarray:
    """Which tokens are part of a person's name by the lexicon's names in full, with a title, or with an initial."""
    n = len(r.words)
    kind = [0 if r.form[i] else lex.of(w) for i, w in enumerate(r.words)]
    out = np.zeros(n, bool)

    # A capitalised word that stands in no lexicon goes with a given or a family name, a title or an initial beside it.
    for i in range(n - 1):
        j = i + 2 if kind[i] in (3, 4) and r.words[i + 1] == "." else i + 1 if kind[i] == 3 else n
        if j < n and not kind[j] and not r.form[j] and _shape(r.words[j]) == "Aa" and len(r.words[j]) > 2 and r.words[i][0].isupper():
            kind[j] = 2
        if r.at[i + 1][0] == r.at[i][1] + 1 and r.text[r.at[i][1]] == " ":
            if kind[i] == 1 and not kind[i + 1] and not r.form[i + 1] and _shape(r.words[i + 1]) == "Aa" and len(r.words[i + 1]) > 2 and r.words[i][0].isupper():
                kind[i + 1] = 2
            elif kind[i + 1] == 2 and not kind[i] and not r.form[i] and _shape(r.words[i]) == "Aa" and len(r.words[i]) > 2 and r.words[i + 1][0].isupper():
                kind[i] = 1

    def surname(i: int) -> int:
        """End of a family name that starts at i (with a second one behind a hyphen)."""
        if i < n and kind[i] in (1, 2) or (i < n and kind[i] == 2):
            return i + 3 if i + 2 < n and r.words[i + 1] == "-" and kind[i + 2] in (1, 2) and r.at[i + 1][0] == r.at[i][1] else i + 1
        return 0

    i = 0
    while i < n:
        j = 0
        k = i + 1
        if kind[i] == 1:
            while k < n and (kind[k] == 4 or r.words[k] == "." and kind[k - 1] == 4):
                k += 1
            j = surname(k)
        elif kind[i] == 3 or kind[i] == 4 and k < n and r.words[k] == ".":
            k += k < n and r.words[k] == "."
            j = surname(k)
        if not j and kind[i] == 2:
            e = surname(i)
            if e and e + 1 < n and r.words[e] == "," and kind[e + 1] == 1:
                j = e + 2
        if j:
            out[i:j] = True
            i = j
        else:
            i += 1
    return out


def unmarked_pairs(r: Record) -> np.ndarray:
    """Which tokens are part of a pair of capitalised words without a mark; what follows a number or address is its town and no pair."""
    out = np.zeros(len(r.words), bool)
    spans = [m.span() for m in _PAIR.finditer(r.text)]
    for i, (a, b) in enumerate(r.at):
        out[i] = not r.form[i] and not r.form[max(0, i - 5) : i].any() and any(x <= a and b <= y for x, y in spans)
    return out


@dataclass
class Field:
    """The fitted field; weights of a token's features for itself, its left and its right neighbour, forms, and both kinds of edges."""

    lex: Lexicon
    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    forms: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    #: The words of the fit; others share the features of an unknown word.
    vocabulary: frozenset = frozenset()

    def __post_init__(self) -> None:
        self._ids: dict[str, int] = {}
        self._rows = np.zeros((0, 3 * len(LABELS)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ids": {}, "_rows": np.zeros((0, 3 * len(LABELS)))}

    def features(self, w: str, hidden: bool = False) -> tuple[int, ...]:
        low = w.lower()
        word, kind = "9" if w.isdigit() else low, self.lex.of(w)
        if hidden or w.isalpha() and low not in self.vocabulary and not kind:
            return _slot("w", "?"), _slot("s", _shape(w)), _slot("l", 0, _shape(w)), _slot("e", "?")
        return _slot("w", word), _slot("s", _shape(w)), _slot("l", kind, _shape(w)), _slot("e", low[-3:]) if w.isalpha() and len(w) > 4 else _slot("e", "")

    def _potentials(self, words: list[str]) -> np.ndarray:
        """A row for each word: what it adds to its own, its right and its left neighbour's labels; each distinct word is worked out once."""
        ids = self._ids
        if len(ids) > 100_000:
            ids.clear()
            self._rows = self._rows[:0]
        new = [w for w in dict.fromkeys(words) if w not in ids]
        if new:
            slots = np.array([self.features(w) for w in new])
            ids.update(zip(new, range(len(ids), len(ids) + len(new))))
            self._rows = np.concatenate([self._rows, np.concatenate([self.own[slots].sum(1), self.left[slots].sum(1), self.right[slots].sum(1)], 1)])
        return self._rows[[ids[w] for w in words]]

    def node(self, records: list[Record]) -> np.ndarray:
        k = len(LABELS)
        each = self._potentials([w for r in records for w in r.words])
        form = np.concatenate([r.code() for r in records])
        first = np.zeros(len(form), bool)
        sizes = np.array([len(r.words) for r in records])
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        s = each[:, :k] + self.forms[1][form]
        left, right = each[:, k : 2 * k] + self.forms[0][form], each[:, 2 * k :] + self.forms[2][form]
        go = ~first[1:]
        s[1:][go] += left[:-1][go]
        s[:-1][go] += right[1:][go]
        return s

    def edges(self, records: list[Record]) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of tokens, which of them are skip edges)."""
        sizes = np.array([len(r.words) for r in records])
        base = np.cumsum(sizes) - sizes
        here = np.concatenate([np.arange(b, b + n - 1) for b, n in zip(base, sizes) if n > 1] or [np.zeros(0, int)])
        skips = [(b + i, b + j) for b, r in zip(base.tolist(), records) for i, j in r.skips]
        last: dict[tuple, int] = {}
        for b, r in zip(base.tolist(), records):
            for i, w in r.capitals:
                before = last.get((r.doc, w), b)
                if before < b:
                    skips.append((before, b + i))
                last[r.doc, w] = b + i
        far = np.array(skips or np.zeros((0, 2)), int)
        pairs = np.concatenate([np.stack([here, here + 1], 1), far]).astype(int)
        return pairs, np.arange(len(pairs)) >= len(here)

    def beliefs(self, records: list[Record]) -> np.ndarray:
        """The log marginal of each token's labels, up to a constant, after loopy message passing."""
        return self.swept(records, SWEEPS)[0]

    def swept(self, records: list[Record], sweeps: int, at: np.ndarray | None = None, back: np.ndarray | None = None, heard: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """(beliefs after so many sweeps, what the tokens ``at`` say in each sweep and the next to those elsewhere that they are linked with).

        ``back`` tells whether a link leads to a later record; ``heard`` is what its other end said in each of the sweeps.
        """
        k = len(LABELS)
        node = self.node(records)
        pairs, far = self.edges(records)
        n, a, b = int((~far).sum()), pairs[:, 0], pairs[:, 1]
        at = np.zeros(0, int) if at is None else at
        chain, skip = np.exp(self.chain - self.chain.max()), np.exp(self.skip - self.skip.max())
        fwd, bwd, came = np.zeros((len(pairs), k)), np.zeros((len(pairs), k)), np.zeros((len(at), k))
        said = []
        scaled = lambda x: np.exp(x - x.max(1, keepdims=True))
        logs = lambda m: np.log(m / m.max(1, keepdims=True) + 1e-30)

        def passed(x: np.ndarray, there: bool) -> np.ndarray:
            """The messages over all edges, each up to a constant: sums over labels as matrix products."""
            p = scaled(x)
            return logs(np.concatenate([p[:n] @ (chain if there else chain.T), p[n:] @ (skip if there else skip.T)]))

        def believed() -> np.ndarray:
            out = node.copy()
            for c in range(k):
                out[:, c] += np.bincount(b, fwd[:, c], len(node)) + np.bincount(a, bwd[:, c], len(node))
                if len(at):
                    out[:, c] += np.bincount(at, came[:, c], len(node))
            own = out[at] - came
            said.append(own - own.max(1, keepdims=True))
            return out

        for i in range(sweeps):
            belief = believed()
            fwd, bwd = passed(belief[a] - bwd, True), passed(belief[b] - fwd, False)
            if len(at):
                p = scaled(heard[i])
                came = logs(np.where(back[:, None], p @ skip.T, p @ skip))
        belief = believed()
        return belief - belief.max(1, keepdims=True), said

    def spans(self, texts: list[str], docs: list | None = None) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the personal information in each text; texts of one document are looked at together."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        some = [(i, Record(t, docs[i] if docs else None, self.lex)) for i, t in enumerate(texts) if t and candidate(t, self.lex)]
        some.sort(key=lambda x: (x[1].doc is not None, x[1].doc or ""))
        for (i, _), found in zip(some, self.spans_of([r for _, r in some])):
            out[i] = found
        return out

    def spans_of(self, records: list[Record]) -> list[list[tuple[int, int, str]]]:
        """The same of records; those of a document follow one another."""
        out, start = [], 0
        for k in range(1, len(records) + 1):
            if k == len(records) or k - start >= AT_A_TIME and (records[k].doc is None or records[k].doc != records[k - 1].doc):
                part = records[start:k]
                some = [r for r in part if r.words]
                out += self.decoded(part, self.beliefs(some) if some else np.zeros((0, len(LABELS))))
                start = k
        return out

    def decoded(self, records: list[Record], y: np.ndarray) -> list[list[tuple[int, int, str]]]:
        ends = np.cumsum([len(r.words) for r in records]).tolist()
        return [self._decoded(r, y[e - len(r.words) : e]) for r, e in zip(records, ends)]

    def _decoded(self, r: Record, y: np.ndarray) -> list[tuple[int, int, str]]:
        found = []
        for a, b, label in r.spans:
            inside = [i for i, (x, z) in enumerate(r.at) if x >= a and z <= b]
            if inside and y[inside, label].mean() >= -NEAR:
                found.append((a, b, LABELS[label]))
        i, n = 0, len(y)
        name = y[:, 5] >= np.where(r.form == 5, -NEAR_NAME, 0)
        # A point, comma or hyphen within a name's form goes with the words around it.
        for k in range(1, n - 1):
            if r.form[k] == 5 and not r.words[k].isalpha() and name[k - 1] and name[k + 1]:
                name[k] = True
        while i < n:
            j = i
            while j < n and name[j] and r.form[j] in (0, 5):
                j += 1
            if j > i:
                while i < j and not r.words[i].isalpha():
                    i += 1
                e = j
                while e > i and not r.words[e - 1].isalpha():
                    e -= 1
                # A town behind an address isn't a name, unless the lexicon says so.
                town = e > i and not (r.form[i:e] == 5).any() and any(label == 4 and b <= r.at[i][0] and not r.text[b : r.at[i][0]].strip(" ,0123456789") for _, b, label in r.spans)
                if e > i and not town and self._is_name(r.words[i:e]):
                    found.append((r.at[i][0], r.at[e - 1][1], "NAME"))
            i = max(j, i + 1)
        return sorted(found)

    def _is_name(self, words: list[str]) -> bool:
        """In full, or by title or initial and surname."""
        kinds = [self.lex.of(w) for w in words if w.isalpha()]
        long_ = [w for w in words if w.isalpha() and len(w) > 1 and self.lex.of(w) != 3]
        return len(long_) >= 2 and all(w[0].isupper() or self.lex.of(w) in (1, 2) for w in long_) or len(long_) == 1 and any(k in (3, 4) for k in kinds)


def fit(texts: list[str], lex: Lexicon, docs: list | None = None) -> Field:
    """Pseudo-likelihood: each token's label given its features and its neighbours' marks, along the chain and the skips.

    Marks of names come from the lexicon; those of every third record are shown to the fit as unknown words.
    """
    k = len(LABELS)
    zero = lambda *s: np.zeros((*s, k))
    f = Field(lex, zero(SIZE), zero(SIZE), zero(SIZE), zero(3, 2 * k - 1), zero(k), zero(k))
    records = [r for r in (Record(t, docs[i] if docs else None, lex) for i, t in enumerate(texts)) if r.words]
    if not records:
        f.forms[1][np.arange(1, 2 * k - 1), np.r_[np.arange(1, k), np.arange(1, k)]] = 8.0
        return f
    y = np.concatenate([r.form for r in records])
    named = y == 5
    words = [w for r in records for w in r.words]
    # Pairs of capitalised words that no lexicon knows may be names or not: they teach nothing.
    unclear = np.concatenate([unmarked_pairs(r) for r in records])
    open_words = {w.lower() for w, u in zip(words, unclear) if u}
    f.vocabulary = frozenset(low for w, is_name in zip(words, named) if w.isalpha() and not is_name and (low := w.lower()) not in open_words)
    number = np.concatenate([np.full(len(r.words), i) for i, r in enumerate(records)])
    unknown = named & (number % 3 == 0)
    slots = np.array([f.features(w, hide) for w, hide in zip(words, unknown.tolist())])
    form = np.where(unknown, 0, np.concatenate([r.code() for r in records]))
    known = ~unclear[:, None]
    pairs, far = f.edges(records)
    near = pairs[~far]
    has_left = np.zeros(len(y), bool)
    has_left[near[:, 1]] = True
    has_right = np.zeros(len(y), bool)
    has_right[near[:, 0]] = True
    left_of, right_of = np.roll(np.arange(len(y)), 1), np.roll(np.arange(len(y)), -1)
    skips = pairs[far]
    gold = np.eye(k)[y]
    params = {"own": f.own, "left": f.left, "right": f.right, "forms": f.forms, "chain": f.chain, "skip": f.skip}
    memory = {n: np.full(p.shape, 1e-6) for n, p in params.items()}
    hl, hr = has_left[:, None], has_right[:, None]
    flat, width = slots.ravel(), slots.shape[1]
    for _ in range(STEPS):
        s = f.own[slots].sum(1) + f.forms[1][form]
        s += hl * (f.left[slots[left_of]].sum(1) + f.forms[0][form[left_of]] + f.chain[y[left_of]])
        s += hr * (f.right[slots[right_of]].sum(1) + f.forms[2][form[right_of]] + f.chain.T[y[right_of]])
        if len(skips):
            np.add.at(s, skips[:, 1], f.skip[y[skips[:, 0]]])
            np.add.at(s, skips[:, 0], f.skip.T[y[skips[:, 1]]])
        p = np.exp(s - s.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - gold) * known
        grads = {n: np.zeros_like(v) for n, v in params.items()}
        gl, gr = g * hl, g * hr
        # A neighbour's gradient goes to its slots: the roles differ only by a shift of the tokens.
        to_left, to_right = np.roll(gl, -1, 0), np.roll(gr, 1, 0)
        for c in range(k):
            grads["own"][:, c] = np.bincount(flat, np.repeat(g[:, c], width), SIZE)
            grads["left"][:, c] = np.bincount(flat, np.repeat(to_left[:, c], width), SIZE)
            grads["right"][:, c] = np.bincount(flat, np.repeat(to_right[:, c], width), SIZE)
        np.add.at(grads["forms"][1], form, g)
        np.add.at(grads["forms"][0], form[left_of], gl)
        np.add.at(grads["forms"][2], form[right_of], gr)
        np.add.at(grads["chain"], y[left_of], gl)
        np.add.at(grads["chain"].T, y[right_of], gr)
        if len(skips):
            np.add.at(grads["skip"], y[skips[:, 0]], g[skips[:, 1]])
            np.add.at(grads["skip"].T, y[skips[:, 1]], g[skips[:, 0]])
        for n, v in params.items():
            d = grads[n] + 0.02 * v
            memory[n] += d * d
            v -= 0.5 * d / np.sqrt(memory[n])
    return f


def records_of(line_matches: DataFrame, mapping_entries: DataFrame, samples: DataFrame) -> DataFrame:
    """(field, record_id, text, doc, place) of the four fields; the doc is the file or the pipeline, place orders its records, samples stand alone."""
    col = lambda df, c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind)
    row = lambda df, f, i, doc, place: df.select(F.lit(f).alias("field"), F.col(i).cast("long").alias("record_id"), F.col(f).alias("text"), col(df, doc, "string").alias("doc"), F.coalesce(col(df, place, "long"), F.col(i).cast("long"), F.lit(0)).alias("place")).filter("text is not null")
    return (
        row(line_matches, "original_line", "line_id", "path", "line_number")
        .unionByName(row(mapping_entries, "original", "entry_id", "pipeline_id", "entry_id"))
        .unionByName(row(samples, "email", "sample_id", None, None))
        .unionByName(row(samples, "phone", "sample_id", None, None))
    )


def names_of(samples: DataFrame) -> Lexicon:
    """The lexicon of all names of a table (name): counts are combined per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, family, rows = Counter(), Counter(), 0
        for b in batches:
            g, f = name_words([n for n in b.column(0).to_pylist() if n])
            given.update(g), family.update(f)
            rows += b.num_rows
        both = list(given.items()) + list(family.items()) + [("", rows)]
        role = ["g"] * len(given) + ["f"] * len(family) + [""]
        yield pa.RecordBatch.from_pydict({"role": pa.array(role, pa.string()), "word": pa.array([w for w, _ in both], pa.string()), "n": pa.array([n for _, n in both], pa.int64())})

    counts = cut(samples.select("name").filter("name is not null").mapInArrow(run, "role string, word string, n bigint").groupBy("role", "word").agg(F.sum("n").alias("n")))
    total = counts.filter("role = ''").agg(F.sum("n")).first()[0] or 0
    least = max(2, total * LEXICON_SHARE)
    found: dict[str, dict[str, int]] = {"g": {}, "f": {}}
    for r in counts.filter((F.col("role") != "") & (F.col("n") >= least)).toLocalIterator():
        found[r.role][r.word] = r.n
    return lexicon_of(found["g"], found["f"], least)


def train(records: DataFrame, names: DataFrame) -> Field:
    """names: (name). The lexicon counts all names; the fit reads TRAIN_RECORDS records, chosen by a hash."""
    lex = names_of(names)
    shared = records.sparkSession.sparkContext.broadcast(lex)
    # About one record in thirty may hold something; a few others go along.
    pick = share_of(records, ["field", "record_id", "text"], 60 * TRAIN_RECORDS).select("doc", "text", F.xxhash64("field", "record_id", "text").alias("_h"))

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([candidate(t, shared.value) for t in texts], pa.bool_())], ["doc", "text", "_h", "hot"])

    rows = pick.mapInArrow(worth, "doc string, text string, _h bigint, hot boolean")
    rows = rows.filter("hot or _h % 32 = 0").orderBy("_h", "text").limit(TRAIN_RECORDS).select("doc", "text").collect()
    return fit([r.text for r in rows], lex, [r.doc for r in rows])


_RESULT = pa.schema([("field", pa.string()), ("record_id", pa.int64()), ("kinds", pa.list_(pa.string())), ("redacted", pa.string())])
#: Results, and the linkable records with their order in their document.
_FIRST = pa.schema([*_RESULT, ("doc", pa.string()), ("place", pa.int64()), ("tie", pa.int64()), ("id", pa.int64()), ("state", pa.binary())])
#: A block's records, and their capitalised words with first and last place.
_BLOCKS = pa.schema([("block", pa.int64()), ("state", pa.binary()), ("field", pa.string()), ("doc", pa.string()), ("place", pa.int64()), ("record_id", pa.int64()), ("tie", pa.int64()), ("id", pa.int64()), ("word", pa.string()), ("first", pa.int32()), ("last", pa.int32())])
#: A block's records, and what is said to its tokens by those of other blocks.
_MAIL = pa.schema([("block", pa.int64()), ("state", pa.binary()), ("id", pa.int64()), ("at", pa.int32()), ("back", pa.bool_()), ("from_block", pa.int64()), ("from_id", pa.int64()), ("from_at", pa.int32()), ("said", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'array<string>' if pa.types.is_list(f.type) else {'int64': 'bigint', 'int32': 'int', 'bool': 'boolean'}.get(str(f.type), str(f.type))}" for f in schema)


def _batch(schema: pa.Schema, rows: list[tuple], *names: str) -> pa.RecordBatch:
    """The rows' named columns (all, if none is named); others are null."""
    given = dict(zip(names or schema.names, zip(*rows)))
    return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(len(rows), f.type) for f in schema], schema=schema)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each block; they are sorted by it, the first column."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[0][0] != row[0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _packed(name: str, record_id: int | None, place: int, tie: int, key: int, r: Record) -> bytes:
    return marshal.dumps(((name, r.doc, place, record_id is not None, record_id or 0, tie, key), r.text, r.form.astype(np.int8).tobytes(), r.spans))


def _unpacked(states: list[bytes]) -> list[tuple[tuple, Record]]:
    """(order, record) in order; a record's document is known by field and name."""
    return [(o, Record(text, o[:2], known=(spans, np.frombuffer(form, np.int8).astype(np.int64)))) for o, text, form, spans in sorted(map(marshal.loads, states))]


def _ends(r: Record) -> dict[str, tuple[int, int]]:
    """The first and last place of a record's capitalised words."""
    out: dict[str, tuple[int, int]] = {}
    for i, w in r.capitals:
        out[w] = out.get(w, (i, i))[0], i
    return out


def _results(some: list[tuple[tuple, Record]], found: list, every: bool) -> pa.RecordBatch:
    return _batch(_RESULT, [(o[0], o[4] if o[3] else None, sorted({k for _, _, k in s}), redact(r.text, s)) for (o, r), s in zip(some, found) if s or every])


def find_spans(records: DataFrame, model: Field, every: bool = False) -> DataFrame:
    """(field, record_id, kinds, redacted) of the records that hold personal information, or with ``every`` of all.

    A scan settles the records without capitalised words of a document, and a shuffle by document the others. Blocks of a large
    document first learn which of their tokens are linked with another block's, from a window over its words. Then, sweep by
    sweep, each tells the others what these tokens say, and after the last its records are settled.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, key = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            names, ids, texts, docs, places = (c.to_pylist() for c in batch.columns)
            settled, lone, linkable = [], [], []
            for i, t in enumerate(texts):
                if not t or not candidate(t, m.lex):
                    if every:
                        settled.append((names[i], ids[i], [], t))
                    continue
                r = Record(t, docs[i], m.lex)
                if r.capitals:
                    key, tie = key + 1, zlib.crc32(t.encode())
                    linkable.append((names[i], ids[i], docs[i], places[i], tie, key, _packed(names[i], ids[i], places[i], tie, key, r)))
                else:
                    r.doc = None
                    lone.append((i, r))
            for (i, _), s in zip(lone, m.spans_of([r for _, r in lone])):
                if s or every:
                    settled.append((names[i], ids[i], sorted({k for _, _, k in s}), redact(texts[i], s)))
            yield _batch(_FIRST, settled, *_RESULT.names)
            yield _batch(_FIRST, linkable, "field", "record_id", "doc", "place", "tie", "id", "state")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The records of whole documents."""
        some: list[tuple[tuple, Record]] = []
        for rows in _groups(batches):
            some += _unpacked([r[1] for r in rows])
            if len(some) >= AT_A_TIME:
                yield _results(some, shared.value.spans_of([r for _, r in some]), every)
                some = []
        yield _results(some, shared.value.spans_of([r for _, r in some]), every)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of large documents, whose records are in order."""
        block, size, doc = TaskContext.get().partitionId() << 33, 0, None
        for batch in batches:
            states, rows = batch.column(0).to_pylist(), []
            blocks = []
            for state in states:
                ((o, r),) = _unpacked([state])
                if size == most or doc != o[:2]:
                    block, size, doc = block + 1, 0, o[:2]
                size += 1
                blocks.append((block, state))
                rows += [(block, o[0], o[1], o[2], o[4] if o[3] else None, o[5], o[6], w, a, b) for w, (a, b) in _ends(r).items()]
            yield _batch(_BLOCKS, blocks, "block", "state")
            yield _batch(_BLOCKS, rows, *(n for n in _BLOCKS.names if n != "state"))

    def sweep(batches: Iterator[pa.RecordBatch], heard: int) -> Iterator[pa.RecordBatch]:
        """What a block's tokens say after so many sweeps; after the last its results."""
        m, k = shared.value, len(LABELS)
        for rows in _groups(batches):
            states, mail = [r for r in rows if r[1] is not None], [r for r in rows if r[1] is None]
            if not mail and heard < SWEEPS:
                yield _batch(_MAIL, states)
                continue
            some = _unpacked([r[1] for r in states])
            base = dict(zip([o[6] for o, _ in some], np.cumsum([0] + [len(r.words) for _, r in some]).tolist()))
            at, back = np.array([base[r[2]] + r[3] for r in mail], int), np.array([r[4] for r in mail], bool)
            came = np.frombuffer(b"".join(r[8] for r in mail), np.float32).reshape(len(mail), heard, k).astype(float)
            y, said = m.swept([r for _, r in some], heard, at, back, [came[:, i] for i in range(heard)])
            if heard == SWEEPS:
                yield _results(some, m.decoded([r for _, r in some], y), every)
            else:
                say = np.stack(said, 1).astype(np.float32)
                yield _batch(_MAIL, states + [(r[5], None, r[6], r[7], not r[4], r[0], r[2], r[3], x.tobytes()) for r, x in zip(mail, say)])

    most, order = BLOCK, ["place", "record_id", "tie", "id"]
    first = cut(records.select("field", "record_id", "text", "doc", "place").mapInArrow(scan, _ddl(_FIRST)))
    linkable = first.filter("state is not null")
    large = cut(linkable.groupBy("field", "doc").agg(F.count("*").alias("n")).filter(F.col("n") > most))
    together = lambda df: df.repartition("block").sortWithinPartitions("block")
    whole = lambda df: together(df.select(F.xxhash64("field", "doc").alias("block"), "state")).mapInArrow(settle, _ddl(_RESULT))
    out = first.filter("kinds is not null").select(*_RESULT.names)
    if large.isEmpty():
        return out.unionByName(whole(linkable))
    # At most one row of large for BLOCK records.
    sized = linkable.join(F.broadcast(large), ["field", "doc"], "left")
    ordered = sized.filter("n is not null").repartitionByRange("field", "doc", *order).sortWithinPartitions("field", "doc", *order)
    blocks = cut(ordered.select("state").mapInArrow(parts, _ddl(_BLOCKS)))
    chain = Window.partitionBy("field", "doc", "word").orderBy(*order)

    def end(at: str, back: bool, other: Callable, other_at: str) -> Column:
        beside = lambda c: other(c).over(chain)
        return F.struct("block", "id", F.col(at).alias("at"), F.lit(back).alias("back"), beside("block").alias("from_block"), beside("id").alias("from_id"), beside(other_at).alias("from_at"), F.lit(b"").alias("said"))

    links = blocks.filter("word is not null").select(end("first", False, F.lag, "last").alias("l"), end("last", True, F.lead, "first").alias("r"))
    links = links.select(F.explode(F.array("l", "r")).alias("x")).select("x.*").filter("block != from_block")
    mail = blocks.filter("state is not null").select("block", "state").unionByName(links, allowMissingColumns=True).select(*_MAIL.names)
    for k in range(SWEEPS + 1):
        mail = together(mail).mapInArrow(lambda b, k=k: sweep(b, k), _ddl(_RESULT if k == SWEEPS else _MAIL))
    return out.unionByName(whole(sized.filter("n is null"))).unionByName(mail)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    for a, b, kind in sorted(spans, reverse=True):
        text = f"{text[:a]}<{kind}>{text[b:]}"
    return text


def find_pii(line_matches: DataFrame, mapping_entries: DataFrame, samples: DataFrame) -> DataFrame:
    """(field, record_id, kind)."""
    records = records_of(line_matches, mapping_entries, samples)
    return find_spans(records, train(records, samples)).select("field", "record_id", F.explode("kinds").alias("kind"))


def redact_pii(line_matches: DataFrame, mapping_entries: DataFrame, samples: DataFrame) -> DataFrame:
    """(field, record_id, redacted) of every record; those without personal information come out as they are."""
    records = records_of(line_matches, mapping_entries, samples)
    return find_spans(records, train(records, samples), every=True).select("field", "record_id", "redacted")
