"""Consistent forms of text: what is not visible is folded, what is visible stays.

Folded: full and half width, canonical equivalents, characters without width, the kind of
a space, compatibility and radical ideographs, letters of another script with the same
shape. Kept: case, number of spaces, tabs, line breaks, all other punctuation, and
compatibility characters that look different (superscripts, circled digits, unit signs).
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter

LATIN, GREEK, CYRILLIC, ARMENIAN, CHEROKEE, LISU = range(6)

# Letters of other scripts that have the shape of a Latin letter.
GREEK_SHAPES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
}
CYRILLIC_SHAPES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "ѕ": "s", "і": "i",
    "ј": "j", "ԛ": "q", "ԝ": "w", "ԁ": "d", "һ": "h", "ӏ": "l", "ү": "y",
}

OTHER_SHAPES = {
    "Օ": "O", "օ": "o", "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M",
    "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F",
    "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y",
    "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# Letters that many typefaces draw much like a Latin letter; what they stand for depends on their neighbours.
NEAR_SHAPES = {
    "α": "a", "γ": "y", "η": "n", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "β": "ß",
    "г": "r", "к": "k", "п": "n", "ь": "b", "ѡ": "w", "ѵ": "v", "Ь": "b", "Ѵ": "V", "ո": "n", "ս": "u", "հ": "h",
    "ց": "g", "զ": "q", "յ": "j", "Տ": "S", "Ս": "U", "Լ": "L", "ı": "i", "ɡ": "g", "ɑ": "a", "ɩ": "i", "ſ": "f",
    "ʋ": "u", "ᴏ": "o", "Ꭵ": "i", "Ꮟ": "b", "Ꮞ": "4", "Ꮤ": "W", "Ꮢ": "R",
}

_TO_LATIN = {**GREEK_SHAPES, **CYRILLIC_SHAPES, **OTHER_SHAPES}
_OPTIONS: dict[str, list[str]] = {}
for _c, _l in _TO_LATIN.items():
    _OPTIONS.setdefault(_l, [_l]).append(_c)
_NEAR: dict[str, list[str]] = {}
for _c, _l in NEAR_SHAPES.items():
    _NEAR.setdefault(_l, []).append(_c)
    _NEAR.setdefault(_c, []).extend(_OPTIONS.get(_l, [_l]))

#: A token: letters of the scripts above with their combining marks.
TOKEN = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ʯ̀-ͯͰ-ͽͿ-ΆΈ-ϿЀ-ҁ҃-ԯԱ-Ֆՙ-ևᎠ-ᏽᴀ-ᴫḀ-῿ꓐ-ꓷꭰ-ꮿ]+")

# Format characters that are seen, unlike the rest of their category.
_SEEN_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}


def ignorable(cp: int) -> bool:
    """Has no width: format characters, variation selectors, joiners, controls that are no white space."""
    if cp in _SEEN_FORMAT:
        return False
    if cp == 0x34F or 0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
        return True
    cat = unicodedata.category(chr(cp))
    return cat == "Cf" or (cat == "Cc" and not 9 <= cp <= 13 and not 0x1C <= cp <= 0x1F and cp != 0x85)


class _Shapes(dict):
    """str.translate table, filled as code points are met: width, spaces, radicals; drops ignorables."""

    def __missing__(self, cp: int):
        ch = chr(cp)
        out: str | int | None = cp
        if cp > 0x7E or cp < 0x20:
            kind = unicodedata.decomposition(ch)
            if ignorable(cp):
                out = None
            elif unicodedata.category(ch) == "Zs":
                out = " "
            elif kind.startswith(("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")):
                out = "".join(chr(int(x, 16)) for x in kind.split()[1:])
            elif 0x2E80 <= cp <= 0x2FDF and kind.startswith("<compat>"):
                out = chr(int(kind.split()[1], 16))
        self[cp] = out
        return out


SHAPES = _Shapes()


def base_form(text: str) -> str:
    """Compatibility normalization of the invisible kinds and deletion of ignorable characters."""
    if text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFC", text.translate(SHAPES))


def script_of(ch: str) -> int:
    if "Ͱ" <= ch <= "Ͽ" or "ἀ" <= ch <= "῿":
        return GREEK
    if "Ѐ" <= ch <= "ԯ":
        return CYRILLIC
    if "\u0531" <= ch <= "\u0587":
        return ARMENIAN
    if "\u13a0" <= ch <= "\u13fd" or "\uab70" <= ch <= "\uabbf":
        return CHEROKEE
    return LISU if "\ua4d0" <= ch <= "\ua4f7" else LATIN


def skeleton(token: str) -> str:
    """Decomposed token with every letter that has a Latin twin replaced by it."""
    return "".join([_TO_LATIN.get(c, c) for c in unicodedata.normalize("NFD", token)])


class LatticeReader:
    """Reads each token as the best path through the lattice of what its letters may stand for.

    A letter may stand for any letter of its shape, at no price, or for one of a similar shape,
    at the price NEAR. A path pays SWITCH for every change of script, so a reading in one script
    is taken wherever there is one; among those the letters are scored by bigrams of tokens
    written in one script (counts over all texts). The lattice is the same for all letters of
    one shape, so look-alikes are read alike; whether a similar letter (a rho for a p) is one
    is decided by its neighbours and the bigrams.
    """

    SWITCH, NEAR = 1e4, 9.0

    def __init__(self, bigrams: dict[str, int] | None = None, cache_size: int = 200_000):
        self.bigrams = bigrams or {}
        self.first = Counter()
        for pair, n in self.bigrams.items():
            self.first[pair[0]] += n
        self.cache: dict[str, str] = {}
        self.cache_size = cache_size

    def _log(self, a: str, b: str) -> float:
        return math.log((self.bigrams.get(a + b, 0) + 0.1) / (self.first.get(a, 0) + 30.0))

    @staticmethod
    def _arcs(c: str) -> list[tuple[str, float]]:
        return [*((o, 0.0) for o in _OPTIONS.get(c, [c])), *((o, LatticeReader.NEAR) for o in _NEAR.get(c, ()))]

    def _search(self, letters: str) -> str:
        best = {c: (self._log("^", c) - price, c) for c, price in self._arcs(letters[0])}
        for x in letters[1:]:
            step: dict[str, tuple[float, str]] = {}
            for c, price in self._arcs(x):
                s = script_of(c)
                step[c] = max((score + self._log(p, c) - price - self.SWITCH * (script_of(p) != s), path + c) for p, (score, path) in best.items())
            best = step
        # of equal scores the Latin spelling is taken
        return max((score + self._log(p, "$"), -ord(path[0]), path) for p, (score, path) in best.items())[2]

    def token(self, token: str) -> str:
        sk = token if token.isascii() else skeleton(token)
        found = self.cache.get(sk)
        if found is None:
            letters = "".join(c for c in sk if not unicodedata.combining(c))
            # a letter that is Latin only forces all others to their Latin reading, which has no price
            forced = any(c not in _OPTIONS and c not in _NEAR and script_of(c) == LATIN for c in letters)
            if not letters or (forced and all(script_of(c) == LATIN and c not in NEAR_SHAPES for c in letters)):
                found = unicodedata.normalize("NFC", sk)
            else:
                chosen = iter(self._search(letters))
                found = unicodedata.normalize("NFC", "".join(c if unicodedata.combining(c) else next(chosen) for c in sk))
            if len(self.cache) >= self.cache_size:
                self.cache.clear()
            self.cache[sk] = found
        return found

    def text(self, text: str) -> str:
        """The one consistent form of a text."""
        t = base_form(text)
        token, cache = self.token, self.cache
        return TOKEN.sub(lambda m: cache.get(m[0]) or token(m[0]), t)


def pure_tokens(text: str) -> list[str]:
    """Tokens written in one script, for the bigram counts."""
    out = []
    for tok in TOKEN.findall(base_form(text)):
        if tok.isascii() or len({script_of(c) for c in unicodedata.normalize("NFD", tok) if not unicodedata.combining(c)}) == 1:
            out.append(tok)
    return out


def bigram_counts(tokens: Counter) -> Counter:
    """Letter bigrams with ends marked; keys are two characters, of the three scripts only (bounded)."""
    out: Counter = Counter()
    for tok, n in tokens.items():
        t = "^" + "".join(c for c in unicodedata.normalize("NFD", tok) if not unicodedata.combining(c)) + "$"
        for a, b in zip(t, t[1:]):
            out[a + b] += n
    return out


class _Content(dict):
    """Translate table to content: p1 differences, case, and all but letters, digits and marks are gone."""

    def __missing__(self, cp: int):
        shaped = SHAPES[cp]
        if shaped is None:
            self[cp] = None
            return None
        text = unicodedata.normalize("NFD", chr(shaped) if isinstance(shaped, int) else shaped)
        text = "".join(_TO_LATIN.get(c, c) for c in text).casefold()
        text = "".join(_TO_LATIN.get(c, c) for c in text)
        out = "".join(sys.intern(c) for c in text if unicodedata.category(c)[0] in "LMN")
        self[cp] = out or None
        return out or None


CONTENT = _Content()


def has_word(text: str | None) -> bool:
    """Has a letter or digit."""
    return bool(text) and any(c.isalnum() or unicodedata.category(c)[0] in "LN" for c in text)


def content(text: str | None) -> str:
    """The text as compared for copies: '' if it has no letter or digit."""
    if not text:
        return ""
    out = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(CONTENT))
    if out and not out[0].isalnum() and not has_word(out):
        return ""
    return out


_SEPARATOR = re.compile("[\n\r\x0b\x0c\x85  |｜;；/／]")
_FIELD = re.compile(r"\s*([^:：]+)[:：](.+)", re.S)
_NAME_ENDS = re.compile(r"[。！？।…]|[.!?][\"”’»)*_]*\s")  # a sentence ends before the colon
_INNER_END = re.compile(r"[。！？!?।…][\"”’」』）)]*\w")


def fields(text: str | None) -> list[tuple[str, str]] | None:
    """(name, value) contents if the text is a list of `key: value` fields, else None.

    At least two fields, every part has a name and a value, names are distinct, no sentence
    ends within a name, and no value runs on after a sentence end.
    """
    if not text or (":" not in text and "：" not in text):
        return None
    out, names = [], set()
    for part in _SEPARATOR.split(text):
        name, value = "", ""
        if m := _FIELD.match(part):
            name, value = content(m[1]), content(m[2])
            if not name or not value or name in names or _INNER_END.search(part) or _NAME_ENDS.search(m[1]):
                return None
            names.add(name)
            out.append((name, value))
        elif content(part):
            return None
    return out if len(out) > 1 else None
