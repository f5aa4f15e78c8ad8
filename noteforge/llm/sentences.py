"""Sentence units of every document, by semi-Markov dynamic programming over whole spans.

Each line is a lattice whose nodes are the places where a sentence could end. A span between
two nodes is scored as a whole: by its length, how it opens (case, and how often the word
opens lines in this corpus), how it closes (end mark, abbreviation, number, quotation that
goes on), and whether its quotes and brackets are balanced: a span may begin or end inside a
pair of marks, at a price, only if another begins right before the pair and one ends right
behind it. The best chain wins; it is found in one pass, whatever the length of the line.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.forms import _TO_LATIN, SHAPES, has_word, ignorable
from noteforge.session import ship

#: Buckets of the opening-word table: its size does not depend on the corpus.
BUCKETS = 1 << 17
#: Price of a span that begins outside a pair of marks and ends inside, or the other way.
CROSS = 15.0
#: Length from which spans are not too short, and price of each character that lacks.
SHORT, LACKS = 8, 0.25
#: Price of a span without a word.
WORDLESS = 40.0
#: Score of a place at which no sentence ends.
NO_END = -1e6

_LINE = re.compile("[\r\n\x0b\x0c\x85  ]+")
_MARKS = re.compile(r"(?:\s?[.!?。！？．｡।॥…‽⁇⁈⁉]+)+")
_CLOSERS = "”’\"'“»«›」』）)】》〉]}＂＊*_"
_PAIRS = {"“": "”", "「": "」", "『": "』", "(": ")", "（": "）", "【": "】", "《": "》", "〈": "〉", "[": "]", "{": "}", "«": "»"}
_CLOSE = {b: a for a, b in _PAIRS.items()}
_EVEN = '"*'
_ANY_PAIR = re.compile("[" + re.escape("".join({*_PAIRS, *_CLOSE, *_EVEN, "„"})) + "]")
_THAI = re.compile("[\u0e00-\u0e7f]+")
_START = re.compile(r"(?<!\w)[^\W\d_]{2,}")
_SPACE = re.compile(r"\s*")
_TOKEN = re.compile(r"[^\W_]+(?:\.\s?[^\W\d_])*[^\W_]*$|[^\s\d]+$")
_TAIL = re.compile(r"[^\s\W_]+$|[\wऀ-ॿ]+$")

# Abbreviations that stand before what they belong to and never end a sentence ...
NEVER = {
    "dr", "prof", "mr", "mrs", "ms", "st", "sr", "jr", "mt", "rev", "hon", "gen", "col", "capt", "lt", "sgt", "gov",
    "approx", "max", "min", "ca", "vs", "fig", "figs", "vol", "e.g", "i.e", "eg", "ie", "cf", "al", "dept", "est",
    "nr", "inkl", "exkl", "bzw", "z.b", "d.h", "u.a", "z.t", "o.ä", "i.d.r", "u.u", "abb", "bd", "hr", "fr", "str",
    "tel", "geb", "evtl", "ggf", "mind", "sog", "vgl", "zzgl", "hrsg", "डॉ", "प्रो", "श्री", "सुश्री", "पं", "रु", "कु",
}
# ... abbreviations that end one only if the next word opens one ...
EITHER = {"p.m", "a.m", "pm", "am", "etc", "usw", "usf", "inc", "ltd", "co", "corp", "u.s", "u.k", "b.c", "a.d", "v.chr", "n.chr", "आदि", "इत्यादि"}
# ... and words that are abbreviations before a number only.
BEFORE_NUMBER = {"no", "nos", "p", "pp", "art", "sec", "ch", "abs", "kap", "s", "सं"}
#: What stands further before a mark cannot be part of a listed abbreviation or change its reading.
_BACK = 2 * max(map(len, NEVER | EITHER | BEFORE_NUMBER)) + 8
MONTHS_DE = {"januar", "jänner", "februar", "feber", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"}


class _Plain(dict):
    """One character for each: width, kind of space and look-alikes folded, so offsets stay."""

    def __missing__(self, cp: int):
        out = SHAPES[cp]
        if out is None or (isinstance(out, str) and len(out) != 1):
            out = cp
        ch = out if isinstance(out, str) else chr(out)
        if chr(cp) in "。！？．｡（）：；，":
            ch = chr(cp)
        self[cp] = _TO_LATIN.get(ch, ch)
        return self[cp]


_PLAIN = _Plain()


def _wide(c: str) -> bool:
    """Scripts written without spaces between words (Han, kana, fullwidth)."""
    return "⺀" <= c <= "鿿" or "豈" <= c <= "﫿" or "＀" <= c <= "￯" or c >= "\U00020000"


def _thai(c: str) -> bool:
    return "฀" <= c <= "๿"


_NO_WORD = re.compile(r"[^\w]*")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")


def opening_word(text: str, at: int) -> str | None:
    """The word that a sentence starting at `at` opens with; two characters where words have no spaces."""
    at = _NO_WORD.match(text, at).end()
    if at >= len(text):
        return None
    if _wide(text[at]):
        return text[at : at + 2]
    m = _WORD.match(text, at)
    word = m[0].casefold() if m else None
    if word and (wide := next((i for i, c in enumerate(word) if _wide(c)), None)):
        word = word[:wide]
    return word


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def opening_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(2, BUCKETS) counts over all texts: how often a word opens a line, how often it occurs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            opens: Counter = Counter()
            all_words: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                plain = text.translate(_PLAIN)
                for line in _LINE.split(plain):
                    if word := opening_word(line, 0):
                        opens[word] += 1
                for word in _WORD.findall(plain):
                    if _wide(word[0]) or _wide(word[-1]):
                        all_words.update(a + b for a, b in zip(word, word[1:]) if _wide(a))
                        if not _wide(word[0]):
                            all_words[opening_word(word, 0)] += 1
                    else:
                        all_words[word.casefold()] += 1
            for row, counts in enumerate((opens, all_words)):
                for word, n in counts.items():
                    if word:
                        table[row, bucket(word)] += n
        used = np.flatnonzero(table.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(table[0, used]), pa.array(table[1, used])], names=["bucket", "opens", "n"])

    found = docs.select(text_col).mapInArrow(run, "bucket bigint, opens bigint, n bigint").groupBy("bucket").agg(F.sum("opens").alias("opens"), F.sum("n").alias("n"))
    table = np.zeros((2, BUCKETS), np.int64)
    got = found.toPandas()  # at most BUCKETS rows
    table[0, got["bucket"]], table[1, got["bucket"]] = got["opens"], got["n"]
    return table


class Segmenter:
    def __init__(self, counts: np.ndarray | None = None):
        self.counts = np.zeros((2, BUCKETS), np.int64) if counts is None else counts
        self.known: dict[str, float] = {}

    def opens(self, word: str) -> float:
        """How well a word opens a sentence, from the corpus: below 0 if it occurs and does not, by a smoothed rate.

        The rate is that at which words open lines (of pairs of characters a lower one), so it
        says the more the oftener a word was seen, without a step; at most 3.9 against.
        """
        score = self.known.get(word)
        if score is None:
            o, n = (int(x) for x in self.counts[:, bucket(word)])
            usual = 1 / 300 if word and _wide(word[0]) else 1 / 100
            score = min(1.5, max(-3.9, 1.2 * math.log((o + 1) / (n * usual + 1))))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = score
        return score

    def _opening(self, line: str, at: int, odd_case: bool) -> float:
        word = opening_word(line, at)
        if word is None:
            return NO_END  # nothing but marks would follow
        score = self.opens(word)
        m = _NO_WORD.match(line, at)
        first = line[m.end()]
        if first.islower() and not _wide(first) and not odd_case:
            score -= 2.0
        elif first.isupper() and not odd_case:
            score += 1.0
        return score

    def _closing(self, line: str, start: int, marks: str, end: int, odd_case: bool) -> float:
        """Score for a sentence that ends at `end`; its marks begin at `start`."""
        marks = marks.replace(" ", "")
        before = line[start - 1] if start else " "
        after = line[end] if end < len(line) else " "
        quoted = line[start + len(marks) : end].strip(" *)）]】}") != "" and line[end - 1] in "”“\"'’」』»«"
        behind = _SPACE.match(line, end).end()
        following = line[behind : behind + 1]
        if quoted:
            if after in ",，、;；:：" or following in ",，、;；:：":
                return NO_END
            if not after.isspace() and (after.isalnum() or _wide(after)):
                return NO_END
            if following and not following.isupper() and not following.isdigit() and following.isalnum() and not _wide(following):
                return NO_END  # goes on around the quotation; scripts without case too
            if following.isupper() and odd_case:
                return -2.0
            return 2.5
        if after in ",，、;；:：":
            return NO_END
        wide = _wide(before) or _wide(after)
        if set(marks) <= {".", "．"}:
            if len(marks) > 1:
                return 2.0 if not following.islower() or odd_case else -1.0
            if after.isalnum() and not wide:
                return NO_END
            if before.isdigit() and after.isdigit():
                return NO_END
            left = line[max(0, start - _BACK) : start]
            m = _TOKEN.search(left)
            if following.isdigit() and before.isdigit() and any(map(_wide, left)):
                return NO_END  # scripts without spaces end no sentence with this mark; it parts a number
            token = (m[0] if m else "").casefold().replace(" ", "")
            tail = _TAIL.search(left)
            last = (tail[0] if tail else "").casefold()
            if last in NEVER or token in NEVER or any(token.endswith("." + x) for x in ("b", "h", "g", "e")):
                return NO_END
            if token in EITHER or last in EITHER or re.search(r"(?:^|\d\s?)[ap]\.\s?m$", left.casefold()[-6:]) or re.search(r"\b[ap]\.\s?m$", left.casefold()[-5:]):
                return -0.5
            if last in BEFORE_NUMBER and following.isdigit():
                return NO_END
            if len(last) == 1 and last.isalpha() and not wide:
                return NO_END  # an initial
            if last.isdigit():
                nxt = opening_word(line, end)
                if nxt in MONTHS_DE or (following.islower() and not odd_case):
                    return NO_END
                return 3.0
            return 4.0 if not (wide and after.isdigit()) else NO_END
        if set(marks) <= {"…", ".", "．"}:
            return 3.5 if wide or odd_case or not following.islower() else -1.0
        if wide and following and not following.isspace():
            return 12.0
        return 7.0

    def line(self, line: str) -> list[int]:
        """Ends of the sentences of one line (plain, without ignorable characters)."""
        n = len(line)
        marks = list(_MARKS.finditer(line))
        thai = "".join(_THAI.findall(line))
        if thai:
            thai = sum(map(str.isalpha, thai)) * 2 > sum(map(str.isalpha, line))
        if not marks and not thai:
            return [n]
        nodes: dict[int, tuple[float, float]] = {}  # place: (closing of the span before, opening of the one behind)
        if thai:
            for m in re.finditer(r"\s+", line):
                a, b = line[m.start() - 1 : m.start()], line[m.end() : m.end() + 1]
                if a and b and not a.isdigit() and not b.isdigit() and (b.isalnum() or b in _PAIRS or b in _EVEN):
                    nodes[m.start()] = (6.0, 0.0)
        upper = sum(map(str.isupper, line))
        cased = upper + sum(map(str.islower, line))
        odd_case = False  # cased alike or at random: case says nothing
        if cased:
            odd_case = upper * 2 > cased or upper == 0
            if not odd_case:
                starts = [w[0] for w in _START.findall(line)]
                odd_case = len(starts) > 3 and sum(map(str.isupper, starts)) > 0.85 * len(starts)
        for m in marks:
            end = m.end()
            mark = m[0].strip()
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            while True:  # behind the marks and behind each closing quote or bracket
                if 0 < end < n:
                    found = (self._closing(line, start, mark, end, odd_case), self._opening(line, end, odd_case))
                    if end not in nodes or sum(found) > sum(nodes[end]):
                        nodes[end] = found
                if end >= n or line[end] not in _CLOSERS:
                    break
                end += 1
        if all(c + o < NO_END / 2 for c, o in nodes.values()):
            return [n]
        return self._search(line, nodes)

    @staticmethod
    def _pairs(line: str) -> list[tuple[int, int]]:
        """(opening, closing) places of quotes and brackets that belong together, inner ones first."""
        out, stack = [], []
        for i, c in enumerate(line):
            if not (c in _PAIRS or c in _CLOSE or c in _EVEN or c == "„"):
                continue
            if c in _EVEN:
                opens = c not in (x for x, _ in stack) and not (i and line[i - 1].isalnum() and line[i + 1 : i + 2].isspace())
                mates = c if i and not line[i - 1].isspace() else ""
            elif c == "“":
                opens = not stack or stack[-1][0] not in "„“"
                mates = "" if opens else "„“"
            else:
                opens = c in _PAIRS or c == "„"
                mates = "" if opens else _CLOSE[c] + ("„" if c == "”" else "")
            if opens:
                stack.append((c, i))
            elif at := next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in mates), -1) + 1:
                out.append((stack[at - 1][1], i))
                del stack[at - 1 :]
        return out

    def _search(self, line: str, nodes: dict[int, tuple[float, float]]) -> list[int]:
        """The best chain of spans, in one pass.

        Per pair of marks that is open, the ends so far from which a span may go on are kept:
        the best of those that no price of length or words can touch any more, and the few
        recent ones that are not worse than an earlier one.
        """
        places = [0, *sorted(nodes), len(line)]
        events = [(p, 1, j) for j, p in enumerate(places[1:], 1)]
        if _ANY_PAIR.search(line):
            for a, b in self._pairs(line):
                events += [(a, 2, 0), (b + 1, 0, 0)]
            events.sort()
        back = [0] * len(places)
        words = at = 0  # stretches with a letter or digit so far
        # (score, node, place, words at its birth, words at which it stops being of use or -1)
        levels: list[list] = [[None, [(0.0, 0, 0, 0, -1)]]]
        for place, kind, j in events:
            if place > at:
                words += any(map(str.isalnum, line[at:place]))
                at = place
            settled, recent = levels[-1]
            if kind == 2:  # a span from right before the pair may end inside
                levels.append([None, [(x[0] - CROSS, *x[1:4], -1) for x in recent if x[3] == words and (x[4] < 0 or x[4] == words)]])
            elif kind == 0:  # a span from inside may end right behind the pair
                inside = [*recent, settled] if settled else recent
                levels.pop()
                levels[-1][1] += [(x[0] - CROSS, *x[1:4], words) for x in inside if x[4] < 0 or x[4] == words]
            else:
                top, best = -math.inf, -1
                if settled:
                    top, best = settled[0], settled[1]
                keep = []
                for x in recent:
                    if x[4] >= 0 and x[4] != words:
                        continue
                    lacks = SHORT - (place - x[2])
                    score = x[0] - (LACKS * lacks if lacks > 0 else 0.0) - (WORDLESS if x[3] == words else 0.0)
                    if score > top or (score == top and x[1] < best):
                        top, best = score, x[1]
                    if lacks > 0 or x[3] == words or x[4] >= 0:
                        keep.append(x)
                    elif settled is None or x[0] > settled[0]:
                        settled = x
                back[j] = best
                if best >= 0 and j < len(places) - 1:
                    score = top + sum(nodes[place])
                    if score > NO_END / 2 and (settled is None or score > settled[0]) and all(score > x[0] for x in keep if x[4] < 0):
                        keep.append((score, j, place, words, -1))
                levels[-1] = [settled, keep]
        out, k = [], len(places) - 1
        while k > 0:
            out.append(places[k])
            k = back[k]
        return out[::-1] if k == 0 else [len(line)]

    def text(self, text: str | None) -> list[tuple[int, int]]:
        """(start, end) of every sentence in code points of the text."""
        if not has_word(text):
            return []
        out = []
        at = 0
        for part in [*_LINE.finditer(text), None]:
            stop = part.start() if part else len(text)
            if stop > at:
                raw = text[at:stop]
                plain, keep = raw.translate(_PLAIN), None
                gone = {c for c in set(raw) if c > "~" and SHAPES[ord(c)] is None and ignorable(ord(c))}
                if gone:
                    keep = [i for i, c in enumerate(raw) if c not in gone]
                    plain = "".join([plain[i] for i in keep])
                begin = 0
                ends = self.line(plain)
                for k, end in enumerate(ends):
                    stop_at = len(raw) if k == len(ends) - 1 else (keep[end - 1] + 1 if keep else end)
                    a, b = begin, stop_at
                    while a < b and raw[a].isspace():
                        a += 1
                    while b > a and raw[b - 1].isspace():
                        b -= 1
                    if b > a and has_word(raw[a:b]):
                        out.append((at + a, at + b))
                    begin = stop_at
            at = part.end() if part else stop
        return out


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: np.ndarray | None = None) -> DataFrame:
    """(id, start_char, end_char) of each sentence of each text.

    Offsets are code points, end exclusive, without surrounding white space. Null texts and
    texts without letter or digit give no rows; a text without end marks is one sentence per
    line; very long lines are searched whole. Extra columns are ignored, an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    model = opening_counts(docs, text_col) if counts is None else counts
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(shared.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = ([], [], [])
            for i, text in zip(ids, texts):
                for a, b in seg.text(text):
                    rows[0].append(i)
                    rows[1].append(a)
                    rows[2].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=[id_col, "start_char", "end_char"])

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, f"`{id_col}` bigint, start_char bigint, end_char bigint")
