"""One form for texts that look alike but differ in their characters.

1. *Classes*: pairs of strings that look alike (a code point and its full-width, joined or non-breaking
   form, a letter and its double in another script, a letter with a combining mark and the composed
   letter) are united by union-find. What looks like a third thing's double looks like its double.
2. *Representatives*: a class is written as its member that the corpus uses most; frequencies are counted
   over all texts. Members of equal frequency are ordered plain ASCII first, then shorter, then by code point.
3. *Rewriting*: an Aho-Corasick automaton over all members finds the occurrences of members in a text; from left
   to right the longest match at each place is replaced. Invisible characters are rewritten to nothing.

Letter case, accents, digits and words stay different: no pair of the table joins them.

Rules are closed and texts rewritten until nothing changes; rules that never settle are refused.

Defined results: null stays null, an empty text stays empty; the result doesn't change when it is rewritten again.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts (left) that look like a Latin letter (right).
CROSS_SCRIPT = (
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX "
    "οo νv ρp ϲc ϳj ϹC ͿJ υu αa ιi "
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY "
    "аa еe оo рp сc уy хx ѕs іi јj ԁd ԛq ԝw һh ӏl ӀI ѵv "
    "ɑa ɡg ʋv օo սu ցg հh ոn ՕO ՏS ԼL "
    "ЗӠ ёë ЁË їï ЇÏ"
)
# Marks that look like an ASCII mark (right).
MARKS = "‐- ‑- ﹣- ⁃- ˗- ;; ․. ։: ꞉: ∶: ⁄/ ∕/ ∣| ǀ| ∗* ∧^ ∼~ ʼ’ ‹< ›>"
# Characters that show nothing.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯﻿￹￺￻"
# Blanks that look like a space.
BLANKS = "               　"
#: Compatibility forms whose plain form looks the same: width, style, joined letters and Roman numerals; superscripts, fractions and circled forms look different.
_SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>")
_JOINED = ("LIGATURE", "DIGRAPH", "ROMAN NUMERAL", "ROMAN DIGIT")


def default_pairs() -> list[tuple[str, str]]:
    """(string, string that looks like it), from the tables above and from the Unicode data of Python."""
    pairs = [(x[0], x[1:]) for x in (CROSS_SCRIPT + " " + MARKS).split(" ")]
    twin = {ord(a): b for a, b in pairs}
    pairs += [(x, "") for x in INVISIBLE]
    pairs += [(x, " ") for x in BLANKS]
    for point in range(0xA0, sys.maxunicode + 1):
        ch = chr(point)
        form = unicodedata.decomposition(ch)
        if not form:
            continue
        if form.startswith("<"):
            tag, *rest = form.split(" ")
            plain = "".join(chr(int(x, 16)) for x in rest)
            if tag in _SAME_LOOK or tag == "<compat>" and any(x in unicodedata.name(ch, "") for x in _JOINED):
                pairs.append((ch, unicodedata.normalize("NFC", plain)))
        else:
            composed, parts = unicodedata.normalize("NFC", ch), unicodedata.normalize("NFD", ch)
            if composed != ch:
                pairs.append((ch, composed))
            elif composed != parts:
                pairs.append((parts, ch))
                pairs.append((ch, unicodedata.normalize("NFC", parts.translate(twin))))
    return [p for p in pairs if p[0] != p[1]]


class Classes:
    """Union-find over strings."""

    def __init__(self, pairs: Iterable[tuple[str, str]]) -> None:
        self.parent: dict[str, str] = {}
        for a, b in pairs:
            self.unite(a, b)

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def unite(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> list[list[str]]:
        groups: dict[str, list[str]] = {}
        for x in self.parent:
            groups.setdefault(self.find(x), []).append(x)
        return [sorted(g) for g in groups.values()]


def rewrites(classes: Classes, counts: dict[str, int]) -> dict[str, str]:
    """member -> representative, for all members that aren't their class's representative."""
    out: dict[str, str] = {}
    for group in classes.members():
        if "" in group:
            best = ""
        else:
            best = min(group, key=lambda x: (-counts.get(x, 0), not x.isascii(), len(x), x))
        out |= {x: best for x in group if x not in (best, "")}
    return _closed(out)


def _closed(rules: dict[str, str]) -> dict[str, str]:
    """Rules whose results need no further rule (a ligature's letters may have representatives of their own)."""
    for _ in range(len(rules) + 1):  # each round settles one more step of the longest way through the rules
        table = Rewriter(rules)
        new = {a: table.rewrite(b) if b not in rules else rules[b] for a, b in rules.items()}
        if new == rules:
            return rules
        rules = new
    raise ValueError("the rules go in a circle")


class Rewriter:
    """Leftmost-longest replacement of all members by their representatives."""

    def __init__(self, rules: dict[str, str]) -> None:
        self.rules = rules
        #: First characters of the members that an ASCII text may hold.
        self.plain = set(x[0] for x in rules if x.isascii())
        self.single = {ord(a): b for a, b in rules.items() if len(a) == 1}
        self.letters = {a: b for a, b in rules.items() if len(a) == 1}
        self.lettered = frozenset(self.letters)
        #: A character of each longer member, one beyond ASCII if it has any: without it the member isn't there.
        self.signs = set(min(a, key=str.isascii) for a in rules if len(a) > 1)
        self.automaton = ahocorasick.Automaton()
        for a in rules:
            self.automaton.add_word(a, a)
        if rules:
            self.automaton.make_automaton()
        #: Characters at which a text and its form may get out of step.
        self.moved = frozenset({*self.letters, *_marks()})

    def _untouched(self, text: str) -> bool:
        return not self.rules or text.isascii() and (not self.plain or self.plain.isdisjoint(text))

    def once(self, text: str) -> str:
        if self._untouched(text):
            return text
        characters = set(text)
        if self.signs.isdisjoint(characters):
            for c in characters & self.lettered:
                text = text.replace(c, self.letters[c])
            return text
        starts: dict[int, str] = {}
        for end, member in self.automaton.iter(text):
            start = end - len(member) + 1
            if len(member) > len(starts.get(start, "")):
                starts[start] = member
        out, at = [], 0
        for start in sorted(starts):
            if start >= at:
                out += [text[at:start], self.rules[starts[start]]]
                at = start + len(starts[start])
        return "".join(out) + text[at:]

    def aligned(self, text: str) -> tuple[str, list[int]]:
        """The rewritten text and, for each of its characters, the position in ``text`` that it comes from.

        Letters and their combining marks are joined where Unicode has the joined letter.
        """
        if self._untouched(text):
            return text, list(range(len(text)))
        moved = self.moved.intersection(text)
        if not moved:
            return text, list(range(len(text)))
        out: list[str] = []
        source: list[int] = []
        at = 0
        for m in re.finditer(f"[{''.join(map(re.escape, sorted(moved)))}]", text):
            i, ch = m.start(), m.group()
            out += text[at:i]
            source += range(at, i)
            at = i + 1
            for c in self.letters.get(ch, ch):
                if unicodedata.combining(c) and out and len(joined := unicodedata.normalize("NFC", out[-1] + c)) == 1:
                    out[-1] = joined
                else:
                    out.append(c)
                    source.append(i)
        out += text[at:]
        source += range(at, len(text))
        return "".join(out), source

    def rewrite(self, text: str) -> str:
        """Rewrite until nothing changes: a removed mark may bring a letter and its accent together."""
        for _ in range(len(text) + len(self.rules) + 1):  # closed rules settle a place in one step, which can wake its neighbours once
            new = self.once(text)
            if new == text:
                return text
            text = new
        raise ValueError("the rules go in a circle")


@lru_cache(maxsize=1)
def _marks() -> frozenset[str]:
    """All combining marks."""
    return frozenset(c for c in map(chr, range(0x300, 0x1E950)) if unicodedata.combining(c))


@lru_cache(maxsize=4)
def default_rewriter(counts: tuple[tuple[str, int], ...] = ()) -> Rewriter:
    """The rewriter of the default pairs with these corpus frequencies, built once in a process."""
    return Rewriter(rewrites(Classes(default_pairs()), dict(counts)))


@lru_cache(maxsize=1)
def _countable() -> tuple[frozenset[str], ahocorasick.Automaton]:
    members = {x for pair in default_pairs() for x in pair if x}
    automaton = ahocorasick.Automaton()
    for x in members:
        if len(x) > 1:
            automaton.add_word(x, x)
    automaton.make_automaton()
    return frozenset(x for x in members if len(x) == 1), automaton


def frequencies(texts: DataFrame, column: str) -> tuple[tuple[str, int], ...]:
    """How often each member of a class stands in the texts, counted over all rows.

    Each partition counts for itself; the result has at most one row per known member (about 3,000).
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        single, automaton = _countable()
        letters, longer = np.zeros(0x110000, np.int64), Counter()
        for batch in batches:
            text = "\0".join(t for t in batch[column] if isinstance(t, str))
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            found = np.bincount(points)
            letters[: len(found)] += found
            longer.update(x for _, x in automaton.iter(text))
        kept = [(x, int(letters[ord(x)])) for x in single if letters[ord(x)]] + list(longer.items())
        yield pd.DataFrame(kept, columns=["member", "n"])

    rows = texts.select(column).mapInPandas(count, "member string, n long")
    return tuple(sorted((m, n) for m, n in rows.groupBy("member").agg(F.sum("n")).collect()))


def canonical(column: Column | str, counts: tuple[tuple[str, int], ...] = ()) -> Column:
    """The text in its one consistent form; ``counts`` come from ``frequencies``."""

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        rewriter = default_rewriter(counts)
        return texts.map(lambda t: rewriter.rewrite(t) if isinstance(t, str) else None)

    return rewrite(column)
