"""Licence scan by template markup.

A template's wording is compiled into an automaton over words: mandatory words are steps on one word,
optional regions can be passed by, and a replaceable region takes words that, joined by spaces, match its pattern. Only
the pattern itself bounds their number; one that ends in ``.+`` runs to the next place from where the rest matches. A text
matches where an automaton can go from its start to its end, so every mandatory word must be there, in order, exactly.
Base phrases are templates without regions.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased, in templates as in texts.
An automaton is run from every place where one of its first words stands, in texts that have all its mandatory
words; but for such open regions it takes the longest way from a place. Every base place counts, overlapping ones too. The score is the share
of the text's words inside a match. Null and empty texts have no words, no labels and score 0. Null ids and repeated
rows are scanned like others. An empty table gives no rows.
"""

import re
import re._parser as syntax
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udf

from corpusloom.llm.base import id_and_text, plain_words, texts
from corpusloom.llm.license_templates import BASE, TEMPLATES

_MARK = re.compile(r"<<(beginOptional)[^>]*>>|<<(endOptional)>>|<<var;(.*?)>>", re.S)


def _most_spaces(items) -> float:
    """Spaces that a parsed pattern can match at most."""
    total = 0.0
    for op, value in items:
        if op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT):
            inner = _most_spaces(value[2])
            total += inner and inner * (float("inf") if value[1] == syntax.MAXREPEAT else int(value[1]))
        elif op is syntax.SUBPATTERN:
            total += _most_spaces(value[3])
        elif op is syntax.BRANCH:
            total += max(map(_most_spaces, value[1]))
        elif op is syntax.LITERAL:
            total += value == 32
        elif op is syntax.IN and all(kind in (syntax.LITERAL, syntax.RANGE, syntax.NEGATE) for kind, _ in value):
            inside = any(kind is syntax.LITERAL and v == 32 or kind is syntax.RANGE and v[0] <= 32 <= v[1] for kind, v in value)
            total += inside != (value[0][0] is syntax.NEGATE)
        elif op is syntax.NOT_LITERAL:
            total += value != 32
        elif op in (syntax.ANY, syntax.IN):
            total += 1
        elif op is not syntax.AT:
            return float("inf")
    return total


@dataclass(frozen=True)
class Words:
    """Words that match a pattern, ``most`` of them if that is bounded."""

    pattern: re.Pattern
    most: float

    @classmethod
    def of(cls, pattern: str) -> "Words":
        return cls(re.compile(pattern), 1 + _most_spaces(syntax.parse(pattern)))

    def ends(self, words: list[bytes], at: int):
        for n in range(at, int(min(at + self.most, len(words))) + 1):
            if self.pattern.fullmatch(b" ".join(words[at:n]).decode()):
                yield n


@dataclass
class Automaton:
    """``edges[state]`` has (word, region, target): a word; ``Words``, or the least number of any words; or neither (a free step)."""

    label: str
    base: bool
    edges: list[list[tuple]] = field(default_factory=lambda: [[]])
    needed: set[bytes] = field(default_factory=set)

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def firsts(self, state: int = 0) -> set[bytes] | None:
        """Words it can go on with from a state; None if it can with any."""
        out, todo, seen = set(), [state], set()
        while todo:
            s = todo.pop()
            if s in seen:
                continue
            seen.add(s)
            for word, pattern, target in self.edges[s]:
                if pattern is not None:
                    return None
                if word is None:
                    todo.append(target)
                else:
                    out.add(word)
        return out

    def end(self, words: list[bytes], start: int) -> int | None:
        """End of the match from ``start``."""
        return self.ends(words)(start)

    def ends(self, words: list[bytes]) -> Callable[[int], int | None]:
        """Function from a place to the end of the match there. What follows a place is found once for all starts."""
        last, known, places, follows = len(self.edges) - 1, {}, defaultdict(list), {}
        for i, word in enumerate(words):
            places[word].append(i)

        def following(s: int) -> list[int]:
            """All places from where state ``s`` gets to the end."""
            if s not in follows:
                begin = None if s == last or self._is_free(s) else self.firsts(s)
                where = range(len(words) + 1) if begin is None else sorted(i for w in begin for i in places.get(w, ()))
                follows[s] = [i for i in where if best(s, i) >= 0]
            return follows[s]

        def best(s: int, at: int) -> int:
            while s != last and len(self.edges[s]) == 1 and self.edges[s][0][0] is not None:
                if at >= len(words) or words[at] != self.edges[s][0][0]:
                    return -1
                s, at = self.edges[s][0][2], at + 1
            if (s, at) not in known:
                out = at if s == last else -1
                for word, region, target in self.edges[s]:
                    if word is not None:
                        if at < len(words) and words[at] == word:
                            out = max(out, best(target, at + 1))
                    elif region is None:
                        out = max(out, best(target, at))
                    elif isinstance(region, Words):
                        out = max([out, *(best(target, n) for n in region.ends(words, at))])
                    else:
                        ends = following(target)
                        k = bisect_left(ends, at + region)
                        if k < len(ends):
                            out = max(out, best(target, ends[k]))
                known[s, at] = out
            return known[s, at]
        return lambda start: end if (end := best(0, start)) >= 0 else None

    def _is_free(self, state: int) -> bool:
        """Free steps lead from ``state`` to the end."""
        return state == len(self.edges) - 1 or any(self._is_free(t) for w, r, t in self.edges[state] if w is None and r is None)


def compile_template(label: str, markup: str, base: bool = False) -> Automaton:
    """Automaton of one template. A missing end of an optional region is the end of the template."""
    out = Automaton(label, base)
    now, open_at = 0, []

    def plain(text: str) -> None:
        nonlocal now
        for word in plain_words(text.encode()):
            new = out.state()
            out.edges[now].append((word, None, new))
            now = new
            if not open_at:
                out.needed.add(word)

    def close() -> None:
        nonlocal now
        new = out.state()
        out.edges[now].append((None, None, new))
        out.edges[open_at.pop()].append((None, None, new))
        now = new

    at = 0
    for mark in _MARK.finditer(markup):
        plain(markup[at:mark.start()])
        at = mark.end()
        if mark[1]:
            open_at.append(now)
        elif mark[2]:
            close()
        else:
            found = re.search(r'match="(.*?)"', mark[3], re.S)
            pattern = found[1] if found else ".*"
            if pattern in (".+", ".*"):
                regions = [int(pattern == ".+")]
            elif re.search(r"[^\\] \.\+$", pattern) and syntax.parse(pattern)[0][0] is not syntax.BRANCH:
                regions = [Words.of(pattern[:-3]), 1]
            else:
                regions = [Words.of(pattern)]
            for region in regions:
                new = out.state()
                out.edges[now].append((None, region, new))
                now = new
    plain(markup[at:])
    while open_at:
        close()
    return out


class Scanner:
    def __init__(self, base=BASE, templates=TEMPLATES):
        compiled = [*[compile_template(*t, True) for t in base], *[compile_template(*t) for t in templates]]
        self.automata = [(a, a.firsts(), frozenset(a.needed)) for a in compiled]

    def matches(self, words: list[bytes]) -> list[tuple[str, bool, int, int]]:
        """(label, base phrase, first word, end) of every match."""
        present, out = set(words), []
        for a, firsts, needed in self.automata:
            if words and needed <= present:
                ends = a.ends(words)
                for i, word in enumerate(words):
                    if firsts is None or word in firsts:
                        end = ends(i)
                        if end is not None and end > i:
                            out.append((a.label, a.base, i, end))
        return out


def covered(spans: list[tuple[int, int]]) -> int:
    total, reached = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reached))
        reached = max(reached, b)
    return total


def _scanner(base: list, templates: list, with_spans: bool):
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
              ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
    kind = pa.struct(fields + [("spans", span)] * with_spans)
    ddl = ("struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double"
           + ",spans:array<struct<label:string,first:bigint,end:bigint>>" * with_spans + ">")
    scanner = Scanner(base, templates)

    def scan(text: pa.Array) -> pa.Array:
        rows = []
        for raw in texts(text):
            words = plain_words(raw)
            found = scanner.matches(words)
            places = [first for _, is_base, first, _ in found if is_base]
            rows.append({
                "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
                "base_labels": ",".join(sorted({label for label, is_base, _, _ in found if is_base})),
                "labels": ",".join(sorted({label for label, *_ in found})),
                "score": covered([(a, b) for _, _, a, b in found]) / len(words) if words else 0.0,
                "spans": [{"label": label, "first": a, "end": b} for label, _, a, b in found]})
        return pa.array(rows, kind)
    return arrow_udf(scan, ddl)


def scan(docs: DataFrame, base: list = BASE, templates: list = TEMPLATES, with_spans: bool = False) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score, and on request every match."""
    return (id_and_text(docs).select("doc_id", _scanner(base, templates, with_spans)("text").alias("__found"))
            .select("doc_id", "__found.*"))
