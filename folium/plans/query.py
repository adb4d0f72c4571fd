"""Search requests and the query language of field values.

Grammar of a value::

    query  := clause*                 clauses without an operator between them are alternatives
    clause := [+|-|NOT] (term | "phrase" | (query))  joined by AND / OR
    term   := word with * and ? as wildcards; a backslash takes the next character literally

``AND`` makes both its neighbours required, ``OR`` leaves them as they are, ``NOT`` and ``-`` exclude.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class QueryError(ValueError):
    """A request that can't be run: no text, no corpus, or text that doesn't parse."""


@dataclass
class Query:
    """What to search for.

    With ``compat`` a value of several bare words binds only the first to its field, as the classic text form does;
    the others are alternatives in the default field.
    """

    kind: str = "document"  # or "sentence"
    keyword: str = ""
    exclude_keyword: str = ""
    year: str = ""
    author: str = ""
    accession: str = ""
    journal: str = ""
    paper_type: str = ""
    exact_author: bool = False
    exact_journal: bool = False
    case_sensitive: bool = False
    sort_by_year: bool = False
    categories: list[str] = field(default_factory=list)
    categories_and: bool = True
    corpora: list[str] = field(default_factory=list)
    coord: bool = False
    compat: bool = False

    def check(self) -> None:
        if not self.corpora:
            raise QueryError("no corpus was named")
        if not any((self.keyword, self.exclude_keyword, self.year, self.author, self.accession, self.journal, self.paper_type, self.categories)):
            raise QueryError("the query is empty")


@dataclass(frozen=True)
class Leaf:
    """A word, a wildcard pattern or a phrase; ``places`` are the words' distances from the first."""

    words: tuple[str, ...]
    wildcard: bool = False
    places: tuple[int, ...] = ()

    def steps(self) -> tuple[int, ...]:
        return self.places or tuple(range(len(self.words)))

    def prefix(self) -> str:
        """What every match of a wildcard pattern begins with."""
        return re.split(r"[*?]", self.words[0])[0]

    def pattern(self) -> str:
        return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in self.words[0]) + "$"


@dataclass(frozen=True)
class Group:
    required: tuple = ()
    optional: tuple = ()
    excluded: tuple = ()

    def leaves(self, positive: bool = True) -> list[Leaf]:
        """Leaves that add to the score, or with ``positive`` off all of them."""
        out: list[Leaf] = []
        for part in (*self.required, *self.optional, *(() if positive else self.excluded)):
            out += part.leaves(positive) if isinstance(part, Group) else [part]
        return list(dict.fromkeys(out))


_LEX = re.compile(r'\s+|"((?:[^"\\]|\\.)*)"|([()])|(&&|\|\|)|([+\-!])(?=\S)|((?:[^\s"()\\]|\\.)+)')
_BREAK = re.compile(r"[ \n\t'\\/()\[\]{}:.;,!?]+")


def _words(text: str, lower: bool, keep: str = "") -> list[str]:
    out, part, skip = [], "", False
    for c in text:
        if skip:
            part, skip = part + (" " if _BREAK.match(c) else c), False
        elif c == "\\":
            skip = True
        elif c not in keep and _BREAK.match(c):
            part += " "
        else:
            part += c
    return [w.lower() if lower else w for w in part.split(" ") if w]


def parse(text: str, case_sensitive: bool = False) -> Group:
    """A field value as a tree of groups and leaves."""
    items, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise QueryError(f"can't read the query at {text[at : at + 20]!r}")
        at = m.end()
        phrase, paren, both, sign, word = m.groups()
        if phrase is not None:
            items.append(("phrase", phrase))
        elif paren or both or sign:
            items.append((paren or {"&&": "AND", "||": "OR"}.get(both) or {"!": "-"}.get(sign, sign), ""))
        elif word in ("AND", "OR", "NOT"):
            items.append(("-" if word == "NOT" else word, ""))
        elif word:
            items.append(("word", word))
    place = 0

    def group(inner: bool) -> Group:
        nonlocal place
        found: list[list] = []  # [state, node]
        sign, joined = "", ""
        while place < len(items):
            kind, value = items[place]
            place += 1
            if kind == ")":
                if not inner:
                    raise QueryError("a bracket closes that none opened")
                inner = False
                break
            if kind in ("AND", "OR"):
                if not found:
                    raise QueryError(f"{kind} has nothing before it")
                joined = kind
                continue
            if kind in ("+", "-"):
                sign = kind
                continue
            node = group(True) if kind == "(" else None
            if kind == "phrase":
                if own := _words(value, not case_sensitive):
                    node = Leaf(tuple(own))
            elif kind == "word":
                own = _words(value, not case_sensitive, keep="?")
                wild = [w for w in own if "*" in w or "?" in w.rstrip("?") or len(w.rstrip("?")) < len(w) and len(own) == 1]
                if wild and len(own) == 1:
                    node = Leaf((own[0],), True)
                elif own := [w for w in (x.strip("?") for x in own) if w]:
                    node = Leaf(tuple(own))
            if node is not None:
                if joined == "AND" and found and found[-1][0] == "":
                    found[-1][0] = "+"
                found.append([sign or ("+" if joined == "AND" else ""), node])
            sign = joined = ""
        if inner:
            raise QueryError("a bracket isn't closed")
        pick = lambda s: tuple(n for state, n in found if state == s)
        return Group(pick("+"), pick(""), pick("-"))

    tree = group(False)
    if not tree.leaves(False):
        raise QueryError("the query has no words")
    return tree


_TOKEN = re.compile(r"[^\W_]+(?:['.][^\W_]+)*")


def analyzed_leaf(leaf: Leaf, stop_words: list[str]) -> Leaf | None:
    """A leaf as the analyzer leaves its words: parted, without stop words; None if nothing is left. Patterns stay."""
    if leaf.wildcard:
        return leaf
    stop = set(stop_words)
    kept = [(i, w) for i, w in enumerate(_TOKEN.findall(" ".join(leaf.words))) if w not in stop and len(w) <= 255]
    if not kept:
        return None
    first = kept[0][0]
    return Leaf(tuple(w for _, w in kept), False, tuple(i - first for i, _ in kept))


def analyzed_tree(tree: Group, stop_words: list[str]) -> Group:
    """A tree for analyzed text; clauses of stop words alone vanish, as they do from the text."""

    def part(nodes: tuple) -> tuple:
        out = [analyzed_tree(n, stop_words) if isinstance(n, Group) else analyzed_leaf(n, stop_words) for n in nodes]
        return tuple(n for n in out if n is not None and (not isinstance(n, Group) or n.leaves(False)))

    return Group(part(tree.required), part(tree.optional), part(tree.excluded))
