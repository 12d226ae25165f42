"""Command patterns as tries of command elements, walked by the elements of a command.

A pattern is a row of slots, each with its choices; a choice gives some command elements, or none. The first words of a
pattern name the command and its subcommand, which all later options carry, so a pattern is parted by the choices of
these words only. No other choices are ever multiplied: a slot with many is one step with many arcs. Patterns of a command
share the nodes of equal first slots. A walk keeps, at each node, the numbers of elements that the slots so far can have
taken; where all elements can be taken the node's first pattern matches.
"""

from __future__ import annotations

import re
from itertools import product

_HOLE = re.compile(r"\{\{(.*?)\}\}", re.S)


def choices(hole: str, split) -> list[str]:
    """The choices of a place `a|b` or `[a|b]`."""
    hole = hole.strip()
    return split(hole[1:-1] if hole.startswith("[") and hole.endswith("]") else hole, ("|",))


def _balanced(text: str) -> bool:
    quote = ""
    for ch in text:
        quote = "" if ch == quote else ch if not quote and ch in "\"'" else quote
    return not quote


def slots(pattern: str, split) -> list[list[str]]:
    """The texts of each slot: what stands between white space outside places and quotes, with the choices of its places."""
    pieces, at = [], 0
    for m in _HOLE.finditer(pattern):
        pieces += [[pattern[at : m.start()]], choices(m[1], split)]
        at = m.end()
    pieces.append([pattern[at:]])
    if not all(_balanced(c) for p in pieces[1::2] for c in p):
        return [["".join(t) for t in product(*pieces)]]
    out: list[list[list[str]]] = [[]]
    quote = ""
    for k, piece in enumerate(pieces):
        if k % 2:
            out[-1].append(piece)
            continue
        text = ""
        for ch in piece[0]:
            quote = "" if ch == quote else ch if not quote and ch in "\"'" else quote
            if ch.isspace() and not quote:
                out[-1].append([text])
                out.append([])
                text = ""
            else:
                text += ch
        out[-1].append([text])
    if quote:
        return [["".join(t) for t in product(*pieces)]]
    return [list(dict.fromkeys("".join(t) for t in product(*slot))) for slot in out if any(slot_text != [""] for slot_text in slot)]


class Trie:
    """The patterns of one command. words splits a text, element makes the command element of a word (its place, the word, the
    words before it decide) or gives None for a word that is none."""

    def __init__(self) -> None:
        self.nodes: list[dict[tuple, int]] = [{}]
        self.first: dict[int, tuple] = {}

    def add(self, order: tuple, row: list[tuple[tuple[str, ...], ...]]) -> None:
        """A pattern as a row of slots, each the element lists of its choices. The least order of equal patterns counts."""
        at = 0
        for slot in row:
            slot = tuple(sorted(set(slot)))
            if slot == ((),):
                continue
            if slot not in self.nodes[at]:
                self.nodes.append({})
                self.nodes[at][slot] = len(self.nodes) - 1
            at = self.nodes[at][slot]
        if at not in self.first or order < self.first[at]:
            self.first[at] = order

    def find(self, key: tuple[str, ...]) -> tuple | None:
        """The least order of the patterns that the elements match."""
        best, todo = None, [(0, frozenset([0]))]
        while todo:
            at, taken = todo.pop()
            if len(key) in taken and at in self.first and (best is None or self.first[at] < best):
                best = self.first[at]
            for slot, to in self.nodes[at].items():
                then = frozenset(n + len(c) for n in taken for c in slot if key[n : n + len(c)] == c)
                if then:
                    todo.append((to, then))
        return best


def rows_of(pattern: str, split, words, element) -> list[list[tuple[tuple[str, ...], ...]]]:
    """The pattern's rows of slots in command elements, one for each choice of its first two words."""
    parts = [[words(t) for t in slot] for slot in slots(pattern, split)]
    out = []

    def leading(head: list[str], k: int) -> None:
        if len(head) < 2 and k < len(parts):
            for more in {tuple(w): w for w in parts[k]}.values():
                leading([*head, *more], k + 1)
            return
        if not head:
            return
        fixed = tuple(e for i, w in enumerate(head) if (e := element(head, i, w)) is not None)
        rest = [tuple(tuple(e for w in choice if (e := element(head, 2, w)) is not None) for choice in slot) for slot in parts[k:]]
        out.append([(fixed,), *rest])

    leading([], 0)
    return out
