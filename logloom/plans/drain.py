"""Log template mining with a fixed-depth tree (after He et al., ICWS 2017), for bounded samples on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

WILDCARD = "<*>"


@dataclass
class Cluster:
    number: int
    tokens: list[str]
    size: int = 1

    @property
    def template(self) -> str:
        return " ".join(self.tokens)


@dataclass
class Drain:
    """similarity: least share of equal tokens; depth: levels of the tree, length and leaves included; most: clusters kept, the least recent goes."""

    similarity: float = 0.6
    depth: int = 4
    children: int = 100
    most: int = 1000
    delimiters: tuple[str, ...] = ()
    clusters: dict[int, Cluster] = field(default_factory=dict)
    tree: dict = field(default_factory=dict)
    made: int = 0

    def tokens(self, line: str) -> list[str]:
        for d in self.delimiters:
            line = line.replace(d, " ")
        return line.split()

    def _leaf(self, tokens: list[str], grow: bool) -> list[int] | None:
        node = self.tree.setdefault(len(tokens), {}) if grow else self.tree.get(len(tokens))
        for token in tokens[: self.depth - 3]:
            if node is None:
                return None
            key = WILDCARD if re.search(r"\d", token) else token
            if key not in node:
                if not grow:
                    key = WILDCARD
                elif len(node) >= self.children:
                    key = WILDCARD
            node = node.setdefault(key, {}) if grow else node.get(key)
        if node is None:
            return None
        return node.setdefault("", []) if grow else node.get("")

    def add(self, line: str) -> Cluster:
        """The cluster that the line joins or founds; its template keeps what its lines share."""
        tokens = self.tokens(line)
        best, most = None, -1.0
        for n in self._leaf(tokens, False) or ():
            if (c := self.clusters.get(n)) is None:
                continue
            equal = sum(a == b for a, b in zip(c.tokens, tokens, strict=True) if a != WILDCARD) / max(1, len(tokens))
            wild = sum(a == WILDCARD for a in c.tokens)
            if (equal, wild) > (most, best and sum(a == WILDCARD for a in best.tokens) or 0):
                best, most = c, equal
        if best is not None and most >= self.similarity or (best is not None and not tokens):
            best.tokens = [a if a == b else WILDCARD for a, b in zip(best.tokens, tokens, strict=True)]
            best.size += 1
            self.clusters[best.number] = self.clusters.pop(best.number)
            return best
        self.made += 1
        c = self.clusters[self.made] = Cluster(self.made, tokens)
        self._leaf(tokens, True).append(c.number)
        if len(self.clusters) > self.most:
            del self.clusters[next(iter(self.clusters))]
        return c
