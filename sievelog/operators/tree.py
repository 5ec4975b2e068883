"""The template tree: fixed depth, one root per message length, leaves with clusters.

A plain Python object.  Messages of different lengths never meet in it, which
is what lets Spark build it length by length.  A leaf keeps its clusters column
by column as numbers of tokens, so a message is scored against all of them by one
comparison per place; places whose token no cluster of the leaf has had are
skipped, and too few of the others mean that nothing matches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from ..config import WILDCARD, MiningConfig


def has_digit(token: str) -> bool:
    return any("0" <= c <= "9" for c in token)


def key_of(token: str) -> str:
    return WILDCARD if has_digit(token) else token


class Node:
    """Inner node (children) or leaf (clusters, oldest first)."""

    def __init__(self) -> None:
        self.children: dict[str, Node] = {}
        self.clusters: list[int] = []
        self.columns: list[np.ndarray] = []  # numbers of the tokens at each place, 0 for a wildcard
        self.wild = np.zeros(4, dtype=np.int32)
        self.present: list[set[int]] = []  # numbers that a place has ever had
        self.version = 0

    def add(self, c: int, codes: Sequence[int]) -> None:
        k = len(self.clusters)
        if not k:
            self.columns = [np.zeros(4, dtype=np.int32) for _ in codes]
            self.present = [set() for _ in codes]
        if k == len(self.wild):
            self.wild = np.resize(self.wild, 2 * k)
            self.columns = [np.resize(column, 2 * k) for column in self.columns]
        self.wild[k] = 0
        for column, seen, code in zip(self.columns, self.present, codes, strict=True):
            column[k] = code
            if code:
                seen.add(code)
            else:
                self.wild[k] += 1
        self.clusters.append(c)
        self.version += 1

    def blank(self, row: int, place: int) -> None:
        """A place of a cluster becomes a wildcard."""
        self.columns[place][row] = 0
        self.wild[row] += 1
        self.version += 1

    def best(self, codes: Sequence[int], need: int) -> int | None:
        """Row with the most equal tokens, then the most wildcards, then the earliest; None below ``need`` equal ones."""
        k = len(self.clusters)
        if not codes or not k:
            return 0 if k else None
        places = [i for i, code in enumerate(codes) if code in self.present[i]]
        if len(places) < need:
            return None
        equal = np.zeros(k, dtype=np.int32)
        for i in places:
            equal += self.columns[i][:k] == codes[i]
        row = int((equal * (len(codes) + 1) + self.wild[:k]).argmax())
        return row if equal[row] >= need else None

    def covering(self, codes: Sequence[int]) -> int | None:
        """Row whose constants are all equal: fewest wildcards, then the earliest."""
        k = len(self.clusters)
        fits = np.ones(k, dtype=bool)
        for column, code in zip(self.columns, codes, strict=True):
            fits &= (column[:k] == code) | (column[:k] == 0)
        rows = np.flatnonzero(fits)
        return int(rows[self.wild[rows].argmin()]) if len(rows) else None


class Tree:
    """Clusters are numbered in the order of their creation."""

    def __init__(self, config: MiningConfig):
        self.config, self.threshold = config, config.threshold
        self.roots: dict[int, Node] = {}
        self.clusters: list[list[str]] = []
        self.leaf_of: list[Node] = []
        self.row_of: list[int] = []
        self.births: list[int] = []
        self.numbers: dict[str, int] = {}
        self.lengths: dict[int, tuple[Node, dict[int, int]]] = {}  # all clusters of a length, made when first asked for
        self.shape = 0  # nodes made so far: paths may have changed when it has

    # search

    def codes(self, tokens: Sequence[str]) -> list[int]:
        """Numbers of a message's tokens; -1 equals nothing."""
        get = self.numbers.get
        return [-1 if t == WILDCARD else get(t, -1) for t in tokens]

    def _own(self, tokens: Sequence[str]) -> list[int]:
        """Numbers of a template's tokens."""
        numbers = self.numbers
        return [0 if t == WILDCARD else numbers.setdefault(t, len(numbers) + 1) for t in tokens]

    def leaf(self, tokens: Sequence[str]) -> Node | None:
        node = self.roots.get(len(tokens))
        for token in tokens[: self.config.layers(len(tokens))]:
            if node is None:
                return None
            node = node.children.get(key_of(token)) or node.children.get(WILDCARD)
        return node

    def _need(self, n: int) -> int:
        return -(-self.threshold * n // 1_000_000)

    def find(self, tokens: Sequence[str]) -> int | None:
        """The cluster that training would choose."""
        leaf = self.leaf(tokens)
        row = None if leaf is None else leaf.best(self.codes(tokens), self._need(len(tokens)))
        return None if row is None else leaf.clusters[row]

    def _of_length(self, n: int) -> Node:
        if n not in self.lengths:
            node, rows = Node(), {}
            for c, tokens in enumerate(self.clusters):
                if len(tokens) == n:
                    rows[c] = len(node.clusters)
                    node.add(c, self._own(tokens))
            self.lengths[n] = node, rows
        return self.lengths[n][0]

    def assign(self, tokens: Sequence[str]) -> int | None:
        """``find``, and failing that the best cluster of the same length."""
        found = self.find(tokens)
        if found is None:
            node = self._of_length(len(tokens))
            row = node.best(self.codes(tokens), self._need(len(tokens)))
            found = None if row is None else node.clusters[row]
        return found

    def fits(self, tokens: Sequence[str]) -> int | None:
        """Exact rule: every constant is equal; fewest wildcards, then the earliest."""
        node = self._of_length(len(tokens))
        row = node.covering(self.codes(tokens)) if node.clusters else None
        return None if row is None else node.clusters[row]

    # change

    def _note(self, node: Node, c: int) -> None:
        """Put a cluster into its leaf."""
        codes = self._own(self.clusters[c])
        self.leaf_of[c], self.row_of[c] = node, len(node.clusters)
        node.add(c, codes)
        if len(codes) in self.lengths:
            every, rows = self.lengths[len(codes)]
            rows[c] = len(every.clusters)
            every.add(c, codes)

    def generalise(self, c: int, tokens: Sequence[str]) -> None:
        """Places of a cluster that differ from a message become wildcards."""
        template = self.clusters[c]
        if template == tokens:
            return
        for i, (a, b) in enumerate(zip(template, tokens, strict=True)):
            if a != b and a != WILDCARD:
                template[i] = WILDCARD
                self.leaf_of[c].blank(self.row_of[c], i)
                if len(template) in self.lengths:
                    every, rows = self.lengths[len(template)]
                    every.blank(rows[c], i)

    def _path(self, tokens: Sequence[str]) -> Node:
        node = self.roots.get(len(tokens))
        if node is None:
            node = self.roots[len(tokens)] = Node()
            self.shape += 1
        for token in tokens[: self.config.layers(len(tokens))]:
            key, kids = key_of(token), node.children
            if key not in kids and key != WILDCARD:
                room = len(kids) + (WILDCARD not in kids) < self.config.max_children
                key = key if room else WILDCARD
            if key not in kids:
                kids[key] = Node()
                self.shape += 1
            node = kids[key]
        return node

    def create(self, tokens: Sequence[str], birth: int) -> int:
        c = len(self.clusters)
        self.clusters.append(list(tokens))
        self.births.append(birth)
        self.leaf_of.append(None)  # type: ignore[arg-type]
        self.row_of.append(0)
        self._note(self._path(tokens), c)
        return c

    def learn(self, tokens: Sequence[str], birth: int, may_create: bool = True) -> int | None:
        """Add a message; its cluster, or None if it needs a new one that may not be made."""
        c = self.find(tokens)
        if c is not None:
            self.generalise(c, tokens)
            return c
        return self.create(tokens, birth) if may_create else None

    def drop(self, gone: set[int]) -> dict[int, int]:
        """Remove clusters; the others keep their order.  Gives old -> new numbers."""
        kept = [c for c in range(len(self.clusters)) if c not in gone]
        number = {old: new for new, old in enumerate(kept)}
        for leaf in {id(n): n for n in self.leaf_of}.values():
            if gone.isdisjoint(leaf.clusters):
                leaf.clusters = [number[c] for c in leaf.clusters]
                leaf.version += 1
                continue
            rows = [row for row, c in enumerate(leaf.clusters) if c in number]
            leaf.clusters = [number[leaf.clusters[row]] for row in rows]
            if not rows:  # the next cluster makes columns of its own
                leaf.wild = np.zeros(4, dtype=np.int32)
                leaf.version += 1
                continue
            room = max(4, len(rows))
            leaf.columns, leaf.wild = [np.resize(x[rows], room) for x in leaf.columns], np.resize(leaf.wild[rows], room)
            leaf.version += 1
            for row, c in enumerate(leaf.clusters):
                self.row_of[kept[c]] = row
        for name in ("clusters", "births", "leaf_of", "row_of"):
            values = getattr(self, name)
            setattr(self, name, [values[c] for c in kept])
        self.lengths = {}
        return number

    # plain data

    def to_rows(self) -> dict:
        """Nodes, roots and clusters as lists, for a state."""
        numbers: dict[int, int] = {}
        nodes: list[dict] = []

        def visit(node: Node) -> int:
            numbers[id(node)] = at = len(nodes)
            nodes.append({"c": [], "k": list(node.clusters)})
            nodes[at]["c"] = [[t, visit(child)] for t, child in sorted(node.children.items())]
            return at

        roots = [[n, visit(node)] for n, node in sorted(self.roots.items())]
        return {"nodes": nodes, "roots": roots, "clusters": [list(c) for c in self.clusters], "births": list(self.births)}

    def part(self, length: int) -> Tree:
        """A copy of the tree for one message length."""
        data, own = self.to_rows(), [c for c, tokens in enumerate(self.clusters) if len(tokens) == length]
        number, nodes, out = {c: i for i, c in enumerate(own)}, data["nodes"], []

        def copy(at: int) -> int:
            mine = len(out)
            out.append({"c": [], "k": [number[c] for c in nodes[at]["k"]]})
            out[mine]["c"] = [[t, copy(child)] for t, child in nodes[at]["c"]]
            return mine

        roots = [[n, copy(at)] for n, at in data["roots"] if n == length]
        return Tree.from_rows(self.config, {"nodes": out, "roots": roots, "clusters": [self.clusters[c] for c in own], "births": [self.births[c] for c in own]})

    @classmethod
    def joined(cls, config: MiningConfig, parts: list[dict]) -> Tree:
        """One tree of the trees of different lengths; clusters are numbered by birth."""
        every = sorted((birth, p, c) for p, data in enumerate(parts) for c, birth in enumerate(data["births"]))
        number = {(p, c): i for i, (_, p, c) in enumerate(every)}
        nodes, roots = [], []
        for p, data in enumerate(parts):
            base = len(nodes)
            nodes += [{"c": [[t, base + child] for t, child in n["c"]], "k": [number[p, c] for c in n["k"]]} for n in data["nodes"]]
            roots += [[n, base + at] for n, at in data["roots"]]
        clusters = [parts[p]["clusters"][c] for _, p, c in every]
        return cls.from_rows(config, {"nodes": nodes, "roots": sorted(roots), "clusters": clusters, "births": [b for b, _, _ in every]})

    @classmethod
    def from_rows(cls, config: MiningConfig, data: dict) -> Tree:
        """Rebuild; refuses data that no tree of this kind can have."""
        tree = cls(config)
        tree.clusters = [list(c) for c in data["clusters"]]
        tree.births = list(data.get("births") or range(len(tree.clusters)))
        tree.leaf_of = [None] * len(tree.clusters)  # type: ignore[list-item]
        tree.row_of = [0] * len(tree.clusters)
        if len(tree.clusters) > config.max_templates or any("" in c for c in tree.clusters):
            raise ValueError("the state has too many clusters or an empty token")
        nodes, seen = data["nodes"], set()

        def build(at: int, length: int, depth: int, path: list[str]) -> Node:
            if not 0 <= at < len(nodes) or at in seen:
                raise ValueError("a node of the state is reached twice or does not exist")
            seen.add(at)
            node, raw = Node(), nodes[at]
            leaf = depth == config.layers(length)
            if (leaf and raw["c"]) or (not leaf and raw["k"]) or len(raw["c"]) > config.max_children:
                raise ValueError("a node of the state holds what it may not")
            for token, child in raw["c"]:
                if token != key_of(token):
                    raise ValueError("a token with a digit can be a child only as a wildcard")
                node.children[token] = build(child, length, depth + 1, [*path, token])
            for c in raw["k"]:
                if not 0 <= c < len(tree.clusters) or len(tree.clusters[c]) != length or tree.leaf_of[c] is not None:
                    raise ValueError("a cluster of the state is in a wrong leaf")
                if any(p not in (WILDCARD, t) and t != WILDCARD for p, t in zip(path, tree.clusters[c], strict=False)):
                    raise ValueError("a cluster of the state cannot follow its path")
                tree._note(node, c)
            return node

        lengths = [n for n, _ in data["roots"]]
        if lengths != sorted(set(lengths)):
            raise ValueError("the roots of the state are out of order")
        for length, at in data["roots"]:
            tree.roots[length] = build(at, length, 0, [])
        if len(seen) != len(nodes) or any(leaf is None for leaf in tree.leaf_of):
            raise ValueError("the state has parts that nothing leads to")
        return tree
