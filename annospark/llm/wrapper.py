"""Wrappers: union-free expressions over the blocks of same-host pages, inferred by aligning page after page.

A wrapper is a list of nodes in page order. A node is a block, which stands at a path in a role with a fixed text or a text
slot, or a group of nodes; both may be optional or repeated. There is no alternation. Two wrappers (a page is one) are
aligned; where they differ, a text becomes a slot, nodes of one side become optional, and neighbours of the same
shape become a repeated node. Pages are then read through the wrapper: what no node describes is not extracted.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import xxhash

from annospark.llm.blocks import DOUBT, MAIN, PLAIN, SIDE, WORDS

GROUP = 4  # nodes of a repeated group
WIDE = 300  # nodes up to which a wrapper tells nodes apart; beyond, blocks under one element become one repeated node

# node: [shape, text or None for a slot, optional, repeated, nodes of a group]
SHAPE, TEXT, OPTIONAL, REPEATED, NODES = range(5)
ROLES = (MAIN, DOUBT, PLAIN, WORDS, SIDE)
SEEN = 10_000  # shapes of a host whose nodes one task remembers

SHARE = 0.5  # of a host's pages on which a text in a slot is furniture of the host
LEAST, LEAST_INSIDE = 2, 4  # different pages that say so, outside and inside article elements


def shape_of(path: str, role: str) -> str:
    """A block's place as a wrapper sees it; blocks of different roles never share a node."""
    return role + path


def role_of(shape: str) -> str:
    return shape[0] if shape and shape[0] in ROLES else PLAIN


def of_page(blocks: list[tuple[str, str]]) -> list:
    """The wrapper of one page, from the ``(shape, text)`` of its blocks."""
    return folded([[shape, text, False, False, []] for shape, text in blocks])


def _joined(a: list, b: list) -> list:
    """One node for two of the same shape."""
    text = a[TEXT] if a[TEXT] == b[TEXT] else None
    inner = [_joined(x, y) for x, y in zip(a[NODES], b[NODES])]
    return [a[SHAPE], text, a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], inner]


def folded(nodes: list) -> list:
    """Neighbouring runs of the same shape made into repeated nodes or groups, until none is left."""
    for size in range(1, GROUP + 1):
        out: list = []
        i = 0
        while i < len(nodes):
            run = nodes[i : i + size]
            shape = [n[SHAPE] for n in run]
            j, merged = i + size, run
            while len(run) == size and [n[SHAPE] for n in nodes[j : j + size]] == shape:
                merged = [_joined(x, y) for x, y in zip(merged, nodes[j : j + size])]
                j += size
            if j == i + size:
                out.append(nodes[i])
                i += 1
            elif size == 1:
                merged[0][REPEATED] = True
                out += merged
                i = j
            else:
                out.append(["(" + "|".join(shape) + ")", None, False, True, merged])
                i = j
        nodes = out
    return nodes


def aligned(a: list, b: list) -> list:
    """The wrapper of everything that ``a`` or ``b`` describes."""
    if a == b:
        return a
    out: list = []
    left, right = [n[SHAPE] for n in a], [n[SHAPE] for n in b]
    for what, i, k, j, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if what == "equal":
            out += [_joined(x, y) for x, y in zip(a[i:k], b[j:m])]
        else:
            out += [[*n[:OPTIONAL], True, *n[REPEATED:]] for n in a[i:k] + b[j:m]]
    out = folded(out)
    return _widened(out) if len(out) > WIDE else out


def _widened(nodes: list) -> list:
    """Blocks under the same outer element taken together, from the innermost element outwards."""
    depth = max(n[SHAPE].count(">") for n in nodes)
    while len(nodes) > WIDE and depth >= 0:
        cut = [[">".join(n[SHAPE].split(">")[: depth + 1]) if not n[NODES] else n[SHAPE], *n[TEXT:]] for n in nodes]
        nodes, depth = folded(cut), depth - 1
    # roles that take turns all along a page, or pages without an outer element: one node for each role
    return nodes if len(nodes) <= WIDE else [[r, None, True, True, []] for r in sorted({_role_alone(n[SHAPE]) for n in flat(nodes)})]


def _role_alone(shape: str) -> str:
    return shape_of("", role_of(shape))


def flat(nodes: list):
    for n in nodes:
        if n[NODES]:
            yield from flat(n[NODES])
        else:
            yield n


def key_of(path: str, text: str) -> int:
    """What pages are compared by: a text at its place, as a signed number of 64 bits."""
    n = xxhash.xxh3_64_intdigest(f"{path}\0{text}")
    return n - (1 << 64) if n >> 63 else n


class Slots:
    """Maps blocks to the nodes of a host's wrapper. Nodes of one shape share what is known of them, since a block may
    stand before or behind an optional neighbour."""

    def __init__(self, wrapper: list):
        self.open: dict[str, bool] = {}
        for n in flat(wrapper):
            self.open[n[SHAPE]] = self.open.get(n[SHAPE], False) or n[TEXT] is None or n[OPTIONAL]
        self.found: dict[str, str | None] = {}

    def node(self, shape: str) -> str | None:
        """The shape of the node that describes a block: its own, or an outer one where the wrapper took nodes together."""
        if shape not in self.found:
            if len(self.found) > SEEN:
                self.found.clear()
            at = shape
            while at not in self.open and ">" in at:
                at = at.rpartition(">")[0]
            if at not in self.open:
                at = _role_alone(shape)
            self.found[shape] = at if at in self.open else None
        return self.found[shape]


class Content:
    """Chooses the texts of a page that fill content slots of its host's wrapper.

    ``pages`` is how many different pages of the host have text. Of a slot the wrapper knows the texts that at least
    ``SHARE`` of the pages have there, ``fixed`` (``key_of`` node and text: number of pages), and ``fill``, how much text
    of its own a page has there that fills it (``key_of`` node and no text: code points).

    A block that no node describes is not extracted. A node without a slot, and a fixed text of a slot, is furniture; fewer
    than ``LEAST`` pages, or ``LEAST_INSIDE`` in an article element, say nothing. Inside article elements that holds only where such texts are the
    smaller part of the blocks of the page's article: where they are the larger part, the pages are versions of one article and keep it.

    Of the slots that a page fills then, those in article elements are content; else those of doubtful role or those of none,
    whichever the pages of the host fill with more text of their own, so a short page follows its host. What is the side by its class names is content where a host has nothing else.
    """

    def __init__(self, wrapper: list, pages: int, fixed: dict[int, int], fill: dict[int, float]):
        self.slots, self.pages, self.fixed = Slots(wrapper), pages, fixed
        self.fill = {shape: fill.get(key_of(shape, ""), 0.0) for shape in self.slots.open}
        self.roles = {role_of(shape) for shape, open_ in self.slots.open.items() if open_ or pages < LEAST}

    def of(self, blocks: list[tuple[str, str]]) -> list[str]:
        inside, judged = [0, 0], []
        for shape, text in blocks:
            node = self.slots.node(shape)
            if node is None:
                continue
            role = role_of(node)
            least = LEAST_INSIDE if role in (MAIN, DOUBT) else LEAST
            n = self.pages if not self.slots.open[node] else self.fixed.get(key_of(node, text), 0)
            repeats = n >= least and n >= SHARE * self.pages
            judged.append((node, role, text, repeats))
            if role in (MAIN, DOUBT):
                inside[repeats] += 1
        left: dict[str, list[tuple[str, str]]] = {r: [] for r in ROLES}
        for node, role, text, repeats in judged:
            # an article most of which repeats is one of several versions, not furniture
            if not repeats or role in (MAIN, DOUBT) and inside[True] > inside[False]:
                left[role].append((node, text))
        chosen = left[MAIN] or max(left[DOUBT], left[PLAIN], key=self._weight)
        if not chosen and not self.roles & {MAIN, DOUBT, PLAIN}:
            chosen = left[WORDS]
        return [text for _, text in chosen]

    def _weight(self, texts: list[tuple[str, str]]) -> tuple[float, int]:
        return sum(self.fill[node] for node in {node for node, _ in texts}), sum(len(text) for _, text in texts)
