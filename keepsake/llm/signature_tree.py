"""Signature trees: nodes hold the OR of their members' token bitmaps and a size range.

An item is (id, size, bits): a set of ``size`` tokens of which each sets one bit. Two sets
share at most as many tokens as their bitmaps share bits, plus the smaller number of tokens
that fell on a bit already set. The same bound holds for nodes with the OR of the bitmaps
and the largest such excess, and is weighed against the smallest sizes below.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

FAN = 8
#: Links need 100 * shared >= PERCENT * united.
PERCENT = 80


def width_of(size: int) -> int:
    """Bits of a bitmap: the power of two from twice the size on, 64 at least."""
    return max(64, 1 << (2 * size - 1).bit_length())


class Groups:
    """Union-find over ids; a group's root is its smallest id."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.parent.setdefault(min(x, y), min(x, y))


class Node:
    __slots__ = ("bits", "low", "high", "excess", "kids", "ids")

    def __init__(self, bits, low, high, excess, kids, ids):
        self.bits, self.low, self.high, self.excess, self.kids, self.ids = bits, low, high, excess, kids, ids


def build(items: Iterable[tuple[int, int, int]]) -> Node:
    """A tree over items in the order of their sizes."""
    level = [Node(b, n, n, n - b.bit_count(), None, [i]) for i, n, b in sorted(items, key=lambda x: (x[1], x[0]))]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), FAN):
            kids = level[at : at + FAN]
            bits = 0
            for kid in kids:
                bits |= kid.bits
            above.append(Node(
                bits, kids[0].low, kids[-1].high, max(k.excess for k in kids), kids, [i for k in kids for i in k.ids]
            ))
        level = above
    return level[0]


def may_link(x: Node, y: Node) -> bool:
    if 100 * x.high < PERCENT * y.low or 100 * y.high < PERCENT * x.low:
        return False
    most = (x.bits & y.bits).bit_count() + min(x.excess, y.excess)
    return (100 + PERCENT) * most >= PERCENT * (x.low + y.low)


def traverse(x: Node, y: Node, groups: Groups, linked: Callable[[int, int], bool]) -> None:
    """Unite all linked members of two nodes (or of one with itself); node pairs that cannot
    hold a link, or whose members are one group already, are passed over."""
    if x is y:
        if x.kids:
            for kid in x.kids:
                traverse(kid, kid, groups, linked)
            for i, kid in enumerate(x.kids):
                for other in x.kids[i + 1 :]:
                    traverse(kid, other, groups, linked)
        return
    if not may_link(x, y):
        return
    if not x.kids and not y.kids:
        a, b = x.ids[0], y.ids[0]
        if groups.find(a) != groups.find(b) and linked(a, b):
            groups.union(a, b)
        return
    root = groups.find(x.ids[0])
    if all(groups.find(i) == root for i in x.ids) and all(groups.find(i) == root for i in y.ids):
        return
    if not y.kids or (x.kids and len(x.ids) >= len(y.ids)):
        for kid in x.kids:
            traverse(kid, y, groups, linked)
    else:
        for kid in y.kids:
            traverse(x, kid, groups, linked)


def fold(bits: int, width: int) -> int:
    """A bitmap of half the width: a token's bit is its place modulo the width."""
    return (bits & ((1 << width) - 1)) | (bits >> width)


def unite(items: list[tuple[int, int, int]], groups: Groups, linked: Callable[[int, int], bool]) -> None:
    """Unite all linked items. Sizes of linked sets differ by a quarter at most, so only
    bitmaps of one width or of neighbouring widths meet; the wider is folded."""
    by_width = defaultdict(list)
    for item in items:
        by_width[width_of(item[1])].append(item)
    for width, own in by_width.items():
        tree = build(own)
        traverse(tree, tree, groups, linked)
        if 2 * width in by_width:
            wider = build((i, n, fold(b, width)) for i, n, b in by_width[2 * width])
            traverse(tree, wider, groups, linked)
