"""Deep-shallow sorting of byte strings that share long prefixes.

Multikey quicksort orders a group of suffixes on words of eight bytes down to a
shallow depth. Whatever is still alike there has a long common prefix: such a
group goes into a blind trie, whose nodes hold only the depth at which their
suffixes branch and the byte each branch takes. An insertion follows the branch
bytes blindly to some leaf, one comparison with that leaf gives the true common
prefix, and the new leaf is tied in at that depth. Walking the trie gives the
order and the common prefixes of neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

SHALLOW = 64
_WORD = 8


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class _Node:
    """A branch at ``depth``; -1 stands for a string that ends there. ``leaf``: any string below."""

    __slots__ = ("depth", "leaf", "next")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.leaf, self.next = depth, leaf, {}


def _byte(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def blind_trie(strings: list[bytes], group: list[int]) -> Iterator[tuple[int, int]]:
    """(string, common prefix with the one before; -1 for the first), in order. Equal strings are allowed."""
    root: _Node | list[int] = [group[0]]
    for s in group[1:]:
        text, at = strings[s], root
        while isinstance(at, _Node):
            at = at.next.get(_byte(text, at.depth), at.leaf)
            if isinstance(at, int):
                at = [at]
        other = strings[at[0]]
        lcp = common_prefix(text, other)
        same = lcp == len(text) == len(other)
        parent, key, here = None, 0, root
        while isinstance(here, _Node) and here.depth < lcp or (isinstance(here, _Node) and here.depth == lcp and not same):
            if here.depth == lcp:
                break
            parent, key, here = here, _byte(text, here.depth), here.next[_byte(text, here.depth)]
        if same:
            while isinstance(here, _Node):
                parent, key, here = here, _byte(text, here.depth), here.next[_byte(text, here.depth)]
            here.append(s)
            continue
        if isinstance(here, _Node) and here.depth == lcp:
            here.next[_byte(text, lcp)] = [s]
            continue
        node = _Node(lcp, at[0])
        node.next = {_byte(other, lcp): here, _byte(text, lcp): [s]}
        if parent is None:
            root = node
        else:
            parent.next[key] = node
    # Walk in order, without recursion: prefixes may be deep.
    lcp, stack = -1, [(root, -1)]
    while stack:
        here, depth = stack.pop()
        if isinstance(here, list):
            for k, s in enumerate(here):
                yield s, (depth if k == 0 else len(strings[s]))
            continue
        keys = sorted(here.next, reverse=True)
        stack += [(here.next[b], depth if b == keys[-1] else here.depth) for b in keys]


def sort_group(strings: list[bytes], group: list[int], shared: int = 0) -> Iterator[tuple[int, int]]:
    """(string, common prefix with the one before; -1 for the first) in order; all share ``shared`` bytes."""
    limit = shared + SHALLOW
    stack: list[tuple[list[int], int, int]] = [(group, shared, -1)]  # a part, bytes it shares, its prefix with what came before
    last = -1
    while stack:
        part, depth, before = stack.pop()
        if len(part) == 1:
            out = [(part[0], before)]
        elif depth >= limit:
            out = [(s, before if k == 0 else lcp) for k, (s, lcp) in enumerate(blind_trie(strings, part))]
        else:
            words = {s: strings[s][depth : depth + _WORD] for s in part}
            pivot = words[part[len(part) // 2]]
            less, same, more = [], [], []
            for s in part:
                w = words[s]
                (same if w == pivot else less if w < pivot else more).append(s)
            if len(pivot) < _WORD:  # these end here, so they are equal
                out = None
                pieces = [(less, depth), (same, None), (more, depth)]
            else:
                out = None
                pieces = [(less, depth), (same, depth + _WORD), (more, depth)]
            pieces = [(p, d) for p, d in pieces if p]
            for k in range(len(pieces) - 1, -1, -1):
                p, d = pieces[k]
                stack.append((p, limit if d is None else d, before if k == 0 else -2))
            continue
        for s, lcp in out:
            if lcp == -2:  # first of a part after a smaller one
                lcp = common_prefix(strings[last], strings[s])
            yield s, lcp
            last = s
