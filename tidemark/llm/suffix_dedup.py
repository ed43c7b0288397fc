"""Exact substring deduplication by deep-shallow suffix sorting.

Candidate suffixes (those that share an anchor, see ``repeats``) are sorted in buckets: a ternary multikey quicksort,
eight bytes a step, orders them to a shallow depth; groups whose members still agree there have long common
prefixes and are ordered by a blind trie, which compares each new suffix with one leaf only. Suffixes that agree
over the whole width are repeats.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as rp
from .scratch import Scratch, small_batches

#: Bytes that the multikey quicksort orders.
SHALLOW = 32
STEP = 8


def _words(buf: bytes) -> np.ndarray:
    """At each byte the next eight as one big-endian number; zeros beyond the end."""
    padded = buf + bytes(STEP)
    return np.ndarray(shape=(len(buf) + 1,), dtype=">u8", buffer=padded, strides=(1,))


def multikey_quicksort(buf: bytes, pos: np.ndarray, length: np.ndarray, group: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order suffixes within their groups by the first ``depth`` bytes of each.

    Returns the order and, for each place in it, a group number: equal where the suffixes agree so far. All groups
    take a step together: each is split around its middle member's next eight bytes into less, equal and more; the
    equal parts go on with the next eight bytes.
    """
    words = _words(buf)
    order = np.argsort(group, kind="stable")
    group = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]])) if len(order) else group[order]
    done = np.zeros(len(order), np.int64)  # bytes that the group agrees on
    while True:
        size = np.bincount(group)
        limit = np.minimum(depth, length[order])
        active = np.flatnonzero((size[group] > 1) & (done < limit))
        if not len(active):
            return order, group
        g, o, at = group[active], order[active], done[active]
        w = words[pos[o] + at].astype(np.uint64)
        spare = STEP - np.minimum(STEP, length[o] - at)  # bytes read beyond the suffix
        w = (w >> (spare * 8).astype(np.uint64)) << (spare * 8).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        members = np.diff(np.concatenate([first, [len(g)]]))
        pivot = np.repeat(w[first + members // 2], members)
        side = (w > pivot).astype(np.int64) - (w < pivot)
        rank = np.repeat(np.arange(len(first)), members) * 3 + side + 1
        turn = np.argsort(rank, kind="stable")
        order[active] = o[turn]
        done[active] = (at + np.where(side == 0, STEP, 0))[turn]
        rank = rank[turn]
        # new group borders: where the part changes, and where a group ended before
        border = np.concatenate([[True], group[1:] != group[:-1]])
        border[active] |= np.concatenate([[True], rank[1:] != rank[:-1]])
        group = np.cumsum(border) - 1


class BlindTrie:
    """Patricia trie of suffixes: inner nodes have a depth and one branch a byte; leaves have the suffixes that are equal.

    A suffix goes down blindly, looking only at the bytes at branching depths, to some leaf; one comparison with that
    leaf gives the true common prefix, where it is put in.
    """

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | None = None  # leaf: [-1, text, members]; inner: [depth, branches]

    @staticmethod
    def common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n
        lo, hi = 0, n  # they agree on lo bytes, not on hi
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if a[lo:mid] == b[lo:mid]:
                lo = mid
            else:
                hi = mid
        return lo

    def add(self, text: bytes, member: int) -> None:
        node = self.root
        if node is None:
            self.root = [-1, text, [member]]
            return
        while node[0] >= 0:
            c = text[node[0]] if node[0] < len(text) else -1
            branches = node[1]
            node = branches[c] if c in branches else next(iter(branches.values()))
        other = node[1]
        if other == text:
            node[2].append(member)
            return
        same = self.common(text, other)
        c = text[same] if same < len(text) else -1
        above, node = None, self.root
        while 0 <= node[0] < same:
            above = (node, text[node[0]])
            node = node[1][above[1]]
        leaf = [-1, text, [member]]
        if node[0] == same:
            node[1][c] = leaf
            return
        old = other[same] if same < len(other) else -1
        inner = [same, {old: node, c: leaf}]
        if above is None:
            self.root = inner
        else:
            above[0][1][above[1]] = inner

    def leaves(self) -> list[list[int]]:
        """Equal suffixes, in byte order."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out.append(node[2])
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def deep_shallow(buf: bytes, pos: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Class numbers of suffixes cut to their lengths, in sorted order of group and bytes: equal where both are equal.

    Suffixes of one group must have one length.
    """
    order, fine = multikey_quicksort(buf, pos, length, group)
    out = np.empty(len(pos), np.int64)
    if not len(pos):
        return out
    size = np.bincount(fine)
    first = np.cumsum(size) - size
    deep = (size > 1) & (length[order[first]] > SHALLOW)
    extra = np.zeros(len(size), np.int64)  # classes beyond one of each group
    inside = np.zeros(len(order), np.int64)
    for g in np.flatnonzero(deep).tolist():
        a, m = int(first[g]), int(size[g])
        o = order[a : a + m]
        trie = BlindTrie()
        for x, (p, n) in enumerate(zip(pos[o].tolist(), length[o].tolist(), strict=True)):
            trie.add(buf[p + SHALLOW : p + n], x)
        leaves = trie.leaves()
        extra[g] = len(leaves) - 1
        for number, members in enumerate(leaves):
            inside[a + np.array(members)] = number
    before = np.cumsum(extra) - extra
    out[order] = fine + before[fine] + inside
    return out


def remove_repeated_substrings(docs: DataFrame, width: int = 200, gram: int = 50) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts anywhere else in the corpus.

    Texts are UTF-8 bytes, whole; a null text is empty; matches never cross documents; overlaps count; all strings
    are judged on the input. Returns doc_id, n_units (bytes), n_removed, spans, kept (binary: cuts may split a
    character). Texts shorter than ``width`` and empty tables lose nothing. Repeated rows are copies of one another.
    A text of any length is taken whole, about 10 bytes of memory a byte beyond the first megabyte. Extra columns are
    not carried.
    """
    spark = docs.sparkSession
    small_batches(spark)
    unit = rp.Unit(False, width, gram)
    scratch = Scratch(spark, "suffix")
    docs = rp.keyed(docs)
    all_anchors = scratch.keep("anchors", rp.anchors(docs, unit))
    # a table of its own, so that the join may split a hot hash
    often = scratch.keep("often", all_anchors.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"))
    candidates = rp.salted(all_anchors.join(often, "h"))
    found = rp.match(rp.segments(docs, candidates, unit), unit, deep_shallow, scratch.keep)
    ranges = scratch.keep("ranges", found.unionByName(rp.copies(all_anchors)))
    scratch.drop("anchors", "often", "found")
    scratch.sweep()
    return rp.cover(docs, ranges, unit)
