"""Deep-shallow sorting of byte strings.

Multikey quicksort orders the strings by eight bytes at a time down to a shallow depth. Groups that still tie there have
long common prefixes; a blind trie orders each of them, comparing whole strings once for every insertion only.
"""

from __future__ import annotations

SHALLOW = 64


def common_prefix(a: bytes, b: bytes, at_least: int = 0) -> int:
    """Length of the longest common prefix, given that it is `at_least` so long."""
    most = min(len(a), len(b))
    if a[at_least:most] == b[at_least:most]:
        return most
    low, high = at_least, most  # equal up to low, different before or at high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """A compacted trie that keeps only depths and branching bytes; strings decide where a new one branches off."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # a leaf is [None, members]; a branch is [depth, {byte: child}], -1 for an end

    def _byte(self, i: int, depth: int) -> int:
        own = self.strings[i]
        return own[depth] if depth < len(own) else -1

    def insert(self, i: int, at_least: int) -> None:
        if self.root is None:
            self.root = [None, [i]]
            return
        node = self.root
        while node[0] is not None:  # blind descent
            node = node[1].get(self._byte(i, node[0])) or next(iter(node[1].values()))
        other = node[1][0]
        same = common_prefix(self.strings[i], self.strings[other], at_least)
        if same == len(self.strings[i]) == len(self.strings[other]):
            node[1].append(i)
            return
        node, above, edge = self.root, None, None
        while node[0] is not None and node[0] < same:
            above, edge = node, self._byte(i, node[0])
            node = node[1][edge]
        if node[0] == same:
            node[1][self._byte(i, same)] = [None, [i]]
            return
        branch = [same, {self._byte(i, same): [None, [i]], self._byte(other, same): node}]
        if above is None:
            self.root = branch
        else:
            above[1][edge] = branch

    def ordered(self) -> list[tuple[int, int]]:
        """(string, length it has in common with the one before; -1 for the first), in order."""
        out: list[tuple[int, int]] = []
        stack = [(self.root, -1)]
        while stack:
            node, before = stack.pop()
            if node[0] is None:
                for k, i in enumerate(node[1]):
                    out.append((i, before if k == 0 else len(self.strings[i])))
            else:
                children = sorted(node[1].items())
                stack += [(child, before if k == 0 else node[0]) for k, (_, child) in reversed(list(enumerate(children)))]
        return out


def sort(strings: list[bytes], shallow: int = SHALLOW) -> list[tuple[int, int]]:
    """(index, length in common with the string before), in order of the strings; equal ones keep their order."""
    out: list[tuple[int, int]] = []
    stack = [(list(range(len(strings))), 0)] if strings else []
    while stack:
        group, depth = stack.pop()
        if len(group) > 1 and depth < shallow:
            words = [strings[i][depth : depth + 8] for i in group]
            pivot = words[len(group) // 2]
            less = [i for i, w in zip(group, words) if w < pivot]
            same = [i for i, w in zip(group, words) if w == pivot]
            more = [i for i, w in zip(group, words) if w > pivot]
            if more:
                stack.append((more, depth))
            # strings that end here are equal as a whole
            stack.append((same, depth + 8 if len(pivot) == 8 else shallow + len(strings[same[0]])))
            if less:
                stack.append((less, depth))
            continue
        if len(group) == 1 or depth > shallow:
            found = [(i, -1 if k == 0 else len(strings[i])) for k, i in enumerate(group)]
        else:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i, depth)
            found = trie.ordered()
        first = found[0][0]
        found[0] = (first, common_prefix(strings[out[-1][0]], strings[first]) if out else 0)
        out += found
    return out
