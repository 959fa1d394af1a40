"""Suffix order of many short texts by grouping suffixes on their Lyndon prefixes.

The construction has two phases. The first puts suffixes with the same Lyndon
prefix (the longest prefix that is smaller than each of its own suffixes) into
one group and knows, for each suffix, the previous smaller one. The second
walks over the order as it grows and emits, behind each suffix, those whose
Lyndon prefix ends where it starts, each at the front of its group; no text of
names is built and nothing recurses.

Texts are short and many here, so the first phase works on all of them at
once in numpy: Lyndon words are merged from right to left, one position of
every text in a step, and groups are cut by comparing eight bytes at a time.
"""

from __future__ import annotations

import numpy as np

#: Zero bytes behind the last text, more than a comparison reads ahead.
PAD = 64


def joined_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each ended by a zero and its bytes raised by one (no UTF-8 byte is 255), and where each starts."""
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
    return data, starts


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number that compares like them."""
    words = np.concatenate((data, np.zeros(PAD + 8, np.uint8))).astype(np.uint64)
    for step in (1, 2, 4):
        words = (words[:-step] << np.uint64(8 * step)) | words[step:]
    return words


def smaller_suffixes(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the next and the previous smaller suffix of its text; previous is -1 if there is none.

    ``following`` of a terminator is -1.
    """
    following = np.full(size, -1, np.int64)
    previous = np.full(size, -1, np.int64)
    lengths = np.diff(starts) - 1
    by_length = np.argsort(-lengths, kind="stable")
    lengths, ends = lengths[by_length], starts[1:][by_length] - 1
    for step in range(1, int(lengths[0]) + 1 if len(lengths) else 0):
        count = int(np.searchsorted(-lengths, -step, side="right"))
        here = ends[:count] - step
        other = here + 1
        active = np.flatnonzero(other < ends[:count])
        while len(active):
            i, e = here[active], other[active]
            less = np.zeros(len(active), bool)
            tied = np.arange(len(active))
            shift = 0
            while len(tied):
                a, b = words[i[tied] + shift], words[e[tied] + shift]
                less[tied] = a < b
                tied = tied[a == b]
                shift += 8
            i, e, active = i[less], e[less], active[less]
            previous[e] = i
            beyond = following[e]
            other[active] = beyond
            active = active[beyond < ends[active]]
        following[here] = other
    return following, previous


def lyndon_groups(words: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each position, numbered in the order of the Lyndon prefixes, and the sizes of the groups.

    Group 0 holds the terminators. A shorter prefix comes before those it begins.
    """
    positions = np.arange(len(following))
    length = np.where(following < 0, 0, following - positions)
    group = np.zeros(len(following), np.int64)
    todo, depth = positions, 0
    while len(todo):
        left = np.minimum(length[todo] - depth, 8)
        mask = np.where(left <= 0, np.uint64(0), ~np.uint64(0) << (np.uint64(8) * (8 - np.maximum(left, 1)).astype(np.uint64)))
        key = words[todo + depth] & mask
        order = np.lexsort((key, group[todo]))
        ranked, key = todo[order], key[order]
        new = np.ones(len(ranked), bool)
        new[1:] = (group[ranked][1:] != group[ranked][:-1]) | (key[1:] != key[:-1])
        # A group is named by its first place among all positions, so the parts of a split group stay between its neighbours.
        old = group[ranked]
        first_of_old = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        base = np.repeat(first_of_old, np.diff(np.append(first_of_old, len(old))))
        place = np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0))
        group[ranked] = old + (place - base) + 0
        depth += 8
        todo = ranked[length[ranked] > depth]
        # Finished members of a group are smaller than its longer ones and must be placed first.
        # They differ in the key already: a word that ends has a zero byte there unless it fills the eight.
        full = np.flatnonzero(length[ranked] == depth)
        if len(full) and len(todo):
            ended = np.zeros(len(following), np.int64)
            np.add.at(ended, group[ranked[full]], 1)
            group[todo] += ended[group[todo]]
    sizes = np.bincount(group, minlength=len(following))
    return group, sizes


def suffix_order(data: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, a suffix ending with its text; terminators come first."""
    size = len(data)
    following, previous = smaller_suffixes(words, starts, size)
    group, _ = lyndon_groups(words, following)
    order = [0] * size
    ends = (starts[1:] - 1).tolist()
    order[: len(ends)] = ends
    front = np.arange(size).tolist()  # a group's name is its first place
    ends_at, parent, name = [*following.tolist(), -2], previous.tolist(), group.tolist()
    for place in range(size):
        suffix = order[place]
        at = suffix - 1
        while ends_at[at] == suffix:
            g = name[at]
            order[front[g]] = at
            front[g] += 1
            at = parent[at]
    return np.array(order, np.int64)
