"""Suffix array of a short byte string by grouping suffixes under their Lyndon prefixes.

At first a group holds the suffixes of one first byte. Groups are taken in descending order.
From each suffix of a group the previous-smaller pointer leads to the nearest position on its left
in a lower group. The prefix of that suffix reaches up to here, so it is lengthened by the
prefix of the group, as often as pointers of the group meet there, and moves with its like to a group
of its own right above its old one, those with more pointers higher. When the lowest group is done, the
prefix of every suffix is its longest Lyndon word, and ends where the next smaller suffix begins.

Suffixes of a group are then in the order of the suffixes that follow their prefixes. So one
pass over the array in ascending order places all of them: each suffix, when it is reached,
sends those for which it is the next smaller one to the first free slot of their groups. These
are found from its left neighbour by the same pointers. No string is compared, copied or
renamed, and nothing recurs: all state is some integers for each position. Pointers skip what is done by
halved paths, so the time is linear but for their inverse Ackermann factor.
"""

from __future__ import annotations

from collections import Counter


def grouped(text: bytes) -> tuple[list[int], list[int], list[int]]:
    """Of every suffix the first slot of its group, its pointer (-1: none), and where its Lyndon word ends."""
    n = len(text)
    starts, at = {}, 0
    size = [0] * n  # of the group that begins at a slot
    for byte, count in sorted(Counter(text).items()):
        starts[byte], size[at] = at, count
        at += count
    group = [starts[byte] for byte in text]
    slots, slot_of = [0] * n, [0] * n  # positions, group after group, and their inverse
    for i, byte in enumerate(text):
        slots[starts[byte]], slot_of[i] = i, starts[byte]
        starts[byte] += 1
    upto = list(range(1, n + 1))
    before = [-1] * n
    open_at = list(range(n + 1))  # by position + 1: itself while its group is not done, else one further left
    top = n
    while top:
        first = group[slots[top - 1]]
        members = slots[first:top]
        top = first
        width = upto[members[0]] - members[0]
        for i in members:
            open_at[i + 1] = i
        met: dict[int, int] = {}
        for i in members:
            at = i
            while open_at[at] != at:
                open_at[at] = at = open_at[open_at[at]]
            open_at[i + 1] = at
            if at:
                before[i] = at - 1
                met[at - 1] = met.get(at - 1, 0) + 1
        if not met:
            continue
        by_count: dict[int, list[int]] = {}
        for p, count in met.items():
            by_count.setdefault(count, []).append(p)
        for count in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for p in by_count[count]:
                upto[p] += count * width
                own = group[p]
                size[own] -= 1
                last, slot = own + size[own], slot_of[p]
                other = slots[last]
                slots[slot], slots[last] = other, p
                slot_of[other], slot_of[p] = slot, last
                moved[own] = moved.get(own, 0) + 1
            for own, number in moved.items():
                begin = own + size[own]
                size[begin] = number
                for slot in range(begin, begin + number):
                    group[slots[slot]] = begin
    return group, before, upto


def suffix_array(text: bytes) -> list[int]:
    """Start positions of all suffixes in ascending order."""
    n = len(text)
    if not n:
        return []
    group, before, upto = grouped(text)
    free, order = list(range(n)), [-1] * n
    for slot in range(-1, n):
        reached = n if slot < 0 else order[slot]
        j = reached - 1
        while j >= 0 and upto[j] == reached:
            own = group[j]
            order[free[own]] = j
            free[own] += 1
            j = before[j]
    return order


def common_prefixes(text: bytes, order: list[int], enough: int) -> list[bool]:
    """Whether each suffix and the one before it in order share ``enough`` bytes."""
    heads = [text[i : i + enough] for i in order]
    return [False, *(a == b for a, b in zip(heads, heads[1:]))][: len(order)]
