"""Suffix arrays of many short strings by grouping suffixes with the same Lyndon prefix.

The order of all suffixes of a block is built in two steps, each over all strings of the block at once.

1. Grouping. The Lyndon prefix of a suffix ends where the next smaller suffix of its string begins. From the
   right, each suffix finds it by following the pointers of the suffixes behind it; a pointer is the
   previous-smaller relation read from the other side. Suffixes with the same Lyndon prefix are a
   group, and groups are in the order of these prefixes, so each group's range in the result is known.
2. Emission. Within a group, suffixes are in the order of what follows the Lyndon prefix, the next smaller
   suffixes, which lie in earlier ranges. Ranges are filled as soon as those are known. Nothing is
   renamed, and there is no recursion on a shorter text.

Strings end with a mark that is smaller than any byte, so neither pointers nor words reach
beyond a string. Text bytes are below 0xF8, as UTF-8 always is.
"""

from __future__ import annotations

import numpy as np

_MASKS = np.array([0, *(((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(1, 9))], np.uint64)

# Places after each one that are compared with it before any pointer is followed.
NEAR = 16


class Block:
    """Strings side by side: ``text`` is their bytes plus one, each followed by a zero."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.r_[0, np.cumsum(self.lengths + 1)[:-1]].astype(np.int64)
        raw = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
        self.text = np.zeros(len(raw) + 8, np.uint8)
        self.text[: len(raw)] = raw + np.uint8(1)  # the separator 0xff becomes zero
        self.size = len(raw)
        packed = np.zeros(self.size, np.uint64)
        for k in range(8):
            packed = packed << np.uint64(8) | self.text[k : k + self.size]
        # Eight bytes from each place on; the last places are only ever compared as zeros.
        self.packed = np.r_[packed, np.zeros(8, np.uint64)]

    def next_smaller(self) -> np.ndarray:
        """For each place the next one in its string, or its end, with a smaller suffix.

        Of most places it is among the next NEAR ones, which all places look at together as long as eight bytes
        decide. The others follow pointers from the right, first that of the smallest suffix they have passed. In
        periodic text, places that are equal for long compare like those as far apart behind them."""
        packed = self.packed
        found = np.arange(1, self.size + 1)
        left = np.flatnonzero(self.text[: self.size])
        own, low_at = packed[left], left + 1
        low = packed[low_at]
        equal = []
        for step in range(1, NEAR + 1):
            value = packed[left + step]
            smaller = left[value < own]
            found[smaller] = smaller + step
            equal.append(left[value == own])
            on = value > own
            left, own, low, low_at, value = left[on], own[on], low[on], low_at[on], value[on]
            less = value < low
            low[less], low_at[less] = value[less], left[less] + step
        tied = np.concatenate(equal)
        places, via = np.r_[left, tied], np.r_[low_at, tied + 1]
        passed = np.arange(len(places)) < len(left)
        ends = self.starts + self.lengths
        back = ends[np.searchsorted(ends, places)] - places
        order = np.argsort(back, kind="stable")
        places, via, passed, back = places[order], via[order], passed[order], back[order]
        # Of places that were equal to another one for eight bytes: how far off that was, and the result.
        apart, result = np.zeros(self.size + 16, np.int64), np.zeros(self.size + 16, bool)
        ahead = np.arange(1, 9)
        bounds = [*np.flatnonzero(np.r_[True, back[1:] != back[:-1]][: len(back)]).tolist(), len(back)]
        for start, stop in zip(bounds, bounds[1:]):
            i, j = places[start:stop], via[start:stop]
            j = np.where(passed[start:stop], found[j], j)
            mine = packed[i]
            while len(i):
                a, b = mine, packed[j]
                greater = b > a
                tie = same = np.flatnonzero(a == b)
                gap, step = j - i, 8
                while len(same):  # equal so far: the strings differ before either ends
                    behind = i[same, None] + (step - 8) + ahead
                    hit = apart[behind] == gap[same, None]
                    known = hit.any(axis=1)
                    greater[same[known]] = result[behind[known, hit[known].argmax(axis=1)]]
                    same = same[~known]
                    a, b = packed[i[same] + step], packed[j[same] + step]
                    greater[same] = b > a
                    same = same[a == b]
                    step += 8
                apart[i[tie]], result[i[tie]] = gap[tie], greater[tie]
                found[i[~greater]] = j[~greater]
                i, mine, j = i[greater], mine[greater], found[j[greater]]
        return found

    def words(self, group: np.ndarray, after: np.ndarray, places: np.ndarray):
        """(order, first): places by group of strings and Lyndon prefix; ``first`` is the slot where
        each place's group of suffixes begins."""
        length = after[places] - places
        part = self.packed[places] & _MASKS[np.minimum(length, 8)]
        order = np.lexsort((part, group))
        new = np.r_[True, (part[order][1:] != part[order][:-1]) | (group[order][1:] != group[order][:-1])]
        slot_first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        depth = 8
        longest = int(length.max(initial=0))
        check = np.arange(len(order))
        while depth < longest and len(check):
            # Slots of groups in which some word goes on, and that have other members.
            first = slot_first[check]
            goes_on = np.bincount(first, length[order[check]] > depth, len(order)) > 0
            size = np.bincount(first, minlength=len(order))
            check = check[(goes_on & (size > 1))[first]]
            if not len(check):
                break
            member = order[check]
            rest = np.clip(length[member] - depth, 0, 8)
            at = np.minimum(places[member] + depth, self.size)
            part = self.packed[at] & _MASKS[rest]
            first = slot_first[check]
            by = np.lexsort((part, first))
            order[check] = member[by]
            part = part[by]
            new = np.r_[True, (part[1:] != part[:-1]) | (first[1:] != first[:-1])]
            run = np.maximum.accumulate(np.where(new, np.arange(len(check)), 0))
            slot_first[check] = check[run]
            depth += 8
        first_of = np.empty(len(order), np.int64)
        first_of[order] = slot_first
        return order, first_of

    def suffix_order(self, group_of_string: np.ndarray) -> np.ndarray:
        """All places but the ends, ordered by group of strings, then by suffix."""
        after = self.next_smaller()
        is_end = np.zeros(self.size, bool)
        is_end[self.starts + self.lengths] = True
        places = np.flatnonzero(~is_end)
        group = np.repeat(group_of_string, self.lengths)
        order, first = self.words(group, after, places)
        n = len(places)
        if not n:
            return places
        number = np.full(self.size + 1, -1)
        number[places] = np.arange(n)
        # What follows a word and its repetitions; more repetitions make the larger suffix.
        follows = number[after[places]]
        behind, times = follows.copy(), np.ones(n, np.int64)
        going = np.flatnonzero((behind >= 0) & (first[behind] == first))
        while len(going):
            times[going] += 1
            behind[going] = follows[behind[going]]
            going = going[(behind[going] >= 0) & (first[behind[going]] == first[going])]
        size = np.bincount(first, minlength=n)
        rank = np.full(n + 1, -1)
        rank[n] = 0  # stands for the end of a string, the smallest of all
        behind[behind < 0] = n
        alone = size[first] == 1
        rank[:n][alone] = first[alone] + 1
        waiting = np.flatnonzero(~alone)
        while len(waiting):
            known = rank[behind[waiting]] >= 0
            unknown = np.bincount(first[waiting][~known], minlength=n) > 0
            ready = ~unknown[first[waiting]]
            now = waiting[ready]
            by = now[np.lexsort((rank[behind[now]], times[now], first[now]))]
            start = first[by]
            new = np.r_[True, start[1:] != start[:-1]]
            run = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
            rank[by] = start + np.arange(len(by)) - run + 1
            waiting = waiting[~ready]
        out = np.empty(n, np.int64)
        out[rank[:n] - 1] = places
        return out

    def same_prefix(self, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
        """Whether the ``length`` bytes from the places on are equal; no string ends within."""
        same = np.ones(len(left), bool)
        check = np.arange(len(left))
        for step in range(0, length, 8):
            mask = _MASKS[min(8, length - step)]
            a = self.packed[left[check] + step] & mask
            b = self.packed[right[check] + step] & mask
            same[check[a != b]] = False
            check = check[a == b]
        return same
