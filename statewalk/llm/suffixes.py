"""Suffix arrays by induced sorting, and permuted common prefixes, on whole numpy arrays.

Suffixes are classified as smaller (S) or larger (L) than their successor. The leftmost S of each run (LMS) cut the text
into substrings; these are sorted by induction, named, and, if names repeat, the string of names is sorted by recursion. Two
linear passes then induce the order of all suffixes from that of the LMS ones: L-types by ascending buckets, S-types by
descending buckets. A pass works bucket by bucket: all entries of a bucket are induced at once, in rounds for runs of one
symbol. The recursion names pairs of names rather than LMS substrings of names, as a level of the latter has as many buckets
as names and its passes could not be run by whole buckets.
"""

from __future__ import annotations

import numpy as np


def _spread(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by value, the distinct values, and where in the order each begins and how many it has."""
    order = np.argsort(values, kind="stable")
    sorted_values = values[order]
    new = np.empty(len(order), bool)
    new[0] = True
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return order, sorted_values[first], first, np.diff(first, append=len(order))


def _induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array induced from LMS positions given in order, those of one bucket behind each other."""
    n = len(text)
    sa = np.full(n, -1, np.int32)
    head = starts.tolist()
    own = text[lms]
    cut = np.searchsorted(own, np.arange(len(starts) + 1))

    def put_l(js: np.ndarray) -> None:
        prev = js[js > 0] - 1
        prev = prev[~is_s[prev]]
        if len(prev):
            order, values, first, size = _spread(text[prev])
            prev = prev[order]
            for v, a, n in zip(values.tolist(), first.tolist(), size.tolist()):
                at = head[v]
                sa[at : at + n] = prev[a : a + n]
                head[v] = at + n

    for c in range(len(starts)):
        at = int(starts[c])
        while at < head[c]:
            js, at = sa[at : head[c]].copy(), head[c]
            put_l(js)
        if cut[c] < cut[c + 1]:
            put_l(lms[cut[c] : cut[c + 1]])

    tail = ends.tolist()

    def put_s(js: np.ndarray) -> None:
        prev = js[js > 0] - 1
        prev = prev[is_s[prev]]
        if len(prev):
            order, values, first, size = _spread(text[prev])
            prev = prev[order]
            for v, a, n in zip(values.tolist(), first.tolist(), size.tolist()):
                at = tail[v]
                sa[at - n : at] = prev[a : a + n][::-1]
                tail[v] = at - n

    for c in range(len(starts) - 1, -1, -1):
        if c == 0:
            sa[0] = n - 1
            break
        at = int(ends[c])
        while at > tail[c]:
            js, at = sa[tail[c] : at][::-1].copy(), tail[c]
            put_s(js)
        if starts[c] < head[c]:
            put_s(sa[starts[c] : head[c]][::-1])
    return sa


def suffix_array(text: np.ndarray, alphabet: int, depth: int | None = None) -> np.ndarray:
    """Suffix array of a string of symbols 1 to alphabet - 1 that ends with a 0, the only one.

    With a depth, suffixes that share their first `depth` symbols may stand in any order among themselves.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    change = np.flatnonzero(text[:-1] != text[1:])
    is_s = np.empty(n, bool)
    is_s[:-1] = np.repeat(text[change] < text[change + 1], np.diff(np.concatenate(([-1], change))))
    is_s[-1] = True
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    counts = np.bincount(text, minlength=alphabet)
    ends = np.cumsum(counts)
    starts = ends - counts

    sa = _induce(text, is_s, lms[np.argsort(text[lms], kind="stable")], starts, ends)
    mark = np.zeros(n, bool)
    mark[lms] = True
    ordered = sa[mark[sa]]
    # name the LMS substrings, each up to and with the next LMS position
    place = np.full(n, -1, np.int32)
    place[lms] = np.arange(len(lms), dtype=np.int32)
    length = np.diff(np.append(lms, n)) + 1
    length[-1] = 1
    size = length[place[ordered]]
    same = np.zeros(len(ordered), bool)
    pairs = np.flatnonzero(size[1:] == size[:-1]) + 1
    k = 0
    while len(pairs):
        done = size[pairs] <= k
        same[pairs[done]] = True
        pairs = pairs[~done]
        pairs = pairs[text[ordered[pairs] + k] == text[ordered[pairs - 1] + k]]
        k += 1
    names = np.empty(len(lms), np.int64)
    names[place[ordered]] = np.cumsum(~same) - 1
    ordered = lms[_order_of_names(names, -1 if depth is None else -(-depth // 2))]
    return _induce(text, is_s, ordered, starts, ends)


def _order_of_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by recursion: pairs of names are named, which doubles what a name covers.

    Ends when all names differ or, with a depth of 0 or more, once a name covers that many of the first names.
    """
    covers, n = 1, len(names)
    while True:
        distinct = int(names.max()) + 1
        if distinct == n or 0 <= depth <= covers:
            return np.argsort(names, kind="stable")
        # the pair of what a name covers and what follows it; past the end is less than any name
        pair = names * (distinct + 1)
        pair[: n - covers] += names[covers:] + 1
        order = np.argsort(pair)
        sorted_pairs = pair[order]
        new = sorted_pairs[1:] != sorted_pairs[:-1]
        names = np.empty(n, np.int64)
        names[order] = np.concatenate(([0], np.cumsum(new)))
        covers *= 2


def permuted_common_prefixes(raw: np.ndarray, sa: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position of raw, the length of the prefix it shares with the suffix that sorts before it, within ends.

    sa sorts raw followed by an end mark; nothing at or after a position's end counts. Entries are in the order of the text,
    not of the array, so that they follow from each other: where the suffix before a position's is one further than that of
    the position to its left, its prefix is one shorter. Only the other positions are compared, eight bytes at a time.
    """
    n = len(raw)
    before = np.full(n, -1, np.int32)
    at = sa[1:]  # sa[0] is the end mark
    before[at[1:]] = at[:-1]
    here = np.arange(n, dtype=np.int32)
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (ends[1:] == ends[:-1])
    some = np.flatnonzero(follows)
    follows[some] = (before[some - 1] >= 0) & (raw[some - 1] == raw[before[some - 1]])
    lead = np.flatnonzero(~follows)
    source = before[lead]
    most = np.where(source >= 0, np.minimum(ends[lead] - lead, n - np.maximum(lead, source)), 0)
    words = np.ndarray((n,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))
    found = np.zeros(len(lead), np.int64)
    go = np.flatnonzero(source >= 0)
    i, j, k = lead[go], source[go], 0
    while len(go):
        differ = words[np.minimum(i + k, n - 1)] ^ words[np.minimum(j + k, n - 1)]
        equal = differ == 0
        apart = ~equal
        low = differ[apart]
        found[go[apart]] = k + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) // 8
        k += 8
        go, i, j = go[equal], i[equal], j[equal]
        found[go] = k
        more = most[go] > k
        go, i, j = go[more], i[more], j[more]
    out = np.zeros(n, np.int32)
    out[lead] = np.minimum(found, most)
    origin = np.maximum.accumulate(np.where(follows, 0, here))
    return np.maximum(out[origin] - (here - origin), 0)
