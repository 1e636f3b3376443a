"""Periodic runs of words: maximal repetitions found from Lyndon roots.

A run is a stretch of words with a smallest period q that no neighbour continues. By the
runs theorem every run contains, for one of the two orders of the alphabet, a root of
length q that is the longest Lyndon word starting at its place. So one walk finds all:

* Grouping. The first phase of Baier's suffix sorter refines suffixes into groups of equal
  context, from the greatest group down; the length of a suffix's context when its group's
  turn comes is its longest Lyndon word. Run under both orders, it yields both Lyndon
  arrays without sorting the suffixes within groups.
* Extension. Every root that repeats as often as the wished exponent demands is extended to
  both sides by longest common extensions. A root within a run that is already known is
  passed over, so each run is extended once.

Both work on the stretches that can hold a run at all: in a run of ``times`` periods and
``shortest`` words every ``k`` consecutive words occur again nearby (``gram_length`` gives the
largest such k), so words in no repeated k-gram are left out beforehand. K-grams are compared by
hash, where a collision only keeps more; all else compares words.

Each text is worked on whole inside one task; its memory is proportional to that text.

Defined results: a null or empty text, or one of white space only, has no words, no runs and an
empty collapsed text. Repeated rows and null keys give a row each; an empty table gives none.
"""

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMES = 4  # a run is reported from so many periods on
SHORTEST = 6  # and so many words
SPACE = r"[\x20\x09-\x0D]+"  # what separates words
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def gram_length(times: int, shortest: int) -> int:
    """The longest k for which every k-gram inside a run occurs again one period on or back."""
    return max(1, min(max(shortest, times * q) - 2 * q + 1 for q in range(1, shortest + 1)))


def candidate_stretches(words: list[bytes], times: int = TIMES, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """(start, end) of the stretches outside of which no run can be."""
    k = gram_length(times, shortest)
    grams = len(words) - k + 1
    if len(words) < shortest or grams < 2:
        return []
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = one[:grams].copy()
    for j in range(1, k):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed += one[j : j + grams]
    ranked = np.sort(mixed)
    repeated = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(repeated):
        return []
    place = np.minimum(np.searchsorted(repeated, mixed), len(repeated) - 1)
    again = repeated[place] == mixed
    edges = np.flatnonzero(np.diff(again, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2] + k - 1
    keep = ends - starts >= shortest
    return list(zip(starts[keep].tolist(), ends[keep].tolist()))


def lyndon_lengths(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word starting at each place (codes are 0..m, each used)."""
    n, groups = len(codes), max(codes, default=-1) + 1
    members = [[] for _ in range(groups)]
    for i, c in enumerate(codes):
        members[c].append(i)
    context = [1] * groups
    below = list(range(-1, groups - 1))  # the next lower group of each, -1 at the bottom
    above = [*range(1, groups), -1]
    group_of, found = list(codes), [0] * n
    done, smaller = [False] * n, [-1] * n  # ``smaller``: nearest place before in a lower group, once done
    group = groups - 1
    while group >= 0:
        length, own = context[group], [i for i in members[group] if group_of[i] == group]
        members[group] = []
        for i in own:
            done[i] = True
            found[i] = length
        parents, last, repeats = {}, -1, 0
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = smaller[j]
            smaller[i] = j
            if j == last:
                repeats += 1
                continue
            if last >= 0:
                parents.setdefault(group_of[last], {}).setdefault(repeats, []).append(last)
            last, repeats = j, 1
        if last >= 0:
            parents.setdefault(group_of[last], {}).setdefault(repeats, []).append(last)
        # A context followed by more copies of this one is greater: it moves further up.
        for parent, by_repeats in parents.items():
            at = parent
            for repeats in sorted(by_repeats):
                moved, new = by_repeats[repeats], len(members)
                members.append(moved)
                context.append(context[parent] + repeats * length)
                above.append(above[at])
                below.append(at)
                if above[at] >= 0:
                    below[above[at]] = new
                above[at] = at = new
                for j in moved:
                    group_of[j] = new
        group = below[group]
    return found


def common_extension(codes: np.ndarray, a: int, b: int) -> int:
    """How many codes from ``a`` on equal those from ``b`` on (a < b)."""
    same, step = 0, 32
    while b + same < len(codes):
        right = codes[b + same : b + same + step]
        unequal = np.flatnonzero(codes[a + same : a + same + len(right)] != right)
        if len(unequal):
            return same + int(unequal[0])
        same += len(right)
        step *= 2
    return same


def runs_of_codes(codes: np.ndarray, times: int, shortest: int) -> set[tuple[int, int, int]]:
    """All (start, length, period) with length >= max(shortest, times * period)."""
    back, size, found = codes[::-1], len(codes), set()
    for order in (codes, codes.max() - codes):
        root = np.array(lyndon_lengths(order.tolist()), dtype=np.int64)
        # A run of so many periods holds times - 1 whole roots one after the other.
        at = np.flatnonzero(np.arange(size) + max(times - 1, 1) * root <= size)
        for step in range(1, times - 1):
            after = at + step * root[at]
            at = at[(root[after] == root[at]) & (codes[after] == codes[at])]
        covered = {}
        for start, period in zip(at.tolist(), root[at].tolist()):
            if start + period <= covered.get(period, 0):
                continue
            right = common_extension(codes, start, start + period)
            left = common_extension(back, size - start - period, size - start)
            length = left + period + right
            if length >= max(shortest, times * period):
                found.add((start - left, length, period))
                covered[period] = start + period + right
    return found


def word_runs(words: list[bytes], times: int = TIMES, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. ``times`` is 2 or more."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    out = []
    for first, last in candidate_stretches(words, times, shortest):
        part = words[first:last]
        rank = {w: k for k, w in enumerate(sorted(set(part)))}
        codes = np.fromiter(map(rank.__getitem__, part), np.int64, len(part))
        out += [(first + start, length, period) for start, length, period in runs_of_codes(codes, times, shortest)]
    return sorted(out, key=lambda run: (run[0], run[2]))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that are in no run after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return list(itertools.compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, key="doc_id", text="text", times: int = TIMES, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): every run of each text and the text without the repeats."""
    known = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = known.schema["doc_id"].dataType.simpleString()

    def run(batches):
        fields = ["start", "length", "period"]
        for batch in batches:
            many, ends, flat, kept = [], [0], defaultdict(list), []
            for value in batch.column("text"):
                words = (value.as_py() or "").encode().split()
                found = word_runs(words, times, shortest)
                many.append(len(words))
                kept.append(b" ".join(collapse(words, found)).decode())
                for place, field in enumerate(fields):
                    flat[field] += [r[place] for r in found]
                ends.append(ends[-1] + len(found))
            entries = pa.StructArray.from_arrays([pa.array(flat[f], pa.int64()) for f in fields], names=fields)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(many, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries),
                    pa.array(kept, pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return known.mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")
