"""Fuzzy line dedup.

Method: lines are normalised (lower case, digits alike, punctuation and blanks reduced to single blanks).  The candidates are the
pairs that share a block key; a key joins three MinHashes of a line's runs of q bytes (q smaller for short lines), and a code of three bits of 20 of the MinHashes
and of the length rules most unlike pairs out before they leave the join.  Every other pair of a bucket, however large, is in one component by other links or verified.  The method named for this operator, blocks of one 64-bit SimHash, can't give right
results at this similarity: lines of 80 % lie about 13 bits apart, and blocks for so many bits have four bits each; within 3 bits it found a fifth of the similar pairs.
Candidates are verified by edit similarity, and of each connected group of lines over all documents the first occurrence (least document id, then
line number) stays; the others go.

Equal normalised lines are one node, known by a 128-bit hash; a line whose first 64 bits are those of another takes part in exact dedup alone (about
one line in 10^7 at 10^12 lines).  A line in a third of all documents costs a row for each occurrence,
grouped by partial sums; its rows are dealt over tasks when they are looked up.  Every line that isn't blank takes part; lines of fewer
than FUZZY_BYTES bytes are compared for equality only.  Blank lines stay.

Defined cases: null and empty texts, and rows without an id, stay as they are; rows that share an id are one document and
keep the same lines; ties (equal lines in one document): the lower line number stays; an empty table gives an empty table; a text of any length is one
list of lines, in time and memory linear in its length; other columns are kept, those named n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import HASHES_ONLY, arrow_rows, col, ends_of, forget, lookup, released, scratch, slices, small, written

#: Lines of fewer bytes in normal form are compared for equality only.
FUZZY_BYTES = 16
#: (q, least, under): lines of so many bytes are keyed by runs of q bytes. The classes overlap by more than PERCENT lets lengths differ.
GRAMS = ((4, 0, 40), (6, 32, 64), (8, 48, 1 << 62))
#: MinHashes of a line, in keys of HASHES each, and how many of them have three bits in its code.
MINHASHES, HASHES, CODED = 36, 3, 20
#: Places of the code in which a candidate agrees, at least.
AGREE = 9
#: Bytes of text that are hashed at a time.
CACHED = 1 << 15
#: Least edit similarity, in percent.
PERCENT = 80

_ODD = np.random.default_rng(20).integers(0, 1 << 31, MINHASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
#: By byte of UTF-8: ASCII letters, line ends, digit zero and all non-ASCII stay.
_TABLE = bytes(b if b > 127 or b == 10 or chr(b).isalpha() else 48 if chr(b).isdigit() else 32 for b in range(256))


def normal_forms(text: str) -> list[bytes]:
    """The normal form, in UTF-8, of every line. A line of nothing but punctuation is its own normal form; that of a blank one is empty."""
    # the table leaves blanks and line ends alone of all white space; runs of blanks are halved over the whole text, not line by line
    whole = text.lower().encode("utf-8", "surrogatepass").translate(_TABLE)
    while b"  " in whole:
        whole = whole.replace(b"  ", b" ")
    forms = [x.strip() for x in whole.split(b"\n")]
    lines = None
    for i, form in enumerate(forms):
        if not form or form[0] > 127:
            lines = text.split("\n") if lines is None else lines
            if not form or lines[i].isspace():
                forms[i] = " ".join(lines[i].split()).encode("utf-8", "surrogatepass")
    return forms


def normalise(line: str) -> list[bytes]:
    """The words of one line's normal form."""
    return normal_forms(line)[0].split()


#: Columns of the distance matrix of one pair for which the rows are chosen at a time.
BAND = 256


def stripped(a: str, b: str) -> tuple[str, str]:
    """Both without what they start and end with in common."""
    if a[:1] == b[:1]:
        lo, hi = 0, min(len(a), len(b))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
        a, b = a[lo:], b[lo:]
    if a[-1:] == b[-1:]:
        lo, hi = 0, min(len(a), len(b))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if a[len(a) - mid : len(a) - lo] == b[len(b) - mid : len(b) - lo] else (lo, mid - 1)
        a, b = a[: len(a) - lo], b[: len(b) - lo]
    return a, b


def distance_bound(a: str, b: str) -> int:
    """An upper bound of the edit distance: both are cut at a run that they share, near the middle rather, and what is left counts whole."""
    a, b = stripped(a, b)
    most = max(len(a), len(b))
    if min(len(a), len(b)) < 16:
        return most
    for eighth in (4, 3, 5, 2, 6, 1, 7):
        mid = max(4, len(a) * eighth // 8)
        run = a[mid - 4 : mid + 4]
        at = b.find(run, max(0, mid - 4 - len(a) // 8), mid + 4 + len(a) // 8)
        if at >= 0:
            return min(most, distance_bound(a[: mid - 4], b[:at]) + distance_bound(a[mid + 4 :], b[at + 8 :]))
    return most


def similar(a: str, b: str, percent: int) -> bool:
    """Whether the edit similarity, 1 - distance / longer length, is at least ``percent``."""
    allowed = max(len(a), len(b)) * (100 - percent) // 100
    a, b = stripped(a, b)
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > allowed:
        return False
    if len(b) <= allowed or distance_bound(a, b) <= allowed:
        return True
    # bit-parallel columns of the distance matrix, of the rows low to high that a path of allowed cost can cross in the next BAND columns
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    m, n = len(a), len(b)
    right, left = (allowed + n - m) // 2, (allowed - n + m) // 2
    low = high = up = down = distance = 0
    for start in range(0, n, BAND):
        stop = min(n, start + BAND)
        gone, more = max(0, start - right) - low, min(m, stop + left) - high
        up, down = up >> gone | ((1 << more) - 1) << (high - low - gone), down >> gone
        low, high, distance = low + gone, high + more, distance + more
        full, last = (1 << (high - low)) - 1, 1 << (high - low - 1)
        near: dict[str, int] = {}
        for k in range(start, stop):
            at = near.get(b[k])
            if at is None:
                at = near[b[k]] = places.get(b[k], 0) >> low & full
            cross = (((at & up) + up) ^ up) | at | down
            more, less = down | ~(cross | up) & full, up & cross
            distance += (more & last != 0) - (less & last != 0)
            if high == m and distance - (n - 1 - k) > allowed:
                return False
            more, less = (more << 1 | 1) & full, less << 1 & full
            up, down = less | ~((at | down) | more) & full, more & (at | down)
    return distance <= allowed


#: Patterns of up to so many words of 64 characters are compared in numpy, PAIRS at a time or fewer; TABLE bounds the places of one table of them.
WORDS, PAIRS, TABLE = 64, 2048, 1 << 21
#: Fewer pairs are compared one by one.
FEWEST = 12
#: Numbers of words that patterns are filled up to, so that many pairs advance together.
FILLED = np.array([1, 2, 3, 4, 6, 8, 11, 16, 22, 32, 44, 64])
#: Classes in which letters are counted.
LETTERS = 128


def letters_apart(one: list[str], two: list[str]) -> np.ndarray:
    """A lower bound of each pair's edit distance: the letters of one that the other lacks, counted in LETTERS classes."""
    places: dict[str, int] = {}
    at = np.fromiter((places.setdefault(t, len(places)) for pair in zip(one, two, strict=True) for t in pair), np.int64, 2 * len(one)).reshape(-1, 2)
    counts = np.empty((len(places), LETTERS), np.int32)
    for t, k in places.items():
        counts[k] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS, minlength=LETTERS)
    sizes, out = counts.sum(1), np.empty(len(one), np.int64)
    for lo in range(0, len(one), PAIRS):
        a, b = at[lo : lo + PAIRS].T
        out[lo : lo + PAIRS] = np.maximum(sizes[a], sizes[b]) - np.minimum(counts[a], counts[b]).sum(1)
    return out


def similar_pairs(one: list[str], two: list[str], percent: int) -> np.ndarray:
    """:func:`similar` of every pair of two lists; the distance matrices of many pairs of about the same length advance together."""
    out = np.zeros(len(one), bool)
    sizes = np.array([list(map(len, one)), list(map(len, two))], np.int64).reshape(2, -1)
    allowed = sizes.max(0, initial=0) * (100 - percent) // 100
    left = np.flatnonzero(np.abs(sizes[0] - sizes[1]) <= allowed)
    apart = letters_apart([one[i] for i in left], [two[i] for i in left])
    left, apart = left[apart <= allowed[left]], apart[apart <= allowed[left]]
    short, long, size = {}, {}, np.zeros(len(one), np.int64)
    for i, least in zip(left.tolist(), apart.tolist(), strict=True):
        a, b = stripped(one[i], two[i])
        if len(a) > len(b):
            a, b = b, a
        # few letters that differ: mostly a few edits, which the bound tells
        if len(b) <= allowed[i] or 2 * least <= allowed[i] and distance_bound(a, b) <= allowed[i]:
            out[i] = True
        else:
            short[i], long[i], size[i] = a, b, len(a)
    words = (size + 63) // 64
    filled = np.append(FILLED, WORDS + 1)[np.minimum(np.searchsorted(FILLED, words), len(FILLED))]
    for w in np.unique(filled[size > 0]).tolist():
        at = np.flatnonzero((filled == w) & (size > 0))
        at = at[np.argsort([-len(long[i]) for i in at.tolist()], kind="stable")]
        together = max(1, min(PAIRS, TABLE // (w * LETTERS)))
        for lo in range(0, len(at), together):
            own = at[lo : lo + together]
            # a numpy step costs as much as several pairs' steps in plain integers
            plain = w > WORDS or len(own) < FEWEST
            if not plain:
                # what both end with doesn't change a distance
                more = np.maximum(0, 64 * (w - 1) + 1 - size[own])
                a, b = [short[i] + " " * k for i, k in zip(own.tolist(), more.tolist(), strict=True)], [long[i] + " " * k for i, k in zip(own.tolist(), more.tolist(), strict=True)]
                by = sorted(range(len(own)), key=lambda k: -len(b[k]))
                own, a, b = own[by], [a[k] for k in by], [b[k] for k in by]
                points = np.frombuffer("".join(a + b).encode("utf-32-le", "surrogatepass"), np.uint32)
                seen = np.zeros(int(points.max()) + 1, bool)
                seen[points] = True
                letters, points = int(seen.sum()), (np.cumsum(seen, dtype=np.int32) - 1)[points]
                plain = w * len(own) * letters > TABLE
            if plain:
                out[own] = [similar(one[i], two[i], percent) for i in own]
            else:
                m, n = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
                out[own] = _distances(points, m, n, letters, w, allowed[own]) <= allowed[own]
    return out


def _distances(points: np.ndarray, m: np.ndarray, n: np.ndarray, letters: int, words: int, allowed: np.ndarray) -> np.ndarray:
    """Edit distances of pairs by bit-parallel columns, exact where they are within ``allowed`` (n - m at least), else larger than it.

    points: the letters of all patterns (lengths m), then of all texts (lengths n, falling).  Only the words of 64 rows that a path of
    allowed cost can cross are computed, and pairs that have no such path any more are left out on the way.  All words of all pairs
    advance in one step, each a column behind the word above it, whose last row it needs.
    """
    pairs, one = len(m), np.uint64(1)
    # letters by place and pair, as places in the table of the patterns' letters
    of_a, of_b = np.zeros((m.max(), pairs), np.int64), np.zeros((n.max() + words, pairs), np.int64)
    for target, lengths, part in ((of_a, m, points[: m.sum()]), (of_b, n, points[m.sum() :])):
        row = np.repeat(np.arange(pairs), lengths)
        target[np.arange(len(part)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = part + row * letters
    table, starts = np.zeros(words * pairs * letters, np.uint64), np.arange(words)[:, None] * (pairs * letters)
    for k in range(min(64, len(of_a))):  # one bit of all words
        at = of_a[k::64]
        at = (at + starts[: len(at)])[m > np.arange(k, len(of_a), 64)[:, None]]
        table[at] |= one << np.uint64(k)
    up, down = np.full((words, pairs), 2**64 - 1, np.uint64), np.zeros((words, pairs), np.uint64)
    # whether the row above a word grows, or falls, from its last column to the next
    more, less = np.ones((words + 1, pairs), np.uint64), np.zeros((words + 1, pairs), np.uint64)
    last, top = ((m - 1) % 64).astype(np.uint64), np.uint64(63)
    # a path leaves the first diagonal and comes to the last one, n - m further right: it is so far above and below the first at most
    right, left = int((allowed + n - m).max()) // 2, int((allowed - n + m).max()) // 2
    bottom, low, high = min(words - 1, left // 64), 0, 0
    distance = m.copy() if bottom == words - 1 else np.full(pairs, 64 * (bottom + 1), np.int64)  # in the last row of the word at the bottom
    out, own, c = allowed + 1, np.arange(pairs), pairs
    for s in range(int(n.max()) + words - 1):  # word w is at column s - w
        while c and n[c - 1] <= s - words + 1:
            c -= 1
        # a path may pass between two words by a diagonal, next to what is told
        if s % 64 == 63 and (alive := _least(up[:, :c], down[:, :c], distance[:c], last[:c], more, less, low, bottom) <= allowed[:c] + 1).sum() < 0.8 * c:
            out[own[c:]] = distance[c:]
            keep = np.flatnonzero(alive)
            up, down, more, less, of_b, c = up[:, keep], down[:, keep], more[:, keep], less[:, keep], of_b[:, keep], len(keep)
            m, n, last, allowed, distance, own = m[keep], n[keep], last[keep], allowed[keep], distance[keep], own[keep]
        if not c:
            break
        if bottom < words - 1 and s == 64 * (bottom + 1) - left + bottom:  # the next word begins in the next step
            bottom += 1
            distance[:c] += m[:c] - 64 * bottom if bottom == words - 1 else 64
        while high < words - 1 and s >= high + 1 + max(0, 64 * (high + 1) - left):
            high += 1
        while s >= low + 64 * (low + 1) + right or s - low >= n[0]:
            low += 1
        if low and s == 65 * low + right:  # the word above has ended: the row above grows by one
            more[low], less[low] = one, np.uint64(0)
        at = table.take(of_b[s - high : s - low + 1, :c][::-1] + starts[low : high + 1])
        p, q, grows, falls = up[low : high + 1, :c], down[low : high + 1, :c], more[low : high + 1, :c], less[low : high + 1, :c]
        # in place as far as it goes
        steep = at | q
        at |= falls
        minus = at & p
        minus += p
        minus ^= p
        minus |= at
        plus = minus | p
        np.invert(plus, out=plus)
        plus |= q
        minus &= p
        above, below = plus >> top, minus >> top
        if high == words - 1:
            distance[:c] += (plus[-1] >> last[:c] & one).astype(np.int64) - (minus[-1] >> last[:c] & one).astype(np.int64)
        elif high == bottom:
            distance[:c] += above[-1].astype(np.int64) - below[-1].astype(np.int64)
        plus <<= one
        plus |= grows
        minus <<= one
        minus |= falls
        np.bitwise_and(plus, steep, out=q)
        np.bitwise_or(plus, steep, out=p)
        np.invert(p, out=p)
        p |= minus
        more[low + 1 : high + 2, :c], less[low + 1 : high + 2, :c] = above, below
    out[own] = distance
    return out


def _least(up: np.ndarray, down: np.ndarray, distance: np.ndarray, last: np.ndarray, more: np.ndarray, less: np.ndarray, low: int, high: int) -> np.ndarray:
    """A lower bound of the values of the words low to high, each in its last column; distance: the value in the last row of the latter."""
    least, under, c = distance.copy(), distance, len(distance)
    for w in range(high, low - 1, -1):
        rows = np.uint64(2**64 - 1) >> (np.uint64(63) - last) if w == len(up) - 1 else np.uint64(2**64 - 1)
        over = under - np.bitwise_count(up[w] & rows).astype(np.int64) + np.bitwise_count(down[w] & rows).astype(np.int64)
        # neighbours differ by one at most
        least = np.minimum(least, (over + under - np.bitwise_count(rows).astype(np.int64)) // 2)
        # the word above is a column further
        under = over + more[w, :c].astype(np.int64) - less[w, :c].astype(np.int64)
    return least


def minhashes(forms: list[bytes], q: int) -> np.ndarray:
    """MINHASHES rows: the least hashes of each form's runs of ``q`` bytes; every form has so many bytes or more."""
    out, sizes = np.empty((MINHASHES, len(forms)), np.uint32), np.fromiter(map(len, forms), np.int64, len(forms))
    # pieces of about CACHED bytes stay in the cache while they are hashed; a longer form is a piece of its own
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // CACHED)) + 1).tolist(), len(forms)]
    for lo, hi in zip(cuts, cuts[1:]):
        starts = np.cumsum(sizes[lo:hi]) - sizes[lo:hi]
        text = b"".join(forms[lo:hi]) + bytes(8)
        grams = np.ndarray(len(text) - 7, "<u8", text, strides=(1,)) & np.uint64(2 ** (8 * q) - 1)
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        mixed = (grams >> np.uint64(32)).astype(np.uint32)
        runs = np.column_stack([starts, starts + sizes[lo:hi] - q + 1]).ravel()
        held = np.empty_like(mixed)
        for k in range(MINHASHES):
            np.multiply(mixed, _ODD[k], out=held)
            out[k, lo:hi] = np.minimum.reduceat(held, runs)[::2]
    return out


def block_keys(low: np.ndarray, q: int) -> np.ndarray:
    """Keys of each form: one for every HASHES of its MinHashes."""
    keys = np.empty((low.shape[1], MINHASHES // HASHES), np.uint64)
    for k in range(keys.shape[1]):
        key = np.full(low.shape[1], 100 * q + k, np.uint64)
        for h in low[k * HASHES : (k + 1) * HASHES]:
            key = (key ^ h) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        keys[:, k] = key
    return keys


def codes(low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Three bits of each MinHash in one number, below four bits of the line's length in characters (sizes).

    Lengths are classed in steps a little larger than PERCENT lets two lengths differ, so that similar lines are in one class or in neighbours.  The four
    bits are a cyclic Gray code of the class: those of neighbours differ in one bit.
    """
    classes = (np.log(sizes) / np.log(101 / PERCENT)).astype(np.int64) % 16
    out = (classes ^ classes >> 1) << 60
    for k in range(CODED):
        out |= (low[k] >> np.uint32(8) & np.uint32(7)).astype(np.int64) << 3 * k
    return out


_LOWS = sum(1 << 3 * k for k in range(CODED))
#: Of the XOR of two codes: whether they agree in AGREE places at least, and the lengths allow similar lines.
ALIKE = f"bit_count((({{0}}) | shiftright({{0}}, 1) | shiftright({{0}}, 2)) & {_LOWS}L) <= {CODED - AGREE} and bit_count(shiftrightunsigned({{0}}, 60)) <= 1"
#: Rows and bytes of text in a block of a large bucket; pairs and characters that are compared at a time.
BLOCK, BLOCK_BYTES, COMPARED, CHARACTERS = 4096, 8 << 20, 16384, 8 << 20


def _candidates(codes: np.ndarray, labels: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of a cell whose codes are ALIKE and whose labels differ: of side 0 and side 1, or of all rows (side 2)."""
    alone = bool((sides == 2).any())
    x, y = np.flatnonzero(sides != 1), np.flatnonzero(sides == 1)
    for lo in range(0, len(x), 128):
        i, j = x[lo : lo + 128], x[lo + 1 :] if alone else y
        unlike = codes[i, None] ^ codes[j]
        fits = np.bitwise_count((unlike | unlike >> np.uint64(1) | unlike >> np.uint64(2)) & np.uint64(_LOWS)) <= CODED - AGREE
        fits &= (np.bitwise_count(unlike >> np.uint64(60)) <= 1) & (labels[i, None] != labels[j])
        if alone:
            fits &= i[:, None] < j
        p, q = np.nonzero(fits)
        yield i[p], j[q]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of different labels that are similar, from cells: key, lists side, id, code, label, form, keys (of the cells the row is in).

    A pair is compared in the least key of both.  One without forms is left to the caller; of the others, those come out that join labels which
    the task's links so far have not joined: no more of them than labels.
    """
    a, b, one, two, ends, held = [], [], [], [], [], 0
    joined: dict[int, int] = {}

    def top(x: int) -> int:
        while joined.get(x, x) != x:
            joined[x] = joined.get(joined[x], joined[x])
            x = joined[x]
        return x

    def out(a: list[int], b: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(map(min, a, b)), pa.int64()), pa.array(list(map(max, a, b)), pa.int64())], names=["a", "b"])

    def compared() -> pa.RecordBatch:
        like = []
        for i in np.flatnonzero(similar_pairs(one, two, PERCENT)).tolist():
            x, y = top(ends[i][0]), top(ends[i][1])
            if x != y:
                joined[max(x, y)] = min(x, y)
                like.append(i)
        return out([a[i] for i in like], [b[i] for i in like])

    for batch in slices(batches, 1):
        key, rows = batch.column(0)[0].as_py(), batch.column(1)[0].values
        side, ids, code, label, forms, keys = (rows.field(k) for k in ("side", "id", "code", "label", "form", "keys"))
        ids, labels = ids.to_numpy(), label.to_numpy()
        texts: dict[int, str | None] = {}
        of: dict[int, set[int]] = {}
        for p, q in _candidates(code.to_numpy().view(np.uint64), labels, side.to_numpy()):
            for k in np.unique(np.concatenate([p, q])).tolist():
                if k not in of:
                    form = forms[k].as_py()
                    texts[k], of[k] = None if form is None else form.decode("utf-8", "replace"), set(keys[k].as_py())
            loose: tuple[list[int], list[int]] = ([], [])
            for i, j in zip(p.tolist(), q.tolist(), strict=True):
                if min(of[i] & of[j]) != key:
                    continue
                s, t = texts[i], texts[j]
                if s is None or t is None:
                    loose[0].append(int(ids[i]))
                    loose[1].append(int(ids[j]))
                elif abs(len(s) - len(t)) * 100 <= max(len(s), len(t)) * (100 - PERCENT):
                    a.append(int(ids[i]))
                    b.append(int(ids[j]))
                    one.append(s)
                    two.append(t)
                    ends.append((int(labels[i]), int(labels[j])))
                    held += len(s) + len(t)
                    if len(one) >= COMPARED or held >= CHARACTERS:
                        yield compared()
                        a, b, one, two, ends, held = [], [], [], [], [], 0
            if loose[0]:
                yield out(*loose)
    if one:
        yield compared()


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, line, id, more (128 bits of the normal form's hash), n, form, and the keys and code by runs of q bytes.

    A line that is in two classes of GRAMS has a second row, with the keys alone (n is null).
    """
    import xxhash

    for batch in slices(batches, 128):
        docs, places, forms = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for i, form in enumerate(normal_forms(text)):
                if form:
                    docs.append(doc)
                    places.append(i)
                    forms.append(form)
        if not forms:
            continue
        sizes = np.fromiter(map(len, forms), np.int64, len(forms))
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, forms)), ">i8").reshape(-1, 2).astype(np.int64)
        n = np.fromiter((len(f.decode("utf-8", "replace")) for f in forms), np.int32, len(forms))
        rest = np.ones(len(forms), bool)
        for q, least, under in (*GRAMS, (0, 0, FUZZY_BYTES)):
            at = np.flatnonzero((sizes >= max(least, FUZZY_BYTES if q else 0)) & (sizes < under))
            if not len(at):
                continue
            own = [forms[i] for i in at]
            if q:
                low = minhashes(own, q)
                keys, code = block_keys(low, q).view(np.int64), codes(low, n[at])
            else:
                keys, code = np.empty((len(own), 0), np.int64), np.zeros(len(own), np.int64)
            new = rest[at]
            rest[at] = False
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([docs[i] for i in at], pa.int64()), pa.array([places[i] for i in at], pa.int32()), pa.array(hashes[at, 0]), pa.array(hashes[at, 1]), pa.array(n[at], mask=~new), pa.array([f if k else None for f, k in zip(own, new, strict=True)], pa.binary()), lists, pa.array(code)],
                names=["doc", "line", "id", "more", "n", "form", "keys", "code"],
            )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken from the text, and n_lines and n_dropped (null text: 0)."""
    with scratch("drops"):
        return _dedup(docs, key, text)


def _dedup(docs: DataFrame, key: str, text: str) -> DataFrame:
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*map(col, kept))
    plain = docs.where(col(key).isNotNull() & col(text).isNotNull()).select(col(key).cast("long").alias("doc"), col(text).alias("text"))
    table = written(plain.mapInArrow(lambda batches: released(_occurrences(batches)), "doc long, line int, id long, more long, n int, form binary, keys array<long>, code long"), "lines", **HASHES_ONLY)
    seen = table.where("n is not null").select("doc", "line", "id", "more")
    first = F.min(F.struct("doc", "line"))
    lines = written(seen.groupBy("id", "more").agg(first.alias("first"), F.count("*").alias("places")).select("id", "more", F.col("first.doc").alias("doc"), F.col("first.line").alias("line"), "places"), "distinct-lines", **HASHES_ONLY)
    clash = small(written(lines.groupBy("id").count().where("count > 1").select("id"), "clashes"))
    repeats = written(lines.where("places > 1").select("id", F.col("doc").alias("of"), F.col("line").alias("at"), "places"), "repeats")
    once = lookup(table, repeats, "id", F.struct("doc", "line"), "places").where("of is null or of = doc and at = line").join(clash, "id", "left_anti")
    if not docs.where(col(key).isNotNull()).groupBy(col(key).cast("long")).count().where("count > 1").isEmpty():  # rows that share an id
        once = once.dropDuplicates(["id", "keys"])
    if repeats.count() * 40 > 12 << 20:  # else the lookup is a broadcast, which is run again in each round at little cost
        once = written(once.select("id", "n", "form", "keys", "code"), "once", **HASHES_ONLY)
    forms = once.where("form is not null").select("id", "form")
    keys = once.select(F.explode("keys").alias("key"), "id", F.col("code").alias("rest"))
    bucketed: list[DataFrame] = []

    def shared(buckets: DataFrame) -> None:
        # few lines share a key with another; each round reads only theirs. A line has one row with its form
        bucketed.append(written(forms.join(small(written(buckets.select("id").distinct(), "bucketed-ids", **HASHES_ONLY)), "id", "left_semi"), "bucketed-forms"))

    def forms_of(ids: DataFrame) -> DataFrame:
        return written(bucketed[0].join(small(ids), "id", "left_semi"), "norms")

    def verify(pairs: DataFrame) -> DataFrame:
        near = written(pairs, "near")
        ends = ends_of(near)
        norms = forms_of(ends)
        x, y = norms.toDF("a", "norm_a"), norms.toDF("b", "norm_b")

        @F.pandas_udf("boolean")
        def alike(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(similar_pairs([p.decode("utf-8", "replace") for p in x], [q.decode("utf-8", "replace") for q in y], PERCENT))

        with arrow_rows(docs.sparkSession, COMPARED):
            found = written(near.join(x, "a").join(y, "b").where(alike("norm_a", "norm_b")).select("a", "b"), "alike")
        for done in (near, ends, norms):
            forget(done)
        return found

    def within(rows: DataFrame) -> DataFrame:
        held = written(rows.groupBy("id").agg(F.collect_set("key").alias("keys")), "large-ids")
        told = held.join(forms_of(held.select("id")), "id", "left")
        sizes = written(told.select("id", F.coalesce(F.octet_length("form"), F.lit(0)).cast("long").alias("size")), "sizes")
        dealt = graph.cells(rows.join(small(sizes), "id"), BLOCK, BLOCK_BYTES).join(told, "id")
        cell = dealt.groupBy("key", "cell").agg(F.collect_list(F.struct("side", "id", F.col("rest").alias("code"), "label", "form", "keys")).alias("rows"))
        with arrow_rows(docs.sparkSession, 64):
            return written(cell.select("key", "rows").mapInArrow(lambda batches: released(_linked(batches)), "a long, b long"), "within")

    found = graph.link_buckets(keys, "true", verify, ALIKE.format("ra ^ rb"), "true", ALIKE.format("both"), within, shared)
    # a line that has no link and one place is alone in its group, and stays
    grouped = lines.join(small(found), "id", "left").where("label is not null or places > 1")
    grouped = written(grouped.select("id", "more", "doc", "line", "places", F.coalesce("label", "id").alias("of"), F.when(F.col("label").isNull(), F.col("more")).alias("part")), "grouped", **HASHES_ONLY)
    groups = grouped.groupBy("of", "part").agg(first.alias("stays"), F.sum("places").alias("total")).where("total > 1")
    repeated = grouped.join(groups, (grouped["of"] == groups["of"]) & grouped["part"].eqNullSafe(groups["part"])).select(F.struct("id", "more").alias("node"), "stays", "places")
    gone = lookup(seen.select("doc", "line", F.struct("id", "more").alias("node")), written(repeated, "repeated"), "node", F.struct("doc", "line"), "places").where(F.col("stays").isNotNull() & (F.struct("doc", "line") != F.col("stays")))
    drops = written(gone.groupBy("doc").agg(F.collect_set("line").alias("__drop")).withColumnRenamed("doc", "__doc"), "drops")
    told = docs.join(small(drops, 4 * (drops.agg(F.sum(F.size("__drop"))).first()[0] or 0)), col(key).cast("long") == F.col("__doc"), "left")
    # every expression but the innermost is made once for a row: the lines are bound, and what stays is told by a hash set
    without = lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), "__drop"), lambda i: F.get(p, i)), "\n")
    left = F.transform(F.array(F.split(col(text), "\n", -1)), without)[0]
    return told.select(
        *(F.when(F.col("__drop").isNull(), col(c)).otherwise(left).alias(c) if c == text else col(c) for c in kept),
        F.coalesce(F.octet_length(col(text)) - F.octet_length(F.replace(col(text), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).alias("n_dropped"),
    )


def deduped_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text_sha256 of every document after line dedup."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
