"""Phrase collocations by weighted acyclic automata.

Counts of all phrases of one to four words are kept in acyclic automata whose arcs are words and whose arcs' weights are counts
(of the phrase that ends there).  They are made and used in four steps:

* Each task sorts the n-grams of a run of texts and builds the run's automaton from them, layer by layer: equal beginnings are one path; from
  the back, states with a single way on that agree in word, count and next state are one state.
* The automata are cut at the borders of prefix ranges (ranges of whole phrases, so that no frequent first word makes a large range; the borders come from a bounded sample and
  only balance the work).  A phrase is counted in the range that its own words fall into.
* The automata of a range are united, and equal phrases' counts are summed; paths under ``least`` are cut from the front, as no phrase
  is more frequent than its beginning.
* For the cuts of a candidate the counts of its parts are asked for: the parts that fall into a range are an automaton themselves, which
  is composed with that range's.  With a part the count of the candidate is told, so that every phrase learns there how frequent the most frequent longer phrase around it is
  (only phrases one word longer need telling: their own extensions are no more frequent).

The driver sees the borders only.  Texts' counts are shuffled as automata; the first phrases of each language are found by numbering ranges of the sorted candidates.

Defined cases: a null language is ``und``; null and empty texts have no words; texts of any length are taken whole (long ones are counted in runs that end where pieces end);
repeated rows count each; ties by count, then phrase; all scores are exact integers of any size; an empty table has no phrases; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import arrow_rows, col, released, scratch, slices, written

#: Words of a phrase at most; times that a candidate occurs; phrases reported for each language; percent of its occurrences within one longer phrase that drop a candidate.
ORDER, LEAST, TOP, WITHIN = 4, 30, 2000, 80
SCALE = 2_000_000
#: Bytes of text in a run, and whose phrases make up a prefix range on average.
RUN_BYTES, RANGE_BYTES = 12 << 20, 4 << 20
#: The sample that borders are taken from: documents, phrases of each, bytes of a word.
SAMPLE_DOCS, SAMPLE_EACH, SAMPLE_WORD = 8192, 8, 32
SEPARATORS, BLANKS = b".,;:!?\n\v\f\r", b" \t"

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(BLANKS)] = 1
_CLASS[list(SEPARATORS)] = 2

Phrase = tuple[bytes, ...]
Border = tuple[bytes, ...]  # language and ORDER words, the missing ones empty


def words_of(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """Words of a text and the number of the piece that each is in."""
    flat = np.frombuffer(data.lower(), np.uint8)  # of bytes only A-Z are lowered
    kind = _CLASS[flat]
    word = kind == 0
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat[word])]), piece


def sorted_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in byte order, and the place (from 1) of each given one."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(order), place[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int64)


@dataclass
class Layers:
    """An automaton unfolded: for each length of phrases the last words (places from 1 in ``words``), weights and the beginnings' places in the layer before, sorted."""

    words: pa.Array
    label: list[np.ndarray]
    weight: list[np.ndarray]
    parent: list[np.ndarray]

    def phrases(self) -> Iterator[tuple[Phrase, int]]:
        """All phrases and their weights."""
        words, before = self.words.to_pylist(), [()]
        for label, weight, parent in zip(self.label, self.weight, self.parent, strict=True):
            here = [(*before[p], words[x - 1]) for x, p in zip(label.tolist(), parent.tolist(), strict=True)]
            yield from zip(here, weight.tolist(), strict=True)
            before = here

    def spans(self, low: list[int], high: list[int]) -> Layers:
        """The phrases between two borders, and the beginnings that they need, without weight."""
        words, label, weight, parent = None, [], [], []
        first = list(low)
        for d in range(ORDER - 1, 0, -1):
            if first[d] < high[d]:
                first[d - 1] = min(first[d - 1], int(self.parent[d][first[d]]))
        for d in range(ORDER):
            at = slice(first[d], high[d])
            own = self.weight[d][at].copy()
            own[: low[d] - first[d]] = 0
            label.append(self.label[d][at])
            weight.append(own)
            parent.append(self.parent[d][at] - first[d - 1] if d else self.parent[d][at])
        used = np.unique(np.concatenate(label))
        words = self.words.take(pa.array(used - 1))
        return Layers(words, [np.searchsorted(used, x) + 1 for x in label], weight, parent)


def layers_of_text(data: bytes) -> tuple[Layers, list[np.ndarray], list[np.ndarray]]:
    """All phrases of a text with their counts; for each layer where its phrases begin among the sorted n-grams; the n-grams' words."""
    words, piece = words_of(data)
    vocabulary, ids = sorted_words(words)
    wide = len(vocabulary) + 1
    following = [ids]
    for k in range(1, ORDER):
        x = np.zeros(len(ids), np.int64)
        if len(ids) > k:
            x[:-k] = np.where(piece[k:] == piece[:-k], ids[k:], 0)
        following.append(x)
    order = np.lexsort((following[2] * wide + following[3], following[0] * wide + following[1]))
    following = [x[order] for x in following]
    changed, label, weight, parent, begins = np.zeros(len(ids), bool), [], [], [], []
    if len(ids):
        changed[0] = True
    for d, x in enumerate(following):
        changed[1:] |= x[1:] != x[:-1]
        first = np.flatnonzero(changed)
        often = np.diff(first, append=len(ids))
        real = x[first] > 0  # zero: the piece has ended
        first, often = first[real], often[real]
        label.append(x[first])
        weight.append(often)
        parent.append(np.searchsorted(begins[d - 1], first, "right") - 1 if d else np.zeros(len(first), np.int64))
        begins.append(first)
    return Layers(vocabulary, label, weight, parent), begins, following


def cuts(layers: Layers, begins: list[np.ndarray], following: list[np.ndarray], borders: list[Phrase]) -> list[list[int]]:
    """For each border the number of phrases of each length before it."""
    out, vocabulary = [], layers.words.to_pylist() if borders else []
    for border in borders:
        low, high, ids = 0, len(following[0]), []
        for d, word in enumerate(border):
            k = bisect_left(vocabulary, word) if word else -1
            there = not word or k < len(vocabulary) and vocabulary[k] == word
            ids.append(k + 1 if there else -1)
            column = following[d][low:high]
            left = int(np.searchsorted(column, k + 1, "left"))
            if not there:
                low += left
                break
            low, high = low + left, low + int(np.searchsorted(column, k + 1, "right"))
        row = []
        for d in range(ORDER):
            n = int(np.searchsorted(begins[d], low, "left"))
            # the border's own beginning lies before the border, though the n-grams that begin so may not
            if d + 1 < ORDER and border[d + 1] and n < len(begins[d]) and len(ids) > d and all(following[e][begins[d][n]] == ids[e] for e in range(d + 1)):
                n += 1
            row.append(n)
        out.append(row)
    return out


def _flat(words: pa.Array) -> tuple[np.ndarray, bytes]:
    """Where words begin and end, and their letters."""
    if not len(words):
        return np.zeros(1, np.int32), b""
    _, ends, letters = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1]
    return ends - ends[0], letters[int(ends[0]) : int(ends[-1])].to_pybytes() if letters else b""


def pack(layers: Layers) -> bytes:
    """The automaton in bytes, its states with a single way on shared."""
    arrays, state = [], np.zeros(len(layers.label[-1]), np.int64)
    for d in range(ORDER - 1, -1, -1):
        label, weight = layers.label[d], layers.weight[d]
        if not d:
            arrays.append((label, weight, state, np.array([len(label)])))
            break
        count = np.bincount(layers.parent[d], minlength=len(layers.label[d - 1]))
        start = np.cumsum(count) - count
        several, single = np.flatnonzero(count > 1), np.flatnonzero(count == 1)
        at = start[single]
        with np.errstate(over="ignore"):
            mixed = label[at] * np.int64(0x9E3779B97F4A7C1) + weight[at] * np.int64(0x1B873593CC9E2D51) + state[at] * np.int64(0x2545F4914F6CDD1D)
        _, first, same = np.unique(mixed, return_index=True, return_inverse=True)
        alike = at[first][same]
        if not all((x[at] == x[alike]).all() for x in (label, weight, state)):  # a clash of mixed keys: nothing is shared
            first, same = np.arange(len(at)), np.arange(len(at))
        arcs = np.concatenate([np.flatnonzero((count > 1)[layers.parent[d]]), at[first]])
        arrays.append((label[arcs], weight[arcs], state[arcs], np.concatenate([count[several], np.ones(len(first), np.int64)])))
        state = np.zeros(len(count), np.int64)
        state[several] = np.arange(1, len(several) + 1)
        state[single] = len(several) + 1 + same
    parts, sizes, kinds = [], [], b""
    for arcs in arrays[::-1]:
        sizes += [len(arcs[0]), len(arcs[3])]
        for x in arcs:
            small = np.min_scalar_type(int(x.max())) if len(x) else np.dtype("u1")
            kinds += small.str[1:].encode()
            parts.append(x.astype(small).tobytes())
    ends, letters = _flat(layers.words)
    raw = b"".join([struct.pack("<10q", *sizes, len(ends), len(letters)), kinds, ends.tobytes(), letters, *parts])
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


@dataclass
class Automaton:
    """Arcs of each length, ordered by the state they leave, and for each state (from 1) its first arc and number of arcs."""

    words: pa.Array
    label: list[np.ndarray]
    weight: list[np.ndarray]
    state: list[np.ndarray]
    count: list[np.ndarray]

    def below(self, d: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arcs that leave each of the states: which of them, and the arcs."""
        count = self.count[d][state]
        start = (np.cumsum(self.count[d]) - self.count[d])[state]
        which = np.repeat(np.arange(len(state)), count)
        return which, np.repeat(start - (np.cumsum(count) - count), count) + np.arange(len(which))


def unpack(blobs: list[bytes]) -> Automaton:
    """Several automata side by side as one, over the words of all; its first arcs are those of each."""
    words, columns, shift = [], [[[] for _ in range(ORDER)] for _ in range(4)], [0] * (ORDER + 1)
    for blob in blobs:
        raw = pa.decompress(blob[8:], decompressed_size=struct.unpack("<q", blob[:8])[0], codec="zstd", asbytes=True)
        *sizes, many, length = struct.unpack("<10q", raw[:80])
        kinds = [raw[k : k + 2].decode() for k in range(80, 80 + 8 * ORDER, 2)]
        at = 80 + 8 * ORDER
        words.append(pa.Array.from_buffers(pa.binary(), many - 1, [None, pa.py_buffer(raw[at : at + 4 * many]), pa.py_buffer(raw[at + 4 * many : at + 4 * many + length])]))
        at += 4 * many + length
        for d in range(ORDER):
            n, states = sizes[2 * d : 2 * d + 2]
            for k, many in enumerate((n, n, n, states)):
                kind = np.dtype(kinds[4 * d + k])
                x = np.frombuffer(raw, kind, many, at).astype(np.int64)
                at += many * kind.itemsize
                columns[k][d].append(np.where(x > 0, x + shift[d + 1], 0) if k == 2 else x)
        for d in range(1, ORDER):
            shift[d] += sizes[2 * d + 1]
    vocabulary, ids = sorted_words(pa.concat_arrays(words))
    at = 0
    for k, part in enumerate(words):
        place = np.concatenate([[0], ids[at : at + len(part)]])
        at += len(part)
        for d in range(ORDER):
            columns[0][d][k] = place[columns[0][d][k]]
    label, weight, state, count = ([np.concatenate(x) if x else np.empty(0, np.int64) for x in c] for c in columns)
    return Automaton(vocabulary, label, weight, state, [np.concatenate([[0], c]) for c in count])


def united(blobs: list[bytes], least: int = 1) -> tuple[Layers, int]:
    """The union, equal phrases' weights summed, and the sum of all single words' weights.

    Phrases under ``least`` and what begins with them are cut.  A phrase without weight is counted elsewhere; with ``least`` 0 such phrases stay, too.
    """
    net = unpack(blobs)
    wide = len(net.words) + 1
    up, label, weight, state = np.zeros(len(net.label[0]), np.int64), net.label[0], net.weight[0], net.state[0]
    out = Layers(net.words, [], [], [])
    for d in range(ORDER):
        key, which = np.unique(up * wide + label, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, which, weight)
        keep = (total >= least) | (total == 0)
        out.label.append(key[keep] % wide)
        out.weight.append(total[keep])
        out.parent.append(key[keep] // wide)
        if d + 1 < ORDER:
            alive = np.flatnonzero(keep[which] & (state > 0))
            parent, arcs = net.below(d + 1, state[alive])
            up = (np.cumsum(keep) - 1)[which[alive]][parent]
            label, weight, state = net.label[d + 1][arcs], net.weight[d + 1][arcs], net.state[d + 1][arcs]
    return _trimmed(out) if least else out, int(net.weight[0].sum())


def _trimmed(layers: Layers) -> Layers:
    """Without the beginnings of nothing."""
    needed = None
    for d in range(ORDER - 1, -1, -1):
        keep = layers.weight[d] > 0
        if needed is not None:
            keep[needed] = True
            layers.parent[d + 1] = (np.cumsum(keep) - 1)[layers.parent[d + 1]]
        needed = np.unique(layers.parent[d][keep])
        layers.label[d], layers.weight[d], layers.parent[d] = layers.label[d][keep], layers.weight[d][keep], layers.parent[d][keep]
    return layers


def layers_of_phrases(phrases: pa.Array) -> tuple[Layers, np.ndarray, np.ndarray]:
    """The automaton, unfolded and without weights, of phrases whose words are joined by spaces; each phrase's length and its place in its layer."""
    words, own = words_of(b"\n".join(phrases.to_pylist()))
    vocabulary, ids = sorted_words(words)
    length = np.bincount(own, minlength=len(phrases))
    table = np.zeros((len(phrases), ORDER), np.int64)
    table[own, np.arange(len(own)) - (np.cumsum(length) - length)[own]] = ids
    order = np.lexsort(table.T[::-1])
    table = table[order]
    changed, out, place = np.zeros(len(order), bool), Layers(vocabulary, [], [], []), np.zeros(len(order), np.int64)
    changed[:1] = True
    before = np.zeros(len(order), np.int64)
    for d in range(ORDER):
        changed[1:] |= table[1:, d] != table[:-1, d]
        real = table[:, d] > 0
        first = changed & real
        out.label.append(table[first, d])
        out.weight.append(np.zeros(int(first.sum()), np.int64))
        out.parent.append(before[first])
        before = np.cumsum(first) - 1
        place[order[real]] = before[real]  # the last layer that has it counts
    return out, length, place


def composed(counts: Layers, asked: Layers) -> list[np.ndarray]:
    """For each phrase of ``asked`` its place in ``counts``, -1 where it isn't."""
    wide = len(counts.words) + 1
    known = pc.fill_null(pc.index_in(asked.words, value_set=counts.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    out: list[np.ndarray] = []
    for d in range(ORDER):
        keys = counts.parent[d] * wide + counts.label[d]
        up = out[d - 1][asked.parent[d]] if d else np.zeros(len(asked.label[d]), np.int64)
        label = known[asked.label[d] - 1] if len(asked.label[d]) else np.empty(0, np.int64)
        want = np.where((up >= 0) & (label > 0), up * wide + label, -1)
        at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
        out.append(np.where(keys[at] == want, at, -1) if len(keys) else np.full(len(want), -1))
    return out


def segments(data: bytes, most: int) -> Iterator[bytes]:
    """A long text in parts that end where a piece ends."""
    while len(data) > most:
        at = max(data.rfind(s, 0, most) for s in (bytes([c]) for c in SEPARATORS))
        if at < 0:
            at = min((x for x in (data.find(bytes([c]), most) for c in SEPARATORS) if x >= 0), default=-1)
        if at < 0:
            break
        yield data[:at]
        data = data[at + 1 :]
    yield data


def _padded(lang: bytes, phrase: Phrase) -> Border:
    return (lang, *phrase, *[b""] * (ORDER - len(phrase)))


def borders_of(docs: DataFrame) -> list[Border]:
    """Borders that part the phrases of ``docs`` (lang, text) into ranges of like size."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = -(-size // RANGE_BYTES)
    if ranges < 2:
        return []

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words, piece = words_of(text or b"")
                for at in np.unique(np.linspace(0, len(words) - 1, SAMPLE_EACH, dtype=np.int64)).tolist() if len(words) else []:
                    same = int((piece[at : at + ORDER] == piece[at]).sum())
                    out.append([lang.encode(), *(w[:SAMPLE_WORD] for w in words[at : at + same].to_pylist())])
            arrays = [pa.array([x[k] if len(x) > k else b"" for x in out], pa.binary()) for k in range(ORDER + 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"w{k}" for k in range(ORDER + 1)])

    names = ", ".join(f"w{k} binary" for k in range(ORDER + 1))
    sample = docs.sample(min(1.0, SAMPLE_DOCS / n), 7).mapInArrow(some, names).toPandas()  # a bounded sample
    keys = sorted(zip(*(sample[c] for c in sample.columns), strict=True))
    return sorted({tuple(map(bytes, keys[len(keys) * k // ranges])) for k in range(1, ranges)}) if keys else []


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Runs of rows with equal first columns, each as pieces of batches, which are read before the next run."""

    def pieces() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            if batch.num_rows:
                new = np.zeros(batch.num_rows, bool)
                new[0] = True
                for c in batch.columns[:keys]:
                    new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(new).tolist()
                for low, high in zip(at, [*at[1:], batch.num_rows], strict=True):
                    yield tuple(c[low].as_py() for c in batch.columns[:keys]), batch.slice(low, high - low)

    return ((key, (piece for _, piece in rows)) for key, rows in groupby(pieces(), lambda x: x[0]))


def _out(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


#: What goes between ranges: kind COUNTS, a range's automaton; PART, a phrase, a number and the range that asks; AROUND, an automaton with other weights.
_ROW = pa.schema([("range", pa.int64()), ("lang", pa.string()), ("kind", pa.int64()), ("net", pa.binary()), ("phrase", pa.binary()), ("n", pa.int64()), ("asks", pa.int64())])
_DDL = "range long, lang string, kind long, net binary, phrase binary, n long, asks long"
COUNTS, PART, AROUND = -1, 0, 1


def _rows(many: int, /, **columns) -> pa.RecordBatch:
    """Rows of _ROW; a column is an array or one value for all, and null if it isn't given."""

    def full(f: pa.Field):
        x = columns.get(f.name)
        return x if isinstance(x, pa.Array) else pa.nulls(many, f.type) if x is None else pa.repeat(pa.scalar(x, f.type), many)

    return pa.RecordBatch.from_arrays([full(f) for f in _ROW], schema=_ROW)


def frequent(docs: DataFrame, borders: list[Border], least: int) -> DataFrame:
    """range, lang, net (the automaton of the phrases that occur ``least`` times), n (words of the language in the range) of ``docs`` (lang, text)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                code = lang.encode()
                low, high = bisect_left(borders, (code,)), bisect_left(borders, (code + b"\0",))
                layers, begins, following = layers_of_text(b"\n".join(parts))
                ends = [[0] * ORDER, *cuts(layers, begins, following, [b[1:] for b in borders[low:high]]), [len(x) for x in layers.label]]
                del following
                for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                    if any(x < y for x, y in zip(a, b, strict=True)):
                        yield _out([(low + k, lang, pack(layers.spans(a, b)))], ["range", "lang", "net"], [pa.int64(), pa.string(), pa.binary()])

        held, size = defaultdict(list), 0
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for part in segments(text or b"", RUN_BYTES):
                    held[lang].append(part)
                    size += len(part)
                    if size >= RUN_BYTES:
                        yield from flushed()
                        held, size = defaultdict(list), 0
        yield from flushed()

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (at, lang), pieces in _runs(batches, 2):
            layers, n = united([net for piece in pieces for net in piece.column(2).to_pylist()], least)
            yield _out([(at, lang, pack(layers), n)], ["range", "lang", "net", "n"], [pa.int64(), pa.string(), pa.binary(), pa.int64()])

    shards = docs.mapInArrow(lambda b: released(runs(b)), "range long, lang string, net binary")
    dealt = shards.repartition("range").sortWithinPartitions("range", "lang")
    return dealt.mapInArrow(lambda b: released(unite(b)), "range long, lang string, net binary, n long")


def requests(counts: DataFrame, borders: list[Border]) -> DataFrame:
    """The parts of each range's candidates, for the ranges that count them; n: the candidate's own count if it is one word longer."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (at, lang), pieces in _runs(batches, 2):
            want: dict[Phrase, int] = {}
            for piece in pieces:
                for net in piece.column(2).to_pylist():
                    for phrase, often in united([net])[0].phrases():
                        for k in range(1, len(phrase)) if often else ():
                            for part in (phrase[:k], phrase[k:]):
                                want[part] = max(want.get(part, 0), often if len(part) == len(phrase) - 1 else 0)
            code = lang.encode()
            for k in range(0, len(want), 8192):
                some = list(islice(want, k, k + 8192))
                there = [bisect_right(borders, _padded(code, part)) for part in some]
                yield _rows(len(some), range=pa.array(there, pa.int64()), lang=lang, kind=PART, phrase=pa.array([b" ".join(p) for p in some], pa.binary()), n=pa.array([want[p] for p in some], pa.int64()), asks=at)

    return counts.select("range", "lang", "net").mapInArrow(ask, _DDL)


def answers(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asking range the counts of the parts it asked for, and for each range how frequent the longer phrases around its own are."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (at, lang), pieces in _runs(batches, 2):
            known, around = None, None
            for piece in pieces:  # the counts come first
                if known is None:
                    known = united(piece.column(3)[:1].to_pylist())[0]
                    around = [np.zeros(len(x), np.int64) for x in known.label]
                    piece = piece.slice(1)
                if not piece.num_rows:
                    continue
                parts, length, place = layers_of_phrases(piece.column(4))
                weight, n = piece.column(5).to_numpy(), np.zeros(piece.num_rows, np.int64)
                for d, there in enumerate(composed(known, parts)):
                    own = np.flatnonzero(length == d + 1)
                    node = there[place[own]]
                    n[own] = known.weight[d][node]  # a part of a frequent phrase is frequent
                    np.maximum.at(around[d], node, weight[own])
                yield _rows(len(n), range=piece.column(6), lang=lang, kind=PART, phrase=piece.column(4), n=pa.array(n))
            yield _rows(1, range=at, lang=lang, kind=AROUND, net=pack(Layers(known.words, known.label, around, known.parent)))

    both = _counted(counts).unionByName(asked)
    return both.repartition("range").sortWithinPartitions("range", "lang", "kind").mapInArrow(lambda b: released(answer(b)), _DDL)


def _counted(counts: DataFrame) -> DataFrame:
    return counts.select("range", "lang", F.lit(COUNTS).cast("long").alias("kind"), "net", F.lit(None).cast("binary").alias("phrase"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("asks"))


def scored(counts: DataFrame, told: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer phrase holds."""
    names, kinds = ["lang", "phrase", "a", "l", "r", "score"], [pa.string(), pa.string(), *[pa.int64()] * 4]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lang), pieces in _runs(batches, 2):
            often: dict[bytes, int] = {}
            nets: dict[int, Layers] = {}
            for piece in pieces:
                kind = piece.column(2).to_numpy()
                for k in np.flatnonzero(kind != PART).tolist():
                    nets[int(kind[k])] = united([piece.column(3)[k].as_py()])[0]
                parts = piece.filter(pa.array(kind == PART))
                often.update(zip(parts.column(4).to_pylist(), parts.column(5).to_pylist(), strict=True))
            around = {p: n for p, n in nets[AROUND].phrases() if n}
            out = []
            for phrase, a in nets[COUNTS].phrases():
                if len(phrase) > 1 and a and 100 * around.get(phrase, 0) < WITHIN * a:
                    cut = [(often[b" ".join(phrase[:k])], often[b" ".join(phrase[k:])]) for k in range(1, len(phrase))]
                    least, k = min((SCALE * a // (l + r), k) for k, (l, r) in enumerate(cut))  # noqa: E741
                    out.append((lang, b" ".join(phrase).decode(), a, *cut[k], least))
            for k in range(0, len(out), 4096):
                yield _out(out[k : k + 4096], names, kinds)

    return _counted(counts).unionByName(told).repartition("range").sortWithinPartitions("range", "lang", "kind").mapInArrow(lambda b: released(score(b)), "lang string, phrase string, a long, l long, r long, score long")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` first phrases of each language."""
    docs = df.select(F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"), col(text).cast("string").alias("text"))
    with scratch("collocations"), arrow_rows(df.sparkSession, 4096):
        borders = borders_of(docs)
        counts = written(frequent(docs, borders, least), "counts")
        told = answers(counts, requests(counts, borders))
        ranked = numbered(written(scored(counts, told), "scored"), [F.desc("score"), F.desc("a"), F.asc("phrase")], by=["lang"], out="rank")
        total = counts.groupBy("lang").agg(F.sum("n").alias("n"))
        out = ranked.where(F.col("rank") <= top).join(total, "lang")
        return written(out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")


SQL = rf"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), words as (
    select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
), grams as (
    select lang, unnest(list_transform(range(1, len(w) - size + 2), lambda i: w[i : i + size - 1])) as g from words, (values (1), (2), (3), (4)) as sizes(size) where len(w) >= size
), f as (
    select lang, g, count(*) as a from grams group by all
), candidates as (
    select * from f where len(g) > 1 and a >= {LEAST}
), inner_parts as (
    select lang, a, unnest([g[1:2], g[2:3], g[3:4], g[1:3], g[2:4]]) as part, len(g) as size from candidates where len(g) > 2
), around as (
    select lang, part as g, max(a) as most from inner_parts where len(part) > 1 and len(part) < size group by all
), cuts as (
    select c.lang, c.g, c.a, k, l.a as l, r.a as r, 2000000::hugeint * c.a // (l.a + r.a) as score
    from (select *, unnest(range(1, len(g))) as k from candidates) as c
    join f as l on l.lang = c.lang and l.g = c.g[1:k] join f as r on r.lang = c.lang and r.g = c.g[k + 1:]
), best as (
    select *, row_number() over (partition by lang, g order by score, k) as nth from cuts
), kept as (
    select b.* from best as b left join around as x on x.lang = b.lang and x.g = b.g where nth = 1 and 100 * coalesce(most, 0) < {WITHIN} * b.a
), ranked as (
    select *, array_to_string(g, ' ') as phrase, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank from kept
)
select lang, rank, phrase, a, l, r, n, score::bigint as score
from ranked join (select lang, sum(a)::bigint as n from f where len(g) = 1 group by lang) using (lang) where rank <= {TOP}
"""
