"""Language-model scoring by online logistic context mixing.

A text is coded bit by bit, and the sum of all bits is its probability. Bits of bytes are predicted by several predictors
under hashed contexts: two that hold what all training documents had after the last 3 and the last 5 bytes, and one that
learns within the text, from its first bytes on: after the same 5 bytes it expects what followed them last time. A mixer
adds their log-odds with weights gated by the class of the last byte and the place of the bit; a second table refines the
sum. Weights and refinement start from fixed values (START, and none) and learn online, after every STEP bytes, so what a
score comes from is its own text and counts of all training documents, of no part of them. Before that, at borders that the words themselves set (one in 16), one bit says whether the text goes on, up
to the next border, as another training document did after the same WINDOW words; if so, these bytes cost that bit alone.
A zero byte ends the text.

Counts are kept for every context of the corpus by its 56-bit hash and the byte that followed, for every token, and for
every border; so what is gathered grows with the corpus, and contexts share a line only if their hashes clash. Documents are
dealt to blocks of about BLOCK_BYTES by a hash of id and text. A block lists its own distinct contexts, tokens and borders
with their counts (partial sums); the lists are dealt by ranges of the hash, summed there, and what a block asked for
goes back to it. So no task and no driver holds the contexts or the vocabulary of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm.shared import documents, least, materialise, residue

ORDERS = (3, 5)  # bytes of context of the predictors that know the corpus
RECALL = 5  # bytes of context of the predictor that learns within the text
PREDICTORS, START, CELLS, RATE, PUSH = len(ORDERS) + 1, 0.3, 33, 0.3, 0.3
STEP, PIECE, TOGETHER, BATCH = 64, 1 << 15, 48, 1 << 22  # bytes between two updates; of a text at a time; texts side by side; characters among which these are picked
BLOCK_BYTES, SLICE_BYTES, CHUNK, SPAN, NEAR = 1 << 24, 1 << 22, 1 << 19, 1 << 19, 1 << 15
WINDOW = 8  # words that a border looks back
#: Chance that a text goes on as another did, after so many borders in a row where it did (3: or more), and the weight of that guess.
GOES_ON, GUESS = (0.3, 0.8, 0.9, 0.95), 2.0
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_PROBES = [np.uint64(x) for x in (0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_WHITE = [bytes([c]) for c in (9, 10, 11, 12, 13, 32)]
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CLASS = np.array([0 if not (chr(b).isalpha() and b < 128) and b < 128 else 1 if b < 128 else 2 for b in range(256)])
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8).astype(np.float32) * 2 - 1
_CELL_OF_BIT = np.arange(8) * CELLS
_ADD, _EIGHT = np.concatenate([np.eye(8, dtype=np.float32)] * PREDICTORS), np.ones(8, np.float32)  # adds up the predictors; the bits
#: Where the cells of a bit begin, for each place of TOGETHER texts side by side; with half a cell for rounding and half a table for sign.
_CELL_OF = (np.repeat(np.arange(TOGETHER) * (8 * CELLS), STEP)[:, None] + _CELL_OF_BIT + CELLS // 2 + 0.5).astype(np.float32)
GAP = max(*ORDERS, RECALL)  # zero bytes before each text


def _recalled() -> np.ndarray:
    """(times it came in a row, expected ^ actual byte) -> eight int8: 16 x the log-odds of the bits that came; 0 after a wrong one."""
    out = np.zeros((4, 256, 8), np.int8)
    for odd in range(256):
        right = 8 - odd.bit_length()  # bits that agree from the top
        for times, sure in ((1, 24), (2, 38), (3, 52)):
            out[times, odd, :right] = sure
            if right < 8:
                out[times, odd, right] = -sure
    return out.view(np.uint64).ravel()


_RECALLED = _recalled()


def _cells(z: np.ndarray) -> np.ndarray:
    """The refinement's cell of each mixed log-odds (times 16) of a one."""
    cell = np.clip(z, -127, 127)
    cell *= np.float32(1 / 8)
    cell += np.float32(CELLS // 2 + 0.5)
    cell = cell.astype(np.intp)
    cell += _CELL_OF_BIT
    return cell


def folded(text: str | None) -> bytes:
    """A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower()


def keys(buffer: np.ndarray) -> np.ndarray:
    """(len(ORDERS), len(buffer) - GAP): for each byte after the first GAP the hash of each context (56 bits) and the byte."""
    b = buffer.astype(np.uint64)
    n, context = len(b) - GAP, None
    out = np.empty((len(ORDERS), n), np.uint64)
    for back in range(1, GAP + 1):
        byte = b[GAP - back : len(b) - back]
        context = byte.copy() if context is None else context | (byte << np.uint64(8 * (back - 1)))
        if back in ORDERS:
            x = out[ORDERS.index(back)]
            np.add(context, np.uint64(back << 48), out=x)
            x *= _MUL
            x ^= x >> np.uint64(29)
            x *= _MIX
    out &= np.uint64(0xFFFFFFFFFFFFFF00)
    out |= b[GAP:]
    return out


def pieces(data: bytes) -> list[bytes]:
    """The text and its end in pieces, each with the GAP bytes before it."""
    whole = bytes(GAP) + data + b"\0"
    return [whole[i - GAP : i + PIECE] for i in range(GAP, len(whole), PIECE)]


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buffer of all pieces, the number of the piece of each place after the first GAP, and which places are not the gap before a piece."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    real = np.ones(int(sizes.sum()), bool)
    real[(first[:, None] + np.arange(GAP)).ravel()] = False
    return np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.arange(len(parts)), sizes)[GAP:], real[GAP:]


def recalled(key: np.ndarray, now: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """For each place the word of eight log-odds of the byte that last followed the same context in the same piece; 0 where none did.
    key: of the order RECALL, with the byte that came in its low eight bits."""
    n = len(key)
    place_bits = max(1, int(n - 1).bit_length())
    mine = (key >> np.uint64(8)) + piece.astype(np.uint64) * _MIX
    mine *= _MUL
    mine >>= np.uint64(place_bits)
    mine <<= np.uint64(place_bits)
    mine |= np.arange(n, dtype=np.uint64)
    mine.sort()
    place = (mine & np.uint64((1 << place_bits) - 1)).astype(np.int64)
    mine >>= np.uint64(place_bits)
    again = np.zeros(n, bool)
    np.equal(mine[1:], mine[:-1], out=again[1:])
    byte = now[place]
    kept = np.zeros(n, bool)  # the place before has the same context, and the byte that came there had come before it
    np.equal(byte[1:], byte[:-1], out=kept[1:])
    kept &= again
    times = np.zeros(n, np.int64)
    times[1:] = 1 + kept[:-1]
    times[2:] += kept[1:-1] & kept[:-2]
    times *= again
    odd = np.zeros(n, np.int64)
    np.bitwise_xor(byte[1:], byte[:-1], out=odd[1:], casting="unsafe")
    out = np.empty(n, np.uint64)
    out[place] = _RECALLED[times * 256 + odd]
    return out


_END = np.uint64(0x2545F4914F6CDD1D)  # stands for the hash of the end, which no word is
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse
_POWERS: list[np.ndarray] = []
_LETTER = np.arange(1, 257, dtype=np.uint64) * _MUL
_LETTER ^= _LETTER >> np.uint64(30)
_LETTER *= _MIX


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of _BASE and of its inverse; kept, since buffers have like lengths."""
    if not _POWERS or len(_POWERS[0]) < n:
        ones = np.ones(max(n, 1 << 19), np.uint64)
        _POWERS[:] = [np.cumprod(np.concatenate((ones[:1], ones[1:] * np.uint64(m))), dtype=np.uint64) for m in (_BASE, pow(_BASE, -1, 1 << 64))]
    return [p[:n] for p in _POWERS]


def _cut(data: bytes) -> Iterator[bytes]:
    """A long text in parts of about SPAN bytes that begin at white space, so that no word is cut."""
    i = 0
    while len(data) - i > SPAN:
        j = max(data.rfind(c, i, i + SPAN) for c in _WHITE)
        if j <= i:
            j = min((x for x in (data.find(c, i + SPAN) for c in _WHITE) if x >= 0), default=len(data))
        yield data[i:j]
        i = j
    yield data[i:]


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and begin of each word: a polynomial over its bytes from running sums, mixed. data ends with white space."""
    b = np.frombuffer(data, np.uint8)
    blank = _BLANK[b]
    edge = blank.copy()
    edge[0] = ~blank[0]
    np.not_equal(blank[1:], blank[:-1], out=edge[1:])
    at = np.flatnonzero(edge)  # begin and stop of each word in turn
    begin, stop = at[::2], at[1::2]
    power, inverse = _powers(len(b))
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    terms = np.take(_LETTER, b)
    terms *= power
    np.cumsum(terms, out=total[1:])
    h = total[stop]
    h -= total[begin]
    h *= inverse[begin]
    h += (stop - begin).astype(np.uint64) * _MUL
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h, begin


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of folded texts one after another: hashes of their words, each text's with its end, where in its text each begins, and how many
    tokens each text has."""
    if sum(map(len, texts)) > SPAN and len(texts) > 1:
        groups, size = [[]], 0
        for t in texts:
            if groups[-1] and size + len(t) > SPAN:
                groups.append([])
                size = 0
            groups[-1].append(t)
            size += len(t)
        if len(groups) > 1:
            return tuple(np.concatenate(x) for x in zip(*map(tokens, groups)))
    if len(texts) == 1 and len(texts[0]) > SPAN:
        parts, i = [], 0
        for part in _cut(texts[0]):
            h, begin = _hashed(part + b" ")
            parts.append((h, begin + i))
            i += len(part)
        h, begin = (np.concatenate(x) for x in zip(*parts))
        return np.append(h, _END), np.append(begin, len(texts[0])), np.array([len(h) + 1])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes + 1) - sizes - 1
    h, begin = _hashed(b" ".join(texts) + b" ")
    words = np.diff(np.append(np.searchsorted(begin, first), len(h)))
    ends = np.cumsum(words)
    t, where = np.insert(h, ends, _END), np.insert(begin - np.repeat(first, words), ends, sizes)
    return t, where, words + 1


def borders(texts: list[bytes], t: np.ndarray, where: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The borders of some texts: the number of the text, hash of the WINDOW words before each, 32-bit hash of what follows up to the next
    one (or the end), and where that begins and ends (in the text with its end)."""
    number = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    mixed = t * _MUL
    mixed[1:] += t[:-1]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX
    at = np.flatnonzero((mixed >> np.uint64(60)) == 0)  # the last word before a border
    i = at - first[at]
    at = at[(i >= WINDOW - 1) & (i < counts[number[at]] - 2)]
    k = np.zeros(len(at), np.uint64)
    for j in range(WINDOW):
        k = (k + t[at - j]) * _MUL
        k ^= k >> np.uint64(31)
    number = number[at]
    begin = where[at + 1]
    last = np.append(number[1:] != number[:-1], True)[: len(at)]
    size = np.fromiter(map(len, texts), np.int64, len(texts))[number] + 1
    end = np.where(last, size, np.append(begin[1:], 0)[: len(at)])
    follows = np.fromiter((xxhash.xxh32_intdigest(texts[n][i:j], j > len(texts[n])) for n, i, j in zip(number.tolist(), begin.tolist(), end.tolist())), np.int64, len(at))
    return number, k, follows, begin, end


def _sums(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of n of each."""
    if not len(k):
        return k, n
    order = np.argsort(k, kind="stable")  # k is a few sorted runs
    k = k[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[at], np.add.reduceat(n[order], at, dtype=n.dtype)


class Counts:
    """Distinct keys of some texts and how often those to learn from have them; keys wait in lists until they are sorted."""

    def __init__(self) -> None:
        self.found, self.waiting, self.size = [], {True: [], False: []}, {True: 0, False: 0}

    def add(self, k: np.ndarray, learn: bool) -> None:
        self.waiting[learn].append(k)
        self.size[learn] += len(k)
        if self.size[learn] > 4 * CHUNK:
            self._sort(learn)

    def _sort(self, learn: bool) -> None:
        if self.waiting[learn]:
            k = np.concatenate(self.waiting[learn])
            self.waiting[learn], self.size[learn] = [], 0
            k.sort()
            at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            n = np.diff(np.append(at, len(k))).astype(np.uint32) if learn else np.zeros(len(at), np.uint32)
            self.found.append((k[at], n))
            if len(self.found) > 1 and sum(len(x) for x, _ in self.found[1:]) > max(1 << 20, len(self.found[0][0])):
                self.found = [_sums(*map(np.concatenate, zip(*self.found)))]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        for learn in (True, False):
            self._sort(learn)
        if len(self.found) == 1:
            return self.found[0]
        return _sums(*map(np.concatenate, zip(*self.found))) if self.found else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))


class Asked:
    """What a block asks for: its distinct (context, byte) pairs, tokens and borders, with the counts of its training texts."""

    def __init__(self) -> None:
        self.pairs, self.tokens, self.borders, self.held, self.size = Counts(), Counts(), [], [], 0

    def add(self, data: bytes, learn: bool, rank: int) -> None:
        self.held.append((data, learn, rank))
        self.size += len(data) + GAP
        if self.size > 1 << 17:
            self._count()

    def _count(self) -> None:
        """Counts what is held."""
        held, self.held, self.size = self.held, [], 0
        for kind in (True, False):
            texts = [d for d, learn, _ in held if learn == kind]
            if not texts:
                continue
            buffer, _, real = _joined([p for d in texts for p in pieces(d)])
            self.pairs.add(keys(buffer)[:, real].ravel(), kind)
            t, where, counts = tokens(texts)
            self.tokens.add(t, kind)
            number, k, follows, _, _ = borders(texts, t, where, counts)
            rank = np.array([r for _, learn, r in held if learn == kind], np.int64)[number]
            self.borders.append((k, follows | (rank << 32), np.full(len(k), kind)))

    def met(self) -> tuple[np.ndarray, ...]:
        """Of each border its least and greatest (document, what follows) among training texts (0: none), and how many documents have it."""
        none = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        k, v, learn = (np.concatenate(x) for x in zip(*self.borders)) if self.borders else none[:3]
        if not len(k):
            return none
        order = np.lexsort((v, k))
        k, v, learn = k[order], v[order], learn[order]
        new = np.concatenate(([True], k[1:] != k[:-1]))
        at = np.flatnonzero(new)
        other = new | np.concatenate(([True], (v[1:] >> 32) != (v[:-1] >> 32)))
        low = np.minimum.reduceat(np.where(learn, v, _NONE), at)
        return k[at], np.where(low == _NONE, 0, low), np.maximum.reduceat(np.where(learn, v, 0), at), np.add.reduceat(other.astype(np.int64), at)

    def slices(self, block: int, bits: int) -> Iterator[pa.RecordBatch]:
        """One row for each range of the hash in which something is asked, so a block never has more rows than keys, however many ranges there are."""
        self._count()
        parts = [self.pairs.all(), self.tokens.all(), self.met()]
        of = [(p[0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(p[0]), np.int64) for p in parts]
        there = np.unique(np.concatenate([np.unique(x) for x in of]))
        edges = [(np.searchsorted(x, there), np.searchsorted(x, there, "right")) for x in of]
        for at in range(0, len(there), SLICES):
            rows = [[_pack(x[e[0][i] : e[1][i]]) for p, e in zip(parts, edges) for x in p] for i in range(at, min(at + SLICES, len(there)))]
            columns = [pa.array([block] * len(rows), pa.int64()), pa.array(there[at : at + SLICES], pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*rows))]
            yield pa.RecordBatch.from_arrays(columns, names=_names(ASKED))


_NONE = np.int64((1 << 63) - 1)
ASKED = "block long, slice int, pairs binary, pair_n binary, tokens binary, token_n binary, borders binary, low binary, high binary, docs binary"
ANSWERS = "block long, slice int, n long, v long, pairs binary, odds binary, tokens binary, token_n binary, borders binary, low binary, high binary"
SCORES = "doc_id long, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
TUNING_BLOCK, TOTALS = -1, -2
#: Rows of a block that are made at once.
SLICES = 1024


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _pack(x: np.ndarray) -> bytes:
    """Byte planes: of sorted keys and small counts, most planes compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _asks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked = None, None
        for batch in batches:
            for b, learn, rank, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if b != block:
                    if asked is not None:
                        yield from asked.slices(block, bits)
                    block, asked = b, Asked()
                asked.add(folded(text), learn, rank)
        if asked is not None:
            yield from asked.slices(block, bits)

    return run


def _odds(k: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sorted distinct pairs and their counts, all of each context that is there -> (pairs, 8) int8: for each bit on the way to the
    byte, 16 x the log-odds of going there."""
    out = np.empty((len(k), 8), np.int8)

    def level(s: int) -> np.ndarray:
        p = k >> np.uint64(s)
        at = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        return np.repeat(np.add.reduceat(counts, at), np.diff(np.append(at, len(k))))

    if not len(k):
        return out
    above = level(8)
    for bit in range(8):
        mine = level(7 - bit)
        out[:, bit] = np.clip(np.rint(16 * np.log(((mine + 0.3) / (above - mine + 0.3)).astype(np.float32))), -127, 127)
        above = mine
    return out


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of all blocks sorted by slice -> what each block asked for; holds one slice at a time. The tuning block's counts, which
    its own blocks have told as well, are taken off for its answer. A row of the block TOTALS has the sum of tokens and how many differ."""

    def closed(now: int, held: list) -> pa.RecordBatch:
        own = np.array([b != TUNING_BLOCK for b, *_ in held])
        counted = [h for h, o in zip(held, own) if o]
        join = lambda i: np.concatenate([h[i] for h in counted]) if counted else np.zeros(0, np.uint64 if i in (1, 3, 5) else np.int64)
        pk, pn = _sums(join(1), join(2))
        tk, tn = _sums(join(3), join(4))
        gk, low, high, docs = join(5), join(6), join(7), join(8)
        if len(gk):
            order = np.argsort(gk)
            gk = gk[order]
            at = np.flatnonzero(np.concatenate(([True], gk[1:] != gk[:-1])))
            low = np.minimum.reduceat(np.where(low == 0, _NONE, low)[order], at)
            gk, high, docs = gk[at], np.maximum.reduceat(high[order], at), np.add.reduceat(docs[order], at)
        useful = (docs > 1) & (high > 0)  # some other training document has it
        gk, low, high = gk[useful], low[useful], high[useful]
        odds, out = _odds(pk, pn), [(TOTALS, now, int(tn.sum()), int((tn > 0).sum()), *[b""] * 7)]
        for b, k, n, t, _, g, *_ in held:
            at, mine = np.searchsorted(pk, k), odds
            if b == TUNING_BLOCK:
                less = pn.copy()
                less[at] -= n
                mine = _odds(pk, less)
            known = np.isin(gk, g, assume_unique=True)
            out.append((b, now, 0, 0, _pack(k), mine[at].tobytes(), _pack(t), _pack(tn[np.searchsorted(tk, t)]), _pack(gk[known]), _pack(low[known]), _pack(high[known])))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=_names(ANSWERS))

    now, held = None, []
    for batch in batches:
        for b, s, pk, pn, tk, tn, gk, low, high, docs in zip(*(batch.column(i).to_pylist() for i in range(10))):
            if s != now:
                if held:
                    yield closed(now, held)
                now, held = s, []
            held.append((b, _unpack(pk, "<u8"), _unpack(pn, "<u4").astype(np.int64), _unpack(tk, "<u8"), _unpack(tn, "<u4").astype(np.int64), _unpack(gk, "<u8"), *(_unpack(x, "<i8") for x in (low, high, docs))))
    if held:
        yield closed(now, held)


class Lookup:
    """Values of keys from a sorted list of distinct ones, by a few probes; a key and its value lie together. Asking for a key that isn't
    there is an error."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.pairs, self.probes = keys, np.stack([keys, np.ascontiguousarray(values).view(np.uint64).ravel()], 1), []
        left = np.arange(len(keys), dtype=np.uint32)
        for m in _PROBES:
            if len(left):
                shift = np.uint64(64 - max(4, int(2 * len(left)).bit_length()))
                spot, index = (keys[left] * m) >> shift, np.zeros(1 << int(64 - shift), np.uint32)
                index[spot] = left
                self.probes.append((m, shift, index))
                left = left[index[spot] != left]

    def __call__(self, k: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            raise RuntimeError("a key that was not asked for")
        found, todo = None, None
        for m, shift, index in self.probes:
            q = k if todo is None else k[todo]
            hit = np.take(self.pairs, np.take(index, (q * m) >> shift), 0)
            bad = np.flatnonzero(hit[:, 0] != q)
            if todo is None:
                found, todo = hit[:, 1], bad
            else:
                found[todo] = hit[:, 1]
                todo = todo[bad]
        if len(todo):
            q = k[todo]
            hit = self.pairs[np.minimum(np.searchsorted(self.keys, q), len(self.keys) - 1)]
            if (hit[:, 0] != q).any():
                raise RuntimeError("a key that was not asked for")
            found[todo] = hit[:, 1]
        return found


@dataclass
class ByteModel:
    table: np.ndarray  # eight int8 log-odds for each key, times 16
    weights: np.ndarray  # PREDICTORS x 3 classes x 8 bits
    refine: np.ndarray  # 8 bits x CELLS, added to the mixed log-odds (times 16)
    keys: np.ndarray  # sorted

    def __post_init__(self) -> None:
        self._found = Lookup(self.keys, self.table)

    def odds(self, parts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of all places of the pieces one after another: PREDICTORS words of log-odds of the bits that came, the byte, the byte before.
        Some pieces at a time, so that what is worked on stays near the processor."""
        n = sum(map(len, parts)) - GAP * len(parts)
        words, now, last = np.empty((n, PREDICTORS), np.uint64), np.empty(n, np.uint8), np.empty(n, np.uint8)
        i = done = 0
        while i < len(parts):
            j, size = i, 0
            while j < len(parts) and (j == i or size + len(parts[j]) <= NEAR):
                size += len(parts[j])
                j += 1
            buffer, piece, real = _joined(parts[i:j])
            k = keys(buffer)[:, real]
            here = slice(done, done + k.shape[1])
            now[here], last[here] = buffer[GAP:][real], buffer[GAP - 1 : -1][real]
            for m in range(len(ORDERS)):
                words[here, m] = self._found(k[m])
            words[here, -1] = recalled(k[ORDERS.index(RECALL)], now[here], piece[real])
            i, done = j, here.stop
        return words, now, last

    def log10(self, data: bytes) -> float:
        return float(self.log10s([data])[0])

    def log10s(self, texts: list[bytes], known: list[np.ndarray | None] | None = None) -> np.ndarray:
        """Of each text by itself; texts of like length go side by side, each with its own weights and refinement. known: places of a
        text (with its end) that cost nothing here."""
        out = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for i in range(0, len(order), TOGETHER):
            group = order[i : i + TOGETHER]
            out[group] = self._side_by_side([texts[g] for g in group], [None if known is None else known[g] for g in group])
        return out

    def _side_by_side(self, texts: list[bytes], known: list[np.ndarray | None]) -> np.ndarray:
        """texts from the longest to the shortest."""
        nats = np.zeros(len(texts))
        weights = np.repeat(self.weights.transpose(1, 0, 2).reshape(1, 3, -1), len(texts), 0)
        refine = np.repeat(self.refine[None].astype(np.float32), len(texts), 0)
        whole = [bytes(GAP) + t + b"\0" for t in texts]
        for begin in range(0, len(whole[0]) - GAP, PIECE):
            who = [i for i, w in enumerate(whole) if len(w) - GAP > begin]
            parts = [whole[i][begin : begin + GAP + PIECE] for i in who]
            words, now, last = self.odds(parts)
            sizes = np.array([len(p) - GAP for p in parts])
            if any(known[i] is not None for i in who):
                todo = np.concatenate([np.ones(n, bool) if known[i] is None else ~known[i][begin : begin + n] for i, n in zip(who, sizes.tolist())])
                ends = np.cumsum(sizes)
                sizes = np.diff(np.concatenate(([0], np.concatenate(([0], np.cumsum(todo)))[ends])))
                words, now, last = words[todo], now[todo], last[todo]
            first = np.cumsum(sizes) - sizes
            by = np.argsort(-sizes, kind="stable")  # those with most left come first
            who, sizes, first = np.array(who)[by], sizes[by], first[by]
            gates, place = _CLASS[last], np.arange(STEP)
            w, r, c = weights[who], refine[who], nats[who]
            for at in range(0, int(sizes[0]), STEP):
                a = int((sizes > at).sum())
                spot, there = first[:a, None] + (at + place), None
                if sizes[a - 1] < at + STEP:
                    there = at + place < sizes[:a, None]
                    spot *= there
                spot = spot.ravel()
                self._step(np.take(words, spot, 0), now[spot], gates[spot].reshape(a, STEP), there, w[:a], r[:a], c[:a])
            weights[who], refine[who], nats[who] = w, r, c
        return -nats / math.log(10)

    @staticmethod
    def _step(words, now, gate, there, weights, refine, nats) -> None:
        """The cost of the next STEP bytes of each text, added to nats; then weights and refinement learn from them."""
        a, n = gate.shape
        x = words.view(np.int8).astype(np.float32)
        terms = np.take(weights.reshape(a * 3, -1), (gate + np.arange(0, 3 * a, 3)[:, None]).ravel(), 0, mode="clip")
        terms *= x
        z = terms @ _ADD
        sign = np.take(_SIGNS, now, 0, mode="clip")
        cell = z * sign
        np.clip(cell, -127, 127, out=cell)
        cell *= np.float32(1 / 8)
        cell += _CELL_OF[: a * n]  # whole numbers below 2^24, which a float32 holds
        cell = cell.astype(np.intp)
        push = np.take(refine.ravel(), cell, mode="clip")
        push *= sign
        z += push
        np.clip(z, -160, 160, out=z)  # a bit costs 10 nats at most
        z *= np.float32(-1 / 16)
        e = np.exp(z, out=z)
        if there is not None:
            e[~there.ravel()] = 0
        f = 1 + e
        e /= f
        nats += (np.log(f, out=f) @ _EIGHT).reshape(a, n).sum(1, dtype=np.float64)
        x *= e @ _ADD.T
        one_hot = (gate[:, None, :] == np.arange(3)[:, None]).astype(np.float32)
        weights += np.float32(RATE / 16 / STEP) * (one_hot @ x.reshape(a, n, -1))
        e *= sign
        refine += np.float32(PUSH) * np.bincount(cell.ravel(), e.ravel(), a * 8 * CELLS).reshape(a, -1).astype(np.float32)


def tuned(known: np.ndarray, table: np.ndarray, texts: list[bytes], rounds: int = 6) -> ByteModel:
    """Weights of each gate and bit by Newton's method on the log-loss, then the refinement of each cell; without texts those that scores start from."""
    model = ByteModel(table, np.full((PREDICTORS, 3, 8), START, np.float32), np.zeros(8 * CELLS, np.float32), known)
    parts = [p for t in texts for p in pieces(t)]
    for step in range(rounds + 1):
        grad, hess = np.zeros((3, 8, PREDICTORS)), np.zeros((3, 8, PREDICTORS, PREDICTORS))
        push, curve = np.zeros(8 * CELLS), np.zeros(8 * CELLS)
        for part in parts:
            words, now, last = model.odds([part])
            x, gate = words.view(np.int8).reshape(-1, PREDICTORS, 8).transpose(1, 0, 2).astype(np.float32) / 16, _CLASS[last]
            z = sum(x[k] * model.weights[k][gate] for k in range(PREDICTORS))
            p = 1 / (1 + np.exp(-np.clip(z, -10, 10)))
            if step == rounds:
                sign = _SIGNS[now]
                cell = _cells(16 * z * sign).ravel()
                push += np.bincount(cell, ((1 - p) * sign).ravel(), 8 * CELLS)
                curve += np.bincount(cell, (p * (1 - p)).ravel(), 8 * CELLS)
                continue
            for c in range(3):
                at = np.flatnonzero(gate == c)
                xc, slope = x[:, at].transpose(2, 1, 0), (p[at] * (1 - p[at])).T[:, :, None]  # bits x places x predictors
                grad[c] += (xc * (1 - p[at]).T[:, :, None]).sum(1)
                hess[c] += xc.transpose(0, 2, 1) @ (xc * slope)
        if step < rounds:
            pull = 2.0 * (START - model.weights.transpose(1, 2, 0))
            move = np.linalg.solve(hess + np.eye(PREDICTORS) * 2.0, (grad + pull)[..., None])[..., 0]
            model.weights += np.clip(move, -0.5, 0.5).transpose(2, 0, 1).astype(np.float32)
        else:
            model.refine = (16 * np.clip(push / (curve + 5), -1, 1)).astype(np.float32)
    return model


def going_on(hits: list[bool | None]) -> float:
    """The cost in nats of the bits at the borders of a text: hit, miss, or None where no other document has the border. Chances
    start from GOES_ON and learn online, by the number of hits in a row."""
    ones, zeros = [GUESS * p for p in GOES_ON], [GUESS * (1 - p) for p in GOES_ON]
    run, nats = 0, 0.0
    for hit in hits:
        if hit is None:
            run = 0
            continue
        state = min(run, 3)
        nats -= math.log((ones if hit else zeros)[state] / (ones[state] + zeros[state]))
        (ones if hit else zeros)[state] += 1
        run = run + 1 if hit else 0
    return nats


@dataclass
class Trained:
    """What scores start from, and the answers to every block of the table that it was trained on."""

    weights: np.ndarray
    refine: np.ndarray
    source: tuple
    blocks: DataFrame  # block, learn, doc_id, rank, text
    answers: DataFrame  # see ANSWERS
    n_blocks: int


def train(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", tuning_docs: int = 0) -> Trained:
    """Counts over all usable rows. The mixer starts from fixed values, unless a caller asks for `tuning_docs`: then those with the least hashes
    (a twentieth at most, one at least) tune it, with counts that leave these out. No rows at all give a model without knowledge."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    h = F.xxhash64(F.lit("lm"), doc_id, text)
    rows = df.select(F.coalesce(usable, F.lit(False)).alias("learn"), doc_id.alias("doc_id"), text.alias("text"), h.alias("h"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    sums = rows.agg(F.sum(size).alias("bytes"), F.count_if("learn").alias("n")).first()
    n_blocks, bits = max(1, -(-(sums["bytes"] or 0) // BLOCK_BYTES)), ((sums["bytes"] or 0) // SLICE_BYTES).bit_length()
    # block and rank by content, so in any order of rows and however the input is split; rank: 31 bits that tell documents apart
    blocks = rows.select(F.pmod("h", F.lit(n_blocks)).alias("block"), "learn", "doc_id", (F.shiftrightunsigned("h", 33) + 1).alias("rank"), "text")
    asking = blocks.repartitionById(n_blocks, F.col("block").cast("int")).select("block", "learn", "rank", "text").mapInArrow(_asks(bits), ASKED)
    if tuning_docs == 0:
        answers = materialise(asking.repartition(1 << max(0, bits - 2), F.col("slice")).sortWithinPartitions("slice").mapInArrow(_answers, ANSWERS), "lm-answers")
        model = tuned(*_table([]), [])
        return Trained(model.weights, model.refine, (df, usable, id_col, text_col), blocks, answers, n_blocks)
    some = least(rows.where("learn"), "h", min(tuning_docs, -(-(sums["n"] or 0) // 20)), sums["n"] or 0)
    tuning = [folded(r["text"]) for r in some.orderBy("h", "text").select("text").collect()]
    own = Asked()
    for t in tuning:
        own.add(t, True, 0)
    own._count()
    own.borders, own.tokens = [], Counts()
    spark = df.sparkSession
    extra = spark.createDataFrame([tuple(r.values()) for part in own.slices(TUNING_BLOCK, bits) for r in part.to_pylist()], ASKED)
    slices = asking.unionByName(extra).repartition(1 << max(0, bits - 2), F.col("slice")).sortWithinPartitions("slice")
    answers = materialise(slices.mapInArrow(_answers, ANSWERS), "lm-answers")
    got = answers.where(F.col("block") == TUNING_BLOCK).orderBy("slice").select("pairs", "odds").collect()
    model = tuned(*_table([(bytes(r["pairs"]), bytes(r["odds"])) for r in got]), tuning)
    return Trained(model.weights, model.refine, (df, usable, id_col, text_col), blocks, answers, n_blocks)


def _table(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Answers of a block in the order of slices -> its sorted keys, and the eight log-odds of each in a word."""
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([_unpack(k, "<u8") for k, _ in rows]), np.concatenate([np.frombuffer(o, "<u8") for _, o in rows])


class Scorer:
    """Scores the texts of one block from what the block asked for."""

    def __init__(self, rows: list[tuple[bytes, ...]], weights: np.ndarray, refine: np.ndarray, train_tokens: int, shift: float):
        k, words = _table([r[:2] for r in rows])
        self.model = ByteModel(words, weights, refine, k)
        join = lambda i, kind: np.concatenate([_unpack(r[i], kind) for r in rows])
        self.count = Lookup(join(2, "<u8"), join(3, "<i8"))
        self.borders, self.low, self.high = join(4, "<u8"), join(5, "<i8"), join(6, "<i8")
        self.train_tokens, self.shift = train_tokens, shift

    def _told(self, rank: np.ndarray, number: np.ndarray, k: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each border, whether another training document has it, and whether the text goes on as there."""
        if not len(self.borders) or not len(k):
            return np.zeros(len(k), bool), np.zeros(len(k), bool)
        at = np.minimum(np.searchsorted(self.borders, k), len(self.borders) - 1)
        low, high, own = self.low[at], self.high[at], rank[number]
        other = np.where(low >> 32 != own, low, high)  # a text is no evidence for itself
        there = (self.borders[at] == k) & (other >> 32 != own)
        return there, there & ((other & 0xFFFFFFFF) == follows)

    def score(self, texts: list[tuple[int | None, int, str | None]]) -> pa.RecordBatch:
        datas = [folded(text) for _, _, text in texts]
        t, where, counts = tokens(datas)
        c, first = self.count(t).view(np.int64), np.cumsum(counts) - counts
        base = np.add.reduceat(np.log10(c + 0.1), first) - self.shift * counts
        number, k, follows, begin, end = borders(datas, t, where, counts)
        there, hit = self._told(np.array([r for _, r, _ in texts], np.int64), number, k, follows)
        flags, known = np.zeros(len(datas)), [None] * len(datas)
        for n in np.unique(number[there]).tolist():
            i, j = np.searchsorted(number, [n, n + 1])
            flags[n] = going_on([bool(h) if x else None for h, x in zip(hit[i:j], there[i:j])]) / math.log(10)
            if hit[i:j].any():
                known[n] = np.zeros(len(datas[n]) + 1, bool)
                for x in (np.flatnonzero(hit[i:j]) + i).tolist():
                    known[n][begin[x] : end[x]] = True
        score = self.model.log10s(datas, known) - flags
        whole = [[d for d, _, _ in texts], [len(d) for d in datas], counts, np.add.reduceat((c > 0).astype(np.int64), first), [self.train_tokens] * len(texts)]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in whole), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=_names(SCORES))


def score(df: DataFrame, usable: Column, model: Trained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row, from its whole text; a null text
    counts as empty. bits_per_byte is over the bytes and the end.

    Null and repeated ids pass through; other columns are ignored; an empty table gives an empty result. Tokens are told
    apart by a 64-bit hash, borders by one of 64 bits and what follows them by one of 32. Rows that repeat both id and text
    count as one document at borders. Counts come from the usable rows of df: with another table than the one trained on,
    contexts are asked for again, and weights and refinement stay.
    """
    if any(x is not y for x, y in zip(model.source[:2], (df, usable))) or model.source[2:] != (id_col, text_col):
        fresh = train(df, usable, id_col, text_col)
        model = Trained(model.weights, model.refine, fresh.source, fresh.blocks, fresh.answers, fresh.n_blocks)
    totals = model.answers.where(F.col("block") == TOTALS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    train_tokens, shift = int(totals["n"]), math.log10(int(totals["n"]) + 0.1 * (int(totals["v"]) + 1))
    asked = _names(ANSWERS)[4:]
    answers = model.answers.where("block >= 0").select("block", "slice", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("rank"), F.lit(None).cast("string").alias("text"), *asked)
    texts = model.blocks.select("block", F.lit(None).cast("int").alias("slice"), "doc_id", "rank", "text", *[F.lit(None).cast("binary").alias(c) for c in asked])
    # a block's answers come first, in the order of their slices
    dealt = answers.unionByName(texts).repartitionById(model.n_blocks, F.col("block").cast("int")).sortWithinPartitions("block", F.col("slice").asc_nulls_last())
    weights, refine = model.weights, model.refine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, scorer = None, [], None
        for batch in batches:
            texts: list[tuple] = []
            size = 0
            for i, (b, s, *text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                if b != block:
                    if texts:
                        yield scorer.score(texts)
                    block, held, scorer, texts, size = b, [], None, [], 0
                if s is not None:
                    held.append(tuple(batch.column(c)[i].as_py() for c in range(5, 12)))
                    continue
                if scorer is None:
                    scorer, held = Scorer(held, weights, refine, train_tokens, shift), []
                texts.append(tuple(text))
                size += len(text[2] or "")
                if size > BATCH:
                    yield scorer.score(texts)
                    texts, size = [], 0
            if texts:
                yield scorer.score(texts)

    out = dealt.mapInArrow(run, SCORES)
    return out.withColumn("bits_per_byte", F.col("score") * F.lit(-math.log2(10)) / (F.col("n_bytes") + 1))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    usable = residue("doc_id", 10) != 0
    out = score(docs, usable, train(docs, usable))
    return out.select("doc_id", (residue("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
