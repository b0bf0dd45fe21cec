"""JPEG XL's entropy coding: hybrid integers, prefix codes, asymmetric numeral systems and back-references."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np

from .jxl import LowBits, LowBitsWriter
from .raster import BadImage

#: Probabilities are in so many bits; a state starts and ends at START.
PRECISION = 12
TOTAL = 1 << PRECISION
START = 0x130000
# Bits and code (lowest bit first) of the logarithm that each count of a histogram is sent by; 13 is a repeat.
LOG_BITS = [5, 4, 4, 4, 4, 4, 3, 3, 3, 3, 3, 6, 7, 7]
LOG_CODE = [17, 11, 15, 3, 9, 7, 4, 2, 5, 6, 0, 33, 1, 65]
# The order in which the lengths of code-length codes are sent.
LENGTH_ORDER = [1, 2, 3, 4, 0, 5, 17, 6, 16, 7, 8, 9, 10, 11, 12, 13, 14, 15]
# Columns and rows back that the first 120 distances stand for.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


@dataclass
class Hybrid:
    """Small values are tokens; a larger one's token holds its size and its highest and lowest bits."""

    split: int = 4
    high: int = 0
    low: int = 0

    @staticmethod
    def read(bits: LowBits, alphabet: int) -> Hybrid:
        split = bits.take(alphabet.bit_length())
        if split == alphabet:
            return Hybrid(split)
        high = bits.take(split.bit_length())
        low = bits.take((split - high).bit_length()) if high <= split else split + 1
        if high + low > split or split > alphabet:
            raise BadImage("a hybrid integer's parts exceed its split")
        return Hybrid(split, high, low)

    def write(self, out: LowBitsWriter, alphabet: int) -> None:
        out.put(self.split, alphabet.bit_length())
        if self.split != alphabet:
            out.put(self.high, self.split.bit_length())
            out.put(self.low, (self.split - self.high).bit_length())

    def value(self, token: int, bits: LowBits) -> int:
        if token < 1 << self.split:
            return token
        kept = self.high + self.low
        n = self.split - kept + (token - (1 << self.split) >> kept)
        if n > 32:
            raise BadImage("a hybrid integer of over 32 bits")
        top = token >> self.low & (1 << self.high) - 1 | 1 << self.high
        return (top << n | bits.take(n)) << self.low | token & (1 << self.low) - 1

    def tokens(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token, extra bits and how many of each value; for configurations that keep no bits."""
        v = values.astype(np.int64)
        size = np.floor(np.log2(np.maximum(v, 1).astype(np.float64))).astype(np.int64)
        size += v >= np.int64(1) << (size + 1)
        size -= v < np.int64(1) << size
        large = v >= 1 << self.split
        return np.where(large, (1 << self.split) + size - self.split, v), np.where(large, v - (np.int64(1) << size), 0), np.where(large, size, 0)


def small_number(bits: LowBits) -> int:
    if not bits.take(1):
        return 0
    n = bits.take(3)
    return (1 << n) + bits.take(n)


def put_small(out: LowBitsWriter, value: int) -> None:
    out.put(value > 0, 1)
    if value:
        n = value.bit_length() - 1
        out.put(n, 3)
        out.put(value - (1 << n), n)


def read_counts(bits: LowBits, alphabet: int) -> list[int]:
    """Counts of a histogram of ``1 << alphabet`` symbols, ``TOTAL`` together."""
    size = 1 << alphabet
    counts = [0] * size
    kind = bits.take(2)
    try:
        if kind == 3:  # two symbols
            a, b = small_number(bits), small_number(bits)
            if a == b:
                raise BadImage("a histogram names one symbol twice")
            counts[a] = bits.take(PRECISION)
            counts[b] = TOTAL - counts[a]
            return counts
        if kind == 1:  # one symbol
            counts[small_number(bits)] = TOTAL
            return counts
        if kind == 2:  # even
            n = small_number(bits) + 1
            for i in range(n):
                counts[i] = TOTAL // n + (i < TOTAL % n)
            return counts
    except IndexError:
        raise BadImage("a histogram's symbol is out of range") from None
    length = 0
    while length < 3 and bits.take(1):
        length += 1
    shift = bits.take(length) + (1 << length) - 1
    n = small_number(bits) + 3
    if shift > 13 or n > size:
        raise BadImage("a histogram is too large")
    logs: list[int] = []
    repeated: set[int] = set()
    while len(logs) < n:
        log = _take_log(bits)
        if log < 13:
            logs.append(log)
            continue
        again = range(len(logs), len(logs) + small_number(bits) + 4)
        repeated.update(again)
        logs += [0] * len(again)
    plain = [i for i in range(n) if i not in repeated]
    if len(logs) > n or not plain:
        raise BadImage("a histogram repeats beyond its end")
    # The first of the largest logarithms is what the others leave.
    rest = max(plain, key=lambda i: (logs[i], -i))
    if not logs[rest] or rest + 1 in repeated:
        raise BadImage("a histogram has no rest")
    last = 0
    for i in range(n):
        if i in repeated:
            counts[i] = last
            continue
        log = logs[i] - 1
        if i == rest or log < 0:
            last = 0
            continue
        more = min(max(shift - (PRECISION - log >> 1), 0), log)
        last = counts[i] = (1 << log) + (bits.take(more) << log - more)
    counts[rest] = TOTAL - sum(counts)
    if counts[rest] < 0:
        raise BadImage("a histogram's counts exceed the total")
    return counts


_LOGS = {(n, code): i for i, (n, code) in enumerate(zip(LOG_BITS, LOG_CODE, strict=True))}


def _take_log(bits: LowBits) -> int:
    code = n = 0
    while n < 7:
        code |= bits.take(1) << n
        n += 1
        if (n, code) in _LOGS:
            return _LOGS[n, code]
    raise BadImage("no such count")


def write_counts(out: LowBitsWriter, counts: list[int]) -> None:
    """The inverse of ``read_counts``, every count exact."""
    used = [i for i, c in enumerate(counts) if c]
    if len(used) == 1:
        out.put(1, 2)
        put_small(out, used[0])
    elif len(used) == 2:
        out.put(3, 2)
        put_small(out, used[0])
        put_small(out, used[1])
        out.put(counts[used[0]], PRECISION)
    else:
        out.put(0, 2)
        out.put(7, 3)  # a shift of 13 in three bits: whole counts
        out.put(6, 3)
        n = used[-1] + 1
        put_small(out, n - 3)
        logs = [c.bit_length() for c in counts[:n]]
        for log in logs:
            out.put(LOG_CODE[log], LOG_BITS[log])
        rest = logs.index(max(logs))
        for i, log in enumerate(logs):
            if i != rest and log > 1:
                out.put(counts[i] - (1 << log - 1), log - 1)


def to_counts(seen: Counter[int], size: int) -> list[int]:
    """Counts of ``TOTAL`` together in proportion to ``seen``, at least one for each symbol seen."""
    if not seen:
        seen = Counter({0: 1})
    n = sum(seen.values())
    counts = [0] * size
    for symbol, k in seen.items():
        counts[symbol] = max(1, k * TOTAL // n)
    spare = TOTAL - sum(counts)
    for symbol, _ in sorted(seen.items(), key=lambda x: -x[1]):
        change = max(spare, 1 - counts[symbol])
        counts[symbol] += change
        spare -= change
        if not spare:
            break
    return counts


@dataclass
class Ans:
    """A histogram with what each of ``TOTAL`` places stands for: a symbol and its place among those of the symbol."""

    counts: list[int]
    symbol: list[int]
    place: list[int]

    @staticmethod
    def of(counts: list[int]) -> Ans:
        size = len(counts)
        bucket = TOTAL // size
        # Each symbol owns a bucket; what does not fit goes to buckets with room, by the format's order of pairing.
        cutoff, other, start = list(counts), [0] * size, [0] * size
        if TOTAL in counts:
            s = counts.index(TOTAL)
            return Ans(counts, [s] * TOTAL, list(range(TOTAL)))
        low = [i for i in range(size) if counts[i] < bucket]
        high = [i for i in range(size) if counts[i] > bucket]
        while low and high:
            giver, taker = high.pop(), low.pop()
            cutoff[giver] -= bucket - cutoff[taker]
            other[taker], start[taker] = giver, cutoff[giver]
            if cutoff[giver] < bucket:
                low.append(giver)
            elif cutoff[giver] > bucket:
                high.append(giver)
        symbol, place = [], []
        for i in range(size):
            own = min(cutoff[i], bucket)
            symbol += [i] * own + [other[i]] * (bucket - own)
            place += [*range(own), *range(start[i], start[i] + bucket - own)]
        return Ans(counts, symbol, place)

    def slots(self) -> dict[int, list[int]]:
        """For each symbol the places that stand for it, in their order."""
        out: dict[int, list[int]] = {s: [0] * c for s, c in enumerate(self.counts) if c}
        for at, (s, p) in enumerate(zip(self.symbol, self.place, strict=True)):
            out[s][p] = at
        return out


@dataclass
class Prefix:
    """A look-up table by the next ``width`` bits: symbol and length."""

    width: int
    table: list[tuple[int, int]]

    @staticmethod
    def of(lengths: dict[int, int]) -> Prefix:
        """Canonical codes of ``lengths`` by symbol; a single symbol takes no bits."""
        if len(lengths) == 1:
            return Prefix(0, [(next(iter(lengths)), 0)])
        width = max(lengths.values(), default=0)
        table: list[tuple[int, int]] = [(-1, 0)] * (1 << width)
        code = 0
        for n, symbol in sorted((n, s) for s, n in lengths.items()):
            first = int(f"{code >> width - n:0{n}b}"[::-1], 2)
            for at in range(first, 1 << width, 1 << n):
                table[at] = (symbol, n)
            code += 1 << width - n
        if code != 1 << width:
            raise BadImage("a prefix code is not full")
        return Prefix(width, table)

    @staticmethod
    def read(bits: LowBits, size: int) -> Prefix:
        if size == 1:
            return Prefix.of({0: 0})
        skip = bits.take(2)
        if skip == 1:
            n = bits.take(2) + 1
            symbols = [bits.take((size - 1).bit_length()) for _ in range(n)]
            lengths = {1: [0], 2: [1, 1], 3: [1, 2, 2], 4: [2, 2, 2, 2]}[n]
            if n == 4 and bits.take(1):
                lengths = [1, 2, 3, 3]
            if max(symbols) >= size or len(set(symbols)) < n:
                raise BadImage("a simple prefix code names a wrong symbol")
            return Prefix.of(dict(zip(symbols, lengths, strict=True)))
        own: dict[int, int] = {}
        room = 32
        for k in LENGTH_ORDER[skip:]:
            n = Prefix(4, _LENGTH_CODE).next(bits)
            if n:
                own[k] = n
                room -= 32 >> n
                if room <= 0:
                    break
        if room and len(own) != 1 or room < 0:
            raise BadImage("the code of code lengths is not full")
        code = Prefix.of(own)
        lengths: list[int] = []
        room, before, run, last = 1 << 15, 0, 0, 8
        while len(lengths) < size and room > 0:
            n = code.next(bits)
            if n < 16:
                lengths.append(n)
                if n:
                    room -= 1 << 15 - n
                    last = n
                before = n
                continue
            # Repeats that follow each other multiply.
            base = 2 if n == 16 else 3
            more = bits.take(base) + 3 + (((run - 2) << base) if before == n else 0)
            new = more - run if before == n else more
            run, before = more, n
            lengths += [last if n == 16 else 0] * new
            room -= (1 << 15 - last) * new if n == 16 else 0
        if room or len(lengths) > size:
            raise BadImage("a prefix code is not full")
        return Prefix.of({s: n for s, n in enumerate(lengths) if n})

    def next(self, bits: LowBits) -> int:
        at = bits.at
        symbol, n = self.table[bits.take(self.width)]
        bits.at = at + n
        return symbol


# Lengths of code lengths by four bits, lowest bit first: 0, 4, 3, then 2, 1 and 5 behind a further bit or two.
_LENGTH_CODE = [{0: (0, 2), 1: (4, 2), 2: (3, 2)}.get(k & 3, (2, 3) if not k & 4 else ((1, 4) if not k & 8 else (5, 4))) for k in range(16)]


@dataclass
class Code:
    """The codes of a stream's contexts: contexts share clusters, each with its integers and symbols."""

    clusters: list[int]
    hybrids: list[Hybrid]
    models: list[Ans] | list[Prefix]
    ans: bool
    copies: tuple[int, int, Hybrid] | None = None  # smallest symbol and length of a back-reference
    state: int = 0
    window: list[int] = field(default_factory=list)
    pending: int = 0
    source: int = 0

    @staticmethod
    def read(bits: LowBits, contexts: int, copies: bool = True) -> Code:
        found = None
        if bits.take(1):
            if not copies:
                raise BadImage("back-references where none may be")
            symbol, length = bits.choice((224, 0), (512, 0), (4096, 0), (8, 15)), bits.choice((3, 0), (4, 0), (5, 2), (9, 8))
            found = (symbol, length, Hybrid.read(bits, 8))
            contexts += 1
        clusters = read_clusters(bits, contexts)
        n = max(clusters) + 1
        ans = not bits.take(1)
        alphabet = bits.take(2) + 5 if ans else 15
        hybrids = [Hybrid.read(bits, alphabet) for _ in range(n)]
        if ans:
            return Code(clusters, hybrids, [Ans.of(read_counts(bits, alphabet)) for _ in range(n)], True, found)
        sizes = []
        for _ in range(n):
            k = bits.take(4) if bits.take(1) else None
            sizes.append(1 if k is None else 1 + (1 << k) + bits.take(k))
        if max(sizes) > 1 << 15:
            raise BadImage("a prefix code is too large")
        return Code(clusters, hybrids, [Prefix.read(bits, s) for s in sizes], False, found)

    def begin(self, bits: LowBits) -> None:
        if self.ans:
            self.state = bits.take(32)

    def finish(self) -> None:
        if self.ans and self.state != START:
            raise BadImage("a stream of symbols ends in a wrong state")

    def symbol(self, bits: LowBits, cluster: int) -> int:
        model = self.models[cluster]
        if not self.ans:
            return model.next(bits)
        at = self.state & TOTAL - 1
        s = model.symbol[at]
        state = model.counts[s] * (self.state >> PRECISION) + model.place[at]
        self.state = state << 16 | bits.take(16) if state < 1 << 16 else state
        return s

    def next(self, bits: LowBits, context: int) -> int:
        return self.value(bits, self.clusters[context])

    def value(self, bits: LowBits, cluster: int, width: int = 0) -> int:
        """The next integer; ``width`` is that of the widest channel, by which near distances are told."""
        if self.copies is None:
            return self.hybrids[cluster].value(self.symbol(bits, cluster), bits)
        if not self.pending:
            s = self.symbol(bits, cluster)
            smallest, shortest, lengths = self.copies
            if s < smallest:
                self.window.append(self.hybrids[cluster].value(s, bits))
                return self.window[-1]
            if not self.window:
                raise BadImage("a back-reference before any value")
            self.pending = lengths.value(s - smallest, bits) + shortest
            own = self.clusters[-1]
            far = self.hybrids[own].value(self.symbol(bits, own), bits)
            if width:
                far = max(NEAR[far][0] + width * NEAR[far][1] - 1, 0) if far < len(NEAR) else far - len(NEAR)
            self.source = len(self.window) - min(min(far, (1 << 20) - 1) + 1, len(self.window))
        self.pending -= 1
        self.source += 1
        self.window.append(self.window[self.source - 1])
        return self.window[-1]


def read_clusters(bits: LowBits, contexts: int) -> list[int]:
    """The cluster of each context."""
    if contexts == 1:
        return [0]
    if bits.take(1):
        n = bits.take(2)
        out = [bits.take(n) for _ in range(contexts)]
    else:
        moved = bits.take(1)
        code = Code.read(bits, 1, copies=contexts > 2)
        code.begin(bits)
        out = [code.next(bits, 0) for _ in range(contexts)]
        code.finish()
        if max(out) > 255:
            raise BadImage("too many clusters")
        if moved:
            recent = list(range(256))
            for i, k in enumerate(out):
                out[i] = recent.pop(k)
                recent.insert(0, out[i])
    if set(out) != set(range(max(out) + 1)):
        raise BadImage("a cluster without a context")
    return out


def read_permutation(bits: LowBits, code: Code, size: int, skip: int) -> list[int]:
    """Places in their new order, sent as the number of smaller ones left; the first ``skip`` stay."""
    context = lambda v: min(v.bit_length(), 7)
    n = code.next(bits, context(size))
    if n > size - skip:
        raise BadImage("a permutation is too long")
    left, out, last = list(range(skip, size)), list(range(skip)), 0
    for _ in range(n):
        last = code.next(bits, context(last))
        if last >= len(left):
            raise BadImage("a permutation leaves its range")
        out.append(left.pop(last))
    return out + left


class Plan:
    """One cluster's code for streams that share it."""

    def __init__(self, streams: list[np.ndarray], hybrid: Hybrid | None = None):
        self.hybrid = hybrid or Hybrid()
        tokens = np.concatenate([self.hybrid.tokens(np.asarray(v, dtype=np.int64))[0] for v in streams])
        largest = int(tokens.max()) if len(tokens) else 0
        self.alphabet = max(5, largest.bit_length())
        self.counts = to_counts(Counter(tokens.tolist()), 1 << self.alphabet)
        self.slots = Ans.of(self.counts).slots()

    def describe(self, out: LowBitsWriter, contexts: int) -> None:
        """The code for ``contexts`` contexts."""
        out.put(0, 1)
        if contexts > 1:
            out.put(1, 1)
            out.put(0, 2)
        out.put(0, 1)
        out.put(self.alphabet - 5, 2)
        self.hybrid.write(out, self.alphabet)
        write_counts(out, self.counts)

    def write(self, out: LowBitsWriter, values: np.ndarray) -> None:
        """Symbols go last to first through the state; a word that a step sheds is read back right after its symbol."""
        tokens, extra, sizes = self.hybrid.tokens(np.asarray(values, dtype=np.int64))
        state = START
        words: list[int | None] = []
        for t in reversed(tokens.tolist()):
            n = self.counts[t]
            shed = None
            if state >= n << 20:
                shed, state = state & 0xFFFF, state >> 16
            words.append(shed)
            state = (state // n << PRECISION) + self.slots[t][state % n]
        out.put(state, 32)
        for shed, more, n in zip(reversed(words), extra.tolist(), sizes.tolist(), strict=True):
            if shed is not None:
                out.put(shed, 16)
            out.put(more, n)


def write_stream(out: LowBitsWriter, contexts: int, values: np.ndarray, hybrid: Hybrid | None = None) -> None:
    """One cluster's code for ``contexts`` contexts and the values by it."""
    plan = Plan([values], hybrid)
    plan.describe(out, contexts)
    plan.write(out, values)
