"""JPEG XR's coefficients as bits: adaptive prefix codes, scans, coded-block patterns and the three bands of a macroblock.

Everything is written once for both directions. A port either takes a value from
the stream (``Reader``) or puts the given one there (``Writer``); both give it back,
so what adapts sees the same values on either side.
"""

from __future__ import annotations

from .jxr import HighBits, HighBitsWriter
from .raster import BadImage

# The words of each prefix code, by the number of symbols.
WORDS = {
    4: [["1", "01", "000", "001"]],
    5: [["1", "01", "001", "0000", "0001"], ["1", "000", "001", "010", "011"]],
    6: [
        ["1", "00000", "001", "00001", "01", "0001"],
        ["01", "0000", "10", "0001", "11", "001"],
        ["0000", "0001", "01", "10", "11", "001"],
        ["00000", "00001", "01", "1", "0001", "001"],
    ],
    7: [["01", "10", "11", "001", "0001", "00000", "00001"], ["1", "01", "001", "0001", "00001", "000000", "000001"]],
    8: [["10", "001", "00001", "0001", "11", "010", "00000", "011"]],
    9: [
        ["010", "00000", "0010", "00001", "00010", "1", "011", "00011", "0011"],
        ["1", "001", "010", "0001", "000001", "011", "00001", "0000000", "0000001"],
    ],
    12: [
        ["00001", "000001", "0000000", "0000001", "00100", "010", "00101", "1", "00110", "0001", "00111", "011"],
        ["0010", "00010", "000000", "000001", "0011", "010", "00011", "11", "011", "100", "00001", "101"],
        ["11", "001", "0000000", "0000001", "00001", "010", "0000010", "011", "100", "101", "0000011", "0001"],
        ["001", "11", "0000000", "00001", "00010", "010", "0000001", "011", "00011", "100", "000001", "101"],
        ["010", "1", "0000001", "0001", "0000010", "011", "00000000", "0010", "0000011", "0011", "00000001", "00001"],
    ],
}
# What each symbol speaks for, between a table and the next one.
WEIGHTS = {
    5: [[0, -1, 0, 1, 1]],
    6: [[-1, 1, 1, 1, 0, 1], [-2, 0, 0, 2, 0, 0], [-1, -1, 0, 1, -2, 0]],
    7: [[1, 0, -1, -1, -1, -1, -1]],
    9: [[2, 2, 1, 1, -1, -2, -2, -2, -3]],
    12: [[1, 1, 1, 1, 1, 0, 0, -1, 2, 1, 0, 0], [2, 2, -1, -1, -1, 0, -2, -1, 0, 0, -2, -1], [-1, 1, 0, 2, 0, 0, 0, 0, -2, 0, 1, 1], [0, 1, 0, 1, -2, 0, -1, -1, -2, -1, -2, -2]],
}
TABLE_LIMIT, WEIGHT_LIMIT = 8, 64
# Least run of each symbol and the bits that follow it, for at least 11, at least 7 and fewer places left.
RUNS = [([1, 2, 3, 5, 7], [0, 0, 1, 1, 3]), ([1, 2, 3, 5, 7], [0, 0, 1, 1, 2]), ([1, 2, 3, 4, 5], [0, 0, 0, 0, 1])]
# The same for magnitudes; one symbol more announces a wider field.
LEVELS = ([2, 3, 4, 6, 10, 14], [0, 0, 1, 2, 2, 2])
# The order of blocks' coefficients in the stream, and the first scans of the bands.
STREAM_ORDER = [0, 5, 1, 6, 10, 12, 8, 14, 2, 4, 3, 7, 9, 13, 11, 15]
LOW_SCAN = [0, 1, 4, 5, 2, 8, 6, 9, 3, 12, 10, 7, 13, 11, 14, 15]
DOWN_SCAN = [0, 4, 8, 5, 1, 12, 9, 6, 2, 13, 3, 15, 7, 10, 14, 11]
# The blocks of a macroblock in the stream's order (two by two, then two by two of these), by their place in columns.
BLOCKS = [0, 4, 1, 5, 8, 12, 9, 13, 2, 6, 3, 7, 10, 14, 11, 15]
# The block that each block's bit is predicted from; the first comes from a neighbour's.
PARENTS = {16: {1: 0, 4: 1, 5: 4, 2: 0, 3: 1, 6: 4, 7: 5, 8: 2, 9: 3, 12: 6, 13: 7, 10: 8, 11: 9, 14: 12, 15: 13}, 4: {1: 0, 2: 0, 3: 1}, 8: {1: 0, 2: 0, 3: 1, 4: 2, 5: 3, 6: 4, 7: 5}}
# For planes of so many blocks, which bits of the neighbours to the left and above foretell the first one.
NEIGHBOURS = {16: (5, 10), 4: (1, 2), 8: (1, 6)}
# Bits of a plane of eight blocks in each quarter; places of halved chroma's lowest coefficients in the stream, and the place that their joint block starts from.
QUARTERS = [(0, 2), (1, 3), (4, 6), (5, 7)]
CHROMA_ORDER, CHROMA_START = {4: [1, 2, 3], 8: [4, 1, 2, 3, 5, 6, 7]}, {4: 10, 8: 2}
# Patterns of four with one, two and three bits, in the order of their words; and the groups of a luma nibble.
ONE, TWO, THREE = [1, 2, 4, 8], [3, 5, 6, 9, 10, 12], [14, 13, 11, 7]
NIBBLES = [[0], [1, 2, 4, 8], [3, 12], [5, 6, 9, 10], [7, 11, 13, 14], [15]]
# Weights of the counts that move the number of plain bits: luma, then chroma of three whole planes; the highpass one in sixteenths.
LUMA_COUNT, CHROMA_COUNT, COUNT_GOAL = [240, 12, 1], {16: [120, 6, 8], 4: [120, 37, 2], 8: [120, 18, 1]}, 70
FIRST_BITS = [8, 4, 0]


class Prefix:
    """Words of a code and, for each eight bits that may come, the symbol and its length."""

    def __init__(self, words: list[str]):
        self.words = [(int(w, 2), len(w)) for w in words]
        self.seen = [(0, 0)] * 256
        for symbol, w in enumerate(words):
            first = int(w.ljust(8, "0"), 2)
            self.seen[first : first + (1 << 8 - len(w))] = [(symbol, len(w))] * (1 << 8 - len(w))


LOW_PLACES = list(range(1, 16))
TABLES = {n: [Prefix(w) for w in words] for n, words in WORDS.items()}
RUN_SYMBOLS = [[max(sum(run >= v for v in least) - 1, 0) for run in range(15)] for least, _ in RUNS]
LEVEL_SYMBOLS = [max(sum(size >= v for v in LEVELS[0]) - 1, 0) for size in range(18)]
PICK = [None, None, Prefix(["1", "0"]), Prefix(["1", "01", "00"]), Prefix(["1", "01", "001", "000"])]
OF_FOUR, OF_TWO = Prefix(["00", "01", "10", "11"]), Prefix(["0", "1"])
OF_PAIRS = Prefix(["00", "01", "100", "101", "110", "111"])
LAST_PLACE = Prefix(["0", "110", "10", "111"])
LOW_PATTERNS = {3: Prefix(["0", "100", "1010", "1011", "1100", "1101", "1110", "1111"]), 2: Prefix(["0", "10", "110", "111"])}


class Reader:
    def __init__(self, bits: HighBits):
        self.bits = bits

    def field(self, n: int, value: int | None = None) -> int:
        return self.bits.take(n) if n else 0

    def word(self, code: Prefix, symbol: int | None = None) -> int:
        got, n = code.seen[self.bits.peek8()]
        if not n:
            raise BadImage("a word that its code doesn't have")
        self.bits.at += n
        return got


    def low_parts(self, n: int, highs: list[int], values: list[int], places: list[int], dropped: int = 0) -> list[int]:
        """``low_part`` of the coefficients at ``places``, from one look at the stream."""
        bits, out, mask = self.bits, [0] * len(highs), (1 << n) - 1
        at, left = bits.at, len(places) * (n + 1)
        seen, bits.at = bits.take(left), at + left
        for k in places:
            left -= n
            size, high = seen >> left & mask, highs[k]
            if high:
                out[k] = (high << n) + size << dropped if high > 0 else -((-high << n) + size << dropped)
            elif size:
                left -= 1
                out[k] = -(size << dropped) if seen >> left & 1 else size << dropped
        bits.at -= left
        return out


class Writer:
    def __init__(self, out: HighBitsWriter):
        self.out = out

    def field(self, n: int, value: int | None = None) -> int:
        if n:
            self.out.put(value, n)
        return value & (1 << n) - 1

    def word(self, code: Prefix, symbol: int | None = None) -> int:
        self.out.put(*code.words[symbol])
        return symbol

    def low_parts(self, n: int, highs: list[int], values: list[int], places: list[int], dropped: int = 0) -> list[int]:
        out, held, bits, mask = [0] * len(highs), 0, 0, (1 << n) - 1
        for k in places:
            size, high = abs(values[k]) >> dropped, highs[k]
            held, bits = held << n | size & mask, bits + n
            if not high and size:
                held, bits = held << 1 | (values[k] < 0), bits + 1
            whole = (abs(high) << n) + (size & mask) << dropped
            out[k] = -whole if (high or values[k]) < 0 else whole
        self.out.put(held, bits)
        return out


class Adaptive:
    """One of several codes, changed at set places by what the symbols since the last change spoke for."""

    def __init__(self, n: int):
        self.tables, self.weights = TABLES[n], WEIGHTS.get(n)
        self.at = 1 if len(self.tables) > 2 else 0
        self.lower = self.upper = 0
        self._choose()

    def _choose(self) -> None:
        self.code = self.tables[self.at]
        if self.weights:
            self.down = self.weights[min(max(self.at - 1, 0), len(self.weights) - 1)]
            self.up = self.weights[min(self.at, len(self.weights) - 1)]

    def word(self, port, symbol: int | None = None) -> int:
        symbol = port.word(self.code, symbol)
        if self.weights:
            self.lower += self.down[symbol]
            self.upper += self.up[symbol]
        return symbol

    def settle(self) -> None:
        if not self.weights:
            return
        step = -(self.at > 0) if self.lower < -TABLE_LIMIT else 0
        if not step and self.upper > TABLE_LIMIT:
            step = int(self.at < len(self.tables) - 1)
        if step:
            self.at += step
            self.lower = self.upper = 0
            self._choose()
        else:
            self.lower, self.upper = (max(-WEIGHT_LIMIT, min(WEIGHT_LIMIT, v)) for v in (self.lower, self.upper))


class Scan:
    """An order of places in which those that are often taken move forward."""

    def __init__(self, order: list[int]):
        self.order = list(order)
        self.forget()

    def forget(self) -> None:
        self.counts = [1 << 15, *range(32, 2, -2)]

    def taken(self, k: int) -> None:
        c, o = self.counts, self.order
        c[k] += 1
        if c[k] > c[k - 1]:
            c[k - 1], c[k], o[k - 1], o[k] = c[k], c[k - 1], o[k], o[k - 1]

    def pairs(self, values: list[int], bits: int) -> list[tuple[int, int]]:
        """Run of zeros before each value that has a high part, with this part."""
        out, run = [], 0
        for k in range(1, 16):
            v = values[self.order[k]]
            high = abs(v) >> bits
            if high:
                out.append((run, -high if v < 0 else high))
                self.taken(k)
                run = 0
            else:
                run += 1
        return out

    def spread(self, pairs: list[tuple[int, int]]) -> list[int]:
        values, k = [0] * 16, 0
        for run, high in pairs:
            k += run + 1
            if k > 15:
                raise BadImage("a run beyond its block")
            values[self.order[k]] = high
            self.taken(k)
        return values


class PlainBits:
    """How many low bits of luma and chroma go uncoded."""

    def __init__(self, band: int, planes: int, chroma: int):
        self.band, self.planes, self.chroma = band, planes, chroma
        self.bits, self.state = [FIRST_BITS[band]] * 2, [0, 0]

    def count(self, luma: int, chroma: int) -> None:
        counts = [luma * LUMA_COUNT[self.band], chroma * CHROMA_COUNT[self.chroma][self.band] >> (4 if self.band == 2 and self.chroma == 16 else 0)]
        for j in range(min(2, self.planes)):
            away = counts[j] - COUNT_GOAL >> 2
            if away <= -8:
                self._move(j, max(away + 4, -16), -1, 0)
            elif away >= 8:
                self._move(j, min(away - 4, 15), 1, 15)

    def _move(self, j: int, by: int, way: int, end: int) -> None:
        self.state[j] += by
        if way * self.state[j] > 8:
            at_end = self.bits[j] == end
            self.state[j] = 8 * way if at_end else 0
            self.bits[j] += 0 if at_end else way


class Blocks:
    """Codes of the runs and levels of one band."""

    def __init__(self):
        self.first = [Adaptive(12), Adaptive(12)]
        self.next = [[Adaptive(6), Adaptive(6)], [Adaptive(6), Adaptive(6)]]
        self.level = [Adaptive(7), Adaptive(7)]

    def settle(self) -> None:
        for code in (*self.first, *self.next[0], *self.next[1], *self.level):
            code.settle()

    def code(self, port, chroma: bool, pairs: list[tuple[int, int]] | None, place: int = 1) -> list[tuple[int, int]]:
        """The pairs of a block with at least one; ``pairs`` are null when reading."""
        out: list[tuple[int, int]] = []
        follow, adjacent, steady = 1, 0, 0
        while follow or not out:
            k = len(out)
            run, value = pairs[k] if pairs else (0, 0)
            then = 0 if not pairs or k + 1 == len(pairs) else 2 if pairs[k + 1][0] else 1
            big = int(abs(value) > 1)
            if not out:
                symbol = self.first[chroma].word(port, 4 * then + 2 * big + (run == 0))
                adjacent, big, follow = symbol & 1, symbol >> 1 & 1, symbol >> 2
                steady = adjacent & follow
                negative = port.field(1, int(value < 0))
                size = magnitude(port, self.level[steady], abs(value)) if big else 1
                run = 0 if adjacent else distance(port, 15 - place, run)
                place += run + 1
            else:
                run = 0 if follow == 1 else distance(port, 15 - place, run)
                place += run + 1
                symbol = 2 * then + big
                if place < 15:
                    symbol = self.next[chroma][steady].word(port, symbol)
                else:
                    symbol = port.word(LAST_PLACE if place == 15 else OF_TWO, symbol)
                big, follow = symbol & 1, symbol >> 1
                steady &= follow
                negative = port.field(1, int(value < 0))
                size = magnitude(port, self.level[steady], abs(value)) if big else 1
            if place > 16:
                raise BadImage("coefficients beyond their block")
            out.append((run, -size if negative else size))
        return out


def distance(port, left: int, run: int) -> int:
    """A run of at least one zero when ``left`` places may be skipped."""
    if left < 2:
        return 1
    if left < 5:
        return 1 + port.word(PICK[left], run - 1)
    group = 0 if left > 10 else 1 if left > 6 else 2
    least, extra = RUNS[group]
    s = port.word(TABLES[5][0], RUN_SYMBOLS[group][run])
    return least[s] + port.field(extra[s], run - least[s])


def magnitude(port, code: Adaptive, size: int) -> int:
    """A magnitude of at least two."""
    least, extra = LEVELS
    s = code.word(port, 6 if size >= 18 else LEVEL_SYMBOLS[size])
    if s < 6:
        return least[s] + port.field(extra[s], size - least[s])
    width = (size - 2).bit_length() - 1
    if size and width > 29:
        raise BadImage("a coefficient that is too large")
    n = 4 + port.field(4, min(width - 4, 15))
    if n == 19:
        n += port.field(2, min(width - 19, 3))
        if n == 22:
            n += port.field(3, width - 22)
    return 2 + (1 << n) + port.field(n, size - 2 - (1 << n))


def low_part(port, n: int, high: int, value: int, dropped: int = 0) -> int:
    """The whole value: ``high`` is what the codes gave, moved up by ``n + dropped`` bits; a sign follows if that is zero."""
    size = port.field(n, abs(value) >> dropped)
    if high:
        whole = (abs(high) << n) + size << dropped
        return -whole if high < 0 else whole
    return -(size << dropped) if size and port.field(1, int(value < 0)) else size << dropped


class Patterns:
    """Whether blocks' bits are sent as differences, as they are or inverted, from how many were set."""

    def __init__(self):
        self.set, self.unset, self.state = [-4, -4], [4, 4], [0, 0]

    def count(self, kind: int, pattern: int, blocks: int = 16) -> None:
        n = pattern.bit_count() * 16 // blocks
        keep = lambda v: max(-16, min(15, v))
        self.set[kind], self.unset[kind] = keep(self.set[kind] + n - 3), keep(self.unset[kind] + 13 - n)
        rare, full = self.set[kind] < 0, self.unset[kind] < 0
        self.state[kind] = (1 if self.set[kind] < self.unset[kind] else 2) if rare else 2 if full else 0

    def differences(self, kind: int, pattern: int, seed: int, blocks: int = 16) -> int:
        if self.state[kind]:
            return pattern if self.state[kind] == 1 else pattern ^ (1 << blocks) - 1
        bit = lambda j: pattern >> j & 1
        return bit(0) ^ seed | sum((bit(j) ^ bit(p)) << j for j, p in PARENTS[blocks].items())

    def pattern(self, kind: int, sent: int, seed: int, blocks: int = 16) -> int:
        if self.state[kind]:
            return sent if self.state[kind] == 1 else sent ^ (1 << blocks) - 1
        out = sent & 1 ^ seed
        for j, p in PARENTS[blocks].items():
            out |= (sent >> j & 1 ^ out >> p & 1) << j
        return out


def four(port, count: int, pattern: int) -> int:
    """Which of four with ``count`` set."""
    if count in (0, 4):
        return 0 if count == 0 else 15
    among = (ONE, TWO, THREE)[count - 1]
    return among[port.word(OF_PAIRS if count == 2 else OF_FOUR, among.index(pattern) if pattern.bit_count() == count else 0)]


class Macroblocks:
    """All that adapts over a tile, and the three bands of its macroblocks."""

    def __init__(self, planes: int, flexible: bool = True, dropped: int = 0, chroma: int = 16):
        self.planes, self.flexible, self.dropped, self.chroma = planes, flexible, dropped, chroma
        self.blocks = [16] + [chroma] * (planes - 1)
        self.dc_kind, self.dc_level = Adaptive(8), [Adaptive(7), Adaptive(7)]
        self.low, self.high = Blocks(), Blocks()
        self.superblocks, self.nibbles, self.chroma_blocks = Adaptive(5), Adaptive(9 if planes == 3 else 5), Adaptive(4)
        across = [STREAM_ORDER[k] for k in LOW_SCAN]
        self.low_scan, self.scans = Scan(LOW_SCAN), [Scan(across), Scan([STREAM_ORDER[k] for k in DOWN_SCAN])]
        self.dc_bits, self.low_bits, self.high_bits = (PlainBits(b, planes, chroma) for b in range(3))
        self.full, self.none = 1, 1
        self.patterns = Patterns()

    def dc(self, port, values: list[int]) -> list[int]:
        """The lowest coefficient of each plane."""
        bits = [self.dc_bits.bits[c > 0] for c in range(self.planes)]
        highs = [abs(v) >> n for v, n in zip(values, bits, strict=True)]
        if self.planes == 3:
            kind = self.dc_kind.word(port, sum((h > 0) << 2 - c for c, h in enumerate(highs)))
        out, counts = [], [0, 0]
        for c in range(self.planes):
            there = kind >> 2 - c & 1 if self.planes == 3 else port.field(1, int(highs[c] > 0))
            size = magnitude(port, self.dc_level[c > 0], highs[c] + 1) - 1 if there else 0
            counts[c > 0] += there
            size = size << bits[c] | port.field(bits[c], abs(values[c]))
            out.append(-size if size and port.field(1, int(values[c] < 0)) else size)
        self.dc_bits.count(*counts)
        return out

    def lowpass(self, port, given: list[list[int]] | None, forget: bool, settle: bool) -> list[list[int]]:
        """The other fifteen of the lowest coefficients of each block, by plane; the first place is unused."""
        if forget:
            self.low_scan.forget()
        joint = self.chroma < 16
        bits = [self.low_bits.bits[c > 0] for c in range(1 if joint else self.planes)]
        pairs = [self.low_scan.pairs(v, n) for v, n in zip(given, bits, strict=False)] if given else None
        if joint and given:
            pairs.append(self._joint_pairs(given))
        which = self._which(port, sum(bool(p) << c for c, p in enumerate(pairs)) if given else 0)
        out, counts = [], [0, 0]
        for c, n in enumerate(bits):
            found = self.low.code(port, c > 0, pairs[c] if given else None) if which >> c & 1 else []
            counts[c > 0] += len(found)
            if given:
                highs = [0] + [(-1 if v < 0 else 1) * (abs(v) >> n) for v in given[c][1:]]
            else:
                highs = self.low_scan.spread(found)
            out.append(port.low_parts(n, highs, given[c] if given else highs, LOW_PLACES) if n else [0, *highs[1:]])
        if joint:
            found = self.low.code(port, True, pairs[1] if given else None, CHROMA_START[self.chroma]) if which & 2 else []
            counts[1] += len(found)
            out += self._joint(port, given, found)
        self.low_bits.count(*counts)
        if settle:
            for code in (self.dc_kind, *self.dc_level):
                code.settle()
            self.low.settle()
        return out

    def _which(self, port, which: int) -> int:
        """Which planes (halved chroma's two count as one) have coded lowpass coefficients."""
        if self.planes == 1:
            return port.field(1, which)
        n = 3 if self.chroma == 16 else 2
        every = (1 << n) - 1
        if self.none <= 0 or self.full < 0:
            turn = self.full < self.none
            which = port.word(LOW_PATTERNS[n], every - which if turn else which)
            which = every - which if turn else which
        else:
            which = port.field(n, which)
        self.full = max(-8, min(7, self.full + 1 - 4 * (which == every)))
        self.none = max(-8, min(7, self.none + 1 - 4 * (which == 0)))
        return which

    def _joint_pairs(self, given: list[list[int]]) -> list[tuple[int, int]]:
        out, run, n = [], 0, self.low_bits.bits[1]
        for v in (given[c][k] for k in CHROMA_ORDER[self.chroma] for c in (1, 2)):
            high = abs(v) >> n
            if high:
                out.append((run, -high if v < 0 else high))
            run = 0 if high else run + 1
        return out

    def _joint(self, port, given, found: list[tuple[int, int]]) -> list[list[int]]:
        n, order = self.low_bits.bits[1], CHROMA_ORDER[self.chroma]
        highs, at = [[0] * self.chroma, [0] * self.chroma], 0
        for run, high in found:
            at += run
            if at >= 2 * len(order):
                raise BadImage("a run beyond its block")
            highs[at % 2][order[at // 2]] = high
            at += 1
        for k in range(1, self.chroma) if n else ():
            for c in range(2):
                highs[c][k] = low_part(port, n, highs[c][k], given[c + 1][k] if given else 0)
        return highs

    def highpass(self, port, flex, given, scan: int, seeds: list[int], forget: bool, settle: bool):
        """Patterns and the coefficients of all blocks of each plane, in the stream's order of blocks. ``seeds`` are the neighbours' bits."""
        if forget:
            for s in self.scans:
                s.forget()
        bits = [self.high_bits.bits[c > 0] for c in range(self.planes)]
        patterns = [sum(any(abs(v) >> n for v in b[1:]) << j for j, b in enumerate(blocks)) for blocks, n in zip(given, bits, strict=True)] if given else []
        sent = []
        for c, p in enumerate(patterns):
            sent.append(self.patterns.differences(int(c > 0), p, seeds[c], self.blocks[c]))
            self.patterns.count(int(c > 0), p, self.blocks[c])
        sent = self._patterns(port, sent or [0] * self.planes)
        if not given:
            for c, s in enumerate(sent):
                patterns.append(self.patterns.pattern(int(c > 0), s, seeds[c], self.blocks[c]))
                self.patterns.count(int(c > 0), patterns[c], self.blocks[c])
        order, out, counts = self.scans[scan], [], [0, 0]
        for c, n in enumerate(bits):
            rest = max(n - self.dropped, 0) if self.flexible else 0
            lost = n - rest
            blocks = []
            for j in range(self.blocks[c]):
                values = given[c][j] if given else [0] * 16
                highs = [0] * 16
                if patterns[c] >> j & 1:
                    found = self.high.code(port, c > 0, order.pairs(values, n) if given else None)
                    counts[c > 0] += len(found)
                    highs = order.spread(found) if not given else [(-1 if v < 0 else 1) * (abs(v) >> n) for v in values]
                blocks.append(flex.low_parts(rest, highs, values, STREAM_ORDER[1:], lost) if rest else [v << n if v >= 0 else -(-v << n) for v in highs])
            out.append(blocks)
        self.high_bits.count(*counts)
        if settle:
            self.superblocks.settle()
            self.nibbles.settle()
            self.high.settle()
        return patterns, out

    @staticmethod
    def _quarter(pattern: int, q: int, blocks: int) -> int:
        if blocks == 8:
            return sum((pattern >> j & 1) << i for i, j in enumerate(QUARTERS[q]))
        return pattern >> q & 1 if blocks == 4 else pattern >> 4 * q & 15

    def _patterns(self, port, sent: list[int]) -> list[int]:
        """Sixteen bits of each plane: grey planes alone, three planes together by quarters."""
        got = [0] * self.planes
        parts = [[self._quarter(p, q, self.blocks[c]) for c, p in enumerate(sent)] for q in range(4)]
        there = sum(any(part) << q for q, part in enumerate(parts))
        there = four(port, self.superblocks.word(port, there.bit_count()), there)
        for q in range(4):
            if not there >> q & 1:
                continue
            part = parts[q]
            group = next(g for g, held in enumerate(NIBBLES) if part[0] in held)
            chroma = sum((v > 0) << k for k, v in enumerate(part[1:]))
            symbol = self.nibbles.word(port, max(group - 1, 0) if not chroma else min(group + 5, 8))
            if symbol < 5:
                group, chroma = symbol + 1, 0
            else:
                chroma = 1 + port.word(PICK[3], chroma - 1)
                group = symbol - 5 if symbol < 8 else 3 + port.word(PICK[3], group - 3)
            held = NIBBLES[group]
            pick = held.index(part[0]) if part[0] in held else 0
            luma = held[port.word(OF_FOUR if len(held) == 4 else OF_TWO, pick)] if len(held) > 1 else held[0]
            got[0] |= luma << 4 * q
            for k in range(2):
                if not chroma >> k & 1:
                    continue
                if self.chroma == 4:
                    got[k + 1] |= 1 << q
                elif self.chroma == 8:
                    two = 1 + port.word(PICK[3], part[k + 1] - 1)
                    got[k + 1] |= sum((two >> i & 1) << j for i, j in enumerate(QUARTERS[q]))
                else:
                    n = 1 + self.chroma_blocks.word(port, part[k + 1].bit_count() - 1)
                    got[k + 1] |= four(port, n, part[k + 1]) << 4 * q
        return got
