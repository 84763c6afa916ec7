"""A second decoder, written from the format's specification alone: bit lists, dictionaries of codewords, the transform by its definition. Slow, for tests."""

import math


class Out(Exception):
    """Past the last bit."""


class Bits:
    def __init__(self, data):
        self.bits, self.at = [byte >> i & 1 for byte in data for i in range(8)], 0

    def u(self, n):
        if self.at + n > len(self.bits):
            raise Out
        self.at += n
        return sum(b << i for i, b in enumerate(self.bits[self.at - n : self.at]))


def high_bit(x):
    n = 0
    while x:
        n, x = n + 1, x >> 1
    return n


def unpack(x):
    return (x & 0x1FFFFF) * (-1 if x >> 31 else 1) * 2.0 ** ((x >> 21 & 0x3FF) - 788)


class Book:
    def __init__(self, b):
        assert b.u(24) == 0x564342
        self.dims, n, ordered = b.u(16), b.u(24), b.u(1)
        lengths = []
        if ordered:
            k = b.u(5) + 1
            while len(lengths) < n:
                lengths += [k] * b.u(high_bit(n - len(lengths)))
                k += 1
        else:
            sparse = b.u(1)
            for _ in range(n):
                lengths.append(0 if sparse and not b.u(1) else b.u(5) + 1)
        # each codeword is the lowest of its length that neither begins another nor begins with one
        self.codes = {}
        for entry, k in enumerate(lengths):
            if k:
                taken = [(c >> max(0, m - k) << max(0, k - m), (c >> max(0, m - k) << max(0, k - m)) + (1 << max(0, k - m))) for m, c in self.codes]
                code = 0
                while any(lo <= code < hi for lo, hi in taken):
                    code += 1
                self.codes[k, code] = entry
        self.single = len(self.codes) == 1
        kind = b.u(4)
        self.vectors = None
        if kind:
            low, step, width, sequence = unpack(b.u(32)), unpack(b.u(32)), b.u(4) + 1, b.u(1)
            base = max(r for r in range(n + 2) if r**self.dims <= n) if kind == 1 else 0
            raw = [b.u(width) for _ in range(base if kind == 1 else n * self.dims)]
            self.vectors = []
            for e in range(n):
                v, last = [], 0.0
                for j in range(self.dims):
                    at = e // base**j % base if kind == 1 else e * self.dims + j
                    v.append(raw[at] * step + low + last)
                    last = v[-1] if sequence else 0.0
                self.vectors.append(v)

    def scalar(self, b):
        code = 0
        for k in range(1, 33):
            code = code << 1 | b.u(1)
            if self.single:
                return next(iter(self.codes.values()))
            if (k, code) in self.codes:
                return self.codes[k, code]
        raise Out

    def vector(self, b):
        return self.vectors[self.scalar(b)]


class Stream:
    def __init__(self, ident, setup):
        b = Bits(ident[7:])
        assert b.u(32) == 0
        self.channels, self.rate = b.u(8), b.u(32)
        b.u(96)
        self.sizes = 1 << b.u(4), 1 << b.u(4)
        b = Bits(setup[7:])
        self.books = [Book(b) for _ in range(b.u(8) + 1)]
        assert not any([b.u(16) for _ in range(b.u(6) + 1)])
        self.floors = [self.read_floor(b) for _ in range(b.u(6) + 1)]
        self.residues = [self.read_residue(b) for _ in range(b.u(6) + 1)]
        self.mappings = [self.read_mapping(b) for _ in range(b.u(6) + 1)]
        self.modes = [(b.u(1), b.u(32), b.u(8)) for _ in range(b.u(6) + 1)]
        assert b.u(1) == 1
        self.half = None

    def read_floor(self, b):
        if b.u(16) == 0:
            return {"order": b.u(8), "rate": b.u(16), "map": b.u(16), "bits": b.u(6), "offset": b.u(8), "books": [b.u(8) for _ in range(b.u(4) + 1)]}
        classes = [b.u(4) for _ in range(b.u(5))]
        dims, subs, masters, books = [], [], [], []
        for _ in range(max(classes, default=-1) + 1):
            dims.append(b.u(3) + 1)
            subs.append(b.u(2))
            masters.append(b.u(8) if subs[-1] else None)
            books.append([b.u(8) - 1 for _ in range(2 ** subs[-1])])
        multiplier, width = b.u(2) + 1, b.u(4)
        xs = [0, 2**width]
        for c in classes:
            xs += [b.u(width) for _ in range(dims[c])]
        return {"classes": classes, "dims": dims, "subs": subs, "masters": masters, "sub_books": books, "multiplier": multiplier, "xs": xs}

    def read_residue(self, b):
        r = {"kind": b.u(16), "begin": b.u(24), "end": b.u(24), "size": b.u(24) + 1, "classes": b.u(6) + 1, "book": b.u(8)}
        stages = []
        for _ in range(r["classes"]):
            low = b.u(3)
            stages.append(low + (b.u(5) << 3 if b.u(1) else 0))
        r["books"] = [[b.u(8) if s >> k & 1 else None for k in range(8)] for s in stages]
        return r

    def read_mapping(self, b):
        assert b.u(16) == 0
        n = b.u(4) + 1 if b.u(1) else 1
        steps = []
        if b.u(1):
            width = high_bit(self.channels - 1)
            steps = [(b.u(width), b.u(width)) for _ in range(b.u(8) + 1)]
        assert b.u(2) == 0
        mux = [b.u(4) for _ in range(self.channels)] if n > 1 else [0] * self.channels
        return steps, mux, [(b.u(8), b.u(8), b.u(8))[1:] for _ in range(n)]

    def floor(self, b, f, n):
        """The floor curve, None if unused."""
        if "order" in f:
            amplitude = b.u(f["bits"])
            if not amplitude:
                return None
            book, c, last = self.books[f["books"][b.u(high_bit(len(f["books"])))]], [], 0.0
            while len(c) < f["order"]:
                v = [x + last for x in book.vector(b)]
                c, last = c + v, v[-1]
            bark = lambda x: 13.1 * math.atan(0.00074 * x) + 2.24 * math.atan(0.0000000185 * x * x) + 0.0001 * x
            curve = []
            for i in range(n):
                w = math.pi * min(f["map"] - 1, math.floor(bark(f["rate"] * i / (2 * n)) * f["map"] / bark(0.5 * f["rate"]))) / f["map"]
                odd, even = (math.prod(4 * (math.cos(x) - math.cos(w)) ** 2 for x in c[k : f["order"] : 2]) for k in (1, 0))
                p, q = (odd * (1 - math.cos(w) ** 2), even / 4) if f["order"] % 2 else (odd * (1 - math.cos(w)) / 2, even * (1 + math.cos(w)) / 2)
                curve.append(math.exp(0.11512925 * (amplitude * f["offset"] / ((2 ** f["bits"] - 1) * math.sqrt(p + q)) - f["offset"])))
            return curve
        if not b.u(1):
            return None
        top = (256, 128, 86, 64)[f["multiplier"] - 1]
        ys = [b.u(high_bit(top - 1)), b.u(high_bit(top - 1))]
        for c in f["classes"]:
            value = self.books[f["masters"][c]].scalar(b) if f["subs"][c] else 0
            for _ in range(f["dims"][c]):
                book = f["sub_books"][c][value % 2 ** f["subs"][c]]
                value //= 2 ** f["subs"][c]
                ys.append(self.books[book].scalar(b) if book >= 0 else 0)
        xs = f["xs"]
        line = lambda x0, y0, x1, y1, x: y0 + int(math.copysign(abs(y1 - y0) * (x - x0) // (x1 - x0), y1 - y0))
        shown, final = [True, True], ys[:2]
        for i in range(2, len(xs)):
            lo, hi = max((x for x in xs[:i] if x < xs[i])), min((x for x in xs[:i] if x > xs[i]))
            lo, hi = xs.index(lo), xs.index(hi)
            guess = line(xs[lo], final[lo], xs[hi], final[hi], xs[i])
            up, down, v = top - guess, guess, ys[i]
            shown.append(v > 0)
            if v:
                shown[lo] = shown[hi] = True
            if v == 0:
                final.append(guess)
            elif v >= 2 * min(up, down):
                final.append(v - down + guess if up > down else guess - v + up - 1)
            else:
                final.append(guess - (v + 1) // 2 if v % 2 else guess + v // 2)
        points = sorted((x, min(max(y, 0), top - 1) * f["multiplier"]) for x, y, s in zip(xs, final, shown, strict=True) if s)
        curve = []
        for x in range(n):
            k = max(i for i, (px, _) in enumerate(points) if px <= x)
            y = points[k][1] if k == len(points) - 1 else line(*points[k], *points[k + 1], x)
            curve.append(10 ** (7 * (y + 1) / 256 - 7))
        return curve

    def residue(self, b, r, used, n):
        """Residue vectors of channels; what the packet doesn't reach stays zero."""
        if r["kind"] == 2:
            both = self.vectors(b, r, [any(used)], n * len(used))[0]
            return [both[c :: len(used)] for c in range(len(used))]
        return self.vectors(b, r, used, n)

    def vectors(self, b, r, used, n):
        out = [[0.0] * n for _ in used]
        begin, end = min(r["begin"], n), min(r["end"], n)
        parts, words = (end - begin) // r["size"], self.books[r["book"]]
        classes = [{} for _ in used]
        if not any(used):
            return out
        try:
            for stage in range(7):
                for p in range(parts):
                    if stage == 0 and p % words.dims == 0:
                        for c, u in enumerate(used):
                            if u:
                                value = words.scalar(b)
                                for k in reversed(range(words.dims)):
                                    classes[c][p + k], value = value % r["classes"], value // r["classes"]
                    for c, u in enumerate(used):
                        book = r["books"][classes[c][p]][stage] if u else None
                        if book is not None:
                            self.partition(b, r, self.books[book], out[c], begin + p * r["size"])
        except Out:
            pass
        return out

    def partition(self, b, r, book, v, at):
        if r["kind"] == 0:
            step = r["size"] // book.dims
            for i in range(step):
                for j, x in enumerate(book.vector(b)):
                    v[at + i + j * step] += x
        else:
            i = 0
            while i < r["size"]:
                got = book.vector(b)
                if at + i + len(got) > len(v):
                    return
                for x in got:
                    v[at + i] += x
                    i += 1

    def decode(self, data):
        """Samples by channel that the packet completes."""
        b = Bits(data)
        assert b.u(1) == 0
        long, _, mapping = self.modes[b.u(high_bit(len(self.modes) - 1))]
        before, after = (b.u(1), b.u(1)) if long else (0, 0)
        n, short = self.sizes[long], self.sizes[0]
        steps, mux, submaps = self.mappings[mapping]
        floors = []
        for c in range(self.channels):
            try:
                floors.append(self.floor(b, self.floors[submaps[mux[c]][0]], n // 2))
            except Out:
                floors.append(None)
        used = [f is not None for f in floors]
        for m, a in steps:
            used[m] = used[a] = used[m] or used[a]
        spectrum = [None] * self.channels
        for s, (_, residue) in enumerate(submaps):
            mine = [c for c in range(self.channels) if mux[c] == s]
            for c, v in zip(mine, self.residue(b, self.residues[residue], [used[c] for c in mine], n // 2), strict=True):
                spectrum[c] = v
        for m, a in reversed(steps):
            for i in range(n // 2):
                x, y = spectrum[m][i], spectrum[a][i]
                spectrum[m][i], spectrum[a][i] = ((x, x - y) if y > 0 else (x + y, x)) if x > 0 else ((x, x + y) if y > 0 else (x - y, x))
        pcm = []
        for f, v in zip(floors, spectrum, strict=True):
            x = [(k, p * q) for k, (p, q) in enumerate(zip(f or [0.0] * (n // 2), v, strict=True)) if p * q]
            pcm.append([sum(a * math.cos(2 * math.pi / n * (i + 0.5 + n / 4) * (k + 0.5)) for k, a in x) for i in range(n)])
        left = (n // 4 - short // 4, n // 4 + short // 4) if long and not before else (0, n // 2)
        right = (3 * n // 4 - short // 4, 3 * n // 4 + short // 4) if long and not after else (n // 2, n)
        half, self.half = self.half, [c[right[0] : right[1]] for c in pcm]
        if half is None:
            return [[] for _ in pcm]
        size = left[1] - left[0]
        rise = lambda i: math.sin(math.pi / 2 * math.sin((i + 0.5) / size * math.pi / 2) ** 2)
        assert len(half[0]) <= size
        for c, old in zip(pcm, half, strict=True):
            for i, x in enumerate(old):
                c[left[0] + i] = c[left[0] + i] * rise(i) + x * rise(size - 1 - i)
        return [c[left[0] : right[0]] for c in pcm]
