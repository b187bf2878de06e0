"""Words of whole UTF-8 texts as 64-bit hashes, by numpy over the raw bytes.

A-Z count as a-z. A word is a maximal run of the bytes that a word class holds. Its hash is a polynomial over
seeded byte values, read off one running sum per segment, so that the cost is per byte and not per word.
"""

import hashlib

import numpy as np

SEGMENT, SLICE, SLICE_BYTES = 1 << 18, 1024, 8 << 20
MULTIPLIER = 0x9E3779B97F4A7C13


def _class(separators) -> np.ndarray:
    kind = np.ones(256, dtype=bool)
    kind[list(separators)] = False
    return kind


#: [^\x20\x09-\x0D]+
BLANK_SPLIT = _class([0x20, *range(0x09, 0x0E)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
ALNUM = _class([b for b in range(128) if not chr(b).isalnum()])


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer: each bit of the result depends on all bits of x."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    values[65:91] = values[97:123]
    return values


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, MULTIPLIER, dtype=np.uint64)
    up[0] = 1
    down = np.full(n, pow(MULTIPLIER, -1, 1 << 64), dtype=np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class WordHasher:
    """``words(data)`` gives starts, ends (bytes) and hashes of the words in data, which has any length."""

    def __init__(self, word_class: np.ndarray, segment: int = SEGMENT, prefix: int = 0):
        """prefix: hash only so many leading bytes of each word."""
        self.kind, self.segment, self.values, self.prefix = word_class, segment, _byte_values(), prefix
        self.up, self.down = _powers(segment + 1)
        self.lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        edge = np.zeros(n + 2, dtype=np.int8)
        edge[1:-1] = self.kind[data]
        step = np.diff(edge)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=total[1:])
        stop = np.minimum(ends, starts + self.prefix) if self.prefix else ends
        raw = (total[stop] - total[starts]) * self.down[starts]
        return starts, ends, mix(raw + (stop - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = np.frombuffer(data, dtype=np.uint8)
        if len(whole) <= self.segment:
            return self._piece(whole)
        parts, at = [], 0
        while at < len(whole):
            end = min(at + self.segment, len(whole))
            if end < len(whole):
                gap = np.flatnonzero(~self.kind[whole[at:end]])
                if len(gap):
                    end = at + int(gap[-1]) + 1
                else:  # one word longer than a segment
                    while end < len(whole) and self.kind[whole[end]]:
                        end += 1
                    digest = hashlib.blake2b(data[at : at + self.prefix if self.prefix else end].translate(self.lower), digest_size=8).digest()
                    parts.append((np.array([at]), np.array([end]), np.frombuffer(digest, dtype=np.uint64)))
                    at = end
                    continue
            s, e, h = self._piece(whole[at:end])
            parts.append((s + at, e + at, h))
            at = end
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def documents(self, texts: list):
        """Yields (first index, hashes, bounds) for runs of texts of about one segment: text first + i has
        hashes[bounds[i]:bounds[i + 1]]. None counts as empty."""
        at = 0
        while at < len(texts):
            run, size, first = [], 0, at
            while at < len(texts) and (not run or size + len(texts[at] or b"") < self.segment):
                run.append(texts[at] or b"")
                size += len(run[-1]) + 1
                at += 1
            starts, _, hashes = self.words(b"\n".join(run))
            begins = np.cumsum([0, *(len(x) + 1 for x in run)])
            yield first, hashes, np.searchsorted(starts, begins)


def slices(batches, column: str | None = "text", rows: int = SLICE):
    """The batches in slices of at most ``rows`` rows whose texts hold about ``SLICE_BYTES`` (a longer text is a slice
    of its own), so that a worker never holds a whole batch as Python values."""
    import pyarrow.compute as pc

    for batch in batches:
        if column is None or column not in batch.schema.names:
            cuts = [*range(0, batch.num_rows, rows), batch.num_rows]
        else:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            total = np.cumsum(sizes, dtype=np.int64)
            cuts = [0]
            while cuts[-1] < batch.num_rows:
                at = cuts[-1]
                before = int(total[at - 1]) if at else 0
                by_size = int(np.searchsorted(total, before + SLICE_BYTES, side="right"))
                cuts.append(min(batch.num_rows, at + rows, max(at + 1, by_size)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(batch, column: str = "text") -> list:
    """The column's values as UTF-8 bytes."""
    import pyarrow as pa

    values = batch.column(column)
    return values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()


class Vocabulary:
    """Positions of word hashes in a sorted table; other words get its size."""

    def __init__(self, hashes: np.ndarray):
        self.table = np.unique(hashes)
        self.mask = np.zeros(1 << 20, dtype=bool)
        self.mask[self.table >> np.uint64(44)] = True

    def __len__(self) -> int:
        return len(self.table)

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), len(self.table), dtype=np.int32)
        maybe = np.flatnonzero(self.mask[hashes >> np.uint64(44)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.table, hashes[maybe]), len(self.table) - 1)
            hit = self.table[at] == hashes[maybe]
            out[maybe[hit]] = at[hit]
        return out
