"""Vectorised text helpers that run inside Arrow tasks.

Every helper works on one Arrow batch of texts as a single byte buffer: words
are found by byte class, hashed by differences of one running polynomial, and
handed back as flat numpy arrays with the row of each word. Nothing here loops
over words in Python.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U64 = np.uint64
#: Of the GNU C library; other systems give memory back by themselves.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, size=(2, 256), dtype=np.int64).astype(_U64) | _U64(1)
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INV = tuple(pow(b, -1, 2**64) for b in _BASE)
_CHUNK = 1 << 17
_POW: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for one chunk of bytes."""
    while len(_POW) <= which:
        k = len(_POW)
        with np.errstate(over="ignore"):
            both = []
            for b in (_BASE[k], _INV[k]):
                a = np.full(_CHUNK + 1, b, dtype=_U64)
                a[0] = 1
                both.append(np.multiply.accumulate(a))
        _POW.append(tuple(both))
    return _POW[which]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


#: Byte classes: the six white-space bytes of `[\x20\x09-\x0D]`, and A-Z folded to a-z.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and the row bounds in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    return data[at[0] : at[-1]] if len(at) else data[:0], at - at[0]


def lowered(texts: pa.Array) -> pa.Array:
    """Texts in lower case, letters of all scripts."""
    return pc.utf8_lower(texts.cast(pa.large_string()))


def give_back() -> None:
    """Hands memory that is free again back to the system: workers wait for their next task beside other stages, and what they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def batches(it, rows: int = 4096, size: int = 2 << 20):
    """Batches of about `size` bytes at most, so that long texts don't pile up; one long text stays whole."""
    for b in it:
        if not b.num_rows:
            continue
        per = max(1, int(b.num_rows * size / max(1, b.nbytes)))
        step, done = min(rows, per), 0
        while done < b.num_rows:
            part = b.slice(done, step)
            done += part.num_rows
            yield part
        give_back()


def words(data: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes outside `apart`; runs stop at row bounds."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~apart[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    touching = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
    flips = np.flatnonzero(edge)
    if len(touching):
        flips = np.sort(np.concatenate([flips, touching, touching]), kind="stable")
    start, end = flips[0::2], flips[1::2]
    return start, end, np.searchsorted(at, start, side="right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = FOLD, which: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; spans are in ascending order and don't overlap."""
    out = np.empty(len(start), dtype=_U64)
    pos, inv = _powers(which)
    table = _BYTE[which][fold]
    done = 0
    while done < len(start):
        base = start[done]
        stop = int(np.searchsorted(end, base + _CHUNK, side="right"))
        if stop <= done:  # one span longer than a chunk
            out[done] = _long_hash(data[start[done] : end[done]], table, which)
            done += 1
            continue
        part = table[data[base : end[stop - 1]]]
        with np.errstate(over="ignore"):
            run = np.zeros(len(part) + 1, dtype=_U64)
            np.cumsum(part * pos[: len(part)], out=run[1:])
            s, e = start[done:stop] - base, end[done:stop] - base
            out[done:stop] = mix((run[e] - run[s]) * inv[s] + (e - s).astype(_U64) * _U64(0xA24BAED4963EE407))
        done = stop
    return out


def _long_hash(data: np.ndarray, table: np.ndarray, which: int) -> np.uint64:
    pos, _ = _powers(which)
    with np.errstate(over="ignore"):
        h, shift = _U64(0), _U64(1)
        for k in range(0, len(data), _CHUNK):
            part = table[data[k : k + _CHUNK]]
            h = h + np.sum(part * pos[: len(part)], dtype=_U64) * shift
            shift = shift * pos[_CHUNK]
        return mix(np.array([h + _U64(len(data)) * _U64(0xA24BAED4963EE407)]))[0]


def shingles(h: np.ndarray, row: np.ndarray, rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each `width`-word shingle; a row of fewer words gives its whole sequence as one."""
    n = len(h)
    count = np.bincount(row, minlength=rows) if n else np.zeros(rows, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    with np.errstate(over="ignore"):
        m = max(0, n - width + 1)
        acc = np.zeros(m, dtype=_U64)
        for k in range(width):
            acc = acc * _U64(0x9FB21C651E98DF25) + h[k : k + m]
        keep = row[: len(acc)] == row[width - 1 :] if len(acc) else np.zeros(0, dtype=bool)
        out, owner = mix(acc[keep]), row[: len(acc)][keep]
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            extra = np.zeros(len(short), dtype=_U64)
            for k in range(width - 1):
                has = count[short] > k
                at = np.minimum(first[short] + k, n - 1)
                extra = np.where(has, extra * _U64(0x9FB21C651E98DF25) + h[at], extra)
            extra = mix(extra + count[short].astype(_U64) * _U64(0xE7037ED1A0B428DB))
            out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
            by = np.argsort(owner, kind="stable")
            out, owner = out[by], owner[by]
    return out, owner


def distinct_per_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row and hash."""
    if not len(h):
        return h, row
    by = np.argsort(h)
    by = by[np.argsort(row[by], kind="stable")]
    h, row = h[by], row[by]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
    return h[keep], row[keep]
