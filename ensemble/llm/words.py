"""Vectorised words of whole texts: one 64-bit hash per word, from the UTF-8 bytes.

Words are the maximal runs of bytes other than space and 0x09-0x0D, with A-Z
lower-cased. A word's hash is a polynomial over per-byte random values modulo
2**64 with a final mix, so it depends on the word's bytes alone. Texts are
hashed in segments of ``SEGMENT`` bytes cut at white space, which bounds the
working memory whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (a bijection)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_POW = _INV = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of them."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 16)
        _POW, _INV = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]), dtype=np.uint64)
                      for x in (_BASE, _U(pow(int(_BASE), -1, 1 << 64))))
    return _POW, _INV


def _segment(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of one byte buffer."""
    space = np.empty(len(buf) + 2, dtype=bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    power, inverse = _powers(len(buf))
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    vals = _BYTES[buf]
    vals *= power[: len(buf)]
    np.cumsum(vals, out=sums[1:])
    # a word's part of the sum, moved to position 0: it depends on the word's bytes alone
    h = (sums[end] - sums[start]) * inverse[start]
    return mix(h + (end - start).astype(np.uint64)), start, end


def word_hashes(buf: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text (uint8 bytes), in order."""
    return spans(buf)[0]


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of one text, byte positions."""
    if len(buf) <= SEGMENT:
        return _segment(buf)
    out, at = [], 0
    while at < len(buf):
        cut = min(len(buf), at + SEGMENT)
        while cut < len(buf) and not _SPACE[buf[cut]]:
            stop = np.flatnonzero(_SPACE[buf[cut : cut + SEGMENT]])
            cut = cut + int(stop[0]) if len(stop) else min(len(buf), cut + SEGMENT)
        h, s, e = _segment(buf[at:cut])
        out.append((h, s + at, e + at))
        at = cut
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def byte_view(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0]


#: Byte map that leaves letters and digits (lower-cased) and bytes of other scripts, the rest being white space.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[:128] = 32
for _r in (range(48, 58), range(97, 123)):
    PLAIN[list(_r)] = list(_r)
PLAIN[65:91] = PLAIN[97:123]


def batch_words(col: pa.Array, bytes_as: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, hashes, row offsets into hashes) for runs of rows.

    Short texts are hashed together (a separator byte stands between them), so
    that the cost per text is small; a text above SEGMENT is hashed by itself.
    ``bytes_as`` maps the bytes before they are cut into words.
    """
    body, off = byte_view(col)
    if bytes_as is not None:
        body = bytes_as[body]
    n, row = len(off) - 1, 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + SEGMENT, side="right")) - 1
        end = min(n, max(end, row + 1))
        if end == row + 1:
            h = word_hashes(body[off[row] : off[end]])
            yield row, end, h, np.array([0, len(h)])
        else:
            size = np.diff(off[row : end + 1])
            buf = np.full(int(size.sum()) + len(size), 32, np.uint8)
            at = np.cumsum(size + 1) - (size + 1)
            keep = np.ones(len(buf), dtype=bool)
            keep[at + size] = False
            buf[keep] = body[off[row] : off[end]]
            h, start, _ = _segment(buf)
            yield row, end, h, np.append(np.searchsorted(start, at), len(h))
        row = end


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes (sorted) of the k-word shingles; fewer words: the whole sequence as one."""
    if not len(h):
        return h
    if len(h) < k:
        k, salt = len(h), _U(len(h))
    else:
        salt = _U(k)
    acc = np.full(len(h) - k + 1, salt, np.uint64)
    for i in range(k):
        acc = mix(acc * _U(0xD6E8FEB86659FD93) + h[i : len(h) - k + 1 + i])
    return np.unique(acc)
