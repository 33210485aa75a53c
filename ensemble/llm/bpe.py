"""Byte-level BPE encoding and decoding (operator 4).

Encoding backtracks: an Aho-Corasick automaton gives the longest vocabulary
entry at every position of a pre-token; entries are taken from left to right,
and each adjacent pair is checked against the merge table (would these two
tokens ever stand side by side after the merges?). Where a pair fails, the next
shorter entry is tried, then the previous token is taken back; positions found
dead are marked, so the work stays linear. The result equals applying the
merges by rank. Decoding concatenates slices of one byte string through an
offset table.

Defined cases: a null or empty text has no tokens; special tokens in a text are
encoded as the vocabulary's added tokens, as the tokenizers library does; very
long texts are encoded whole. Repeated rows are encoded row by row; other
columns are ignored by ``encode_documents`` and may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space before other white space; elsewhere a space always starts a new pre-token.
SPACES = re.compile(r" \s")
#: Pre-tokens held in a worker's cache; beyond it the cache starts anew (memory bound).
CACHE = 400_000
#: Tokens decoded at once (memory bound for very long texts).
DECODE_STEP = 1 << 18


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 letters stand for themselves, the rest for U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Encoder and decoder of one tokenizers-library vocabulary file (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = _byte_letters(), spec["model"]
        self.vocab = {bytes(letters[c] for c in k): v for k, v in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        strings = [b""] * size
        for k, v in self.vocab.items():
            strings[v] = k
        for k, v in self.special.items():
            strings[v] = k.encode()
        self.strings = strings
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.sizes = self.lengths.tolist()
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.blob = np.frombuffer(b"".join(strings), np.uint8)

        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        parts = [tuple(bytes(letters[c] for c in side) for side in p) for p in pairs]
        # rank of what a merge makes; single bytes have rank -1 and no parts
        rank = {a + b: i for i, (a, b) in reversed(list(enumerate(parts)))}
        self.rank = [rank.get(s, -1) for s in strings]
        self.pair = {}
        self.parts = [(-1, -1)] * size
        for i, (a, b) in enumerate(parts):
            ia, ib, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.pair.setdefault((ia, ib), i)
            if rank[a + b] == i:
                self.parts[whole] = (ia, ib)
        self.automaton = ahocorasick.Automaton()
        for k, v in self.vocab.items():
            self.automaton.add_word(k.decode("latin-1"), (len(k), v))
        self.automaton.make_automaton()
        self.shorter = [self._prefix(s) for s in strings]
        self.pretoken = regex.compile(PATTERN).findall
        self._fits: dict[int, bool] = {}
        self.cache: dict[str, str] = {}
        self.chunks: dict[str, str] = {}

    def _prefix(self, s: bytes) -> int:
        return next((self.vocab[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.vocab), -1)

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side after all merges.

        Undo the merges of the later-made side step by step: if at some point
        the two facing parts would have merged before the merge that is being
        undone, the pair cannot survive.
        """
        key, limit = left << 32 | right, 1 << 60
        ok = True
        while True:
            made = self.pair.get((left, right))
            if made is not None and made < limit:
                ok = False
                break
            rl, rr = self.rank[left], self.rank[right]
            if rl < 0 and rr < 0:
                break
            if rl > rr:  # the left token was made later: its right part faced the right token before
                limit, left = rl, self.parts[left][1]
            else:  # of equal merges the left one happens first
                limit, right = rr + 1, self.parts[right][0]
        if len(self._fits) > 1_000_000:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one pre-token."""
        if (whole := self.vocab.get(piece)) is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token  # a later end is a longer entry
        out: list[int] = []
        dead = bytearray(n + 1)
        lengths, shorter, known = self.sizes, self.shorter, self._fits.get
        at, token, last = 0, longest[0], -1
        while at < n:
            while True:
                end = at + lengths[token]
                if not dead[end]:
                    ok = last < 0 or known(last << 32 | token)
                    if ok is None:
                        ok = self.fits(last, token)
                    if ok:
                        out.append(token)
                        at, last = end, token
                        token = longest[at] if at < n else -1
                        break
                token = shorter[token]
                if token < 0:  # nothing fits here: take the previous token back
                    dead[at] = 1
                    token = out.pop()
                    at -= lengths[token]
                    last = out[-1] if out else -1
                    break
        return out

    def _joined(self, piece: str) -> str:
        """A pre-token's ids, each followed by a comma (kept in the cache)."""
        out = "".join(f"{i}," for i in self.encode_piece(piece.encode("utf-8", "surrogatepass")))
        if len(self.cache) >= CACHE:
            self.cache.clear()
        if len(piece) < 64:
            self.cache[piece] = out
        return out

    def ids_text(self, text: str) -> str:
        """Decimal ids of a whole text, joined by commas."""
        cache, joined = self.cache, self._joined
        out: list[str] = []
        for part in (self.split.split(text) if self.split else [text]):
            if part in self.special:
                out.append(f"{self.special[part]},")
            elif not part:
                continue
            elif part[-1] == " " or SPACES.search(part):
                out.extend(cache.get(p) or joined(p) for p in self.pretoken(part))
            else:  # no space stands beside other white space: each starts a pre-token
                first, *rest = part.split(" ")
                out.extend(cache.get(p) or joined(p) for p in self.pretoken(first))
                chunks = self.chunks
                found = list(map(chunks.get, rest))
                if None in found:
                    for i, s in enumerate(found):
                        if s is None:
                            found[i] = chunks.get(rest[i]) or self._chunk(rest[i])
                out += found
        return "".join(out)[:-1]

    def _chunk(self, word: str) -> str:
        """Ids of a space and a word (its pre-tokens need no context), kept in a cache."""
        if word.isalpha():  # letters alone: one pre-token
            out = "".join([f"{i}," for i in self.encode_piece((" " + word).encode())])
        elif word[-1] in ".,;:!?" and word[:-1].isalpha():
            out = (self.chunks.get(word[:-1]) or self._chunk(word[:-1])) + (self.cache.get(word[-1]) or self._joined(word[-1]))
        else:
            out = "".join([self.cache.get(p) or self._joined(p) for p in self.pretoken(" " + word)])
        if len(self.chunks) >= CACHE:
            self.chunks.clear()
        if len(word) < 64:
            self.chunks[word] = out
        return out

    def encode(self, text: str) -> list[int]:
        s = self.ids_text(text)
        return list(map(int, s.split(","))) if s else []

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered through the offset table in bounded steps."""
        out = []
        for at in range(0, len(ids), DECODE_STEP):
            part = ids[at : at + DECODE_STEP]
            size = self.lengths[part]
            first = np.cumsum(size) - size
            take = np.arange(int(size.sum())) + np.repeat(self.offsets[part] - first, size)
            out.append(self.blob[take].tobytes())
        return b"".join(out)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row (ids array too if asked for).

    ``path`` names a vocabulary file present on every machine (it is a fixed
    resource of the installation, not data).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            count, digest, decoded, all_ids = [], [], [], []
            for text in b.column("text").to_pylist():
                s = tok.ids_text(text or "")
                ids = np.fromstring(s, np.int64, sep=",") if s else np.zeros(0, np.int64)
                count.append(len(ids))
                digest.append(hashlib.sha256(s.encode()).hexdigest())
                raw = tok.decode_bytes(ids)
                decoded.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
                all_ids.append(ids.tolist() if keep_ids else None)
            cols = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(count, pa.int64()),
                    "ids_sha256": pa.array(digest, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if keep_ids:
                cols["ids"] = pa.array(all_ids, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>" if keep_ids else "")
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids array<long>); null ids decode to the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            texts = [tok.decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string())})

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
