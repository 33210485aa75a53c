"""URL filters by sorted digest arrays (operator 7).

A rule is ``host/path-prefix`` with a verdict; it fits its host and all
subdomains where the URL's path starts with its path, and the longest fitting
rule wins. Rules, and listed whole URLs, are kept as sorted arrays of 64-bit
xxhash keys with their strings beside them. A task maps an array into memory and
probes it by vectorised binary search; a hit counts only where the stored string
equals the probed one, so digest collisions are harmless.

Rules are an argument of the caller: their array is broadcast (in shards of
``SHARD_BYTES``, probed one after the other in the same pass over the URLs), and
every key a URL could hit is probed, each host suffix with each path prefix of a
length that occurs. Listed URLs are a table of any size: it is dealt into shards
by digest together with the distinct URLs that no rule fits, a task builds a
shard's array and probes it, and the URLs found meet the rows again by a join.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
no rule and the default verdict; of equally long fitting rules the one with the
longer host wins; a rule given twice counts once, and ``block`` wins where its
verdicts differ; without rules and list every URL gets the default verdict; null
listed URLs fit nothing, and a URL listed twice counts once; other columns are
ignored. Rows are judged one by one, so repeated rows stay.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, saved
from .similar import runs

#: Bytes of strings (of rules; of listed and probed URLs) in one shard, and of found URLs that may be broadcast.
SHARD_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class DigestArray:
    """Sorted 64-bit digests with the strings they stand for, over one mapped buffer."""

    def __init__(self, buf) -> None:
        n = int(np.frombuffer(buf, np.int64, 1)[0])
        self.keys = np.frombuffer(buf, np.uint64, n, 8)
        self.offsets = np.frombuffer(buf, np.int64, n + 1, 8 + 8 * n)
        self.values = np.frombuffer(buf, np.uint8, n, 16 + 16 * n)
        self.blob = memoryview(buf)[16 + 17 * n :]

    @staticmethod
    def pack(entries: dict[bytes, int]) -> bytes:
        keys = np.array([xxhash.xxh64_intdigest(k) for k in entries], np.uint64)
        order = np.argsort(keys, kind="stable")
        strings, values = list(entries), np.array(list(entries.values()), np.uint8)
        ordered = [strings[i] for i in order]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in ordered])]).astype(np.int64)
        return b"".join([np.int64(len(keys)).tobytes(), keys[order].tobytes(), offsets.tobytes(),
                         values[order].tobytes(), *ordered])

    def probe(self, probes: list[bytes]) -> np.ndarray:
        """Value of each probed string, -1 where it is not in the list."""
        out = np.full(len(probes), -1, np.int64)
        if not len(self.keys) or not probes:
            return out
        digests = np.array([xxhash.xxh64_intdigest(p) for p in probes], np.uint64)
        at = np.searchsorted(self.keys, digests)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests)
        for i in hit:  # few: confirm the string, and walk over equal digests
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:
                if self.blob[self.offsets[k] : self.offsets[k + 1]] == probes[i]:
                    out[i] = self.values[k]
                    break
                k += 1
        return out


def map_into_memory(packed: bytes) -> mmap.mmap:
    """The packed array as a read-only mapping of an unnamed file of this task's machine."""
    with tempfile.TemporaryFile() as f:
        f.write(packed)
        f.flush()
        return mmap.mmap(f.fileno(), len(packed), access=mmap.ACCESS_READ)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(_UPPER, _LOWER)), slash + path


def split_url(url):
    """(host, path) columns of a URL column, as the module says."""
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _shards(entries: dict[bytes, int]) -> list[dict[bytes, int]]:
    out, size = [{}], 0
    for k, v in entries.items():
        if size > SHARD_BYTES:
            out.append({})
            size = 0
        out[-1][k] = v
        size += len(k) + 17
    return out


def _probe_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, ["shard"]):
        listed = t.column("listed").to_numpy(zero_copy_only=False)
        urls = t.column("url").combine_chunks()
        stored, asked = urls.filter(pa.array(listed)), urls.filter(pa.array(~listed))
        if not len(stored) or not len(asked):
            continue
        array = DigestArray(map_into_memory(DigestArray.pack({u.encode(): 1 for u in stored.to_pylist()})))
        found = array.probe([u.encode() for u in asked.to_pylist()])
        yield pa.RecordBatch.from_arrays([asked.filter(pa.array(found >= 0))], names=["url"])


def listed_urls(urls: DataFrame, blocked: DataFrame) -> DataFrame:
    """The distinct ``url`` of ``urls`` that are in ``blocked`` (url)."""
    n = max(1, int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked, stored = (d.select(F.col("url").cast("string").alias("url")).filter("url is not null").distinct() for d in (urls, blocked))
    both = stored.select("url", F.lit(True).alias("listed")).union(asked.select("url", F.lit(False)))
    size = urls.select("url").union(blocked.select("url")).agg(F.sum(F.octet_length("url") + 17)).first()[0] or 0
    shards = max(n, -(-size // SHARD_BYTES))
    dealt = both.withColumn("shard", F.pmod(F.xxhash64("url"), F.lit(shards))).repartition(n, "shard").sortWithinPartitions("shard")
    return map_arrow(dealt, _probe_shard, "url string")


def filter_urls(pages: DataFrame, rules: dict[str, str], blocked_urls: DataFrame | None = None,
                otherwise: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    ``rules`` maps ``host/path-prefix`` to ``allow`` or ``block``; a URL without
    a fitting rule is blocked if ``blocked_urls`` (url) holds exactly it, else gets
    ``otherwise``.
    """
    lists: dict[bytes, int] = {}
    lengths: set[int] = set()
    for rule, verdict in rules.items():
        host, path = split_rule(rule)
        lengths.add(len(path))
        key = (host + path).encode()
        lists[key] = max(lists.get(key, 0), int(verdict == "block"))
    sizes = sorted(lengths, reverse=True)
    host, path = split_url("url")
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")) \
        .select("page_id", "url", host.alias("host"), path.alias("path"),
                F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    schema = "page_id long, url string, host string, path string, rule string, verdict string"
    sc = pages.sparkSession.sparkContext
    for shard in _shards(lists):
        df = map_arrow(df, _prober(sc.broadcast(DigestArray.pack(shard)), sizes), schema)
    default = F.lit(otherwise)
    if blocked_urls is not None:
        found = saved(listed_urls(df.filter("rule is null").select("url"), blocked_urls))
        size = found.agg(F.sum(F.octet_length("url"))).first()[0] or 0
        found = found.withColumn("listed", F.lit(True))
        df = df.join(F.broadcast(found) if size <= SHARD_BYTES else found, "url", "left")
        default = F.when(F.col("listed"), "block").otherwise(default)
    return df.select("page_id", "url", "host", "path", "rule", F.coalesce("verdict", default).alias("verdict"))


def _rank(rule: str) -> tuple[int, int]:
    """Longer rules first, then those with the longer host."""
    return len(rule), len(rule.partition("/")[0])


def _candidates(host: str, path: str, sizes: list[int]) -> list[tuple[str, str]]:
    """(host suffix, path prefix) pairs that a rule could have."""
    out, at = [], 0
    suffixes = [host]
    while (at := host.find(".", at) + 1) > 0:
        suffixes.append(host[at:])
    for s in suffixes:
        out += [(s, path[:n]) for n in sizes if n <= len(path)]
    return out


def _prober(packed, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(map_into_memory(packed.value))
        for b in batches:
            rows = b.to_pydict()
            probes: list[bytes] = []
            owner: list[int] = []
            for i, (h, p) in enumerate(zip(rows["host"], rows["path"])):
                mine = [(s + x).encode() for s, x in _candidates(h, p, sizes)] if h else []
                probes += mine
                owner += [i] * len(mine)
            found = array.probe(probes)
            rule, verdict = rows["rule"], rows["verdict"]
            for k in np.flatnonzero(found >= 0):
                i, key = owner[k], probes[k].decode()
                if rule[i] is None or _rank(key) > _rank(rule[i]):
                    rule[i], verdict[i] = key, "block" if found[k] else "allow"
            yield pa.RecordBatch.from_pydict(rows, schema=b.schema)

    return run
