"""URL filters: sorted digest arrays probed by vectorised binary search.

A filter list is stored as three flat files: the sorted 64-bit XXH64 digests
of its entries, the offsets of the entries' strings, and the strings.  Python
workers memory-map them, so the list costs one copy per machine and nothing
per row; every digest that matches is confirmed against the stored string, so
two strings of one digest are told apart.

An entry is ``host/path``: it fits a url whose host is that host or one of its
subdomains and whose path starts with that path.  The longest entry wins.

Defined results: a null url, or one without ``://``, has an empty host and an
empty path and fits no entry.  An empty path starts with no rule's path.
Repeated rows are judged each by itself; columns other than the key and the
url are never read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.shared import bounded_batches, ship_bytes

#: The rules that come before the method's own list.
BASE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The method's list is built from a rule: each of these labels before each of these domains.
AD_LABELS = ("ad", "ads", "adserver", "ads-track", "analytics", "banner", "click", "metrics", "pixel", "stats", "telemetry", "track", "tracker", "tracking")
AD_DOMAINS = ("example.com", "example.net", "example.org")

_A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def default_blocklist() -> list[str]:
    """Ad and tracking hosts, every path."""
    return [f"{label}.{domain}/" for label, domain in product(AD_LABELS, AD_DOMAINS)]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the module says."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return rest[:end].translate(_A_Z), tail[:stop]


class DigestArray:
    """Entries in sorted digest order, memory-mapped from one file."""

    def __init__(self, path: str):
        head = np.memmap(path, np.uint64, mode="r", shape=(3,))
        n, n_lengths, n_hosts = map(int, head)
        at = 24
        self.keys = np.memmap(path, np.uint64, mode="r", offset=at, shape=(n,)) if n else np.empty(0, np.uint64)
        at += 8 * n
        self.offsets = np.memmap(path, np.uint64, mode="r", offset=at, shape=(n + 1,))
        at += 8 * (n + 1)
        self.path_lengths = np.memmap(path, np.uint64, mode="r", offset=at, shape=(n_lengths,)).tolist() if n_lengths else []
        at += 8 * n_lengths
        self.hosts = np.memmap(path, np.uint64, mode="r", offset=at, shape=(n_hosts,)) if n_hosts else np.empty(0, np.uint64)
        at += 8 * n_hosts
        size = int(self.offsets[-1])
        self.strings = np.memmap(path, np.uint8, mode="r", offset=at, shape=(size,)) if size else np.empty(0, np.uint8)

    @staticmethod
    def dump(entries: Iterable[str], digest=xxhash.xxh64_intdigest) -> bytes:
        rows = sorted((digest(b), b) for b in {e.encode() for e in entries})
        split = [b.decode().partition("/") for _, b in rows]  # an entry without "/" is a host with any path, an empty one too
        lengths, hosts = sorted({len(slash + path) for _, slash, path in split}), sorted({xxhash.xxh64_intdigest(host.encode()) for host, _, _ in split})
        head = np.array([len(rows), len(lengths), len(hosts)], np.uint64), np.array([k for k, _ in rows], np.uint64)
        tail = np.cumsum([0, *(len(b) for _, b in rows)]).astype(np.uint64), np.array(lengths, np.uint64), np.array(hosts, np.uint64)
        return b"".join(x.tobytes() for x in (*head, *tail)) + b"".join(b for _, b in rows)

    def may_hold(self, hosts: list[str]) -> np.ndarray:
        """Which hosts have entries, by digest alone."""
        probe = np.fromiter((xxhash.xxh64_intdigest(h.encode()) for h in hosts), np.uint64, len(hosts))
        return np.searchsorted(self.hosts, probe, "right") > np.searchsorted(self.hosts, probe, "left")

    def entry(self, k: int) -> bytes:
        return self.strings[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes()

    def contains(self, candidates: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """Which candidates are entries."""
        found = np.zeros(len(candidates), bool)
        if not len(self.keys) or not candidates:
            return found
        probe = np.fromiter(map(digest, candidates), np.uint64, len(candidates))
        lo, hi = np.searchsorted(self.keys, probe, "left"), np.searchsorted(self.keys, probe, "right")
        for c in np.flatnonzero(hi > lo):
            found[c] = any(self.entry(k) == candidates[c] for k in range(lo[c], hi[c]))
        return found


def longest_fits(array: DigestArray, split: list[tuple[str, str]]) -> list[str | None]:
    """The longest entry that fits each (host, path), or None."""
    suffixes = [(row, host[s:]) for row, (host, _) in enumerate(split) if host for s in [0] + [k + 1 for k, c in enumerate(host) if c == "."]]
    owner: list[int] = []
    candidates: list[str] = []
    for k in np.flatnonzero(array.may_hold([host for _, host in suffixes])):
        row, host = suffixes[k]
        path = split[row][1]
        for length in array.path_lengths:
            if length <= len(path):
                owner.append(row)
                candidates.append(host + path[:length])
    best: list[str | None] = [None] * len(split)
    for c in np.flatnonzero(array.contains([x.encode() for x in candidates])):
        if best[owner[c]] is None or len(candidates[c]) > len(best[owner[c]]):
            best[owner[c]] = candidates[c]
    return best


OUT = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Iterable[tuple[str, str]] = BASE_RULES, blocklist: Iterable[str] | None = None) -> DataFrame:
    """key, host, path, rule, verdict of every row.

    rules: (entry, verdict); the longest that fits decides.  Where none fits,
    a url that fits an entry of blocklist is blocked and any other allowed.
    An entry is a host and the beginning of a path; without "/" it fits every
    path of its host.  Paths are only looked up for hosts that have entries.
    Null and repeated keys are kept as they are; a url may be of any length.
    """
    verdicts = dict(rules)
    rule_file = ship_bytes(pages.sparkSession, DigestArray.dump(verdicts))
    block_file = ship_bytes(pages.sparkSession, DigestArray.dump(default_blocklist() if blocklist is None else blocklist))
    schema = T.StructType([T.StructField("key", pages.schema[key].dataType), *OUT.fields])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule_array, block_array = DigestArray(SparkFiles.get(rule_file)), DigestArray(SparkFiles.get(block_file))
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            rule = longest_fits(rule_array, split)
            blocked = longest_fits(block_array, split)
            verdict = [verdicts[r] if r is not None else "block" if b is not None else "allow" for r, b in zip(rule, blocked, strict=True)]
            hosts, paths = [h for h, _ in split], [p for _, p in split]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, rule, verdict))], names=schema.names)

    out = bounded_batches(pages.select(F.col(key).alias("key"), F.col(url).alias("url"))).mapInArrow(judge, schema)
    return out.withColumnRenamed("key", key)
