"""URL filter by a sorted digest array: 64-bit xxhash keys in a memory-mapped file, probed by binary search.

The index of a rule list is three flat files: the digests in ascending order, the end offset of each rule's text, and
the texts. Spark hands the files to each executor once (``SparkContext.addFile``), where every Python worker maps them,
so they take page cache and not heap. A batch of urls makes its candidate keys (each parent domain with each path
prefix of a length that some rule has), hashes them, finds them with one vectorised search, and compares the stored
text, so a digest collision changes nothing. Lists beyond SEGMENT rules become several such indexes, each probed.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import ship
from .common import free_name, table

#: Rules of one index file: 2**24 digests are 128 MB.
SEGMENT = 1 << 24

#: Fixed values: (verdict, host, path) of op7.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestIndex:
    """One segment, opened where the files are."""

    def __init__(self, at: str) -> None:
        self.keys = np.memmap(f"{at}.keys", np.uint64, "r")
        self.ends = np.memmap(f"{at}.ends", np.uint64, "r")
        self.text = np.memmap(f"{at}.text", np.uint8, "r")

    def rule(self, i: int) -> bytes:
        return bytes(self.text[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])])

    def find(self, digests: np.ndarray, wanted: list[bytes]) -> Iterator[tuple[int, bool]]:
        """(place in wanted, blocks?) of each wanted text that is stored. A stored text is a verdict byte and the rule."""
        at = np.searchsorted(self.keys, digests)
        inside = np.flatnonzero(at < len(self.keys))
        for j in inside[self.keys[at[inside]] == digests[inside]]:
            i = int(at[j])
            while i < len(self.keys) and self.keys[i] == digests[j]:  # texts that share the digest
                stored = self.rule(i)
                if stored[1:] == wanted[j]:
                    yield int(j), stored[:1] == b"b"
                    break
                i += 1


def build(rules: Iterable[tuple[str, str, str]], folder: str) -> tuple[list[str], list[int]]:
    """Writes the segments; returns the files' stems and the lengths (in bytes) that rules' paths have.

    A rule given twice keeps its first verdict.
    """
    seen: dict[bytes, bytes] = {}
    for verdict, rule_host, rule_path in rules:
        seen.setdefault(f"{rule_host.lower()}{rule_path}".encode(), b"b" if verdict == "block" else b"a")
    lengths = sorted({len(r) - r.index(b"/") if b"/" in r else 0 for r in seen})
    stems, items = [], list(seen.items())
    name = hashlib.sha256(repr(sorted(items)).encode()).hexdigest()[:16]
    for s in range(0, len(items), SEGMENT):
        part = sorted((xxhash.xxh64_intdigest(r), v + r) for r, v in items[s : s + SEGMENT])
        stem = os.path.join(folder, f"rules-{name}-{s // SEGMENT}")
        np.array([d for d, _ in part], np.uint64).tofile(f"{stem}.keys")
        np.cumsum([len(t) for _, t in part], dtype=np.uint64).tofile(f"{stem}.ends")
        with open(f"{stem}.text", "wb") as f:
            f.write(b"".join(t for _, t in part))
        stems.append(stem)
    return stems, lengths


def judge(hosts: list[str], paths: list[str], indexes: list[DigestIndex], lengths: list[int]) -> tuple[list[str | None], list[str | None]]:
    """(rule, its verdict) of each url: the longest rule that fits, or nulls."""
    keys: list[bytes] = []
    owner: list[int] = []
    for n, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        if not h:
            continue
        b, q = h.encode(), p.encode()
        prefixes = [q[:k] for k in lengths if k <= len(q)]
        at = 0
        while at >= 0:
            for prefix in prefixes:
                keys.append(b[at:] + prefix)
                owner.append(n)
            dot = b.find(b".", at)
            at = dot + 1 if dot >= 0 else -1
    rule: list[str | None] = [None] * len(hosts)
    verdict: list[str | None] = [None] * len(hosts)
    best = [-1] * len(hosts)
    if keys:
        digests = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        for index in indexes:
            for j, blocks in index.find(digests, keys):
                n = owner[j]
                if len(keys[j]) > best[n]:
                    best[n], rule[n], verdict[n] = len(keys[j]), keys[j].decode(), "block" if blocks else "allow"
    return rule, verdict


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """pages (only the columns kept by the caller) with host, path, rule and verdict.

    A rule (verdict, host, path prefix) fits its host and all subdomains; the longest that fits wins; a url that none
    fits is allowed, since the list names what to block. Null urls and urls without :// have empty host and path and
    no rule. The four names get an underscore before them where pages has them. Nulls, repeated rows and urls of any
    length are judged row by row; no rows give no rows.
    """
    ship(pages.sparkSession)
    context = pages.sparkSession.sparkContext
    folder = tempfile.mkdtemp(prefix="rules-")  # the driver's copy; executors get theirs through addFile
    stems, lengths = build(rules, folder)
    for stem in stems:
        for kind in ("keys", "ends", "text"):
            if not os.path.exists(SparkFiles.get(f"{os.path.basename(stem)}.{kind}")):
                context.addFile(f"{stem}.{kind}")
    names = [os.path.basename(stem) for stem in stems]
    at = [free_name(pages, n) for n in ("host", "path", "rule", "verdict")]
    parsed = pages.select("*", host(F.col(url)).alias(at[0]), path(F.col(url)).alias(at[1]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [DigestIndex(SparkFiles.get(name)) for name in names]
        for batch in batches:
            rule, verdict = judge(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), indexes, lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array([v or "allow" for v in verdict], pa.string())], [*batch.schema.names, *at[2:]])

    schema = StructType([*parsed.schema.fields, *[StructField(n, StringType()) for n in at[2:]]])
    return parsed.mapInArrow(probe, schema)


def op7_urls(spark, sf_dir: str) -> DataFrame:
    """One row for each page, by :func:`filter_urls` with RULES."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


#: DuckDB: the rules spelled out; the longest one that fits.
OP7_SQL = """
WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict
  FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id) f USING (page_id)
"""
