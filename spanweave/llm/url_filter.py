"""URL filter on sorted digest arrays.

A rule is a host and a path prefix; it fits its host and all subdomains. The index is an array of the
sorted 64-bit xxhash keys of the rules (host followed by path), their strings, and their verdicts, in files
that every executor maps into memory: the driver streams the sorted rules into the files, one
partition at a time, and Spark ships the files like any other (``addFile``), so a new executor fetches them again.

A second such array has the keys of the rules' hosts, each with the lengths of its paths. A batch of URLs probes both
once, by vectorised binary search: the hosts with every suffix of the URL's host that begins a label, then the rules with
the path prefixes of the lengths that the hosts found have. Hits are confirmed against the stored string, so equal digests of
different strings do no harm. The longest fitting rule decides (of equal rules, block), else the default.

Defined results: a null URL, or one without ``://``, has an empty host and path and gets the default, as does a host
with an empty label that no rule names; repeated rows are judged alike; without rules every URL gets
the default; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.session import materialize

SEED = 42
DOT = re.compile(r"\.")
LOWER = {c: c + 32 for c in range(65, 91)}


FILES = ("keys", "ends", "strings", "blocks", "hosts", "length_ends", "lengths")


class Index(NamedTuple):
    """Names of the shipped files: of the rules by key, and of their hosts by key with the lengths of their paths; and the length of the longest host."""

    keys: str
    ends: str
    strings: str
    blocks: str
    hosts: str
    length_ends: str
    lengths: str
    longest: int


def build_index(rules: DataFrame) -> Index:
    """``rules``: host, path (empty, or from its first slash on), verdict (allow or block)."""
    spark = rules.sparkSession
    clean = rules.where("host is not null and verdict is not null").select(
        F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.coalesce("path", F.lit("")).alias("path"), F.col("verdict"),
    )
    whole = materialize(clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "url-rules")
    rules_by_key = whole.select(
        F.xxhash64(F.concat("host", "path")).alias("key"), F.concat("host", "path").alias("rule"), (F.col("verdict") == "block").alias("block")
    ).orderBy("key", "rule")
    # a path is shorter than a URL, so the lengths of a host are few
    hosts_by_key = whole.groupBy(F.xxhash64("host").alias("key")).agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"), F.max(F.length("host")).alias("longest")).orderBy("key")
    folder, tag = os.path.join(SparkFiles.getRootDirectory(), f"staged-{uuid.uuid4().hex}"), uuid.uuid4().hex
    os.makedirs(folder)
    names, longest = [f"{part}-{tag}" for part in FILES], 0
    with ExitStack() as opened:
        files = Index(*[opened.enter_context(open(os.path.join(folder, n), "wb")) for n in names], 0)
        end = 0
        for row in rules_by_key.toLocalIterator():
            text = row["rule"].encode()
            end += len(text)
            files.keys.write(np.int64(row["key"]).tobytes())
            files.ends.write(np.int64(end).tobytes())
            files.strings.write(text)
            files.blocks.write(b"\1" if row["block"] else b"\0")
        end = 0
        for row in hosts_by_key.toLocalIterator():
            end += len(row["lengths"])
            longest = max(longest, row["longest"])
            files.hosts.write(np.int64(row["key"]).tobytes())
            files.length_ends.write(np.int64(end).tobytes())
            files.lengths.write(np.array(row["lengths"], np.int32).tobytes())
    for name in names:
        spark.sparkContext.addFile(os.path.join(folder, name))
    return Index(*names, longest)


def split_url(url: str | None) -> tuple[str, str]:
    """Lower-case host and path of a URL."""
    _, sign, rest = (url or "").partition("://")
    if not sign:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return host.translate(LOWER), path


def label_starts(host: str, longest: int) -> Iterator[int]:
    """Where the labels begin whose suffix is not longer than the longest host of a rule."""
    first = len(host) - longest
    if first <= 0:
        yield 0
    for dot in DOT.finditer(host, max(first - 1, 0)):
        yield dot.end()


def _mapped(name: str, kind: type) -> np.ndarray:
    path = SparkFiles.get(name)
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)


def _digests(texts: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in texts), np.uint64, len(texts)).view(np.int64)


def _judge(index: Index, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ends = _mapped(index.keys, np.int64), _mapped(index.ends, np.int64)
        strings, blocks = _mapped(index.strings, np.uint8), _mapped(index.blocks, np.uint8)
        hosts, length_ends, lengths = _mapped(index.hosts, np.int64), _mapped(index.length_ends, np.int64), _mapped(index.lengths, np.int32)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            suffixes = [(row, host[cut:]) for row, (host, _) in enumerate(parts) for cut in label_starts(host, index.longest)]
            digests = _digests([h.encode() for _, h in suffixes])
            places = np.searchsorted(hosts, digests)
            found = np.flatnonzero(places < len(hosts))
            owners, probes = [], []
            for i in found[hosts[places[found]] == digests[found]].tolist():
                (row, host), at = suffixes[i], int(places[i])
                path = parts[row][1]
                for n in lengths[length_ends[at - 1] if at else 0 : length_ends[at]].tolist():
                    if n <= len(path):
                        owners.append(row)
                        probes.append((host + path[:n]).encode())
            digests = _digests(probes)
            places = np.searchsorted(keys, digests)
            best: dict[int, tuple[int, int]] = {}
            inside = np.flatnonzero(places < len(keys))
            for i in inside[keys[places[inside]] == digests[inside]].tolist():
                at = int(places[i])
                while at < len(keys) and keys[at] == digests[i]:
                    stored = strings[ends[at - 1] if at else 0 : ends[at]].tobytes()
                    if stored == probes[i]:
                        best[owners[i]] = max(best.get(owners[i], (-1, -1)), (len(stored.decode()), at))
                    at += 1
            chosen = [best.get(row, (0, -1))[1] for row in range(len(parts))]
            rule = [strings[ends[at - 1] if at else 0 : ends[at]].tobytes().decode() if at >= 0 else None for at in chosen]
            verdict = [("block" if blocks[at] else "allow") if at >= 0 else default for at in chosen]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                pa.array(rule, pa.string()), pa.array(verdict, pa.string()),
            ], ["id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, index: Index, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_judge(index, default), f"id {kind}, host string, path string, rule string, verdict string")
