"""URL rules by sorted, memory-mapped digest arrays."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import ascii_lower, written


def url_parts(url: str):
    """Columns (host, path): the host after the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, A-Z lower-cased; the path from there up to ``?``, ``#`` or the end. Both are empty
    where the url is null or has no ``://``."""
    full = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(full, "://")
    rest = F.when(at > 0, F.substring(full, at + 3, F.length(full))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return ascii_lower(host), path


class DigestArray:
    """Sorted 64-bit digests in a memory-mapped file, with the full strings they stand for."""

    def __init__(self, digests: np.ndarray, strings: list[bytes]) -> None:
        order = np.argsort(digests, kind="stable")
        self.folder = tempfile.TemporaryDirectory(prefix="digests-")
        offsets = np.cumsum([0, *(len(strings[i]) for i in order)]).astype("<u8")
        for name, data in (("keys", digests[order].astype("<u8").tobytes()), ("offsets", offsets.tobytes()), ("strings", b"".join(strings[i] for i in order))):
            with open(os.path.join(self.folder.name, name), "wb") as out:
                out.write(data)
        n = len(digests)
        self.keys = np.memmap(os.path.join(self.folder.name, "keys"), "<u8", "r", shape=(n,)) if n else np.zeros(0, "<u8")
        self.offsets = np.memmap(os.path.join(self.folder.name, "offsets"), "<u8", "r", shape=(n + 1,))
        self.bytes = np.memmap(os.path.join(self.folder.name, "strings"), "u1", "r") if offsets[-1] else np.zeros(0, "u1")

    def probe(self, digests: np.ndarray, strings: list[bytes]) -> np.ndarray:
        """Whether each string is stored: a binary search of all digests at once, then a look at
        the full strings of equal digests, as two strings can share one."""
        first, last = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        found = np.zeros(len(digests), bool)
        for k in np.flatnonzero(first < last):
            found[k] = any(bytes(self.bytes[int(self.offsets[i]) : int(self.offsets[i + 1])]) == strings[k] for i in range(first[k], last[k]))
        return found


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, kind, digest, string) sorted by part and kind, rules (kind 0) first -> the probes found."""
    part, rules, array = None, [], None
    for batch in batches:
        parts, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.append(0, np.flatnonzero((parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])) + 1)
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(parts)], strict=True):
            if lo == hi:
                continue
            if parts[lo] != part:
                part, rules, array = parts[lo], [], None
            digests = batch.column(2).slice(lo, hi - lo).to_numpy().view(np.uint64)
            strings = [x.encode() for x in batch.column(3).slice(lo, hi - lo).to_pylist()]
            if kinds[lo] == 0:
                rules.append((digests, strings))
                continue
            if array is None:
                array = DigestArray(np.concatenate([r[0] for r in rules]) if rules else np.zeros(0, np.uint64), [x for r in rules for x in r[1]])
            if (found := array.probe(digests, strings)).any():
                yield pa.RecordBatch.from_arrays([batch.column(3).slice(lo, hi - lo).filter(pa.array(found))], ["string"])


def stored(probes: DataFrame, rules: DataFrame, per_part: int = 200_000) -> DataFrame:
    """The distinct strings of ``probes`` (string) that are among ``rules`` (string).

    Both are dealt by digest over parts of about ``per_part`` rules or probes; a task sorts its part's
    digests into a memory-mapped array in its own temporary folder, gone with the part, and streams the part's
    distinct probes past it. No task holds more rules than its part's, and a frequent probe is one row.
    """
    digest = F.xxhash64("string").alias("digest")
    rules, probes = rules.select("string", digest).distinct(), written(probes.select("string", digest).distinct(), "probes")
    parts = max(1, -(-max(rules.count(), probes.count()) // per_part))
    part = F.pmod(F.shiftright("digest", 7), F.lit(parts)).cast("int")
    both = rules.withColumn("kind", F.lit(0)).unionByName(probes.withColumn("kind", F.lit(1))).withColumn("part", part).select("part", "kind", "digest", "string")
    return both.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_probed, "string string")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) from rules (host, path, verdict).

    A rule fits its host and all subdomains where the url's path starts with the rule's path;
    the longest fitting rule (host and path together, then the host) wins; where rules agree in
    both, ``block`` wins over ``allow``. Without a rule the verdict is ``default``. Urls that
    are null or have no ``://`` have empty parts and fit no rule; rules with a null or empty host
    are ignored.

    Hosts are looked up first, with each of their parents; only those that a rule names are
    looked up with the path, cut at each length that the host's rules have. Repeated rows and
    null keys pass through; an empty table of rules leaves the default.
    """
    host, path = url_parts(url)
    parts = written(pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), host.alias("host"), path.alias("path")), "urls")
    rules = rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").where("rule_host <> ''")
    rules = written(rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")), "rules")
    hosts = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    labels = F.split("host", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parents = parts.where("host <> ''").select("host").distinct().select("host", F.explode(F.array_distinct(up)).alias("string"))
    known = stored(parents, rules.select(F.col("rule_host").alias("string")))
    named = parents.join(known, "string").join(hosts, F.col("string") == F.col("rule_host")).select("host", "rule_host", "lengths")
    named = written(named, "named-hosts")
    named = F.broadcast(named) if named.count() <= 50_000 else named  # counted; so a frequent host is not gathered
    cuts = parts.join(named, "host").select("row", "rule_host", "path", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    cuts = written(cuts.select("row", "rule_host", F.substring("path", F.lit(1), F.col("n")).alias("rule_path")), "url-cuts")
    text = F.concat_ws("\n", "rule_host", "rule_path")
    hit = stored(cuts.select(text.alias("string")), rules.select(text.alias("string")))
    fits = cuts.withColumn("string", text).join(hit, "string").join(rules, ["rule_host", "rule_path"])
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("all"), F.length("rule_host").alias("own"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    best = fits.groupBy("row").agg(F.max(rank).alias("best"))
    out = parts.join(best, "row", "left")
    return out.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
