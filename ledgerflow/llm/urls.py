"""Allow and block rules for URLs, held as a sorted array of 64-bit digests.

The rules' keys (host and path) are hashed by XXH64, sorted, and written as one
file that each executor fetches and maps into memory. A URL's candidate keys are
probed by vectorised binary search; a digest that is found counts only if the
full key stored beside it is equal. The file is built only for rules of at most
MAX_RULES rows; more are looked up by a join on the candidate keys.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, mapped, writable

#: Rules up to which the array is built on the driver and sent to the executors (about 100 bytes each).
MAX_RULES = 1_000_000
DEFAULT = "allow"

_maps: dict[str, "DigestArray"] = {}


class DigestArray:
    """``digests`` ascending, ``ends`` of the keys in ``text``, ``allow``: files in a folder, memory-mapped."""

    def __init__(self, path: str):
        import numpy as np

        n, size = np.memmap(path, np.int64, "r", shape=(2,))
        n = int(n)
        self.n = n
        if n:
            self.digests = np.memmap(path, np.uint64, "r", 16, (n,))
            self.ends = np.memmap(path, np.int64, "r", 16 + 8 * n, (n + 1,))
            self.allow = np.memmap(path, np.uint8, "r", 24 + 16 * n, (n,))
            self.text = np.memmap(path, np.uint8, "r", 24 + 17 * n, (int(size),))

    @staticmethod
    def write(rules: list[tuple[str, bool]], path: str) -> None:
        """``rules``: distinct key and whether it allows."""
        import numpy as np
        import xxhash

        keyed = sorted((xxhash.xxh64_intdigest(k.encode()), k.encode(), a) for k, a in rules)
        ends = np.cumsum([0, *(len(k) for _, k, _ in keyed)]).astype(np.int64)
        with open(path, "wb") as f:
            f.write(np.array([len(keyed), ends[-1]], np.int64).tobytes())
            f.write(np.array([d for d, _, _ in keyed], np.uint64).tobytes() + ends.tobytes())
            f.write(np.array([a for _, _, a in keyed], np.uint8).tobytes() + b"".join(k for _, k, _ in keyed))

    def find(self, keys: list[bytes]):
        """For each key its place, or -1. Keys with one digest stand together; each of them is compared in full."""
        import numpy as np
        import xxhash

        out = np.full(len(keys), -1, np.int64)
        if not self.n or not keys:
            return out
        h = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, h)
        for i in np.flatnonzero(self.digests[np.minimum(at, self.n - 1)] == h):
            j = int(at[i])
            while j < self.n and self.digests[j] == h[i]:
                if self.text[self.ends[j] : self.ends[j + 1]].tobytes() == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out


def digest_array(path: str) -> DigestArray:
    if path not in _maps:
        _maps[path] = DigestArray(path)
    return _maps[path]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT, max_rules: int = MAX_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict`` (``allow`` or ``block``; ``default`` without a rule).

    ``rules``: ``host, path, action``. A rule fits its host and all subdomains if
    the URL's path starts with its path; the longest (host and path together)
    wins, of equally long ones the least by code point; of a rule given twice with both actions, block. Rules
    with a null are ignored. Null and odd URLs have empty host and path and get
    the default. Repeated pages each get a row; input columns named like the
    added ones are replaced; an empty table, of pages or rules, is fine.
    """
    spark = pages.sparkSession
    known = rules.filter("host IS NOT NULL AND path IS NOT NULL AND action IN ('allow', 'block')").groupBy("host", "path").agg(F.min(F.col("action") == "allow").alias("allow"))
    pages = writable(pages)
    url = fresh(pages, "judged_url")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    pages = pages.withColumn(url, F.col(f"`{url_col}`")).select(*(F.col(f"`{c}`") for c in kept), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    lengths = sorted(r[0] for r in known.select(F.length("path")).distinct().collect())
    if known.count() > max_rules:
        return _judge_by_join(pages, known, lengths, default)
    file = os.path.join(tempfile.mkdtemp(), f"rules-{uuid.uuid4().hex}.bin")
    DigestArray.write([(r.host + "\n" + r.path, r.allow) for r in known.collect()], file)
    spark.sparkContext.addFile(file)
    name = os.path.basename(file)
    h, p = pages.columns.index("host"), pages.columns.index("path")

    def run(batches):
        import pyarrow as pa

        array = digest_array(SparkFiles.get(name))
        for b in batches:
            keys, of = [], []
            for i, (host, path) in enumerate(zip(b.column(h).to_pylist(), b.column(p).to_pylist())):
                own = candidates(host, path, lengths)
                keys += own
                of += [i] * len(own)
            at = array.find([k.encode() for k in keys])
            best: dict[int, tuple] = {}
            for k, i, j in zip(keys, of, at):
                if j >= 0:
                    rule = k.replace("\n", "", 1)
                    found = (-len(rule), rule, bool(array.allow[j]))
                    best[i] = min(best.get(i, found), found)
            rule = [best[i][1] if i in best else None for i in range(b.num_rows)]
            verdict = [("allow" if best[i][2] else "block") if i in best else default for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*b.schema.names, "rule", "verdict"])

    return mapped(pages, run, "rule string, verdict string")


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys, host and path parted by a line feed, of all rules that would fit: the host and its parents with the path's starts of ``lengths``."""
    hosts, rest = [], host
    while rest:
        hosts.append(rest)
        rest = rest.partition(".")[2]
    return [f"{h}\n{path[:n]}" for h in hosts for n in lengths if n <= len(path)]


def _judge_by_join(pages: DataFrame, known: DataFrame, lengths: list[int], default: str) -> DataFrame:
    """The same for rules of any number: distinct pairs of host and path are joined with the rules by their candidate keys."""
    parts = F.split("host", r"\.")
    parents = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    starts = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda x: x.isNotNull())
    asked = pages.select("host", "path").distinct().withColumn("h", F.explode(parents)).withColumn("p", F.explode(starts))
    best = asked.join(known.withColumnsRenamed({"host": "kh", "path": "kp"}), (F.col("h") == F.col("kh")) & (F.col("p") == F.col("kp")))
    rule = F.concat("kh", "kp")
    best = best.groupBy("host", "path").agg(F.min(F.struct((-F.length(rule)).alias("n"), rule.alias("rule"), "allow")).alias("best"))
    out = pages.join(best, ["host", "path"], "left")
    verdict = F.when(F.col("best.allow"), "allow").when(~F.col("best.allow"), "block").otherwise(default)
    return out.select(*(F.col(f"`{c}`") for c in pages.columns), F.col("best.rule").alias("rule"), verdict.alias("verdict"))


#: The rules of op5: host, path, action.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: The verdicts for ``pages`` in DuckDB's SQL.
URLS_SQL = r"""
WITH rules(rh, rp, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS row_id
  FROM pages),
m AS (
  SELECT row_id, rh || rp AS rule, action, row_number() OVER (PARTITION BY row_id ORDER BY length(rh || rp) DESC, rh || rp) AS k
  FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (row_id)
"""
