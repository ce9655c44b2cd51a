"""URL filters by a cascade of Bloom filters (operator 7).

Listed keys are encoded in a Bloom filter. Over the corpus's complete key universe its false positives are known,
so a second filter encodes them; the listed keys which that one hits wrongly go into a third, and so on until a
level has no false positive. A key of the universe is listed exactly if the first level that misses it is an even
one (counting the filter of the listed keys as level zero): membership is exact and no join is needed.

A key is a host followed by the beginning of a path, such as ``example.com/en/7``, or a host alone. What a URL
could match is every suffix of its host, at label borders, with each length of path that the list has. Rules are
listed keys with an action; the longest that fits wins. A URL that no rule fits is blocked where its host or a
parent domain is on the host list, and allowed otherwise.

Scale: the universe is read once to find the false positives of level zero, for the rules and the hosts together; all
deeper levels are built from these and the listed keys. Keys are gathered on the driver only where a count has shown
that there are ``SMALL_KEYS`` at most; larger sets stay tables and their filters are made by grouped ORs. Filters are
sent out only up to ``filter_bytes``: a longer list is split by hash into shards with a cascade each, and the pages
are passed through shard after shard. The rule list (with its actions) must be short enough for a driver, as it is
an argument; the host list may be a DataFrame of any size.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule, and is allowed; repeated
rows are judged each; an empty table or list gives an empty cascade; extra columns are ignored by the query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lattica.llm.common import materialize, read

FILTER_BYTES = 32 << 20
#: Most keys of a list or of a level's false positives that the driver holds; more of them stay a table.
SMALL_KEYS = 100_000
FIRST_RATE, NEXT_RATE = 1 / 256, 0.5

#: (action, host, beginning of the path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in BLOCKED_NAMES for top in ("com", "net", "org"))

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


def host_suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first."""
    out = [host] if host else []
    while (dot := host.find(".")) >= 0:
        host = host[dot + 1 :]
        out.append(host)
    return out


@dataclass
class Bloom:
    bits: int
    hashes: int
    level: int
    data: bytes

    @staticmethod
    def shape(keys: int, rate: float) -> tuple[int, int]:
        return max(64, 64 * math.ceil(keys * math.log2(1 / rate) / math.log(2) / 64)), max(1, round(math.log2(1 / rate)))

    @staticmethod
    def places(key: str, bits: int, hashes: int, level: int) -> list[int]:
        digest = xxhash.xxh3_128_intdigest(key.encode("utf-8", "replace"), level)
        a, b = digest & 0xFFFFFFFFFFFFFFFF, digest >> 64 | 1
        return [(a + k * b) % bits for k in range(hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.data[p >> 3] >> (p & 7) & 1 for p in self.places(key, self.bits, self.hashes, self.level))


@dataclass
class Cascade:
    levels: list[Bloom] = field(default_factory=list)

    def __contains__(self, key: str) -> bool:
        for n, level in enumerate(self.levels):
            if key not in level:
                return n % 2 == 1
        return len(self.levels) % 2 == 1


@dataclass
class Keys:
    """Distinct keys: held on the driver where they are few, a table of one column ``key`` else."""

    count: int
    local: list[str] | None = None
    frame: DataFrame | None = None

    @classmethod
    def of(cls, keys: DataFrame, small_keys: int) -> Keys:
        table = materialize(keys, "keys")
        count = table.count()
        return cls(count, [r.key for r in table.collect()]) if count <= small_keys else cls(count, frame=table)

    def as_frame(self, spark: SparkSession) -> DataFrame:
        return self.frame if self.frame is not None else spark.createDataFrame([(k,) for k in self.local], "key string")

    def bloom(self, rate: float, level: int) -> Bloom:
        """A filter of the keys. Those of a table are gathered by a grouped OR of the filter's words, whose number is
        that of the filter's bits by 64: the caller has bounded it."""
        bits, hashes = Bloom.shape(self.count, rate)

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = [p for key in batch.column(0).to_pylist() for p in Bloom.places(key, bits, hashes, level)]
                place = np.array(at, np.int64)
                mask = np.left_shift(np.uint64(1), (place & 63).astype(np.uint64)).view(np.int64)
                yield pa.record_batch([pa.array(place >> 6), pa.array(mask)], ["word", "mask"])

        if self.local is None:
            found = self.frame.mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
            data = np.zeros(bits // 64, "<i8")
            data[found["word"].to_numpy()] = found["mask"].to_numpy()
            return Bloom(bits, hashes, level, data.tobytes())
        data = bytearray(bits // 8)
        for key in self.local:
            for p in Bloom.places(key, bits, hashes, level):
                data[p >> 3] |= 1 << (p & 7)
        return Bloom(bits, hashes, level, bytes(data))

    def within(self, level: Bloom, small_keys: int) -> Keys:
        """Those of the keys that a filter holds, rightly or not."""
        if self.local is not None:
            kept = [k for k in self.local if k in level]
            return Keys(len(kept), kept)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([pa.array([k for k in batch.column(0).to_pylist() if k in level], pa.string())], ["key"])

        return Keys.of(self.frame.mapInArrow(run, "key string"), small_keys)


def build_cascades(listed: list[Keys], universe: DataFrame, first_rate: float = FIRST_RATE, small_keys: int = SMALL_KEYS) -> list[Cascade]:
    """A cascade for each list over ``universe(key)`` (repeats do no harm), which is read once for all of them.

    What the first filters hit is grouped by key together with the lists; groups without a listed row are the false
    positives. All further levels are made of these and of the lists.
    """
    spark = universe.sparkSession
    firsts = [keys.bloom(first_rate, 0) if keys.count else None for keys in listed]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = set(batch.column(0).to_pylist())
            found = [(n, k) for n, level in enumerate(firsts) if level is not None for k in keys if k in level]
            yield pa.record_batch([pa.array([n for n, _ in found], pa.int32()), pa.array([k for _, k in found], pa.string())], ["list", "key"])

    marked = universe.mapInArrow(hits, "list int, key string").withColumn("listed", F.lit(False))
    for n, keys in enumerate(listed):
        if keys.count:
            marked = marked.union(keys.as_frame(spark).select(F.lit(n), "key", F.lit(True)))
    false = marked.groupBy("list", "key").agg(F.bool_or("listed").alias("listed")).where("NOT listed")
    false = materialize(false.select("list", "key"), "false-positives")
    counts = {r["list"]: r["n"] for r in false.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
    near: dict[int, list[str]] = {n: [] for n in range(len(listed))}
    for row in false.where(F.col("list").isin([n for n, c in counts.items() if c <= small_keys])).collect():
        near[row["list"]].append(row["key"])
    cascades = []
    for n, (keys, first) in enumerate(zip(listed, firsts)):
        if first is None:
            cascades.append(Cascade())
            continue
        count = counts.get(n, 0)
        wrong = Keys(count, near[n]) if count <= small_keys else Keys(count, frame=false.where(F.col("list") == n).select("key"))
        cascade, pair = Cascade([first]), [wrong, keys]
        while pair[0].count:
            level = pair[0].bloom(NEXT_RATE, len(cascade.levels))
            cascade.levels.append(level)
            pair = [pair[1].within(level, small_keys), pair[0]]
        cascades.append(cascade)
    return cascades


def shards_of(listed: DataFrame, filter_bytes: int = FILTER_BYTES, first_rate: float = FIRST_RATE, small_keys: int = SMALL_KEYS) -> list[Keys]:
    """The distinct keys of a list, in shards by hash where one first filter would not fit ``filter_bytes``."""
    whole = Keys.of(listed.where("key IS NOT NULL AND key <> ''").select("key").distinct(), small_keys)
    shards = max(1, math.ceil(Bloom.shape(whole.count, first_rate)[0] / 8 / filter_bytes))
    if shards == 1:
        return [whole]
    shard = F.pmod(F.xxhash64("key"), F.lit(shards))
    return [Keys.of(whole.as_frame(listed.sparkSession).where(shard == s), small_keys) for s in range(shards)]


def filter_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    blocked_hosts: DataFrame | None = None,
    url_col: str = "url",
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns with these names give way."""
    made = ["host", "path", "rule", "verdict"]
    names = [c for c in pages.columns if c not in made]
    pages = pages.select(*(F.col(f"`{c}`") for c in names))
    hosts = [Keys(len(BLOCKED_HOSTS), list(BLOCKED_HOSTS))] if blocked_hosts is None else shards_of(blocked_hosts, filter_bytes)
    actions = {host + path: action for action, host, path in rules}
    lengths = sorted({len(path) for _, _, path in rules}, reverse=True)

    def candidates(host: str, path: str) -> list[str]:
        return [s + path[:n] for n in lengths if len(path) >= n for s in host_suffixes(host)]

    def universe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {k for u in batch.column(0).to_pylist() for h, p in [host_and_path(u)] for k in (*host_suffixes(h), *candidates(h, p))}
            yield pa.record_batch([pa.array(sorted(found), pa.string())], ["key"])

    keys = pages.select(F.col(f"`{url_col}`").cast("string")).mapInArrow(universe, "key string")
    rule_cascade, host_cascade = build_cascades([Keys(len(actions), list(actions)), hosts[0]], keys)
    place = names.index(url_col)

    def judge(host_cascade: Cascade, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hosts, paths, fits, verdicts = [], [], [], []
                before = [None] * batch.num_rows if first else batch.column(len(names) + 2).to_pylist()
                blocked = [False] * batch.num_rows if first else [v == "block" for v in batch.column(len(names) + 3).to_pylist()]
                for url, rule, bad in zip(batch.column(place).to_pylist(), before, blocked):
                    host, path = host_and_path(url)
                    if first:
                        rule = max((k for k in candidates(host, path) if k in rule_cascade), key=len, default=None)
                    if rule is None:
                        bad = bad or any(s in host_cascade for s in host_suffixes(host))
                    else:
                        bad = actions[rule] == "block"
                    hosts.append(host)
                    paths.append(path)
                    fits.append(rule)
                    verdicts.append("block" if bad else "allow")
                columns = [pa.array(c, pa.string()) for c in (hosts, paths, fits, verdicts)]
                yield pa.record_batch([*batch.columns[: len(names)], *columns], [*names, *made])

        return run

    schema = StructType([*pages.schema.fields, *(StructField(c, StringType()) for c in made)])
    out = pages.mapInArrow(judge(host_cascade, True), schema)
    for shard in hosts[1:]:
        out = out.mapInArrow(judge(build_cascades([shard], keys)[0], False), schema)
    return out


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page."""
    return filter_urls(read(spark, sf_dir, "pages", "page_id", "url")).drop("url")


OP7_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r(action, rhost, rpath) AS (VALUES {", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)}),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
b(listed) AS (VALUES {", ".join(f"('{x}')" for x in BLOCKED_HOSTS)}),
k AS (SELECT DISTINCT page_id FROM h JOIN b ON host = listed OR ends_with(host, '.' || listed))
SELECT h.page_id, host, path, rule, coalesce(action, CASE WHEN k.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m USING (page_id) LEFT JOIN k USING (page_id)
"""
