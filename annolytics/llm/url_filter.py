"""URL filter: a blocked Bloom filter over listed canonical URLs, then an exact hash join.

A listed entry is (host, path, verdict). It fits a URL whose host is the listed host or a subdomain of it
and whose path starts with the listed path; the longest fitting entry wins. A URL's candidate keys are its
host suffixes joined with those prefixes of its path that have the length of some listed path. The filter
(one array of 512-bit blocks; all probes of a key stay in one block) drops nearly all keys that are not
listed. Only possible hits are joined with the list, by exact key and once per distinct host and path, which
removes the false ones. Everything is built-in expressions.

Defined results: a null URL, or one without ``://``, has an empty host and path and is not listed. Hosts of
the list are compared in lower case; entries with a null host or path are ignored; of entries with the same
key, ``allow`` wins. Rows in are rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.operators.ordering import attach_row
from annolytics.session import materialize

WORDS = 8  # 64-bit words in a block
PROBES = 6
KEYS_PER_BLOCK = 32  # 16 bits a key
MAX_BLOCKS = 1 << 16  # 4 MB; a longer list makes more false hits, which the join removes
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: str, blocks: str) -> str:
    return f"pmod(xxhash64({key}), {blocks})"


def _probe(key: str, i: int) -> str:
    """Bit 0..511 of the ``i``-th probe of a key inside its block."""
    return f"cast((shiftrightunsigned(xxhash64({key}, 1), {9 * i}) & 511) as int)"


def bloom(listed: DataFrame) -> DataFrame:
    """One row: ``blocks`` and ``words``, the filter of column ``key``."""
    size = listed.select(F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.count("*") / KEYS_PER_BLOCK))).cast("int").alias("blocks")).select("blocks")
    bits = F.array(*[F.expr(_probe("key", i)) for i in range(PROBES)])
    keyed = listed.select("key", size.scalar().alias("blocks")).select(F.expr(_block("key", "blocks")).alias("block"), F.explode(bits).alias("bit"))
    set_words = keyed.select(
        (F.col("block") * WORDS + F.floor(F.col("bit") / 64)).cast("int").alias("word"), F.expr("shiftleft(1L, bit % 64)").alias("bits")
    )
    empty = size.select(F.explode(F.sequence(F.lit(0), F.col("blocks") * WORDS - 1)).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_words.unionByName(empty).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    filled = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
    return filled.select((F.size("w") / WORDS).cast("int").alias("blocks"), F.col("w.bits").alias("words"))


def canonical_list(entries: DataFrame) -> DataFrame:
    """Distinct keys of a list with host, path and verdict."""
    rows = entries.where("host IS NOT NULL AND path IS NOT NULL AND host != ''").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    return rows.select(F.concat("host", F.lit("\n"), "path").alias("key"), "host", "path", "verdict").groupBy("key", "host", "path").agg(F.min("verdict").alias("verdict"))


def _all_set(key: Column, blocks: Column, words: Column) -> Column:
    base = F.pmod(F.xxhash64(key), blocks).cast("int") * WORDS
    mixed = F.xxhash64(key, F.lit(1))
    found = F.lit(True)
    for i in range(PROBES):
        bit = F.shiftrightunsigned(mixed, 9 * i).bitwiseAND(511).cast("int")
        found = found & (F.getbit(F.get(words, base + F.shiftright(bit, 6)), bit.bitwiseAND(63)) == 1)
    return found


def maybe_listed(key: Column, table: DataFrame) -> Column:
    """Whether all probes of a key are set in a filter made by ``bloom``."""
    return _all_set(key, table.select("blocks").scalar(), table.select("words").scalar())


def with_maybe_listed(rows: DataFrame, key: Column, table: DataFrame, name: str = "__maybe") -> DataFrame:
    """``rows`` with ``maybe_listed`` as column ``name``. The filter is one subquery of the plan, which all probes share."""
    filled = attach_row(rows, table.select(F.col("blocks").alias("__blocks"), F.col("words").alias("__words")))
    return filled.withColumn(name, _all_set(key, F.col("__blocks"), F.col("__words"))).select(*rows.columns, name)


def judge_urls(pages: DataFrame, entries: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule`` (listed host and path, or null) and ``verdict``.
    Columns of these names in ``pages`` are replaced."""
    listed = canonical_list(entries)
    lengths = listed.agg(F.collect_set(F.length("path")).alias("lengths")).scalar()
    added = ("host", "path", "rule", "verdict")
    others = [c for c in pages.columns if c.lower() not in added and c != url]
    read = [F.col(url)] if url.lower() not in added else []
    parts = pages.select(*others, *read, host_of(url).alias("host"), path_of(url).alias("path"))

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.lit("\n"), F.substring(F.col("path"), F.lit(1), n)))))
    keyed = parts.where("host != ''").select("host", "path", lengths.alias("lengths")).select("host", "path", F.explode(keys).alias("key"))
    possible = with_maybe_listed(keyed, F.col("key"), materialize(bloom(listed))).where("__maybe").drop("__maybe").distinct()
    exact = possible.join(listed.select("key", F.struct(F.concat("host", "path").alias("rule"), F.length("host").alias("n"), "verdict").alias("hit")), "key")
    best = exact.groupBy("host", "path").agg(F.max_by("hit", F.struct(F.length("hit.rule"), "hit.n")).alias("__hit"))
    return parts.join(best, ["host", "path"], "left").select(
        *others, *read, "host", "path", F.col("__hit.rule").alias("rule"), F.coalesce("__hit.verdict", F.lit(otherwise)).alias("verdict")
    )
