"""URL filter: a blocked Bloom filter of listed rules in front of an exact hash join.

A rule is a host and a path prefix. It fits its host and every subdomain of it, where the url's
path starts with the rule's. Each url expands into the few (host suffix, path prefix) keys whose
shape occurs in the list; the Bloom filter drops nearly all keys of unlisted urls before the
shuffle, and an equi-join with the list removes the filter's false positives.

Defined cases: null url or one without ``://`` has empty host and path and gets the default
verdict; repeated rows are judged each for itself; an empty list or table gives no rule; of fitting
rules the longest (host and path together) wins, then the longer host, then code point order; a
rule listed twice with both actions blocks. The list may be of any size: the filter's bits are
bounded by ``max_filter_bits`` (beyond that it lets more keys pass, and the join stays exact), and
the list itself is joined by shuffle unless Spark measures it as small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch

WORDS = 8  # a block has 8 words of 64 bits, one cache line
PROBES = 6


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: from there up to ``? #``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and its mask in each of the block's words."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    second = F.xxhash64(key, F.lit(17))
    bits = [F.shiftrightunsigned(second, 9 * i).bitwiseAND(F.lit(64 * WORDS - 1)).cast("int") for i in range(PROBES)]
    masks = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for b in bits:
            one = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(b, 3))
            mask = mask.bitwiseOR(F.when(b.bitwiseAND(F.lit(WORDS - 1)) == w, one).otherwise(F.lit(0).cast("long")))
        masks.append(mask)
    return block, masks


class BlockedBloom:
    """Bits of the listed keys; a key sets and reads bits of one block only.

    The filter is a table of at most ``max_filter_bits`` / 512 blocks (1 MB by default), which is
    the proven bound of its broadcast.
    """

    def __init__(self, keys: DataFrame, column: str, bits_per_key: int = 16, max_filter_bits: int = 1 << 23):
        self.blocks = max(1, min(max(1, keys.count()) * bits_per_key, max_filter_bits) // (64 * WORDS))
        block, masks = _places(F.col(column), self.blocks)
        named = [m.alias(f"__w{w}") for w, m in enumerate(masks)]
        self.table = keys.select(block.alias("__block"), *named).groupBy("__block").agg(*[F.bit_or(f"__w{w}").alias(f"__w{w}") for w in range(WORDS)])

    def possible(self, df: DataFrame, column: str) -> DataFrame:
        """Rows whose key may be listed; none that is listed is lost."""
        block, masks = _places(F.col(column), self.blocks)
        df = df.withColumn("__block", block).join(F.broadcast(self.table), "__block")
        for w in range(WORDS):
            df = df.where(F.col(f"__w{w}").bitwiseAND(masks[w]) == masks[w])
        return df.drop("__block", *[f"__w{w}" for w in range(WORDS)])


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``rules``: host, path, action (allow or block). Returns id, host, path, rule, verdict for each row."""
    spark = pages.sparkSession
    rules = (
        rules.select(F.lower("host").alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "action")
        .where(F.col("r_host").isNotNull() & (F.col("r_host") != ""))
        .groupBy("r_host", "r_path")
        .agg(F.max("action").alias("action"))  # 'block' sorts after 'allow'
        .withColumn("key", F.concat_ws("\x00", "r_host", "r_path"))
    )
    shapes = rules.select(F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("chars")).distinct().limit(4096).collect()
    host, path = host_and_path(F.col("__url"))
    rows = (
        pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"))
        .withColumn("host", host)
        .withColumn("path", path)
        .select("__id", "host", "path", F.monotonically_increasing_id().alias("__row"))
    )
    rows = Scratch(spark, "urls").save(rows, "rows")  # urls are parsed once, and row numbers stay what they are
    if not shapes:
        return rows.select(F.col("__id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if len(shapes) == 4096:  # too many shapes for literals: take every one up to the longest
        longest = rules.agg(F.max(F.size(F.split("r_host", r"\."))), F.max(F.length("r_path"))).first()
        pairs = F.expr(f"flatten(transform(sequence(1, least({longest[0]}, size(split(host, '[.]')))), l -> transform(sequence(0, least({longest[1]}, length(path))), c -> struct(l as labels, c as chars))))")
    else:
        shape = sorted((s["labels"], s["chars"]) for s in shapes)
        pairs = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in shape])
    bloom = BlockedBloom(rules, "key")
    keys = (
        rows.select("__row", "host", "path", F.explode(pairs).alias("s"))
        .where(F.col("host") != "")
        .where((F.size(F.split("host", r"\.")) >= F.col("s.labels")) & (F.length("path") >= F.col("s.chars")))
        .select("__row", F.concat_ws("\x00", F.expr("substring_index(host, '.', -s.labels)"), F.expr("substring(path, 1, s.chars)")).alias("key"))
    )
    found = (
        bloom.possible(keys, "key").join(rules, "key")
        .groupBy("__row")
        .agg(F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), "action")).alias("best"))
    )
    out = rows.join(found, "__row", "left")
    return out.select(F.col("__id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), j AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM h
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
