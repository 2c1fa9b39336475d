"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join; DataFrame functions only.

A canonical key is ``host`` or ``host/first/second`` (lower-case host without port, path segments
without a trailing slash). A listed key covers its host's subdomains and the paths below it, so a URL
is tested under every suffix of its host and every leading part of its path. Each key falls in one
64-bit block, in which ``BITS`` bits are set; a key whose bits are not all set is surely not listed. What
passes goes to an exact join with the list, which removes the false positives. Distinct URLs are
tested once, so that a URL or host that fills the table is not dealt to one task.

Rules of the form (verdict, host, path) come first: a rule fits its host and all subdomains if the
path starts with the rule's; the longest fitting rule (host and path together) decides.

URLs that are null or lack ``://`` have an empty host and path, fit no rule, are not listed, and are
allowed. Repeated rows are judged alike, each keeps its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS = 4
KEYS_PER_BLOCK = 4  # 16 bits a key
#: A filter has at most so many blocks (16 bytes each), so it can always be broadcast; more keys only make it let more pass.
MAX_BLOCKS = 1 << 20

#: Verdict, host and path of the rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Names of listed sites; each is listed under every ending.
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_ENDINGS = ("example.com", "example.net", "example.org")


def listed(spark: SparkSession) -> DataFrame:
    """The default list, as canonical keys."""
    return spark.createDataFrame([(f"{n}.{e}",) for n in LISTED_NAMES for e in LISTED_ENDINGS], "key string")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(size, name, verdict), or null."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("name"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size:int,name:string,verdict:string>")


def keys_of(host: Column, path: Column) -> Column:
    """Canonical keys under which a URL may be listed."""
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    paths = F.concat(F.array(F.lit("")), F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))).otherwise(F.array().cast("array<string>")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def mask_of(key: Column) -> Column:
    bits = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(_one(F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def _one(bit: Column) -> Column:
    """A long with one bit set, the bit's number being a column."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom(listing: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of the filter (``block``, ``bits``) and how many there can be, ``MAX_BLOCKS`` at most."""
    blocks = min(MAX_BLOCKS, max(16, -(-listing.count() // KEYS_PER_BLOCK)))
    return listing.select(block_of(F.col("key"), blocks).alias("block"), mask_of(F.col("key")).alias("own")).groupBy("block").agg(F.bit_or("own").alias("bits")), blocks


def _tested(rows: DataFrame, key: Column, listing: DataFrame) -> DataFrame:
    """``rows`` with ``__may``: false where ``key`` is surely none of ``listing`` (``key``, of the same type). Nothing is shuffled."""
    filter_, blocks = bloom(listing)
    met = rows.withColumns({"__block": block_of(key, blocks), "__own": mask_of(key)}).join(F.broadcast(filter_.select(F.col("block").alias("__block"), F.col("bits").alias("__bits"))), "__block", "left")
    return met.withColumn("__may", F.coalesce(F.col("__bits").bitwiseAND(F.col("__own")) == F.col("__own"), F.lit(False))).drop("__block", "__own", "__bits")


def possible(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be one of ``listing``."""
    return _tested(rows, F.col("key"), listing).where("__may").drop("__may")


def without(docs: DataFrame, gone: DataFrame, names: dict[str, Column]) -> DataFrame:
    """``docs`` without the rows for which ``names`` (by column of ``gone``, the first an identifier) are listed there; nulls are equal.

    Only rows that may go, by a Bloom filter of the identifiers, travel to meet the list; all others pass where they are.
    """
    first = next(iter(names))
    listed = stored(docs.sparkSession, gone.select(*(F.col(n).alias(f"__{n}") for n in names)), "gone")
    tested = _tested(docs, F.xxhash64(names[first]), listed.select(F.xxhash64(f"__{first}").alias("key")))
    stays, asked = tested.where("not __may").drop("__may"), tested.where("__may").drop("__may")
    same = [own.eqNullSafe(listed[f"__{n}"]) for n, own in names.items()]
    return stays.unionByName(asked.join(listed, same, "left_anti"))


def blocked_urls(urls: DataFrame, listing: DataFrame) -> DataFrame:
    """Distinct ``url`` of ``urls`` (``url``, ``host``, ``path``) that are listed, with the longest listed key."""
    listing = listing.where(F.col("key").isNotNull()).select("key").distinct()
    passed = possible(urls.select("url", F.explode(keys_of(F.col("host"), F.col("path"))).alias("key")), listing)
    return passed.join(listing, "key").groupBy("url").agg(F.max_by("key", F.struct(F.length("key"), "key")).alias("listed_key"))


def judge(pages: DataFrame, listing: DataFrame, rules=RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``listed_key`` of every row of ``pages``."""
    rows = pages.select("page_id", "url")
    placed = lambda df: df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    distinct = placed(rows.where(F.col("url").isNotNull()).select("url").distinct())
    hits = blocked_urls(distinct, listing)
    out = placed(rows).join(hits, "url", "left").withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("listed_key").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("r.name").alias("rule"), F.coalesce(F.col("r.verdict"), own).alias("verdict"), "listed_key")


def sql(rules=RULES) -> str:
    """The same result as SQL for the oracle."""
    values = ", ".join(f"('{n}.{e}')" for n in LISTED_NAMES for e in LISTED_ENDINGS)
    fits = lambda h, p: f"(host = '{h}' or host like '%.{h}') and path like '{p}%'"
    best = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    case = lambda pick: "case " + " ".join(f"when {fits(h, p)} then '{pick(v, h, p)}'" for v, h, p in best) + " end"
    return f"""
with listed(key) as (values {values}),
rest as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (select page_id, url, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
          coalesce(regexp_extract(r, '^[^/?#]*(/[^?#]*)?', 1), '') as path from rest),
urls as (select distinct url, host from parts),
hits as (select url, max(key) as listed_key from urls join listed on host = key or host like '%.' || key group by url)
select page_id, host, path, {case(lambda v, h, p: h + p)} as rule,
  coalesce({case(lambda v, h, p: v)}, case when listed_key is null then 'allow' else 'block' end) as verdict, listed_key
from parts left join hits using (url)"""
