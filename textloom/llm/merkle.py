"""Merkle manifest of a dataset: fixed-size ordered arrays of leaves, collapsed level by level in SQL.

Leaves are placed in their group by ranges, gathered to blocks of SPAN, and each block's levels grow in one
expression: a fold over the levels whose step slices the last one into runs of FAN and hashes each run.  A
block gives one root; the roots of a group are the leaves of the next round until one is left.  The way back
gives each node the runs' other digests above it, left and right of its own, from which its proof and its
refolded root are made inside the block's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, id_crc, placed, table

FAN, LEVELS = 8, 3
SPAN = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """`-` if null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def lowered(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; pure ASCII takes the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(parts: Column) -> Column:
    """Lowercase hex sha256 of an array of strings, concatenated."""
    return F.sha2(F.array_join(parts, ""), 256)


def _levels(leaves: Column, depth: Column) -> Column:
    """The leaves and ``depth`` levels above them; each node is the digest of up to FAN nodes below."""

    def runs(nodes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(nodes), F.lit(FAN))
        return F.transform(starts, lambda i: digest(F.slice(nodes, i, F.lit(FAN))))

    return F.aggregate(F.sequence(F.lit(1), depth), F.array(leaves), lambda seen, _: F.concat(seen, F.array(runs(F.element_at(seen, -1)))))


def _sides(levels: Column, at: Column, depth: Column) -> Column:
    """For the node at a place of a block, by level upwards: its run's digests to the left and to the right, joined."""

    def step(level: Column) -> Column:
        own = F.floor(at / F.pow(F.lit(FAN), level)).cast("int")
        start = own - own % FAN
        nodes = F.element_at(levels, level + 1)
        return F.struct(F.array_join(F.slice(nodes, start + 1, own - start), "").alias("left"), F.array_join(F.slice(nodes, own + 2, start + FAN - 1 - own), "").alias("right"))

    return F.transform(F.sequence(F.lit(0), depth - 1), step)


def _height(n: Column) -> Column:
    """Levels above the leaves until one node is left, LEVELS at most (a block's share of them)."""
    height = F.lit(0)
    for k in range(LEVELS):
        height = height + (n > FAN**k).cast("int")
    return height


def _blocks(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, block, depth, nodes, levels): a group's nodes in arrays of SPAN by their place."""
    gathered = nodes.groupBy("key", F.floor(F.col("place") / SPAN).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", *[c for c in nodes.columns if c not in ("key", "place")]))).alias("nodes"))
    return gathered.join(sizes.select("key", _height(F.col("n")).alias("depth")), "key").withColumn("levels", F.when(F.col("depth") == 0, F.array(F.col("nodes.node"))).otherwise(_levels(F.col("nodes.node"), F.col("depth"))))


def trees(nodes: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """((key, node): each group's root; (key, place, .., path): each node with the digests beside its way up).

    ``nodes`` has (key, place, node, ..) with places gapless from 0 in each group; ``path`` is an array of
    (left, right) strings from the node upwards, empty for the only node of a group.  A lone node is its own root.
    """
    stack, now, k = [], nodes, 0
    while True:
        sizes = scratch.keep(now.groupBy("key").agg(F.count("*").alias("n")), f"{name}-sizes{k}")
        blocks = scratch.keep(_blocks(now, sizes), f"{name}-blocks{k}")
        stack.append(blocks)
        now = blocks.select("key", F.col("block").alias("place"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
        k += 1
        if (sizes.agg(F.max("n")).first()[0] or 0) <= SPAN:
            break
    roots = now.select("key", "node")
    above = now.select("key", F.col("place").alias("block"), F.array().cast("array<struct<left:string,right:string>>").alias("above"))
    for blocks in reversed(stack):
        level = blocks.join(above, ["key", "block"])
        own = F.when(F.col("depth") == 0, F.array().cast("array<struct<left:string,right:string>>"))
        with_path = F.transform("nodes", lambda x, i: F.struct(x.alias("x"), F.concat(own.otherwise(_sides(F.col("levels"), i, F.col("depth"))), F.col("above")).alias("path")))
        found = level.select("key", F.explode(with_path).alias("_n")).select("key", "_n.x.*", "_n.path")
        above = found.select("key", F.col("place").alias("block"), F.col("path").alias("above"))
    return roots, found


def folded(node: Column, path: Column) -> Column:
    """The root that a node and the digests beside its way up give."""
    return F.aggregate(path, node, lambda below, side: F.sha2(F.concat(side["left"], below, side["right"]), 256))


def manifest(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): every document's place in the dataset's tree.

    Null fields have an encoding of their own; a null id comes first in its language, is never tampered with, and
    null languages form a group.  Rows of one id order by their leaves, so repeated rows give repeated rows.
    Texts of any length are hashed whole, empty ones too; an empty table gives no rows; further columns are not read.
    """
    scratch = Scratch(spark, "merkle")
    fields = [encoded(F.col(c)) for c in FIELDS[:-1]]
    text = F.col("text")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(F.concat(*fields, encoded(text)), 256).alias("node"),
        F.when(id_crc() % 3 == 0, F.sha2(F.concat(*fields, encoded(lowered(text))), 256)).alias("tampered"),
    )
    subroots, found = trees(placed(leaves, scratch, "key", ["doc_id", "node"], "leaves"), scratch, "lang")
    langs = placed(subroots.select(F.lit(0).alias("key"), F.col("key").alias("lang"), "node"), scratch, "key", ["lang"], "langs")
    root, tops = trees(langs, scratch, "all")
    tops = tops.select(F.col("lang").alias("key"), F.col("node").alias("subroot"), F.col("path").alias("rest")).crossJoin(F.broadcast(root.select(F.col("node").alias("root"))))  # one row
    whole = found.join(tops, "key").withColumn("path", F.concat("path", "rest"))
    beside = F.aggregate("path", F.lit(""), lambda s, side: F.concat(s, side["left"], side["right"]))
    out = whole.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), folded(F.coalesce("tampered", "node"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and check of every document."""
    return manifest(table(spark, sf_dir, "documents"), spark)


#: Levels of all groups by recursion, then each document's run mates by level, then the fold of each leaf up its levels.
ORACLE = """
with recursive e as (
  select doc_id, coalesce('=' || lang, '') as k,
    coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') as meta,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, (r & 1) * 3988292384))), 4294967295::bigint) as crc
  from documents),
leaf as (
  select doc_id, k, sha256(meta || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
    case when crc % 3 = 0 then sha256(meta || coalesce(octet_length(encode(low)) || ':' || low, '-')) end as tampered from e),
place as (select *, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as p from leaf),
lang(k, lvl, p, node, n) as (
  select k, 0, p, leaf, count(*) over (partition by k) from place
  union all
  select k, lvl + 1, p // 8, sha256(string_agg(node, '' order by p)), (n + 7) // 8 from lang where n > 1 group by k, lvl, p // 8, n),
sub as (select k, lvl as top, node as subroot from lang where n = 1),
subplace as (select *, row_number() over (order by k) - 1 as q from sub),
up(lvl, p, node, n) as (
  select 0, q, subroot, count(*) over () from subplace
  union all
  select lvl + 1, p // 8, sha256(string_agg(node, '' order by p)), (n + 7) // 8 from up where n > 1 group by lvl, p // 8, n),
apex as (select lvl as high, node as root from up where n = 1),
steps as (
  select d.k, d.p, a.lvl, coalesce(string_agg(b.node, '' order by b.p) filter (where b.p < d.p // (8 ** a.lvl)::bigint), '') as l,
    coalesce(string_agg(b.node, '' order by b.p) filter (where b.p > d.p // (8 ** a.lvl)::bigint), '') as r
  from place d join (select distinct k, lvl from lang where n > 1) a on a.k = d.k
  join lang b on b.k = d.k and b.lvl = a.lvl and b.p // 8 = d.p // (8 ** (a.lvl + 1))::bigint group by d.k, d.p, a.lvl
  union all
  select d.k, d.p, s.top + a.lvl, coalesce(string_agg(b.node, '' order by b.p) filter (where b.p < s.q // (8 ** a.lvl)::bigint), ''),
    coalesce(string_agg(b.node, '' order by b.p) filter (where b.p > s.q // (8 ** a.lvl)::bigint), '')
  from place d join subplace s on s.k = d.k join (select distinct lvl from up where n > 1) a on true
  join up b on b.lvl = a.lvl and b.p // 8 = s.q // (8 ** (a.lvl + 1))::bigint group by d.k, d.p, s.top, a.lvl),
fold(k, p, lvl, node) as (
  select k, p, 0, coalesce(tampered, leaf) from place
  union all
  select f.k, f.p, f.lvl + 1, sha256(s.l || f.node || s.r) from fold f join steps s on s.k = f.k and s.p = f.p and s.lvl = f.lvl),
proof as (select k, p, sha256(string_agg(l || r, '' order by lvl)) as h from steps group by k, p),
final as (select k, p, arg_max(node, lvl) as folded_root from fold group by k, p)
select d.doc_id, d.leaf, s.subroot, a.root, coalesce(h, sha256('')) as proof_sha256, f.folded_root, f.folded_root = a.root as verified
from place d join subplace s on s.k = d.k cross join apex a join final f on f.k = d.k and f.p = d.p left join proof on proof.k = d.k and proof.p = d.p
"""
