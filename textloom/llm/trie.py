"""Prefix trie of conversations, kept as the chains of nodes that each conversation is the least member of.

A node is a digest of a rebuilt conversation's first d turns; its owner is the least conv_id that has it.  Who
owns a prefix owns every longer one of its own, so a conversation's first owned depth is found by halving: each
round, all open conversations look up the digest of their middle depth and join it with the owners' table.  Owned
depths form a chain, which hangs on the chain of the owner one turn higher up.  Totals go from the chains
upwards to all chains above them, reached in doubling steps, and down each chain's depths as running sums.

No step holds a conversation: turns are placed by ranges, digests are chained in segments of SEGMENT turns whose
ends are chained again, and running sums go in the same two levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, placed, shuffle_parts, table

#: Conversations of a block share the first of them as the source of their leading turns.
BLOCK, LEADS = 20, 4
SEGMENT = 1024
WORD = r"[^\x20\x09-\x0D]+"


def _turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((conv, length), (conv, depth, turn, words)): the rebuilt conversations' turns, depth from 1, as digests with word counts.

    Turns of one number order by the digest of role and text.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", _turn_digest(F.coalesce("role", F.lit("")), text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    own = placed(narrow, scratch, "conv", ["turn", "digest"], "turns")
    sizes = scratch.keep(own.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % LEADS).cast("int")), "sizes")
    lead = sizes.select(F.col("conv").alias("base"), F.least(F.col("n"), F.lit(LEADS)).alias("had"))
    convs = sizes.withColumn("base", F.col("conv") - F.col("conv") % BLOCK).join(lead, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("had", F.lit(0))).alias("led"), "n")
    convs = scratch.keep(convs.withColumn("length", F.col("led") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")
    heads = own.filter(F.col("place") < LEADS - 1).select(F.col("conv").alias("base"), "place", "digest", "words")
    borrowed = convs.filter("led > 0").select("conv", "base", "led").join(heads, "base").filter("place < led")
    kept = own.join(convs.select("conv", "h", "led"), "conv").filter("place >= h")
    steps = borrowed.select("conv", (F.col("place") + 1).alias("depth"), "digest", "words").unionByName(kept.select("conv", (F.col("place") - F.col("h") + F.col("led") + 1).alias("depth"), "digest", "words"))
    return convs.select("conv", "length"), scratch.keep(steps, "steps")


def _segment(depth: Column) -> Column:
    return F.floor((depth - 1) / SEGMENT)


def _chained(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """rows (group.., order, .., digest) with each digest replaced by that of all up to it in its group; streamed in sorted order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, so_far = None, b""
        for batch in batches:
            out = []
            for key, d in zip(zip(*[batch.column(g).to_pylist() for g in group]), batch.column("digest").to_pylist()):
                so_far = hashlib.sha256((so_far if key == last else b"") + d).digest()
                last = key
                out.append(so_far)
            at = batch.schema.get_field_index("digest")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.repartition(shuffle_parts(rows.sparkSession), *group).sortWithinPartitions(*group, order).mapInArrow(run, rows.schema)


def prefixes(convs: DataFrame, steps: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, depth, words, node): the digest of each prefix, the empty one included."""
    parts = scratch.keep(_chained(steps.withColumn("segment", _segment(F.col("depth"))), ["conv", "segment"], "depth"), "parts")
    ends = parts.filter(F.col("depth") % SEGMENT == 0).select("conv", "segment", "digest")
    carried = _chained(ends, ["conv"], "segment").select("conv", (F.col("segment") + 1).alias("segment"), F.col("digest").alias("carry"))
    node = F.when(F.col("carry").isNull(), F.col("digest")).otherwise(F.unhex(F.sha2(F.concat("carry", "digest"), 256)))
    whole = parts.join(carried, ["conv", "segment"], "left").select("conv", "depth", "words", node.alias("node"))
    empty = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), F.unhex(F.lit("")).alias("node"))
    return scratch.keep(whole.unionByName(empty), "prefixes")


def first_owned(convs: DataFrame, prefix: DataFrame, owners: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, length, first): the least depth whose prefix the conversation owns, length + 1 if none."""
    now = scratch.keep(convs.select("conv", "length", F.lit(0).cast("long").alias("low"), (F.col("length") + 1).alias("high")), "search0")
    longest = convs.agg(F.max("length")).first()[0]
    for k in range(1, ((longest or 0) + 1).bit_length() + 1 if longest is not None else 1):
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        asked = now.filter("low < high").withColumn("depth", middle).join(prefix.select("conv", "depth", "node"), ["conv", "depth"])
        told = asked.join(owners.select("depth", "node", "owner"), ["depth", "node"])
        mine = F.col("owner") == F.col("conv")
        moved = told.select("conv", "length", F.when(mine, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(mine, F.col("depth")).otherwise(F.col("high")).alias("high"))
        now = scratch.keep(now.filter("low = high").unionByName(moved), f"search{k}")
        scratch.drop(f"search{k - 1}")
    return now.select("conv", "length", F.col("low").alias("first"))


def _above(chains: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, up, at): every chain that a chain hangs on, directly or not, and the depth where; from (conv, up, at) of the direct ones."""
    found, jump = chains, chains.select("conv", "up")  # jump: the chain 2^k links up
    k = 0
    while True:
        higher = found.select(F.col("conv").alias("up"), F.col("up").alias("top"), "at")
        fresh = scratch.keep(jump.join(higher, "up").select("conv", F.col("top").alias("up"), "at"), f"fresh{k}")
        if fresh.isEmpty():
            return found
        found = scratch.keep(found.unionByName(fresh), f"above{k}")
        jump = scratch.keep(jump.join(jump.select(F.col("conv").alias("up"), F.col("up").alias("top")), "up").select("conv", F.col("top").alias("up")), f"jump{k}")
        k += 1


def _downward(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (conv, depth, ..) with each column summed over its conversation's depths from the row's own down to the last."""
    rows = rows.withColumn("segment", _segment(F.col("depth") + 1))
    segments = rows.groupBy("conv", "segment").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    later = Window.partitionBy("conv").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    after = segments.select("conv", "segment", *[F.sum(f"_{c}").over(later).alias(f"_{c}") for c in columns])
    within = Window.partitionBy("conv", "segment").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.select(*[c for c in rows.columns if c not in columns], *[F.sum(c).over(within).alias(c) for c in columns])
    return summed.join(after, ["conv", "segment"]).select(*[c for c in summed.columns if c not in ("segment", *columns)], *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns])


def _ends(rows: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) from (conv, depth, member): each node's ending members in order, hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            conv, depth, member = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1]))) if len(conv) else np.zeros(0, int)
            out = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(conv)]):
                now, ids = (int(conv[a]), int(depth[a])), ",".join(map(str, member[a:b].tolist())).encode()
                if now == key:
                    state.update(b"," + ids)
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(ids)
            yield made(out)
        yield made([] if key is None else [(*key, state.hexdigest())])

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.int64(), pa.string()))], names=["conv", "depth", "ends_sha256"])

    spread = rows.repartition(shuffle_parts(rows.sparkSession), "conv", "depth").sortWithinPartitions("conv", "depth", "member")
    return spread.mapInArrow(run, "conv long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, spark: SparkSession) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the empty one at the root.

    A null role or text is empty and a null turn comes first; repeated rows are turns of their own; turns of one
    number order by a digest of role and text.  Rows without a conv_id belong to no conversation and are left
    out.  A remainder of a
    negative conv_id is negative, as in SQL.  Conversations and texts of any length are taken whole; an empty table has no conversations and no
    root; further columns are not read.
    """
    scratch = Scratch(spark, "trie")
    convs, steps = rebuilt(conversations.select("conv_id", "turn", "role", "text"), scratch)
    prefix = prefixes(convs, steps, scratch)
    owners = scratch.keep(prefix.groupBy("depth", "node").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs")), "owners")
    first = first_owned(convs, prefix, owners, scratch)
    hung = first.filter("first > 0").withColumn("at", F.col("first") - 1)
    hung = hung.join(prefix.select("conv", F.col("depth").alias("at"), "node"), ["conv", "at"]).join(owners.select(F.col("depth").alias("at"), "node", F.col("owner").alias("up")), ["at", "node"])
    first = scratch.keep(first.join(hung.select("conv", "up"), "conv", "left"), "first")  # up: the owner one turn above the chain; of none, of its last turn

    owned = prefix.join(first, "conv").filter("depth >= first").join(owners.select("depth", "node", "n_convs"), ["depth", "node"])
    nodes = scratch.keep(owned.select("conv", "depth", F.when(F.col("depth") > F.col("first"), F.col("conv")).otherwise(F.col("up")).alias("parent"), "n_convs", (F.col("depth") < F.col("length")).cast("long").alias("next"), (F.col("words") * (F.col("n_convs") - 1)).alias("saved")), "nodes")

    links = scratch.keep(first.filter("first > 0 and first <= length").select("conv", "up", (F.col("first") - 1).alias("at")), "links")
    children = links.groupBy(F.col("up").alias("conv"), F.col("at").alias("depth")).agg(F.count("*").alias("hung"))
    nodes = scratch.keep(nodes.join(children, ["conv", "depth"], "left").withColumn("n_children", F.col("next") + F.coalesce("hung", F.lit(0))).withColumn("leaves", (F.col("n_children") == 0).cast("long")), "counted")
    chains = nodes.groupBy("conv").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = _above(links, scratch).join(chains, "conv").groupBy(F.col("up").alias("conv"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    summed = nodes.join(below, ["conv", "depth"], "left").select("conv", "depth", "parent", "n_convs", "n_children", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])

    ending = first.select(F.when(F.col("first") <= F.col("length"), F.col("conv")).otherwise(F.col("up")).alias("conv"), F.col("length").alias("depth"), F.col("conv").alias("member"))
    found = _downward(summed, ["leaves", "saved"]).join(_ends(ending), ["conv", "depth"], "left")
    return found.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the conversations' trie."""
    return prefix_trie(table(spark, sf_dir, "conversations"), spark)


#: Prefixes as digests of all turns up to a depth; a node's subtree is what its members' own nodes are at that depth or deeper.
ORACLE = r"""
with o as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as p
  from conversations where conv_id is not null),
crc as (
  select c, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, (r & 1) * 3988292384))), 4294967295::bigint) % 4 as h
  from (select c, count(*) as n from o group by c)),
conv as (select a.c, a.h, a.c - a.c % 20 as b, least(a.h, coalesce(z.n, 0)) as led, least(a.h, coalesce(z.n, 0)) + greatest(a.n - a.h, 0) as len from crc a left join crc z on z.c = a.c - a.c % 20),
r as (
  select v.c, o.p + 1 as d, o.role, o.text from conv v join o on o.c = v.b and o.p < v.led
  union all
  select v.c, o.p - v.h + v.led + 1, o.role, o.text from conv v join o on o.c = v.c and o.p >= v.h),
pre as (
  select c, d, sha256(string_agg(octet_length(encode(role)) || ':' || octet_length(encode(text)) || ':' || role || text, '' order by d) over (partition by c order by d)) as k,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w from r
  union all
  select c, 0, '', 0 from conv),
node as (select d, k, min(c) as c, count(*) as n, any_value(w) as w from pre group by d, k),
up as (select n.*, m.c as parent from node n left join pre p on p.c = n.c and p.d = n.d - 1 left join node m on m.d = p.d and m.k = p.k),
kids as (select parent as c, d - 1 as d, count(*) as n from up where d > 0 group by all),
whole as (select u.*, coalesce(k2.n, 0) as children from up u left join kids k2 on k2.c = u.c and k2.d = u.d),
sub as (
  select a.d, a.k, sum((m.children = 0)::int)::bigint as leaves, sum(m.w * (m.n - 1))::bigint as saved
  from whole m join pre a on a.c = m.c and a.d <= m.d group by a.d, a.k),
ends as (select p.d, p.k, sha256(string_agg(v.c::varchar, ',' order by v.c)) as h from conv v join pre p on p.c = v.c and p.d = v.len group by p.d, p.k)
select w.c as conv_id, w.d::bigint as depth, w.parent as parent_conv_id, w.n as n_convs, w.children as n_children, s.leaves as n_leaves, s.saved as saved_tokens, coalesce(h, sha256('')) as ends_sha256
from whole w join sub s on s.d = w.d and s.k = w.k left join ends e on e.d = w.d and e.k = w.k
"""
