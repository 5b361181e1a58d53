"""Near-duplicate groups by exact Jaccard similarity of word shingles, with SimHash and Golay keys for candidates.

Texts of few shingles meet exactly: under each shingle of their prefix, the part of the set, common shingles
last, that must hold one of any near text's.  Texts of more shingles meet by sketches, which can miss a pair.
Fingerprints of few bits can't bound Jaccard similarity, so a text gets one short fingerprint in each of
several tables, taken over the least few of its shingle hashes in the table's own order; near copies agree
on some of them whole.  A key is 23 bits of it as they are and a Golay index of 23 others.  Rows that meet
under a key are linked if their wide fingerprints (256 bits over all shingles) are close; the components of
those links are then resolved with the exact similarity of the shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, shuffle_parts
from textloom.llm.components import buckets, components, dealt
from textloom.llm.decontaminate import FILTER_BITS, _bitmap, _probes
from textloom.llm.simhash import forest, golay_indices, shingle_hashes, words_of

TABLES, LEAST = 10, 4
WIDE = 4  # words of 64 bits
#: Wide fingerprints of texts with similarity 0.8 differ in 39 bits in the mean, with a deviation of 6.
WIDE_DISTANCE = 60
#: Pairs whose smaller set has so many shingles at most are found exactly.
SMALL = 64
#: Frequent shingles, ordered last in the prefixes; the others are in hash order.
HOT = 100_000
#: A component of more texts, or of more bytes of shingles, is resolved in parts, which are then compared with each other.
PART, PART_BYTES = 4_000, 96 << 20
_SALT = np.random.default_rng(2024).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mix(h: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = (h ^ salt) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= salt
    return x ^ (x >> np.uint64(29))


def _majority(h: np.ndarray, block: int = 65_536) -> np.uint64:
    votes = np.zeros(64, np.int64)
    raw = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    for a in range(0, len(raw), block):
        votes += np.unpackbits(raw[a : a + block], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(h)).view(">u8")[0].astype(np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(words_of(text), width))


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Short fingerprint in each table and wide fingerprint of a non-empty shingle set."""
    prints = np.zeros(TABLES, np.uint64)
    for t in range(TABLES):
        h = _mix(shingles, _SALT[t])
        prints[t] = _majority(np.partition(h, LEAST - 1)[:LEAST] if len(h) > LEAST else h)
    return prints, np.array([_majority(_mix(shingles, _SALT[32 + i])) for i in range(WIDE)], np.uint64)


def sketch_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the candidate keys of (n, TABLES) short fingerprints; no row has a key twice."""
    exact, other = prints & np.uint64(0x7FFFFF), (prints >> np.uint64(23)) & np.uint64(0x7FFFFF)
    index = golay_indices(other.ravel()).astype(np.uint64).reshape(*prints.shape, 6)
    keys = (np.arange(TABLES, dtype=np.uint64)[:, None] << np.uint64(40)) | (exact[:, :, None] << np.uint64(12)) | index
    take = np.ones(index.shape, bool)
    take[:, :, 1:] = index[:, :, 1:] != index[:, :, :1]  # fewer indices repeat their first
    return keys[take], np.nonzero(take)[0]


SKETCHES = "doc_id long, seal long, digest binary, prints binary, wide binary, shingles binary"


def _sketched(width: int, similarity: float):
    """What a text is found by, so that texts themselves need not meet; all but id and seal are equal for texts with the same words.

    Sets of over SMALL shingles have prints and a wide fingerprint; the sets that can be near one of SMALL, themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SKETCHES.split(", ")]
        for batch in batches:
            made = []
            for text in batch.column(2):
                words = words_of(text.as_py())
                s = np.unique(shingle_hashes(words, width))
                digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                prints, wide = (x.tobytes() for x in sketch(s)) if len(s) > SMALL else (None, None)
                made.append((digest, prints, wide, s.tobytes() if 0 < len(s) <= _largest(similarity) else None))
            columns = zip(*made) if made else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in columns)], names=names)

    return run


def _largest(similarity: float) -> int:
    """Shingles of the largest text that can be near one of SMALL."""
    return int(SMALL / similarity + 1e-9)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the sets, one a row."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))], names=["shingle"])


def prefix(shingles: np.ndarray, similarity: float, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles, frequent ones last: two sets of ``similarity`` or more have one of them in common."""
    n = len(shingles)
    take = n - int(np.ceil(similarity * n - 1e-9)) + 1
    late = np.zeros(n, np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
        late = np.where(hot[at] == shingles, rank[at], 0)
    return shingles[np.lexsort((shingles, late))[:take]]


def _prefixed(similarity: float, order):
    """(key, node, folds) of small sets; the folds are 16 bits of each shingle, equal for equal shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = order.value
        for batch in batches:
            keys, nodes, folds = [], [], []
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = np.frombuffer(raw, np.uint64)
                k = prefix(s, similarity, hot, rank)
                keys.append(k)
                nodes.append(np.full(len(k), node, np.int64))
                folds += [np.sort(s.astype(np.uint16)).tobytes()] * len(k)
            k = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            n = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n), pa.array(folds, pa.binary())], names=["key", "node", "wide"])

    return run


def _near_sets(sets: list[np.ndarray], similarity: float):
    """Which of the items left can be near one: equal shingles have equal folds, so none is missed."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)

    def near(at: int, left: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(sets[at], flat), size[at] - 1)
        common = np.bincount(owner[sets[at][place] == flat], minlength=len(sets))[left]
        return common >= similarity * (size[at] + size[left] - common) - 1e-9

    return near


def _links(out: set[tuple[int, int]]) -> pa.RecordBatch:
    u, v = (np.array(c, np.int64) for c in (zip(*sorted(out)) if out else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _link_small(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cuts, node, raw in buckets(batches, (1, 2), (0, 3, 4)):
            out: set[tuple[int, int]] = set()
            for k in np.flatnonzero(np.diff(cuts) > 1):
                a, b = cuts[k], cuts[k + 1]
                name = node[a:b]
                sets = [np.frombuffer(x, np.uint16) for x in raw[a:b]]
                out |= {(int(name[x]), int(name[y])) for x, y in forest(b - a, _near_sets(sets, similarity))}
            yield _links(out)

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, wide) of the candidate keys of (node, prints, wide)."""
    for batch in batches:
        prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, TABLES)
        keys, row = sketch_keys(prints)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row))], names=["key", "node", "wide"])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cuts, node, raw in buckets(batches, (1, 2), (0, 3, 4)):
        wide = np.frombuffer(b"".join(raw), np.uint64).reshape(-1, WIDE)
        two = cuts[:-1][np.diff(cuts) == 2]
        near = np.bitwise_count(wide[two] ^ wide[two + 1]).sum(axis=1) <= WIDE_DISTANCE
        out = set(zip(node[two[near]].tolist(), node[two[near] + 1].tolist()))
        for k in np.flatnonzero(np.diff(cuts) > 2):
            bits, name = wide[cuts[k] : cuts[k + 1]], node[cuts[k] : cuts[k + 1]]
            out |= {(int(name[x]), int(name[y])) for x, y in forest(len(bits), lambda i, left, bits=bits: np.bitwise_count(bits[left] ^ bits[i]).sum(axis=1) <= WIDE_DISTANCE)}
        yield _links(out)


def _resolve(similarity: float):
    """Classes of a part of a component under exact similarity, by search from text to text."""

    def run(part: pa.Table) -> pa.Table:
        node = part.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        node = node[order]
        raw = part.column("shingles").to_pylist()
        sets = [np.frombuffer(raw[i], np.uint64) for i in order.tolist()]
        cls = np.arange(len(sets))
        for x, y in forest(len(sets), _near_sets(sets, similarity)):
            cls[y] = cls[x]
        return pa.table({"node": pa.array(node), "cls": pa.array(node[cls])})

    return run


def _across(held: DataFrame, classes: DataFrame, similarity: float, scratch: Scratch) -> DataFrame | None:
    """(node, cls) links between the classes of components of over PART texts; none if there are no such.

    Every member is kept: those outside a component's largest class meet all of its members, in pairs of
    parts of PART / 2 texts.  Members of the largest class are one class already.
    """
    of = held.select("node", "component").join(classes, "node")
    counts = of.groupBy("component", "cls").count()
    volume = held.groupBy("component").agg(F.sum(F.octet_length("shingles")).alias("bytes"))
    most = counts.groupBy("component").agg(F.sum("count").alias("texts"), F.count("*").alias("n"), F.max(F.struct("count", "cls")).alias("top")).join(volume, "component")
    most = most.filter(((F.col("texts") > PART) | (F.col("bytes") > PART_BYTES)) & (F.col("n") > 1))
    # texts in half a part: fewer where they are long
    half = F.greatest(F.lit(1.0), F.least(F.lit(PART / 2), F.col("texts") * (PART_BYTES / 2) / F.col("bytes")))
    most = scratch.keep(most.select("component", F.col("top.cls").alias("top"), F.ceil(F.col("top.count") / half).alias("tops"), F.ceil((F.col("texts") - F.col("top.count")) / half).alias("rests")), "most")
    if most.isEmpty():
        return None
    j = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    inside = F.col("cls") == F.col("top")
    part = F.pmod(F.xxhash64("node", F.lit("across")), F.when(inside, F.col("tops")).otherwise(F.col("rests")))
    # Parts of the largest class count from -1 down, those of the others from 0 up.
    with_top = F.transform(j(F.col("rests")), lambda x: pair(-1 - F.col("part"), x))
    with_rest = F.concat(F.transform(j(F.col("tops")), lambda x: pair(-1 - x, F.col("part"))), F.transform(F.filter(j(F.col("rests")), lambda x: x != F.col("part")), lambda x: pair(F.least(x, F.col("part")), F.greatest(x, F.col("part")))))
    spread = held.join(classes, "node").join(most, "component").withColumn("part", part).withColumn("with", F.when(inside, with_top).otherwise(with_rest))
    pairs = spread.select("component", "node", "shingles", F.explode("with").alias("w")).select("component", "w.a", "w.b", "node", "shingles")
    got = pairs.groupBy("component", "a", "b").applyInArrow(_resolve(similarity), "node long, cls long")
    return scratch.keep(got.filter("node <> cls").distinct(), "across")


def near_duplicate_classes(docs: DataFrame, spark: SparkSession, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, class_id): the least doc_id of the texts reachable over similarities of ``similarity`` or more.

    Ids may repeat: each of the texts of an id counts.  Words and shingles are as for the fingerprints; texts with the same words are one node, null and empty
    texts have none and are alike.  Pairs of which one has SMALL shingles or fewer are all found; of the others,
    at the threshold, 99.5 % share a key, and more above it.  Components of candidates of more than PART texts are resolved in parts whose classes meet
    again by their least members while that shrinks them; then all members are compared across classes.
    """
    scratch = Scratch(spark, "neardup")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("seal"), "text")
    # Texts are read once and stay where they are: copies meet by digest, and the others by the sketches made beside it.
    sketches = scratch.keep(narrow.mapInArrow(_sketched(width, similarity), SKETCHES), "sketches")
    # A node is a digest, numbered; the row that stands for it is found by id and seal, as ids may repeat.
    same = [F.first(c).alias(c) for c in ("prints", "wide", "shingles")]
    nodes = sketches.groupBy("digest").agg(F.min(F.struct("doc_id", "seal")).alias("lead"), *same).withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.keep(nodes.select("digest", "lead.*", "node", "prints", "wide", "shingles"), "nodes")
    by_bucket = lambda df: dealt(df, spark).repartition(shuffle_parts(spark), "key", "a", "b").sortWithinPartitions("key", "a", "b")
    met = by_bucket(scratch.keep(nodes.filter("prints is not null").select("node", "prints", "wide").mapInArrow(_keyed, "key long, node long, wide binary"), "keyed"))
    small = nodes.filter("shingles is not null")
    often = small.select("shingles").mapInArrow(_members, "shingle long").groupBy("shingle").count().filter("count > 8").orderBy(F.desc("count"), "shingle").limit(HOT)
    seen = often.toArrow()
    hot, rank = (seen.column(c).to_numpy() for c in ("shingle", "count"))
    hot = hot.view(np.uint64)
    order = spark.sparkContext.broadcast((hot[np.argsort(hot)], rank[np.argsort(hot)]))
    short = small.select("node", "shingles").mapInArrow(_prefixed(similarity, order), "key long, node long, wide binary")
    near = by_bucket(scratch.keep(short, "short"))
    both = met.mapInArrow(_link, "u long, v long").unionByName(near.mapInArrow(_link_small(similarity), "u long, v long"))
    found = scratch.keep(components(spark, both.distinct()), "candidates")
    for name in ("keyed", "short"):
        scratch.drop(name)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["node", "component", "shingles"])

    leads = scratch.keep(nodes.join(found, "node").select("doc_id", "seal", "node", "component"), "leads")  # its size is known then
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (leads.count() * 16).bit_length()))
    seals = spark.sparkContext.broadcast(_bitmap(leads.select(F.col("seal").alias("hash")), bits))  # 2^27 bits at most

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of the leads' seals, and few others: only these meet the leads."""
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for at in _probes(batch.column(1).to_numpy().view(np.uint64), bits):
                hit &= (seals.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1) > 0
            yield batch.filter(pa.array(hit))

    passed = narrow.mapInArrow(passing, "doc_id long, seal long, text string")
    wanted = passed.join(leads, ["doc_id", "seal"]).select("node", "component", "text").dropDuplicates(["node"])
    held = scratch.keep(wanted.mapInArrow(sets, "node long, component long, shingles binary"), "sets")
    scratch.drop("leads")
    classes, todo, r = None, held, 0
    while True:
        parts = F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum(F.octet_length("shingles")) / PART_BYTES))
        sizes = todo.groupBy("component").agg(parts.alias("parts"))
        parted = todo.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node", F.lit(r)), F.col("parts")))
        got = scratch.keep(parted.groupBy("component", "part").applyInArrow(_resolve(similarity), "node long, cls long"), f"classes{r}")
        classes = got if classes is None else scratch.keep(classes.join(got.toDF("cls", "up"), "cls", "left").select("node", F.coalesce("up", "cls").alias("cls")), f"merged{r}")
        large = scratch.keep(sizes.filter("parts > 1").select("component"), f"large{r}")
        if r >= 20 or large.isEmpty():
            break
        reps = got.select(F.col("cls").alias("node")).distinct()
        nxt = scratch.keep(todo.join(large, "component", "left_semi").join(reps, "node", "left_semi").select("node", "component", "shingles"), f"reps{r}")
        if nxt.count() == todo.count():
            break
        todo, r = nxt, r + 1
    more = _across(held, classes, similarity, scratch)
    if more is not None:
        links = classes.filter("node <> cls").unionByName(more).toDF("u", "v")
        whole = scratch.keep(components(spark, links), "whole").toDF("cls0", "up")
        classes = scratch.keep(classes.join(whole, classes.node == whole.cls0, "left").select("node", F.coalesce("up", "node").alias("cls")), "all")
    linked = scratch.keep(nodes.join(classes, "node").select("node", "doc_id", "cls"), "linked")
    least = linked.groupBy("cls").agg(F.min("doc_id").alias("class_id"))
    of = nodes.join(linked.join(least, "cls").select("node", "class_id"), "node", "left").select("digest", F.coalesce("class_id", "doc_id").alias("class_id"))
    return sketches.select("doc_id", "digest").join(of, "digest").select("doc_id", "class_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group, with its columns as they are.

    Rows without an id are kept; rows that repeat an id share its fate.
    """
    gone = near_duplicate_classes(docs.filter("doc_id is not null"), spark).filter("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = Scratch(spark, "copies").keep(gone, "ids")  # its size is known then: no text moves for a few
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti").select(*docs.columns)
