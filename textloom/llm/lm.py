"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds every training word (as its 64-bit hash) in ascending order with its count; a word's rank is its
id.  Level k holds every k-gram, ordered by its context (the id of its first k - 1 words in the level above) and
its last word; its rank is its id.  Monotone pointers, one list for each shard of the level above, tell where a
context's successors begin and end.  Inside a context's stretch words are kept relative to the context: each
stretch is lifted above the last value of the one before it, so that a shard's whole sequence ascends and takes
one Elias-Fano code, and a successor is searched as the context's base plus the word.  Each k-gram has 8 bits of
the logarithm of its discounted probability, each context 8 bits of its left-over mass.

Smoothing is interpolated absolute discounting over all n-grams, none pruned: p(w | c) = (n - D) / n(c) + mass(c) *
p(w | shorter c), mass(c) = D * kinds(c) / n(c), down to the add-one unigram; terms of unseen n-grams are zero.

Levels are cut into shards of about SHARD_TOKENS counted tokens, by context and, for a context of more, by word;
each is written by one task into the shared folder and memory-mapped by the scoring tasks: the trie grows with
the corpus, but no task or driver holds it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import eliasfano as ef
from textloom.llm.common import Scratch, id_crc, table

DISCOUNT = 0.75
#: Longest n-grams of the query's model; ``train`` takes any.
ORDER = 2
#: Words of a shard of level 1, and counted tokens of one of the others, in the mean; a level has twelve shards at least.
SHARD_ENTRIES, SHARD_TOKENS, LEAST_SHARDS = 2_000_000, 2_000_000, 12
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text
STEP = 12 / 255  # of a quantised base-10 logarithm

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0][0]) < n:
        both = []
        for base in (_R, _R_INV):
            p = np.full(n, base)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = [(both[0], both[1])]
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, one after another with an end each, and how many each text has.

    Words are runs of bytes other than white space, A-Z lower-cased; null counts as empty (an end only).
    """
    raws = [(t or "").encode() for t in texts]
    b = _FOLD[np.frombuffer(b" ".join(raws) + b" ", np.uint8)]
    size = np.array([len(r) + 1 for r in raws], np.int64)
    stop = np.cumsum(size)
    word = np.concatenate(([False], ~_GAP[b], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(b) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)))
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    words = np.diff(np.concatenate(([0], np.searchsorted(starts, stop))))
    out = np.full(len(h) + len(texts), END)
    last = np.cumsum(words + 1) - 1
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner] = h
    return out, words + 1


def _parts(batches: Iterator[pa.RecordBatch], limit: int = 3_000_000) -> Iterator[tuple[list, list]]:
    """(ids, texts) in bounded pieces; a longer text makes one of its own."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = len(t or "")
            if texts and held + n > limit:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += n
        if texts:
            yield ids, texts


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else order
    return k[head], np.add.reduceat(c, head) if len(k) else c


def _counting(keys_of, shard_of=None, room: int = 4_000_000):
    """Counts keys of each task's texts before the shuffle; what is held is emitted whenever it passes ``room`` keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(k), 200_000):
                cols = [pa.array(k[a : a + 200_000].view(np.int64)), pa.array(c[a : a + 200_000])]
                if shard_of is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(shard_of(k[a : a + 200_000])), *cols], names=["shard", "key", "n"])
                else:
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "n"])

        keys, counts, held = [], [], 0
        for _, texts in _parts(batches):
            k, c = np.unique(keys_of(texts), return_counts=True)
            keys.append(k)
            counts.append(c.astype(np.int64))
            held += len(k)
            if held > room:
                k, c = _summed(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held > room // 2:
                    yield from out(k, c)
                    keys, counts, held = [], [], 0
        if keys:
            yield from out(*_summed(keys, counts))

    return run


def shard_bits(entries: int) -> int:
    return max(4, (entries // SHARD_ENTRIES).bit_length())


def local_path(uri: str) -> str:
    """The folder as the tasks open it: the shared folder has to be mounted on all of them."""
    scheme, _, rest = uri.partition(":")
    if rest and scheme != "file":
        raise ValueError(f"memory-mapped levels need a mounted shared folder in spark.checkpoint.dir, not {scheme}")
    return "/" + (rest if rest else uri).lstrip("/")


class _Shards(dict):
    """Files of a level, mapped when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, s: int):
        self[s] = value = self.make(s)
        return value


class Level:
    """Reader of one level of n-grams and of the pointers into it."""

    def __init__(self, folder: str, k: int, parents: np.ndarray):
        head = ef.load(f"{folder}/head{k}")
        self.offsets, self.ctx, self.word = head["offsets"], head["ctx"], head["word"]  # of each shard: first id, first context and word
        self.parents = parents  # first id of each shard of the level above
        self.size = int(self.offsets[-1])
        grams = lambda t: (lambda p: (ef.Code(p), p["prob"], p["counts"]))(ef.load(f"{folder}/grams{k}-{t}"))
        self.grams = _Shards(grams)
        self.next = _Shards(lambda s: (lambda p: (ef.Code(p), p["rest"], int(p["base"][0])))(ef.load(f"{folder}/next{k}-{s}")))

    def stretch(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each context's successors begin and end, and its quantised left-over mass."""
        begin, end, rest = (np.zeros(len(context), np.int64) for _ in range(3))
        for s, row in _by_shard(np.searchsorted(self.parents, context, side="right") - 1):
            code, mass, base = self.next[s]
            i = context[row] - int(self.parents[s])
            begin[row], end[row], rest[row] = base + code.get(i).astype(np.int64), base + code.get(i + 1).astype(np.int64), mass[i]
        return begin, end, rest

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id or -1, quantised probability, quantised left-over mass of the context) of each known context and word."""
        distinct, at = np.unique(context, return_inverse=True)
        begin, end, rest = self.stretch(distinct)
        ids, prob = np.full(len(context), -1, np.int64), np.zeros(len(context), np.int64)
        live = np.flatnonzero((end > begin)[at])
        # the last shard that begins at or before (context, word); a context that goes over several has its first words there
        shard = (np.searchsorted(self.ctx, distinct, side="right") - 1)[at[live]]
        while len(late := np.flatnonzero((shard > 0) & (self.ctx[shard] == context[live]) & (self.word[shard] > word[live]))):
            shard[late] -= 1
        for t, row in _by_shard(shard):
            row = live[row]
            code, q, _ = self.grams[t]
            off, stop = int(self.offsets[t]), int(self.offsets[t + 1])
            here, back = np.unique(at[row], return_inverse=True)
            lo, hi = np.maximum(begin[here], off) - off, np.minimum(end[here], stop) - off
            base = np.where(lo > 0, code.get(np.maximum(lo, 1) - 1) + np.uint64(1), np.uint64(0))
            got = code.find(base[back] + word[row].astype(np.uint64))
            got[(got < lo[back]) | (got >= hi[back])] = -1
            hit = got >= 0
            ids[row[hit]], prob[row[hit]] = got[hit] + off, q[got[hit]]
        return ids, prob, rest[at]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for t, row in _by_shard(np.searchsorted(self.offsets, ids, side="right") - 1):
            out[row] = self.grams[t][2][ids[row] - int(self.offsets[t])]
        return out


class Trie:
    """Reader of a written trie, as far as its levels are there."""

    def __init__(self, folder: str, order: int):
        head = ef.load(f"{folder}/head")
        self.first = head["first"]  # id of each word shard's first word
        self.total, self.size = (int(x) for x in head["totals"])
        self.bits = int(head["bits"][0])
        self.words = _Shards(lambda s: (lambda p: (ef.Code(p), p["counts"]))(ef.load(f"{folder}/words-{s}")))
        self.levels: dict[int, Level] = {}
        parents = self.first
        for k in range(2, order + 1):
            self.levels[k] = Level(folder, k, parents)
            parents = self.levels[k].offsets

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, training count) of each word."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        ends = np.append(self.first[1:], self.size)
        for s, row in _by_shard((hashes >> np.uint64(64 - self.bits)).astype(np.int64)):
            if ends[s] == self.first[s]:
                continue
            code, n = self.words[s]
            got = code.find(hashes[row] & np.uint64((1 << (64 - self.bits)) - 1))
            hit = got >= 0
            ids[row[hit]] = got[hit] + int(self.first[s])
            counts[row[hit]] = n[got[hit]]
        return ids, counts

    def counts(self, k: int, ids: np.ndarray) -> np.ndarray:
        """Training counts of known k-grams."""
        if k > 1:
            return self.levels[k].counts(ids)
        out = np.zeros(len(ids), np.int64)
        for s, row in _by_shard(np.searchsorted(self.first, ids, side="right") - 1):
            out[row] = self.words[s][1][ids[row] - int(self.first[s])]
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """Base-10 logarithm of the add-one probability."""
        return np.log10((counts + 1.0) / (self.total + 1.0 * (self.size + 1)))

    def walk(self, word: np.ndarray, heads: np.ndarray, end: int, order: int, p: np.ndarray | None = None) -> np.ndarray:
        """Context id of each token for n-grams of ``order`` + 1 words, -1 if there is none; a text's first token comes after an end.

        ``p``, the tokens' unigram probabilities, is raised to those of ``order`` in place.
        """
        ids = word
        for k in range(2, order + 2):
            context = np.full(len(word), -1, np.int64)
            context[1:] = ids[:-1]
            context[heads] = end if k == 2 else -1
            if k > order:
                return context
            ids = np.full(len(word), -1, np.int64)
            if p is None:
                both = np.flatnonzero((context >= 0) & (word >= 0))
                ids[both] = self.levels[k].find(context[both], word[both])[0]
                continue
            known = np.flatnonzero(context >= 0)
            got, q, rest = self.levels[k].find(context[known], np.maximum(word[known], 0))
            got[word[known] < 0] = -1
            ids[known] = got
            p[known] = p[known] * 10.0 ** (-STEP * rest) + np.where(got >= 0, 10.0 ** (-STEP * q), 0.0)
        return ids


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    ranked = shard[order]
    cuts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True]))) if len(ranked) else []
    for a, b in zip(cuts, cuts[1:]):
        yield int(ranked[a]), order[a:b]


_OPEN: dict[tuple[str, int], Trie] = {}


def opened(folder: str, order: int) -> Trie:
    """The trie's levels up to ``order``; a worker keeps the last one."""
    if (folder, order) not in _OPEN:
        _OPEN.clear()
        _OPEN[folder, order] = Trie(folder, order)
    return _OPEN[folder, order]


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(p) / STEP), 0, 255).astype(np.uint8)


def _write_shards(df: DataFrame, shards: int, write, schema: str) -> list:
    """Gives each shard's rows (shard, key, n), ascending by key and summed, to one task in turn; write(shard, keys, counts) returns a row of numbers.

    A shard's keys lie together in the order of keys, so one column is sorted by; its rows arrive in batches.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            key, n = _summed(*zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in write(now, key, n)], names=names)

        for batch in batches:
            shard, key, n = (batch.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now is not None and shard[a] != now:
                    yield flush()
                    held = []
                now = int(shard[a])
                held.append((key[a:b].view(np.uint64), n[a:b]))
        if held:
            yield flush()

    return df.repartition(shards, "shard").sortWithinPartitions("key").mapInArrow(run, schema).collect()  # a row for each shard


def bounds(parents: list[tuple[int, int, int]], hot: list[tuple[int, int]], size: int, tokens: int) -> np.ndarray:
    """First keys (context * size + word) of the shards of a level.

    ``parents`` are (first id, entries, counted tokens) of the shards above, each cut into stretches of about
    ``tokens`` tokens; ``hot`` contexts (id, tokens) of more are cut by word.
    """
    cuts = {0}
    for first, entries, n in parents:
        parts = min(entries, -(-n // tokens)) if entries else 0
        cuts |= {(first + entries * i // parts) * size for i in range(parts)}
    for c, n in hot:
        parts = -(-n // tokens)
        cuts |= {c * size + size * i // parts for i in range(parts)} | {(c + 1) * size}
    return np.array(sorted(cuts), np.uint64)


def train(docs: DataFrame, spark: SparkSession, order: int = ORDER) -> str:
    """Counts, smooths and writes the trie of all texts of docs (text); returns its folder.

    Null texts count as empty ones, which are an end; repeated rows count as often as they come.
    """
    scratch = Scratch(spark, "lm")
    folder = local_path(scratch.path("trie"))
    narrow = docs.select(F.lit(0).alias("id"), "text")

    counted = narrow.mapInArrow(_counting(lambda texts: tokens(texts)[0]), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = scratch.keep(counted, "words")
    size, total = (int(x or 0) for x in counted.agg(F.count("*"), F.sum("n")).first())
    bits = shard_bits(size)

    def write_words(s: int, key: np.ndarray, n: np.ndarray) -> tuple[int, int, int]:
        # sorted as signed numbers; a shard's keys have their first bit in common, so their order is the unsigned one
        low = key & np.uint64((1 << (64 - bits)) - 1)
        ef.save(f"{folder}/words-{s}", ef.build(low) | {"counts": n.astype(np.uint32 if n.max() < 2**32 else np.uint64)})
        return s, len(low), int(n.sum())

    shard = F.shiftrightunsigned("key", 64 - bits).cast("int")
    rows = {r["s"]: (r["n"], r["tokens"]) for r in _write_shards(counted.select(shard.alias("shard"), "key", "n"), 1 << bits, write_words, "s long, n long, tokens long")}
    each = [rows.get(s, (0, 0)) for s in range(1 << bits)]
    first = np.cumsum([0, *(n for n, _ in each)])[:-1]
    ef.save(f"{folder}/head", {"first": first.astype(np.int64), "totals": np.array([total, size], np.int64), "bits": np.array([bits], np.int64)})
    part = max(1, min(SHARD_TOKENS, total // LEAST_SHARDS))
    many = [r["key"] for r in counted.filter(F.col("n") > part).collect()]  # at most total / part words
    hot_ids, hot_n = opened(folder, 1).ids(np.array(many, np.int64).view(np.uint64))
    parents, hot = [(int(f), *e) for f, e in zip(first, each)], list(zip(hot_ids.tolist(), hot_n.tolist()))
    scratch.drop("words")
    for k in range(2, order + 1):
        parents, hot = _write_level(narrow, folder, k, order, parents, hot, size, part)
    return folder


def _write_level(narrow: DataFrame, folder: str, k: int, order: int, parents: list, hot: list, size: int, part: int) -> tuple[list, list]:
    """Counts and writes level k and the pointers into it; returns its shards and its hot entries."""
    spark = narrow.sparkSession
    ids_above = parents[-1][0] + parents[-1][1]
    if ids_above * size >= 1 << 63:
        raise ValueError(f"keys of {k}-grams do not fit 63 bits")
    cuts = bounds(parents, hot, size, part)

    def keys(texts: list[str | None]) -> np.ndarray:
        trie = opened(folder, k - 1)
        h, lengths = tokens(texts)
        distinct, at = np.unique(h, return_inverse=True)
        word = trie.ids(distinct)[0]
        context = trie.walk(word[at], np.cumsum(lengths) - lengths, int(word[np.searchsorted(distinct, END)]), k - 1)
        known = context >= 0
        return context[known].astype(np.uint64) * np.uint64(size) + word[at][known].astype(np.uint64)

    def write_grams(t: int, key: np.ndarray, n: np.ndarray) -> tuple[int, ...]:
        context, word = (key // np.uint64(size)).astype(np.int64), key % np.uint64(size)
        head = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        kinds = np.diff(np.append(head, len(key)))
        above = opened(folder, k - 1).counts(k - 1, context[head])
        # each stretch begins above the last value of the one before it
        top = word[np.append(head[1:], len(key)) - 1] + np.uint64(1)
        base = np.concatenate(([np.uint64(0)], np.cumsum(top, dtype=np.uint64)[:-1]))
        p = (n - DISCOUNT) / np.repeat(above, kinds)
        more = n.astype(np.uint32 if n.max() < 2**32 else np.uint64) if k < order else np.zeros(0, np.uint32)
        ef.save(f"{folder}/grams{k}-{t}", ef.build(np.repeat(base, kinds) + word) | {"prob": _quantised(p), "counts": more})
        ef.save(f"{folder}/kinds{k}-{t}", {"ctx": context[head], "kinds": kinds, "above": above})
        return t, len(key), int(context[0]), int(word[0]), int(n.sum())

    def shard_of(key: np.ndarray) -> np.ndarray:
        return (np.searchsorted(cuts, key, side="right") - 1).astype(np.int32)

    got = narrow.mapInArrow(_counting(keys, shard_of), "shard int, key long, n long")
    rows = sorted(_write_shards(got, len(cuts), write_grams, "t long, n long, ctx long, word long, tokens long"), key=lambda r: r["t"])
    names = [r["t"] for r in rows]  # shards of no row have no file
    offsets = np.cumsum([0, *(r["n"] for r in rows)])
    for new, old in enumerate(names):
        for what in ("grams", "kinds"):
            os.replace(f"{folder}/{what}{k}-{old}", f"{folder}/{what}{k}-{new}")
    starts = np.array([r["ctx"] for r in rows], np.int64)
    ef.save(f"{folder}/head{k}", {"offsets": offsets.astype(np.int64), "ctx": starts, "word": np.array([r["word"] for r in rows], np.int64)})

    def write_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, a, entries in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts, mass = np.zeros(entries, np.int64), np.ones(entries)
                t = max(0, int(np.searchsorted(starts, a, side="left")) - 1)  # the first shard that may hold context a
                base = int(offsets[t]) if len(starts) else 0
                while t < len(starts) and starts[t] < a + entries:
                    got = ef.load(f"{folder}/kinds{k}-{t}")
                    base += int(got["kinds"][got["ctx"] < a].sum())
                    inside = (got["ctx"] >= a) & (got["ctx"] < a + entries)
                    at = got["ctx"][inside] - a
                    counts[at] += got["kinds"][inside]  # a context may go over several shards
                    mass[at] = DISCOUNT * counts[at] / got["above"][inside]
                    t += 1
                begin = np.concatenate(([0], np.cumsum(counts))).astype(np.uint64)
                ef.save(f"{folder}/next{k}-{s}", ef.build(begin) | {"rest": _quantised(np.minimum(mass, 1.0)), "base": np.array([base], np.int64)})
            yield batch

    above = [(s, a, n) for s, (a, n, _) in enumerate(parents) if n]
    if above:
        spark.createDataFrame(above, "s long, a long, n long").repartition(len(above), "s").mapInArrow(write_next, "s long, a long, n long").count()
    heavy: list[tuple[int, int]] = []
    if k < order:
        trie = opened(folder, k)

        def hot_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            level = opened(folder, k).levels[k]
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    n = level.grams[t][2]
                    at = np.flatnonzero(n > part)
                    yield pa.RecordBatch.from_arrays([pa.array(at + int(level.offsets[t]), pa.int64()), pa.array(n[at].astype(np.int64))], names=["id", "n"])

        if trie.levels[k].size:
            heavy = [tuple(r) for r in spark.createDataFrame([(t,) for t in range(len(rows))], "t long").mapInArrow(hot_grams, "id long, n long").collect()]  # at most total / part
    return [(int(o), r["n"], r["tokens"]) for o, r in zip(offsets, rows)] or [(0, 0, 0)], heavy


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, folder: str, order: int = ORDER) -> DataFrame:
    """Token counts, add-one unigram score and trie score of every whole text (null: empty).

    Repeated rows give repeated rows, a null id stays null, an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = opened(folder, order)
        for ids, texts in _parts(batches):
            h, lengths = tokens(texts)
            distinct, at = np.unique(h, return_inverse=True)
            word, counts = trie.ids(distinct)
            base = trie.unigram(counts)[at]
            heads = np.cumsum(lengths) - lengths
            p = 10.0**base
            trie.walk(word[at], heads, int(word[np.searchsorted(distinct, END)]), order, p)
            add = lambda x: np.add.reduceat(x, heads)
            cols = [ids, lengths, add((counts[at] > 0).astype(np.int64)), np.full(len(ids), trie.total), add(base), add(np.log10(p))]
            kinds = [pa.int64()] * 4 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SCORES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole document by a model of the training ones."""
    docs = table(spark, sf_dir, "documents")
    folder = train(docs.filter(id_crc() % 7 != 2), spark)
    return score(docs, folder).withColumn("held_out", id_crc() % 7 == 2)
