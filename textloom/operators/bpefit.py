"""Learning a byte-level BPE from a table of texts: counts of distinct words, merges in batches, counts kept by differences.

Texts never leave the executors.  They become one table of distinct words with counts, each word a list of symbols.
A round takes the most frequent pairs, finds how often a new symbol of each would stand beside any neighbour, and
merges as many of the pairs, in order, as must come next whatever the merges before them make: no pair that an
earlier one of the batch could take from, and none that a new pair could overtake.  The batch is what one merge at
a time would choose.  Only words that change send differences to the pairs' counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import pieces
from textloom.operators.bpe import portions
from textloom.sources.scratch import Scratch
from textloom.sources.sinks import replace_json

#: Fixed value: how byte-level tokenizers cut a text into words before bytes are merged, for Java's regular expressions.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
#: Pairs looked at in a round.
CANDIDATES = 256
#: Rounds after which the differences are summed into one table again.
COMPACT = 8


def byte_letters() -> list[str]:
    """For each byte the printable character that stands for it in a vocabulary: itself, or the next ones from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def alphabet() -> tuple[list[str], np.ndarray]:
    """(symbols by id, id of each byte): all 256 bytes, in the order of the characters that stand for them."""
    letters = byte_letters()
    order = sorted(range(256), key=lambda b: letters[b])
    ids = np.zeros(256, np.int32)
    ids[order] = np.arange(256)
    return [letters[b] for b in order], ids


#: Symbols of a block of words, about.
BLOCK = 1 << 20
#: Words in blocks, as bytes of int64 counts, int32 symbols of all words and int32 numbers of symbols: a row a block, as a row a word costs more than the merging.
BLOCKS = "counts binary, symbols binary, sizes binary"


def _block(counts: np.ndarray, symbols: np.ndarray, sizes: np.ndarray) -> dict[str, pa.Array]:
    kinds = {"counts": (counts, np.int64), "symbols": (symbols, np.int32), "sizes": (sizes, np.int32)}
    return {name: pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary()) for name, (x, kind) in kinds.items()}


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Blocks of the distinct words of all texts with their counts, as lists of byte ids; null texts have none."""
    _, ids = alphabet()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for share in pieces.shares(batch.column(0)):
                words, _ = pieces.stretches(share)
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()), pa.array(n)], names=["stretch", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            raw, ends = pieces.inside(batch.column(0).cast(pa.large_binary()))
            parts.append((batch.column(1).to_numpy(), ids[raw], np.diff(ends)))
            held += len(raw)
            if held >= BLOCK:
                yield pa.RecordBatch.from_pydict(_block(*map(np.concatenate, zip(*parts))))
                parts, held = [], 0
        if held:
            yield pa.RecordBatch.from_pydict(_block(*map(np.concatenate, zip(*parts))))

    distinct = texts.select(text).mapInArrow(cut, "stretch string, n long")  # equal stretches of a share are cut into words once
    words = distinct.select(F.explode(F.regexp_extract_all("stretch", F.lit(WORD), F.lit(0))).alias("word"), "n")
    return words.groupBy("word").agg(F.sum("n").alias("count")).mapInArrow(run, BLOCKS)


def merged(flat: np.ndarray, word: np.ndarray, left: int, right: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, word, words changed) with each left and right that stand side by side in a word replaced by new, from the left."""
    if len(flat) < 2:
        return flat, word, word[:0]
    at = np.flatnonzero((flat[:-1] == left) & (flat[1:] == right) & (word[:-1] == word[1:]))
    if left == right and len(at):  # in a run of hits, each second one overlaps the one before
        run = np.flatnonzero(np.append(True, np.diff(at) != 1))
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
    flat = flat.copy()
    flat[at] = new
    keep = np.ones(len(flat), bool)
    keep[at + 1] = False
    return flat[keep], word[keep], np.unique(word[at])


def _pairs(flat: np.ndarray, word: np.ndarray, count: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    same = word[:-1] == word[1:]
    return (flat[:-1][same].astype(np.int64) << 32) | flat[1:][same], sign * count[word[:-1][same]]


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, which, values)
    return keys[sums != 0], sums[sums != 0]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols of all words, the word of each, counts) of each block."""
    for batch in batches:
        for row in batch.select(["counts", "symbols", "sizes"]).to_pylist():
            sizes = np.frombuffer(row["sizes"], np.int32)
            yield np.frombuffer(row["symbols"], np.int32), np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(row["counts"], np.int64)


ROUND = BLOCKS + ", pairs array<struct<key:long,n:long>>"


def _apply(merges: list[tuple[int, int, int]] | None):
    """Words after the merges, with each block's differences of pair counts.  None: all pairs as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, word, count in _words(batches):
            if merges is None:
                keys, n = _summed(*_pairs(flat, word, count, 1))
            else:
                before, changed = (flat, word), np.zeros(len(count), bool)
                for left, right, new in merges:
                    flat, word, hit = merged(flat, word, left, right, new)
                    changed[hit] = True
                old, now = (_pairs(f[changed[w]], w[changed[w]], count, s) for (f, w), s in ((before, -1), ((flat, word), 1)))
                keys, n = _summed(np.concatenate([old[0], now[0]]), np.concatenate([old[1], now[1]]))
            rows = pa.StructArray.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])
            block = _block(count, flat, np.bincount(word, minlength=len(count)))
            yield pa.RecordBatch.from_pydict(block | {"pairs": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), rows)})

    return run


def _beside(pairs: list[tuple[int, int]]):
    """(pair, other, n): how often each neighbour, left (negative) or right, stands beside each of the pairs."""
    wanted = np.array([(a << 32) | b for a, b in pairs], np.int64)
    order = np.argsort(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, word, count in _words(batches):
            if len(flat) < 3:
                continue
            keys = (flat[:-1].astype(np.int64) << 32) | flat[1:]
            at = np.minimum(np.searchsorted(wanted[order], keys), len(wanted) - 1)
            hit = np.flatnonzero((wanted[order][at] == keys) & (word[:-1] == word[1:]))
            which = order[at[hit]].astype(np.int64)
            ahead, behind = (hit > 0) & (word[hit - 1] == word[hit]), hit + 2 < len(flat)
            behind[behind] = word[hit[behind] + 2] == word[hit[behind]]
            sides = [(which[ahead], -1 - flat[hit[ahead] - 1].astype(np.int64), count[word[hit[ahead]]]), (which[behind], flat[hit[behind] + 2].astype(np.int64), count[word[hit[behind]]])]
            pair, other, n = (np.concatenate(c) for c in zip(*sides))
            key, n = _summed((pair << 33) | (other + (1 << 32)), n)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 33), pa.array((key & ((1 << 33) - 1)) - (1 << 32)), pa.array(n)], names=["pair", "other", "n"])

    return run


def batch_of(top: list[tuple[int, int, int]], bounds: dict[int, int], least: int) -> list[tuple[int, int]]:
    """The pairs that one merge at a time would take next, in order, of ``top`` (left, right, n), most first.

    ``bounds`` has for each place in top how frequent a pair with its new symbol can be.  A later pair is sure
    only if none merged before it takes its symbols (its last is an earlier one's first, its first an earlier one's
    last, or either is doubled in one), and it is more frequent than any pair that they make.
    """
    taken: list[tuple[int, int]] = []
    made = 0
    for k, (left, right, n) in enumerate(top):
        if n < least or (taken and n <= made):
            break
        if any(right == a or left == b or (a == b and a in (left, right)) or (left == right and left in (a, b)) for a, b in taken):
            break
        taken.append((left, right))
        made = max(made, bounds.get(k, 0))
    return taken


def fit(texts: DataFrame, scratch: Scratch, vocab_size: int = 8192, min_frequency: int = 2, text: str = "text") -> list[tuple[int, int]]:
    """The merges, in order, as pairs of symbol ids: 0 to 255 are the bytes, each merge makes the next one.

    Most frequent pair first, of equal ones the least ids; until vocab_size symbols are there or no pair occurs
    min_frequency times.  The driver holds merges and a round's candidates only.
    """
    if vocab_size < 256:
        raise ValueError("a byte-level vocabulary has 256 entries at least")
    if min_frequency < 1:
        raise ValueError("min_frequency must be positive")
    merges: list[tuple[int, int]] = []
    words = scratch.keep(word_counts(texts, text).mapInArrow(_apply(None), ROUND), "words0")
    counted = words.select(F.explode("pairs").alias("p")).select("p.*")
    sums = lambda df: df.groupBy("key").agg(F.sum("n").alias("n"))
    k = 0
    while 256 + len(merges) < vocab_size:
        if k % COMPACT == 0:
            counted = scratch.keep(sums(counted), f"pairs{k}")
            for old in range(k - COMPACT, k):
                scratch.drop(f"words{old}")
            scratch.drop(f"pairs{k - COMPACT}")
        now = sums(counted).filter(F.col("n") >= min_frequency).orderBy(F.desc("n"), "key").limit(CANDIDATES).collect()  # CANDIDATES rows
        top = [(r.key >> 32, r.key & 0xFFFFFFFF, r.n) for r in now]
        if not top:
            break
        beside = words.select("counts", "symbols", "sizes").mapInArrow(_beside([t[:2] for t in top]), "pair long, other long, n long")
        most = beside.groupBy("pair", "other").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.max("n").alias("n")).collect()  # CANDIDATES rows
        chosen = batch_of(top, {r.pair: r.n for r in most}, min_frequency)[: vocab_size - 256 - len(merges)]
        fresh = [(a, b, 256 + len(merges) + i) for i, (a, b) in enumerate(chosen)]
        merges += chosen
        if 256 + len(merges) >= vocab_size:
            break
        k += 1
        after = scratch.keep(words.select("counts", "symbols", "sizes").mapInArrow(_apply(fresh), ROUND), f"words{k}")
        counted = counted.unionByName(after.select(F.explode("pairs").alias("p")).select("p.*"))
        words = after
    return merges


def vocabulary(merges: list[tuple[int, int]]) -> list[str]:
    """The symbols by id, in the characters that stand for bytes."""
    symbols, _ = alphabet()
    for a, b in merges:
        symbols.append(symbols[a] + symbols[b])
    return symbols


def tokenizer_json(merges: list[tuple[int, int]]) -> str:
    """The tokenizer as a file that the tokenizers library reads."""
    symbols = vocabulary(merges)
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {s: i for i, s in enumerate(symbols)}, "merges": [[symbols[a], symbols[b]] for a, b in merges]}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model}, ensure_ascii=False)


#: Characters of a stretch that is encoded in columns; a longer one is left to the library.
SHORT = 256


class Encoder:
    """Counts tokens by a learned tokenizer (its JSON) and decodes them again, each distinct stretch of the texts once.

    Stretches of settled characters are encoded in columns: in each round every piece merges, from the left, its pair
    that was learned first, which is what one merge at a time does, as a new symbol's pairs are learned later.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        model = json.loads(tokenizer)["model"]
        ids, letters = model["vocab"], byte_letters()
        self.bytes = np.array([ids[c] for c in letters], np.int64)
        byte = {c: b for b, c in enumerate(letters)}
        symbols = [bytes(byte[c] for c in s) for s in sorted(ids, key=ids.get)]
        self.spelled = np.frombuffer(b"".join(symbols), np.uint8)
        self.sizes = np.array([len(s) for s in symbols])
        self.begins = np.cumsum(self.sizes) - self.sizes
        keys = np.array([ids[a] << 32 | ids[b] for a, b in model["merges"]], np.int64)
        self.made = np.array([ids[a + b] for a, b in model["merges"]], np.int64)
        self.rank = np.argsort(keys)
        self.keys = keys[self.rank]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, dict[int, bytes]]:
        """(tokens of each text, those that decoding gives otherwise by place), for large binaries as in ``pieces.shares``."""
        words, at = pieces.stretches(texts)
        n, same = self.words(words.dictionary)
        which = words.indices.to_numpy()
        total, wrong = (np.append(0, np.cumsum(x[which])) for x in (n, ~same))
        found, other = total[at[1:]] - total[at[:-1]], {}
        for k in np.flatnonzero(wrong[at[1:]] > wrong[at[:-1]]).tolist():  # a stretch is not kept: the text is decoded whole
            text = texts[k].as_py()
            found[k], back = self._by_library([text.decode()])[0]
            if back != text:
                other[k] = back
        return found, other

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, whether decoding gives it again) of each word, no one empty."""
        n, same = np.zeros(len(words), np.int64), np.ones(len(words), bool)
        if not len(words):
            return n, same
        points, _, word = pieces.characters(words)
        fit = np.bincount(word, pieces.kinds(points) == 0) == 0
        fit &= np.bincount(word) <= SHORT
        if fit.any():
            n[fit], same[fit] = self._in_columns(words.filter(pa.array(fit)))
        rest = [w.decode() for w in words.filter(pa.array(~fit)).to_pylist()]
        at = np.flatnonzero(~fit)
        for part in portions(rest):
            out = self._by_library(part)
            n[at[: len(part)]] = [size for size, _ in out]
            same[at[: len(part)]] = [back == w.encode() for w, (_, back) in zip(part, out)]
            at = at[len(part) :]
        return n, same

    def _by_library(self, texts: list[str]) -> list[tuple[int, bytes]]:
        ids = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return [(len(x), t.encode()) for x, t in zip(ids, self.library.decode_batch(ids, skip_special_tokens=False))]

    def _in_columns(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        points, at, word = pieces.characters(words)
        begins = np.flatnonzero(pieces.piece_starts(points, pieces.kinds(points), word))
        raw, _ = pieces.inside(words)
        length = np.diff(np.append(at[begins], len(raw)))
        n, same = np.zeros(len(begins), np.int64), np.ones(len(begins), bool)
        flat, piece, source = self.bytes[raw], np.repeat(np.arange(len(begins)), length), raw
        while len(flat):
            first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            size = np.diff(np.append(first, len(flat)))
            rank = np.full(len(flat), len(self.made))
            if len(self.keys):
                key = (flat[:-1] << 32) | flat[1:]
                near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = np.flatnonzero((self.keys[near] == key) & (piece[:-1] == piece[1:]))
                rank[hit] = self.rank[near[hit]]
            least = np.minimum.reduceat(rank, first)
            over = least == len(self.made)
            if over.any():  # nothing left to merge in these: they are counted, decoded and put away
                ended = np.repeat(over, size)
                n[piece[first[over]]] = size[over]
                gone = np.repeat(over, length[piece[first]])
                same[piece[first[over]]] = self._decodes(flat[ended], np.repeat(np.arange(over.sum()), size[over]), source[gone], length[piece[first[over]]])
                flat, piece, rank, source = flat[~ended], piece[~ended], rank[~ended], source[~gone]
                size, least = size[~over], least[~over]
            hit = np.flatnonzero((rank == np.repeat(least, size)) & (rank < len(self.made)))
            run = np.flatnonzero(np.append(True, np.diff(hit) != 1)) if len(hit) else hit  # in a run of hits, each second one overlaps the one before
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            flat[hit] = self.made[rank[hit]]
            keep = np.ones(len(flat), bool)
            keep[hit + 1] = False
            flat, piece = flat[keep], piece[keep]
        of = word[begins]
        return np.bincount(of, n, len(words)).astype(np.int64), np.bincount(of, ~same, len(words)) == 0

    def _decodes(self, flat: np.ndarray, piece: np.ndarray, source: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether each piece's symbols spell the bytes it came from."""
        sizes = self.sizes[flat]
        total = np.bincount(piece, sizes, len(length)).astype(np.int64)
        if (total != length).any():
            return np.zeros(len(length), bool)
        spelled = self.spelled[np.repeat(self.begins[flat] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(source))]
        return np.bincount(np.repeat(np.arange(len(length)), length), spelled != source, len(length)) == 0


def lost(texts: DataFrame, tokenizer: str, text: str = "text") -> int:
    """How many texts are not the same after encoding and decoding by the tokenizer (its JSON)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            wrong = sum(len(encoder.texts(share)[1]) for share in pieces.shares(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([wrong], pa.int64())], names=["wrong"])

    return texts.select(text).mapInArrow(run, "wrong long").agg(F.coalesce(F.sum("wrong"), F.lit(0))).first()[0]


def fit_tokenizer(texts: DataFrame, scratch: Scratch, vocab_size: int = 8192, min_frequency: int = 2, text: str = "text") -> dict:
    """A tokenizer of the given texts with its training facts; an empty side and one that doesn't keep its texts are errors."""
    if texts.filter(F.length(text) > 0).isEmpty():
        raise ValueError("nothing to learn from")
    merges = fit(texts, scratch, vocab_size, min_frequency, text)
    made = tokenizer_json(merges)
    wrong = lost(texts, made, text)
    if wrong:
        raise ValueError(f"{wrong} texts are not kept by the tokenizer")
    return {"kind": "byte-bpe", "version": 1, "backend": json.loads(made), "training": {"requested_vocab_size": vocab_size, "min_frequency": min_frequency, "merges": len(merges)}, "sentinels": []}


def with_sentinels(payload: dict, names: list[str]) -> dict:
    """The same tokenizer with names after its vocabulary; no text can be encoded to them."""
    if payload["sentinels"]:
        raise ValueError("there are sentinels already")
    return {**payload, "sentinels": list(names)}


def decode(payload: dict, ids: list[int]) -> str:
    """Text of ids; a sentinel gives its name, and the runs between are decoded on their own."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(json.dumps(payload["backend"]))
    size, out, run = tok.get_vocab_size(), [], []
    for i in [*ids, None]:
        if i is not None and i < size:
            run.append(i)
            continue
        out.append(tok.decode(run, skip_special_tokens=False))
        run = []
        if i is not None:
            out.append(payload["sentinels"][i - size])
    return "".join(out)


def save_tokenizer(spark: SparkSession, path: str, payload: dict) -> None:
    """Puts the tokenizer's JSON in place whole, on any file system that Spark knows."""
    replace_json(spark, path, payload)


def load_tokenizer(spark: SparkSession, path: str) -> dict:
    """A tokenizer saved by save_tokenizer; another kind or version is an error."""
    payload = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))  # one small file
    if not isinstance(payload, dict) or payload.get("kind") != "byte-bpe" or payload.get("version") != 1:
        raise ValueError("not a tokenizer of this kind and version")
    return payload
