"""Merkle manifest, quality rules and prefix trie against brute force, on small fixtures with nulls, ties and repeats."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from textloom.llm import common, merkle, outliers, trie

rng = np.random.default_rng(5)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grown(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def beside(levels, p):
    out = []
    for level in levels[:-1]:
        run = p - p % 8
        out.append((level[run:p], level[p + 1 : run + 8]))
        p //= 8
    return out


def brute_manifest(rows):
    low = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, t: sha(*map(field, (r[0], r[1], r[2], r[3], t)))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: grown([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in order}
    top = grown([trees[k][-1][0] for k in order])
    out = []
    for q, k in enumerate(order):
        for p, (_, _, own, r) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            path = beside(trees[k], p) + beside(top, q)
            node = leaf(r, low(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else own
            for left, right in path:
                node = sha(*left, node, *right)
            out.append((r[0], own, trees[k][-1][0], top[-1][0], sha(*[x for left, right in path for x in left + right]), node, node == top[-1][0]))
    return sorted(map(str, out))


MERKLE = "doc_id long, source string, lang string, n_chars long, text string, node string, place int, key long"


@pytest.mark.parametrize("span", [8, 512])
def test_manifest(spark, span, monkeypatch):
    """Groups of 1, 8, 9, 64, 65 and 700 leaves, nulls everywhere, equal ids, repeated rows; blocks of one and three levels."""
    monkeypatch.setattr(merkle, "SPAN", span)
    monkeypatch.setattr(merkle, "LEVELS", 1 if span == 8 else 3)
    rows = []
    for lang, n in ((None, 9), ("", 1), ("=", 8), ("é", 64), ("zz", 65), ("en", 700), ("e", 2)):
        rows += [(int(i), f"s{i % 3}" if i % 5 else None, lang, None if i % 7 == 0 else int(i), [None, "", "ABC Éa", "x" * 50_000, f"T{i}"][i % 5]) for i in rng.integers(-50, 10**6, n)]
    rows += [(None, None, "en", None, None), (None, "a", "en", 1, "A"), rows[-1], rows[-1], (rows[-1][0], "other", "en", 3, "B")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], MERKLE)
    got = merkle.manifest(df.repartition(7), spark)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_manifest(rows)
    one = rows[:1]
    assert [str(tuple(r)) for r in merkle.manifest(spark.createDataFrame([(*one[0], "x", 1, 2)], MERKLE), spark).collect()] == brute_manifest(one)
    assert merkle.manifest(df.limit(0), spark).count() == 0


def test_places_of_a_hot_group(spark):
    """A group over all partitions, beside small ones, with ties."""
    rows = [("hot", int(x)) for x in rng.integers(0, 300, 3000)] + [(f"g{i % 40}", i) for i in range(200)]
    got = common.placed(spark.createDataFrame(rows, "k string, v long"), common.Scratch(spark, "t"), "k", ["v"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.k].append((r.place, r.v))
    assert len(got) == len(rows)
    for found in by.values():
        found.sort()
        assert [p for p, _ in found] == list(range(len(found))) and [v for _, v in found] == sorted(v for _, v in found)


def brute_counts(t):
    t = t or ""
    space = " \t\n\x0b\x0c\r"
    words, now = [], ""
    for c in t + " ":
        if c in space:
            words += [now] if now else []
            now = ""
        else:
            now += c
    seen, dup = set(), 0
    for line in t.split("\n"):
        if any(c not in space for c in line):
            dup += line in seen
            seen.add(line)
    grams = defaultdict(list)
    for i in range(len(words) - 4):
        grams[tuple(words[i : i + 5])].append(i)
    covered = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


VOCABULARY = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(300)]


def prose(n, r=rng):
    return " ".join(r.choice(VOCABULARY, n))


def test_counts_of_texts():
    texts = [None, "", " \t", "a", "é\U0001d11e b\x1cc\x85d\xa0e", "#*$%&|<> x\n#", "l\nl\n \n\nl \nl", " ".join("abcde" * 3), "w " * 5000, prose(300), " ".join(["q"] * 6), "a b c d e x a b c d e a b c d e"]
    texts += [" ".join(rng.choice(list("ab"), 60)) for _ in range(30)] + [" ".join(f"w{i % 9000}" for i in range(20_000))]
    for t in texts:
        assert outliers.counts_of(t)[:5] == brute_counts(t)


def test_chi_square():
    assert outliers.chi2_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-3)
    assert outliers.chi2_quantile(0.95, 7) == pytest.approx(14.0671, abs=1e-3)
    x = np.sort((np.random.default_rng(1).standard_normal((200_000, 5)) ** 2).sum(1))[:150_000]
    z = np.random.default_rng(1).standard_normal((200_000, 5))
    near = z[(z**2).sum(1) <= x[-1]]
    assert outliers.consistency(0.75) * near.var(0).mean() == pytest.approx(1, abs=0.02)


def brute_mcd(x):
    """The same search with all distances at hand, for one group."""
    p, floor = outliers.P, np.array(outliers.FLOOR)
    low_median = lambda v: np.sort(v, 0)[math.ceil(0.5 * len(v)) - 1]
    whole = lambda c: c + np.diag(floor**2)
    far = lambda m, c: np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(whole(c)), x - m)
    mid = low_median(x)
    mad = low_median(np.abs(x - mid))
    scale = 1.4826 * mad + floor / 2
    z = (x - mid) / scale
    unit = z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]
    starts = [np.diag((1.4826 * mad) ** 2), np.tanh(z).T @ np.tanh(z) / len(x) * np.outer(scale, scale), unit.T @ unit / len(x) * p * np.outer(scale, scale)]

    def take(keep, factor):
        return x[keep].mean(0), factor * np.cov(x[keep].T, bias=True)

    def step(m, c):
        d = far(m, c)
        return take(d <= np.sort(d)[math.ceil(outliers.H * len(x)) - 1], outliers.consistency(outliers.H))

    best = min((step(*step(mid, c)) for c in starts), key=lambda mc: np.linalg.slogdet(whole(mc[1]))[1])
    for _ in range(10):
        after = step(*best)
        done = abs(np.linalg.slogdet(whole(after[1]))[1] - np.linalg.slogdet(whole(best[1]))[1]) < 1e-3
        best = after
        if done:
            break
    final = take(far(*best) <= outliers.chi2_quantile(outliers.REWEIGHT, p), outliers.consistency(outliers.REWEIGHT))
    return final[0], whole(final[1])


def junk(n):
    return " ".join(w + "$$$" for w in rng.choice(VOCABULARY, n))


def test_quality(spark):
    texts = [(prose(int(np.exp(rng.normal(5, 0.7)))), "en", "a") for _ in range(260)] + [(prose(int(np.exp(rng.normal(4, 0.5)))), None, None) for _ in range(70)]
    texts += [(prose(80), "de", f"s{i % 9}") for i in range(63)] + [(prose(80), "fr", "x")] * 3 + [(prose(60), "it", "y")]
    texts += [(junk(100), "en", "a")] * 2 + [(junk(150), "en", "a"), (junk(90), None, None), (junk(90), "de", "s1"), (prose(4000), "en", "a")]
    texts += [(None, "en", "a"), ("", None, "a"), ("few words here", "en", "a"), (" ".join([prose(6)] * 20), "en", "a")]
    copy = prose(200)
    texts += [(copy, "en", "a")] * 900  # copies must not become the norm
    rows = [(None if i % 97 == 0 else i, t, lang, source, -1, True) for i, (t, lang, source) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept boolean")
    out = outliers.quality(df, spark)
    got = sorted(map(str, map(tuple, out.collect())))
    group = lambda t: (t[1], t[2]) if t[1:] in {("en", "a"), (None, None)} else "de" if t[1] == "de" else None
    vectors, models = defaultdict(dict), {}
    for t in texts:
        c = outliers.counts_of(t[0])
        if c[0] >= 10 and 100 * c[4] <= 20 * c[0] and group(t):
            vectors[group(t)][t[0]] = outliers.vector_of(*c)
    for g, of in vectors.items():
        models[g] = brute_mcd(np.array(list(of.values())))
    want, rejected = [], []
    for (i, *_), t in zip(rows, texts):
        c = brute_counts(t[0])
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        kept = not failed
        if kept and group(t):
            m, cov = models[group(t)]
            z = np.array(vectors[group(t)][t[0]]) - m
            kept = bool(z @ np.linalg.inv(cov) @ z <= outliers.chi2_quantile(outliers.CUT, outliers.P))
            rejected += [] if kept else [t[0]]
        want.append(str((i, *c, failed, kept)))
    assert got == sorted(want)
    assert len(rejected) == 5 and all("$$$" in t for t in rejected)
    assert outliers.quality(df.limit(0), spark).count() == 0
    assert outliers.quality(df.filter("lang = 'it'"), spark).filter("kept").count() == 1


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, sha(str(len(role.encode())), ":", role, text), (role, text)))
    convs = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, b in built.items():
        for d in range(len(b) + 1):
            members[b[:d]].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].split()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), sum(not kids[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("segment", [2, 1024])
def test_trie(spark, segment, monkeypatch):
    """Shared leads, copies, absent bases, nested shares, a long conversation over many segments, nulls and ties."""
    monkeypatch.setattr(trie, "SEGMENT", segment)
    rows = []
    for c in [*range(0, 45), *range(61, 70), 103, 120, 121, 122, 123]:
        n = int(rng.integers(1, 7))
        rows += [(c, t, ["user", None, ""][t % 3], f"w{rng.integers(0, 3)} a  b") for t in range(n)]
    rows += [(c, t, "user", "same thing") for c in range(200, 220) for t in range(4)]
    rows += [(300, t, "u", f"t{t % 2} x") for t in range(60)] + [(c, t, "u", f"t{t % 2} x" if t < c - 290 else "other") for c in range(301, 312) for t in range(c - 288)]
    rows += [(None, 0, "user", "no conversation"), (7, None, "user", "first"), (7, 1, "x", None), (7, 1, "x", None), (7, 1, "a", "tie"), (-7, 0, "u", "neg"), (-40, 0, "u", "neg")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string")
    got = trie.prefix_trie(df.repartition(5), spark)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_trie(rows)
    assert trie.prefix_trie(df.limit(0), spark).count() == 0


def test_chains_above_a_comb(spark):
    """A chain of chains is resolved in doubling steps."""
    got = trie._above(spark.createDataFrame([(i + 1, i, i * 10) for i in range(20)], "conv long, up long, at long"), common.Scratch(spark, "t")).collect()
    assert sorted(map(tuple, got)) == sorted((i, j, j * 10) for i in range(21) for j in range(i))
