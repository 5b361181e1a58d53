"""The training-data operators against brute force, on small fixtures with nulls, empty texts, ties and repeats."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from textloom.llm import decontaminate, eliasfano, html, langid, lm, media, neardup, packing, pii, simhash, suffixes, toxicity
from textloom.llm.components import components

rng = np.random.default_rng(11)
WORDS = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(400)]


def prose(n, seed=None):
    r = np.random.default_rng(seed) if seed is not None else rng
    return " ".join(r.choice(WORDS, n))


def table(spark, texts):
    """Documents with clashing extra columns; two rows of the last text have further ids."""
    rows = [(i, t, "x", 1.0, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score_ string, n double, piece int")


BASE = prose(120, 1)
TEXTS = [None, "", BASE, BASE, BASE.replace(" ", "  ").upper(), BASE[:300] + " zz " + BASE[300:], "a", "\U0001d11e é\n", prose(3000, 2), prose(40, 3), prose(40, 4) + " " + BASE]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, score_ string, n double, piece int")


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    from textloom.llm.tokens import WordTokens

    path = tokenizer()
    tok, own = Tokenizer.from_file(path), WordTokens(path, cache_words=5)
    for t in [*[x or "" for x in TEXTS], "don't I'll 'S it's<|endoftext|> x", "a\xadb", "ÀÉ ß ñ²3½ x'd've", "a\x1cb\x85c", "Σας ΟΔΟΣ", "12 345!!??.."]:
        assert own.encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(spark, docs, empty):
    pieces = packing.token_pieces(docs, tokenizer(), 64)
    want = {(r.doc_id, r.piece): r for r in pieces.collect()}
    got = packing.pack(pieces, spark, 64, group_items=10).collect()
    assert sorted((r.doc_id, r.piece) for r in got) == sorted(want)
    assert want[0, 0].length == want[1, 0].length == 1
    by = {}
    for r in got:
        assert (r.start, r.length, r.ids_crc32) == tuple(want[r.doc_id, r.piece][2:])
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    whole = packing.pack(pieces, spark, 64)
    room = []  # first-fit decreasing, the plain way
    for n in sorted((r.length for r in got), reverse=True):
        at = next((i for i, left in enumerate(room) if left >= n), None)
        room.append(64 - n) if at is None else room.__setitem__(at, room[at] - n)
    assert whole.select("sequence_id").distinct().count() <= len(room)
    assert packing.pack(packing.token_pieces(empty, tokenizer(), 64), spark, 64).count() == 0


@pytest.mark.parametrize("n,letters,length", [(1, 2, 9), (4, 1, 9), (50, 2, 60), (501, 1, 700), (1500, 2, 40)])
def test_suffix_order(n, letters, length):
    t = np.random.default_rng(n).integers(1, letters + 1, n)
    order, raw = suffixes.suffix_order(t, length), bytes(t.astype(np.uint8))
    keys = [raw[i : i + length] for i in order]
    assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)


def test_remove_repeats(spark, empty):
    long = prose(400, 5)
    texts = [None, "", long, long, "q" * 1000, prose(60, 6) + long[200:900] + prose(60, 7), prose(60, 8) + long[350:749] + prose(9, 9), "short", "ü" * 300]
    texts += [prose(30, 100 + i) + long[500:1000] + prose(30, 200 + i) for i in range(6)]
    old, suffixes.GROUP = suffixes.GROUP, 3  # large cores are dealt by window
    try:
        got = {r.doc_id: r for r in suffixes.remove_repeats(table(spark, texts), spark).collect()}
    finally:
        suffixes.GROUP = old
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raws for i in range(len(b) - 399))
    for i, b in enumerate(raws):
        mask = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - 399):
            if seen[b[j : j + 400]] > 1:
                mask[j : j + 400] = True
        spans = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        kept = bytes(x for x, m in zip(b, mask) if not m)
        assert tuple(got[i])[1:] == (len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()), i
    assert suffixes.remove_repeats(empty, spark).count() == 0


BASE_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(BASE_PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark, empty):
    texts = [None, "", "a@b.c_d@e.f x@y a@b.-.c. é\U0001d11e z@q.w", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 " + "1" * 5000, "+1 (988) 555-2485+49 30 1234567 +1 2", "1.2.3.4 " * 300, "x" * 3000 + " a@b.co"]
    texts += ["call me, phone (988) 555-2485 or bob (at) mail (dot) com", "x@a.de +49 30 123456 10.0.0.1"] * 3
    held = pii.candidates(table(spark, texts))
    for r in held.collect():
        assert sorted((s.start, s.rank, s.end) for s in r.spans if s.sure) == base_spans(texts[r.doc_id])
    out = {r.doc_id: r for r in pii.decided(held, pii.fit(held)).collect()}
    for i, r in out.items():
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.found}
    posterior = pii.estimate({(1, 1, 1, 0): 50, (0, 1, 1, 0): 20, (0, -1, 0, -1): 30})
    assert posterior[0, 1, 1, 0] > 0.5 > posterior[0, -1, 0, -1]
    clean = pii.redact(spark, table(spark, ["mail x@a.de!", None, "none"]), "").collect()
    assert [r.text for r in sorted(clean)] == ["mail [EMAIL]!", None, "none"]
    assert pii.redact(spark, empty, "").count() == 0


def test_html(spark):
    nav = "<nav><ul><li><a href=1>one</a></li></ul></nav>"
    page = f"<html><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body>{nav}<div class='cookie-notice'>cookies</div><article><h1>A&amp;B</h1><p><b>first\n  line<br><p>second</p><ul><li>x<li>y</ul><div class=comments><p>me too</p></div></article><aside>side</aside><footer>f</footer>"
    plain = "<body><div id=top>site name</div><div class=body><p>text {}</p></div>"
    rows = [(0, "http://a.b/1", page), (1, None, None), (2, "", ""), (3, "http://c.d/", "just words")] + [(10 + i, "http://e.f/x", plain.format(i)) for i in range(8)] + [(10, "http://e.f/x", plain.format(0))]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, host string")
    got = html.extract(pages.drop("host"), spark).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert by[0] == "A&B\nfirst line\nsecond\nx\ny" and by[1] == by[2] == "" and by[3] == "just words"
    assert by[12] == "text 2"  # the site's name is low in entropy over its pages
    assert html.extract(pages.drop("host").limit(0), spark).count() == 0


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 10), (1000, 1 << 60), (5000, 5100)):
        v = np.unique(r.integers(0, top, n, dtype=np.uint64))
        code = eliasfano.Code(eliasfano.build(v))
        q = np.concatenate([v, r.integers(0, top, n, dtype=np.uint64), [np.uint64(2**63)]])
        at = np.minimum(np.searchsorted(v, q), len(v) - 1)
        assert (code.find(q) == np.where(v[at] == q, at, -1)).all()
        assert (code.get(np.arange(len(v))) == v).all()
    steps = np.repeat(np.arange(50, dtype=np.uint64), 3)
    assert (eliasfano.Code(eliasfano.build(steps)).get(np.arange(150)) == steps).all()


def lm_words(t):
    return [w.lower() if w.isascii() else w for w in re.findall(r"[^\x20\x09-\x0d]+", t or "")] + ["\0"]


def lm_model(texts, order):
    """Interpolated absolute discounting the plain way: log10 p of the last word of a context and word."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        w = ["\0", *lm_words(t)]
        counts[1].update(w[1:])
        for k in range(2, order + 1):
            counts[k].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    total, size = sum(counts[1].values()), len(counts[1])

    def p(words):
        if len(words) == 1:
            return (counts[1][words[0]] + 1) / (total + size + 1)
        after = [(g, n) for g, n in counts[len(words)].items() if g[:-1] == words[:-1]]
        lower = p(words[1:])
        if not after:
            return lower
        n = sum(c for _, c in after)
        return max(0, counts[len(words)][words] - lm.DISCOUNT) / n + lm.DISCOUNT * len(after) / n * lower

    return counts, total, size, p


@pytest.mark.parametrize("order,part", [(2, 10**6), (3, 10**6), (2, 12), (3, 25)])
def test_lm(spark, docs, order, part, monkeypatch):
    """Every score equals the back-off model's within the quantiser's step, also with contexts cut over shards."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", part)
    all_texts, d = TEXTS, docs
    if part < 100:  # few words, one of them in most pairs
        all_texts = [" ".join(x for w in prose(9, 800 + i).split()[: i % 10] for x in (w, "the")) for i in range(12)] + [None, "The the THE"]
        d = table(spark, all_texts)
    texts = [t for i, t in enumerate(all_texts) if i % 4 != 1]
    folder = lm.train(d.filter("doc_id % 4 <> 1"), spark, order)
    got = {r.doc_id: r for r in lm.score(d, folder, order).collect()}
    counts, total, size, p = lm_model(texts, order)
    for i, t in enumerate(all_texts):
        w = lm_words(t)
        base = sum(math.log10((counts[1][x] + 1) / (total + size + 1)) for x in w)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(counts[1][x] > 0 for x in w), total)
        assert got[i].base_score == pytest.approx(base)
        if len(w) < 400:
            full = ["\0", *w]
            want = sum(math.log10(p(tuple(full[max(0, j - order + 1) : j + 1]))) for j in range(1, len(full)))
            assert abs(got[i].score - want) <= len(w) * (order - 1) * lm.STEP / 2 + 1e-6
    if part > 100:
        assert got[3].score > got[3].base_score


def test_lm_of_nothing(spark, empty):
    assert lm.score(empty, lm.train(empty, spark)).count() == 0
    got = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), lm.train(empty, spark)).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.score) == (3, 0, 0, 0.0)


def test_decontamination(spark, empty):
    item = prose(40, 21)
    w = item.split()
    near = " ".join("changed" if i in (7, 16, 25) else x for i, x in enumerate(w))
    texts = [None, "", prose(50, 22) + " " + item.upper() + ", " + prose(50, 23), prose(30, 24) + " " + near, prose(200, 25), " ".join(w[:6]) + " " + prose(60, 26), "tiny exact one", item + " " + item, item]
    bench = spark.createDataFrame([(5, item, 0), (3, item, 0), (6, None, 0), (7, "", 0), (8, "tiny exact one", 0)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontaminate.overlaps(table(spark, texts), bench, spark, batch_bytes=500).collect()}
    assert got == {(2, 3): 40, (3, 3): 37, (6, 8): 3, (7, 3): 40, (8, 3): 40}
    members = {(r.item_id, r.reported_id) for r in decontaminate.membership(bench, spark).collect()}
    assert members == {(5, 3), (3, 3), (8, 8)}
    assert decontaminate.overlaps(empty, bench, spark).count() == 0 and decontaminate.overlaps(table(spark, texts), bench.limit(0), spark).count() == 0


def test_decontamination_misses_nothing(spark):
    """Items of 6 to 20 words with substitutions, and their pieces, against a scan of every diagonal."""
    r = np.random.default_rng(71)
    items = {n: [f"i{n}w{i}" for i in range(n)] for n in range(6, 21)}
    items[50] = [f"i50w{i}" for i in range(50)]
    texts, want = [], set()
    for n, item in items.items():
        for k in range(60):
            drop = set(r.choice(n, r.integers(0, n // 4 + 1), replace=False).tolist()) if k % 3 else set()
            a, b = (0, n) if k % 2 else sorted(r.choice(n + 1, 2, replace=False).tolist())
            doc = [f"x{k}"] * int(r.integers(0, 3)) + [f"new{i}" if i in drop else item[i] for i in range(a, b)] + [f"y{k}"] * int(r.integers(0, 3))
            h, w = (decontaminate.word_hashes(" ".join(x).encode())[0] for x in (doc, item))
            for g in range(1 - n, len(doc)):
                lo, hi = max(g, 0), min(g + n, len(doc))
                start, end, matched = decontaminate.best_overlap(h[lo:hi] == w[lo - g : hi - g])
                if decontaminate.contaminated(matched, end - start, n):
                    want.add((len(texts), n))
            texts.append(" ".join(doc))
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.overlaps(table(spark, texts), bench, spark).collect()}
    assert got == want and len(want) > 300


def test_media_round_trip(spark, docs):
    payloads = [media.padded(t)[0] for t in [*TEXTS, "é\0z" * 70_000, "\x7f" * 576]]
    blobs = media.encode_many(payloads)
    for p, blob in zip(payloads, blobs):
        frames, at = [], 0
        while at < len(blob):
            f, at = media.parse(blob, at)
            frames.append(f)
        assert b"".join(i.tobytes() for i in media.decode_many(frames)) == p
        assert all((f.width, f.height % 192) == (192, 0) for f in frames) or len(frames) > 1
    got = {r.doc_id: r for r in media.media_columns(docs).collect()}
    for i, t in enumerate(TEXTS):
        p, n = media.padded(t)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert tuple(got[2])[1:] == tuple(got[3])[1:]
    with pytest.raises(ValueError):
        media.parse(b"not a file")


def test_language_id(spark):
    alphabet = {"aa": "abcde ", "bb": "vwxyz ", "cc": "mnopq "}
    rows = [(i, "".join(rng.choice(list(alphabet[k]), 300)), k, "s") for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    odd = [(500, None, "aa", "s"), (501, "", "bb", "s"), (502, "12 !", None, "s"), (503, "abcd" * 3000, None, "s")]
    d = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in langid.predict(d, langid.train(d, per_language=30), spark).collect()}
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows]) > 0.98
    assert [got[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "und", "aa"]
    assert langid.predict(d, langid.train(d.limit(0)), spark).filter("lang_pred <> 'und'").count() == 0


def test_golay_keys_meet_within_two_bits():
    w = np.random.default_rng(3).integers(0, 1 << 23, 2000).astype(np.uint32)
    keys = simhash.golay_indices(w)
    for flips in (1, 2):
        e = np.array([sum(1 << int(b) for b in rng.choice(23, flips, replace=False)) for _ in w], np.uint32)
        assert (keys[:, :, None] == simhash.golay_indices(w ^ e)[:, None, :]).any((1, 2)).all()


def test_simhash_components(spark, docs, empty):
    prints = [int(x) for x in np.random.default_rng(4).integers(0, 1 << 62, 40)]
    prints += [p ^ (1 << int(b)) ^ (1 << int(c)) for p in prints[:20] for b, c in [rng.choice(64, 2, replace=False)]] + [p ^ 7 for p in prints[:5]]
    signed = [int(np.uint64(p & (2**64 - 1)).view(np.int64)) for p in dict.fromkeys(prints)]
    links = {frozenset(r) for r in simhash.fuzzy_links(spark.createDataFrame(list(enumerate(signed)), "node long, fp long")).collect()}
    parent = list(range(len(signed)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(i, j) for i in range(len(signed)) for j in range(i) if ((signed[i] ^ signed[j]) & (2**64 - 1)).bit_count() <= 2]
    assert all(((signed[a] ^ signed[b]) & (2**64 - 1)).bit_count() <= 2 for a, b in map(tuple, links))
    for i, j in pairs:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    want = [find(i) for i in range(len(signed))]
    parent = list(range(len(signed)))
    for a, b in map(tuple, links):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(signed))] == want
    got = {r.doc_id: r for r in simhash.simhash_components(docs, spark).collect()}
    assert got[0].fingerprint == got[1].fingerprint == "0" * 16 and got[1].component_id == 0
    assert got[2].component_id == got[3].component_id == got[4].component_id == 2
    assert simhash.simhash_components(empty, spark).count() == 0


def test_components_of_a_long_chain(spark):
    got = components(spark, spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_near_duplicates(spark, empty):
    base = [prose(150, 40 + i).split() for i in range(4)]
    texts = [None, ""] + [" ".join(b) for b in base]
    for k, b in enumerate(base):
        for at in ((20,), (50, 100), (30, 75)):
            texts.append(" ".join("new" if i in at else w for i, w in enumerate(b)))
    texts += [" ".join(base[0]).upper(), " ".join(base[0][:70] + base[1][:70])]
    sets = [set(neardup.shingle_set(t, 5).tolist()) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if same and want[i] != want[j]:
                lo, hi = sorted((want[i], want[j]))
                want = [lo if x == hi else x for x in want]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(table(spark, texts), spark).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = neardup.keep_one(spark, table(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == table(spark, texts).columns
    assert neardup.keep_one(spark, empty, "").count() == 0


def test_near_duplicates_across_parts(spark, monkeypatch):
    """Edited copies are near their base alone, and the base hasn't the least id of its class."""
    base = prose(200, 60).split()
    spots = np.random.default_rng(61)
    texts = []
    for k in range(24):
        at = 5 + np.arange(4) * 48 + spots.integers(0, 40, 4)
        texts.append(" ".join(f"new{k}" if i in at else w for i, w in enumerate(base)))
    texts.append(" ".join(base))
    sets = [set(neardup.shingle_set(t, 5).tolist()) for t in texts]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert all(near(s, sets[-1]) for s in sets) and not near(sets[0], sets[1])
    monkeypatch.setattr(neardup, "PART", 3)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(table(spark, texts), spark).collect()}
    assert set(got.values()) == {0} and len(got) == len(texts)
    monkeypatch.setattr(neardup, "PART", 10_000)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(table(spark, texts), spark).collect()} == got


def test_near_duplicates_under_repeated_ids(spark):
    """What stays does not hang on the order of rows that share an id."""
    a, b = prose(60, 501), prose(60, 502)
    rows = [(1, a), (1, b), (2, b + " more"), (3, a), (3, a), (None, b), (None, None)]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        kept = neardup.keep_one(spark, spark.createDataFrame(order, "doc_id long, text string").coalesce(1), "")
        assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([(1, a), (1, b), (None, b), (None, None)], "doc_id long, text string").collect()))


def test_near_duplicates_of_short_texts(spark):
    """Every pair of a text of 8, 12 or 40 words and the same text with a word more is found."""
    texts = []
    for k in range(240):
        t = prose((8, 12, 40)[k % 3], 7000 + k)
        texts += [t, t + f" more{k}"]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(table(spark, texts), spark).collect()}
    assert all(got[i] == i - i % 2 for i in range(len(texts)))


def test_near_duplicates_move_sketches_not_texts(spark, monkeypatch):
    """Up to the candidates no table is made by shuffling texts."""
    plans, keep = {}, neardup.Scratch.keep

    def kept(self, df, name):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString())
        return keep(self, df, name)

    monkeypatch.setattr(neardup.Scratch, "keep", kept)
    texts = [prose(n, 8100 + n) for n in (3, 40, 90, 150)]
    texts += [t + " more" for t in texts]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(table(spark, texts), spark).collect()}
    assert [got[i] for i in range(8)] == [0, 1, 2, 3, 4, 1, 2, 3]
    assert all("Join" not in plans[name] and "text#" not in plans[name] for name in ("nodes", "keyed", "short"))
    assert plans["sets"].count("passing(") and "Join" in plans["sets"]  # texts of no candidate are left out before they move


def test_sketch_keys():
    """The keys of many prints at once are each print's own, without repeats."""
    prints = np.random.default_rng(8200).integers(0, 1 << 63, (50, neardup.TABLES), np.uint64)
    prints[0] = 0
    keys, row = neardup.sketch_keys(prints)
    for i, p in enumerate(prints):
        index = simhash.golay_indices((p >> np.uint64(23)) & np.uint64(0x7FFFFF)).astype(np.uint64)
        want = (np.arange(neardup.TABLES, dtype=np.uint64)[:, None] << np.uint64(40)) | ((p & np.uint64(0x7FFFFF))[:, None] << np.uint64(12)) | index
        assert np.array_equal(np.sort(keys[row == i]), np.unique(want))


def test_toxicity(spark, empty):
    bad = ["idiot", "moron", "scum"]
    texts = [prose(30, 300 + i) + (" " + bad[i % 3] + " you " + bad[(i + 1) % 3] if i % 4 == 0 else "") for i in range(240)] + [None, ""]
    d = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None) for i in range(240)] + [(0, None, None)], "doc_id long, toxic int, text string")
    model = toxicity.train(d, labels.drop("text"))
    got = {r.doc_id: r for r in toxicity.score(d, model, spark).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.95
    assert got[240].score == got[241].score < 0.5
    assert toxicity.train(d, labels.drop("text").limit(0)).score("x") == 0.5
    assert toxicity.score(empty, model, spark).count() == 0


def test_pipeline_stages_keep_columns(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, seen = docs.count(), docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, seen, sf).write.parquet(out)
        after = spark.read.parquet(out)
        if k < 4:
            assert after.columns == docs.columns
            assert 0.5 * before < after.count() <= before
        seen = after
    assert os.path.exists(tmp_path / "4")
    assert corpus_pipeline.run(spark, sf).count() == seen.count()


def test_repeats_are_not_decided_by_a_polynomial_hash(spark):
    """Two texts whose difference is a multiple of x^k - 1 for many k: polynomial hashes modulo 2^64 agree on them."""
    d = np.ones(1, np.int64)
    for k in (1, 2, 4, 8, 16, 32, 64, 128, 1, 2, 4, 8, 16):
        factor = np.zeros(k + 1, np.int64)
        factor[0], factor[k] = -1, 1
        d = np.convolve(d, factor)
    a = np.full(400, 79)
    b = a.copy()
    b[: len(d)] += d
    texts = [bytes(a.astype(np.uint8)).decode(), bytes(b.astype(np.uint8)).decode()]
    assert len(d) <= 400 and texts[0] != texts[1] and min(b) >= 32
    assert [r.n_removed for r in suffixes.remove_repeats(table(spark, texts), spark).collect()] == [0, 0]


def test_repeats_with_null_and_repeated_ids(spark):
    long = prose(120, 900)
    rows = spark.createDataFrame([(None, long), (1, prose(150, 901)), (1, long), (None, None)], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(rows, spark).collect())
    n = len(long.encode())
    assert got == sorted([(n, n, 1), (len(prose(150, 901).encode()), 0, 0), (n, n, 1), (0, 0, 0)])


def test_repeats_leave_texts_and_spans(spark, tmp_path):
    """A passage of over 50 words in two documents is gone from both, one under 400 bytes stays, a text without repeats stays as it is."""
    long, short, clean, wide = prose(90, 910), prose(52, 911), prose(200, 912), "ü" * 250 + "é" * 20
    texts = [prose(40, 913) + long + prose(40, 914), long + prose(30, 915), clean, short + prose(40, 916), prose(40, 917) + short, None, wide + "ö" * 30, "a" + wide + "õ" * 30]
    assert len(long.encode()) >= 400 > len(short.encode())
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raws for i in range(len(b) - 399))
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffixes.op2_suffix_array_dedup(spark, str(tmp_path)).collect()}
    kept = {r.doc_id: r for r in suffixes.without_repeats(table(spark, texts), spark).collect()}
    for i, b in enumerate(raws):
        gone = {k for j in range(len(b) - 399) if seen[b[j : j + 400]] > 1 for k in range(j, j + 400)}
        left = bytes(x for k, x in enumerate(b) if k not in gone)
        starts, stops = sorted(k for k in gone if k - 1 not in gone), sorted(k + 1 for k in gone if k + 1 not in gone)
        assert bytes(kept[i].kept) == left and [tuple(x) for x in kept[i].spans] == list(zip(starts, stops)), i
        assert got[i].spans == ",".join(f"{a}:{z}" for a, z in zip(starts, stops)), i
        assert got[i].kept_text == left.decode("utf-8", "replace"), i
        assert tuple(got[i])[1:5] == (len(b), len(gone), len(starts), hashlib.sha256(left).hexdigest()), i
    assert all(long not in got[i].kept_text and got[i].n_removed >= len(long.encode()) for i in (0, 1))
    assert got[2].kept_text == clean and all(short in got[i].kept_text for i in (3, 4)) and got[5].kept_text == ""
    assert "�" in got[6].kept_text + got[7].kept_text  # the common run ends inside a character: ö and õ share a first byte
