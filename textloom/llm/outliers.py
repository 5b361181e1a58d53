"""Quality rules: counts of each text, and robust multivariate outliers of its language and source.

The counts become a vector of transformed statistics.  For each (lang, source) the minimum covariance
determinant is searched: from three deterministic starts (Hubert, Rousseeuw, Verdonck 2012), concentration steps
keep the H share of texts nearest to the centre and take their mean and covariance again; the start of the least
determinant goes on until it settles, and one reweighting follows.  A text beyond the CUT quantile of the
chi-square distribution by its squared Mahalanobis distance is rejected.

A step is two aggregates by group (a quantile sketch, then sums and products), both combined before the
shuffle, so that a group of any size costs no task more than another.  Covariances are regularised by FLOOR, the
spread per statistic that is never held against a text: many statistics are zero in nearly all texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, table

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Share of a group that a concentration step keeps.
H = 0.75
#: Distinct texts that a group needs for an estimate of its own.
LEAST = 50
#: Texts shorter than this many words are drawn towards the usual rate by as many words.
PRIOR_WORDS = 20
#: Standard deviations added to the statistics': log words, log word length, roots of the rates of symbols, repeated lines, repeated words.
FLOOR = (0.7, 0.1, 0.08, 0.2, 0.2)
P = len(FLOOR)
CUT = 1 - 1e-6
REWEIGHT = 0.975
#: Relative error of the quantile sketch is 1 / ACCURACY.
ACCURACY = 10_000
#: Models are broadcast up to this many groups (240 bytes each).
BROADCAST_GROUPS = 20_000
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words in windows that occur twice or more; windows are compared whole, by their words' numbers."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    size = int(ids.max()) + 1
    key, room = ids[:n].copy(), size
    for k in range(1, width):
        if room * size >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            room = int(key.max()) + 1
        key, room = key * size + ids[k : n + k], room * size
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[which] > 1)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def counts_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The five counts of a text, and its lines that have a word."""
    raw = (text or "").encode()
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    characters = sum(map(len, words)) - int((np.frombuffer(raw, np.uint8) & 0xC0 == 0x80).sum())
    return len(words), characters, sum(raw.count(s) for s in SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids), len(lines)


def vector_of(n: int, characters: int, symbols: int, dup: int, repeated: int, lines: int) -> list[float]:
    """Transformed statistics of a text with words."""
    few = n + PRIOR_WORDS
    return [math.log(n), math.log((characters + 5 * PRIOR_WORDS) / few), math.sqrt(symbols / few), math.sqrt(dup / (lines + 2)), math.sqrt(repeated / n)]


def measured(docs: DataFrame) -> DataFrame:
    """docs' doc_id, lang and source (`=` and the value, empty for null) with the counts, base_failed, and of those that pass a digest and the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(3):
                t = text.as_py()
                c = counts_of(t)
                failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
                rows.append((*c[:5], failed, None if failed else xxhash.xxh3_128_hexdigest(t.encode()), None if failed else vector_of(*c)))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.list_(pa.float64())]
            columns = [pa.array(v, k) for v, k in zip(zip(*rows) if rows else [()] * 8, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=[x.split()[0] for x in schema.split(", ")])

    schema = f"doc_id long, lang string, source string, {COUNTS}, base_failed boolean, tag string, x array<double>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = k / 2, x / 2
    term = math.exp(a * math.log(half) - half - math.lgamma(a + 1))
    total, n = 0.0, 0
    while term > 1e-18 * max(total, 1e-300) or n < half:
        total += term
        n += 1
        term *= half / (a + n)
    return min(1.0, total)


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


def consistency(share: float) -> float:
    """What the covariance of a normal distribution's ``share`` nearest the centre is to be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def _groups(seen: DataFrame) -> DataFrame:
    """(lang, source, group): a pair of LEAST distinct texts or more is a group; smaller ones of a language are pooled,
    then those of all languages; what is left without LEAST has a null group."""
    sizes = seen.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = sizes.filter(F.col("n") < LEAST)
    pools = small.groupBy("lang").agg(F.sum("n").alias("pool"))
    rest = pools.filter(F.col("pool") < LEAST).agg(F.sum("pool").alias("rest"))
    pooled = small.select("lang", "source").join(pools, "lang").crossJoin(F.broadcast(rest))  # one row
    group = F.when(F.col("pool") >= LEAST, F.to_json(F.struct("lang"))).when(F.col("rest") >= LEAST, "all")
    return sizes.filter(F.col("n") >= LEAST).select("lang", "source", F.to_json(F.struct("lang", "source")).alias("group")).unionByName(pooled.select("lang", "source", group.alias("group")))


def _met(rows: DataFrame, small: DataFrame, on: list[str], n: int, how: str = "inner") -> DataFrame:
    """rows with what ``small`` has for their key: n rows, broadcast if they are few; else the join is shuffled and splits hot keys."""
    return rows.join(F.broadcast(small) if n <= BROADCAST_GROUPS else small, on, how)


def _distance(x: Column, mean: Column, precision: Column) -> Column:
    """Squared Mahalanobis distance; the precision matrix is flat, row by row."""
    z = [F.get(x, F.lit(i)) - F.get(mean, F.lit(i)) for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + z[i] * z[j] * F.get(precision, F.lit(i * P + j)) * (1.0 if i == j else 2.0)
    return total


def _moments(z: list[Column], prefix: str = "") -> list[Column]:
    """Sums and products of a vector as one array aggregate each."""
    return [F.array(*[F.sum(a) for a in z]).alias(f"{prefix}s1"), F.array(*[F.sum(z[i] * z[j]) for i in range(P) for j in range(i, P)]).alias(f"{prefix}s2")]


def _square(flat: np.ndarray) -> np.ndarray:
    """(n, P, P) symmetric matrices from their upper triangles."""
    out = np.zeros((len(flat), P, P))
    i, j = np.triu_indices(P)
    out[:, i, j] = out[:, j, i] = flat
    return out


MODEL = "group string, start int, mean array<double>, precision array<double>, logdet double"


def _model_rows(group, start, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    whole = cov + np.diag(np.square(FLOOR))
    return pd.DataFrame({"group": group, "start": start, "mean": list(mean), "precision": list(np.linalg.inv(whole).reshape(len(whole), -1)), "logdet": np.linalg.slogdet(whole)[1]})


def _estimates(factor: float):
    """Models from a step's sums over the rows kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            n = f["n"].to_numpy(float)[:, None]
            mean = np.stack(f["s1"]) / n
            cov = _square(np.stack(f["s2"]) / n) - mean[:, :, None] * mean[:, None, :]
            yield _model_rows(f["group"], f["start"], mean, factor * cov)

    return run


def _starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Three models a group: spread of each statistic alone, covariance of the hyperbolic tangents, and of the directions."""
    for f in frames:
        if not len(f):
            continue
        n, mid, mad = f["n"].to_numpy(float)[:, None, None], np.stack(f["mid"]), np.stack(f["mad"])
        scale = 1.4826 * mad + np.array(FLOOR) / 2
        wide = scale[:, :, None] * scale[:, None, :]
        alone = np.einsum("gi,ij->gij", (1.4826 * mad) ** 2, np.eye(P))
        for start, cov in enumerate((alone, _square(np.stack(f["ts2"])) / n * wide, _square(np.stack(f["us2"])) / n * P * wide)):
            yield _model_rows(f["group"], start, mid, cov)


def fit(seen: DataFrame, scratch: Scratch, groups: int, steps: int = 12) -> DataFrame:
    """(group, mean, precision, ..): the reweighted estimate of each group of distinct vectors (group, x)."""
    xs = [F.get("x", F.lit(i)) for i in range(P)]
    quantile = lambda c, q: F.percentile_approx(c, q, ACCURACY)
    mids = scratch.keep(seen.groupBy("group").agg(F.count("*").alias("n"), F.array(*[quantile(x, 0.5) for x in xs]).alias("mid")), "mid")
    mads = scratch.keep(_met(seen, mids, ["group"], groups).groupBy("group", "n", "mid").agg(F.array(*[quantile(F.abs(x - F.get("mid", F.lit(i))), 0.5) for i, x in enumerate(xs)]).alias("mad")), "mad")
    near = _met(seen, mads, ["group"], groups)
    z = [(x - F.get("mid", F.lit(i))) / (1.4826 * F.get("mad", F.lit(i)) + FLOOR[i] / 2) for i, x in enumerate(xs)]
    near = near.select("group", "n", "mid", "mad", F.array(*z).alias("z"))
    z = [F.get("z", F.lit(i)) for i in range(P)]
    size = F.greatest(F.sqrt(sum((a * a for a in z), F.lit(0.0))), F.lit(1e-9))
    begun = near.groupBy("group", "n", "mid", "mad").agg(*_moments([F.tanh(a) for a in z], "t"), *_moments([a / size for a in z], "u"))
    now = scratch.keep(begun.mapInPandas(_starts, MODEL), "start")

    def step(models: DataFrame, name: str, limit: float | None, factor: float) -> DataFrame:
        """Mean and covariance of the rows within the limit, or of each group's H nearest."""
        far = _met(seen, models.select("group", "start", "mean", "precision"), ["group"], 3 * groups).select("group", "start", "x", _distance(F.col("x"), F.col("mean"), F.col("precision")).alias("d2"))
        if limit is None:
            bars = scratch.keep(far.groupBy("group", "start").agg(quantile(F.col("d2"), H).alias("bar")), f"bar-{name}")
            far = _met(far, bars, ["group", "start"], 3 * groups)
        near = far.filter(F.col("d2") <= (F.col("bar") if limit is None else F.lit(limit)))
        return scratch.keep(near.groupBy("group", "start").agg(F.count("*").alias("n"), *_moments(xs)).mapInPandas(_estimates(factor), MODEL), name)

    raw = consistency(H)
    for k in range(steps):
        after = step(now, f"step{k}", None, raw)
        if k == 1:
            best = F.min_by(F.struct("start", "mean", "precision", "logdet"), F.struct("logdet", "start"))
            after = scratch.keep(after.groupBy("group").agg(best.alias("b")).select("group", "b.*"), "best")
        elif k > 1:
            old = now.select("group", F.col("logdet").alias("before"))
            moved = after.join(old, "group").agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
            if moved is None or moved < 1e-3:
                now = after
                break
        now = after
    return step(now, "final", chi2_quantile(REWEIGHT, P), consistency(REWEIGHT))


def quality(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """Columns of the docs' counts with base_failed and kept; one row for each row, repeated rows and null ids too.

    A null or empty text has no words and fails.  A null language or source is a value of its own.  Equal texts of a
    group count once in its estimate, so copies can't become the norm, and get equal verdicts.  Groups of fewer than
    LEAST distinct passing texts are pooled, by language and then over all; a pool under LEAST rejects nothing.
    Texts of any length are read whole; further columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(spark, "outliers")
    rows = scratch.keep(measured(docs), "measured")
    distinct = scratch.keep(rows.filter(~F.col("base_failed")).groupBy("lang", "source", "tag").agg(F.any_value("x").alias("x")), "distinct")
    pairs = scratch.keep(_groups(distinct), "pairs")
    n_pairs, n_groups = pairs.agg(F.count("*"), F.count_distinct("group")).first()
    seen = scratch.keep(_met(distinct, pairs, ["lang", "source"], n_pairs).filter("group is not null").select("group", "x"), "seen")
    models = fit(seen, scratch, n_groups)
    of = pairs.join(models, "group", "left").select("lang", "source", "mean", "precision")
    judged = _met(rows, of, ["lang", "source"], n_pairs, "left")
    far = _distance(F.col("x"), F.col("mean"), F.col("precision"))
    inside = F.coalesce(far <= chi2_quantile(CUT, P), F.lit(True))
    return judged.select("doc_id", *[c.split()[0] for c in COUNTS.split(", ")], "base_failed", (~F.col("base_failed") & inside).alias("kept"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality(table(spark, sf_dir, "documents"), spark)
