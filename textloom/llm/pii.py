"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give the base spans, which always stay; looser patterns propose more: obfuscated and national
forms of the same kinds, account numbers, secrets and names.  Labelers (checked form, gazetteer, words before,
words after, counter-evidence) vote on every proposed span.  Expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability without labels, and the posteriors train a naive Bayes span
classifier over votes and shape, which decides on the looser spans.  The tables that the driver sees are counts
by vote pattern, whose number is fixed by the labelers.

Every step is linear in a text and its matches: a pattern's matches and the text between them come from one
split, and what a kind has taken is masked, at its length, before the next kind looks.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "person")

# Possessive and anchored forms of the base patterns.  They match the same spans: what follows a repeated class never
# starts with a member of it, and a run that fails at its start fails at each later place too.
_LOCAL = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: Cheap tests that any match passes; they spare most texts the patterns.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
#: In this order what one kind takes covers what it shares with the others.
MASK_ORDER = ("email", "phone", "card", "ip")

# Fixed word lists: titles, given names common in English, German, French and Spanish, domains.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Herrn|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sr|Sra"
GIVEN = (
    "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|William|Elizabeth|David|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|"
    "Christopher|Daniel|Matthew|Anthony|Mark|Donald|Steven|Andrew|Paul|Joshua|Emily|Emma|Olivia|Sophia|Hannah|Hans|Peter|Klaus|Jürgen|Wolfgang|"
    "Ursula|Monika|Sabine|Petra|Anna|Lukas|Felix|Jean|Pierre|Michel|Philippe|Alain|Marie|Nathalie|Isabelle|Sophie|Camille|José|Antonio|Manuel|"
    "Francisco|Juan|Carlos|Miguel|Carmen|María|Ana|Lucía|Elena|Isabel"
)
_NAME = "\\p{Lu}[\\p{Ll}'’]{1,30}+(?:-\\p{Lu}\\p{Ll}{1,30}+)?+"
_VALUE = "[A-Za-z0-9_+/=-]"
LOOSE = {
    "email": f"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\\x20?[\\[({{](?:at|AT)[\\])}}]\\x20?[A-Za-z0-9-]{{1,63}}+(?:(?:\\x20?[\\[({{](?:dot|DOT)[\\])}}]\\x20?|\\.)[A-Za-z0-9-]{{1,63}}+)++",
    "phone": "(?<![0-9+.])(?:\\([0-9]{3}\\)\\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9+])(?:00[1-9][0-9]{1,2}[\\x20-]?|0[1-9][0-9]{1,3}[\\x20/-])[0-9]{2,4}(?:[\\x20-]?[0-9]{2,4}){1,4}(?![0-9])",
    "card": "(?<![0-9])[0-9]{4}([._/])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}(?![0-9])",
    "ip": "(?<![0-9])[0-9]{1,3}(?:\\x20?[\\[({](?:\\.|dot)[\\])}]\\x20?[0-9]{1,3}){3}(?![0-9])",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}+(?:\\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "secret": f"(?<!{_VALUE})(?=[0-9_+/=-]*+[A-Za-z])(?=[A-Za-z_+/=-]*+[0-9]){_VALUE}{{16,512}}+(?!{_VALUE})",
    "person": f"(?=[\\p{{Lu}}])(?<!\\p{{L}})(?:(?:{TITLES})\\.?\\x20{_NAME}(?:\\x20{_NAME})?+|(?:{GIVEN})\\x20{_NAME})(?!\\p{{L}})",
}
LOOSE_NEEDS = {
    "email": "(?i)[\\[({]at[\\])}]", "phone": "[0-9]{3}[.-][0-9]{4}|0[0-9]{2,4}[\\x20/-][0-9]", "card": "[0-9]{4}[._/][0-9]{4}", "ip": "[0-9]\\x20?[\\[({](?:\\.|dot)[\\])}]",
    "iban": "[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]{4}", "secret": f"{_VALUE}{{16}}", "person": "\\p{Lu}\\p{Ll}{1,11}+\\.?+\\x20\\p{Lu}",
}
GAZETTEER = {
    "email": "(?i)(?:\\.|dot[\\])}]\\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|ch|at|nl|be|us|ca|au|jp)$",
    "ip": "^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[0-1][0-9]|22[0-3])(?![0-9])",
    "card": "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": "^(?:\\+[1-9]|\\(?[2-9][0-9]{2}|00[1-9]|0[1-9])",
    "iban": "^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM)",
    "secret": "^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk[-_]|pk_live|rk_live|xox[abpr]-|eyJ|AIza|ya29|SG\\.)|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$",
    "person": f"(?:^|\\x20)(?:{GIVEN})(?:\\x20|$)",
}
BEFORE = {
    "email": "(?i)mail|contact|write|kontakt|correo|courriel|reach|adresse",
    "ip": "(?i)\\bip\\b|host|server|address|adresse|login|from|client",
    "card": "(?i)card|visa|credit|payment|karte|tarjeta|carte|amex|debit",
    "phone": "(?i)phone|tel|call|fax|mobile|cell|telefon|handy|móvil|ruf",
    "iban": "(?i)iban|account|konto|compte|cuenta|bank|bic",
    "secret": "(?i)(?:token|secret|passw(?:or)?d|pwd|pass|credential|auth\\w*|bearer|api[_ -]?key|access[_ -]?key|private[_ -]?key|key)[\"']?\\s?[:=]?\\s?[\"']?$",
    "person": f"(?i)(?:\\bname|named|\\bby|author|contact|dear|hallo|signed|patient|kund|sincerely|nom|nombre|\\b(?:{TITLES})\\.?)[:,]?\\s*$",
}
AFTER = {
    "email": "(?i)^[^.]{0,20}(?:mail|contact|reply)",
    "ip": "(?i)^(?::[0-9]{2,5}|/[0-9]{1,2}\\b|\\s+(?:port|logged|connected))",
    "card": "(?i)^[^.]{0,20}(?:exp|cvv|cvc|valid|gültig)",
    "phone": "(?i)^\\s*(?:ext|x[0-9]|\\(?(?:mobile|home|work|office|fax))",
    "iban": "(?i)^[^.]{0,20}(?:bic|swift)",
    "secret": "^[\"'`;,)]",
    "person": "(?i)^(?:'s\\b|,?\\s+(?:said|says|wrote|born|aged|lives|phone|tel|email|geboren|née?\\b))",
}
COUNTER = {
    "email": "(?i)example\\s*$|regex",
    "ip": "(?i)version|release|section|chapter|build|\\bv$",
    "card": "(?i)isbn|serial|order|invoice|tracking|part no",
    "phone": "(?i)isbn|version|order|invoice|page|vol|date|\\$",
    "iban": "(?i)serial|model|part",
    "secret": "(?i)(?:sha-?[0-9]*|md5|commit|checksum|digest|revision|hash|uuid|file|path|url|href|src|https?:|www)\\W{0,3}[^\\s]*$",
    "person": "(?i)(?:street|avenue|straße|rue|calle|saint|st\\.|mount|lake|hotel|university)\\s*$",
}
LABELERS = ("checked", "gazetteer", "before", "after", "counter")
WINDOW, BLOCK = 40, 64
#: Noncharacters that stand for taken text: the first of a span by its kind, the others by REST.
TAKEN = {k: chr(0xFDD0 + i) for i, k in enumerate(KINDS)}
REST = "﷯"
SPAN = "struct<start:int,rank:int,end:int,value:string,before:string,after:string,ok:boolean>"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(lengths: Column) -> Column:
    """Sum of all lengths before each one, in blocks, so that work stays near linear in their number."""
    add = lambda s, x: s + x
    total = lambda xs: F.aggregate(xs, F.lit(0), add)
    ends = lambda ls: F.sequence(F.lit(0), F.ceil(F.size(ls) / F.lit(BLOCK)).cast("int"))
    blocks = lambda ls: F.transform(ends(ls), lambda b: total(F.slice(ls, b * BLOCK + 1, BLOCK)))
    before = lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
    place = lambda ls, base: F.transform(ls, lambda _, i: F.element_at(base, (i / F.lit(BLOCK)).cast("int") + 1) + total(F.slice(ls, (i - i % BLOCK) + 1, i % BLOCK)))
    return _let(lengths, lambda ls: _let(_let(blocks(ls), before), lambda base: place(ls, base)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    """Whether a match has the numbers that its kind asks for."""
    if kind == "ip":
        parts = F.transform(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= F.lit("255")))
    if kind == "card":
        digits = _digits(value)
        places = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
        weighed = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
        luhn = F.aggregate(weighed, F.lit(0), lambda s, x: s + x) % 10 == 0
        # a run of thousands of digits is refused by its length before it is weighed
        return F.when(F.length(digits).between(12, 19), luhn).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        plain = F.regexp_replace(value, "\\x20", "")
        turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
        marks = F.filter(F.split(turned, ""), lambda c: c != "")
        number = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(c.cast("int"))
        rest = F.aggregate(marks, F.lit(0), lambda s, c: (s * F.when(c >= "A", 100).otherwise(10) + number(c)) % 97)
        return F.length(plain).between(15, 34) & (rest == 1)
    return F.lit(True)


def _matches(text: Column, pattern: str, needs: str) -> Column:
    wanted = text.contains(needs) if needs == "@" else text.rlike(needs)
    return F.when(wanted, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _spans(text: Column, matches: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points (ends exclusive) and the text around them."""
    rank = KINDS.index(kind)

    def placed(ms: Column, gaps: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(ms)), ms, lambda g, m: F.length(g) + F.length(m))

        def one(start: Column, i: Column) -> Column:
            m, gap = F.get(ms, i), F.get(gaps, i)
            at = start + F.length(gap)
            return F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + F.length(m)).alias("end"), m.alias("value"), F.right(gap, F.lit(WINDOW)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(WINDOW)).alias("after"), _valid(kind, m).alias("ok"))

        return F.transform(_starts(sizes), one)

    found = _let(matches, lambda ms: _let(F.split(text, pattern, -1), lambda gaps: placed(ms, gaps)))
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _masked(text: Column, spans: Column, pattern: str, kind: str, accept) -> Column:
    """The text with the accepted spans of a pattern replaced, at their length, by the kind's mark."""
    fill = lambda s: F.when(accept(s), F.concat(F.lit(TAKEN[kind]), F.repeat(F.lit(REST), F.length(s["value"]) - 1))).otherwise(s["value"])
    whole = F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), F.transform(spans, fill), lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")
    return F.when(F.exists(spans, accept), whole).otherwise(text)


def _by_kind(rank: Column, kinds: tuple[str, ...], make) -> Column:
    out = None
    for kind in kinds:
        hit = rank == KINDS.index(kind)
        out = F.when(hit, make(kind)) if out is None else out.when(hit, make(kind))
    return out


def _voted(s: Column, kind: str, sure: bool) -> Column:
    """A span with each labeler's vote (+1, -1 or 0, abstains) and its shape."""
    yes = lambda c, good, bad: F.when(c, good).otherwise(bad)
    checked = F.lit(1) if sure else yes(s["ok"], 1, -1) if kind in ("iban", "card", "ip") else F.lit(0)
    votes = (checked, yes(s["value"].rlike(GAZETTEER[kind]), 1, -1), yes(s["before"].rlike(BEFORE[kind]), 1, 0), yes(s["after"].rlike(AFTER[kind]), 1, 0), yes(s["before"].rlike(COUNTER[kind]), -1, 0))
    shape = F.least(F.floor(F.length(s["value"]) / 4).cast("int"), F.lit(10))
    return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.lit(sure).alias("sure"), *(v.alias(n) for v, n in zip(votes, LABELERS)), shape.alias("shape"))


def _voter(kind: str, sure: bool):
    return lambda s: _voted(s, kind, sure)


def _ok(s: Column) -> Column:
    return s["ok"]


def _anything(s: Column) -> Column:
    return s["start"] >= 0


def _accepter(model: dict, kind: str):
    return lambda s: _let(_voted(s, kind, False), lambda v: _log_odds(model, kind, v) > 0)


def _covered(text: Column, kind: str) -> Column:
    """The text with the valid matches of a kind's strict pattern masked."""
    fill = lambda m: F.when(_valid(kind, m), F.concat(F.lit(TAKEN[kind]), F.repeat(F.lit(REST), F.length(m) - 1))).otherwise(m)
    joined = lambda ms: F.array_join(F.flatten(F.zip_with(F.split(text, STRICT[kind], -1), ms, lambda g, m: F.array(g, F.coalesce(fill(m), F.lit(""))))), "")
    wanted = text.contains(NEEDS[kind]) if NEEDS[kind] == "@" else text.rlike(NEEDS[kind])
    return F.when(wanted, joined(F.regexp_extract_all(text, F.lit(STRICT[kind]), F.lit(0)))).otherwise(text)


def _looked(df: DataFrame, model: dict | None) -> DataFrame:
    """Adds base (spans of the strict patterns), loose (proposed ones) and masked: the text with the spans found masked.

    Base spans are those of the text itself, kind by kind.  The looser patterns look at the text with all base
    spans masked, each at what those before it have left, so no proposed span overlaps another or a base span.
    Without a model every proposed span is masked, with one those that it accepts.
    """
    text = F.col("text")
    df = df.select("*", *(_matches(text, STRICT[k], NEEDS[k]).alias(f"_m_{k}") for k in BASE))
    base = F.array_sort(F.concat(*(F.transform(F.filter(_spans(text, F.col(f"_m_{k}"), STRICT[k], k), _ok), _voter(k, True)) for k in BASE)))
    df = df.select("*", base.alias("base"), _covered(text, MASK_ORDER[0]).alias("masked")).drop(*(f"_m_{k}" for k in BASE))
    for kind in MASK_ORDER[1:]:
        df = df.withColumn("masked", _covered(F.col("masked"), kind))
    for kind in LOOSE:
        m = F.col("masked")
        df = df.withColumn("_ms", _matches(m, LOOSE[kind], LOOSE_NEEDS[kind])).withColumn(f"_l_{kind}", _spans(m, F.col("_ms"), LOOSE[kind], kind))
        df = df.withColumn("masked", _masked(m, F.col(f"_l_{kind}"), LOOSE[kind], kind, _anything if model is None else _accepter(model, kind)))
    loose = F.array_sort(F.concat(*(F.transform(f"_l_{k}", _voter(k, False)) for k in LOOSE)))
    return df.withColumn("loose", loose).drop("_ms", *(f"_l_{k}" for k in LOOSE))


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans): base spans and proposed spans of each row, with the labelers' votes.

    A null text counts as empty.  One row comes out for each row, so repeated rows give repeated rows, a null id
    stays null and an empty table gives none; other columns are not read.  The result is a written table: filters
    on it would else be pushed into the whole chain of masks.
    """
    df = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return Scratch(docs.sparkSession, "spans").keep(_looked(df, None).select("doc_id", F.concat("base", "loose").alias("spans")), "candidates")


def estimate(counts: dict[tuple[int, ...], float], rounds: int = 50, prior: float = 0.5) -> dict[tuple[int, ...], float]:
    """EM for two hidden classes over vote patterns: the posterior of each pattern.

    Each labeler has a rate for each vote under each class, with a beta-like prior that a vote of +1 is
    likelier on true spans and -1 on false ones; patterns weigh by their counts.
    """
    if not counts:
        return {}
    n = len(next(iter(counts)))
    lean = {(1, 1): 3.0, (1, 0): 1.0, (1, -1): 0.5, (0, 1): 0.5, (0, 0): 1.0, (0, -1): 3.0}
    rates = [{(y, v): lean[y, v] / sum(lean[y, w] for w in (1, 0, -1)) for y in (0, 1) for v in (1, 0, -1)} for _ in range(n)]
    share, posterior = prior, {}
    for _ in range(rounds):
        for votes in counts:
            logs = [math.log(share if y else 1 - share) + sum(math.log(rates[i][y, v]) for i, v in enumerate(votes)) for y in (0, 1)]
            posterior[votes] = 1 / (1 + math.exp(min(700.0, logs[0] - logs[1])))
        total = sum(counts.values())
        share = min(0.99, max(0.01, (sum(c * posterior[v] for v, c in counts.items()) + 1) / (total + 2)))
        for i in range(n):
            mass: dict[tuple[int, int], float] = defaultdict(float)
            for votes, c in counts.items():
                mass[1, votes[i]] += c * posterior[votes]
                mass[0, votes[i]] += c * (1 - posterior[votes])
            for y in (0, 1):
                whole = sum(mass[y, v] + lean[y, v] for v in (1, 0, -1))
                for v in (1, 0, -1):
                    rates[i][y, v] = (mass[y, v] + lean[y, v]) / whole
    return posterior


def fit(held: DataFrame) -> dict[int, tuple[float, dict[str, dict[int, float]]]]:
    """For each kind's rank a bias and the log-odds weight of each vote and shape: the span classifier.

    Kinds of no span have a weightless classifier with a bias of zero, which accepts nothing.
    """
    keys = ("rank", *LABELERS, "shape")
    spans = held.select(F.explode("spans").alias("s")).select(*(F.col(f"s.{k}").alias(k) for k in keys))
    rows = spans.groupBy(*keys).agg(F.count("*").alias("n")).collect()  # at most 7 * 3 * 2 * 2 * 2 * 2 * 11 rows
    model = {}
    for rank in range(len(KINDS)):
        own = sorted((r for r in rows if r["rank"] == rank), key=lambda r: tuple(r))
        counts: dict[tuple[int, ...], float] = defaultdict(float)
        for r in own:
            counts[tuple(r[k] for k in LABELERS)] += r["n"]
        posterior = estimate(dict(counts))
        true = sum(c * posterior[v] for v, c in counts.items())
        false = sum(counts.values()) - true
        weights: dict[str, dict[int, float]] = {}
        for k in (*LABELERS, "shape"):
            mass: dict[tuple[int, int], float] = defaultdict(float)
            for r in own:
                p = posterior[tuple(r[x] for x in LABELERS)]
                mass[1, r[k]] += r["n"] * p
                mass[0, r[k]] += r["n"] * (1 - p)
            weights[k] = {v: math.log((mass[1, v] + 1) / (true + 2)) - math.log((mass[0, v] + 1) / (false + 2)) for v in sorted({v for _, v in mass})}
        model[rank] = (math.log((true + 1) / (false + 1)), weights)
    return model


def log_odds(model: dict, rank: int, votes: dict[str, int]) -> float:
    """The classifier in plain Python."""
    bias, weights = model[rank]
    return bias + sum(by.get(votes[k], 0.0) for k, by in weights.items())


def _log_odds(model: dict, kind: str, s: Column) -> Column:
    bias, weights = model[KINDS.index(kind)]
    total = F.lit(float(bias))
    for name, by_value in weights.items():
        term = F.lit(0.0)
        for v, w in by_value.items():
            term = F.when(s[name] == v, F.lit(float(w))).otherwise(term)
        total = total + term
    return total


def decided(held: DataFrame, model: dict) -> DataFrame:
    """(doc_id, base, found): base spans, and base and accepted ones, as sorted arrays of (start, rank, end)."""
    slim = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))
    pick = lambda keep: F.array_sort(F.transform(F.filter("spans", keep), slim))
    odds = lambda s: _by_kind(s["rank"], KINDS, lambda k: _log_odds(model, k, s))
    return held.select("doc_id", pick(lambda s: s["sure"]).alias("base"), pick(lambda s: s["sure"] | (odds(s) > 0)).alias("found"))


def _spelled(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole document; ``n_found`` counts the base spans and those that the classifier adds."""
    held = candidates(table(spark, sf_dir, "documents"))
    out = decided(held, fit(held))
    count = lambda spans, i: F.size(F.filter(spans, lambda s: s["rank"] == i)).cast("long")
    counts = [count("base", i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return out.select("doc_id", *counts, F.sha2(_spelled("base"), 256).alias("base_sha256"), _spelled("found").alias("spans"), F.size("found").cast("long").alias("n_found"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with each found span replaced by its kind in brackets, and n_chars to match; null texts stay null.

    Spans that overlap are replaced as one.  A text that holds the noncharacters of the masks has them replaced by
    U+FFFD if something in it is redacted.  Repeated rows give repeated rows; other columns stay as they are.
    """
    scratch = Scratch(spark, "redact")
    model = fit(candidates(docs))
    marks = "".join(TAKEN.values()) + REST
    clean = F.translate(F.coalesce("text", F.lit("")), marks, "�" * len(marks))
    # the spans are found again rather than joined back: a projection, where a join would move every text
    df = _looked(docs.select(F.struct(*docs.columns).alias("_row"), clean.alias("text"), clean.alias("_clean")), model)
    done = F.col("masked")
    for kind in KINDS:
        done = F.regexp_replace(done, f"{TAKEN[kind]}{REST}*", f"[{kind.upper()}]")
    new = F.when(F.col("masked") != F.col("_clean"), done).otherwise(F.col("_row.text"))
    out = df.select(new.alias("_new"), "_row.*").withColumn("text", F.col("_new")).drop("_new")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    # written here: a filter on the new text would else be pushed into the whole chain of masks
    return scratch.keep(out.select(*docs.columns), "documents")
