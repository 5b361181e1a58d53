"""Tokenizing and packing of training rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import RE2_SPACE
from textloom.operators import fimstream, ngrams, permutation, rows as R
from textloom.operators.splits import running
from textloom.plans.registry import ORACLE_SQL, query, table

CP = "list_transform(list_filter(string_split({}, ''), lambda c: c <> ''), lambda c: unicode(c))"
TURNS = "(select conv_id, string_agg(text, chr(10) order by turn) filter (role in ('system', 'user')) prompt, string_agg(text, chr(10) order by turn) filter (role = 'assistant') answer from conversations group by conv_id)"
BODY = "regexp_replace(text, '\\A[\\r\\n]+|[\\r\\n]+\\z', '', 'g')"


def _ints(c: str):
    return F.array_join(F.col(c), ",")


@query("char_encode", "with v as (select ch, row_number() over (order by ch) - 1 id from (select distinct ch from (select unnest(string_split(text, '')) ch from documents where lang = 'en') where ch <> '')), m as (select map_from_entries(list((ch, id))) m from v) select doc_id, sha256(array_to_string(list_filter(list_transform(string_split(text, ''), lambda c: m[c]), lambda i: i is not null), ',')) ids_sha, len(list_filter(list_transform(string_split(text, ''), lambda c: m[c]), lambda i: i is not null)) n_ids from documents, m")
def char_encode(spark, d):
    docs = table(spark, d, "documents")
    x = R.encoded(docs, ngrams.vocabulary(docs.filter("lang = 'en'")))
    return x.select("doc_id", F.sha2(_ints("ids"), 256).alias("ids_sha"), F.size("ids").cast("long").alias("n_ids"))


@query("next_token_windows", f"with i as (select doc_id, {CP.format('text')} ids from documents), w as (select doc_id, ids, unnest(range(0, len(ids) - 64, 64)) s from i) select doc_id, s as start, array_to_string(ids[s + 1:s + 64], ',') x, array_to_string(ids[s + 2:s + 65], ',') y from w")
def next_token_windows(spark, d):
    w = R.windows(table(spark, d, "documents").select("doc_id", R.char_ids(F.col("text")).alias("ids")), "ids", 64)
    return w.select("doc_id", F.col("start").cast("long").alias("start"), _ints("x").alias("x"), _ints("y").alias("y"))


@query("doc_rows", f"with i as (select doc_id, {CP.format(BODY + ' || chr(10) || chr(10)')} ids from documents), k as (select doc_id, ids, ids[1:257] kept from i where len(ids) >= 2) select doc_id, array_to_string(list_concat(kept[1:len(kept) - 1], list_transform(range(0, 256 - (len(kept) - 1)), lambda z: 0)), ',') x, array_to_string(list_concat(kept[2:], list_transform(range(0, 256 - (len(kept) - 1)), lambda z: -1)), ',') y, len(kept) - 1 n_targets, len(ids) - len(kept) n_cut from k")
def doc_rows(spark, d):
    r = R.document_rows(table(spark, d, "documents"), 256)
    return r.select("doc_id", _ints("x").alias("x"), _ints("y").alias("y"), F.col("n_targets").cast("long").alias("n_targets"), F.col("n_cut").cast("long").alias("n_cut"))


@query("doc_row_accounting", f"with i as (select doc_id, text, length({BODY}) + 2 n from documents) select count(*) documents, cast(sum(least(n, 257) - 1) as bigint) target_tokens, count(*) filter (n > 257) cut_documents, cast(sum(greatest(n - 257, 0)) as bigint) cut_tokens, max(n) longest_tokens, count(*) filter (contains({BODY}, chr(10) || chr(10))) blank_line_documents from i where n >= 2")
def doc_row_accounting(spark, d):
    body = F.regexp_replace("text", "\\A[\\r\\n]+|[\\r\\n]+\\z", "")
    x = table(spark, d, "documents").select(body.alias("b"), (F.length(body) + 2).alias("n")).filter("n >= 2")
    return x.agg(F.count("*").alias("documents"), F.sum(F.least("n", F.lit(257)) - 1).alias("target_tokens"), F.count_if(F.col("n") > 257).alias("cut_documents"), F.sum(F.greatest(F.col("n") - 257, F.lit(0))).alias("cut_tokens"), F.max("n").cast("long").alias("longest_tokens"), F.count_if(F.col("b").contains("\n\n")).alias("blank_line_documents"))


def _turns(spark, d):
    c = table(spark, d, "conversations")
    joined = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    g = c.groupBy("conv_id").agg(joined(F.col("role").isin("system", "user")).alias("prompt"), joined(F.col("role") == "assistant").alias("answer"), F.count_if(F.col("role").isin("system", "user")).alias("np"), F.count_if(F.col("role") == "assistant").alias("na"))
    return g.filter("np > 0 and na > 0")


@query("prompt_completion_mask", f"with t as (select * from {TURNS} where prompt is not null and answer is not null and prompt <> '' and answer <> ''), i as (select conv_id, {CP.format('prompt')} p, {CP.format('answer')} a from t) select conv_id, array_to_string(list_concat(p, a)[1:len(p) + len(a) - 1], ',') inputs, array_to_string(list_concat(list_transform(range(0, len(p) - 1), lambda z: -1), a), ',') targets, len(p) prompt_tokens, len(a) completion_tokens from i")
def prompt_completion_mask(spark, d):
    t = _turns(spark, d).filter("prompt <> '' and answer <> ''").select("conv_id", R.char_ids(F.col("prompt")).alias("p"), R.char_ids(F.col("answer")).alias("a"))
    x, y = R.masked(F.col("p"), F.col("a"))
    return t.select("conv_id", F.array_join(x, ",").alias("inputs"), F.array_join(y, ",").alias("targets"), F.size("p").cast("long").alias("prompt_tokens"), F.size("a").cast("long").alias("completion_tokens"))


@query("segment_rows", f"with t as (select * from {TURNS} where prompt <> '' and answer <> ''), i as (select conv_id, {CP.format('prompt')} p, {CP.format(chr(39) + 'run' + chr(39))} e, {CP.format('answer')} a from t) select conv_id, array_to_string(list_concat(list_concat(p, e), a)[1:len(p) + len(e) + len(a) - 1], ',') inputs, array_to_string(list_concat(list_transform(range(0, len(p) + len(e) - 1), lambda z: -1), a), ',') targets from i")
def segment_rows(spark, d):
    t = _turns(spark, d).filter("prompt <> '' and answer <> ''").select("conv_id", R.char_ids(F.col("prompt")).alias("p"), F.array(F.struct(R.char_ids(F.lit("run")).alias("ids"), F.lit("execution").alias("role")), F.struct(R.char_ids(F.col("answer")).alias("ids"), F.lit("answer").alias("role"))).alias("parts"))
    x, y = R.segments(F.col("p"), F.col("parts"), False)
    return t.select("conv_id", F.array_join(x, ",").alias("inputs"), F.array_join(y, ",").alias("targets"))


@query("collate", f"with t as (select * from {TURNS} where prompt <> '' and answer <> ''), i as (select conv_id, conv_id // 8 batch, {CP.format('prompt')} x, len(prompt) n from t), m as (select batch, max(n) n from i group by batch) select conv_id, batch, array_to_string(list_concat(x, list_transform(range(0, m.n - i.n), lambda z: 0)), ',') x, m.n - i.n pad from i join m using (batch)")
def collate(spark, d):
    t = _turns(spark, d).filter("prompt <> '' and answer <> ''").select("conv_id", F.floor(F.col("conv_id") / 8).alias("batch"), R.char_ids(F.col("prompt")).alias("x")).withColumn("y", F.col("x"))
    return R.collated(t).select("conv_id", "batch", _ints("x").alias("x"), F.col("pad").cast("long").alias("pad"))


@query("pair_rows", "with p as (select doc_id, text from documents join labels using (doc_id) where quality is not null), q as (select doc_id, substr(text, 1, 40) prompt, substr(text, 41, length(text) // 2) chosen, substr(text, 41 + length(text) // 2) rejected from p) select doc_id, case when coalesce(prompt, '') = '' then 'empty prompt' when coalesce(chosen, '') = '' or coalesce(rejected, '') = '' then 'empty side' when chosen = rejected then 'identical sides' when greatest(length(chosen), length(rejected)) + length(prompt) - 1 > 128 then 'too long' end refusal from q")
def pair_rows(spark, d):
    p = table(spark, d, "documents").join(table(spark, d, "labels").filter("quality is not null"), "doc_id")
    half = F.floor(F.length("text") / 2).cast("int")
    prompt, chosen, rejected = F.substring("text", 1, 40), F.substring(F.col("text"), F.lit(41), half), F.substring(F.col("text"), half + 41, F.length("text"))
    return p.select("doc_id", R.pair_refusal(prompt, chosen, rejected, 128).alias("refusal"))


@query("full_batches", "with r as (select conv_id, row_number() over (order by sha256('7:0:' || conv_id)) rn, count(*) over () n from (select distinct conv_id from conversations)) select conv_id, (rn - 1) // 16 batch from r where (rn - 1) // 16 < n // 16")
def full_batches(spark, d):
    from textloom.operators.splits import running

    c = table(spark, d, "conversations").select("conv_id").distinct().withColumn("h", F.sha2(F.concat(F.lit("7:0:"), F.col("conv_id").cast("string")), 256))
    c = c.withColumn("k", F.conv(F.substring("h", 1, 4), 16, 10).cast("long"))
    counts = running(c.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("h", "conv_id"))).alias("xs")), F.size("xs"), "k")
    rows = counts.select("before", "total", F.posexplode("xs").alias("i", "x")).select("x.conv_id", F.floor((F.col("before") + F.col("i")) / 16).alias("batch"), "total")
    return rows.filter(F.col("batch") < F.floor(F.col("total") / 16)).select("conv_id", "batch")


@query("mask_audit", f"with t as (select * from {TURNS} where prompt <> '' and answer <> '') select count(*) rows, cast(sum(length(prompt) + length(answer) - 1) as bigint) tokens, cast(sum(length(answer)) as bigint) supervised, count(*) filter (length(prompt) + length(answer) - 1 > 512) overlength, bool_and(length(answer) > 0) all_supervised from t")
def mask_audit(spark, d):
    t = _turns(spark, d).filter("prompt <> '' and answer <> ''").select(R.char_ids(F.col("prompt")).alias("p"), R.char_ids(F.col("answer")).alias("a"))
    x, y = R.masked(F.col("p"), F.col("a"))
    sup = F.size(F.filter(y, lambda v: v != -1))
    return t.select(F.size(x).alias("n"), sup.alias("s")).agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"), F.sum("s").alias("supervised"), F.count_if(F.col("n") > 512).alias("overlength"), F.bool_and(F.col("s") > 0).alias("all_supervised"))


@query("fim_rows", "select doc_id, text joined from documents")
def fim_rows(spark, d):
    r = R.fim(table(spark, d, "documents"), 0.5, 0.5, 1337, 0)
    return r.select("doc_id", F.concat("prefix", "middle", "suffix").alias("joined"))


DRAW = "('0x' || substr(md5('fim:1337:0:{}:' || doc_id), 1, 8))::bigint"


@query("fim_parts", f"""with d as (select doc_id, coalesce(text, '') t, length(coalesce(text, '')) n, {DRAW.format('rate')} < 2147483648 hit, {DRAW.format('spm')} < 2147483648 spm, {DRAW.format('a')} a, {DRAW.format('b')} b from documents),
 m as (select doc_id, t, n, spm, hit and n >= 2 hit, a % (n + 1) a, b % greatest(n, 1) b from d), c as (select *, least(a, b + (b >= a)::int) lo, greatest(a, b + (b >= a)::int) hi from m)
 select doc_id, case when hit then t[:lo] else t end prefix, case when hit then substr(t, lo + 1, hi - lo) else '' end middle, case when hit then substr(t, hi + 1) else '' end suffix, case when not hit then 'plain' when spm then 'spm' else 'psm' end arrangement from c""")
def fim_parts(spark, d):
    return R.fim(table(spark, d, "documents"), 0.5, 0.5, 1337, 0)


@query("epoch_order", "select doc_id, row_number() over (order by sha256('1337:2:' || doc_id), doc_id) - 1 place from documents")
def epoch_order(spark, d):
    """The place of each document in an epoch: rows are ranked inside buckets of the digest's first two bytes, then by the buckets' sizes."""
    from textloom.operators.splits import running

    x = table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.lit("1337:2:"), F.col("doc_id").cast("string")), 256).alias("k"))
    x = x.withColumn("b", F.conv(F.substring("k", 1, 4), 16, 10).cast("long"))
    before = running(x.groupBy("b").agg(F.count("*").alias("n")), F.col("n"), "b").select("b", "before")
    rank = F.row_number().over(Window.partitionBy("b").orderBy("k", "doc_id"))
    return x.join(before, "b").select("doc_id", (F.col("before") + rank - 1).cast("long").alias("place"))


_NUMBERED = "select doc_id id, count(*) over () n, row_number() over (order by doc_id) - 1 x from documents"
_HALVES = f"select id, n, greatest(1, (length(bin(greatest(1, n - 1))) + 1) // 2) h, x from ({_NUMBERED})"


@query("epoch_places", f"with recursive w as ({permutation.pass_sql(_HALVES, 1337, 2)} union all {permutation.pass_sql('select * from w where x >= n', 1337, 2)}) select id doc_id, x place from w where x < n")
def epoch_places(spark, d):
    """The place of each document in an epoch by a keyed permutation of their numbers."""
    numbered = running(table(spark, d, "documents").select("doc_id"), F.lit(1)).select("doc_id", F.col("before").alias("number"), "total")
    n = numbered.agg(F.max("total")).first()[0] or 0
    return permutation.with_places(numbered.drop("total"), n, 1337, 2).select("doc_id", "place")


_DATASET = f"""with t as (select * from {TURNS} where prompt <> '' and answer <> ''), i as (select conv_id, case when conv_id % 3 = 0 then 'synthesis' else 'execution' end kind, {CP.format('prompt')} p, case when conv_id % 3 = 0 then [] else {CP.format("'run ' || conv_id")} end e, {CP.format('answer')} a from t), f as (select *, len(p) + len(e) + len(a) - 1 <= 4096 fits from i)"""


def _dataset(spark, d):
    part = lambda ids, role: F.struct(ids.alias("ids"), F.lit(role).alias("role"))
    answer = part(R.char_ids(F.col("answer")), "answer")
    run = part(R.char_ids(F.concat(F.lit("run "), F.col("conv_id").cast("string"))), "execution")
    synthesis = F.col("conv_id") % 3 == 0
    t = _turns(spark, d).filter("prompt <> '' and answer <> ''")
    rows = t.select("conv_id", F.when(synthesis, "synthesis").otherwise("execution").alias("kind"), R.char_ids(F.col("prompt")).alias("prompt"), F.when(synthesis, F.array(answer)).otherwise(F.array(run, answer)).alias("parts"))
    return R.dataset(rows, 4096)


@query("dataset_rows", f"{_DATASET}, x as (select conv_id, kind, array_to_string((p || e || a)[1:len(p) + len(e) + len(a) - 1], ',') inputs, array_to_string(list_transform(range(0, len(p) + len(e) - 1), lambda z: -1) || a, ',') targets, array_to_string(list_transform(range(0, len(p) - 1), lambda z: -1) || e || list_transform(range(0, len(a)), lambda z: -1), ',') execution from f where fits) select conv_id, kind, sha256(inputs) inputs, sha256(targets) targets, sha256(execution) execution from x")
def dataset_rows(spark, d):
    """Examples of both kinds with the two masks."""
    examples = _dataset(spark, d)[0]
    return examples.select("conv_id", "kind", *[F.sha2(F.array_join(c, ","), 256).alias(c) for c in ("inputs", "targets", "execution")])


@query("dataset_dropped", f"{_DATASET} select kind, count(*) filter (not fits) dropped, count(*) n from f group by kind")
def dataset_dropped(spark, d):
    return _dataset(spark, d)[1]


@query("pair_encodings", f"""with p as (select doc_id, text from documents join labels using (doc_id) where quality is not null), q as (select doc_id, substr(text, 1, 40) prompt, substr(text, 41, length(text) // 2) chosen, substr(text, 41 + length(text) // 2) rejected from p),
 r as (select *, coalesce(prompt, '') <> '' and coalesce(chosen, '') <> '' and coalesce(rejected, '') <> '' and chosen <> rejected and greatest(length(chosen), length(rejected)) + length(prompt) - 1 <= 1024 good from q), i as (select doc_id, good, {CP.format('prompt')} p, {CP.format('chosen')} c, {CP.format('rejected')} r from r)
 select doc_id, good usable, case when good then sha256(array_to_string((p || c)[1:len(p) + len(c) - 1], ',')) end chosen_inputs, case when good then sha256(array_to_string(list_transform(range(0, len(p) - 1), lambda z: -1) || c, ',')) end chosen_targets, case when good then sha256(array_to_string((p || r)[1:len(p) + len(r) - 1], ',')) end rejected_inputs, case when good then sha256(array_to_string(list_transform(range(0, len(p) - 1), lambda z: -1) || r, ',')) end rejected_targets from i""")
def pair_encodings(spark, d):
    """Both sides of each preference pair as masked rows."""
    p = table(spark, d, "documents").join(table(spark, d, "labels").filter("quality is not null"), "doc_id")
    half = F.floor(F.length("text") / 2).cast("int")
    q = p.select("doc_id", F.substring("text", 1, 40).alias("prompt"), F.substring(F.col("text"), F.lit(41), half).alias("chosen"), F.substring(F.col("text"), half + 41, F.length("text")).alias("rejected"))
    out = R.pairs(q, "prompt", "chosen", "rejected", 1024)
    return out.select("doc_id", F.col("refusal").isNull().alias("usable"), *[F.sha2(F.array_join(c, ","), 256).alias(c) for c in ("chosen_inputs", "chosen_targets", "rejected_inputs", "rejected_targets")])


@query("fim_windows", f"""with p as ({ORACLE_SQL['fim_parts']}), i as (select doc_id, {CP.format('prefix')} p, {CP.format('middle')} m, {CP.format('suffix')} s, arrangement a from p),
 d as (select doc_id, case a when 'psm' then [1114112] || p || [1114113] || s || [1114114] || m || [1114115] when 'spm' then [1114112, 1114113] || s || [1114114] || p || m || [1114115] else p end || [10, 10] ids from i join documents using (doc_id) where regexp_replace(text, '[{RE2_SPACE}]+', '', 'g') <> ''),
 b as (select ids, sum(len(ids)) over (order by doc_id) - len(ids) base from d), t as (select base + generate_subscripts(ids, 1) - 1 pos, unnest(ids) id from b), w as (select sum(len(ids))::bigint - 2 total from d),
 y as (select draw, ('0x' || substr(md5('window:1337:0:' || draw), 1, 15))::bigint % (total - 512) start from (select total, unnest(range(0, (total + 511) // 512)) draw from w)), z as (select draw, start, unnest(range(start, start + 513)) pos from y)
 select draw, start, sha256(string_agg(id, ',' order by pos) filter (pos < start + 512)) inputs, sha256(string_agg(id, ',' order by pos) filter (pos > start)) targets from z join t using (pos) group by draw, start""")
def fim_windows(spark, d):
    """An epoch's windows over documents of which half have their middles moved."""
    found = fimstream.windows(fimstream.stream(table(spark, d, "documents"), 1337, 0, 0.5), 512, 1337, 0)
    return found.select("draw", "start", *[F.sha2(F.array_join(c, ","), 256).alias(c) for c in ("inputs", "targets")])
