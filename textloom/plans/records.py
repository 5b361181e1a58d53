"""Small record operators: fingerprints, sides, rates, flags, orders, masks, traces, validators and arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators import records as R
from textloom.operators import splits
from textloom.plans.corpus import FRACTION, PATH, SEED, SPLIT, SURVIVORS
from textloom.plans.registry import query, table
from textloom.sources.scratch import Scratch
from textloom.streaming import probe

SIDED = f"(select doc_id, text, {SPLIT} split from documents join ({SURVIVORS}) using (doc_id))"
METRICS = "(select user_id run, event_id step, value, event_type kind from events)"


@query("split_fingerprint", f"with v as (select doc_id, text from {SIDED} where split = 'val'), p as (select doc_id // 1000 b, sha1(string_agg(sha1(text), '' order by doc_id)) h from v group by 1) select {FRACTION}::double val_frac, {SEED} seed, (select cast(coalesce(sum(length(text)), 0) + 2 * greatest(count(*) - 1, 0) as bigint) from v) val_chars, substr(sha1(string_agg(h, '' order by b)), 1, 12) val_sha1 from p")
def split_fingerprint(spark, d):
    """Requested split, its validation characters and a digest of them: a tree of the digests of id blocks, never one row of all."""
    v = splits.hash_split(table(spark, d, "documents"), SEED, FRACTION).filter("split = 'val'")
    return R.tree_digest(v, "doc_id", "text").select(F.lit(FRACTION).alias("val_frac"), F.lit(SEED).alias("seed"), F.col("chars").alias("val_chars"), F.col("digest").alias("val_sha1"))


@query("side_texts", f"with s as (select doc_id, text, split, coalesce(sum(length(text) + 2) over (partition by split order by doc_id rows between unbounded preceding and 1 preceding), 0) pos from {SIDED}) select doc_id, split, cast(pos as bigint) pos, sha1(text) h from s")
def side_texts(spark, d):
    """The two sides as joined texts, kept as pieces with their places: a side is never one value."""
    s = splits.hash_split(table(spark, d, "documents"), SEED, FRACTION).select("doc_id", "split", F.length("text").alias("n"), F.sha1("text").alias("h"))
    s = Scratch(spark, "sides").keep(s, "narrow")  # read by both sides, and by each one's ranges
    side = lambda x: splits.running(s.filter(F.col("split") == x), F.col("n") + 2)
    return side("train").unionByName(side("val")).select("doc_id", "split", F.col("before").cast("long").alias("pos"), "h")


@query("token_split", f"with t as (select doc_id, len(string_split(text, ' ')) n from documents), r as (select *, coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) before, sum(n) over () total from t) select doc_id, cast(greatest(0, least(n, floor(total * {1 - FRACTION}) - before)) as bigint) train_tokens, n::bigint n from r")
def token_split(spark, d):
    r = splits.running(table(spark, d, "documents").select("doc_id", F.size(F.split("text", " ", -1)).alias("n")), F.col("n"))
    cut = F.floor(F.col("total") * F.lit(1 - FRACTION))
    return r.select("doc_id", F.greatest(F.lit(0).cast("long"), F.least(F.col("n").cast("long"), cut - F.col("before"))).alias("train_tokens"), F.col("n").cast("long").alias("n"))


@query("explicit_sides", "select doc_id id, 'train' split, length(text) n from documents union all select item_id, 'val', length(text) from benchmark")
def explicit_sides(spark, d):
    side = lambda name, key, label: table(spark, d, name).select(F.col(key).alias("id"), F.lit(label).alias("split"), F.length("text").cast("long").alias("n"))
    return side("documents", "doc_id", "train").unionByName(side("benchmark", "item_id", "val"))


@query("scan_prefix", "with r as (select doc_id, length(text) n, coalesce(sum(length(text)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) before from documents) select doc_id, cast(least(n, 2000000 - before) as bigint) n from r where before < 2000000 and n > 0")
def scan_prefix(spark, d):
    """The documents of the corpus's first 2,000,000 characters, which is what an inspection samples."""
    r = splits.running(table(spark, d, "documents").select("doc_id", F.length("text").alias("n")), F.col("n"))
    return r.filter("before < 2000000 and n > 0").select("doc_id", F.least(F.col("n").cast("long"), 2_000_000 - F.col("before")).alias("n"))


@query("nested_get", "select event_id, json_extract_string(props, '$.ref') ref, coalesce(json_extract_string(props, '$.none.deep'), 'absent') deep from events")
def nested_get(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.ref").alias("ref"), F.coalesce(F.get_json_object("props", "$.none.deep"), F.lit("absent")).alias("deep"))


@query("split_rate", "select lang, case when count(*) filter (quality is not null) = 0 then 'nan'::double else round(sum(quality) / count(quality), 9) end rate from documents left join (select * from labels where toxic = 0) using (doc_id) group by lang")
def split_rate(spark, d):
    """Correct over tried in the chosen split; a group that tried nothing gets NaN, not null."""
    x = table(spark, d, "documents").join(table(spark, d, "labels").filter("toxic = 0"), "doc_id", "left")
    return x.groupBy("lang").agg(R.rate(F.col("quality"), F.col("quality").isNotNull()).alias("rate"))


@query("evaluation_filter", "select doc_id, lang from documents where lang in ('en', 'fr')")
def evaluation_filter(spark, d):
    return table(spark, d, "documents").filter(F.col("lang").isin("en", "fr")).select("doc_id", "lang")


@query("seed_flags", f"with m as (select run % 5 seed, avg(value) filter (kind = 'click') a, avg(value) filter (kind = 'view') b from {METRICS} group by 1) select count(*) seeds, count(*) filter (a is not null and b is not null) completed, coalesce(bool_and(a < b) filter (a is not null and b is not null), false) and count(*) = count(*) filter (a is not null and b is not null) all_lower, round(avg(a - b), 9) mean_gain from m")
def seed_flags(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("seed"), "value", "event_type")
    m = e.groupBy("seed").pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    done = F.col("click").isNotNull() & F.col("view").isNotNull()
    all_lower = F.coalesce(F.bool_and(F.when(done, F.col("click") < F.col("view"))), F.lit(False)) & (F.count("*") == F.count_if(done))
    return m.agg(F.count("*").alias("seeds"), F.count_if(done).alias("completed"), all_lower.alias("all_lower"), F.round(F.avg(F.col("click") - F.col("view")), 9).alias("mean_gain"))


@query("comparison_verdict", f"with a as (select run, avg(value) v from {METRICS} group by run), c as (select lead(v) over (order by run) - v change from a) select case when bool_and(change < 0) then 'falls throughout' when bool_or(change < 0) then 'mixed' else 'never falls' end verdict from c where change is not null")
def comparison_verdict(spark, d):
    a = table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.avg("value").alias("v"))
    c = a.withColumn("change", F.lead("v").over(Window.orderBy("run")) - F.col("v")).filter("change is not null")  # over one row an arm
    return c.agg(F.when(F.bool_and(F.col("change") < 0), "falls throughout").when(F.bool_or(F.col("change") < 0), "mixed").otherwise("never falls").alias("verdict"))


@query("refused_ids", "select item_id id from benchmark union select doc_id from labels where toxic = 1")
def refused_ids(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id")).union(table(spark, d, "labels").filter("toxic = 1").select("doc_id")).distinct()


@query("median_first", "with r as (select conv_id, turn, row_number() over (partition by conv_id order by length(text), turn) - 1 rn, count(*) over (partition by conv_id) n from conversations) select conv_id, turn, (rn - n // 2 + n) % n place from r")
def median_first(spark, d):
    """Rows of a group by size, turned so that the median comes first."""
    w = Window.partitionBy("conv_id")
    r = table(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(w.orderBy(F.length("text"), "turn")) - 1).alias("rn"), F.count("*").over(w).alias("n"))
    return r.select("conv_id", "turn", F.pmod(F.col("rn") - F.floor(F.col("n") / 2), F.col("n")).cast("long").alias("place"))


@query("top_scores", "select vec_id, list_aggregate(list_reverse_sort(embedding)[1:3], 'string_agg', ',') top from (select vec_id, list_transform(embedding, lambda x: round(x::double, 6)) embedding from embeddings)")
def top_scores(spark, d):
    x = F.transform("embedding", lambda v: F.round(v.cast("double"), 6))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.slice(F.sort_array(x, asc=False), 1, 3), ",").alias("top"))


@query("path_order", f"select doc_id, p as path, row_number() over (partition by source order by p, doc_id) place from (select doc_id, source, {PATH} p from documents)")
def path_order(spark, d):
    """Files of a source in path order, as readers take them."""
    from textloom.operators import provenance

    x = provenance.with_paths(table(spark, d, "documents"))
    return x.select("doc_id", "path", F.row_number().over(Window.partitionBy("source").orderBy("path", "doc_id")).cast("long").alias("place"))


@query("first_examples", "select conv_id, turn, role from conversations order by conv_id, turn limit 20")
def first_examples(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role").orderBy("conv_id", "turn").limit(20)


@query("distinct_examples", "select example, min(conv_id) first_conv, count(*) n from (select conv_id, '[' || turn || ',\"' || role || '\"]' example from conversations) group by example")
def distinct_examples(spark, d):
    """Drawn examples by their JSON key: the first and how often each was drawn."""
    x = table(spark, d, "conversations").select("conv_id", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit(',"'), "role", F.lit('"]')).alias("example"))
    return x.groupBy("example").agg(F.min("conv_id").alias("first_conv"), F.count("*").alias("n"))


TRACE = "string_split(replace(text, '. ', '.' || chr(10)) || chr(10) || 'output r = ' || doc_id || chr(10) || chr(10) || 'tail', chr(10))"


@query("trace_parse", f"with l as (select doc_id, {TRACE} ls from documents), p as (select doc_id, ls, list_position(list_transform(ls, lambda x: starts_with(x, 'output r = ')), true) pos from l) select doc_id, len(list_filter(ls[1:pos - 1], lambda x: x <> '')) n_steps, substr(ls[pos], 12) answer from p")
def trace_parse(spark, d):
    """Steps of a generated trace and its answer: the lines before the first output line, empty ones dropped."""
    t = F.concat(F.replace("text", F.lit(". "), F.lit(".\n")), F.lit("\noutput r = "), F.col("doc_id").cast("string"), F.lit("\n\ntail"))
    steps, answer = R.trace(t)
    return table(spark, d, "documents").select("doc_id", F.size(steps).cast("long").alias("n_steps"), answer.alias("answer"))


@query("validators", "select event_id, isfinite(value) finite, value = floor(value) whole, regexp_full_match(sha256(props), '[0-9a-f]{64}') digest from events where value is not null and props is not null")
def validators(spark, d):
    e = table(spark, d, "events").filter("value is not null and props is not null")
    return e.select("event_id", R.finite(F.col("value")).alias("finite"), (F.col("value") == F.floor("value")).alias("whole"), R.hex_digest(F.sha2("props", 256)).alias("digest"))


@query("row_mask_audit", "with t as (select conv_id, string_agg(text, chr(10) order by turn) filter (role in ('system', 'user')) p, string_agg(text, chr(10) order by turn) filter (role = 'assistant') a from conversations group by conv_id) select conv_id, list_transform(string_split(p || a, ''), lambda c: unicode(c))[1:length(p) + length(a) - 1] = list_concat(list_transform(string_split(p, ''), lambda c: unicode(c)), list_transform(string_split(a, ''), lambda c: unicode(c)))[1:length(p) + length(a) - 1] same_inputs, length(a) supervised from t where p <> '' and a <> ''")
def row_mask_audit(spark, d):
    """Both encodings of a row have the same inputs, and every answer target is the answer's own token."""
    from textloom.operators import rows
    from textloom.plans.rows import _turns

    t = _turns(spark, d).filter("prompt <> '' and answer <> ''").select("conv_id", rows.char_ids(F.col("prompt")).alias("p"), rows.char_ids(F.col("answer")).alias("a"))
    x, y = rows.masked(F.col("p"), F.col("a"))
    sx, sy = rows.segments(F.col("p"), F.array(F.struct(F.col("a").alias("ids"), F.lit("answer").alias("role"))), False)
    own = F.forall(F.zip_with(x, y, lambda i, j: (j == -1) | j.isNotNull()), lambda ok: ok)
    return t.select("conv_id", ((x == sx) & (y == sy) & own).alias("same_inputs"), F.size(F.filter(y, lambda v: v != -1)).cast("long").alias("supervised"))


@query("parameter_counts", "select p_partkey, 12 * l * n * n + v * n params, 6 * (12 * l * n * n + v * n) * 1024 flops, round(0.003 * 256 / n, 9) lr from (select p_partkey, 64 * (1 + p_size % 8)::bigint n, (2 + p_size % 5)::bigint l, (256 + p_partkey % 1000)::bigint v from part)")
def parameter_counts(spark, d):
    """Weights, floating-point operations a step of 1024 tokens and the width rule's learning rate of models sized by the parts."""
    n, l, v = 64 * (1 + F.col("p_size") % 8).cast("long"), (2 + F.col("p_size") % 5).cast("long"), (256 + F.col("p_partkey") % 1000).cast("long")
    grid = table(spark, d, "part").select("p_partkey", n.alias("n"), l.alias("l"), v.alias("v"))
    params = 12 * F.col("l") * F.col("n") * F.col("n") + F.col("v") * F.col("n")
    return grid.select("p_partkey", params.alias("params"), (6 * params * 1024).alias("flops"), F.round(0.003 * 256 / F.col("n"), 9).alias("lr"))


@query("time_words", "select event_id, case when s < 60 then s || 's' when s < 3600 then s // 60 || 'm' else s // 3600 || 'h ' || lpad((s % 3600 // 60)::varchar, 2, '0') || 'm' end words from (select event_id, event_id * 7 s from events)")
def time_words(spark, d):
    return table(spark, d, "events").select("event_id", T.time_words(F.col("event_id") * 7).alias("words"))


@query("pair_scan", "with p as (select row_number() over (order by item_id) - 1 line_no, item_id, text from benchmark), q as (select line_no, item_id, substr(text, 1, 20) prompt, substr(text, 21, 20) chosen, substr(text, 41) rejected from p) select line_no, item_id, case when item_id is null then 'no id' when prompt = '' then 'empty prompt' when chosen = '' or rejected = '' then 'empty side' when chosen = rejected then 'identical sides' when item_id in (select doc_id from labels where toxic = 1) then 'held-out id' end refusal from q")
def pair_scan(spark, d):
    """Preference pairs by line with the first reason against each; a scan with any reason is refused as a whole."""
    b = table(spark, d, "benchmark")
    lines = splits.running(b.select("item_id", "text"), F.lit(1), "item_id").select(F.col("before").cast("long").alias("line_no"), "item_id", "text")
    q = lines.select("line_no", "item_id", F.substring("text", 1, 20).alias("prompt"), F.substring("text", 21, 20).alias("chosen"), F.expr("substring(text, 41)").alias("rejected"))
    gate = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("item_id")).distinct().withColumn("gated", F.lit(True))
    return q.join(gate, "item_id", "left").select("line_no", "item_id", R.pair_reason("item_id", "prompt", "chosen", "rejected", F.col("gated")).alias("refusal"))


@query("conversations_built", "with b as (select doc_id, text, instr(text, '. ') pos from documents) select doc_id, case when coalesce(text, '') = '' then 'empty' when pos = 0 then 'no answer' end why, case when pos > 0 then substr(text, 1, pos) end prompt_text, case when pos > 0 then length(text) - pos - 1 end answer_chars from b")
def conversations_built(spark, d):
    """Documents as conversations, their first sentence as the prompt; those that make none are skipped with the reason."""
    c = R.conversation(table(spark, d, "documents"))
    return c.select("doc_id", "why", F.col("turns")[0]["text"].alias("prompt_text"), F.length(F.col("turns")[1]["text"]).cast("long").alias("answer_chars"))


@query("study_state", f"with a as (select run, count(*) n, max(step) last_step, bool_and(isfinite(value)) ok, min(value) lo from {METRICS} where value is not null group by run) select run, concat_ws(',', case when n < 50 then 'budget' end, case when not ok then 'finite' end, case when lo <= 0.5 then 'floor' end) issues, case when not ok then 'failed' when n < 50 then 'running' else 'done' end state from a")
def study_state(spark, d):
    """Rules that an arm breaks and the state that they put it in."""
    from textloom.operators.studies import issues

    m = table(spark, d, "events").filter("value is not null")
    a = m.groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("n"), F.bool_and(R.finite(F.col("value"))).alias("ok"), F.min("value").alias("lo"))
    a = issues(a, {"budget": F.col("n") >= 50, "finite": F.col("ok"), "floor": F.col("lo") > 0.5})
    return a.select("run", "issues", F.when(~F.col("ok"), "failed").when(F.col("n") < 50, "running").otherwise("done").alias("state"))


@query("study_states", """with l as (select user_id run, case when event_type = 'signup' then 'start' when event_type = 'error' and value < 0.5 then 'end' else 'metric' end kind, event_id // 2 step, case when event_id % 997 = 0 then null else value end value, case when value < 0.2 then 'complete' when value < 0.4 then 'failed' end note, ts from events),
 t as (select run, bool_or(two) two from (select run, step, count(distinct coalesce(value, 'nan'::double)) > 1 two from l where kind = 'metric' group by all) group by run),
 r as (select run, max(step) filter (kind = 'metric') step, max(step) filter (kind = 'start') planned, max(ts) seen, max(ts) filter (kind = 'metric') progress, bool_or(kind = 'metric' and (value is null or not isfinite(value))) odd, arg_max(case when note in ('complete', 'failed', 'interrupted') then note else 'failed' end, ts) filter (kind = 'end') ended from l group by run),
 a as (select r.*, two, (epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(coalesce(progress, seen))) / 1e6 age from r left join t using (run)), b as (select *, age > case when progress is null then 120 else 21600 end late from a)
 select run, case when two or odd then 'failed' when ended is not null then ended when late then 'stalled' else 'running' end status, case when two then 'a step has two values' when odd then 'not finite' when ended is not null then 'study ' || ended when late and progress is null then 'nothing after the start' when late then 'no progress' when progress is null then 'awaiting steps' else 'active' end reason,
 step, planned, round(greatest(age, 0), 1) progress_age_seconds from b""")
def study_states(spark, d):
    """Each run's state at a time, the batch form of the live probe: ends, faults and silence by its lines."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "start").when((F.col("event_type") == "error") & (F.col("value") < 0.5), "end").otherwise("metric")
    note = F.when(F.col("value") < 0.2, "complete").when(F.col("value") < 0.4, "failed")
    lines = e.select(F.col("user_id").alias("run"), kind.alias("kind"), F.floor(F.col("event_id") / 2).alias("step"), F.when(F.col("event_id") % 997 != 0, F.col("value")).alias("value"), note.alias("note"), "ts")
    return probe.study_states(lines, F.lit("2024-01-31 00:00:00"), stall_seconds=21600)


@query("corpus_inspection", "select source, count(*) docs, cast(sum(length(text)) as bigint) chars, cast(sum(strlen(text)) as bigint) bytes, count(distinct sha256(text)) distinct_texts, cast(sum(len(string_split(text, ' '))) as bigint) words, round(sum(len(string_split(text, ' '))) / nullif(sum(strlen(text)), 0), 9) words_per_byte from documents group by source")
def corpus_inspection(spark, d):
    """Audit of a corpus by source: documents, characters, bytes, distinct texts, tokens and tokens a byte."""
    return R.inspection(table(spark, d, "documents"), "source")
