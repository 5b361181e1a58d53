"""Ledger analytics, on events and labels as stand-ins for run logs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators import ledger as G
from textloom.plans.registry import query, table

METRICS = "(select user_id run, event_id step, value, event_type kind from events)"


def _metrics(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value", F.col("event_type").alias("kind"))


@query("arm_summary", f"select kind, count(*) n, round(avg(value), 9) mean, min(value) lo, max(value) hi, round(max(value) - min(value), 9) spread from {METRICS} group by kind")
def arm_summary(spark, d):
    return G.arm_summary(_metrics(spark, d), "kind", "value")


@query("seed_verdict", f"with v as (select kind, run % 5 seed, avg(value) > 60 violates from {METRICS} group by all) select kind, count(*) seeds, case when bool_or(violates) then 'falsified' when count(*) < 5 then 'pending' else 'held' end verdict from v group by kind")
def seed_verdict(spark, d):
    v = _metrics(spark, d).groupBy("kind", (F.col("run") % 5).alias("seed")).agg((F.avg("value") > 60).alias("violates"))
    return G.seed_verdict(v, "kind", 5)


@query("paired_arms", f"with m as (select run, kind, avg(value) v from {METRICS} group by all), p as (select run, max(v) filter (kind = 'click') treatment, max(v) filter (kind = 'view') baseline from m group by run) select run, round(treatment, 9) treatment, round(baseline, 9) baseline, round(treatment - baseline, 9) gain from p")
def paired_arms(spark, d):
    m = _metrics(spark, d).groupBy("run", "kind").agg(F.avg("value").alias("v"))
    p = G.paired(m, "run", "kind", "v", "click", "view")
    return p.withColumn("treatment", F.round("treatment", 9)).withColumn("baseline", F.round("baseline", 9))


@query("interaction", f"with m as (select run % 7 seed, kind, avg(value) v from {METRICS} group by all), p as (select seed, max(v) filter (kind = 'click') c, max(v) filter (kind = 'view') l, max(v) filter (kind = 'purchase') e, max(v) filter (kind = 'login') b from m group by seed) select seed, round(c - l - e + b, 9) interaction from p")
def interaction(spark, d):
    m = _metrics(spark, d).groupBy((F.col("run") % 7).alias("seed"), "kind").agg(F.avg("value").alias("v"))
    p = m.groupBy("seed").pivot("kind", ["click", "view", "purchase", "login"]).agg(F.first("v"))
    return p.select("seed", F.round(F.col("click") - F.col("view") - F.col("purchase") + F.col("login"), 9).alias("interaction"))


@query("consecutive_arms", f"with a as (select run, count(*) steps, avg(value) v from {METRICS} group by run) select run, steps, round(v, 9) mean, round(lead(v) over (order by steps, run) - v, 9) change from a")
def consecutive_arms(spark, d):
    a = _metrics(spark, d).groupBy("run").agg(F.count("*").alias("steps"), F.avg("value").alias("v"))
    w = Window.orderBy("steps", "run")  # over one row an arm
    return a.select("run", "steps", F.round("v", 9).alias("mean"), F.round(F.lead("v").over(w) - F.col("v"), 9).alias("change"))


@query("latest_metric", f"select run, max(step) step, arg_max(value, step) value, arg_min(value, step) first_value, arg_min(step, value) best_step from {METRICS} where value is not null group by run")
def latest_metric(spark, d):
    m = _metrics(spark, d).filter("value is not null")
    return m.groupBy("run").agg(F.max("step").alias("step"), F.max_by("value", "step").alias("value"), F.min_by("value", "step").alias("first_value"), G.least_by("step", "value").alias("best_step"))


@query("last_runs", f"select run, step, kind, rn from (select *, row_number() over (partition by kind order by step desc) rn from {METRICS}) where rn <= 15")
def last_runs(spark, d):
    return G.last_n(_metrics(spark, d), "kind", "step", 15).select("run", "step", "kind", F.col("rn").cast("long").alias("rn"))


@query("step_check", f"with l as (select run, step, row_number() over (partition by run order by value, step) line_no from {METRICS}), b as (select *, lag(step) over (partition by run order by line_no) before from l) select run, step, line_no, before from b where step <= before")
def step_check(spark, d):
    w = Window.partitionBy("run").orderBy("value", "step")
    lines = _metrics(spark, d).withColumn("line_no", F.row_number().over(w).cast("long"))
    return G.increasing(lines, "run", "step").select("run", "step", "line_no", "before")


@query("committed_metrics", f"select run, step, value from {METRICS} where step > 0 and step <= 5000 union all select distinct run, 0, 0.0 from {METRICS}")
def committed_metrics(spark, d):
    m = _metrics(spark, d)
    return m.filter("step > 0 and step <= 5000").select("run", "step", "value").unionByName(m.select("run").distinct().select("run", F.lit(0).cast("long").alias("step"), F.lit(0.0).alias("value")))


@query("bench_ratios", f"with t as (select run, kind, value + 1 as secs from {METRICS} where kind in ('click', 'view')), p as (select run, avg(secs) filter (kind = 'click') cached, avg(secs) filter (kind = 'view') plain from t group by run having count(distinct kind) = 2) select round(median(cached), 9) cached_median, round(median(plain), 9) plain_median, round(median(plain / cached), 9) ratio_median, round(greatest((max(cached) - min(cached)) / median(cached), (max(plain) - min(plain)) / median(plain)), 9) noise from p")
def bench_ratios(spark, d):
    t = _metrics(spark, d).filter("kind in ('click', 'view')").withColumn("seconds", F.col("value") + 1)
    p = t.groupBy("run").pivot("kind", ["click", "view"]).agg(F.avg("seconds")).toDF("run", "cached", "plain").dropna()
    med = lambda c: F.percentile(c, 0.5)
    return p.agg(F.round(med(F.col("cached")), 9).alias("cached_median"), F.round(med(F.col("plain")), 9).alias("plain_median"), F.round(med(F.col("plain") / F.col("cached")), 9).alias("ratio_median"), F.round(F.greatest((F.max("cached") - F.min("cached")) / med(F.col("cached")), (F.max("plain") - F.min("plain")) / med(F.col("plain"))), 9).alias("noise"))


@query("run_digest", "select event_type kind, count(*) n, count(distinct user_id) corpora, min(ts) first_ts, max(ts) last_ts, arg_min(event_id, value) best, count(*) filter (value > 90) untrusted from (select * from events order by event_id) group by event_type")
def run_digest(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("corpora"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), G.least_by("event_id", "value").alias("best"), F.count_if(F.col("value") > 90).alias("untrusted"))


@query("holdout_groups", "with h as (select sha1(lang || (doc_id % 3)) val_sha1, length(text) // 4000 val_chars, doc_id % 4 seed, source from documents) select val_sha1, val_chars, count(*) runs, count(distinct seed) seeds, array_to_string(list_sort(list_distinct(list(source))), ',') corpora from h group by all")
def holdout_groups(spark, d):
    h = table(spark, d, "documents").select(F.sha1(F.concat("lang", (F.col("doc_id") % 3).cast("string"))).alias("val_sha1"), F.floor(F.length("text") / 4000).alias("val_chars"), (F.col("doc_id") % 4).alias("seed"), "source")
    return h.groupBy("val_sha1", "val_chars").agg(F.count("*").alias("runs"), F.count_distinct("seed").alias("seeds"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("corpora"))


@query("provenance_consensus", "select lang, case when count(distinct source) = 1 then min(source) end source, count(distinct source) > 1 arms_disagreed from documents group by lang")
def provenance_consensus(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.count_distinct("source").alias("n"), F.min("source").alias("one"))
    return g.select("lang", F.when(F.col("n") == 1, F.col("one")).alias("source"), (F.col("n") > 1).alias("arms_disagreed"))


@query("artifact_integrity", "with a as (select source k, sha1(string_agg(sha1(text), '' order by doc_id)) digest from documents group by source), r as (select source k, sha1(string_agg(sha1(text), '' order by doc_id)) digest from documents where doc_id <> 5 and source <> 'src3' group by source) select k, a.digest actual, r.digest recorded from a full join r using (k) where a.digest is distinct from r.digest")
def artifact_integrity(spark, d):
    def digests(x):
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.sha1("text").alias("h")))), lambda v: v["h"]), "")
        return x.groupBy(F.col("source").alias("k")).agg(F.sha1(parts).alias("digest"))

    docs = table(spark, d, "documents")
    return G.integrity(digests(docs), digests(docs.filter("doc_id <> 5 and source <> 'src3'")), "k")


@query("mean_vectors", "select label, pos, round(avg(v), 6) mean from (select label, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 pos from embeddings) group by label, pos")
def mean_vectors(spark, d):
    return G.elementwise_mean(table(spark, d, "embeddings"), "label", "embedding").withColumn("pos", F.col("pos").cast("long"))


@query("pair_summary", "select quality, count(*) n, round(avg(case when toxic = 0 then 1.0 else 0.0 end), 9) accuracy, round(avg(greatest(0, 1 - (quality - toxic))), 9) hinge from labels where quality is not null and toxic is not null group by quality")
def pair_summary(spark, d):
    p = table(spark, d, "labels").filter("quality is not null and toxic is not null")
    return p.groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg((F.col("toxic") == 0).cast("double")), 9).alias("accuracy"), F.round(F.avg(F.greatest(F.lit(0), 1 - (F.col("quality") - F.col("toxic"))).cast("double")), 9).alias("hinge"))


@query("trace_scores", "with t as (select doc_id, lang split, string_split(text, ' ') ref, list_transform(string_split(text, ' '), lambda w, i: case when i > 1 + doc_id % 9 then 'x' else w end) gen from documents), s as (select split, len(ref) n, coalesce(list_position(list_transform(list_zip(ref, gen), lambda z: z[1] = z[2]), false) - 1, len(ref)) m, ref = gen exact from t) select split, count(*) examples, round(avg(exact::int), 9) trace_exact, round(sum(m) / nullif(sum(n), 0), 9) line_prefix_accuracy from s group by split")
def trace_scores(spark, d):
    ref = F.split("text", " ", -1)
    gen = F.transform("ref", lambda w, i: F.when(i + 1 > 1 + F.col("doc_id") % 9, "x").otherwise(w))
    t = table(spark, d, "documents").select("doc_id", F.col("lang").alias("split"), ref.alias("ref")).withColumn("gen", gen)
    s = t.select("split", F.size("ref").alias("n"), G.prefix_match(F.col("ref"), F.col("gen")).alias("m"), (F.col("ref") == F.col("gen")).alias("exact"))
    return s.groupBy("split").agg(F.count("*").alias("examples"), F.round(F.avg(F.col("exact").cast("double")), 9).alias("trace_exact"), F.round(F.try_divide(F.sum("m"), F.sum("n")), 9).alias("line_prefix_accuracy"))


@query("patience", """with recursive e as (select user_id run, event_id step, value, row_number() over (partition by user_id order by event_id) i from events where value is not null),
 w as (select distinct run, 0::bigint i, 'inf'::double best, null::bigint best_step, 0 bad, null::bigint stop_step, null::varchar reason from e
 union all select w.run, e.i, case when isfinite(e.value) and e.value < best - 0.5 then e.value else best end, case when isfinite(e.value) and e.value < best - 0.5 then e.step else best_step end, case when isfinite(e.value) and e.value < best - 0.5 then 0 else bad + 1 end,
  case when not isfinite(e.value) or (e.value >= best - 0.5 and bad + 1 >= 5) then e.step end, case when not isfinite(e.value) then 'not finite' when e.value >= best - 0.5 and bad + 1 >= 5 then 'no improvement' end from w join e on e.run = w.run and e.i = w.i + 1 where w.reason is null)
 select run, case when best_step is not null then best end best, best_step, stop_step, reason from w qualify row_number() over (partition by run order by i desc) = 1""")
def patience(spark, d):
    return G.patience(_metrics(spark, d).filter("value is not null"), "run", "step", "value", 5, 0.5)
