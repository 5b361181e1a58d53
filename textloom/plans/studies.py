"""Queries on studies, identities and schedules; events, labels and documents stand in for run records."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import studies as U
from textloom.plans.registry import query, table


@query("source_registry", "select source as name, 'https://example.org/' || source url, cast(sum(strlen(text)) as bigint) bytes, sha256(string_agg(lang, ',' order by lang)) seal from (select source, lang, string_agg(text, '' order by doc_id) as text from documents group by source, lang) group by source")
def source_registry(spark, d):
    """The sources of a corpus with their addresses, sizes and a seal of their languages."""
    g = table(spark, d, "documents").groupBy("source", "lang").agg(F.sum(F.octet_length("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("bytes"), F.array_sort(F.collect_list("lang")).alias("langs"))
    return g.select(F.col("source").alias("name"), F.concat(F.lit("https://example.org/"), "source").alias("url"), "bytes", F.sha2(F.array_join("langs", ","), 256).alias("seal"))


@query("selected_paths", "with s(source, dir, suffix) as (values ('src1', 'en', '.md'), ('src2', 'fr', '.md')), x as (select doc_id, source, lang || '/f' || doc_id || case when doc_id % 2 = 0 then '.md' else '.txt' end path from documents) select doc_id from x where exists (select 1 from s where s.source = x.source and split_part(path, '/', 1) = dir and ends_with(path, suffix))")
def selected_paths(spark, d):
    scope = spark.createDataFrame([("src1", "en", ".md"), ("src2", "fr", ".md")], "source string, dir string, suffix string")
    x = table(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("dir"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt").alias("suffix"))
    return x.join(F.broadcast(scope), ["source", "dir", "suffix"], "left_semi").select("doc_id")


@query("study_issues", "with r as (select doc_id, quality, toxic from labels), x as (select doc_id, concat_ws(',', case when not coalesce(doc_id % 9 <> 0, false) then 'budget' end, case when not coalesce(quality = 1, false) then 'quality' end, case when not coalesce(toxic = 0, false) then 'toxic' end) issues from r) select doc_id, issues from x where issues <> ''")
def study_issues(spark, d):
    r = U.issues(table(spark, d, "labels"), {"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 0, "budget": F.col("doc_id") % 9 != 0})
    return r.filter("issues <> ''").select("doc_id", "issues")


@query("signature_mismatch", "with a as (select source, count(*) > 5 big, count(distinct lang) langs from documents group by source), f as (select arg_min(big, source) b, arg_min(langs, source) l from a) select source, 'big' field from a, f where big is distinct from b union all select source, 'langs' from a, f where langs is distinct from l")
def signature_mismatch(spark, d):
    a = table(spark, d, "documents").groupBy("source").agg((F.count("*") > 5).alias("big"), F.count_distinct("lang").alias("langs"))
    return U.differs_from_first(a, "source", ["big", "langs"])


@query("incomplete_arms", "with arms as (select s.seed, a.arm from (select unnest(range(3)) seed) s, (values ('a'), ('b'), ('c'), ('d')) a(arm)), scores as (select doc_id % 3 seed, chr(97 + (doc_id % 4)::int) arm, count(*) n from labels where doc_id % 12 <> 7 group by all) select cast(seed as bigint) seed, string_agg(arm, ',' order by arm) missing from arms left join scores using (seed, arm) where n is null group by seed")
def incomplete_arms(spark, d):
    arms = spark.range(3).toDF("seed").crossJoin(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "arm string"))  # twelve rows
    scores = table(spark, d, "labels").filter("doc_id % 12 <> 7").groupBy((F.col("doc_id") % 3).alias("seed"), F.element_at(F.array(*(F.lit(x) for x in "abcd")), (F.col("doc_id") % 4).cast("int") + 1).alias("arm")).agg(F.count("*").alias("n"))
    return arms.join(scores, ["seed", "arm"], "left_anti").groupBy("seed").agg(F.array_join(F.array_sort(F.collect_list("arm")), ",").alias("missing"))


@query("learning_rates", "select event_id, round(case when s < 10 then 0.003 * (s + 1) / 10 when s >= 100 then 0.0003 else 0.0003 + 0.5 * 0.0027 * (1 + cos(pi() * (s - 10) / 90.0)) end, 12) lr from (select event_id, event_id % 120 s from events)")
def learning_rates(spark, d):
    """The rate at each logged step of runs of 120 steps."""
    return table(spark, d, "events").select("event_id", F.round(U.cosine_rate(F.col("event_id") % 120, 0.003, 0.0003, 10, 100), 12).alias("lr"))


@query("agreement", "with t as (select doc_id, string_split(text, ' ') a, list_transform(string_split(text, ' '), lambda w, i: case when i % (2 + doc_id % 30) = 0 then 'x' else w end) b from documents), s as (select doc_id, list_transform(list_zip(a, b), lambda z: z[1] = z[2]) same from t) select doc_id, len(list_filter(same, lambda x: x)) agree, coalesce(list_position(same, false) - 1, len(same)) first_difference from s")
def agreement(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.split("text", " ", -1).alias("a"))
    t = t.withColumn("b", F.transform("a", lambda w, i: F.when((i + 1) % (2 + F.col("doc_id") % 30) == 0, "x").otherwise(w)))
    n, first = U.agreement(F.col("a"), F.col("b"))
    return t.select("doc_id", n.alias("agree"), first.alias("first_difference"))


@query("mean_logprob", "select conv_id, round(sum(-ln(1 + turn)), 9) logprob_sum, round(avg(-ln(1 + turn)), 9) mean_logprob from conversations group by conv_id")
def mean_logprob(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(-F.ln(1 + F.col("turn"))).alias("lp"))
    total = F.aggregate("lp", F.lit(0.0), lambda s, x: s + x)
    return g.select("conv_id", F.round(total, 9).alias("logprob_sum"), F.round(F.try_divide(total, F.size("lp")), 9).alias("mean_logprob"))


@query("key_difference", "with a as (select distinct lang k from documents where source = 'src1'), b as (select distinct lang k from documents where source <> 'src1' and lang <> 'es') select coalesce(a.k, b.k) k, case when b.k is null then 'left' else 'right' end side from a full join b on a.k = b.k where a.k is null or b.k is null")
def key_difference(spark, d):
    docs = table(spark, d, "documents")
    a = docs.filter("source = 'src1'").select(F.col("lang").alias("k")).distinct().withColumn("l", F.lit(True))
    b = docs.filter("source <> 'src1' and lang <> 'es'").select(F.col("lang").alias("k")).distinct().withColumn("r", F.lit(True))
    return a.join(b, "k", "full").filter("l is null or r is null").select("k", F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


@query("top_devices", "select vec_id, label from embeddings order by label desc, vec_id limit 4")
def top_devices(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label").orderBy(F.desc("label"), "vec_id").limit(4)


@query("version_tuples", "select event_id, array_to_string(list_transform(regexp_extract_all('driver ' || strftime(ts, '%Y-%m-%d') || '.0' || user_id || ' x', '[0-9]+'), lambda x: x::int), ',') parts from events")
def version_tuples(spark, d):
    """Numbers of a dotted or dashed name, as integers."""
    name = F.concat(F.lit("driver "), F.date_format("ts", "yyyy-MM-dd"), F.lit(".0"), F.col("user_id").cast("string"), F.lit(" x"))
    parts = F.transform(F.regexp_extract_all(name, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int").cast("string"))
    return table(spark, d, "events").select("event_id", F.array_join(parts, ",").alias("parts"))


@query("order_identity", "select source, sha256(string_agg(doc_id, ',' order by sha256('9:' || doc_id))) digest from documents group by source")
def order_identity(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct(F.sha2(F.concat(F.lit("9:"), F.col("doc_id").cast("string")), 256).alias("h"), F.col("doc_id").cast("string").alias("i")))).alias("xs"))
    return g.select("source", F.sha2(F.array_join(F.transform("xs", lambda x: x["i"]), ","), 256).alias("digest"))


@query("mixed_batches", "with t as (select doc_id, (row_number() over (order by doc_id) - 1) // 6 batch from documents where lang = 'en'), r as (select doc_id, (row_number() over (order by doc_id) - 1) // 2 batch from documents where lang = 'fr') select doc_id, 'target' origin, batch from t union all select doc_id, 'replay', batch from r")
def mixed_batches(spark, d):
    docs = table(spark, d, "documents")
    return U.mixed(docs.filter("lang = 'en'").select("doc_id"), docs.filter("lang = 'fr'").select("doc_id"), "doc_id", 8, 0.25)
