"""Leakage of the benchmark (as validation) into the documents (as training)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.text import RE2_SPACE as S
from textloom.operators import leakage as K
from textloom.operators import splits
from textloom.plans.corpus import FRACTION, NORM, SEED, SPLIT, SURVIVORS
from textloom.plans.registry import query, table
from textloom.sources.scratch import Scratch


def winnow_sql(source: str, key: str) -> str:
    return f"""(with g as (select {key} k, i, substr(md5(substr(text, cast(i as bigint), 50)), 1, 16) g, length(text) - 49 n from (select {key}, text, unnest(range(1, length(text) - 48)) i from {source} where length(text) >= 50 and regexp_replace(text, '[{S}]+', '', 'g') <> '')),
 w as (select k, i, n, min(g) over (partition by k order by i rows between 24 preceding and current row) h from g)
 select distinct k, h from w where n >= 25 and i >= 25 union select distinct k, g from g where n < 25 union select {key}, substr(md5(text), 1, 16) from {source} where length(text) < 50 and regexp_replace(text, '[{S}]+', '', 'g') <> '')"""


LINES = "(select unnest(string_split(text, chr(10))) line from {})"
SCAN = f"""select * from (select count(*) val_docs, count(*) filter (text in (select text from documents)) val_docs_in_train from benchmark),
 (select count(*) val_lines, count(*) filter (line in (select line from {LINES.format('documents')})) val_lines_in_train from {LINES.format('benchmark')} where regexp_replace(line, '[{S}]+', '', 'g') <> ''),
 (select count(*) val_shingles, count(*) filter (h in (select h from {winnow_sql('documents', 'doc_id')})) val_shingles_in_train from (select distinct h from {winnow_sql('benchmark', 'item_id')}))"""


def _sides(spark, d):
    return table(spark, d, "documents").withColumn("_k", F.col("doc_id")), table(spark, d, "benchmark").withColumn("_k", F.col("item_id"))


@query("winnow_fingerprints", f"select k as doc_id, h from {winnow_sql('documents', 'doc_id')}")
def winnow_fingerprints(spark, d):
    return K.fingerprints(table(spark, d, "documents"), "doc_id")


@query("leak_documents", "select item_id, text in (select text from documents) hit from benchmark")
def leak_documents(spark, d):
    train = table(spark, d, "documents").select(F.sha2("text", 256).alias("h")).distinct().withColumn("hit", F.lit(True))
    val = table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("h"))
    return val.join(train, "h", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("leak_lines", f"select line, count(*) n from {LINES.format('benchmark')} where regexp_replace(line, '[{S}]+', '', 'g') <> '' and line in (select line from {LINES.format('documents')}) group by line")
def leak_lines(spark, d):
    train, val = _sides(spark, d)
    from textloom.functions.text import strip

    return K.lines_of(val).filter(strip(F.col("line")) != "").join(K.lines_of(train).distinct(), "line", "left_semi").groupBy("line").agg(F.count("*").alias("n"))


@query("leak_content", f"select v.k as item_id, count(*) n, count(*) filter (v.h in (select h from {winnow_sql('documents', 'doc_id')})) n_in_train from {winnow_sql('benchmark', 'item_id')} v group by v.k")
def leak_content(spark, d):
    train, val = _sides(spark, d)
    own = K.fingerprints(val, "item_id")
    marked = K.met(own, K.fingerprints(train, "_k"), K.small(val)).withColumn("hit", F.lit(True))
    return own.join(marked, "h", "left").groupBy("item_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("hit", F.lit(False))).alias("n_in_train"))


@query("leak_verdict", f"""with s as ({SCAN}), f as (select *, round(val_docs_in_train / greatest(val_docs, 1), 9) doc_frac, round(val_lines_in_train / greatest(val_lines, 1), 9) line_frac, round(val_shingles_in_train / greatest(val_shingles, 1), 9) content_frac from s),
 r as (select *, case when content_frac >= .2 then 2 when content_frac >= .05 then 1 else 0 end c, case when doc_frac >= .1 then 2 when doc_frac >= .01 then 1 else 0 end o, case when val_lines >= 20 or (val_lines >= 3 and line_frac >= .9) then case when line_frac >= .9 then 2 when line_frac >= .5 then 1 else 0 end end l from f)
 select val_docs, val_docs_in_train, val_lines, val_lines_in_train, val_shingles, val_shingles_in_train, doc_frac, line_frac, content_frac, ['CLEAN', 'SUSPECT', 'CONTAMINATED'][greatest(c, o, l) + 1] verdict,
 concat_ws(',', case when c = greatest(c, o, l) and c > 0 then 'content' end, case when o = greatest(c, o, l) and o > 0 then 'documents' end, case when l = greatest(c, o, l) and l > 0 then 'lines' end) deciding, greatest(c, o, l) = 0 trustworthy from r""")
def leak_verdict(spark, d):
    return K.verdict(K.scan(*_sides(spark, d)))


#: Each corpus (lang, source): its sides by hash, how near the held-out share comes to the request, and normalized texts on both sides.
ELIGIBILITY = f"""with u as ({SURVIVORS}), h as (select doc_id, lang, source, text, {SPLIT} split, {NORM} norm, length(text) n from documents join u using (doc_id)),
 c as (select lang, source, coalesce(sum(n) filter (split = 'val'), 0)::bigint val_chars, sum(n) total, max(n) top, count(*) filter (split = 'val') docs from h group by lang, source),
 m as (select v.lang, v.source, count(*) met from h v where split = 'val' and exists (select 1 from h t where t.split = 'train' and t.lang = v.lang and t.source = v.source and t.norm = v.norm) group by all),
 f as (select c.*, val_chars / total achieved, 1 - top / total reach, coalesce(met, 0) / greatest(docs, 1) leak from c left join m using (lang, source)),
 v as (select *, case when val_chars = 0 then 'empty' when achieved >= {FRACTION} * 0.8 - 1e-9 then null when least(reach, {FRACTION}) < {FRACTION} * 0.8 - 1e-9 then 'corpus' else 'splitter' end split_verdict, case when leak >= .1 then 'CONTAMINATED' when leak >= .01 then 'SUSPECT' else 'CLEAN' end leak_verdict from f)
 select lang, source, val_chars, split_verdict, leak_verdict, case when val_chars = 0 then 'no held-out text' when split_verdict is not null then 'split: ' || split_verdict when leak_verdict <> 'CLEAN' then 'leakage: ' || leak_verdict end reason from v"""


@query("holdout_eligibility", f"select *, reason is null eligible from ({ELIGIBILITY})")
def holdout_eligibility(spark, d):
    """What stands first against a claim on each corpus's held-out side: no text, the split, or leakage."""
    h = splits.hash_split(table(spark, d, "documents"), SEED, FRACTION).select("lang", "source", "split", T.normalized_hash(F.col("text")).alias("norm"), F.length("text").alias("n"))
    h = Scratch(spark, "holdout").keep(h, "narrow")  # read three times; the split and the hash of lines cost more than its writing
    val, of = F.col("split") == "val", ["lang", "source"]
    c = h.groupBy(*of).agg(F.coalesce(F.sum(F.when(val, F.col("n"))), F.lit(0)).alias("val_chars"), F.sum("n").alias("total"), F.max("n").alias("top"), F.count_if(val).alias("docs"))
    met = h.filter(val).join(h.filter(~val).select(*of, "norm").distinct(), [*of, "norm"], "left_semi").groupBy(*of).agg(F.count("*").alias("met"))
    f = c.join(met, of, "left").select(*of, "val_chars", F.lit(FRACTION).alias("requested_val_frac"), (F.col("val_chars") / F.col("total")).alias("achieved_val_frac"), F.least(1 - F.col("top") / F.col("total"), F.lit(FRACTION)).alias("achievable_val_frac"), (F.coalesce("met", F.lit(0)) / F.greatest("docs", F.lit(1))).alias("leak"))
    v = splits.with_verdict(f).withColumnRenamed("verdict", "split_verdict").withColumn("leak_verdict", K.call(F.col("leak"), "documents"))
    return K.eligibility(v.select(*of, "val_chars", "split_verdict", "leak_verdict"))
