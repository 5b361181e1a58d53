"""Character statistics and n-gram baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import ngrams as N
from textloom.plans.corpus import FRACTION, SEED, SPLIT, SURVIVORS
from textloom.plans.registry import ORACLE_SQL, query, table

CHARS = "select unnest(string_split(text, '')) ch from documents"
SIDED = f"u as ({SURVIVORS}), sided as (select doc_id, text, {SPLIT} split from documents join u using (doc_id))"
GRAMS = "select substr(text, cast(i as bigint), 3) gram from (select text, unnest(range(1, length(text) - 1)) i from sided where split = '{}')"


@query("char_histogram", f"select ch, count(*) n from ({CHARS}) where ch <> '' group by ch")
def char_histogram(spark, d):
    return N.characters(table(spark, d, "documents"))


@query("vocab_rare", f"with h as (select ch, count(*) n from ({CHARS}) where ch <> '' group by ch) select count(*) vocab, count(*) filter (n < 10) rare, case when count(*) > 300 and count(*) filter (n < 10) > 0 then 'rare' else 'fine' end word from h")
def vocab_rare(spark, d):
    h = N.characters(table(spark, d, "documents"))
    one = h.agg(F.count("*").alias("vocab"), F.count_if(F.col("n") < 10).alias("rare"))
    return one.withColumn("word", F.when((F.col("vocab") > 300) & (F.col("rare") > 0), "rare").otherwise("fine"))


@query("char_vocabulary", f"select ch, row_number() over (order by ch) - 1 id from (select distinct ch from ({CHARS}) where ch <> '')")
def char_vocabulary(spark, d):
    return N.vocabulary(table(spark, d, "documents"))


@query("ngram_counts", "select substr(text, cast(i as bigint), 3) gram, count(*) n from (select text, unnest(range(1, length(text) - 1)) i from documents) group by 1")
def ngram_counts(spark, d):
    return N.grams(table(spark, d, "documents"), 3)


@query("ngram_context", "select substr(text, cast(i as bigint), 2) ctx, count(*) d from (select text, unnest(range(1, length(text) - 1)) i from documents) group by 1")
def ngram_context(spark, d):
    return N.contexts(N.grams(table(spark, d, "documents"), 3), 3)


@query("ngram_baseline", f"""with {SIDED}, v as (select count(distinct ch) v from (select unnest(string_split(text, '')) ch from sided) where ch <> ''),
tc as (select ch, count(*) n from (select unnest(string_split(text, '')) ch from sided where split = 'train') where ch <> '' group by ch),
vc as (select ch, count(*) m from (select unnest(string_split(text, '')) ch from sided where split = 'val') where ch <> '' group by ch),
tg as (select gram, count(*) n from ({GRAMS.format('train')}) group by gram), vg as (select gram, count(*) m from ({GRAMS.format('val')}) group by gram),
cx as (select substr(gram, 1, 2) ctx, sum(n) d from tg group by 1),
r as (select 'uniform' model, ln(v) nats from v union all
select 'frequency', -sum(m * ln((coalesce(n, 0) + 1.0) / ((select sum(n) from tc) + v))) / sum(m) from vc left join tc using (ch), v union all
select '3-gram', -sum(m * ln((coalesce(n, 0) + 1.0) / (coalesce(d, 0) + v))) / sum(m) from vg left join tg using (gram) left join cx on substr(vg.gram, 1, 2) = cx.ctx, v)
select model, round(nats, 9) nats, round(nats / ln(2.0), 9) bits, round(exp(nats), 7) choices from r""")
def ngram_baseline(spark, d):
    return N.baselines(table(spark, d, "documents"), SEED, FRACTION)


@query("unknown_chars", "with vocab as (select distinct ch from (select unnest(string_split(text, '')) ch from documents where lang = 'en') where ch <> ''), x as (select doc_id, unnest(string_split(text, '')) ch, generate_subscripts(string_split(text, ''), 1) - 1 pos from documents) select doc_id, ch, count(*) n, min(pos) first_pos from x where ch <> '' and ch not in (select ch from vocab) group by all")
def unknown_chars(spark, d):
    docs = table(spark, d, "documents")
    return N.unknown_characters(docs, N.vocabulary(docs.filter("lang = 'en'")))


@query("validation_coverage", f"with {SIDED}, c as (select split, unnest(string_split(text, '')) ch from sided) select distinct ch from c where split = 'val' and ch <> '' and ch not in (select ch from c where split = 'train')")
def validation_coverage(spark, d):
    from textloom.operators.splits import hash_split

    s = hash_split(table(spark, d, "documents"), SEED, FRACTION)
    side = lambda x: s.filter(F.col("split") == x).select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).filter("ch <> ''").distinct()
    return side("val").join(side("train"), "ch", "left_anti")


@query("closed_fraction", f"with b as ({ORACLE_SQL['ngram_baseline']}), w as (select max(nats) filter (model = 'uniform') u, max(nats) filter (model = '3-gram') t from b) select model, nats, u baseline, case when model = 'uniform' then u else t end floor, case when model <> 'uniform' and u > t then round((u - nats) / (u - t), 9) end closed, case when model = 'uniform' or u <= t then 'no distance to close' end reason from b, w")
def closed_fraction(spark, d):
    """How far each baseline goes from the uniform one to the best; the uniform one has nowhere to go."""
    b = N.baselines(table(spark, d, "documents"), SEED, FRACTION).select("model", "nats")
    w = b.agg(F.max(F.when(F.col("model") == "uniform", F.col("nats"))).alias("baseline"), F.max(F.when(F.col("model") == "3-gram", F.col("nats"))).alias("best"))  # one row
    rows = b.crossJoin(w).select("model", "nats", "baseline", F.when(F.col("model") == "uniform", F.col("baseline")).otherwise(F.col("best")).alias("floor"))
    return N.closed_fraction(rows)
