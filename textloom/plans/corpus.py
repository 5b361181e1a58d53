"""Corpus building: segmentation, dedup, splits, provenance, exclusion rules and counts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import tables
from textloom.functions import text as T
from textloom.operators import dedup, provenance, splits
from textloom.plans.registry import ORACLE_SQL, query, table

S, L = T.RE2_SPACE, T.RE2_LINE
SEED, FRACTION = 1337, 0.1
STRIP = f"regexp_replace(text, '\\A[{S}]+|[{S}]+\\z', '', 'g')"
LINES_OF = f"list_filter(string_split(regexp_replace(text, '{L}', chr(10), 'g'), chr(10)), lambda x, i: i < len(string_split(regexp_replace(text, '{L}', chr(10), 'g'), chr(10))) or x <> '')"
NORM = f"sha256(regexp_replace(array_to_string(list_transform({LINES_OF}, lambda x: regexp_replace(x, '[{S}]+\\z', '')), chr(10)), '\\A[{S}]+|[{S}]+\\z', '', 'g'))"
SPLIT = f"case when substr(sha256('{T.HOLDOUT_SALT}' || chr(0) || '{SEED}' || chr(0) || {STRIP}), 1, 16) < '{T.threshold(FRACTION, 64)}' then 'val' else 'train' end"
SURVIVORS = f"select min(doc_id) doc_id from documents group by sha1({STRIP})"
PATH = "source || '/' || lang || '/' || case when doc_id % 7 = 0 then 'tests' when doc_id % 11 = 0 then 'vendor' else 'lib' end || '/' || case when doc_id % 13 = 0 then 'mbpp_' when doc_id % 5 = 0 then 'test_' else '' end || 'mod' || (doc_id % 50) || '.md'"
REASON = f"""case when list_has_any(string_split(lower(p), '/'), ['vendor','vendored','third_party','third-party','external','fixtures','fixture','testdata','test_data','__pycache__','node_modules','target','_build','build','.lake']) then 'vendored-generated-or-fixture-directory'
 when list_contains(string_split(lower(p), '/'), 'data') and regexp_matches(lower(p), '(^|/)(tests?(/|$)|test_)') then 'test-fixture-data'
 when regexp_matches(p, '(?i)(^|[^A-Za-z0-9])(human[_-]?eval|mbpp|code[_-]?contests|apps)([^A-Za-z0-9]|$)') then 'benchmark-name-in-path' end"""
GENERATED_SQL = provenance.GENERATED.replace("'", "''")
CONTENT_REASON = f"""case when p_reason is not null then p_reason when contains(text, chr(0)) then 'binary-nul' when {STRIP} = '' then 'empty'
 when regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(human[_-]?eval|mbpp|code[_-]?contests|apps)([^A-Za-z0-9]|$)') then 'benchmark-name-in-content'
 when regexp_matches(array_to_string(({LINES_OF})[1:80], chr(10)), '{GENERATED_SQL}') then 'generated-header' end"""


@query("exact_dedup", "select sha1(text) dedup_key, min(doc_id) doc_id, count(*) n_copies from documents group by 1")
def exact_dedup(spark, d):
    return dedup.keep_first(table(spark, d, "documents"), F.sha1("text"))


@query("stripped_dedup", f"select sha1({STRIP}) dedup_key, min(doc_id) doc_id, count(*) n_copies from documents group by 1")
def stripped_dedup(spark, d):
    return dedup.keep_first(table(spark, d, "documents"), F.sha1(T.strip(F.col("text"))))


@query("normalized_dedup", f"""with k as (select doc_id, sha256(text) sha, {NORM} norm from documents), f as (select norm, min(doc_id) first, arg_min(sha, doc_id) first_sha from k group by norm)
select doc_id, doc_id = first included, case when doc_id = first then null when sha = first_sha then 'exact-duplicate' else 'normalized-duplicate' end reason, case when doc_id <> first then first end duplicate_of from k join f using (norm)""")
def normalized_dedup(spark, d):
    return dedup.two_level(table(spark, d, "documents"), F.col("text"))


@query("normalized_hash", f"select doc_id, {NORM} normalized_sha256 from documents")
def normalized_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalized_hash(F.col("text")).alias("normalized_sha256"))


@query("text_counts", f"select doc_id, length(text) char_count, strlen(text) byte_count, len({LINES_OF}) line_count, sha256(text) sha256 from documents")
def text_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("char_count"), F.octet_length(t).cast("long").alias("byte_count"), F.size(T.lines(t)).cast("long").alias("line_count"), F.sha2(t, 256).alias("sha256"))


@query("min_length_filter", f"select doc_id, length(text) n from documents where length(text) >= 200 and {STRIP} <> ''")
def min_length_filter(spark, d):
    return table(spark, d, "documents").filter((F.length("text") >= 200) & (T.strip(F.col("text")) != "")).select("doc_id", F.length("text").cast("long").alias("n"))


BROKEN = "case when doc_id % 3 = 0 then replace(text, '. ', '.' || chr(10) || chr(10) || '# file: ') else replace(text, '. ', '.' || chr(10) || chr(10)) end"


@query("segment_documents", f"with b as (select doc_id, {BROKEN} t from documents), s as (select doc_id, unnest(case when contains(t, chr(10) || chr(10) || '# file: ') then list_transform(string_split(t, chr(10) || chr(10) || '# file: '), lambda x, i: case when i > 1 then '# file: ' || x else x end) else string_split(t, chr(10) || chr(10)) end) doc from b) select doc_id, count(*) n_docs, cast(sum(length(doc)) as bigint) n_chars from s where regexp_replace(doc, '[{S}]+', '', 'g') <> '' group by doc_id")
def segment_documents(spark, d):
    """Sentences stand for the documents of a joined text: set apart by markers in a third of the rows, by blank lines in the others."""
    gap = F.when(F.col("doc_id") % 3 == 0, ".\n\n# file: ").otherwise(".\n\n")
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(". "), gap).alias("text"))
    return splits.segments(docs, "text").groupBy("doc_id").agg(F.count("*").alias("n_docs"), F.sum(F.length("doc")).alias("n_chars"))


@query("segment_table", ORACLE_SQL["segment_documents"])
def segment_table(spark, d):
    """The same by the table function, from SQL."""
    tables.register(spark)
    gap = F.when(F.col("doc_id") % 3 == 0, ".\n\n# file: ").otherwise(".\n\n")
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(". "), gap).alias("text"))
    return spark.sql("select doc_id, count(*) n_docs, sum(length(doc)) n_chars from segments(table({docs}), 'text') group by doc_id", docs=docs)


@query("hash_split", f"with u as ({SURVIVORS}) select doc_id, {SPLIT} split from documents join u using (doc_id)")
def hash_split(spark, d):
    return splits.hash_split(table(spark, d, "documents"), SEED, FRACTION).select("doc_id", "split")


@query("tool_sample", f"select doc_id, substr(sha256('{T.TOOL_SALT}' || chr(0) || '7' || chr(0) || " + STRIP + f"), 1, 16) < '{T.threshold(0.5, 64)}' uses_tool from documents")
def tool_sample(spark, d):
    return table(spark, d, "documents").select("doc_id", (T.holdout_digest(F.col("text"), 7, T.TOOL_SALT) < T.threshold(0.5, 64)).alias("uses_tool"))


@query("group_split_source", f"select source, count(*) n_docs, case when sha256('{SEED}' || chr(0) || source) < '{T.threshold(0.25, 256)}' then 'validation' else 'train' end split from documents group by source")
def group_split_source(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_docs")).withColumn("split", T.group_split(F.col("source"), SEED, 0.25))


@query("positional_split", f"with r as (select doc_id, length(text) n, coalesce(sum(length(text)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) before, sum(length(text)) over () total from documents) select doc_id, cast(greatest(0, least(n, floor(total * {1 - FRACTION}) - before)) as bigint) train_chars, cast(n - greatest(0, least(n, floor(total * {1 - FRACTION}) - before)) as bigint) val_chars from r")
def positional_split(spark, d):
    return splits.positional(table(spark, d, "documents"), FRACTION)


@query("cross_split_overlap", f"with s as (select lang, case when sha256('{SEED}' || chr(0) || source) < '{T.threshold(0.25, 256)}' then 'validation' else 'train' end split, {NORM} h from documents) select h normalized_sha256, count(distinct split) n_splits from s group by h having count(distinct split) > 1")
def cross_split_overlap(spark, d):
    s = table(spark, d, "documents").select(T.group_split(F.col("source"), SEED, 0.25).alias("split"), T.normalized_hash(F.col("text")).alias("normalized_sha256"))
    return s.groupBy("normalized_sha256").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


@query("path_reasons", f"with x as (select doc_id, {PATH} p from documents) select doc_id, p as path, {REASON} reason from x")
def path_reasons(spark, d):
    return provenance.with_paths(table(spark, d, "documents")).select("doc_id", "path", provenance.path_exclusion(F.col("path")).alias("reason"))


@query("reason_cascade", f"with x as (select doc_id, text, {PATH} p from documents), y as (select *, {REASON} p_reason from x) select doc_id, {CONTENT_REASON} reason, {CONTENT_REASON} is null included from y")
def reason_cascade(spark, d):
    r = provenance.inspect(provenance.with_paths(table(spark, d, "documents")))
    return r.select("doc_id", "reason", "included")


@query("reason_histogram", f"with x as (select doc_id, text, {PATH} p from documents), y as (select *, {REASON} p_reason from x) select coalesce({CONTENT_REASON}, 'included') reason, count(*) n, cast(sum(strlen(text)) as bigint) bytes from y group by 1")
def reason_histogram(spark, d):
    r = provenance.inspect(provenance.with_paths(table(spark, d, "documents")))
    return r.groupBy(F.coalesce("reason", F.lit("included")).alias("reason")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query("source_counts", f"select source, lang, grouping(source) g_source, grouping(lang) g_lang, count(*) n, cast(sum(strlen(text)) as bigint) bytes, count(distinct sha1(text)) n_distinct from documents group by grouping sets ((source), (lang), ())")
def source_counts(spark, d):
    x = table(spark, d, "documents").select("source", "lang", F.octet_length("text").alias("b"), F.sha1("text").alias("h"))
    g = x.groupingSets([[F.col("source")], [F.col("lang")], []], "source", "lang")
    return g.agg(F.grouping("source").cast("long").alias("g_source"), F.grouping("lang").cast("long").alias("g_lang"), F.count("*").alias("n"), F.sum("b").alias("bytes"), F.count_distinct("h").alias("n_distinct"))


@query("split_totals", f"with s as (select source, strlen(text) b, case when sha256('{SEED}' || chr(0) || source) < '{T.threshold(0.25, 256)}' then 'validation' else 'train' end split from documents) select split, count(*) n_docs, count(distinct source) n_groups, cast(sum(b) as bigint) bytes, round(sum(b) / sum(sum(b)) over (), 9) byte_fraction from s group by split")
def split_totals(spark, d):
    s = table(spark, d, "documents").select("source", F.octet_length("text").alias("b"), T.group_split(F.col("source"), SEED, 0.25).alias("split"))
    g = s.groupBy("split").agg(F.count("*").alias("n_docs"), F.count_distinct("source").alias("n_groups"), F.sum("b").alias("bytes"))
    return g.withColumn("byte_fraction", F.round(F.col("bytes") / F.sum("bytes").over(Window.partitionBy(F.lit(0))), 9))


@query("module_family", f"with x as (select doc_id, {PATH} p from documents), y as (select doc_id, p, regexp_replace(regexp_replace(string_split(p, '/')[-1], '\\.[^.]*$', ''), '^(mbpp_|test_)', '') stem from x) select doc_id, p as path, string_split(p, '/')[1] || ':' || stem family, case when list_contains(string_split(p, '/'), 'tests') then 'test' else 'documentation' end kind from y")
def module_family(spark, d):
    x = provenance.with_paths(table(spark, d, "documents"))
    return x.select("doc_id", "path", provenance.family(F.col("path")).alias("family"), provenance.kind(F.col("path")).alias("kind"))


@query("license_ancestors", f"with x as (select doc_id, {PATH} p from documents), l(dir, license) as (values ('', 'root'), ('src1', 'mit'), ('src2/en', 'bsd'), ('src0', 'apache'), ('src0/fr', 'mpl')) select doc_id, string_agg(license, ',' order by dir) licenses from x join l on dir = '' or starts_with(p, dir || '/') group by doc_id")
def license_ancestors(spark, d):
    licenses = spark.createDataFrame([("", "root"), ("src1", "mit"), ("src2/en", "bsd"), ("src0", "apache"), ("src0/fr", "mpl")], "dir string, license string")
    return provenance.ancestor_licenses(provenance.with_paths(table(spark, d, "documents")), licenses)


@query("spdx_identifiers", "select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, 'SPDX-License-Identifier:[ \\t\\r\\n\\f]*([^\\r\\n]+)', 1))), '|') spdx from documents where contains(text, 'SPDX-License-Identifier:')")
def spdx_identifiers(spark, d):
    ids = F.regexp_extract_all("text", F.lit("SPDX-License-Identifier:[ \\t\\r\\n\\f]*([^\\r\\n]+)"), F.lit(1))
    return table(spark, d, "documents").filter(F.col("text").contains("SPDX-License-Identifier:")).select("doc_id", F.array_join(F.array_sort(F.array_distinct(ids)), "|").alias("spdx"))


@query("quoted_urls", f"with x as (select doc_id, {PATH} p from documents) select doc_id, 'https://example.org/blob/main/' || replace(replace(url_encode(p || ' é+'), '%2F', '/'), '+', '%20') url from x")
def quoted_urls(spark, d):
    x = provenance.with_paths(table(spark, d, "documents"))
    return x.select("doc_id", F.concat(F.lit("https://example.org/blob/main/"), T.quoted_path(F.concat("path", F.lit(" é+")))).alias("url"))


@query("corpus_fingerprint", "select cast(sum(length(text)) + 2 * (count(*) - 1) as bigint) chars, (select count(distinct ch) from (select unnest(string_split(text, '')) ch from documents) where ch <> '') vocab, substr(sha1(string_agg(sha1(text), '' order by doc_id)), 1, 12) digest from documents")
def corpus_fingerprint(spark, d):
    return splits.fingerprint(table(spark, d, "documents"))


@query("split_health", None)
def split_health(spark, d):
    return splits.health(table(spark, d, "documents"), FRACTION, SEED)


@query("order_split", None)
def order_split(spark, d):
    return splits.order_split(table(spark, d, "documents"), FRACTION, SEED)


@query("stratified_windows", "with t as (select doc_id, length(text) n, coalesce(sum(length(text)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) before, sum(length(text)) over () total from documents), e as (select i, (select max(total) from t) * i // 10 a, (select max(total) from t) * (i + 1) // 10 b from range(10) r(i)), w as (select i, a + ('0x' || substr(md5('7:' || i), 1, 8))::bigint % greatest(1, b - a) p from e) select cast(i as bigint) stratum, cast(p as bigint) start, t.doc_id from w join t on p >= before and p < before + n")
def stratified_windows(spark, d):
    return splits.stratified(table(spark, d, "documents"), 10, 7)


@query("weighted_draws", "with t as (select doc_id, length(text) n, coalesce(sum(length(text)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) before, sum(length(text)) over () total from documents), w as (select i, ('0x' || substr(md5('7:' || i), 1, 8))::bigint % (select max(total) from t) u from range(64) r(i)) select i draw, doc_id, cast(u - before as bigint) as \"offset\" from w join t on u >= before and u < before + n")
def weighted_draws(spark, d):
    return splits.weighted_draws(table(spark, d, "documents"), 64, 7)
