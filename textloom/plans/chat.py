"""Conversation data: head lines, examples, truncation, gates and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans.registry import query, table


@query("conversation_summary", "select count(distinct conv_id) conversations, count(*) turns, count(*) filter (role = 'assistant') answers, count(*) filter (role = 'system') systems, max(turn) last_turn, cast(sum(length(text)) as bigint) chars from conversations")
def conversation_summary(spark, d):
    c = table(spark, d, "conversations")
    return c.agg(F.count_distinct("conv_id").alias("conversations"), F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.count_if(F.col("role") == "system").alias("systems"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


@query("conversation_parts", "select conv_id, string_agg(role || ':' || length(text), ',' order by turn) shape from conversations group by conv_id")
def conversation_parts(spark, d):
    """Turns of a conversation as one array of (role, text) parts, here shown by their lengths."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(parts.alias("parts"))
    return g.select("conv_id", F.array_join(F.transform("parts", lambda p: F.concat(p["role"], F.lit(":"), F.length(p["text"]).cast("string"))), ",").alias("shape"))


@query("head_split", "with l as (select doc_id, string_split('Problem: ' || doc_id || chr(10) || 'Signature: f' || chr(10) || text, chr(10)) ls from documents), h as (select doc_id, ls, coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '^(Problem|Signature|Example):')), false) - 1, len(ls)) n from l) select doc_id, n n_head, length(array_to_string(ls[n + 1:], chr(10))) body_chars from h")
def head_split(spark, d):
    whole = F.concat(F.lit("Problem: "), F.col("doc_id").cast("string"), F.lit("\nSignature: f\n"), F.col("text"))
    x = table(spark, d, "documents").select("doc_id", F.split(whole, "\n", -1).alias("ls"))
    is_head = F.transform("ls", lambda v: v.rlike("^(Problem|Signature|Example):"))
    x = x.withColumn("n", F.when(F.array_position(is_head, False) > 0, F.array_position(is_head, False) - 1).otherwise(F.size("ls").cast("long")))
    body = F.array_join(F.slice("ls", F.col("n").cast("int") + 1, F.size("ls")), "\n")
    return x.select("doc_id", F.col("n").alias("n_head"), F.length(body).cast("long").alias("body_chars"))


@query("example_lines", "with t as (select conv_id, turn, 'Example: f(' || conv_id || ', [' || turn || ']) == ' || (conv_id + turn) || chr(10) || text as doc from conversations), e as (select conv_id, turn, regexp_extract_all(doc, '(?m)^Example: ([a-z_]+)\\((.*)\\) == (.*)$', 1) f, regexp_extract_all(doc, '(?m)^Example: ([a-z_]+)\\((.*)\\) == (.*)$', 2) a, regexp_extract_all(doc, '(?m)^Example: ([a-z_]+)\\((.*)\\) == (.*)$', 3) r from t) select conv_id, turn, f[1] fn, a[1] args, r[1] expected, not json_valid('[' || a[1] || ']') error from e where len(f) > 0")
def example_lines(spark, d):
    doc = F.concat(F.lit("Example: f("), F.col("conv_id").cast("string"), F.lit(", ["), F.col("turn").cast("string"), F.lit("]) == "), (F.col("conv_id") + F.col("turn")).cast("string"), F.lit("\n"), F.col("text"))
    pattern = F.lit("(?m)^Example: ([a-z_]+)\\((.*)\\) == (.*)$")
    x = table(spark, d, "conversations").withColumn("doc", doc)
    e = x.select("conv_id", "turn", *(F.get(F.regexp_extract_all("doc", pattern, F.lit(i)), F.lit(0)).alias(n) for i, n in ((1, "fn"), (2, "args"), (3, "expected")))).filter("fn is not null")
    return e.withColumn("error", F.try_parse_json(F.concat(F.lit("["), "args", F.lit("]"))).isNull())


@query("spec_headers", f"""with c as (select conv_id, turn, substr(text, 1, 200) || chr(10) || case when turn % 3 = 0 then 'x t ' || turn else 't ' || turn || ' ' end || chr(10) || 'requires ' || conv_id || case when turn % 2 = 0 then chr(10) || 'Example: f(1) == 2' else '' end || chr(10) || substr(text, 1, 80) || case when turn % 4 = 1 then chr(10) || 't 9' || chr(10) || 'Example:' else '' end as context from conversations)
 select conv_id, turn, nullif(regexp_extract(context, '{T.SPEC_HEADER}', 1), '') header from c""")
def spec_headers(spark, d):
    turn, text, line = F.col("turn").cast("string"), F.col("text"), F.lit("\n")
    head = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("x t "), turn)).otherwise(F.concat(F.lit("t "), turn, F.lit(" ")))
    example = F.when(F.col("turn") % 2 == 0, "\nExample: f(1) == 2").otherwise("")
    again = F.when(F.col("turn") % 4 == 1, "\nt 9\nExample:").otherwise("")
    context = F.concat(F.substring(text, 1, 200), line, head, line, F.lit("requires "), F.col("conv_id").cast("string"), example, line, F.substring(text, 1, 80), again)
    return table(spark, d, "conversations").select("conv_id", "turn", T.spec_header(context).alias("header"))


@query("truncate_completion", "select conv_id, turn, sha1(case when contains(text, '.') then substr(text, 1, instr(text, '.')) else text end) cut from conversations")
def truncate_completion(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha1(T.truncate_after(F.col("text"), ".")).alias("cut"))


@query("short_text", "select conv_id, turn, substr(regexp_replace(regexp_replace(text, '\\A[" + T.RE2_SPACE + "]+|[" + T.RE2_SPACE + "]+\\z', '', 'g'), '[" + T.RE2_SPACE + "]+', ' ', 'g'), 1, 160) short from conversations")
def short_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.shorten(F.col("text")).alias("short"))


@query("heldout_gate", "with ids as (select distinct item_id from benchmark), m as (select doc_id, unnest(regexp_extract_all(text, '[0-9]+')) id from documents) select distinct doc_id from m where try_cast(id as bigint) in (select item_id from ids)")
def heldout_gate(spark, d):
    """Documents that name a held-out id: the mentions are exploded and semi-joined, whatever the number of ids."""
    ids = table(spark, d, "benchmark").select(F.col("item_id").alias("id")).distinct()
    m = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("m"))
    return m.select("doc_id", F.col("m").try_cast("bigint").alias("id")).join(ids, "id", "left_semi").select("doc_id").distinct()


@query("corpus_containment", "select item_id, exists (select 1 from documents d where contains(d.text, b.text)) contained from benchmark b")
def corpus_containment(spark, d):
    """Whether each pair text lies in the corpus: all pairs of a block are looked for in one pass over each document."""
    items = table(spark, d, "benchmark")
    hit = contained(items.select("item_id", "text"), table(spark, d, "documents").select("text")).withColumn("hit", F.lit(True))
    return items.select("item_id").join(hit, "item_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("contained"))


def contained(items: DataFrame, docs: DataFrame, block: int = 1_000_000) -> DataFrame:
    """(item_id) of the items (item_id, text) whose text occurs in a document.

    Items are read in blocks of ``block`` characters; a block's texts make one automaton, so a document is read once
    a block, whatever their number.
    """
    import ahocorasick

    def matched(part: list[tuple[int, str]]) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(part)  # a block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine, ids = ahocorasick.Automaton(), {}
            for i, t in held.value:
                ids.setdefault(t, []).append(i)
            for t in ids:
                if t:
                    machine.add_word(t, t)
            machine.make_automaton()
            for batch in batches:
                texts = {t for x in batch.column(0) if x.as_py() is not None for _, t in (machine.iter(x.as_py()) if len(machine) else ())}
                if batch.num_rows and "" in ids:
                    texts.add("")
                yield pa.RecordBatch.from_arrays([pa.array([i for t in texts for i in ids[t]], pa.int64())], names=["item_id"])

        return docs.mapInArrow(run, "item_id long").distinct()

    found, now, size = docs.sparkSession.createDataFrame([], "item_id long"), [], 0
    for r in items.filter("text is not null").toLocalIterator():
        now.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size > block:
            found, now, size = found.unionByName(matched(now)), [], 0
    return (found.unionByName(matched(now)) if now else found).distinct()
