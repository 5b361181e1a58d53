"""Reading, cleaning and judging raw text and pages."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import bpe, scripts
from textloom.plans.registry import query, table
from textloom.sources import files
from textloom.streaming import metrics

S = T.RE2_SPACE
TIDY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\v]+', ' ', 'g'), '[ \\f\\v]*\\n[ \\f\\v]*', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query("tidy_text", f"select page_id, sha1(regexp_replace({TIDY.format('html')}, '\\A[{S}]+|[{S}]+\\z', '', 'g')) tidy_sha from pages")
def tidy_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha1(T.tidy(F.col("html"))).alias("tidy_sha"))


@query("html_text", None)
def html_text(spark, d):
    pages = table(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return files.read_binary(pages).select("path", "text", "kind", "encoding", "dropped", "word")


@query("readable_text", "select doc_id, coalesce(length(text), 0) > 0 and not contains(text, chr(0)) and 1 - length(regexp_replace(text, '[^\\pC\\pZ]|[ \\n\\r\\t]', '', 'g')) / length(text) >= 0.9 readable from documents")
def readable_text(spark, d):
    bad = F.regexp_count("text", F.lit("[\\p{C}\\p{Z}&&[^ \\n\\r\\t]]"))
    full = F.coalesce(F.length("text"), F.lit(0)) > 0
    return table(spark, d, "documents").select("doc_id", F.when(full, ~F.col("text").contains("\0") & ((1 - bad / F.length("text")) >= 0.9)).otherwise(False).alias("readable"))


@query("accent_gate", "with p as (select doc_id, text, length(text) n, ceil(length(text) / ceil(length(text) / 512.0))::bigint step from documents where length(text) > 0), c as (select doc_id, substr(text, cast(i * step + 1 as bigint), step) part from (select *, unnest(range(0, ceil(n / step)::bigint)) i from p)), s as (select doc_id, length(regexp_replace(part, '[^\\pL]', '', 'g')) letters, length(regexp_replace(part, '[^" + T.accent_class("\\x{{{:x}}}") + "]', '', 'g')) accented from c) select doc_id, count(*) filter (letters >= 8) judged, count(*) filter (letters >= 8 and accented / letters >= 0.35) tripped, round(coalesce(max(accented / letters) filter (letters >= 8), 0), 9) worst from s group by doc_id union all select doc_id, 0, 0, 0.0 from documents where coalesce(length(text), 0) = 0")
def accent_gate(spark, d):
    """Letters are looked up in a table by code point and summed by chunk, beside the text."""
    return files.accent_rows(table(spark, d, "documents"))


@query("size_verdict", "select doc_id, case when n = 0 then 'empty' when n > 268435456 then 'too big' when n > 33554432 then 'large' else 'fits' end verdict, case when n < 1024 then n || ' bytes' when n < 1048576 then n // 1024 || ' KB' else n // 1048576 || ' MB' end words from (select doc_id, strlen(text) n from documents)")
def size_verdict(spark, d):
    n = F.octet_length("text")
    return table(spark, d, "documents").select("doc_id", files.size_verdict(n).alias("verdict"), T.size_words(n).alias("words"))


@query("cut_at_blank", "with j as (select source, string_agg(text, chr(10) || chr(10) order by doc_id) t from documents group by source), h as (select source, t, substr(t, 1, 20000) h from j), r as (select *, instr(reverse(h), chr(10) || chr(10)) p from h) select source, length(case when length(t) <= 20000 then t when p > 0 and length(h) - p - 1 > 10000 then substr(h, 1, length(h) - p - 1) else h end) n from r")
def cut_at_blank(spark, d):
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n\n")
    j = table(spark, d, "documents").groupBy("source").agg(parts.alias("t"))
    return j.select("source", F.length(T.cut_at_blank_line(F.col("t"), 20000)).cast("long").alias("n"))


@query("scripts_in_text", "with r(system, lo, hi, prio) as (values " + ", ".join(f"('{n}', {lo}, {hi}, {i})" for i, (n, lo, hi) in enumerate(scripts.FLAT)) + "), x as (select doc_id, unnest(string_split(text, '')) ch, generate_subscripts(string_split(text, ''), 1) - 1 pos from documents), c as (select doc_id, unicode(ch) cp, min(pos) pos from x where ch <> '' and unicode(ch) > 127 group by all), n as (select doc_id, cp, pos, coalesce(arg_min(system, prio), 'U+' || lpad(upper(to_hex(cp)), 4, '0')) system from c left join r on cp between lo and hi group by doc_id, cp, pos) select doc_id, system, count(*) n_chars, min(pos) first_pos from n group by doc_id, system")
def scripts_in_text(spark, d):
    return scripts.systems(table(spark, d, "documents"), "doc_id")


@query("ascii_fold", None)
def ascii_fold(spark, d):
    """NFKD folding to ASCII; Spark has no normalisation function, so it runs in Arrow batches."""
    # fixed values
    fold = str.maketrans({"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "―": "-", "−": "-", "…": "...", "\u00a0": " ", "•": "*", "·": "*", "′": "'", "″": '"', "\ufeff": ""})

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            plain = unicodedata.normalize("NFKD", t.translate(fold))
            return "".join(c if c in "\n\t" or " " <= c <= "~" else " " if c.isspace() else "" for c in plain)

        return texts.map(one)

    return table(spark, d, "documents").select("doc_id", folded("text").alias("folded"))


@query("decode_ladder", f"""with x as (select doc_id, text t, coalesce(length(text), 0) > 0 and not contains(text, chr(0)) and 1 - length(regexp_replace(text, '[^\\pC\\pZ]|[ \\n\\r\\t]', '', 'g')) / length(text) >= 0.9 ok, regexp_replace(coalesce(text, ''), '[{S}]+', '', 'g') <> '' words from documents)
 select doc_id || '.txt' path, case when ok and words then sha1(t) end text_sha, case when ok and words then 'text' else 'refused' end kind, case when ok and words then ['utf-8', 'utf-16', 'utf-8-sig'][doc_id % 3 + 1] end encoding, case when t is null or (t = '' and doc_id % 3 <> 2) then 'empty' when not ok then 'not text' when not words then 'no words' else 'read' end word from x""")
def decode_ladder(spark, d):
    """Texts in several encodings, read back: UTF-8, UTF-16 with a mark, Latin-1 bytes."""
    x = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-8")).when(F.col("doc_id") % 3 == 1, F.encode("text", "UTF-16")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).alias("content"))
    return files.read_binary(x).select("path", F.sha1("text").alias("text_sha"), "kind", "encoding", "word")


@query("strip_header", "select doc_id, sha1(regexp_replace(substr(t, instr(t, '***' || chr(10)) + 4, instr(t, '*** END OF') - instr(t, '***' || chr(10)) - 4), '\\A[" + S + "]+|[" + S + "]+\\z', '', 'g')) body from (select doc_id, 'head *** START OF THIS ***' || chr(10) || replace(text, '*', '+') || chr(10) || '*** END OF THIS ***' t from documents)")
def strip_header(spark, d):
    t = F.concat(F.lit("head *** START OF THIS ***\n"), F.translate("text", "*", "+"), F.lit("\n*** END OF THIS ***"))
    begin, end = F.instr("t", "***\n") + 4, F.instr("t", "*** END OF")
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.sha1(T.strip(F.substring(F.col("t"), begin, end - begin))).alias("body"))


@query("bpe_tokens", None)
def bpe_tokens(spark, d):
    import public_tokenizers

    return bpe.encode(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", F.size("ids").alias("n_tokens"))


@query("daily_events", "select date_trunc('day', ts)::timestamp start, event_type, count(*) n, round(sum(value), 6) total from events group by all")
def daily_events(spark, d):
    """The batch twin of the windowed stream."""
    out = metrics.windowed(table(spark, d, "events"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
