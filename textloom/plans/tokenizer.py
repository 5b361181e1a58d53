"""Tokenizers learned on the training side."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import pyarrow.compute as pc

from textloom.operators import bpefit, pieces, splits
from textloom.plans.corpus import FRACTION, SEED, SPLIT, SURVIVORS
from textloom.plans.registry import query, table
from textloom.sources.scratch import Scratch

SIZE = 288
_W = "\\x09-\\x0d\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_WORD = f"''s|''t|''re|''ve|''m|''ll|''d| ?\\pL+| ?\\pN+| ?[^{_W}\\pL\\pN]+|[{_W}]+"
#: All words with their counts on the training side; each step replaces the most frequent pair. RE2 looks at nothing ahead, so the last blank before a word is parted first.
_GROWN = f"""with recursive u as ({SURVIVORS}), side as (select doc_id, text, {SPLIT} = 'train' and doc_id in (select doc_id from u) as train from documents),
 part as (select doc_id, train, unnest(string_split(regexp_replace(text, '([{_W}])([{_W}][^{_W}])', '\\1' || chr(57344) || '\\2', 'g'), chr(57344))) p from side),
 word as (select doc_id, train, unnest(regexp_extract_all(p, '{_WORD}')) w from part),
 start as (select w, count(*) filter (train) n, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || hex(encode(w))[2 * i + 1:2 * i + 2])::int) s from word group by w),
 r(step, w, n, s, a, b) as (
  select 0, w, n, list_transform(s, lambda b: case when b between 33 and 126 then b - 33 when b between 161 and 172 then b - 67 when b >= 174 then b - 68 when b <= 32 then b + 188 when b <= 160 then b + 94 else 255 end), -1, -1 from start
  union all
  select r.step + 1, r.w, r.n, list_reduce(list_transform(r.s, lambda x: [x]), lambda acc, x: case when acc[-1] = m.a and x[1] = m.b then acc[:-2] || [256 + r.step] else acc || x end), m.a, m.b
  from r cross join (select s[i] a, s[i + 1] b, sum(n) c from (select s, n, unnest(range(1, len(s))) i from r) group by all having sum(n) >= 2 order by c desc, a, b limit 1) m where r.step < {SIZE} - 256)"""


def _train(spark, d, scratch):
    """The training side's texts, kept: learning reads them more than once."""
    train = splits.hash_split(table(spark, d, "documents"), SEED, FRACTION).filter("split = 'train'").select("text")
    return scratch.keep(train, "train")


@query("bpe_merges", f"{_GROWN} select step - 1 place, any_value(a) left_id, any_value(b) right_id from r where step > 0 group by step")
def bpe_merges(spark, d):
    """The merges of a tokenizer of the training side, in order."""
    scratch = Scratch(spark, "bpe")
    merges = bpefit.fit(_train(spark, d, scratch), scratch, SIZE)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "place int, left_id int, right_id int")


@query("fitted_tokens", f"{_GROWN}, last as (select w, len(s) k from r where step = (select max(step) from r)), n as (select doc_id, sum(k) n_tokens from word join last using (w) group by doc_id) select doc_id, coalesce(n_tokens, 0)::bigint n_tokens, sha1(text) decoded_sha1 from documents left join n using (doc_id)")
def fitted_tokens(spark, d):
    """Every text, held-out ones too, encoded by the training side's tokenizer and decoded again."""
    scratch = Scratch(spark, "bpe")
    payload = bpefit.fit_tokenizer(_train(spark, d, scratch), scratch, SIZE)
    backend = json.dumps(payload["backend"])

    def run(batches):
        encoder = bpefit.Encoder(backend)
        for batch in batches:
            at = 0
            for texts in pieces.shares(batch.column(1)):
                n, other = encoder.texts(texts)
                digests = pa.array([hashlib.sha1(other.get(k, t.as_buffer())).hexdigest() for k, t in enumerate(texts)], pa.string())
                missing = batch.column(1).slice(at, len(n)).is_null()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(n), pc.if_else(missing, None, digests)], names=["doc_id", "n_tokens", "decoded_sha1"])
                at += len(n)

    return table(spark, d, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, decoded_sha1 string")
