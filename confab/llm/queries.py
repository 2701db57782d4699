"""The queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, fill_middle, html_text, langid, mixing, pieces, quality, resampling, secrets, simhash, token_binary, warc
from .common import documents


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(documents(spark, sf_dir, "conversations"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(documents(spark, sf_dir), width=4, distance=4)
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(documents(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("key")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir)).drop("key")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_digest(documents(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(~langid.is_held_out()), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return langid.identify(docs, model)


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(documents(spark, sf_dir))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_simhash, op3_html_text, op4_secrets, op5_mixing, op6_quality, op7_warc, op8_decontaminate, op9_token_binary, op10_language_id, op11_pieces, op12_fill_middle, op13_resample)}

_SPACE = r"[ \t\n\x0b\f\r]+"
_ASCII_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_QUALITY = rf"""
with d as (select doc_id, coalesce('=' || source, '-') as host, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^ \t\n\x0b\f\r]+') as ws from d),
win as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w)),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from win where (doc_id, g) in (select doc_id, g from win group by all having count(*) > 1)) group by 1),
raw as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
dup as (select doc_id, count(*) - count(distinct line) as n from raw where regexp_replace(line, '{_SPACE}', '', 'g') <> '' group by 1),
norm as (select doc_id, trim(regexp_replace(translate(translate(line, {_ASCII_LOWER}), '123456789', '000000000'), '{_SPACE}', ' ', 'g')) as line from raw),
ln as (select doc_id, line, count(*) * len(string_split(line, ' ')) as words from norm where line <> '' group by doc_id, line),
hl as (select ln.*, d.host from ln join d using (doc_id)),
id as (select doc_id, string_agg(line, chr(10) order by line) as ident from ln group by 1),
hs as (select host, count(*) as host_docs from d group by 1),
f1 as (select host, line from (select host, line, count(distinct ident) as docs from hl join id using (doc_id) group by all) join hs using (host) where docs >= 10 and docs >= 0.001e0 * host_docs),
held as (select hl.* from hl semi join f1 using (host, line)),
own as (select doc_id, sum(words) as held, string_agg(line, chr(10) order by line) as same from held group by 1),
id2 as (select doc_id, case when len(ws) - held <= 0.05e0 * len(ws) then same else ident end as ident from own join id using (doc_id) join w using (doc_id)),
bad as (select host, line from (select host, line, count(distinct ident) as docs from held join id2 using (doc_id) group by all) join hs using (host) where docs >= 10 and docs >= 0.001e0 * host_docs),
cut as (select doc_id, sum(words)::bigint as n from held semi join bad using (host, line) group by 1),
s as (select w.doc_id, len(ws) as n_words, length(regexp_replace(w.text, '{_SPACE}', '', 'g')) as word_chars, len(regexp_extract_all(w.text, '[#*$%&|<>]')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, coalesce(cut.n, 0) as n_frequent_words
  from w left join dup using (doc_id) left join rep using (doc_id) left join cut using (doc_id))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_words - n_frequent_words >= 0.3e0 * n_words as kept from s
"""

_WARC = """
with p as (select page_id, coalesce(html, '') as html from pages), f as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest, min(page_id) over (partition by sha256(html)) as first from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type, case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f
"""

_CONTAMINATION = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII_LOWER}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as ws from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), {_ASCII_LOWER}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as ws from benchmark),
bw as (select distinct item, least(13, len(ws)) as n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') as g from (select item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as i from b where len(ws) > 0)),
dw as (select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as g from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from bw))),
h as (select doc_id, i, bw.n, item from dw join bw using (g)),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by 1),
k as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from h) group by 1)
select d.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated from d left join c using (doc_id) left join k using (doc_id)
"""

_FILL_MIDDLE = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
u as (select doc_id, text, regexp_extract_all(text, '[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+') as us, cast('0x' || x[1:8] as bigint) as h1, cast('0x' || x[9:16] as bigint) as h2, cast('0x' || x[17:24] as bigint) as h3, cast('0x' || x[25:32] as bigint) as h4 from d),
c as (select doc_id, text, us, len(us) as n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) as a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
p as (select doc_id, text, n, form, array_to_string(us[1:a], '') as pre, array_to_string(us[a + 1:b], '') as mid, array_to_string(us[b + 1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256 from p
"""

#: SQL of the queries that SQL can express; the others rest on hashes, tokenizers, markup or dynamic programmes.
ORACLES: dict[str, str] = {"op6_quality": _QUALITY, "op7_warc": _WARC, "op8_decontaminate": _CONTAMINATION, "op12_fill_middle": _FILL_MIDDLE}
