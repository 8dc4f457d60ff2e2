"""The queries of this subpackage: thin uses of the operators, with production
parameters, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_mixing, op2_licenses, op3_quality, op4_linededup, op5_secrets, op6_neardup, op7_warc, op8_html, op9_decontamination, op10_sharding, op11_conversations, op12_fill_in_middle, op13_packing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1")
    out = op3_quality.quality_rules(_table(spark, sf_dir, "documents"), trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op4_linededup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = op4_linededup.classify_lines(_table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "line_no", "kept", F.col("keeper.doc_id").alias("keeper_doc_id"), F.col("keeper.line_no").alias("keeper_line_no"))


def op5_secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_secrets.secret_digest(op5_secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op6_neardup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_neardup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op7_warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = op7_warc.capture_histories(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op8_html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_html.extract_pages(_table(spark, sf_dir, "pages"))


def op9_decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = op9_decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "matched", "n_windows", "coverage", "changed_slots")


def op10_sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op10_sharding.shard_rows(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_conversations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_conversations.repair_damaged(_table(spark, sf_dir, "conversations"))


def op12_fill_in_middle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = op12_fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    restored = op12_fill_in_middle.restore(F.col("form"), F.col("output"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op13_packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 tells of every document beside the model's verdict."""
    return op3_quality_query(spark, sf_dir).drop("kept", "llr")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that op5 finds by its patterns."""
    return op5_secrets_query(spark, sf_dir).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing_query,
    "op2_licenses": op2_licenses_query,
    "op3_quality": op3_quality_query,
    "op4_linededup": op4_linededup_query,
    "op5_secrets": op5_secrets_query,
    "op6_neardup": op6_neardup_query,
    "op7_warc": op7_warc_query,
    "op8_html": op8_html_query,
    "op9_decontamination": op9_decontamination_query,
    "op10_sharding": op10_sharding_query,
    "op11_conversations": op11_conversations_query,
    "op12_fill_in_middle": op12_fill_in_middle_query,
    "op13_packing": op13_packing_query,
    "quality_base": quality_base,
    "secret_base": secret_base,
}

_ASSIGN = op5_secrets.ASSIGN.replace("'", "''")
#: Matches of a pattern and the gaps between them give the places, in code points.
_PLACED = " union all ".join(
    f"select r, {k} as kind, string_split_regex(text, '{rx}') as gaps, regexp_extract_all(text, '{rx}') as found, regexp_extract_all(text, '{rx}', {group}) as sized from d where regexp_matches(text, '{rx}')"
    for k, (rx, group) in enumerate(((_ASSIGN, 2), ("AKIA[A-Z0-9]+", 0), ("[0-9a-f]+", 0)))
)

#: CRC-32 of an ASCII text, bit by bit.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({}, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _edited(state: str, cost: str, edits: str) -> str:
    """Ways are texts of nine digits of cost and the audit, so the least is the cheapest."""
    return f"(lpad((left({state}, 9)::bigint + {cost})::varchar, 9, '0') || substr({state}, 10) || '{edits}')"


def _inserted(s: str, u: str, a: str, e: str) -> list[str]:
    """The four states' ways with insertions after them."""
    e, s = e or "null", s or "null"
    to_user = [u, _edited(e, "2", "I"), _edited(s, "2", "I"), _edited(a, "2", "I")]
    to_assistant = [a, _edited(u, "2", "I"), _edited(e, "4", "II"), _edited(s, "4", "II")]
    return [e, s, f"least({', '.join(to_user)})", f"least({', '.join(to_assistant)})"]


def _turned() -> list[str]:
    """The states' ways (e, s, u, a) after one more turn (role initial i, must: to be deleted, t: truncated)."""
    kept = lambda state, i: f"case when i = '{i}' and not must then {_edited(state, 't', 'K')} end"
    put = lambda state: f"case when not must then {_edited(state, '2 + t', 'R')} end"
    gone = lambda state: _edited(state, "3", "D")
    return [
        gone("e"),
        f"least({gone('s')}, {kept('e', 's')})",
        f"least({gone('u')}, {', '.join(f(x) for x in 'esa' for f in (lambda x: kept(x, 'u'), put))})",
        f"least({gone('a')}, {kept('u', 'a')}, {put('u')})",
    ]


_AFTER = _inserted("s", "u", "a", "e")

#: Where SQL can say it.  The others rest on 64-bit hashes, trained weights or
#: verified candidate search, and are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5('17|' || coalesce(doc_id::varchar, '~') || '|' || coalesce(source, '~') || '|' || coalesce(text, '~')), 1, 15))::bigint as key from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
w as (select *, [5.0, 2.0, 1.0][rank % 3 + 1]::double as weight, 3.0::double * source_size as cap from s),
r as (select *, coalesce(sum(cap) over before, 0)::double as cap_before, sum(weight) over () - coalesce(sum(weight) over before, 0) as weight_left, (sum(source_size) over ())::double as total from w
  window before as (order by cap / weight, rank rows between unbounded preceding and 1 preceding)),
l as (select *, (total - cap_before) / weight_left as level, (total - cap_before) / weight_left > cap / weight as stops from r),
t as (select source, source_size, least(cap, case when stops then cap else weight * (select arg_min(level, (cap / weight, rank)) from l where not stops) end) as target from l),
p as (select d.*, t.source_size, t.target, floor(t.target + 0.5)::bigint as budget, coalesce(sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join t on d.source is not distinct from t.source),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from p)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::bigint as taken from e""",
    "op7_warc": r"""
with p as (select page_id, coalesce(html, '') as html, regexp_replace(regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:www\.)?', ''), '#.*$', '') as bare from pages),
d as (select *, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1 having count(*) > 1)
select page_id, payload_bytes, payload_digest, case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to,
  array_to_string(list_reverse(string_split(regexp_extract(bare, '^[^/?:]*'), '.')), ',') || ')' || regexp_replace(bare, '^[^/?:]*(?::\d+)?', '') as url_key,
  strftime(make_timestamp((1704067200 + page_id % 31536000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as captured
from d left join f using (payload_digest)""",
    "op11_conversations": rf"""
with recursive d as (select *, {_CRC32.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as fault from conversations),
f as (select conv_id, turn, case when fault = 4 then 'user' else coalesce(role, ' ') end as role,
    case when fault = 1 then '' when fault = 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text from d, range(case when fault = 3 then 2 else 1 end) where fault <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, left(role, 1) as i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from f),
j as (select *, case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, text order by k) > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else 'none' end as fault,
    k > 1 and coalesce(lag(i) over (partition by conv_id order by k), '') || i not in ('su', 'ua', 'au') as bad from o),
t as (select *, fault in ('blank', 'duplicate') as must, (fault = 'truncated')::int as t from j),
w as (select distinct conv_id, 0::bigint as k, '000000000' as e, null::varchar as s, '000000002I' as u, '000000004II' as a from t
  union all select conv_id, k, {", ".join(f"{x} as {c}" for c, x in zip("esua", _AFTER, strict=True))} from (
    select w.conv_id, t.k, {", ".join(f"{x} as {c}" for c, x in zip("esua", _turned(), strict=True))} from w join t on t.conv_id is not distinct from w.conv_id and t.k = w.k + 1)),
z as (select conv_id, left(least(e, a), 9)::bigint as cost, substr(least(e, a), 10) as audit from (select *, row_number() over (partition by conv_id order by k desc) as last from w) where last = 1),
c as (select conv_id, unnest(string_split(audit, '')) as edit, generate_subscripts(string_split(audit, ''), 1) as p from z where audit <> ''),
e as (select *, count(*) filter (edit <> 'I') over up - case when edit = 'I' then 0 else 1 end + 1 as k, count(*) filter (edit <> 'D') over up as emitted from c window up as (partition by conv_id order by p)),
r as (select e.*, t.role, t.text, t.i, max(case when emitted = 1 and edit = 'K' and i = 's' then 1 else 0 end) over (partition by e.conv_id) as headed from e left join t on t.conv_id is not distinct from e.conv_id and t.k = e.k),
l as (select conv_id, sha256(string_agg(case edit when 'K' then role else case when (emitted - headed) % 2 = 1 then 'user' else 'assistant' end end || ':' || case edit when 'I' then '' else text end, chr(10) order by p)) as repaired_sha256 from r where edit <> 'D' group by conv_id),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (bad) as illegal from t group by conv_id)
select x.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) x left join g on g.conv_id is not distinct from x.conv_id left join z on z.conv_id is not distinct from x.conv_id left join l on l.conv_id is not distinct from x.conv_id""",
    "op12_fill_in_middle": r"""
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
h as (select *, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substring(text, 1, a) as prefix, substring(text, a + 1, b - a) as middle, substring(text, b + 1) as suffix from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256 from p""",
    "quality_base": r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
wd as (select r, unnest(w) as word, generate_subscripts(w, 1) as i from d),
h as (select r, i, word || ' ' || lead(word, 1) over p || ' ' || lead(word, 2) over p || ' ' || lead(word, 3) over p || ' ' || lead(word, 4) over p || ' ' || lead(word, 5) over p || ' ' || lead(word, 6) over p || ' ' || lead(word, 7) over p as x
  from wd window p as (partition by r order by i)),
rep as (select r, i from (select *, count(*) over (partition by r, x) as n from h where x is not null) where n > 1),
cov as (select r, count(*) as n from (select distinct r, i + k as j from rep, range(8) t(k)) group by r),
ln as (select r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d)
select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, len(w) < 20 or 100 * coalesce(n, 0) > 30 * len(w) as base_failed
from d join ln using (r) left join cov using (r)""",
    "secret_base": f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
f as (select *, unnest(range(1, len(found) + 1)) as i from ({_PLACED})),
s as (select r, kind, length(sized[i]) as size, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0))::bigint as start, length(found[i]) as n from f),
k as (select r, kind, start, start + n as stop from s where size >= [12, 18, 16][kind + 1]),
g as (select r, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as b, count(*) filter (kind = 2) as c, string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || start || ':' || stop, ',' order by start, kind) as spans from k group by r)
select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256 from d left join g using (r)""",
}
