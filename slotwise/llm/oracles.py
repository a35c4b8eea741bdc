"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

import re

from slotwise.llm.quality_rules import BOILERPLATE

_WORD = r"[^\x20\x09-\x0D]"
_PHRASES = "|".join(re.escape(p) for p in BOILERPLATE)

QUALITY_RULES = f"""with d as (select doc_id, coalesce(text, '') as t from documents),
 w as (select doc_id, t, regexp_extract_all(t, '{_WORD}+') as ws from d),
 g as (select doc_id, t, ws, len(ws) as n, list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) as g from w),
 tri as (select doc_id, unnest(g) as tri, unnest(range(1, len(g) + 1)) as i from g),
 twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, tri) as c from tri) where c > 1),
 marked as (select doc_id, count(distinct i + j) as n_repeat from twice, (values (0), (1), (2)) s(j) group by doc_id),
 line as (select doc_id, unnest(string_split(t, chr(10))) as l from d),
 lines as (select doc_id, l, regexp_extract_all(l, '{_WORD}+') as lw, strlen(trim(l, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))) as bytes from line where regexp_matches(l, '{_WORD}')),
 judged as (select doc_id, l, bytes,
  (len(lw) >= 8 and not regexp_matches(lw[-1], '[.!?:;"'')\\]}}…”’»。！？“]$'))
  or (len(regexp_extract_all(l, '[|<>]')) >= 3 and 100 * len(regexp_extract_all(l, '[|<>]')) >= 25 * len(lw))
  or (len(lw) >= 4 and 100 * len(regexp_extract_all(l, '[#*$%&!]')) >= 30 * len(lw))
  or regexp_matches(l, '(?i){_PHRASES}') as failed from lines),
 per_line as (select doc_id, count(*) - count(distinct l) as n_dup, count(*) filter (where failed) as n_failed, coalesce(sum(bytes) filter (where failed), 0) as lost, sum(bytes) as total from judged group by doc_id),
 base as (select g.doc_id, n, len(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as symbols, coalesce(n_dup, 0) as n_dup, coalesce(n_repeat, 0) as n_repeat, coalesce(n_failed, 0) as n_failed, coalesce(lost, 0) as lost, coalesce(total, 0) as total
  from g left join per_line using (doc_id) left join marked using (doc_id))
select doc_id, n::bigint as n_words, chars::bigint as word_chars, symbols::bigint as n_symbols, n_dup::bigint as n_dup_lines, n_repeat::bigint as n_repeat_words, n < 50 or 100 * n_repeat > 50 * n as base_failed,
 not (n < 50 or 100 * n_repeat > 50 * n) and 100 * lost <= 30 * total as kept, n_failed::bigint as n_failed_lines, lost::bigint as lost_bytes, total::bigint as total_bytes from base"""

#: Pairs that share a shingle, their similarity, and the least document that links lead to; texts without a word are like their equals.
NEAR_DEDUP = """with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
 g as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
 n as (select doc_id, count(*) as n from g group by doc_id),
 shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
 links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where c::double / (x.n + y.n - c) >= 0.8
  union all select a, b from (select doc_id as b, min(doc_id) over (partition by text) as a from documents where text is not null and not regexp_matches(text, '[^\\x20\\x09-\\x0D]')) where a < b),
 ways as (select a, b from links union select b, a from links),
 reach as (select doc_id as id, doc_id as root from documents union select ways.b, reach.root from reach join ways on ways.a = reach.id)
select id as doc_id, min(root) as class_id from reach group by id"""

#: Every 50-byte window beside the least document that has it; windows joined to spans, and what is left put together.
SUFFIX_DEDUP = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
 p as (select doc_id, unnest(range(n - 49)) as i, h from d where n >= 50),
 w as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from p),
 f as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as m from w) where m < doc_id),
 e as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from f),
 g as (select doc_id, i, sum(new) over (partition by doc_id order by i) as k from e),
 spans as (select doc_id, k, min(i) as a, max(i) + 50 as b from g group by doc_id, k),
 cuts as (select doc_id, k, a, b, coalesce(lag(b) over (partition by doc_id order by k), 0) as before from spans),
 kept as (select c.doc_id, count(*) as n_spans, sum(b - a) as n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by k) || substr(any_value(h), 2 * max(b) + 1) as r from cuts c join d using (doc_id) group by c.doc_id)
select d.doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(r, h))) as kept_sha256 from d left join kept using (doc_id)"""

#: Equal lines that have a word (or 16 characters); of longer ones deletion variants with their places (for substitutions) and spelt out (for insertions).
LINE_DEDUP = f"""with s as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
 l as (select doc_id, unnest(ls) as l, unnest(range(len(ls))) as k from s),
 seen as (select l, min(doc_id * 1000000 + k) as pos from l where length(l) >= 16 or regexp_matches(l, '{_WORD}') group by l),
 big as (select l, pos from seen where length(l) >= 16),
 places as (select l, pos, length(l) as n, unnest(range(length(l))) as p from big),
 v as (select l, pos, n, p, hash(substr(l, 1, p::int) || substr(l, p::int + 2)) as d from places),
 pairs as (select v.l as longer, v.pos as longer_pos, b.l as shorter, b.pos as shorter_pos from v join big b on hash(b.l) = v.d and length(b.l) = v.n - 1),
 near as (select l from (select l, pos, min(pos) over (partition by n, p, d) as m from v) where m < pos union select case when longer_pos > shorter_pos then longer else shorter end from pairs),
 judged as (select l.*, seen.l is not null and (doc_id * 1000000 + k <> seen.pos or near.l is not null) as gone from l left join seen on seen.l = l.l left join near on near.l = l.l),
 kept as (select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, coalesce(string_agg(l, chr(10) order by k) filter (where not gone), '') as t from judged group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, octet_length(encode(coalesce(t, '')))::bigint as kept_bytes, sha256(coalesce(t, '')) as kept_sha256 from documents d left join kept using (doc_id)"""

#: The checksum of an id's digits, bit by bit; pairs of equal words in a period's distance, and their islands of a run's length.
PERIODIC_RUNS = f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}+') as ws from documents),
 steps as (select doc_id, ws, len(ws) as n, cast(doc_id as varchar) as s from d),
 crc as (select doc_id, ws, n, xor(list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(range(1, length(s) + 1), lambda i: list_prepend(1000000 + ascii(substr(s, i::int, 1))::ubigint, [0::ubigint, 0, 0, 0, 0, 0, 0, 0])))),
   lambda c, o: case when o > 0 then xor(c, o - 1000000) when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end), 4294967295::ubigint) as h from steps),
 g as (select doc_id, ws, n, h % 10 = 0 and n > 0 as plant, ((h // 10) % greatest(n, 1))::bigint as a, (h // 10)::bigint as g from crc),
 t as (select doc_id, n, case when plant then list_transform(range(n), lambda i: ws[case when i >= a then a + (i - a) % (1 + (n - a) // (3 + g % 8)) else i end + 1]) else ws end as ws from g),
 w as (select doc_id, n, unnest(range(n)) as i, unnest(ws) as w from t),
 m as (select x.doc_id, y.i - x.i as q, x.i from w x join w y on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i and 4 * (y.i - x.i) <= x.n),
 isl as (select doc_id, q, min(i) as s, count(*) + q as len from (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as k from m) group by doc_id, q, k),
 runs as (select doc_id, s, len, min(q) as p from isl where len >= greatest(6, 4 * q) group by doc_id, s, len),
 best as (select doc_id, count(*) as n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' order by s, p) as t, min(p) as p from runs group by doc_id),
 top as (select * from (select doc_id, s, len, p, row_number() over (partition by doc_id order by len::double / p desc, s, p) as k from runs) where k = 1),
 gone as (select distinct doc_id, unnest(range(s + p, s + len)) as i from runs),
 kept as (select w.doc_id, coalesce(string_agg(w.w, ' ' order by w.i) filter (where gone.i is null), '') as t, count(gone.i) as n_dropped from w left join gone on gone.doc_id = w.doc_id and gone.i = w.i group by w.doc_id)
select t.doc_id, t.n::bigint as n_words, coalesce(n_runs, 0)::bigint as n_runs, s::bigint as start, len::bigint as length, top.p::bigint as period, (1000 * len // top.p)::bigint as exponent_milli,
 sha256(coalesce(best.t, '')) as runs_sha256, sha256(coalesce(kept.t, '')) as collapsed_sha256, coalesce(n_dropped, 0)::bigint as n_dropped
 from t left join best using (doc_id) left join top using (doc_id) left join kept using (doc_id)"""

#: Phrases by neighbouring words of one piece; every cut of a phrase, and every phrase inside a longer one.
COLLOCATIONS = """with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as t from documents),
 w as (select lang, regexp_extract_all(t, '[^\\x20\\x09]+') as ws from p),
 total as (select lang, sum(len(ws))::hugeint as n from w group by lang),
 g as (select lang, m, ws, unnest(range(1, len(ws) - m + 2)) as i from w, (select unnest([1, 2, 3, 4, 5]) as m) where len(ws) >= m),
 f as (select lang, m, array_to_string(ws[i : i + m - 1], ' ') as phrase, count(*) as a from g group by all having count(*) >= 100),
 s as (select lang, m, phrase, a, string_split(phrase, ' ') as ws from f where m > 1),
 cut as (select *, unnest(range(1, m)) as k from s),
 parts as (select lang, m, phrase, a, k, array_to_string(ws[1 : k], ' ') as lp, array_to_string(ws[k + 1 :], ' ') as rp from cut),
 x as (select p.lang, p.phrase, p.a, p.k, l.a as l, r.a as r, n, 1000 * p.a::hugeint * n // (l.a::hugeint * r.a) as score from parts p join f l on l.lang = p.lang and l.phrase = p.lp join f r on r.lang = p.lang and r.phrase = p.rp join total t on t.lang = p.lang),
 best as (select * from x qualify row_number() over (partition by lang, phrase order by score, k) = 1),
 sub as (select lang, ws, a, unnest(range(2, m)) as k, m from s where m > 2),
 inner_ as (select lang, array_to_string(ws[i : i + k - 1], ' ') as phrase, max(a) as longer from (select *, unnest(range(1, m - k + 2)) as i from sub) group by 1, 2),
 left_ as (select b.* from best b left join inner_ i using (lang, phrase) where longer is null or 100 * longer < 100 * b.a),
 ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000"""

ORACLE_SQL = {"op1_quality_rules": QUALITY_RULES, "op5_near_dedup": NEAR_DEDUP, "op7_suffix_dedup": SUFFIX_DEDUP, "op9_line_dedup": LINE_DEDUP, "op12_periodic_runs": PERIODIC_RUNS, "op13_collocations": COLLOCATIONS}
