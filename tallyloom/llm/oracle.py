"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import re
import string

from tallyloom.llm.license_scan import TEMPLATES, LicenseParams

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4 = f"""
with it as (select item_id, w, least(10, len(w)) m from (select item_id, {_WORDS} w from benchmark) where len(w) > 0),
iw as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') g from it, unnest(range(1, len(w) - m + 2)) t(i)),
dd as (select doc_id, {_WORDS} w from documents),
dw as (select doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') g from dd, (select distinct m from it), unnest(range(1, len(w) - m + 2)) t(i)),
h as (select doc_id, i, m, item_id from dw join iw using (m, g)),
p as (select doc_id, count(distinct pos) n_hit from (select doc_id, unnest(range(i, i + m)) pos from h) group by doc_id),
n as (select doc_id, count(*) n, string_agg(s, ',' order by s) s from (select distinct doc_id, item_id::varchar s from h) group by doc_id)
select dd.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n.n, 0) n_items, sha256(coalesce(n.s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dd left join p using (doc_id) left join n using (doc_id)"""


def op9(p: LicenseParams = LicenseParams()) -> str:
    rows = []
    for i, (label, text) in enumerate(TEMPLATES):
        ws = re.findall("[a-z0-9]+", text.lower())
        n = len(ws) - p.k + 1
        rows += [f"({i}, '{label}', {n}, {q}, '{' '.join(ws[q : q + p.k])}')" for q in range(n)]
    return f"""
with d as (select doc_id, {_WORDS} w from documents),
g as (select doc_id, i pos, array_to_string(w[i + 1:i + {p.k}], ' ') gram from d, unnest(range(0, len(w) - {p.k} + 1)) t(i)),
t(template, label, t_grams, q, gram) as (values {', '.join(rows)}),
b as (select doc_id, template, label, t_grams, pos - q diag, bit_or(1::bigint << q) places, min(pos) f, max(pos) l from g join t using (gram) group by all),
s as (select *, sum(fresh) over (partition by doc_id, template order by diag) run from (select *, case when diag - lag(diag) over (partition by doc_id, template order by diag) <= {p.slack} then 0 else 1 end fresh from b)),
r as (select *, cov >= {p.coverage} and l - f + 1 <= (t_grams + {p.k} - 1) * {1 + p.stretch} + {p.slack} ok from (select doc_id, template, label, t_grams, run, bit_count(bit_or(places)) / t_grams::double cov, min(f) f, max(l) + {p.k} - 1 l from s group by doc_id, template, label, t_grams, run)),
o as (select distinct a.doc_id, a.template, a.run from r a join r b on a.doc_id = b.doc_id and a.ok and b.ok and a.label <> b.label and a.cov < b.cov and a.f <= b.l and b.f <= a.l),
m as (select doc_id, max(cov) score, list(label) filter (where ok and hit is null) ls from r left join (select *, true hit from o) o using (doc_id, template, run) group by doc_id),
x as (select doc_id, i - case when label = 'gpl' then 3 else 2 end start, label from (select doc_id, i, case when w[i - 1] = 'mit' then 'mit' when w[i - 1] = 'apache' then 'apache' when w[i - 1] = 'public' and w[i - 2] = 'general' then 'gpl' end label
  from d, unnest(range(2, len(w) + 1)) t(i) where w[i] = 'license') where label is not null),
a as (select doc_id, count(*) n, min(start) f, max(start) l, list(label) ls from x group by doc_id),
e as (select d.doc_id, len(w)::bigint n_words, coalesce(a.n, 0) n_base, a.f first_word, a.l last_word, coalesce(a.ls, []) bl, coalesce(m.ls, []) ml, coalesce(score, 0)::double score from d left join a using (doc_id) left join m using (doc_id))
select doc_id, n_words, n_base, first_word, last_word, array_to_string(list_sort(list_distinct(bl)), ',') base_labels, array_to_string(list_sort(list_distinct(list_concat(bl, ml))), ',') labels, score from e"""


ORACLE_SQL = {"op4_decontaminate": OP4, "op9_license_scan": op9()}
