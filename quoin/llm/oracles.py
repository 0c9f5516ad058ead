"""DuckDB SQL for the queries that SQL can express, from the contracts and not from the operators."""

from __future__ import annotations

from .rules import LEVELS, RULES
from .warc import OP5_SQL

WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


def _level() -> str:
    over = [f"len(list_filter([{', '.join(map(str, grid))}]::double[], lambda c: c < {value}))" for value, grid in RULES.values()]
    return f"{LEVELS} - greatest({', '.join(over)})"


def quality_rules(alpha: float = 0.03, delta: float = 0.05) -> str:
    return f"""
with t as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text, {WORDS.format("coalesce(text, '')")} as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) as lines from documents),
  g as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from t)),
  r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where n > 1) group by doc_id),
  c as (select t.doc_id, stratum, text, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
    len(regexp_extract_all(text, '[A-Z]')) as n_capitals, len(regexp_extract_all(text, '[!?]')) as n_marks, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words from t left join r on t.doc_id = r.doc_id),
  f as (select *, {_level()} as level, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c),
  k as (select doc_id, min(quality) as quality from labels where quality in (0, 1) group by doc_id),
  x as (select stratum, text, min(quality) as quality, min(level) as level from f join k on f.doc_id = k.doc_id where not base_failed group by stratum, text),
  m as (select greatest(1, count(distinct stratum)) as m from x),
  q as (select stratum, k, count(*) filter (where quality = 1) as n, count(*) filter (where quality = 1 and level <= k) as good, count(*) filter (where quality = 0 and level <= k) as bad from x, (select unnest(range(0, {LEVELS})) as k) group by stratum, k),
  u as (select *, n = 0 or good > n * {alpha} or list_sum(list_transform(range(0, good + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha})))) > {delta} / m as fails from q, m),
  p as (select *, max(fails::int) over (partition by stratum order by k) as failed from u),
  h as (select stratum, first(k order by good - bad, k) as chosen from p where failed = 0 and bad > good group by stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(level <= chosen, false) as kept from f left join h on f.stratum = h.stratum"""


COMPONENTS = """reach as (select a as node, a as root from links union select l.b, r.root from reach r join links l on r.node = l.a),
  comp as (select node, min(root) as root from reach group by node)"""


def ngram_join(n: int = 4, percent: int = 85) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with recursive w as (select doc_id, {WORDS.format(lower)} as w from documents),
  s as (select distinct doc_id, unnest(case when len(w) >= {n} then list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end) as g from w),
  n as (select doc_id, count(*) as n from s group by doc_id),
  k as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
  links as (select a, b from k join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * k >= {percent} * (na.n + nb.n - k)),
  {COMPONENTS}
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(root, w.doc_id) as component_id from w left join n on w.doc_id = n.doc_id left join comp on w.doc_id = node"""


def vector_links(threshold: float = 0.9) -> str:
    return f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
  g as (select vec_id, e from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
  links as (select a.vec_id as a, b.vec_id as b from g a join g b on len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= {threshold}),
  {COMPONENTS}
select v.vec_id, coalesce(n, 0) as n_links, coalesce(root, v.vec_id) as component_id, v.vec_id = coalesce(root, v.vec_id) as kept from v left join (select a, count(*) as n from links group by a) l on v.vec_id = l.a left join comp on v.vec_id = node"""


ORACLE: dict[str, str] = {
    "op1_quality_rules": quality_rules(),
    "op2_ngram_jaccard": ngram_join(),
    "op4_embedding_near_dedup": vector_links(),
    "op5_warc_bundles": OP5_SQL,
}
