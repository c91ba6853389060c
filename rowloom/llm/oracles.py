"""SQL for DuckDB of the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from rowloom.llm import quality, urls

_WORD = r"[^\x20\x09-\x0D]+"


def _quality() -> str:
    values = " union all ".join(f"select lang, source, '{n}' as ratio, cast({a} * {scale} // {b} as bigint) as v from b where not base_failed" for n, a, b, scale, *_ in quality.RATIOS)
    steps = " union all ".join(f"select '{n}' as ratio, {str(low).lower()} as below, {least} as least" for n, _, _, _, low, _, least in quality.RATIOS)
    ranks = ", ".join(f"({i}, {r})" for i, r in enumerate((quality.ORIGIN, *quality.RANKS)))
    inside = " and ".join(f"greatest({a} - {e}, 0) * {scale} // {b} <= q.{n}_high" + (f" and ({a} + {e}) * {scale} // {b} >= q.{n}_low" if low else "") for n, a, b, scale, low, e, _ in quality.RATIOS)
    cells = ", ".join(f"max(case when ratio = '{n}' then low end) as {n}_low, max(case when ratio = '{n}' then high end) as {n}_high" for n, *_ in quality.RATIOS)

    def fence(name: str, keys: str) -> str:
        """By group and ratio, the first quantile that a leap follows, both ways from the other quartile."""
        by = f"{keys}ratio"
        return f"""{name}_s as (select {by}, docs, j, min(case when upto * 1000 >= docs * r then top end) as u, min(case when upto * 1000 >= docs * (1000 - r) then floor_ end) as d
        from (select *, sum(n) over (partition by {by} order by bin) as upto, sum(n) over (partition by {by}) as docs from (select {by}, bin, floor_, top, sum(n) as n from sketch group by {by}, bin, floor_, top) s) t, (values {ranks}) x(j, r) group by {by}, docs, j),
    {name}_l as (select *, lag(u) over o as bu, lag(d) over o as bd, first_value(u) over o as mu, first_value(d) over o as md from {name}_s window o as (partition by {by} order by j)),
    {name} as (select {by}, docs, case when any_value(below) then coalesce(max(case when j > 1 and md - d > {quality.LEAP} * (md - bd) + least then bd end), min(d)) else -1 end as low,
      coalesce(min(case when j > 1 and u - mu > {quality.LEAP} * (bu - mu) + least then bu end), max(u)) as high from {name}_l join st using (ratio) group by {by}, docs)"""

    return rf"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
    e as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from w),
    g as (select doc_id, i, w = lag(w) over d as echo, case when i + 7 <= count(*) over (partition by doc_id) then
      w || ' ' || lead(w, 1) over d || ' ' || lead(w, 2) over d || ' ' || lead(w, 3) over d || ' ' || lead(w, 4) over d || ' ' || lead(w, 5) over d || ' ' || lead(w, 6) over d || ' ' || lead(w, 7) over d end as gram
      from e window d as (partition by doc_id order by i)),
    r as (select *, case when gram is not null and count(*) over (partition by doc_id, gram) > 1 then 1 else 0 end as hit from g),
    c as (select doc_id, echo, max(hit) over (partition by doc_id order by i rows between 7 preceding and current row) as covered from r),
    rep as (select doc_id, sum(covered) as n_repeat_words, count(*) filter (echo) as n_echo_words from c group by doc_id),
    l as (select doc_id, line, count(*) as n from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents) x where regexp_matches(line, '{_WORD}') group by all),
    dup as (select doc_id, sum(n - 1) as n_dup_lines from l group by doc_id),
    m as (select d.doc_id, d.lang, d.source, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
      cast(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
      cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(coalesce(n_echo_words, 0) as bigint) as n_echo_words
      from documents d join w on w.doc_id = d.doc_id left join rep on rep.doc_id = d.doc_id left join dup on dup.doc_id = d.doc_id),
    b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m),
    v as ({values}),
    k as (select lang, source, ratio, v, greatest(length(bin(v)) - 6, 0) as e from v),
    sketch as (select lang, source, ratio, e * 32 + (v >> e) as bin, (v >> e) << e as floor_, (((v >> e) + 1) << e) - 1 as top, count(*) as n from k group by all), st as ({steps}),
    {fence('qo', 'lang, source, ')}, {fence('ql', 'lang, ')}, {fence('qa', '')},
    h as (select o.lang, o.source, o.ratio, case when o.docs >= {quality.MIN_DOCS} then o.low when l.docs >= {quality.MIN_DOCS} then l.low else a.low end as low,
      case when o.docs >= {quality.MIN_DOCS} then o.high when l.docs >= {quality.MIN_DOCS} then l.high else a.high end as high
      from qo o join ql l on l.ratio = o.ratio and l.lang is not distinct from o.lang join qa a on a.ratio = o.ratio),
    q as (select lang, source, {cells} from h group by lang, source)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, case when base_failed then false else coalesce({inside}, false) end as kept
    from b left join q on q.lang is not distinct from b.lang and q.source is not distinct from b.source"""


_TOP_K = """with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as x from embeddings),
    s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) as bigint) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
    select query_id, cast(r as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s) t where r <= 10"""

#: Texts in hexadecimal, cut into pieces of 256 windows, so that no long string is read anew for each of its bytes.
_REPEATS = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    q as (select doc_id, o, substr(h, 2 * o + 1, 610) as h from (select doc_id, h, unnest(range(0, len(h) // 2, 256)) as o from d) x),
    w as (select doc_id, o + j as i, md5_number_lower(substr(h, 2 * j + 1, 100)) as s from (select doc_id, o, h, unnest(range(0, least(len(h) // 2 - 49, 256))) as j from q) x),
    f as (select s, min(doc_id) as least from w group by s having count(distinct doc_id) > 1),
    m as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from w join f using (s) where f.least < w.doc_id),
    n as (select doc_id, i, sum(case when before is null or i > before + 50 then 1 else 0 end) over (partition by doc_id order by i) as span from m),
    r as (select doc_id, span, min(i) as a, max(i) + 50 as b from n group by doc_id, span),
    g as (select doc_id, list(a order by a) as starts, list(b order by a) as ends from r group by doc_id),
    e as (select d.doc_id, h, coalesce(starts, []) as starts, coalesce(ends, []) as ends from d left join g using (doc_id)),
    k as (select *, array_to_string(list_transform(range(0, len(starts) + 1), lambda x: substr(h, cast(2 * coalesce(ends[x], 0) + 1 as bigint), cast(2 * (coalesce(starts[x + 1], len(h) // 2) - coalesce(ends[x], 0)) as bigint))), '') as kept from e)
    select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(list_sum(ends) - list_sum(starts), 0) as bigint) as n_removed, cast(len(starts) as bigint) as n_spans, sha256(unhex(kept)) as kept_sha256 from k"""

_JACCARD = rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as ws from documents),
    s as (select distinct doc_id, unnest(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
    n as (select doc_id, count(*) as n from s group by doc_id),
    pairs as (select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
    links as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * common >= 90 * (a.n + b.n - common)),
    reach as (select doc_id, doc_id as root from w union select l.x, r.root from reach r join links l on l.y = r.doc_id),
    c as (select doc_id, min(root) as component_id from reach group by doc_id)
    select w.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id from w left join n using (doc_id) join c using (doc_id)"""


def _urls(rules: Sequence[tuple[str, str, str]] = urls.RULES, levels: int = 10) -> str:
    """``levels`` bound the depth at which a node may have children enough for a wildcard, not that of paths."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    when = lambda pick: "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{pick(v, h, p)}'" for v, h, p in ordered) + " end"
    split = "string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '*', 'g'), '/')"
    alike = lambda b, n: f"({n} * ((b * {n} - {b} * l) * (b * {n} - {b} * l)) <= {urls.DIFFERENT} * (l * ({n} - l) * ({b} * ({n} - {b}))) or {b} = 0 or {b} = {n} or l = {n})"
    steps = ["l0 as (select host, segs, segs as t, n, blocked, labelled from counted)"]
    for i in range(levels):
        up = f"t[1:{i}]"
        steps += [
            f"w{i} as (select host, {up} as p from l{i} where len(segs) > {i} group by host, {up} having count(distinct t[{i + 1}]) >= {urls.MANY} and sum(n) <= count(distinct t[{i + 1}]) * {urls.PER_CHILD})",
            f"l{i + 1} as (select l.host, segs, case when w.host is not null and t[{i + 1}] <> '' then list_concat({up}, ['*'], t[{i + 2}:]) else t end as t, n, blocked, labelled from l{i} l left join w{i} w on w.host = l.host and w.p = l.{up} and len(segs) > {i})",
        ]
    return f"""with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    x as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from u),
    y as (select page_id, host, path, {when(lambda v, h, p: h + p)} as rule, {when(lambda v, h, p: v)} as said, {split} as segs from x),
    counted as (select host, segs, count(*) as n, count(*) filter (said = 'block') as blocked, count(said) as labelled from y group by host, segs),
    sh as (select cast(sum(blocked) as double) / sum(n) as share from counted), {', '.join(steps)},
    st as (select host, segs, j, t[1:j] as node, t[1:j - 1] as up, t[j] as seg, blocked, labelled from (select *, unnest(range(1, len(t) + 1)) as j from l{levels}) z),
    no as (select host, node, up, seg, cast(sum(blocked) as double) as b, cast(sum(labelled) as double) as l from st group by all),
    po as (select *, sum(b) over (partition by host, up) as ab, sum(l) over (partition by host, up) as al from no),
    si as (select *, case when l = 0 then '?' when {alike('ab', 'al')} then '~' when b * al > ab * l then '+' else '-' end as side from po),
    ps as (select *, sum(b) over (partition by host, up, side) as sb, sum(l) over (partition by host, up, side) as sl from si),
    br as (select host, node, case when side in ('?', '~') or {alike('sb', 'sl')} then side else '=' || seg end as branch from ps),
    te as (select st.host, segs, string_agg(branch, '/' order by j) as template from st join br using (host, node) group by st.host, segs),
    pl as (select c.*, template from counted c join te using (host, segs)),
    pu as (select host, template, (sum(blocked) + {urls.PRIOR} * any_value(share)) / (sum(labelled) + {urls.PRIOR}) as purity from pl, sh group by host, template),
    ju as (select host, segs, purity from pl join pu using (host, template))
    select page_id, host, path, rule, coalesce(said, case when purity >= {urls.REJECT} then 'block' else 'allow' end) as verdict from y left join ju using (host, segs)"""


ORACLE_SQL = {"op1_quality_rules": _quality(), "op6_top_k": _TOP_K, "op7_repeats": _REPEATS, "op9_jaccard_join": _JACCARD, "op10_url_filter": _urls()}
