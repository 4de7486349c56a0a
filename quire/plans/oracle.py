"""The registered queries in SQL for DuckDB."""

from __future__ import annotations

from quire.plans.fixtures import with_views

ORACLE: dict[str, str] = {}


def _put(name: str, views: tuple[str, ...], sql: str, more: str = "") -> None:
    head = with_views(*views) if views else ""
    ORACLE[name] = f"{head}{', ' if head and more else 'with ' if more else ''}{more} {sql}"


_PD = ("fx_page", "fx_document")
_REQ = "coalesce(case when spreadside in ('left','right') then spreadside end, case when pinside in ('left','right') then pinside end)"


def _balanced(unused: str, more_views: str = "") -> str:
    return f"""kept as (select p.*, d.firstpageright, {_REQ} as required from fx_page p join fx_document d on d.id = p.documentid where not p.staged and not ({unused})),
numbered as (select *, row_number() over (partition by documentid order by sortorder, id) as k, case when required is not null then case when (required = 'right') = firstpageright then 1 else 0 end end as par from kept),
seen as (select *, max(2 * k + par) over (partition by documentid order by k rows between unbounded preceding and 1 preceding) as v from numbered),
judged as (select *, coalesce(case when v is null then k % 2 else (v % 2 + k - cast(floor(v / 2) as bigint)) % 2 end <> par, false) as blank_before from seen),
placed as (select *, cast(k + sum(cast(blank_before as int)) over (partition by documentid order by k rows between unbounded preceding and current row) as bigint) as position from judged),
sided as (select *, case when (position % 2 = 1) = firstpageright then 'right' else 'left' end as side from placed)"""


_UNUSED = "p.filler and p.pagetype = 'canvas'"
_put("spreads", _PD, """select documentid, id, position, side, sum(fresh) over (partition by documentid order by position rows between unbounded preceding and current row) as row_no from
(select *, case when side = 'right' and not width > height and coalesce(lag(side) over w = 'left' and not lag(width > height) over w and lag(position) over w = position - 1, false) then 0 else 1 end as fresh from sided window w as (partition by documentid order by position)) t""", _balanced(_UNUSED))
_put("rebalance", _PD, """select documentid, position, false as filler, id from placed union all
select b.documentid, b.position, true, coalesce(f.id, 0) from (select documentid, position - 1 as position, row_number() over (partition by documentid order by position) as i from placed where blank_before) b
left join (select documentid, id, row_number() over (partition by documentid order by sortorder, id) as i from fx_page p where not staged and p.filler and p.pagetype = 'canvas') f on f.documentid = b.documentid and f.i = b.i""", _balanced(_UNUSED))
_put("rebalance_used_fillers", (*_PD, "fx_overlay"), "select documentid, id, position, blank_before from placed", _balanced(_UNUSED + " and p.id not in (select pageid from fx_overlay)"))
_ISSUES = f"""numbered as (select p.*, d.firstpageright, row_number() over (partition by documentid order by sortorder, p.id) as position from fx_page p join fx_document d on d.id = p.documentid where not staged),
judged as (select *, lead(spreadid) over (partition by documentid order by position) as next_spread, case when (position % 2 = 1) = firstpageright then 'right' else 'left' end as side from numbered),
issues as (select documentid, id, position, spreadid is not null and spreadside = 'left' and (next_spread is null or next_spread <> spreadid) as torn, coalesce({_REQ} <> side, false) as wrong_side from judged)"""
_put("layout_issues", _PD, "select * from issues where torn or wrong_side", _ISSUES)
_put("issue_counts", _PD, "select documentid, count(*) as issues from issues where torn or wrong_side group by all", _ISSUES)
_put("can_link", ("fx_page",), "select documentid, id, next_id from (select *, lead(id) over w as next_id, lead(spreadid) over w as ns from fx_page where not staged and not filler window w as (partition by documentid order by sortorder, id)) t where spreadid is null and ns is null and next_id is not null")
_put("link_spreads", ("fx_page",), """select id, spreadid, spreadside from fx_page where spreadid is not null union all
select case when half = 1 then id else nid end, id, case when half = 1 then 'left' else 'right' end from (select * from (select *, i - row_number() over (partition by documentid, staged, area order by i) as island from (
select id, documentid, staged, area, spreadid, row_number() over w as i, lead(id) over w as nid, lead(spreadid) over w as nsp from (select *, case when staged then sourceid end as area from fx_page where not filler) f window w as (partition by documentid, staged, area order by sortorder, id)) n
where spreadid is null and nid is not null and nsp is null) s qualify row_number() over (partition by documentid, staged, area, island order by i) % 2 = 1) t, (values (1), (2)) h(half)""")
_put("type_areas", _PD, """select id, side, round(case when side = 'right' then i else o end / 210.0, 6) as x, round(cast(20 as double) / 297, 6) as y, round((210 - i - o) / 210.0, 6) as w, round(cast(252 as double) / 297, 6) as h,
round(case when side = 'right' then cast(149 as double) / 210 else cast(12 as double) / 210 end, 6) as note_x from (select p.id, case when (row_number() over (partition by documentid order by sortorder, p.id) % 2 = 1) = firstpageright then 'right' else 'left' end as side, cast(case when pagetype = 'html' then 20 else 25 end as double) as i, cast(case when pagetype = 'html' then 68 else 18 end as double) as o from fx_page p join fx_document d on d.id = p.documentid where not staged) t""")
_put("move_pages", ("fx_page",), """select documentid, id, row_number() over (partition by documentid order by nr, sortorder, id) as position from (select k.*, case when c.f is null then r when r = c.f then c.t when r = c.t then c.f else r end as nr from ranked k left join chosen c on c.documentid = k.documentid) t""",
"""units as (select *, min(sortorder * 1000000000000 + id) over (partition by documentid, coalesce(spreadid, -id)) as u from fx_page where not staged and not (filler and pagetype = 'canvas')),
ranked as (select *, dense_rank() over (partition by documentid order by u) as r from units),
chosen as (select documentid, r as f, case when documentid % 2 = 0 then r - 1 else r + 1 end as t from ranked x where sortorder = 3 and case when documentid % 2 = 0 then r - 1 else r + 1 end between 1 and (select max(r) from ranked y where y.documentid = x.documentid))""")
_put("adopt_pages", ("fx_page",), """select documentid, id, row_number() over (partition by documentid order by a, b, sortorder, id) as position from (select documentid, id, position as a, 0 as b, sortorder from here union all
select n.documentid, n.id, case when n.documentid % 4 = 0 then 0 else coalesce(h.position, 2147483648) end, 1, n.sortorder from fx_page n left join here h on h.documentid = n.documentid and n.documentid % 4 = 1 and h.id = n.documentid * 100 + 2 where n.staged) t""",
"here as (select *, row_number() over (partition by documentid order by sortorder, id) as position from fx_page where not staged)")
_put("mirror_overlays", (*_PD, "fx_overlay"), """select o.id, case when t.id is not null then cast(greatest(0, 1 - o.x - o.w) as decimal(10,6)) else o.x end as x from fx_overlay o left join (select id from (select p.id, case when (row_number() over (partition by documentid order by sortorder, p.id) % 2 = 1) = firstpageright then 'right' else 'left' end as side, case when sortorder % 2 = 0 then 'left' when sortorder % 3 = 0 then 'right' end as ls from fx_page p join fx_document d on d.id = p.documentid where not staged) q where ls <> side) t on t.id = o.pageid""")

_RANGES = """counted as (select d.id as documentid, d.firstpageright, d.pagerange, count(*) as n from fx_document d join fx_page p on p.documentid = d.id where not p.staged group by all),
numbers as (select documentid, firstpageright, pagerange, n, unnest(range(1, n + 1)) as k from counted),
chosen as (select *, case when pagerange in ('', '5-2') then true when pagerange = '2-3, 6' then k in (2, 3, 6) when pagerange = '4, 1-2,6-' then k between 1 and 2 or k = 4 or k >= 6 when pagerange = '2-40' then k >= 2 else true end as ok from numbers),
numbered as (select *, row_number() over (partition by documentid order by sortorder, id) as k from fx_page where not staged),
published as (select p.documentid, p.id, p.width, p.height, c.firstpageright, p.k as pagenumber, row_number() over (partition by p.documentid order by p.k) as position, count(*) over (partition by p.documentid) as c from numbered p join chosen c on c.documentid = p.documentid and c.k = p.k where c.ok)"""
_put("parse_range", _PD, "select documentid as id, pagerange <> '5-2' as valid, coalesce(string_agg(case when ok then cast(k as varchar) end, ',' order by k), '') as numbers from chosen group by all", _RANGES)
_put("published_pages", _PD, "select documentid, id, pagenumber from published", _RANGES)
_put("compact_range", _PD, "select documentid, string_agg(case when a = b then cast(a as varchar) else a || '-' || b end, ', ' order by a) as pages from (select documentid, min(pagenumber) as a, max(pagenumber) as b from published group by documentid, pagenumber - position) t group by documentid", _RANGES)
_put("print_selection", _PD, "select documentid, id, position - case when c >= 2 then 1 else 0 end as position from published where position >= 2 ", _RANGES)
_GRID = {"1up": (1, "c"), "2up": (2, "ceil((c + o) / 2.0)"), "4up": (4, "ceil((c + o) / 4.0)"), "booklet": (2, "2 * ceil((c + 1 - o) / 4.0)")}
for _layout, (_slots, _sides) in _GRID.items():
    if _layout == "booklet":
        _at = "select documentid, q - 1 as side_no, case when (q % 2 = 1) = (pp = q) then 1 else 0 end as slot_no, position from (select *, least(pp, 4 * cast(ceil((c + 1 - o) / 4.0) as bigint) + 1 - pp) as q from (select *, position + 1 - o as pp from s) a) b"
    else:
        _o = "o" if _slots > 1 else "0"
        _at = f"select documentid, (position - 1 + {_o}) // {_slots} as side_no, (position - 1 + {_o}) % {_slots} as slot_no, position from s"
    _put(f"impose_{_layout}", _PD, f"select g.documentid, g.side_no, g.slot_no, coalesce(a.position, 0) as position from grid g left join slotted a on a.documentid = g.documentid and a.side_no = g.side_no and a.slot_no = g.slot_no",
    _RANGES + f""", s as (select *, case when firstpageright then 1 else 0 end as o from published), slotted as ({_at}),
grid as (select documentid, side_no, unnest(range(0, {_slots})) as slot_no from (select documentid, unnest(range(0, cast({_sides} as bigint))) as side_no from (select distinct documentid, c, o from s) x) y)""")
_put("print_plan", _PD, """select documentid, side_no, slot_no, id, round(slot_no * 148.5 + 5 + (138.5 - width * z) / 2, 2) as x, round(5 + (196 - height * z) / 2, 2) as y, round(width * z, 2) as w, round(height * z, 2) as h from
(select *, q - 1 as side_no, case when (q % 2 = 1) = (pp = q) then 1 else 0 end as slot_no, least(138.5 / width, cast(196 as double) / height) as z from (select *, least(pp, 4 * cast(ceil((c + 1 - o) / 4.0) as bigint) + 1 - pp) as q from (select *, position + 1 - o as pp from s) a) b) e""",
_RANGES + ", s as (select *, case when (first_value(pagenumber) over (partition by documentid order by position) % 2 = 1) = firstpageright then 1 else 0 end as o from published)")

_CITE = "case when showcitation and (coalesce(url not in ('', '0'), false) or coalesce(author not in ('', '0'), false)) then"
_given = lambda c: f"case when {c} not in ('', '0') then {c} end"
_put("citations", ("fx_page", "fx_source"), f"""select p.id, coalesce({_CITE} concat_ws(', ', {_given('author')}, coalesce({_given('title')}, filename)) end, '') as citation,
coalesce({_CITE} concat_ws(', ', {_given('author')}, {_given('title')}, {_given('url')}) end, '') as plain from fx_page p left join fx_source s on s.id = p.sourceid""")
_put("source_counts", ("fx_page", "fx_source"), "select s.id, count(*) filter (where p.staged) as staged, count(*) filter (where not p.staged) as in_document, count(p.id) as pages from fx_source s left join fx_page p on p.sourceid = s.id group by s.id")
_put("master_usage", ("fx_document", "fx_page"), "select d.id, (select count(*) from fx_page p where p.documentid = d.id) as pages, (select count(*) from fx_document e where e.masterid = d.id) as derived from fx_document d where ismaster")
_put("lineage", ("fx_document",), "select d.id, d.masterid, m.id is not null as known from fx_document d left join fx_document m on m.id = d.masterid where d.masterid is not null")
_put("copy_sources", ("fx_document",), "select distinct g.userid, d.id from fx_document d join (select distinct o_custkey % 100 as userid, o_custkey % 7 as course from orders) g on g.course = d.course where d.ismaster")
_put("glossary_lookup", ("fx_glossary",), "select t.glossaryid, t.term, min(g.id) as id from (select p_size as glossaryid, upper(p_brand) as term from part union select p_size, p_name from part) t join fx_glossary g on g.glossaryid = t.glossaryid and (lower(t.term) = lower(g.concept) or lower(t.term) = lower(g.alias)) where g.approved group by all")
_NOW = "timestamp '2024-01-15 00:00:00'"
_put("recent_jobs", ("fx_job",), f"select documentid, id, rank from (select *, row_number() over (partition by documentid order by ts desc, id desc) as rank from fx_job where status in ('queued', 'running') or ts >= {_NOW} - interval 1 day) t where rank <= 20")
_put("stale_jobs", ("fx_job",), f"select id from fx_job where status = 'queued' and ts < {_NOW} - interval 10 minute")
_put("job_result", ("fx_job",), "select documentid % 500 as job, count(*) filter (where status <> 'failed') as pages, coalesce(string_agg(case when status = 'failed' then 'bad ' || id end, chr(10) order by id), '') as message, case when count(*) filter (where status = 'failed') > 0 and count(*) filter (where status <> 'failed') = 0 then 'failed' else 'done' end as status from fx_job group by 1")
_put("job_status", ("fx_job",), "select documentid, ['queued', 'running', 'failed', 'done'][max(list_position(['queued', 'running', 'failed', 'done'], status))] as status, count(*) as jobs from fx_job group by documentid")
_put("open_jobs", ("fx_job",), "select documentid, count(*) filter (where status = 'queued') as queued, count(*) filter (where status = 'running') as running from fx_job where status in ('queued', 'running') group by documentid")
_put("completion", ("fx_view",), "select user_id, documentid, min(ts) as first_view, count(*) as views from fx_view group by all")
_put("next_order", ("fx_page",), "select documentid, max(sortorder) + 1 as next from fx_page group by documentid")

_put("clamp_boxes", ("fx_overlay",), "select id, cast(x1 as decimal(10,6)) as x, cast(y1 as decimal(10,6)) as y, cast(greatest(0, least(w, 1 - x1)) as decimal(10,6)) as w, cast(greatest(0, least(h, 1 - y1)) as decimal(10,6)) as h from (select *, greatest(0, least(1, x)) as x1, greatest(0, least(1, y)) as y1 from fx_overlay) t")
_put("reading_order", ("fx_overlay",), "select pageid, id, row_number() over (partition by pageid order by round(x, 1), y, sortorder, id) as rank from fx_overlay where overlaytype in ('reflow', 'textframe', 'imageframe')")
_put("z_order", ("fx_overlay",), "select pageid, id, row_number() over (partition by pageid order by case when overlaytype in ('textframe', 'imageframe') then 0 else 1 end, sortorder, id) as z from fx_overlay")
_put("page_overlays", ("fx_page", "fx_overlay"), "select p.id, coalesce(string_agg(cast(o.id as varchar), ',' order by o.sortorder, o.id), '') as overlays from fx_page p left join fx_overlay o on o.pageid = p.id group by p.id")
_put("page_facts", ("fx_page", "fx_overlay"), "select p.id, p.documentid, count(*) filter (where overlaytype = 'textframe') as frames, count(o.id) = 0 as blank, coalesce(bool_or(overlaytype in ('reflow', 'textframe')), false) as has_text from fx_page p left join fx_overlay o on o.pageid = p.id group by p.id, p.documentid")
_put("column_numbers", ("fx_overlay",), "select pageid, id, row_number() over (partition by pageid order by sortorder, id) as column_no from fx_overlay where overlaytype = 'column'")
_put("learner_masks", ("fx_overlay",), """select pageid, count(*) as masks, md5(sha1(cast(pageid as varchar)) || ';' || string_agg(concat_ws(',', x, y, w, h, case when sortorder % 3 = 1 then 'black' else 'white' end), ';' order by sortorder, id)) as key from fx_overlay where overlaytype = 'mask' and sortorder % 3 <> 0 group by pageid""")

_put("page_titles", (), "select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title from pages")
_ACT = "b0"
for _t in ("script", "style", "noscript", "iframe", "object", "embed", "svg", "template", "button", "select", "textarea"):
    _ACT = f"regexp_replace({_ACT}, '(?is)<{_t}\\b[^>]*>.*?</{_t}\\s*>', '', 'g')"
_BODY = f"bodies as (select page_id, {_ACT} as b from (select page_id, case when regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) <> '' then regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) else html end as b0 from pages) t)"
_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"
_put("plain_text", (), f"select page_id, md5({_PLAIN}) as text from bodies", _BODY)
_put("previews", (), f"select page_id, case when length(t) <= 120 then t else case when regexp_extract(left(t, 120), '^(.*)\\s', 1) <> '' then regexp_extract(left(t, 120), '^(.*)\\s', 1) else left(t, 120) end || '…' end as preview from (select page_id, {_PLAIN} as t from bodies) x", _BODY)
_put("html_tokens", (), """select page_id, lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag, starts_with(token, '</') as closing, count(*) as n, max(pos) - 1 as last from
(select page_id, unnest(l) as token, generate_subscripts(l, 1) as pos from (select page_id, regexp_extract_all(b, '(<[^>]+>|[^<]+)', 1) as l from bodies) t) u group by all""", _BODY)
_put("charsets", (), "select page_id, coalesce(nullif(lower(regexp_extract(html, '(?i)<meta[^>]+charset=[\"'']?([\\w-]+)', 1)), ''), 'utf-8') as charset from pages")
_BRK = "trim(line) = '{{< pagebreak >}}'"
_put("layout_segments", ("fx_line",), f"select documentid, line_no, dense_rank() over (partition by documentid order by s) - 1 as segment from (select *, {_BRK} as brk, sum(case when {_BRK} then 1 else 0 end) over (partition by documentid order by line_no rows between unbounded preceding and current row) as s from fx_line) t where not brk")
_put("div_tree", ("fx_line",), """select t.documentid, t.line_no, t.depth, coalesce((select max(o.line_no) from depths o where o.documentid = t.documentid and o.opener and o.line_no < t.line_no and o.depth = case when t.opener then t.depth - 1 else t.depth end), -1) as parent from depths t""",
"""steps as (select *, regexp_matches(line, '^\\s*:{3,}\\s*\\S') and not regexp_matches(line, '^\\s*:{3,}\\s*$') as opener, regexp_matches(line, '^\\s*:{3,}\\s*$') as closer from fx_line),
sums as (select *, sum(case when opener then 1 when closer then -1 else 0 end) over (partition by documentid order by line_no rows between unbounded preceding and current row) as c from steps),
depths as (select *, cast(c - least(0, min(c) over (partition by documentid order by line_no rows between unbounded preceding and current row)) as bigint) as depth from sums)""")
_put("note_numbers", ("fx_line",), """select documentid, line_no as block_index, cast(coalesce(case when starts_with(line, ':::') then sum(case when starts_with(line, ':::') then 1 else 0 end) over (partition by documentid order by line_no rows between unbounded preceding and current row) end, 0) as bigint) as note_no,
coalesce((select min(n.line_no) from fx_line n where n.documentid = x.documentid and n.line_no >= x.line_no and n.line_no % 3 <> 1), (select max(n.line_no) from fx_line n where n.documentid = x.documentid and n.line_no % 3 <> 1), -1) as holder from fx_line x""")
_put("column_widths", (), "select p_partkey, (select w from (select unnest([20, 25, 30, 33, 40, 50, 60, 66, 70, 75, 80]) as w) t order by abs(p_size * 2 - w), w limit 1) as width from part")
_BLOCKS = """blocks as (select doc_id, i - 1 as block_index, case when i = 1 then 'h1' else 'p' end as tag, s as text from (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) t where s <> '')"""
_CPL = "cast(greatest(10, floor(cast(167 as double) / 210 * 210 / (3.88 * 0.5 * case when tag = 'h1' then 1.8 else 1.0 end))) as int)"
_put("block_heights", (), f"select doc_id, block_index, lines, round(lines * (3.88 * 1.4 / 297) * case when tag = 'h1' then cast(1.8 as double) else cast(1 as double) end * 1.05, 6) as h from (select *, cast(greatest(1, ceil(length(text) / cast({_CPL} as double))) as bigint) as lines from blocks) t", _BLOCKS)
_put("flow_text_kept", (), "select * from (select doc_id, sum(length(regexp_replace(text, '[ \t\r\f\n]+', '', 'g')))::bigint as characters from documents group by doc_id) t where characters > 0")
_LINED = r"""lined as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(translate(x, '<>&[]', '     '), '[ \t\r\f]+', ' ', 'g'))), lambda x: regexp_matches(x, '[a-zA-Z0-9]')) as ls from documents),
each as (select doc_id, unnest(ls) as l, generate_subscripts(ls, 1) - 1 as i from lined)"""
_put("noted_blocks", (), """select doc_id, i + (i + 1) // 5 as block_index, 'text' as kind, case when i % 5 = 4 then 'blockquote' else 'p' end as tag,
case i % 5 when 1 then '<p>' || l || '<sup>' || n || '</sup> end</p>' when 3 then '<p>' || l || '<sup>' || n || '</sup></p>' when 4 then '<blockquote>' || l || '</blockquote>' else '<p>' || l || '</p>' end as html,
case i % 5 when 1 then '<p><sup>' || n || '</sup> side ' || i || ' <b>mark</b></p>' when 2 then '<ul><li>' || l || '</li><li>two<ul><li>deep</li></ul></li></ul>' when 3 then '<p><sup>' || n || '</sup> foot ' || i || '</p><ol><li>' || l || '</li></ol>' when 4 then '<p>m ' || i || '</p>' else '' end as notes
from (select *, 2 * (i // 5) + (i % 5 >= 1)::int + (i % 5 >= 3)::int as n from each) t""", _LINED)
_put("word_pages", (), """select doc_id, page as page_no, string_agg(html, '' order by i) as html from (select doc_id, i // 6 + 1 as page, i, case i % 6 when 0 then '<h2>' || l || '</h2>' when 1 then '<ul><li><strong>' || l || '</strong></li>' || case when i = top then '</ul>' else '' end when 2 then '<li>' || l || '</li></ul>'
when 3 then '<p>' || l || '<em><sup><a href="#fn:' || n || '" class="footnote-ref">' || n || '</a></sup></em>' || case when i % 12 = 3 then '<img src="docx:word/media/image' || i || '.png" alt="">' else '' end || '</p>' when 4 then '<table><tr><td>' || l || '</td><td>x y<br>in ' || i || '</td></tr><tr><td></td></tr></table>' else '<p>' || l || '<br></p>' end as html
from (select *, (i + 3) // 6 as n, max(i) over (partition by doc_id) as top from each) t union all
select doc_id, (max(i) + 1) // 6 + 1, 1000000, '<div class="footnotes"><hr><ol>' || string_agg('<li id="fn:' || (i + 3) // 6 || '"><p>note ' || i || '</p></li>', '' order by i) filter (where i % 6 = 3) || '</ol></div>' from each group by doc_id) u where html is not null group by doc_id, page""", _LINED)
_put("word_media", (), """select doc_id, 'rId' || i as id, 'docx:word/media/image' || i || '.png' as src, 'image' || i || '.png' as filename, 'picture ' || i as data from each where i % 12 = 3""", _LINED)
_put("pictured_blocks", (), """select doc_id, 6 * (i // 4) + nr as block_index, case when nr = 3 then 'pagebreak' when pic and filename is not null then 'image' else 'text' end as kind, case when nr = 3 then null when pic and filename is not null then 'img' else 'p' end as tag,
case when nr = 3 or (pic and filename is not null) then null when pic then '<p><em>[' || case when nr = 1 then 'A' else l end || ']</em></p>' when nr = 0 then '<p>' || l || ' more</p>' else '<p>' || l || '</p>' end as html,
case when pic then t.src end as src, case when pic then case when nr = 1 then '' else l end end as caption, case when pic then filename end as filename, case when pic then width end as width
from (select *, nr in (1, 2) as pic, 'p' || i || '.png' as src from each, (values (0), (1), (2), (3), (4), (5)) v(nr) where case i % 4 when 0 then nr in (0, 1) when 1 then nr = 2 when 2 then nr in (3, 4) else nr = 5 end) t
left join (select 'p' || p_partkey || '.png' as src, 'f' || p_partkey as filename, p_size::bigint as width from part where p_partkey % 3 <> 0) m on m.src = t.src""", _LINED)
_put("note_tops", ("fx_overlay",), "select pageid as page, id as no, round(c + max(y - c) over (partition by pageid order by id rows between unbounded preceding and current row), 6) as top from (select *, coalesce(sum(h1 + cast(2 as double) / 297) over (partition by pageid order by id rows between unbounded preceding and 1 preceding), 0) as c from (select pageid, id, cast(y as double) as y, cast(w as double) / 10 as h1 from fx_overlay) a) b")

_put("export_nested", ("fx_document", "fx_page", "fx_overlay"), """select d.id, coalesce(string_agg(p.id || ':' || p.o, ',' order by p.sortorder, p.id), '') as pages from fx_document d left join (select p.id, p.documentid, p.sortorder, coalesce(string_agg(cast(o.id as varchar), '+' order by o.sortorder, o.id), '') as o from fx_page p left join fx_overlay o on o.pageid = p.id group by all) p on p.documentid = d.id group by d.id""")
_put("nested_round_trip", ("fx_document", "fx_page", "fx_overlay"), "select documentid + 1000000000 as documentid, p.id + 1000000000 as id, 'page' as kind from fx_page p join fx_document d on d.id = p.documentid union all select pageid + 1000000000, o.id + 1000000000, 'overlay' from fx_overlay o join fx_page p on p.id = o.pageid join fx_document d on d.id = p.documentid")
_put("copy_pages", _PD, """select target as documentid, target * 1048576 + n as id, id as copied_from, coalesce(case when spreadid is not null and halves = 2 then target * 1048576 + l end, 0) as spreadid from (select *, count(*) over (partition by target, documentid, spreadid) as halves, min(n) over (partition by target, documentid, spreadid) as l from (select d.id as target, u.documentid, u.id, p.spreadid, row_number() over (partition by d.id order by u.documentid, u.pagenumber) as n from fx_document d join published u on u.documentid = d.masterid join fx_page p on p.id = u.id) a) b""", _RANGES)
_put("remap_masters", ("fx_document",), "select d.id, coalesce(m.id, 0) as masterid from fx_document d left join fx_document m on m.id = d.masterid")
_put("broken_spreads", ("fx_page",), "select documentid, spreadid from fx_page where not staged and spreadid is not null group by all having count(*) < 2")
_put("orphans", ("fx_document", "fx_page", "fx_overlay"), "select 'overlay' as kind, id from fx_overlay where id % 9 = 0 or pageid not in (select id from fx_page) union all select 'page', id from fx_page where id % 11 = 0 or documentid not in (select id from fx_document)")
_put("delete_sources", ("fx_page", "fx_source"), "select id, case when sourceid in (select id from fx_source where id % 4 = 0) then 0 else sourceid end as sourceid from fx_page where not (staged and sourceid in (select id from fx_source where id % 4 = 0))")
_put("delete_documents", ("fx_document", "fx_page", "fx_overlay"), "select id, 'document' as kind from fx_document where not ismaster union all select id, 'page' from fx_page where documentid not in (select id from fx_document where ismaster) union all select id, 'overlay' from fx_overlay where pageid in (select id from fx_page where documentid not in (select id from fx_document where ismaster))")

_PROFILE = "profile as (select vec_id as page, i - 1 as x, round(cast(abs(v) as double), 6) as ink, 64 as n from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings) t)"
_put("empty_band", (), """select page, center from (select s.page, (a + b) // 2 as center, row_number() over (partition by s.page order by b - a desc, a) as k from (select page, min(x) as a, max(x) as b from (select page, x, x - row_number() over (partition by page order by x) as g from profile where ink < 0.05 and x between 25 and 38) e group by page, g) s
join (select page, sum(case when x < 25 then ink else 0 end) as li, sum(case when x >= 38 then ink else 0 end) as ri from profile group by page) h on h.page = s.page where b - a + 1 >= 0.64 and li > 0.5 and ri > 0.5) q where k = 1""", _PROFILE)
_put("shadow_valley", (), """select page, x from (select p.page, x, lum, median, row_number() over (partition by p.page order by lum, x) as k from (select *, cast(round(ink * 1000) as bigint) as lum from profile) p join (select page, list_sort(list(cast(round(ink * 1000) as bigint)))[33] as median from profile group by page) m on m.page = p.page where x between 25 and 38) t where k = 1 and lum < median - 25""", _PROFILE)
_put("text_columns", (), """select page, row_number() over (partition by page order by first) as column_no, first, last from (select *, count(*) over (partition by page) as c from (select page, min(first) as first, max(last) as last from (select *, sum(far) over (partition by page order by first rows between unbounded preceding and current row) as g from (select *, case when coalesce(first - lag(last) over (partition by page order by first) - 1 >= 0.02 * 64, true) then 1 else 0 end as far from
(select page, min(x) as first, max(x) as last from (select page, x, x - row_number() over (partition by page order by x) as g from profile where ink > 0.08) a group by page, g) r) s) t group by page, g) u where last - first + 1 > 6.4) v where c >= 2""", _PROFILE)
_put("border_box", (), "select page, least(count(*) filter (where x < least(lo, 13)), 13) as first, 63 - least(count(*) filter (where x > greatest(hi, 51)), 12) as last from (select *, coalesce(min(case when not ink > 0.1 then x end) over (partition by page), 64) as lo, coalesce(max(case when not ink > 0.1 then x end) over (partition by page), -1) as hi from profile) t group by page", _PROFILE)
_put("row_profile", (), "select doc_id as page, i - 1 as y, round(1 - length(regexp_replace(s, '[^ ]', '', 'g')) / cast(length(s) as double), 6) as ink from (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) t where length(s) > 0")

_put("visible_pages", _PD, """select id % 10 as userid, pid as id, masked from (select d.id, p.id as pid, false as masked from fx_document d join fx_page p on p.documentid = d.id where not p.staged and d.id % 3 = 0 union all
select d.id, u.id, d.id % 2 <> 0 from fx_document d join published u on u.documentid = d.id where d.id % 3 <> 0) t""", _RANGES)
_put("layout_pages", ("fx_line",), f"""select a.documentid, coalesce(segment, 0) + 1 as page_no, coalesce(content, '') as content from (select distinct documentid from fx_line) a left join (select documentid, segment, string_agg(line, chr(10) order by line_no) as content from
(select documentid, line_no, line, dense_rank() over (partition by documentid order by s) - 1 as segment from (select *, {_BRK} as brk, sum(case when {_BRK} then 1 else 0 end) over (partition by documentid order by line_no rows between unbounded preceding and current row) as s from fx_line) t where not brk) u group by all) b on b.documentid = a.documentid""")
_put("split_passages", (), """select doc_id, case when length(t) <= 200 or h = '' then t else h end as head, case when length(t) <= 200 or h = '' then 0 else length(t) - length(h) - 1 end as rest from (select doc_id, t, regexp_extract(left(t, 200), '^(.*) ', 1) as h from (select doc_id, replace(text, chr(10), ' ') as t from documents) a) b""")
_put("image_texts", (), "select p_partkey as id, o.src is not null as found, case when o.src is null then '[' || coalesce(nullif(case when p_size % 3 = 0 then '' else p_brand end, ''), p_name) || ']' else '-' end as fallback from part left join (select distinct o_orderkey * 2 as src from orders) o on o.src = p_partkey")

_BASES = """bases as (select *, case when (position % 2 = 1) = firstpageright then false else true end as left_ from (select d.id as documentid, d.firstpageright, 1 + count(p.id) as position from fx_document d left join fx_page p on p.documentid = d.id and not p.staged group by all) t)"""
_put("flow_starts", _PD, "select documentid, position + cast(left_ as bigint) as position, left_ as shifted from bases", _BASES)
_put("import_preview", _PD, """select documentid, sourceid, coalesce(id, 0) as id, position, side, filler, sum(case when joins then 0 else 1 end) over (w rows between unbounded preceding and current row) as row_no,
joins and coalesce(lag(half) over w = 'left' and half = 'right', false) as chained, case when joins or coalesce(lead(joins) over w, false) or wide then '-' when side = 'right' then 'left' else 'right' end as ghost
from (select *, coalesce(side = 'right' and not wide and lag(side) over v = 'left' and not lag(wide) over v, false) as joins from items window v as (partition by documentid, sourceid order by position)) j window w as (partition by documentid, sourceid order by position)""", _BASES + f""",
st as (select p.documentid, p.sourceid, p.id, p.landscapelock as wide, case when p.spreadid is not null then p.spreadside end as half, {_REQ} as required, b.position + cast(left_ as bigint) as base, b.firstpageright, row_number() over (partition by p.documentid, p.sourceid order by p.sortorder, p.id) as k from fx_page p join bases b on b.documentid = p.documentid where p.staged),
walk as (with recursive r as (select *, cast(required is not null and case when (base % 2 = 1) = firstpageright then 'right' else 'left' end <> required as bigint) as gap, base + cast(required is not null and case when (base % 2 = 1) = firstpageright then 'right' else 'left' end <> required as bigint) as position from st where k = 1 union all
select s.*, cast(s.required is not null and case when ((r.position + 1) % 2 = 1) = s.firstpageright then 'right' else 'left' end <> s.required as bigint), r.position + 1 + cast(s.required is not null and case when ((r.position + 1) % 2 = 1) = s.firstpageright then 'right' else 'left' end <> s.required as bigint) from st s join r on r.documentid = s.documentid and r.sourceid = s.sourceid and s.k = r.k + 1) select * from r),
items as (select *, case when (position % 2 = 1) = firstpageright then 'right' else 'left' end as side from (select documentid, sourceid, id, position, false as filler, wide, half, firstpageright from walk union all select documentid, sourceid, null, position - 1, true, false, null, firstpageright from walk where gap = 1) u)""")
_put("insert_blanks", ("fx_page",), """select documentid, id, row_number() over (partition by documentid order by p) as position from (select documentid, id, 2 * position as p from here union all
select h.documentid, 0, case when h.documentid % 2 = 0 then 2 * coalesce((select max(position) from here x where x.documentid = h.documentid and x.spreadid = h.spreadid and x.spreadside = 'left'), h.position) - 1 else 2 * coalesce((select max(position) from here x where x.documentid = h.documentid and x.spreadid = h.spreadid and x.spreadside = 'right'), h.position) + 1 end from here h where h.sortorder in (2, 5)) t""",
"here as (select *, row_number() over (partition by documentid order by sortorder, id) as position from fx_page where not staged)")
_put("natural_frames", (), "select p_partkey, round(case when h > m then m / a * pw / greatest(1, ph) else w end, 6) as w, round(least(h, m), 6) as h from (select *, w * ph / greatest(1, pw) * a as h, 0.9 * cast(252 as double) / 297 as m from (select p_partkey, p_size * 40 as pw, p_partkey % 3000 as ph, cast(210 as double) / 297 as a, least(cast(167 as double) / 210, p_size * 40 / cast(1240 as double)) as w from part) t) u")
_CLIPS = "clips as (select documentid, staged, case when sortorder % 3 = 0 then 'bild' else 'ausschnitt-' end || sortorder || '.png' as filename, sortorder from fx_page)"
_put("next_clip", ("fx_page",), "select documentid, coalesce(max(sortorder) filter (where sortorder % 3 <> 0), 0) + 1 as next from fx_page group by documentid")
_put("missing_clips", _PD, "select d.id as documentid, c.filename, min(c.documentid) as copied_from from fx_document d join clips c on c.documentid = d.masterid where not exists (select 1 from clips o where o.documentid = d.id and o.filename = c.filename and not o.staged) group by all", _CLIPS)
_put("snippet_images", ("fx_source",), "select s.id as sourceid, case when p.p_partkey is not null then filename else '-' end as filename from fx_source s left join part p on p.p_partkey = s.id and p.p_partkey % 3 <> 0")
_put("layout_images", ("fx_page",), """select p.id, case when p.sortorder % 4 = 0 then 'HTTPS://x.test/' || p.id when c.filename is not null then c.filename else '-' end as url, case when p.sortorder % 4 = 0 or c.filename is not null then '-' when p.id % 2 = 0 then '[' || p.pagetype || ']' else '' end as fallback
from fx_page p left join (select distinct documentid, filename from clips) c on c.documentid = p.documentid and c.filename = 'ausschnitt-' || (p.sortorder * 2) || '.png'""", _CLIPS)
_put("remap_glossaries", ("fx_overlay",), """select o.id, case when g = 0 then 0 when g in (select distinct p_size from part) and g % 5 = 1 then g + 1000 when g in (select distinct p_size from part) and g % 7 = c then g else 0 end as glossaryid from (select id, id % 60 as g, pageid % 7 as c from fx_overlay where overlaytype = 'glossary') o""")
_put("hidden_passages", (), "select doc_id as sourceid, count(*) as passages, count(*) filter (where length(text) % 4 = 0) as hidden from blocks group by doc_id", _BLOCKS)
_put("footnotes", (), "select o_orderkey, cast(1 as int) as note_no, 'fn:1' as target, o_orderpriority as text from orders union all select o_orderkey, 2, 'fn' || o_orderkey, 'two' from orders where o_orderkey % 3 = 0")
_put("writing_lines", (), "select p_partkey, cast(case when p_size % 5 = 0 then 5 when p_size % 7 = 0 then 1 else greatest(1, least(40, p_size * 2 - 20)) end as int) as lines, 'box a_b' || case when regexp_full_match(p_brand, '[A-Za-z][A-Za-z0-9_-]*') then ' ' || p_brand else '' end as classes from part")
_put("stale_measures", ("fx_source",), "select id as sourceid from fx_source where id % 3 = 0 or id % 8 = 1")
_put("mean_luminance", (), """select page, round(avg(case when c = ' ' then 255 else 0 end), 4) as mean, avg(case when c = ' ' then 255 else 0 end) < 100 as invert from (select *, cast(greatest(1, floor((greatest(max(x) over (partition by page), max(y) over (partition by page)) + 1) / 150.0)) as bigint) as s from (select doc_id as page, y, x, string_split(line, '')[x + 1] as c from (select doc_id, y, line, unnest(range(0, length(line))) as x from (select doc_id, i - 1 as y, l as line from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) a) b) c) d) e where x % s = 0 and y % s = 0 group by page""")


# edits: a table lined (documentid, id, firstpageright, required, unused, isfiller, spread, layoutside, ord) is balanced
_SETTLED = """ranked as (select *, row_number() over (partition by documentid, unused order by ord) as k from lined),
kept as (select *, case when required is not null then case when (required = 'right') = firstpageright then 1 else 0 end end as par from ranked where not unused),
seen as (select *, max(2 * k + par) over (partition by documentid order by k rows between unbounded preceding and 1 preceding) as v from kept),
judged as (select *, coalesce(case when v is null then k % 2 else (v % 2 + k - cast(floor(v / 2) as bigint)) % 2 end <> par, false) as blank_before from seen),
placed as (select *, cast(k + sum(cast(blank_before as int)) over (partition by documentid order by k rows between unbounded preceding and current row) as bigint) as position from judged),
settled as (select documentid, coalesce(id, 0) as id, position, isfiller as filler, coalesce(spread, 0) as spreadid, coalesce(layoutside <> case when (position % 2 = 1) = firstpageright then 'right' else 'left' end, false) as turned from placed union all
select b.documentid, coalesce(f.id, 0), b.position, true, 0, false from (select documentid, position - 1 as position, row_number() over (partition by documentid order by position) as i from placed where blank_before) b left join ranked f on f.unused and f.documentid = b.documentid and f.k = b.i)"""
_REQUIRED = "case when spreadside in ('left', 'right') then spreadside when pinside in ('left', 'right') then pinside end"
_SIDES = f"""paged as (select p.*, d.firstpageright, p.filler and p.pagetype = 'canvas' and p.id not in (select pageid from fx_overlay) as unused, case when sortorder % 2 = 0 then 'left' when sortorder % 3 = 0 then 'right' end as layoutside from fx_page p join fx_document d on d.id = p.documentid),
here as (select *, row_number() over (partition by documentid order by sortorder, id) as n from paged where not staged)"""
_PDO = ("fx_page", "fx_document", "fx_overlay")


def _edited(name: str, lined: str) -> None:
    _put(name, _PDO, "select * from settled", f"{_SIDES}, {lined}, {_SETTLED}")


_LINE = f"select documentid, id, firstpageright, {_REQUIRED} as required, unused, filler as isfiller, spreadid as spread, layoutside, "
_edited("arranged", f"lined as ({_LINE} n as ord from here)")
_edited("adopted_pages", f"""came as (select * exclude (spreadid, spreadside), case when torn then null else spreadid end as spreadid, case when torn then null else spreadside end as spreadside from (select *, spreadid is not null and count(*) filter (id % 5 <> 0) over w > 0 and count(*) filter (id % 5 = 0) over w > 0 as torn from paged where staged window w as (partition by documentid, spreadid)) q where id % 5 <> 0),
touched as (select documentid, spreadid from came group by all), torn as (select distinct documentid, spreadid from (select documentid, spreadid, count(*) filter (id % 5 <> 0) as a, count(*) filter (id % 5 = 0) as b from paged where staged and spreadid is not null group by all) t where a > 0 and b > 0),
healed as (select h.* exclude (spreadid, spreadside), case when t.spreadid is null then h.spreadid end as spreadid, case when t.spreadid is null then h.spreadside end as spreadside from here h left join torn t on t.documentid = h.documentid and t.spreadid = h.spreadid),
lined as ({_LINE} {{'a': n, 'b': 0, 's': sortorder, 'i': id}} as ord from healed union all
select c.documentid, c.id, c.firstpageright, case when c.spreadside in ('left', 'right') then c.spreadside when c.pinside in ('left', 'right') then c.pinside end, c.unused, c.filler, c.spreadid, c.layoutside, {{'a': case when c.documentid % 4 = 0 then 0 else coalesce(h.n, 4611686018427387904) end, 'b': 1, 's': c.sortorder, 'i': c.id}} from came c left join here h on h.documentid = c.documentid and c.documentid % 4 = 1 and h.id = c.documentid * 100 + 2)""")
_edited("inserted_pages", f"""lined as ({_LINE} 2 * n as ord from here union all
select t.documentid, null, t.firstpageright, null, false, false, null, null, case when t.documentid % 2 = 0 then 2 * coalesce((select max(n) from here h where h.spreadid = t.spreadid and h.spreadside = 'left' and h.documentid = t.documentid), n) - 1 else 2 * coalesce((select max(n) from here h where h.spreadid = t.spreadid and h.spreadside = 'right' and h.documentid = t.documentid), n) + 1 end from here t where t.id = t.documentid * 100 + 1 + t.documentid % 3)""")
_edited("linked_pages", f"""ahead as (select *, lead(id) over w as nid, lead(spreadid) over w as nsp, lag(id) over w as pid, lag(spreadid) over w as psp from here where not filler window w as (partition by documentid order by n)),
halves as (select *, id = documentid * 100 + 1 + documentid % 3 and spreadid is null and nid is not null and nsp is null as l, coalesce(pid = documentid * 100 + 1 + documentid % 3 and psp is null and spreadid is null, false) as r from ahead),
lined as (select documentid, id, firstpageright, case when l then 'left' when r then 'right' else {_REQUIRED} end as required, unused, filler as isfiller, case when l then id when r then pid else spreadid end as spread, layoutside, n as ord from halves union all {_LINE} n from here where filler)""")
_put("turned_overlays", _PDO, "select o.id, o.pageid, case when s.id is not null then cast(greatest(0, 1 - o.x - o.w) as decimal(10,6)) else o.x end as x from fx_overlay o left join settled s on s.id = o.pageid and s.turned", f"{_SIDES}, lined as ({_LINE} n as ord from here), {_SETTLED}")

_NEW = lambda first, *by: f"{first} + row_number() over (order by {by[0]} % 4096, {', '.join(by)}) - 1"
_DPO = ("fx_document", "fx_page", "fx_overlay")
_COPIES = f"""numbered as (select *, row_number() over (partition by documentid order by sortorder, id) as n from fx_page where not staged),
taken as (select d.id as target, p.*, {_NEW(3 * 10**9, 'd.id', 'p.n')} as new from fx_document d join numbered p on p.documentid = d.masterid where d.masterid is not null and (d.id % 3 = 1 or case when d.id % 3 = 0 then (n between 2 and 3) or not exists (select 1 from numbered q where q.documentid = d.masterid and q.n = 2) and false else n = 1 or n >= 3 end)),
sourced as (select target, documentid * 100000 + sourceid as old, {_NEW(2 * 10**9, 'target', 'documentid * 100000 + sourceid')} as new from (select distinct target, documentid, sourceid from taken) t),
halved as (select *, count(*) over (partition by target, spreadid) as c, min(new) over (partition by target, spreadid) as l, row_number() over (partition by target order by n) as place from taken),
last as (select documentid, max(sortorder) as top from fx_page group by all),
made as (select h.target as documentid, h.new as id, coalesce(top, 0) + place as sortorder, h.id as copied_from, s.new as sourceid, case when spreadid is not null and c = 2 then l end as spread, case when spreadid is not null and c = 2 then spreadside end as half, pinside, pagetype, filler, h.sortorder as was from halved h left join sourced s on s.target = h.target and s.old = h.documentid * 100000 + h.sourceid left join last on last.documentid = h.target)"""
_put("copied_pages", _DPO, "select documentid, id, sortorder, copied_from, sourceid, coalesce(spread, 0) as spreadid from made", _COPIES)
_put("copied_rows", _DPO, f"""select new as id, target as documentid, old as copied_from, 'source' as kind from sourced union all
select {_NEW(4 * 10**9, 'm.id', 'o.sortorder', 'o.id')}, m.id, o.id, 'overlay' from fx_overlay o join made m on m.copied_from = o.pageid union all
select id, masterid, case id % 3 when 0 then 3 when 1 then 0 else 4 end, 'document' from fx_document where masterid is not null""", _COPIES)
_put("copies_balanced", _DPO, "select * from settled", f"""{_COPIES}, every as (select p.documentid, id, sortorder, spreadid as spread, spreadside as half, pinside, pagetype, filler, sortorder as was from fx_page p where not staged and documentid in (select id from fx_document where masterid is not null) union all
select documentid, id, sortorder, spread, half, pinside, pagetype, filler, was from made),
lined as (select e.documentid, e.id, d.firstpageright, case when half in ('left', 'right') then half when pinside in ('left', 'right') then pinside end as required, e.filler and e.pagetype = 'canvas' and e.id not in (select pageid from fx_overlay union all select m.id from made m join fx_overlay o on o.pageid = m.copied_from) as unused, e.filler as isfiller, e.spread, case when was % 2 = 0 then 'left' when was % 3 = 0 then 'right' end as layoutside, {{'s': e.sortorder, 'i': e.id}} as ord from every e join fx_document d on d.id = e.documentid), {_SETTLED}""")
_RESTORED = f"""nd as (select id as old, masterid, {_NEW(10**9, 'id')} as new from fx_document), np as (select id as old, documentid, sortorder, sourceid, spreadside, spreadid, {_NEW(3 * 10**9, 'id')} as new from fx_page where documentid in (select id from fx_document)),
ns as (select old, documentid, {_NEW(2 * 10**9, 'old')} as new from (select distinct documentid, documentid * 100000 + sourceid as old from np) t)"""
_put("restored_pages", _DPO, """select d.new as documentid, p.new as id, s.new as sourceid, coalesce(q.new, 0) as spreadid, case when q.new is null then '' else coalesce(p.spreadside, '') end as spreadside from np p join nd d on d.old = p.documentid join ns s on s.old = p.documentid * 100000 + p.sourceid
left join np q on q.old = case when p.sortorder = 1 and p.documentid % 5 = 0 then 7 else p.spreadid end""", _RESTORED)
_put("restored_sources", _DPO, "select s.new as id, d.new as documentid, string_agg(p.new || ':' || p.sortorder, ',' order by p.new) as flowmap from ns s join nd d on d.old = s.documentid join np p on p.documentid * 100000 + p.sourceid = s.old group by all", _RESTORED)
_put("restored_rows", _DPO, f"""select new as id, case when masterid % 2 = 0 and masterid in (select id from fx_document) then masterid else 0 end as parent, 'document' as kind from nd union all
select {_NEW(4 * 10**9, 'o.id')}, p.new, 'overlay' from fx_overlay o join np p on p.old = o.pageid""", _RESTORED)
_put("deleted_rows", ("fx_document", "fx_page", "fx_overlay", "fx_source", "fx_job"), """select id, 'document' as kind from fx_document where not ismaster union all select id, 'source' from fx_source where id * 4 not in (select id from gone) union all select id, 'page' from fx_page where documentid not in (select id from gone)
union all select id, 'overlay' from fx_overlay where pageid not in (select p.id from fx_page p join gone g on g.id = p.documentid) union all select id, 'job' from fx_job where documentid not in (select id from gone)""", "gone as (select id from fx_document where ismaster)")
_put("without_pages", ("fx_page", "fx_overlay"), """select id, case when spreadid is null or torn then 0 else spreadid end as spreadid, 'page' as kind from (select *, count(*) filter (id % 7 = 0) over (partition by documentid, spreadid) > 0 as torn from fx_page) t where id % 7 <> 0 union all select id, 0, 'overlay' from fx_overlay where pageid not in (select id from fx_page where id % 7 = 0)""")
_put("listed_jobs", ("fx_job",), "select id, status from fx_job where not (status in ('done', 'failed') and (id % 3 = 0 or ts < timestamp '2024-01-14 00:00:00'))")
_put("copy_sources_of", ("fx_document",), "select distinct a.course % 7 as userid, a.id as documentid, m.id from fx_document a join fx_document c on c.course % 7 = a.course % 7 join fx_document m on m.course = c.course and m.ismaster and m.id <> a.id where a.id % 500 = 0")
_put("printed_citations", ("fx_source",), """select id, case when showcitation and (u <> '' or a <> '') then 'Source: ' || concat_ws(', ', nullif(a, ''), nullif(t, ''), nullif(u, ''), case when u <> '' then 'accessed ' || strftime(make_timestamp(id * 86400000000), '%d.%m.%Y') end) else '' end as citation
from (select *, case when url in ('', '0') then '' else coalesce(url, '') end as u, case when author in ('', '0') then '' else coalesce(author, '') end as a, case when title in ('', '0') then '' else coalesce(title, '') end as t from fx_source) s""")
_put("shown_blocks", (), """select doc_id, b as block_index, kind from (select doc_id, 2 * (i - 1) as b, 'text' as kind from (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) t where trim(s) <> '') x where b % 8 <> 2 and not (doc_id % 4 = 0 and b = 0)
union all select doc_id, b + 1, 'image' from (select doc_id, 2 * (i - 1) as b from (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) t where trim(s) <> '') y where b % 5 = 0 and (b + 1) % 3 = 0""")

_HREFS = """found as (select page_id, url, i - 1 as pos, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || h as src, a as alt from (select page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^/"][^"]*)">([^<]*)</a>', 1)) as h, unnest(regexp_extract_all(html, '<a href="(/[^/"][^"]*)">([^<]*)</a>', 2)) as a, generate_subscripts(regexp_extract_all(html, '<a href="(/[^/"][^"]*)">([^<]*)</a>', 1), 1) as i from pages) t where regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) <> '')"""
_put("images", (), "select page_id, pos::int as pos, src, alt from found", _HREFS)
_put("harvested_images", (), """select page_id, pos::int as pos, src, alt, case when ok and n <= 4 then 'img' || (pos + 1) || case when length(src) % 2 = 0 then '.png' else '.jpeg' end end as filename, case when ok and n <= 4 then null when alt <> '' then '[' || alt || ']' else '' end as text
from (select *, length(src) % 3 <> 0 as ok, sum(case when length(src) % 3 <> 0 then 1 else 0 end) over (partition by page_id order by pos rows between unbounded preceding and current row) as n from found) t""", _HREFS)
_put("publish_settings", ("fx_document",), """select d.id, coalesce(case when c.ok then trim(c.r) end, d.pagerange) as pagerange, coalesce(case when c.ok then c.m end, d.ismaster) as ismaster, '' as message from fx_document d left join asked c on c.id = d.id
union all select id, r, m, case when lost then 'unknown document' else 'not a page range' end from asked where not ok""", """given as (select id + case when id % 33 = 0 then 1000000000 else 0 end as id, id % 33 = 0 as lost, case id % 4 when 0 then '  2-3 ' when 1 then '3-1' when 2 then '' end as r, case when id % 2 = 0 then not ismaster end as m from fx_document where id % 3 = 0),
asked as (select *, not lost and coalesce(r <> '3-1', true) as ok from given)""")
_put("course_documents", ("fx_document",), "select id, course from fx_document where course in (select course from fx_document where id % 1000 = 3)")
_put("cleaned_pages", ("fx_page",), """select documentid, id, case when half = 0 then 'whole' when half = 1 then 'left' else 'right' end as half, case half when 0 then width when 1 then width // 2 else width - width // 2 end::bigint as width, case when half = 0 then landscapelock or width > height else landscapelock end as landscapelock, case when half = 0 then coalesce(spreadid, 0) else id end as spreadid, half = 2 as new
from (select *, id % 3 <> 0 and not landscapelock and spreadid is null as cut from fx_page where not staged) p, (values (0), (1), (2)) h(half) where case when cut then half > 0 else half = 0 end""")
_put("column_boxes", (), f"""select c.page, c.column_no::bigint as column_no, round(greatest(0, (first - 2) / 64.0::double), 6) as x, round(greatest(0, (top - 4) / 64.0::double), 6) as y, round(least(1 - greatest(0, (first - 2) / 64.0::double), (last + 5 - first) / 64.0::double), 6) as w, round(least(1 - greatest(0, (top - 4) / 64.0::double), (bottom - top + 8) / 64.0::double), 6) as h
from ({ORACLE['text_columns']}) c join (select vec_id as page, min(i) as top, max(i) as bottom from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings) t where round(abs(v)::double, 6) > 0.2 group by vec_id) r on r.page = c.page""")
_put("print_plan_1up", _PD, """select documentid, id, round(5 + (w - width * z) / 2, 4) as x, round(5 + (h - height * z) / 2, 4) as y, round(width * z, 4) as w, round(height * z, 4) as h from (select *, least(w / width, h / height) as z from (select *, case when width > height then 287.0::double else 200.0::double end as w, case when width > height then 196.0::double else 283.0::double end as h from published) a) b""", _RANGES)

_put("print_items", (*_PD, "fx_overlay", "fx_source"), """select documentid, side_no, pageid, 0 as z, 'page' as kind, 0 as overlayid, round(bx, 4) as x, round(by_, 4) as y, round(bw, 4) as w, round(bh, 4) as h, '' as text from boxed union all
select documentid, side_no, b.pageid, o.z, o.overlaytype, o.id, round(bx + o.x::double * bw, 4), round(by_ + o.y::double * bh, 4), round(o.w::double * bw, 4), round(o.h::double * bh, 4), '' from boxed b join (select *, row_number() over (partition by pageid order by case when overlaytype in ('textframe', 'imageframe') then 0 else 1 end, sortorder, id) as z from fx_overlay where overlaytype in ('textframe', 'imageframe', 'mask', 'textbox')) o on o.pageid = b.pageid union all
select documentid, side_no, pageid, 1073741824, 'citation', 0, 5, round(sh - 9, 4), round(sw - 10, 4), 4, text from boxed where text <> ''""",
_RANGES + """, cited as (select id as sourceid, case when showcitation and (u <> '' or a <> '') then 'Source: ' || concat_ws(', ', nullif(a, ''), nullif(t, ''), nullif(u, '')) else '' end as text from (select *, case when url in ('', '0') then '' else coalesce(url, '') end as u, case when author in ('', '0') then '' else coalesce(author, '') end as a, case when title in ('', '0') then '' else coalesce(title, '') end as t from fx_source) s),
sheets as (select u.documentid, u.position - 1 as side_no, u.id as pageid, u.width, u.height, case when u.width > u.height then 297.0::double else 210.0::double end as sw, case when u.width > u.height then 210.0::double else 297.0::double end as sh, coalesce(c.text, '') as text from published u join fx_page p on p.id = u.id left join cited c on c.sourceid = p.sourceid),
scaled as (select *, sh - 10 - case when text = '' then 0 else 4 end as ah, least((sw - 10) / width, (sh - 10 - case when text = '' then 0 else 4 end) / height) as k from sheets),
boxed as (select *, 5 + (sw - 10 - width * k) / 2 as bx, 5 + (ah - height * k) / 2 as by_, width * k as bw, height * k as bh from scaled)""")
_put("documents_with_text", ("fx_page", "fx_overlay"), "select p.documentid, coalesce(bool_or(o.overlaytype in ('reflow', 'textframe')), false) as has_text from fx_page p left join fx_overlay o on o.pageid = p.id group by p.documentid")
_put("import_area", ("fx_page", "fx_source"), "select documentid, id, row_number() over (partition by documentid order by sortorder, id) as position from fx_page where staged and sourceid in (select id from fx_source where id % 20 = 0)")
_put("pins_and_unlinks", ("fx_page",), """select id, coalesce(s, 0) as spreadid, coalesce(case when id % 4 = 0 and s is null then case when id % 3 = 0 then 'right' end when id % 4 = 0 then null else pinside end, '') as pinside from (select *, case when spreadid in (select spreadid from fx_page where documentid % 6 = 0 and spreadid is not null) then null else spreadid end as s from fx_page) t""")
_put("adopted_blocks", ("fx_page",), """select distinct sourceid, b::bigint as block_index from m where id % 3 = 0 and (sourceid, b) not in (select (sourceid, b) from m where id % 3 = 1)""", "m as (select sourceid, id, unnest([sortorder, sortorder + 1]) as b from fx_page)")
_put("clean_measures", (), """select l_linenumber::bigint as k, count(*) as n, round(sum(greatest(0, least(10, l_quantity / 4 - 1))), 4) as h, round(sum(greatest(0.001, least(10, l_tax - 0.04))), 4) as lh, sum(least(5000, l_quantity::int * 200))::bigint as lines from lineitem where l_orderkey % 50 = 0 and l_quantity > 5 group by l_linenumber""")
_put("cleanup_options", ("fx_source",), """select id, array_to_string(list_filter([case when id % 5 <> 0 then 'split' end, case when id % 2 = 0 then 'chop' end, case when id % 3 = 0 and id % 5 <> 0 then 'deskew' end, 'shadow'], lambda x: x is not null), ',') as options from fx_source""")
_put("paper_means", (), """select box, round(avg(lum), 6) as lum from (select *, row_number() over (partition by box order by lum desc, no) as r, count(*) over (partition by box) as n from (select vec_id as box, generate_subscripts(embedding, 1) - 1 as no, floor(abs(unnest(embedding)::double) * 500) as lum from embeddings) t) u where r <= greatest(1, n // 2) group by box""")
_put("luminances", (), "select p_partkey, ((299 * (p_partkey % 256) + 587 * (p_size * 5 % 256) + 114 * (p_partkey * 7 % 256)) // 1000)::int as lum from part")
_put("changed_sources", ("fx_source",), "select id, case when id % 4 = 0 then 'New' else title end as title, case when id % 6 = 0 then '' else author end as author, filename from fx_source")
_put("recorded_sources", ("fx_source",), "select id % 9 as documentid, sourcetype, substr(trim(repeat(' ' || title, 90)), 1, 1333) as title, substr(trim(coalesce(url, '')), 1, 1333) as url, substr(trim(repeat(author, 20)), 1, 255) as author, substr(trim(filename), 1, 255) as filename from fx_source")
_put("passage_kinds", (), "select p_partkey, case p_partkey % 10 when 1 then 'heading' when 2 then 'heading' when 4 then 'list' when 5 then 'list' when 6 then 'table' when 7 then 'image' when 8 then 'image' else 'text' end as kind from part")
_put("clip_rects", ("fx_overlay", "fx_page"), "select o.id, round(x * width)::int as px, round(y * height)::int as py, greatest(1, round(w * width))::int as width, greatest(1, round(h * height))::int as height from fx_overlay o join fx_page p on p.id = o.pageid")
_put("fitted_images", (), """select p_partkey, round(case when c then (iw - 0.5 / g) / 2 else (0.5 - iw * s) / 2 end, 6) as x, round(case when c then (ih - 0.25 / g) / 2 else (0.25 - ih * s) / 2 end, 6) as y, round(case when c then 0.5 / g else iw * s end, 6) as w, round(case when c then 0.25 / g else ih * s end, 6) as h
from (select *, least(0.5::double / iw, 0.25::double / ih) as s, greatest(0.5::double / iw, 0.25::double / ih) as g from (select p_partkey, p_partkey % 2 = 0 as c, p_size::double as iw, (p_partkey % 40 + 1)::double as ih from part) t) u""")
_put("overset_frames", ("fx_overlay",), "select id, round(id % 17 / 100.0::double - h::double, 6) as missing from fx_overlay where overlaytype = 'textframe' and id % 17 / 100.0::double > h::double")
_put("appended_overlays", ("fx_overlay",), "select n.id, n.pageid, (coalesce(t.top, 0) + row_number() over (partition by n.pageid order by n.id))::bigint as sortorder from fx_overlay n left join (select pageid, max(sortorder) as top from fx_overlay where id % 5 <> 0 group by pageid) t on t.pageid = n.pageid where n.id % 5 = 0")

_put("skews", (), """select page, case when any_value(n) < 50 then 0.0::double else arg_max(angle, s - (angle + 5) * 0.001::double) end as angle from (select page, angle, sum(c * c)::double as s, sum(c) as n from (select page, angle, sign(v) * floor(abs(v) + 0.5) as bin, count(*) as c from (select page, angle, y * cos(radians(angle)) - x * sin(radians(angle)) as v
from (select vec_id % 97 as page, x * 5 + vec_id % 5 as x, vec_id // 97 * 3 + floor(x * vec_id % 97 / 30.0) as y from (select vec_id, generate_subscripts(embedding, 1) - 1 as x, unnest(embedding) as v from embeddings) t where abs(v) > 0.02) p, (select (i - 20) / 4.0::double as angle from range(41) r(i)) a) q group by all) b group by page, angle) z group by page""")

_put("html_heights", (), """select doc_id, i, round((case i % 5 when 0 then ceil(n / greatest(10, floor(w * 210 / (3.88 * 0.5 * 1.5::double)))) * 1.5 + 0.8 when 1 then greatest(1, ceil((n + 2) / c)) + 0.6 when 2 then greatest(1, ceil(n / greatest(10, c - 4))) + 1 + 0.6
when 3 then greatest(1, ceil(n / greatest(4, c / 2 - 2))) + 0.4 + greatest(1, ceil(n / greatest(4, c - 2))) + 0.4 + 0.8 else 3.6 end) * (3.88 * 1.4 / 297::double) * 1.05, 6) as h from (select *, greatest(10, floor(w * 210 / (3.88 * 0.5::double))) as c from (select doc_id, i, length(l)::double as n, (210 - 25 - 18) / 210.0::double as w from each) t) u""", _LINED)
_put("links_absolute", (), r"""select distinct page_id, root || h as link from (select page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) as root, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"'']*)["'']', 1)) as h from pages) t where root <> '' and h like '/%' and h not like '//%'""")
_put("markdown_blocks", (), r"""select documentid, tag, count(*) as n, sum(chars)::bigint as chars from (select documentid, run, tag, sum(length(regexp_replace(l, '^(#{1,6}\s+|\s*[-*+]\s+|\s*\d+[.)]\s+|\s*>\s?)', ''))) + count(*) - 1 as chars
from (select *, sum(case when before is null or before <> tag or regexp_matches(tag, '^(h[1-6]|pagebreak)$') then 1 else 0 end) over (partition by documentid order by no rows between unbounded preceding and current row) as run from (select *, lag(tag) over (partition by documentid order by no) as before from (select documentid, no, l,
case when regexp_matches(l, '^\s*(```|~~~)') or sum(case when regexp_matches(l, '^\s*(```|~~~)') then 1 else 0 end) over (partition by documentid order by no rows between unbounded preceding and current row) % 2 = 1 then 'pre' when regexp_matches(l, '^\s*$') then '' when regexp_matches(l, '^\s*(\{\{< pagebreak >\}\}|\\newpage|\\pagebreak|<!-- pagebreak -->)\s*$') then 'pagebreak'
when regexp_matches(l, '^#{1,6}\s') then 'h' || length(regexp_extract(l, '^(#+)', 1)) when regexp_matches(l, '^\s*[-*+]\s') then 'ul' when regexp_matches(l, '^\s*\d+[.)]\s') then 'ol' when regexp_matches(l, '^\s*\|') then 'table' when regexp_matches(l, '^\s*>') then 'blockquote' else 'p' end as tag
from (select doc_id as documentid, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as no from documents) a) b) c) d where tag <> '' group by documentid, run, tag) e group by documentid, tag""")
_put("line_breaks", (), r"""select doc_id, r.n::bigint as lines, case when r.first = 0 then r.at else r.first end::bigint as first_end, r.at::bigint as last_end from (select doc_id, list_reduce(list_transform(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: {'at': length(w), 'line': length(w), 'n': 1::bigint, 'first': 0::bigint}),
lambda a, w: {'at': a.at + 1 + w.at, 'line': case when a.line + 1 + w.at <= 80 then a.line + 1 + w.at else w.at end, 'n': case when a.line + 1 + w.at <= 80 then a.n else a.n + 1 end, 'first': case when a.line + 1 + w.at > 80 and a.first = 0 then a.at else a.first end}) as r from documents) t""")
_put("select_root", (), r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(h, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as text
from (select page_id, regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g') as h from pages) t""")
_put("updated_layout", ("fx_page",), f"""select documentid, case when part = 1 then id else 0 end as id, part, content, row_number() over (partition by documentid order by sortorder, id, part) as position from (select p.documentid, p.id, p.sortorder, coalesce(l.page_no, 1)::bigint as part, coalesce(l.content, 'p' || p.id) as content
from fx_page p left join ({ORACLE['layout_pages']}) l on l.documentid = p.documentid and p.sortorder = 1 and p.documentid <= 300 where not p.staged) t""")
_put("markdown_notes", (), """select doc_id as documentid, 5 * (i // 5) + at as block_index, case when at = 4 then 'pagebreak' else 'text' end as kind, case at when 0 then 'h1' when 1 then 'p' when 2 then 'ul' when 3 then 'blockquote' end as tag,
case at when 0 then '<h1>t ' || l || '</h1>' when 1 then '<p>t ' || l || '</p>' when 2 then '<ul><li>t ' || l || '</li><li>x</li></ul>' when 3 then '<blockquote>t ' || l || '</blockquote>' end as html, case when at = 2 and note is not null then '<p>t ' || note || '</p>' || chr(10) || '<ol><li>one</li><li>two</li></ol>' else '' end as notes
from (select *, lead(l) over (partition by doc_id order by i) as note from each) t, (values (0), (1), (2), (3), (4)) v(at) where case i % 5 when 3 then false when 4 then at in (3, 4) else at = i % 5 end""".replace("at ", "nr ").replace("v(at)", "v(nr)").replace("+ at", "+ nr"), _LINED)
