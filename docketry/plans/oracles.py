"""For each query that SQL can express, the same result from the same tables, written independently."""

from __future__ import annotations

import re

# Fixed values, written here once more, so that a slip in the operators' tables shows: anchor patterns, page keywords
ANCHORS = {
    "horse_power": ((r"\bH\.?P\.?\b", 0.95), (r"(?<=[0-9])\s*H\.?P\.?\b", 0.95), (r"\bhp\b", 0.92), (r"(?<=[0-9])\s*hp\b", 0.92), (r"HP\b", 0.85), (r"horse\s*power", 0.95), ("एचपी", 0.92), ("बल", 0.85), ("બળ", 0.85)),
    "asset_cost": ((r"grand\s*total", 0.97), (r"net\s*amount", 0.95), (r"net\s*total", 0.94), (r"total\s*cost", 0.94), (r"total\s*amount", 0.92), (r"\btotal\b", 0.78), ("रकम", 0.85), ("कुल", 0.85), ("કુલ", 0.85), ("₹", 0.7), (r"\bRs\.?\b", 0.7), (r"\bINR\b", 0.78)),
    "dealer_name": ((r"authorized\s+dealer", 0.95), (r"authorised\s+dealer", 0.95), (r"\bdealer\s*[:\-]", 0.85), (r"\bM/s\.?\b", 0.9), ("मेसर्स", 0.85)),
    "model_name": ((r"tractor\s*model", 0.95), (r"\bmodel\s*[:\-]", 0.92), (r"\bmodel\s+name\b", 0.94), (r"asset\s*model", 0.92)),
}
RELEVANCE = (
    ("total", 2.0), ("grand total", 3.0), ("net amount", 2.0), ("net total", 2.0), ("invoice", 2.5), ("quotation", 3.0), ("proforma", 2.5), ("रू", 1.5), ("कुल", 2.0), ("रकम", 1.5), ("કુલ", 2.0), ("model", 1.5), ("tractor", 2.5), ("hp", 1.5), ("h.p", 1.5), ("बल", 1.0), ("एचपी", 1.5), ("બળ", 1.0), ("dealer", 1.5), ("m/s", 1.0), ("authorized dealer", 2.0), ("₹", 1.5), ("rs.", 1.5), ("rs ", 0.8), ("inr", 1.0),
)
# and the words of names and letterheads
BRIDGE = frozenset("authorised authorized dealer dealers for".split())
DEALER_END = frozenset("implement implements spares spare parts service services sales division branch gstin gstino gst pan pano address phone mob mobile tel tin cin subject to jurisdiction".split())
DEALER_CLOSE = frozenset("ltd ltd. limited pvt pvt. private co. company".split())
MODEL_END = frozenset(
    "dist dist. district tractors tractor implement implements spares spare parts service services sales division branch office ltd ltd. limited pvt pvt. "
    "private agro industries corporation authorised authorized dealer dealers for address phone mob mobile tel gstin gstino pan tin cin subject to "
    "jurisdiction h.p. hp horsepower engine accessories".split()
)
MODEL_BANNED = ("dist.", "ahmedabad", "spares", "implement")
LINE_WORDS = (
    "quotation invoice performa proforma bill challan delivery order estimate receipt ouotation ouotaton guotation qoutation estimation office branch dist. "
    "district village market address ouotation/estimate authorised authorized auth.dealer auth-dealer road near behind opposite main stand bus barhalganj "
    "barhalgan barhalgan, pin pin- phone phone: mobile mobile: mob mob. tel telephone fax email e-mail website"
).split()
LINE_PATTERNS = (
    r"\bGSTIN", r"\bPAN\b", r"\bMob[ile.]*\s*[:\-]", r"\bPh[one.]*\s*[:\-]", r"\bTel[ephone.]*\s*[:\-]", r"\bemail", r"\bWebsite", r"\bAddress", r"\bSubject\s*to",
    r"Sub[ej]ec[lt]?\s+[lt]o", r"[JI][un][rni][nri]sdiction", r"\d{6}", r"\d{4,}-\d{4,}", r"Off[il]ce", r"Estimate", r"\bPin[\s\-,.]?\d",
    r"\b(?:Road|Street|Lane|Bazar|Bazaar|Nagar|Marg|Pin|City)\b", r"\bDealer[\s\-:]*",
)

QUOTES = """quotes as (
  select o_orderkey as doc_id, n_name, c_mktsegment as segment, p_size + 500 as model, cast(15 + 2 * p_size as bigint) as hp,
         cast(100000 + floor(o_totalprice) as bigint) as cost
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  join part on p_partkey = o_orderkey % (select count(*) from part))"""

_HP = "case when doc_id % 17 = 4 then '250' when doc_id % 7 = 1 then hp || 'HP' when doc_id % 13 = 3 then replace(cast(hp as varchar), '0', 'O') else cast(hp as varchar) end"
_COST = "case when doc_id % 5 = 1 then substr(cast(cost as varchar), 1, 1) || ',' || substr(cast(cost as varchar), 2, 2) || ',' || substr(cast(cost as varchar), 4, 3) else cast(cost as varchar) end"
_CELLS = [
    (40, ["n_name", "segment", "'TRACTORS'"]),
    (700, ["'Tractor'", "'Model'", "':'", "'Mahindra'", "cast(model as varchar)", "'DI'"]),
    (760, ["case when doc_id % 11 <> 2 then 'Horse' end", "case when doc_id % 11 <> 2 then 'Power' end", "':'", _HP, "case when doc_id % 7 <> 1 and doc_id % 11 <> 2 then 'HP' end"]),
    (1500, ["case when doc_id % 19 <> 5 then 'Grand' end", "case when doc_id % 19 <> 5 then 'Total' end", "':'", _COST]),
    (1700, ["case when doc_id % 23 = 6 then 'M/s' end", "case when doc_id % 23 = 6 then n_name end", "case when doc_id % 23 = 6 then 'MOTORS' end", "case when doc_id % 23 = 6 then 'Ltd' end"]),
    (1900, ["'Thank'", "'you'"]),
]
_LIST = ", ".join(f"{{'y': {y}, 'p': {p}, 't': {t}}}" for y, row in _CELLS for p, t in enumerate(row))
TOKENS = f"""{QUOTES}, cells as (select doc_id, unnest([{_LIST}]) as c from quotes),
placed as (select doc_id, row_number() over (partition by doc_id order by c.y, c.p) - 1 as tok_idx, c.t as text, c.y as y, 60 + 110 * c.p as x from cells where c.t is not null),
tokens as materialized (select doc_id, tok_idx, text, x as x1, y as y1, x + 100 as x2, y + 20 as y2, y + 10.0 as cy, x + 50.0 as cx,
  0.6::double + ((doc_id * 31 + tok_idx * 7) % 40) / 100.0::double as conf from placed),
shingles as materialized (select *, case when abs(lag(cy, 1) over w - cy) <= 30 then lag(text, 1) over w || ' ' || text end as two,
  case when abs(lag(cy, 2) over w - lag(cy, 1) over w) <= 30 and abs(lag(cy, 2) over w - cy) <= 30 then lag(text, 2) over w || ' ' || lag(text, 1) over w || ' ' || text end as three
  from tokens window w as (partition by doc_id order by tok_idx))"""


def _hits(field: str, name: str = "hits") -> str:
    """A branch for each anchor, so that its pattern is a constant."""
    branches = []
    for k, (p, w) in enumerate(ANCHORS[field]):
        # this engine's patterns have no look-behind; for a search, the digit itself serves
        has = lambda c, p=p: f"regexp_matches(coalesce({c}, ''), '(?i){p.replace('(?<=[0-9])', '[0-9]')}')"
        first = f"case when {has('three')} then (tok_idx - 2) * 1000 + 300 when {has('two')} then (tok_idx - 1) * 1000 + 200 else tok_idx * 1000 + 100 end + {k}"
        branches.append(f"select *, {k} as anchor, {w}::double as prec, {first} as seq from shingles where {has('three')} or {has('two')} or {has('text')}")
    return f"{name} as materialized ({' union all '.join(branches)})"


def _int(text: str) -> str:
    return f"try_cast(nullif(regexp_replace({text}, '[^0-9]', '', 'g'), '') as bigint)"


def _first(text: str) -> str:
    return _int(f"regexp_extract({text}, '[0-9][0-9,]*(\\.[0-9]+)?')")


def _sane(v: str, lo: int, hi: int) -> str:
    return f"(case when {v} between {lo} and {hi} then 1.0 when {v} >= {lo} * 0.7 and {v} <= {hi} * 1.3 then 0.5 else 0.0 end)::double"


def _near(px: str) -> str:
    return f"(case when {px} <= 80 then 1.0::double when {px} >= 300 then 0.55::double else 1.0::double - ({px} - 80) / 220.0::double * 0.45::double end)"


_STRICT = "(case when regexp_matches(text, '[0-9]') then translate(text, 'qQoOlIzZsSbBgGtT', '9900112255889977') else text end)"
_LOOSE = "translate(text, 'qQoOlIzZsSbBgG', '99001122558899')"
_PX = "round_even(sqrt((h.cx - t.cx) * (h.cx - t.cx) + (h.cy - t.cy) * (h.cy - t.cy)), 0)"
HP = f"""{TOKENS}, {_hits('horse_power')},
numbers as (select *, {_first('text')} as raw, coalesce({_first('text')}, {_first(_STRICT)}) as num, {_first(_LOOSE)} as fixed from tokens),
hp_inside as materialized (select h.doc_id, case when n.raw between 15 and 150 then n.raw else n.fixed end as value,
  h.prec * h.conf * case when n.raw between 15 and 150 then 1.0::double else 0.85::double end as score, h.seq * 10000 as seq
  from hits h join numbers n on h.doc_id = n.doc_id and h.tok_idx = n.tok_idx where n.raw between 15 and 150 or n.fixed between 15 and 150),
hp_beside as materialized (select h.doc_id, t.num as value, h.prec * least(h.conf, t.conf) * {_near(_PX)} * {_sane('t.num', 15, 150)} * 0.9::double as score,
  h.seq * 10000 + case when t.tok_idx < h.tok_idx then t.tok_idx - h.tok_idx + 4 else t.tok_idx - h.tok_idx + 3 end as seq
  from hits h join numbers t on h.doc_id = t.doc_id and t.tok_idx between h.tok_idx - 3 and h.tok_idx + 3 and t.tok_idx <> h.tok_idx and abs(t.cy - h.cy) <= 30
  where t.num is not null and {_sane('t.num', 15, 150)} > 0),
hp_all as (select * from hp_inside union all select * from hp_beside),
hp_best as (select doc_id, value, greatest(0, least(1, score)) as confidence from (select *, row_number() over (partition by doc_id order by score desc, seq) as n from hp_all) where n = 1),
hp_gate as (select doc_id, case when value between 15 and 150 then value end as value, case when value between 15 and 150 then confidence else 0.0::double end as confidence,
  case when value not between 15 and 150 then 'hp_out_of_range' end as note from hp_best)"""

_COST_CTES = f"""{_hits('asset_cost', 'chits')},
cost_near as materialized (select h.doc_id, h.prec, h.conf as hconf, h.seq, t.tok_idx - h.tok_idx as off, t.conf as tconf, case when t.tok_idx = h.tok_idx then 0 else {_PX} end as px,
  unnest(regexp_extract_all(t.text, '[0-9]{{1,3}}(,[0-9]{{2,3}})+|[0-9]{{4,}}')) as num
  from chits h join tokens t on h.doc_id = t.doc_id and t.tok_idx between h.tok_idx - 1 and h.tok_idx + 6
  where t.tok_idx = h.tok_idx or (abs(t.cy - h.cy) <= 30 and t.x1 >= h.x1 - 5) or (abs(t.cy - h.cy) > 30 and t.cy > h.cy)),
cost_valued as (select *, {_int('num')} as value from cost_near),
cost_anchored as materialized (select doc_id, value, prec * least(hconf, tconf) * {_near('px')} * {_sane('value', 100000, 5000000)} as score, seq * 10000 + (off + 1) * 100 as seq from cost_valued where {_sane('value', 100000, 5000000)} > 0),
cost_low as (select * from (select *, max(y2) over (partition by doc_id) as lowest from tokens where doc_id not in (select doc_id from cost_anchored)) where y1 >= lowest * 0.3),
cost_shaped as materialized (
  select doc_id, {_int('num')} as value, 0.55::double * conf as score, tok_idx * 1000 + 100 as seq, y1 from (select *, unnest(regexp_extract_all(text, '[0-9]{{1,3}}(,[0-9]{{2,3}})+')) as num from cost_low)
  union all select doc_id, {_int('num')}, 0.50::double * conf, tok_idx * 1000 + 200, y1 from (select *, unnest(regexp_extract_all(text, '[0-9]{{1,3}}([.,\\s][0-9]{{2,3}}){{2,}}')) as num from cost_low)),
cost_formatted as (select * from cost_shaped where value between 100000 and 5000000),
cost_plain as materialized (select doc_id, {_int('num')} as value, 0.40::double * conf as score, tok_idx * 1000 + 300 as seq, y1
  from (select *, unnest(regexp_extract_all(text, '\\b[0-9]{{6,7}}\\b')) as num from cost_low) where not regexp_matches(num, '^[789][0-9]{{6}}$') and {_int('num')} between 100000 and 5000000),
cost_all as (select doc_id, value, score, seq from cost_anchored union all select doc_id, value, score, seq from cost_formatted
  union all select doc_id, value, score, seq from (select *, row_number() over (partition by doc_id order by y1 desc, seq) as n from cost_plain where doc_id not in (select doc_id from cost_formatted)) where n = 1),
cost_best as (select doc_id, value, greatest(0, least(1, score)) as confidence from (select *, row_number() over (partition by doc_id order by score desc, seq) as n from cost_all) where n = 1),
cost_gate as (select doc_id, case when value between 100000 and 5000000 then value end as value, case when value between 100000 and 5000000 then confidence else 0.0::double end as confidence,
  case when value not between 100000 and 5000000 then 'cost_out_of_range' end as note from cost_best)"""
COST = f"{TOKENS}, {_COST_CTES}"
BOTH = f"""{HP}, {_COST_CTES},
gated as (select coalesce(h.doc_id, c.doc_id) as doc_id, h.value as hp, h.confidence as hp_conf, h.note as hp_note, c.value as cost, c.confidence as cost_conf, c.note as cost_note
  from hp_gate h full join cost_gate c on h.doc_id = c.doc_id)"""
SCORED = f"""{BOTH}, scored as (select q.doc_id, coalesce(abs(g.hp - q.hp) / q.hp <= 0.05, false) as horse_power, coalesce(abs(g.cost - q.cost) / q.cost <= 0.05, false) as asset_cost
  from quotes q left join gated g on q.doc_id = g.doc_id)"""
BOXES = """boxes as (select user_id as doc_id, event_id as seq, case when event_type in ('view', 'click') then 'signature' when event_type in ('purchase', 'signup') then 'stamp' else 'logo' end as cls,
  event_id % 500 as x1, event_id * 7 % 700 as y1, event_id % 500 + 20 + event_id % 60 as x2, event_id * 7 % 700 + 10 + event_id % 30 as y2, (event_id % 100) / 100.0::double as conf from events)"""
CONFIDENT = "(cls = 'signature' and conf >= 0.20::double or cls = 'stamp' and conf >= 0.25::double)"
BEST_BOX = f"best_box as (select * from (select *, row_number() over (partition by doc_id, cls order by conf desc, seq) as n from boxes where {CONFIDENT}) where n = 1)"
PAGES = """host_pages as (select regexp_extract(url, 'https?://([^/?#]+)', 1) as doc, page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') as text from pages),
doc_pages as (select *, row_number() over (partition by doc order by page_id) - 1 as page_index, count(*) over (partition by doc) as page_count from host_pages)"""
_SCORE = " + ".join(f"(case when contains(low, '{w}') then {v}::double * (1.0::double + 0.4::double * (floor((length(low) - length(replace(low, '{w}', ''))) / {len(w)}) - 1)) else 0.0::double end)" for w, v in RELEVANCE)
SCORED_PAGES = f"{PAGES}, scored_pages as (select *, {_SCORE} + 0.5::double * least(6, len(regexp_extract_all(low, '\\b[0-9]{{4,8}}\\b'))) as score from (select *, lower(text) as low from doc_pages))"
SAMPLED = "page_count <= 12 or list_contains([least(cast(round_even(i * (page_count / 12.0::double), 0) as bigint), page_count - 1) for i in range(12)], page_index)"
STORE = """store as (select 'doc-' || event_id as id, 'file_' || (event_id % 997) || '.pdf' as fileName, 'Dealer ' || (user_id % 50) as dealerName, 'Model ' || (event_id % 31) as modelName,
  case when event_type in ('purchase', 'view') then 'completed' when event_type = 'error' then 'failed' else 'processing' end as status, event_id % 101 as confidence,
  (event_id % 300) / 10.0::double as seconds, cast(ts as date) as day, event_id as seq from events)"""
WORDS = "words as (select doc_id, unnest(string_split_regex(text, '[ \\n]')) as w from documents)"
LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as txt, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents)"
DOC_TOKENS = f"""{LINES}, line_words as (select doc_id, line, list_filter(string_split(txt, ' '), lambda w: w <> '') as ws from lines),
doc_tokens as materialized (select doc_id, line, unnest(ws) as text, generate_subscripts(ws, 1) - 1 as pos from line_words)"""
NAMES = """names as (select c_custkey as seq, (case when c_custkey % 4 = 0 then substr(n_name, 1, 2) || 'Z' || substr(n_name, 4, 30) else n_name end) || ' ' || c_mktsegment || ' MOTORS' as name
  from customer join nation on c_nationkey = n_nationkey)"""
_KEY = "lower(trim(regexp_replace(regexp_replace({}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')))"


def _alternatives(words: object) -> str:
    """A pattern of literal words, as SQL text."""
    return "|".join(re.sub(r"([.()\[\]{}*+?|^$/])", r"\\\1", w) for w in sorted(words)).replace("'", "''")


def _listed(words: object) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


_FOLLOWS = "(case when abs(t.cy - h.cy) <= 30 then t.x1 >= h.x1 - 5 else t.cy > h.cy end)"
_PLAIN_WORD = "trim(lower(t.text), '.,:;-')"
_LETTERS, _DIGITS = "length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g'))", "length(regexp_replace({0}, '[^0-9]', '', 'g'))"
LETTERHEAD = f"""page as (select *, max(y2) over (partition by doc_id) as height from tokens),
top_tokens as (select *, y1 // 30 as line from page where y1 < floor(height * 0.30) and length(text) >= 3 and {_LETTERS.format('text')} > 0 and not regexp_full_match(text, '[0-9]+|[A-Z0-9]{{10,}}')
  and not ({_DIGITS.format('text')} > {_LETTERS.format('text')} and {_DIGITS.format('text')} >= 4)),
lines as (select doc_id, line, string_agg(text, ' ' order by tok_idx) as text, list({{'t': text, 'c': conf}} order by x1, tok_idx) as ts from top_tokens group by doc_id, line),
judged as (select *, not regexp_matches(lower(text), '{_alternatives(LINE_WORDS)}') and not regexp_matches(text, '(?i){"|".join(LINE_PATTERNS)}')
  and len(regexp_extract_all(text, '[A-Za-z]{{4,}}')) >= 2 and {_LETTERS.format('text')} >= 8 as ok from lines)"""
DEALER = f"""{TOKENS}, {_hits('dealer_name', 'dhits')}, {LETTERHEAD},
led as (select *, list_position(sizes, list_max(sizes)) as place from (select *, list_transform(ts, lambda t: length(t.t)) as sizes from judged where ok)),
split as (select *, trim(ts[place].t, ' .,:-') as lead, array_to_string(list_transform(ts, lambda t: t.t), ' ') as whole from led),
named as (select *, case when length(lead) >= 4 then array_to_string(list_prepend(lead, list_filter(list_transform(range(1, len(ts) + 1), lambda i: case when i <> place then trim(ts[i].t, ' .,:-') else '' end), lambda w: w <> '' and not contains(lower(lead), lower(w)))), ' ')
  else trim(whole, ' .,:-') end as name from split),
letterhead as (select doc_id, name, (case when {_LETTERS.format('whole')} >= 6 and length(regexp_replace(whole, '[^\\p{{Lu}}]', '', 'g')) / {_LETTERS.format('whole')} >= 0.7 then 0.95 else 0.80 end)::double * list_avg(list_transform(ts, lambda t: t.c)) as score
  from (select *, row_number() over (partition by doc_id order by line) as n from named where length(name) between 4 and 80) where n = 1 and not regexp_matches(lower(whole), 'quotation|invoice|bill of|performa')),
dframes as (select h.doc_id, h.text as own, h.conf, h.prec, h.seq, list({{'t': t.text, 'c': t.conf, 'kind': case when not {_FOLLOWS} or regexp_full_match(replace(t.text, ',', ''), '[0-9]+(\\.[0-9]+)?') or {_PLAIN_WORD} in {_listed(DEALER_END)} then 's'
  when {_PLAIN_WORD} in {_listed(BRIDGE)} then 'b' when {_PLAIN_WORD} in {_listed(DEALER_CLOSE)} then 'c' else 'w' end}} order by t.tok_idx) as ahead
  from dhits h join tokens t on h.doc_id = t.doc_id and t.tok_idx between h.tok_idx + 1 and h.tok_idx + 7 group by all),
dshapes as (select *, array_to_string(list_transform(ahead, lambda x: x.kind), '') as kinds from dframes),
dspans as (select *, length(regexp_extract(kinds, '^b*')) as skipped, length(regexp_extract(kinds, '^b*((w{{0,5}}c)|(w{{1,6}}))', 1)) as n from dshapes),
dnamed as (select *, trim(array_to_string(list_transform(ahead[skipped + 1 : skipped + n], lambda x: x.t), ' '), ' .,:-') as name,
  (case when regexp_matches(lower(own), 'authori[sz]') then 0.55::double else prec end) * list_avg(list_prepend(conf, list_transform(ahead[1 : skipped + n], lambda x: x.c))) as score from dspans where n > 0),
dealers as (select doc_id, name, score, 0 as first, 0 as seq from letterhead union all select doc_id, name, score, 1, seq from dnamed where length(name) between 4 and 80),
dealer_top as (select * from (select *, row_number() over (partition by doc_id order by score desc, first, seq) as n from dealers) where n = 1)"""
_STRIPPED = """trim(array_to_string(ws[1 : coalesce(list_max(list_transform(range(1, len(ws) + 1), lambda i: case when regexp_matches(ws[i], '[A-Za-z0-9]') and length(ws[i]) > 1 and not regexp_matches(ws[i], '[\\x{0900}-\\x{097F}\\x{0A80}-\\x{0AFF}]')
  and not regexp_full_match(ws[i], '[hH][pP][^\\p{L}\\p{N}_]*|[^\\p{L}\\p{N}_]+[0-9]+[^\\p{L}\\p{N}_]*') then i end)), 0)], ' '), ' .,:-')"""
_BRANDED = "regexp_matches(h.text, '(?i)\\b(Mahindra|Sonalika)\\b')"
MODEL = f"""{TOKENS}, {_hits('model_name', 'mhits')},
mframes as (select h.doc_id, h.tok_idx, h.conf, list({{'t': t.text, 'c': t.conf, 'kind': case when not {_FOLLOWS} then 's' when trim(lower(t.text), '.,:;-()') in {_listed(MODEL_END)} or regexp_full_match(trim(t.text), '(?i)Mahindra|Sonalika') then 'e' else 'w' end}} order by t.tok_idx) as ahead
  from tokens h join tokens t on h.doc_id = t.doc_id and t.tok_idx between h.tok_idx + 1 and h.tok_idx + 6 where {_BRANDED} or (h.doc_id, h.tok_idx) in (select (doc_id, tok_idx) from mhits) group by all),
mshapes as (select *, array_to_string(list_transform(ahead, lambda x: x.kind), '') as kinds from mframes),
anchored as (select f.*, h.prec, h.seq, ahead[1 : least(4, length(regexp_extract(kinds, '^[we]*')))] as run from mshapes f join mhits h on f.doc_id = h.doc_id and f.tok_idx = h.tok_idx),
anchored_words as (select *, list_filter(string_split(trim(array_to_string(list_transform(run, lambda x: x.t), ' '), ' .,:-'), ' '), lambda w: w <> '') as ws from anchored),
branded as (select h.text, f.*, list_prepend({{'t': h.text, 'c': h.conf, 'kind': 'w'}}, ahead[1 : least(5, length(regexp_extract(kinds, '^w*')))]) as used from mshapes f join tokens h on f.doc_id = h.doc_id and f.tok_idx = h.tok_idx where {_BRANDED}),
branded_words as (select *, list_filter(string_split(trim(array_to_string(list_transform(used, lambda x: x.t), ' '), ' .,:-'), ' '), lambda w: w <> '') as ws from branded),
branded_names as (select *, {_STRIPPED} as name from branded_words),
models as (select doc_id, {_STRIPPED} as name, prec * list_avg(list_prepend(conf, list_transform(run, lambda x: x.c))) as score, 0 as first, seq from anchored_words where length({_STRIPPED}) >= 3 and regexp_matches({_STRIPPED}, '[0-9]')
  union all select doc_id, name, (case when regexp_matches(name, '[0-9]') then 0.85 else 0.40 end)::double * list_avg(list_transform(used, lambda x: x.c)), 1, tok_idx from branded_names where length(name) >= 3
    and case when regexp_matches(name, '[0-9]') then not regexp_matches(lower(name), '{_alternatives(MODEL_BANNED)}') else not regexp_matches(array_to_string(list_transform(used, lambda x: x.t), ' '), '[0-9]') end),
model_top as (select * from (select *, row_number() over (partition by doc_id order by score desc, first, seq) as n from models) where n = 1)"""


def _forms_hp(text: str) -> str:
    """Horse power inside a text: the first of four forms whose value is in range."""
    forms = (r"(?i)\bH[.\s]*P[.\-:\s]+([0-9]{2,3})\b", r"(?i)\(\s*HP[-:\s]*([0-9]{2,3})\s*\)", r"(?i)\b([0-9]{2,3})\s*H[.\s]*P\b", r"(?i)\b([0-9]{2,3})HP\b")
    tried = [f"try_cast(nullif(regexp_extract({text}, '{f}', 1), '') as bigint)" for f in forms]
    return "coalesce(" + ", ".join(f"case when {t} between 15 and 150 then {t} end" for t in tried) + ")"


def _best_sql(ctes: str, top: str) -> str:
    return f"""with {ctes}, docs as (select distinct doc_id from tokens) select d.doc_id, name as value, round(coalesce(greatest(0, least(1, score)), 0), 6)::double as confidence,
      case when name is null then 'none' else 'tier1' end as source from docs d left join {top} t on d.doc_id = t.doc_id"""


def _common_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two columns of up to 61 characters."""
    mask = f"coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda k: case when unicode(substr({a}, k, 1)) = ch then (1::bigint << (k - 1)) else 0::bigint end)), 0)::bigint"
    full, chars = f"((1::bigint << length({a})) - 1)", f"list_transform(range(1, length({b}) + 1), lambda j: unicode(substr({b}, j, 1))::bigint)"
    return f"(length({a}) - bit_count(list_reduce({chars}, lambda row, ch: (((row + (row & {mask})) | (row - (row & {mask}))) & {full}), {full})))"


_REST = "array_to_string(list_sort(list_filter({0}, lambda w: not list_contains({1}, w))), ' ')"
FUZZY = f"""nations as (select n_nationkey as seq, n_name || ' AUTOMOBILES' as canonical, n_name || ' TRACTORS' as alias from nation),
spelt as (select seq, 0 as k, canonical, canonical as form from nations union all select seq, 1, canonical, alias from nations),
forms as (select form, min((seq, k)) as rank, arg_max(canonical, (seq, k)) as canonical from spelt group by form),
said as (select c_custkey, (case when c_custkey % 3 = 0 then substr(n_name, 1, 3) || 'X' || substr(n_name, 5, 30) else n_name end) || ' ' || (case when c_custkey % 2 = 0 then 'TRACTORS' else c_mktsegment end) as value from customer join nation on c_nationkey = n_nationkey),
pairs as (select value, form, canonical, rank, list_distinct(string_split(value, ' ')) as x, list_distinct(string_split(form, ' ')) as y from (select distinct value from said), forms),
parted as materialized (select *, length(array_to_string(list_intersect(x, y), ' ')) as s, {_REST.format('x', 'y')} as dx, {_REST.format('y', 'x')} as dy from pairs),
measured as materialized (select *, s + cast(s > 0 as int) + length(dx) as la, s + cast(s > 0 as int) + length(dy) as lb, {_common_sql('dx', 'dy')} as c from parted),
ratios as (select *, case when s > 0 and (dx = '' or dy = '') then 100.0::double else greatest(0.0, 100.0::double - 100.0::double * (length(dx) + length(dy) - 2 * c) / (la + lb), case when s > 0 then 100.0::double - 100.0::double * (1 + length(dx)) / (s + la) end,
  case when s > 0 then 100.0::double - 100.0::double * (1 + length(dy)) / (s + lb) end) end as score from measured),
nearest as (select * from (select *, row_number() over (partition by value order by score desc, rank) as n from ratios) where n = 1)"""


def _anchor_sql(field: str) -> str:
    return f"with {TOKENS}, {_hits(field)} select doc_id, tok_idx, cast(anchor as bigint) as anchor, prec as precision, seq from hits"


_GROUPED = "reverse(regexp_replace(reverse(substr(d, 1, length(d) - 3)), '([0-9]{2})', '\\1,', 'g'))"

SQL: dict[str, str] = {
    "flagship_hp_accuracy": f"""with {HP} select count(*) as docs, count(g.value) as found, count(*) filter (abs(g.value - q.hp) / q.hp <= 0.05) as correct, round(avg(coalesce(g.confidence, 0)), 6) as mean_confidence
      from quotes q left join hp_gate g on q.doc_id = g.doc_id""",
    "tokens_reading_order": f"""with {DOC_TOKENS}, ordered as (select *, row_number() over (partition by doc_id order by (30 * line) // 20, 60 * pos, line * 1000000 + pos) - 1 as tok_idx from doc_tokens)
      select doc_id, count(*) as tokens, max(tok_idx) as last, arg_min(text, tok_idx) as first_text, arg_max(text, tok_idx) as last_text, cast(sum(tok_idx * length(text)) as bigint) as checksum from ordered group by doc_id""",
    "script_distribution": f"""with {DOC_TOKENS} select case when regexp_matches(text, '[\\x{{0900}}-\\x{{097F}}]') and regexp_matches(text, '[\\x{{0A80}}-\\x{{0AFF}}]') then 'mixed' when regexp_matches(text, '[\\x{{0900}}-\\x{{097F}}]') then 'hi'
      when regexp_matches(text, '[\\x{{0A80}}-\\x{{0AFF}}]') then 'gu' else 'en' end as script, count(*) as tokens, count(distinct doc_id) as docs from doc_tokens group by 1""",
    **{f"anchor_hits_{f}": _anchor_sql(f) for f in ANCHORS},
    "hp_candidates": f"with {HP} select doc_id, value, round(score, 6) as score, seq from hp_all",
    "hp_best": f"with {HP} select o_orderkey as doc_id, value, round(coalesce(confidence, 0.0::double), 6) as confidence, case when b.doc_id is null then 'none' else 'tier1' end as source from orders left join hp_best b on o_orderkey = b.doc_id",
    "cost_candidates": f"with {COST} select doc_id, value, round(score, 6) as score, seq from cost_all",
    "cost_best": f"with {COST} select doc_id, value, round(confidence, 6) as confidence, 'tier1' as source from cost_best",
    "dealer_best": _best_sql(DEALER, "dealer_top"),
    "model_best": _best_sql(MODEL, "model_top"),
    "letterhead_lines": f"with {TOKENS}, {LETTERHEAD} select doc_id, cast(line as bigint) as line, text, ok from judged",
    "dealer_fuzzy_match": f"""with {FUZZY} select c_custkey, s.value, case when score >= 90 then canonical else s.value end as norm_value,
      round(case when score >= 90 then 0.7::double + 0.10::double when score >= 70 then 0.7::double * 0.85::double else 0.7::double * 0.5::double end, 6) as confidence, round(score, 6) as score from said s join nearest n on s.value = n.value""",
    "digit_repair": f"""with {WORDS}, made as (select case when regexp_matches(w, '[0-9]') then translate(w, 'qQoOlIzZsSbBgGtT', '9900112255889977') else w end as strict, translate(w, 'qQoOlIzZsSbBgG', '99001122558899') as loose from words where w <> '')
      select length(loose) as length, count(*) as words, count(*) filter (strict = loose) as same, cast(sum(length(regexp_replace(loose, '[^0-9]', '', 'g'))) as bigint) as digits, max(strict) as largest from made group by 1""",
    "int_coerce": f"select o_orderkey, {_int(chr(39) + 'Rs. ' + chr(39) + ' || printf(' + chr(39) + '%.2f' + chr(39) + ', o_totalprice) || ' + chr(39) + '/-' + chr(39))} as value from orders",
    "proximity_and_sanity": f"""with {BOXES}, d as (select seq, round_even(sqrt(((x1 + x2) / 2.0::double - 50) * ((x1 + x2) / 2.0::double - 50) + ((y1 + y2) / 2.0::double - 10) * ((y1 + y2) / 2.0::double - 10)), 0) as distance from boxes)
      select seq, distance, round({_near('distance')}, 6) as proximity, {_sane('(seq % 250)', 15, 150)} as sanity from d""",
    "derive_hp": f"""with {QUOTES}, spelt as (select doc_id, case doc_id % 5 when 0 then 'YUVO 405 DI (HP-' || hp || ')' when 1 then 'Tech 405 D1 HP. ' || hp || '!' when 2 then 'MF 245 DI ' || hp || ' HP' when 3 then '3805P+ ' || hp || 'HP' else 'PT-4' || hp end as name from quotes),
      read as (select doc_id, try_cast(regexp_extract(name, '(?i)\\bH[.\\s]*P[.\\-:\\s]+([0-9]{{2,3}})\\b', 1) as bigint) as a, try_cast(regexp_extract(name, '(?i)\\(\\s*HP[-:\\s]*([0-9]{{2,3}})\\s*\\)', 1) as bigint) as b,
        try_cast(regexp_extract(name, '(?i)\\b([0-9]{{2,3}})\\s*H[.\\s]*P\\b', 1) as bigint) as c, try_cast(regexp_extract(name, '(?i)\\b([0-9]{{2,3}})HP\\b', 1) as bigint) as d from spelt)
      select doc_id, coalesce(case when a between 15 and 150 then a end, case when b between 15 and 150 then b end, case when c between 15 and 150 then c end, case when d between 15 and 150 then d end) as hp from read""",
    "normalize_cross_field": f"""with {BOTH}, checked as (select *, coalesce(hp > 0 and not (cost / hp between 6000 and 20000), false) as odd from gated)
      select doc_id, hp, cost, round(case when odd then cost_conf * 0.8::double else cost_conf end, 6) as cost_confidence, concat_ws(',', hp_note, cost_note, case when odd then 'hp_cost_inconsistent' end) as notes from checked""",
    "model_exact_match": f"""with masters as (select {_KEY.format('p_name')} as key, arg_min(p_name, p_partkey) as master from part where p_partkey % 3 <> 0 group by 1),
      fields as (select p_partkey, case when p_partkey % 2 = 0 then upper(replace(p_name, ' ', '  -')) else p_name end as raw from part)
      select p_partkey, coalesce(master, trim(raw)) as value, round(case when master is null then 0.7::double * 0.7::double else 0.75::double end, 6) as confidence, case when master is not null then 100.0::double end as match_score,
        case when master is null then 'model_no_exact_match' else '' end as notes from fields left join masters on {_KEY.format('raw')} = key""",
    "candidate_counts": f"with {NAMES} select trim(name) as name, count(*) as n, min(seq) as first from names where length(trim(name)) >= 4 group by 1",
    "asset_union": """with rows_ as (select p_brand as brand, p_type as model, case when p_partkey % 2 = 0 then p_brand || ' ' || p_type else lower(p_brand || ' ' || p_type) end as full_name, p_partkey % 2 as rank, p_partkey as seq from part)
      select brand, model, full_name from (select *, row_number() over (partition by lower(trim(full_name)) order by rank, seq) as n from rows_) where n = 1""",
    "brand_list": "select distinct p_brand as brand from part where p_brand <> ''",
    "asset_harvest": f"""with {TOKENS}, found as (select b.doc_id, b.tok_idx, regexp_extract(b.text, '(?i)\\b(Mahindra|Sonalika)\\b', 1) as said, trim(coalesce(string_agg(t.text, ' ' order by t.tok_idx), '')) as model
        from tokens b left join tokens t on b.doc_id = t.doc_id and t.tok_idx between b.tok_idx + 1 and b.tok_idx + 3 and abs(t.cy - b.cy) <= 30 where regexp_matches(b.text, '(?i)\\b(Mahindra|Sonalika)\\b') group by all),
      kept as (select case lower(said) when 'mahindra' then 'Mahindra' else 'Sonalika' end as brand, model from found where regexp_matches(model, '[0-9]') and length(model) between 2 and 40) select distinct brand, model, brand || ' ' || model as full_name from kept""",
    "doc_confidence": f"""with {BOTH}, {BOXES}, {BEST_BOX}, fields as (select doc_id, 0.15::double as w, hp_conf as c from gated union all select doc_id, 0.20::double, cost_conf from gated
      union all select doc_id, 0.125::double, conf from best_box where cls in ('signature', 'stamp') and doc_id in (select doc_id from gated)),
      summed as (select doc_id, coalesce(sum(case when c > 0 then w * c end) / sum(case when c > 0 then w end), 0) as confidence from fields group by doc_id)
      select doc_id, round(confidence, 6) as confidence, confidence < 0.70::double as needs_review from summed""",
    "best_detection": f"with {BOXES} select doc_id, cls, x1, y1, x2, y2, conf, seq from (select *, row_number() over (partition by doc_id, cls order by conf desc, seq) as n from boxes) where n = 1",
    "detection_filter": f"with {BOXES} select cls, count(*) as n, min(conf) as least, max(conf) as most from boxes where {CONFIDENT} group by cls",
    "detection_top_k": f"with {BOXES} select doc_id, cls, seq, n as rank from (select *, row_number() over (partition by doc_id, cls order by conf desc, seq) as n from boxes) where n <= case cls when 'stamp' then 2 when 'signature' then 1 else 0 end",
    "iou_anti_join": f"""with {BOXES}, pairs as (select a.doc_id, a.seq, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i,
        (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as u from boxes a join boxes b on a.doc_id = b.doc_id and a.cls = 'signature' and b.cls = 'stamp')
      select doc_id, seq from boxes where cls = 'signature' and (doc_id, seq) not in (select (doc_id, seq) from pairs where i / greatest(1, u - i) > 0.3)""",
    "annotation_summary": f"""with {BOXES}, d as (select doc_id, bool_or(cls = 'signature') as s, bool_or(cls = 'stamp') as t from boxes group by doc_id)
      select count(*) filter (s) as with_sig, count(*) filter (t) as with_stamp, count(*) filter (s and t) as both, count(*) filter (not s and not t) as neither from d""",
    "page_relevance": f"with {SCORED_PAGES} select page_id, round(score, 6) as relevance_score from scored_pages",
    "page_sample": f"with {PAGES} select doc, page_id, page_index from doc_pages where {SAMPLED}",
    "best_page": f"with {SCORED_PAGES} select doc, page_index, round(score, 6) as relevance_score from (select *, row_number() over (partition by doc order by score desc, page_index) as n from scored_pages where {SAMPLED}) where n = 1",
    "legacy_flat": f"""with {BOTH}, {BOXES}, {BEST_BOX}, seen as (select doc_id, max(case when cls = 'signature' then concat_ws(',', x1, y1, x2, y2) end) as sig, max(case when cls = 'stamp' then concat_ws(',', x1, y1, x2, y2) end) as st from best_box group by doc_id)
      select cast(g.doc_id as varchar) as doc_id, hp as horse_power, cost as asset_cost, sig is not null as signature_present, coalesce(sig, '') as signature_bbox, st is not null as stamp_present, coalesce(st, '') as stamp_bbox
      from gated g left join seen s on g.doc_id = s.doc_id""",
    "eval_fields": f"""with {SCORED}, sums as (select count(*) as total, count(*) filter (horse_power) as h, count(*) filter (asset_cost) as c, count(*) filter (horse_power and asset_cost) as b from scored)
      select 'horse_power' as field, h as correct, total, round(h / total, 6) as accuracy from sums union all select 'asset_cost', c, total, round(c / total, 6) from sums union all select 'document', b, total, round(b / total, 6) from sums""",
    "eval_histogram": f"with {SCORED} select cast(horse_power as bigint) + cast(asset_cost as bigint) as hits, count(*) as docs from scored group by 1",
    "eval_confusion": """with r as (select regexp_matches(lower(text), 'idiot|moron|stupid|clown') as p, toxic = 1 as t from labels join documents using (doc_id))
      select count(*) filter (p and t) as tp, count(*) filter (p and not t) as fp, count(*) filter (not p and not t) as tn, count(*) filter (not p and t) as fn from r""",
    "eval_latency": "select count(value) as n, round(quantile_cont(value, 0.5), 6) as p50, round(list_sort(list(value))[least(cast(floor(0.95::double * count(value)) as bigint), count(value) - 1) + 1], 6) as p95, round(max(value), 6) as max from events",
    "eval_model_plain": f"""with {QUOTES}, both_names as (select doc_id, 'Mahindra ' || model || ' DI' as truth, case doc_id % 4 when 0 then upper('Mahindra ' || model || ' DI') when 1 then 'mahindra ' || (model + 1) when 2 then model || '-DI, MAHINDRA tractor' end as got from quotes),
      keyed as (select doc_id, {_KEY.format('got')} as p, {_KEY.format('truth')} as g from both_names),
      cut as (select doc_id, p, g, regexp_extract_all(g, '[0-9]+') as numbers, list_filter(string_split(p, ' '), lambda w: regexp_full_match(w, '\\p{{L}}{{3,}}')) as pw, list_filter(string_split(g, ' '), lambda w: regexp_full_match(w, '\\p{{L}}{{3,}}')) as gw from keyed)
      select doc_id, coalesce(p <> '' and g <> '' and (p = g or (list_has_any(pw, gw) and ((len(numbers) > 0 and len(list_filter(numbers, lambda n: not contains(p, n))) = 0) or len(list_filter(numbers, lambda n: length(n) >= 3 and contains(p, n))) > 0))), false) as hit from cut""",
    "below_threshold": f"""with {BOTH}, long as (select 'horse_power' as field, hp_conf as c from gated union all select 'asset_cost', cost_conf from gated)
      select field, count(*) as n, round(max(c), 6) as most from long where c < 0.55::double group by field""",
    "tier2_merge": f"""with {COST} select b.doc_id, case when weak and q.doc_id % 3 <> 0 and not (q.doc_id % 5 = 1) then cast(q.cost as varchar) else cast(b.value as varchar) end as value,
        round(case when weak and q.doc_id % 3 <> 0 and not (q.doc_id % 5 = 1) then 0.7::double else b.confidence end, 6) as confidence, case when weak and q.doc_id % 3 <> 0 and not (q.doc_id % 5 = 1) then 'tier2' else 'tier1' end as source
      from (select *, confidence < 0.55::double as weak from cost_best) b join quotes q on b.doc_id = q.doc_id where q.doc_id % 3 <> 0 or not weak or not contains(cast(q.cost as varchar), '999')
      union all select b.doc_id, '999', 0.7::double, 'tier2' from (select *, confidence < 0.55::double as weak from cost_best) b join quotes q on b.doc_id = q.doc_id where q.doc_id % 3 = 0 and weak and contains(cast(q.cost as varchar), '999')""",
    "json_blob_parse": """with r as (select event_id, 'Answer: ' || props || case when event_id % 10 = 0 then '} trailing' else ' ok' end as raw from events),
      b as (select event_id, regexp_extract(raw, '(?s)\\{.*\\}') as blob from r), v as (select event_id, blob, blob <> '' and json_valid(blob) as parsed from b)
      select event_id, case when parsed then cast(json_extract(blob, '$.k') as bigint) end as k, parsed from v""",
    "inr_format": f"""with a as (select o_orderkey, case when o_orderkey % 50 <> 0 then cast(floor(o_totalprice * (o_orderkey % 7) * (o_orderkey % 5)) as bigint) end as v from orders), b as (select *, cast(v as varchar) as d from a)
      select o_orderkey, case when v is null then '—' when length(d) <= 3 then '₹' || d else '₹' || ltrim({_GROUPED}, ',') || ',' || right(d, 3) end as shown, printf('%.2f KB', o_orderkey / 1024.0::double) as size from b""",
    "dash_kpis": f"""with {STORE} select count(*) as total, count(*) filter (status = 'completed') as completed, round(100.0::double * count(*) filter (status = 'completed') / count(*), 6) as completion_pct,
      round(cast(sum(confidence) filter (status = 'completed') as double) / count(*) filter (status = 'completed'), 6) as avg_confidence, round(sum(seconds) filter (status = 'completed') / count(*) filter (status = 'completed'), 6) as avg_seconds from store""",
    "dash_volume": f"with {STORE}, days as (select cast(unnest(range(date '2024-01-27', date '2024-02-03', interval 1 day)) as date) as day) select cast(d.day as varchar) as day, count(s.id) as n from days d left join store s on s.day = d.day group by d.day",
    "dash_confidence_buckets": f"""with {STORE}, ok as (select * from store where status = 'completed' and confidence <> 0) select '90+' as bucket, count(*) as n from ok where confidence >= 90 union all select '80-89', count(*) from ok where confidence between 80 and 89
      union all select '70-79', count(*) from ok where confidence between 70 and 79 union all select '<70', count(*) from ok where confidence < 70""",
    "dash_languages": "select coalesce(case when doc_id % 10 > 0 then lang end, 'Unknown') as lang, count(*) as n from documents group by 1",
    "queue_counts": f"with {STORE} select status, count(*) as n from store group by status",
    "store_search": f"with {STORE} select id from store where status = 'completed' and contains(lower(fileName || ' ' || dealerName || ' ' || modelName), 'dealer 7')",
    "store_upsert": f"""with {STORE}, now as (select case when seq % 3 = 0 then 'completed' else status end as status, case when seq % 3 = 0 then seq + 10000000 else seq end as seq from store) select status, count(*) as n, max(seq) as last from now group by status""",
    "store_delete": f"with {STORE} select status, count(*) as n from store where status <> 'failed' group by status",
    "store_merge_in_flight": f"with {STORE} select status, count(*) as n from store where seq % 2 = 0 or (seq % 3 = 0 and status = 'processing') group by status",
    "stratified_sample": """with r as (select doc_id, source, row_number() over (partition by source order by doc_id * 7919 % 10007, doc_id) as n, count(*) over (partition by source) as size, count(*) over () as total from documents)
      select doc_id, source from r where n <= greatest(1, round_even(60.0::double * size / total, 0))""",
    "split_70_15_15": """with r as (select doc_id, row_number() over (order by doc_id * 7919 % 10007, doc_id) as n, count(*) over () as total from documents)
      select doc_id, case when n <= round_even(total * 0.7::double, 0) then 'train' when n <= round_even(total * 0.7::double, 0) + round_even(total * 0.15::double, 0) then 'val' else 'test' end as part from r""",
    "labels_missing": "select doc_id from documents where doc_id not in (select doc_id from labels)",
    "yolo_encode": f"""with {BOXES} select seq, printf('%d %.6f %.6f %.6f %.6f', case cls when 'signature' then 0 else 1 end, (x1 + x2) / 2.0::double / 600, (y1 + y2) / 2.0::double / 750, (x2 - x1) / 600.0::double, (y2 - y1) / 750.0::double) as line from boxes where cls <> 'logo'""",
    "yolo_verify": f"""with {BOXES}, b as (select *, seq % 11 = 0 as odd, seq % 13 = 0 and seq % 11 <> 0 as six, greatest(abs((x1 + x2) / 1024.0::double), abs((y1 + y2) / 1400.0::double)) > 1.0000005 as far from boxes where cls <> 'logo')
      select count(*) as lines, count(*) filter (cls = 'signature' and not odd and not six and not far) as signatures, count(*) filter (cls = 'stamp' and not odd and not six and not far) as stamps, count(*) filter (six) as malformed, count(*) filter (odd) as bad_class, count(*) filter (far and not six) as bad_range from b""",
    "size_histogram": "with h as (select max(n_chars) + 1 as hi from documents) select cast(floor(n_chars * 20.0::double / hi) + 1 as bigint) as bin, count(*) as docs, round(quantile_cont(n_chars, 0.5), 6) as median from documents, h group by 1",
    "filename_buckets": """with f as (select case event_id % 4 when 0 then 'Android_' || event_id when 1 then 'others-' || event_id when 2 then cast(event_id + 1000000000 as varchar) else 'scan ' || event_id end as stem from events)
      select case when lower(stem) like 'android%' then 'android' when lower(stem) like 'others%' then 'others' when regexp_full_match(stem, '[0-9]{9,}') then 'numeric' else 'named' end as bucket, count(*) as n from f group by 1""",
    "brand_document_frequency": "select p_brand as brand, count(distinct l_orderkey) as docs from lineitem join part on l_partkey = p_partkey group by 1",
    "pseudo_labels": f"with {BOTH} select count(*) as docs, count(*) filter (hp_conf >= 0.85 and cost_conf >= 0.85) as sure, round(cast(count(*) filter (hp_conf >= 0.85 and cost_conf >= 0.85) as double) / count(*), 6) as share from gated",
    "cache_misses": "with d as (select doc_id, substr(sha256(text), 1, 16) as hash from documents) select doc_id, hash from d where hash not in (select hash from d where doc_id % 3 = 0)",
    "evidence_text": f"with {TOKENS} select doc_id, string_agg(text, ' ' order by tok_idx) as text from tokens group by doc_id",
    "row_text": f"with {TOKENS} select doc_id, cast(y1 // 25 as bigint) as line, string_agg(text, ' ' order by x1, text) as text from tokens group by doc_id, y1 // 25",
    "coerce_ints": """select event_id, case event_id % 6 when 1 then event_id when 2 then event_id when 3 then cast(event_id || '000' as bigint) when 5 then -event_id end as value from events""",
    "manual_ints": "select o_orderkey, case when o_orderkey % 4 = 2 then null else cast(floor(o_totalprice) as bigint) end as value from orders",
    "evaluation_keys": f"""with n as (select c_custkey, 'M/s. ' || c_name || case when c_custkey % 2 = 0 then '&Sons' else ' & Co.' end as name from customer) select c_custkey, {_KEY.format("replace(name, '&', ' and ')")} as key from n""",
    "prompts": """select c_custkey, 'Text of the page:' || chr(10) || c_name || chr(10) || chr(10) || 'Answer with a JSON object of these fields: ['
      || array_to_string(list_filter([case when c_custkey % 2 = 0 then '"asset_cost"' end, case when c_custkey % 3 = 0 then '"dealer_name"' end], lambda f: f is not null), ',') || ']' as prompt from customer""",
    "quad_boxes": """with q as (select event_id, event_id % 300 - 20.5::double as x, event_id * 7 % 200 - 9.5::double as y, event_id % 9 as w, event_id % 5 as h from events),
      p as (select event_id, list_transform([x, x + w, x + w - 0.5::double, x - 1.0::double], lambda v: cast(round_even(v, 0) as bigint)) as xs, list_transform([y, y + 1.25::double, y + h, y + h - 0.25::double], lambda v: cast(round_even(v, 0) as bigint)) as ys from q),
      b as (select event_id, list_min(xs) as x1, list_min(ys) as y1, list_max(xs) as x2, list_max(ys) as y2 from p)
      select event_id, case when x2 > x1 and y2 > y1 then greatest(0, x1) end as x1, case when x2 > x1 and y2 > y1 then greatest(0, y1) end as y1, case when x2 > x1 and y2 > y1 then greatest(0, x2) end as x2, case when x2 > x1 and y2 > y1 then greatest(0, y2) end as y2 from b""",
    "schema_faults": f"with {BOXES} select count(*) filter (seq % 17 = 0 or x1 >= x2 or y1 >= y2) as bad_boxes, count(*) filter (seq % 23 = 0) as bad_confidences from boxes",
    "detections_by_confidence": f"with {BOXES} select doc_id, seq, row_number() over (partition by doc_id order by conf desc, seq) as place from boxes",
    "stamp_shapes": """with outlines as (select user_id as doc_id, event_id as seq, event_id * 13 % 800 as x, event_id * 29 % 1100 as y, 12 + event_id % 190 as w, 10 + event_id * 3 % 90 as h, (event_id % 60) / 100.0::double as density, 2.0::double * (22 + event_id % 190 + event_id * 3 % 90) + event_id % 40 as arc, event_id from events), sized as (select *, w * h * (20 + event_id % 70) / 100.0::double as area, 1400000 as page from outlines),
  stamps as (select *, greatest(0, x - 6) as x1, greatest(0, y - 6) as y1, least(1000, x + w + 6) as x2, least(1400, y + h + 6) as y2, least(1.0::double, 0.4::double + 0.3::double * (4 * pi() * area / (arc * arc + 1e-9::double)) + 0.3::double * least(area / (0.01::double * page), 1.0::double)) as conf from sized
    where area between 0.0008::double * page and 0.05::double * page and w >= 20 and h >= 20 and w / h between 0.4::double and 2.5::double and area / (w * h + 1e-9::double) >= 0.25::double),
  best_stamps as (select * from (select *, row_number() over (partition by doc_id order by conf desc, seq) as n from stamps) where n <= 2) select doc_id, seq, x1, y1, x2, y2, round(conf, 6) as conf from best_stamps""",
    "signature_shapes": """with outlines as (select user_id as doc_id, event_id as seq, event_id * 13 % 800 as x, event_id * 29 % 1100 as y, 12 + event_id % 190 as w, 10 + event_id * 3 % 90 as h, (event_id % 60) / 100.0::double as density, 2.0::double * (22 + event_id % 190 + event_id * 3 % 90) + event_id % 40 as arc, event_id from events), sized as (select *, w * h * (20 + event_id % 70) / 100.0::double as area, 1400000 as page from outlines),
  stamps as (select *, greatest(0, x - 6) as x1, greatest(0, y - 6) as y1, least(1000, x + w + 6) as x2, least(1400, y + h + 6) as y2, least(1.0::double, 0.4::double + 0.3::double * (4 * pi() * area / (arc * arc + 1e-9::double)) + 0.3::double * least(area / (0.01::double * page), 1.0::double)) as conf from sized
    where area between 0.0008::double * page and 0.05::double * page and w >= 20 and h >= 20 and w / h between 0.4::double and 2.5::double and area / (w * h + 1e-9::double) >= 0.25::double),
  best_stamps as (select * from (select *, row_number() over (partition by doc_id order by conf desc, seq) as n from stamps) where n <= 2),
      wide as (select * from sized where area between 0.0015::double * page and 0.04::double * page and w >= 60 and h >= 15 and w / h between 1.2::double and 12 and density between 0.04::double and 0.45::double),
      hit as (select a.doc_id, a.seq from (select wide.*, greatest(0, least(x + wide.w, s.x2) - greatest(x, s.x1)) * greatest(0, least(y + wide.h, s.y2) - greatest(y, s.y1)) as i, wide.w * wide.h + (s.x2 - s.x1) * (s.y2 - s.y1) as u
        from wide join (select doc_id as d, x1, y1, x2, y2 from best_stamps) s on wide.doc_id = s.d) a where i / greatest(1, u - i) > 0.3::double),
      free as (select *, least(1.0::double, 0.3::double + 0.4::double * least(density / 0.2::double, 1.0::double) + 0.3::double * least(w / h / 4.0::double, 1.0::double)) as conf from wide where (doc_id, seq) not in (select (doc_id, seq) from hit))
      select doc_id, seq, greatest(0, x - 8) as x1, greatest(0, y - 8) as y1, least(1000, x + w + 8) as x2, least(1400, y + h + 8) as y2, round(conf, 6) as conf from (select *, row_number() over (partition by doc_id order by conf desc, seq) as n from free) where n = 1""",
    "cached_results": "select cast(l.doc_id as varchar) as doc_id, l.doc_id || '::a' || (l.doc_id % 7) as key, n_chars + 97 as size from labels l join documents d on l.doc_id = d.doc_id",
    "detection_cache_misses": """with d as (select doc_id, substr(sha256(text), 1, 16) as hash from documents), k as (select distinct doc_id, hash from d where doc_id % 3 = 0)
      select 'recognition' as side, doc_id, hash from d where (doc_id, hash) not in (select (doc_id, hash) from k where doc_id % 2 = 1) union all select 'detection', doc_id, hash from d where (doc_id, hash) not in (select (doc_id, hash) from k)""",
    "image_label_pairs": "select '/data/images/scan.' || event_id || '.png' as path, 'labels/scan.' || event_id || '.txt' as label_path from events where event_id % 3 = 0",
    "most_common": "select event_type as name, count(*) as n, row_number() over (order by count(*) desc, min(event_id)) as place from events group by 1",
    "issue_head": f"""with {BOXES}, b as (select *, greatest(abs((x1 + x2) / 1024.0::double), abs((y1 + y2) / 1400.0::double)) > 1.0000005 as far from boxes where cls <> 'logo'),
      i as (select printf('%08d', seq) as image, 'class' as issue from b where seq % 11 = 0 union all select printf('%08d', seq), 'range' from b where far), r as (select *, row_number() over (order by image, issue) as place, count(*) over () as total from i)
      select place, image, issue from r where place <= 20 union all select distinct 21, cast(null as varchar), cast(total - 20 as varchar) from r where total > 20""",
    "uniform_sample": "select doc_id, lang from documents order by doc_id * 7919 % 10007, doc_id limit 40",
    "newest_documents": """select 'doc-' || event_id as id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as uploadedAt, event_id as seq from events order by 2 desc, 3 desc limit 50""",
    "store_records": f"""with {BOXES}, m as (select *, case when seq % 5 > 0 then cast(seq * 137 as varchar) end as d from boxes)
      select cast(seq as varchar) as id, printf('%.2f KB', seq * 31 / 1024.0::double) as fileSize, case when seq % 6 = 0 then 'unknown' else 'pdf' end as fileType, 'application/octet-stream' as mimeType, cast(round_even(conf * 100, 0) as bigint) as confidence,
        case when seq % 3 > 0 then 'Dealer ' || doc_id else '—' end as dealerName, '—' as modelName, case when seq % 4 > 0 then (15 + seq % 100) || ' HP' else '—' end as horsePower,
        case when d is null then '—' when length(d) <= 3 then '₹ ' || d else '₹ ' || ltrim({_GROUPED}, ',') || ',' || right(d, 3) end as assetCost, cls = 'signature' as signatureDetected, false as stampDetected, case when cls = 'signature' then concat_ws(',', x1, y1, x2, y2) else '' end as signatureBbox from m""",
    "extract_documents": f"""with {HP}, {_COST_CTES}, {DEALER[len(TOKENS) + 2:]}, {MODEL[len(TOKENS) + 2:]}, {BOXES}, {BEST_BOX},
      full_texts as (select doc_id, string_agg(text, ' ' order by tok_idx) as full_text from tokens group by doc_id),
      forms as (select n_nationkey as rank, n_name || ' AUTOMOBILE TRACTORS' as canonical, n_name || ' AUTOMOBILE TRACTORS' as form from nation),
      pairs as (select value, form, canonical, rank, list_distinct(string_split(value, ' ')) as x, list_distinct(string_split(form, ' ')) as y from (select distinct name as value from dealer_top), forms),
      {FUZZY[FUZZY.index('parted as'):]},
      dealer_done as (select d.doc_id, case when n.score >= 90 then canonical else d.name end as dealer_name, case when n.score >= 90 then least(1.0::double, d.c + 0.10::double) when n.score >= 70 then d.c * 0.85::double else d.c * 0.5::double end as dealer_conf
        from (select doc_id, name, greatest(0.0::double, least(1.0::double, score)) as c from dealer_top) d join nearest n on d.name = n.value),
      assets as (select distinct 'Mahindra ' || (p_size + 500) || ' DI' as full_name from part where (p_size + 500) % 2 = 0),
      model_done as (select m.doc_id, m.name as raw, m.c as raw_conf, coalesce(full_name, m.name) as model_name, case when full_name is null then m.c * 0.7::double else least(1.0::double, m.c + 0.05::double) end as model_conf
        from (select doc_id, name, greatest(0.0::double, least(1.0::double, score)) as c from model_top) m left join assets on {_KEY.format('m.name')} = {_KEY.format('full_name')}),
      wide as (select f.doc_id, dealer_name, coalesce(dealer_conf, 0) as dealer_conf, model_name, coalesce(model_conf, 0) as model_conf, raw_conf, h.value as hp0, coalesce(h.confidence, 0) as hp_conf0, {_forms_hp('raw')} as of_model, {_forms_hp('full_text')} as of_text, c.value as cost0, coalesce(c.confidence, 0) as cost_conf0
        from full_texts f left join dealer_done d on f.doc_id = d.doc_id left join model_done m on f.doc_id = m.doc_id left join hp_best h on f.doc_id = h.doc_id left join cost_best c on f.doc_id = c.doc_id),
      powered as (select *, (hp0 is null or hp_conf0 < 0.3) as weak from wide),
      derived as (select *, case when weak then coalesce(of_model, of_text, hp0) else hp0 end as hp1, case when weak and of_model is not null then greatest(0.6::double, least(0.85::double, coalesce(raw_conf, 0))) when weak and of_text is not null then 0.55::double else hp_conf0 end as hp_conf1 from powered),
      gated_all as (select *, case when hp1 between 15 and 150 then hp1 end as hp, case when hp1 between 15 and 150 then hp_conf1 else 0.0::double end as hp_conf, case when cost0 between 100000 and 5000000 then cost0 end as cost, case when cost0 between 100000 and 5000000 then cost_conf0 else 0.0::double end as cost_conf1 from derived),
      checked as (select *, case when coalesce(hp > 0 and not (cost / hp between 6000 and 20000), false) then cost_conf1 * 0.8::double else cost_conf1 end as cost_conf from gated_all),
      seen as (select doc_id, max(case when cls = 'signature' then conf end) as sig, max(case when cls = 'stamp' then conf end) as st from best_box group by doc_id),
      parts_ as (select c.*, s.sig, s.st, [{{'w': 0.20::double, 'c': dealer_conf}}, {{'w': 0.20::double, 'c': model_conf}}, {{'w': 0.15::double, 'c': hp_conf}}, {{'w': 0.20::double, 'c': cost_conf}}, {{'w': 0.125::double, 'c': coalesce(s.sig, 0)}}, {{'w': 0.125::double, 'c': coalesce(s.st, 0)}}] as ps
        from checked c left join seen s on c.doc_id = s.doc_id)
      select cast(doc_id as varchar) as doc_id, dealer_name, model_name, hp as horse_power, cost as asset_cost, sig is not null as signature_present, st is not null as stamp_present,
        round(coalesce(list_sum(list_transform(list_filter(ps, lambda p: p.c > 0), lambda p: p.w * p.c)) / list_sum(list_transform(list_filter(ps, lambda p: p.c > 0), lambda p: p.w)), 0), 6) as confidence from parts_""",
    "dealer_harvest": f"""with {TOKENS}, {_hits('dealer_name', 'dhits')}, page as (select *, max(y2) over (partition by doc_id) as height from tokens),
      rows12 as (select doc_id, y1 // 30 as line, string_agg(text, ' ' order by x1, tok_idx) as text, count(*) as n from page where y1 < height * 0.12 group by 1, 2),
      bold as (select doc_id, upper(trim(text)) as name from (select *, row_number() over (partition by doc_id order by length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) + 2 * n desc, line) as r from rows12) where r = 1),
      heads as (select distinct doc_id, tok_idx, cy from dhits),
      ahead as (select h.doc_id, h.tok_idx, list({{'t': t.text, 's': regexp_full_match(t.text, '[0-9][0-9,]*(\\.[0-9]+)?') or abs(t.cy - h.cy) > 30}} order by t.tok_idx) as a from heads h join tokens t on h.doc_id = t.doc_id and t.tok_idx between h.tok_idx + 1 and h.tok_idx + 5 group by 1, 2),
      cut as (select doc_id, a, coalesce(list_position(list_transform(a, lambda x: x.s), true), len(a) + 1) as stop from ahead),
      anchored as (select doc_id, array_to_string(list_transform(a[1 : stop - 1], lambda x: x.t), ' ') as name from cut)
      select * from (select * from bold union all select * from anchored) where length(name) between 4 and 80 and regexp_matches(name, '\\p{{L}}')""",
    "iou_keep_first": f"""with {BOXES}, pages_ as (select doc_id, list({{'seq': seq, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} order by seq) as bs from boxes group by doc_id),
      kept as (select doc_id, list_reduce(bs, lambda acc, b: case when len(list_filter(acc, lambda k: greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1))
        > 0.7::double * greatest(1, (k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1))))) > 0 then acc else list_append(acc, b) end, bs[1 : 0]) as ks from pages_)
      select doc_id, unnest(list_transform(ks, lambda k: k.seq)) as seq from kept""",
}

_SCANS = """plans as (select c_custkey as k, 140 + 8 * (c_custkey % 5) as width, 100 + 10 * (c_custkey % 3) as height, 14 + c_custkey % 30 as x, 12 + c_custkey % 20 as y, 24 + c_custkey % 9 as w, 22 + c_custkey % 7 as h,
  case when c_custkey % 7 = 3 then [120, 120, 120] when c_custkey % 3 = 0 then [200, 40, 50] else [30, 40, 160] end as ink, c_custkey % 25 = 7 or c_custkey % 100 = 41 as cut, c_custkey % 10 = 1 as many from customer),
scans as (select *, 'scan-' || k || case when many then '.ppm' else '.png' end as name, unnest(case when not many then [0] when cut then [0, 1] else [0, 1, 2] end) as page from plans),
whole as (select * from scans where not cut or (many and page = 0))"""

SQL["page_images"] = f"""with {_SCANS} select name, cast(page as int) as page_index, cast(case when cut and not many then null when cut or not many then 1 else 3 end as int) as page_count,
  cast(case when cut and (not many or page = 1) then null else width end as int) as width, cast(case when cut and (not many or page = 1) then null else height end as int) as height,
  cast(case when cut and (not many or page = 1) then null else 3 * width * height end as bigint) as n_bytes,
  case when not cut then null when not many then 'a chunk beyond the end' when page = 1 then 'too few bytes of pixels' end as error from scans"""
SQL["page_levels"] = f"""with {_SCANS} select name, cast(page as int) as page_index, cast(255 * (width * height - w * h) + ink[1] * w * h as bigint) as red, cast(255 * (width * height - w * h) + ink[2] * w * h as bigint) as green,
  cast(255 * (width * height - w * h) + ink[3] * w * h as bigint) as blue, cast((4899 * ink[1] + 9617 * ink[2] + 1868 * ink[3] + 8192) // 16384 as int) as threshold, 0.0::double as skew from whole"""
SQL["page_stamps"] = f"""with {_SCANS} select name || '#' || page as doc_id, 'stamp' as cls, cast(x + 5 * page - 6 as int) as x1, cast(y - 6 as int) as y1, cast(x + 5 * page + w + 6 as int) as x2, cast(y + h + 6 as int) as y2,
  round(least(1.0::double, 0.4::double + 0.3::double * 4 * pi() * (w - 1) * (h - 1) / (power(2 * (w + h - 2), 2) + 1e-9) + 0.3::double * least((w - 1) * (h - 1) / (0.01::double * width * height), 1.0::double)), 6) as conf
  from whole where k % 7 <> 3 and (w - 1) * (h - 1) between 0.0008 * width * height and 0.05 * width * height"""


def _token_set_sql(pairs: str, name: str) -> str:
    """CTEs that end in ``name`` (a, b, score) over the distinct rows of ``pairs`` (a, b)."""
    return f"""{name}_w as (select a, b, list_distinct(string_split(a, ' ')) as x, list_distinct(string_split(b, ' ')) as y from (select distinct a, b from {pairs} where a <> '' and b <> '')),
{name}_p as materialized (select *, length(array_to_string(list_intersect(x, y), ' ')) as s, {_REST.format('x', 'y')} as dx, {_REST.format('y', 'x')} as dy from {name}_w),
{name}_m as materialized (select *, s + cast(s > 0 as int) + length(dx) as la, s + cast(s > 0 as int) + length(dy) as lb, {_common_sql('dx', 'dy')} as c from {name}_p),
{name} as (select a, b, case when s > 0 and (dx = '' or dy = '') then 100.0::double else greatest(0.0, 100.0::double - 100.0::double * (length(dx) + length(dy) - 2 * c) / (la + lb), case when s > 0 then 100.0::double - 100.0::double * (1 + length(dx)) / (s + la) end,
  case when s > 0 then 100.0::double - 100.0::double * (1 + length(dy)) / (s + lb) end) end as score from {name}_m)"""


def _partial_sql(pairs: str, name: str) -> str:
    """CTEs that end in ``name`` (a, b, score): the best ratio of the shorter text with any window of the longer."""
    return f"""{name}_o as (select a, b, case when length(a) <= length(b) then a else b end as short, case when length(a) <= length(b) then b else a end as long from (select distinct a, b from {pairs} where a <> '' and b <> '')),
{name}_s as (select *, length(short) as n, length(long) as m from {name}_o),
{name}_x as materialized (select a, b, short, n, w from (select a, b, short, n, unnest(list_distinct(list_concat(list_transform(range(m - n + 1), lambda i: substr(long, i + 1, n)), list_transform(range(1, n), lambda k: substr(long, 1, k)), list_transform(range(1, n), lambda k: substr(long, m - k + 1, k))))) as w from {name}_s)),
{name}_c as (select a, b, n, w, {_common_sql('short', 'w')} as c from {name}_x),
{name} as (select a, b, max(100.0::double * 2 * c / (n + length(w))) as score from {name}_c group by a, b)"""


_SIX = f"""people as (select c_custkey as k, n_name, c_mktsegment as seg, n_name || ' ' || c_mktsegment || ' MOTORS' as dealer, 'Mahindra ' || (500 + c_custkey % 97) || ' DI' as model, 15 + 2 * (c_custkey % 40) as hp, 100000 + 13 * c_custkey as cost
  from customer join nation on c_nationkey = n_nationkey),
said as (select *, k % 31 <> 3 as there, case k % 6 when 0 then dealer when 1 then 'M/s. ' || lower(dealer) || ' & Sons' when 2 then substr(n_name, 1, 3) || 'X' || substr(n_name, 5, 30) || ' ' || seg || ' MOTOR' when 3 then n_name when 4 then 'the' || dealer || 'hall' end as p_dealer,
  case k % 5 when 0 then upper(model) when 1 then 'mahindra ' || (501 + k % 97) when 2 then (500 + k % 97) || '-DI, MAHINDRA tractor' when 3 then 'Mahindra DI model ' || (k % 7) end as p_model from people),
keys as materialized (select *, {_KEY.format("replace(p_dealer, '&', ' and ')")} as dp, {_KEY.format("replace(dealer, '&', ' and ')")} as dg, {_KEY.format('p_model')} as mp, {_KEY.format('model')} as mg from said),
dpairs as (select dp as a, dg as b from keys where dp is not null), mpairs as (select mp as a, mg as b from keys where mp is not null),
{_token_set_sql('dpairs', 'dset')},
{_partial_sql('dpairs', 'dpart')},
{_token_set_sql('mpairs', 'mset')},
{_partial_sql('mpairs', 'mpart')},
cut as (select mp as a, mg as b, regexp_extract_all(mg, '[0-9]+') as numbers, list_filter(string_split(mp, ' '), lambda w: regexp_full_match(w, '\\p{{L}}{{3,}}')) as pw, list_filter(string_split(mg, ' '), lambda w: regexp_full_match(w, '\\p{{L}}{{3,}}')) as gw from (select distinct mp, mg from keys where mp is not null)),
mrule as (select c.a, c.b, c.a = c.b or (list_has_any(pw, gw) and ((len(numbers) > 0 and len(list_filter(numbers, lambda n: not contains(c.a, n))) = 0) or len(list_filter(numbers, lambda n: length(n) >= 3 and contains(c.a, n))) > 0 or mset.score >= 60 or mpart.score >= 80)) as ok
  from cut c join mset on mset.a = c.a and mset.b = c.b join mpart on mpart.a = c.a and mpart.b = c.b),
judged as materialized (select 'doc-' || keys.k as doc_id, keys.*, case when there and k % 29 = 5 then 'corrupt_input: x' when not there then 'missing' end as error, (k % 300) / 10.0::double as seconds,
  coalesce(dset.score >= 90 or (dpart.score >= 95 and length(dp) >= greatest(8, length(dg) // 2)), false) as dealer_ok, coalesce(mrule.ok, false) as model_ok, abs(case when k % 7 = 0 then 9 else 0 end) / hp::double <= 0.05::double as hp_ok, k % 11 <> 0 as cost_ok,
  (there and k % 4 = 0) as sig, (there and k % 3 = 0) as stamp, k % 2 = 0 as sig_true, k % 3 = 0 as stamp_true
  from keys left join dset on dset.a = dp and dset.b = dg left join dpart on dpart.a = dp and dpart.b = dg left join mrule on mrule.a = mp and mrule.b = mg),
hits as (select *, there and dealer_ok as h1, there and model_ok as h2, there and hp_ok as h3, there and cost_ok as h4, there and sig = sig_true as h5, there and stamp = stamp_true as h6 from judged),
sums as (select count(*) as docs_total, count(*) filter (h1 and h2 and h3 and h4 and h5 and h6) as docs_correct, count(*) filter (error is not null) as errors, count(*) filter (h1) as dealer_name_correct, count(*) filter (h2) as model_name_correct, count(*) filter (h3) as horse_power_correct,
  count(*) filter (h4) as asset_cost_correct, count(*) filter (h5) as signature_correct, count(*) filter (h6) as stamp_correct, count(*) filter (sig and sig_true) as signature_tp, count(*) filter (sig and not sig_true) as signature_fp, count(*) filter (not sig and not sig_true) as signature_tn,
  count(*) filter (not sig and sig_true) as signature_fn, count(*) filter (stamp and stamp_true) as stamp_tp, count(*) filter (stamp and not stamp_true) as stamp_fp, count(*) filter (not stamp and not stamp_true) as stamp_tn, count(*) filter (not stamp and stamp_true) as stamp_fn from hits)"""
_FIELDS = ("dealer_name", "model_name", "horse_power", "asset_cost", "signature", "stamp")

SQL["eval_dealer"] = f"with {_SIX} select doc_id, dealer_ok as hit from judged where there"
SQL["eval_model"] = f"with {_SIX} select doc_id, model_ok as hit from judged where there"
SQL["eval_report"] = f"""with {_SIX}, times as (select median(seconds) as p50, list_sort(list(seconds))[least(cast(floor(0.95::double * count(*)) as bigint), count(*) - 1) + 1] as p95, max(seconds) as top from hits where there)
  select sums.*, round(docs_correct / docs_total, 6) as dla, {', '.join(f'round({c}_correct / docs_total, 6) as {c}_accuracy' for c in _FIELDS)}, round(p50, 6) as seconds_p50, round(p95, 6) as seconds_p95, round(top, 6) as seconds_max from sums, times"""
SQL["eval_report_summary"] = f"with {_SIX} " + " union all ".join(f"select '{c}' as field, {c}_correct || '/' || docs_total as shown, round({c}_correct / docs_total, 6) as accuracy from sums" for c in _FIELDS)

SQL["sure_documents"] = f"""with {HP}, {_COST_CTES}, {DEALER[len(TOKENS) + 2:]}, {MODEL[len(TOKENS) + 2:]}
  select d.doc_id, d.name as dealer_name, m.name as model_name, cast(h.value as bigint) as horse_power, cast(c.value as bigint) as asset_cost from dealer_top d join model_top m on d.doc_id = m.doc_id join hp_best h on d.doc_id = h.doc_id join cost_best c on d.doc_id = c.doc_id
  where least(d.score, m.score, h.confidence, c.confidence) >= 0.6::double"""
SQL["record_faults"] = """select event_id as doc_id, case when event_id % 19 = 0 then 'unreadable' else array_to_string(list_filter([case when event_id % 17 = 0 then 'extra:note,extra:zeal' end, case when event_id % 11 = 0 then 'extra:fields.signature.ink' end,
  case when event_id % 7 in (1, 2) then 'confidence:dealer_name' end, case when event_id % 3 = 0 then 'value:horse_power' end, case when event_id % 5 in (1, 2, 3) then 'bbox:signature' end, case when event_id % 13 = 0 then 'missing:stamp' end], lambda x: x is not null), ',') end as faults from events"""
_STUTTERED = """recursive parts as (select p_partkey, string_split(p_type || ' ' || p_brand, ' ') as w from part),
said as (select p_partkey, list_concat(w, case p_partkey % 6 when 1 then [w[-1], w[-1]] when 2 then w[len(w) - 1 : len(w)] when 3 then [lower(w[1]) || '.'] when 4 then [w[1] || 'Y', '-'] when 5 then list_concat(w, w) else w[1 : 0] end) as ws from parts)"""
_TAIL = "list_filter(range(cast(len(ws) // 2 as bigint), 0, -1), lambda w: ws[len(ws) - w + 1 : len(ws)] = ws[len(ws) - 2 * w + 1 : len(ws) - w])[1]"
_LAST = "select p_partkey, array_to_string(arg_min(ws, len(ws)), ' ') as name from steps group by p_partkey"
SQL["repeated_tails"] = f"with {_STUTTERED}, steps as (select * from said union all select p_partkey, ws[1 : len(ws) - {_TAIL}] from steps where {_TAIL} is not null) {_LAST}"
SQL["echoed_words"] = f"""with {_STUTTERED}, plain as materialized (select distinct trim(lower(unnest(ws)), '.,:;-') as w from said), kin as (select a.w as a, b.w as b, {_common_sql('a.w', 'b.w')} as c from plain a, plain b where a.w <> '' and b.w <> ''),
  alike as materialized (select list(a || '|' || b) as pairs from kin where 100.0::double * 2 * c / (length(a) + length(b)) >= 80),
  steps as (select * from said union all select p_partkey, ws[1 : len(ws) - coalesce({_TAIL}, 1)] from steps, alike where len(ws) > 1 and ({_TAIL} is not null or len(list_filter(ws[1 : len(ws) - 1], lambda v: list_contains(pairs, trim(lower(ws[-1]), '.,:;-') || '|' || trim(lower(v), '.,:;-')))) > 0)) {_LAST}"""
SQL["folder_records"] = """select 'paper-' || s_suppkey || case when s_suppkey % 10 = 3 then '.txt' when s_suppkey % 2 = 0 then '.PNG' else '.pdf' end as doc_id, case when s_suppkey % 10 not in (3, 4, 6) then 15 + s_suppkey % 100 end as horse_power,
  case when s_suppkey % 10 not in (3, 4, 6) then 100000 + 137 * s_suppkey end as asset_cost, case s_suppkey % 10 when 3 then 'unsupported_format' when 4 then 'corrupt_input' end as error from supplier"""

_PACKETS = """plans as (select s_suppkey as k, s_name as said, 1 + s_suppkey % 4 as n, s_suppkey % 3 as place, 20 + s_suppkey % 7 as w from supplier),
packets as (select *, unnest(range(n)) as page from plans),
sheets as (select *, 'packet-' || k || '.pdf' as name, case when page = place then 'Quotation' else 'Terms' end || ' of ' || said || ' (' || page || ')' || case when page = place then chr(10) || 'Grand Total: ' || (100000 + k) else '' end as text from packets)"""
SQL["pdf_pages"] = f"""with {_PACKETS} select name, cast(page as int) as page_index, cast(n as int) as page_count, text, cast(case when page % 2 = 0 then w end as int) as width, cast(case when page % 2 = 0 then 10 end as int) as height, cast(null as varchar) as error from sheets"""
SQL["pdf_best_page"] = f"""with {_PACKETS}, low as (select *, lower(text) as low from sheets), scored as (select *, {_SCORE} + 0.5::double * least(6, len(regexp_extract_all(low, '\\b[0-9]{{4,8}}\\b'))) as score from low)
  select name as doc, cast(page as int) as page_index, round(score, 6) as relevance_score, text from (select *, row_number() over (partition by name order by score desc, page) as r from scored) where r = 1"""
SQL["store_insert"] = f"with {STORE}, joined as (select * from store where seq % 3 > 0 union all select * from store where seq % 2 = 0) select status, count(*) as n, count(distinct id) as ids from joined group by status"
SQL["dealer_clusters"] = f"""with recursive {NAMES}, counted as (select trim(name) as name, count(*) as n, min(seq) as first from names where length(trim(name)) >= 4 group by 1),
  ranked as materialized (select *, row_number() over (order by first, name) as place from counted), npairs as (select x.name as a, y.name as b from ranked x, ranked y),
  {_token_set_sql('npairs', 'nset')},
  claims as (select x.place as place, y.place as other, row_number() over (partition by x.place order by score desc, y.place) as r from nset join ranked x on x.name = a join ranked y on y.name = b where score >= 85),
  nears as materialized (select place, list(other order by r) as near from claims where r <= 5 group by place),
  steps as (select 0::bigint as k, cast([] as bigint[]) as taken, cast([] as bigint[]) as mine union all
    select place, case when list_contains(taken, place) then taken else list_concat(taken, list_prepend(place, list_filter(near, lambda x: x <> place and not list_contains(taken, x)))) end,
      case when list_contains(taken, place) then cast([] as bigint[]) else list_prepend(place, list_filter(near, lambda x: x <> place and not list_contains(taken, x))) end from steps join nears on place = k + 1),
  members as (select k, unnest(mine) as place, generate_subscripts(mine, 1) as o from steps),
  named as (select k, name, n, row_number() over (partition by k order by n desc, length(name) desc, o) as lead, sum(n) over (partition by k) as total from members join ranked using (place))
  select max(name) filter (lead = 1) as canonical, coalesce(string_agg(name, '|' order by name) filter (lead > 1), '') as aliases, cast(max(total) as bigint) as frequency from named where total >= 2 group by k"""
