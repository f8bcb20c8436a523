"""DuckDB statements that restate every registered query over the raw tables.

Written against the rules, not against the Spark code: sentence ends are found
by blanking out the full stops that do not count, alignment compares all pairs.
"""

from __future__ import annotations

# --- fixed values, stated here once more so that a slip in the package shows -----
VERBS = (
    "is are was were be been being am have has had do does did may might can could "
    "will would shall should must need ought "
    "use uses used using collect collects collected collecting "
    "share shares shared sharing disclose discloses disclosed disclosing "
    "sell sells sold selling delete deletes deleted deleting "
    "store stores stored storing retain retains retained retaining "
    "process processes processed processing provide provides provided providing "
    "offer offers offered offering require requires required requiring "
    "allow allows allowed allowing permit permits permitted "
    "apply applies applied access accesses accessed "
    "transfer transfers transferred transferring receive receives received receiving "
    "obtain obtains obtained obtaining protect protects protected protecting "
    "safeguard safeguards safeguarded secure secures secured "
    "maintain maintains maintained maintaining update updates updated updating "
    "change changes changed changing inform informs informed informing "
    "notify notifies notified notifying contact contacts contacted contacting "
    "request requests requested requesting consent consents consented "
    "object objects objected restrict restricts restricted "
    "correct corrects corrected erase erases erased "
    "remove removes removed removing govern governs governed "
    "control controls controlled limit limits limited "
    "track tracks tracked log logs logged record records recorded "
    "publish publishes published post posts posted display displays displayed "
    "send sends sent sending deliver delivers delivered "
    "transmit transmits transmitted comply complies complied "
    "ensure ensures ensured describe describes described "
    "contain contains contained include includes included "
    "cover covers covered explain explains explained "
    "state states stated outline outlines outlined "
    "summarize summarizes summarized define defines defined "
    "means refers refer referred relate relates related "
    "belongs concern concerns concerned represent represents represented "
    "let lets make makes made take takes taken give gives given look looks "
    "follow follows followed continue continues continued "
    "reserve reserves reserved review reviews reviewed "
    "expect expects expected happen happens happened "
    "agree agrees agreed accept accepts accepted "
    "remain remains remained believe believes believed "
    "understand understands understood know knows known "
    "note notes noted assume assumes assumed assure assures assured "
).split()
UI_LABELS = (
    "login", "log in", "sign in", "sign up", "register", "contact us", "about us",
    "home", "menu", "search", "faq", "help", "get started", "free trial",
    "pricing", "privacy policy", "terms", "terms of use", "terms & conditions",
    "terms and conditions", "cookie policy", "sitemap", "language", "english",
    "español", "espanol", "more", "learn more", "read more", "accept", "agree",
    "decline", "ok", "okay", "close", "submit", "cancel", "back", "next",
    "continue", "shop", "cart", "account", "my account", "support", "download",
    "subscribe", "unsubscribe", "newsletter", "all rights reserved", "back to top",
)
MODALS = (
    "am is are was were have has had do does did may might must can could will would "
    "shall should need ought cannot can't won't don't doesn't didn't isn't aren't "
    "wasn't weren't haven't hasn't hadn't shouldn't couldn't wouldn't mustn't needn't"
).split()
PRONOUNS = "we you they i it".split()
DETERMINERS = "the this these those our your their its his her a an".split()
SUBORDINATORS = (
    "when if although because unless while after before since whereas whether as "
    "though until provided"
).split()
TRAILING = " .!?;:”“\"'）)]»"
ABBREVIATIONS = (
    "mr mrs ms miss dr prof rev capt col gen lt sgt gov sen rep dept est inc ltd "
    "corp co jr sr etc vs no nos fig vol st mt ft sec min hrs approx esq univ "
    "calif ave blvd ct rd am pm jan feb mar apr jun jul aug sep sept oct nov dec "
    "mon tue wed thu fri sat sun"
).split()
LABEL_TOKENS = {
    "Categories of Personal Information Collected": "CATEGORIES_OF_PERSONAL_INFORMATION_COLLECTED",
    "Categories of Personal Information Shared / Disclosed": "CATEGORIES_OF_PERSONAL_INFORMATION_SHARED_OR_DISCLOSED",
    "Categories of Personal Information Sold": "CATEGORIES_OF_PERSONAL_INFORMATION_SOLD",
    "Description of Right to Correct Information": "DESCRIPTION_OF_RIGHT_TO_CORRECT_INFORMATION",
    "Description of Right to Delete": "DESCRIPTION_OF_RIGHT_TO_DELETE",
    "Description of Right to Know PI Collected": "DESCRIPTION_OF_RIGHT_TO_KNOW_PI_COLLECTED",
    "Description of Right to Know PI sold / shared": "DESCRIPTION_OF_RIGHT_TO_KNOW_PI_SOLD_OR_SHARED",
    "Description of Right to Limit use of PI": "DESCRIPTION_OF_RIGHT_TO_LIMIT_USE_OF_PI",
    "Description of Right to Non-discrimination on exercising rights": "DESCRIPTION_OF_RIGHT_TO_NON_DISCRIMINATION",
    "Description of Right to Opt-out of sale of PI": "DESCRIPTION_OF_RIGHT_TO_OPT_OUT_OF_SALE_OF_PI",
    "Methods to exercise rights": "METHODS_TO_EXERCISE_RIGHTS",
    "Others": "OTHERS",
    "Updated Privacy Policy": "UPDATED_PRIVACY_POLICY",
}
LABELS = tuple(LABEL_TOKENS)
# --- end of fixed values ----------------------------------------------------

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NWS = "[^" + WS[1:]
W = r"[\pL\pN_]"
NW = r"[^\pL\pN_]"
B, E = f"(^|{NW})", f"($|{NW})"
CLOSE = "”\"'）)\\]»"
GAP = f"[ \\t\\n{CLOSE}]"
LOWER = r"\p{Ll}\x{aa}\x{ba}"
DIGIT = r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def alt(xs) -> str:
    return "(" + "|".join(xs) + ")"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(WS + '+')}, ' ', 'g'))"


def norm(x: str) -> str:
    moved = f"translate(nfc_normalize({x}), chr(160) || chr(9) || {lit('“”‘’`–—')}, {lit('  ' + chr(34) * 2 + chr(39) * 3 + '--')})"
    return f"lower({collapse(moved)})"


def sub(x: str, pattern: str, repl: str, opts: str = "g") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {repl}, '{opts}')"


LINKS = rf"(?:https?://|www\.)[^{WS[1:-1]},;()]+|[\pL\pN_.+-]+@[\pL\pN_.-]+\.[a-z]{{2,}}"


def marked(x: str) -> str:
    """Text with chr(2) behind every sentence end."""
    no = "chr(7)"
    t = (f"array_to_string(list_transform(string_split({sub(x, LINKS, 'chr(1) || ' + lit(chr(92) + '0') + ' || chr(1)', 'gi')}, chr(1)), "
         "lambda p, i: case when i % 2 = 1 then p else ' ' || chr(1) || "
         "translate(case when right(p, 1) in ('.', '!', '?') then left(p, length(p) - 1) else p end, '.!?', chr(3) || chr(4) || chr(5)) "
         "|| chr(6) || '0 ' || case when right(p, 1) in ('.', '!', '?') then right(p, 1) else '' end end), '')")
    t = f"replace(replace({t}, '..', {no} || {no}), {no} || '.', {no} || {no})"
    for _ in range(2):
        t = sub(t, rf"(^|[^\pL\pN]){alt(ABBREVIATIONS)}({GAP}*)\.", rf"'\1\2\3' || {no}", "gi")
        t = sub(t, rf"(^|[^\pL\pN])(\pL)({GAP}*)\.", rf"'\1\2\3' || {no}")
    for _ in range(3):
        t = sub(t, rf"(^|[^\pL\pN{GAP[1:-1]}])({GAP}*)\.", rf"'\1\2' || {no}")
    t = sub(t, rf"\.( *)([{DIGIT}{LOWER}])", rf"{no} || '\1\2'")
    return sub(t, rf"(\.|[!?]+)([{CLOSE}]*)", r"'\1\2' || chr(2)")


def sentences(x: str) -> str:
    shown = (f"replace(replace(translate({marked(x)}, chr(7) || chr(3) || chr(4) || chr(5), '..!?'), "
             "chr(6) || '0', ''), chr(1), '')")
    return (f"list_filter(list_transform(string_split({shown}, chr(2)), lambda s: trim(s)), "
            "lambda s: s <> '')")


def rx(pattern: str, opts: str = "") -> str:
    return f"regexp_matches(t, {lit(pattern)}{f', {lit(opts)}' if opts else ''})"


URL = rf"^(?:(?:https?://|www\.|(?:[a-z0-9-]+\.)+[a-z]{{2,}})(?:/{NWS}*)?)$"
EMAIL = rf"^[\pL\pN_.+-]+@[\pL\pN_.-]+\.[a-z]{{2,}}$"
SIGNAL = "(" + " or ".join([
    rx(B + alt(MODALS) + E, "i"),
    rx(B + alt(PRONOUNS) + WS + "+[a-z]+" + E, "i"),
    rx(B + "please" + WS + "+[a-z]+" + E, "i"),
    rx(B + W + "+(s|ed)" + WS + f"+({alt(DETERMINERS)}|{W}+ly)" + E, "i")]) + ")"
PROBE = f"list_has_any(string_split(lower(t), ' '), [{', '.join(lit(v) for v in VERBS)}])"
TERMINAL = rx("[.!?][”\"'）)]*$")
LAST = f"list_last(string_split(rtrim(t, {lit(TRAILING)}), ' '))"
N = "len(list_filter(string_split(t, ' '), lambda w: w <> ''))"

FRAGMENT_TYPE = f"""case
 when len(regexp_replace(t, '[^{DIGIT}]', '', 'g')) >= 7 and ({rx(rf'^[+]?[0-9][0-9{WS[1:-1]}().-]{{5,}}$')} or {rx(rf'^[(]?[0-9]{{3}}[)]?[{WS[1:-1]}.-]?[0-9]{{3}}[{WS[1:-1]}.-]?[0-9]{{4}}$')}) then 'phone'
 when {rx(EMAIL, 'i')} then 'email'
 when {rx(URL, 'i')} then 'url'
 when {rx(rf'^(©|copyright($|{NW})).*([0-9]{{4}}|all rights reserved)', 'i')} then 'copyright'
 when lower(t) in ({', '.join(lit(x) for x in UI_LABELS)}) then case when n <= 3 then 'nav' else 'button' end
 when block_kind = 'heading' then 'heading'
 when {rx(f';({WS}+(and|or))?$')} then 'list_item'
 when right(t, 1) = ':' then 'lead_in'
 when {rx(rf'^[0-9]+([.][0-9]+)*[.:]?{WS}+{NWS}')} or {rx(rf'^[IVX]+[.]?{WS}+{NWS}')} then 'heading'
 when n <= 10 and {rx(rf'^[A-Z0-9{WS[1:-1]}/&.{chr(39)}’%-]{{2,}}$')} then 'heading'
 when n <= 4 and {TERMINAL} and not probe and regexp_matches(t, '^\\p{{Lu}}') then 'heading'
 when n <= 3 and not {TERMINAL} then 'short'
 when not contains(t, ',') and {rx('^' + alt(SUBORDINATORS) + E, 'i')} then 'other'
 when n >= 4 and (regexp_matches({LAST}, {lit(URL)}, 'i') or regexp_matches({LAST}, {lit(EMAIL)}, 'i')) then null
 when n <= 8 and not {TERMINAL} and not probe and not {SIGNAL} then 'heading'
 when n >= 4 and (probe or {SIGNAL}) then null
 else 'other' end"""

UNITS = f"""
lines as materialized (
  select lang || '_' || doc_id as doc_id, lang as subset, doc_id as num, source,
         list_filter(list_transform(string_split(text, chr(10)), lambda l: {collapse('l')}),
                     lambda l: regexp_matches(l, '[\\pL\\pN]')) as ls
  from documents),
blocks as materialized (
  select doc_id, subset, num, 'prose' as block_kind, unnest(ls) as line,
         unnest(range(len(ls))) as k from lines),
cut as materialized (select doc_id, subset, block_kind, k, {sentences('line')} as ss from blocks),
numbered as (
  select doc_id, subset, block_kind, k as block_seq, unnest(ss) as t, unnest(range(len(ss))) as i from cut),
placed as (
  select doc_id, subset, block_kind, block_seq, t,
         row_number() over (partition by doc_id order by block_seq, i) as position,
         {N} as n, {PROBE} as probe from numbered),
units as materialized (
  select doc_id || '_U' || position as unit_id, doc_id, subset, position::int as position,
         block_seq::int as block_seq, block_kind, t as unit_text,
         case when ft is null then 'sentence' else 'fragment' end as unit_kind, ft as fragment_type
  from (select *, {FRAGMENT_TYPE} as ft from placed))"""

SPANS = f"""
drafts as (
  select doc_id, num, k, j, line, string_split(line, ' ') as w, (num + k) % 5 as kind
  from blocks, range(3) r(j)),
span_src as (
  select doc_id, (k * 3 + j)::int as src_row, 'ra' || (1 + (num + k + j) % 6) as ranumb,
         [{', '.join(lit(x) for x in LABELS)}][1 + (num + j * (k % 2)) % 13] as label,
         case kind when 0 then array_to_string(w[2:9], ' ')
                   when 1 then line
                   when 2 then array_to_string(list_filter(w, lambda x, i: i % 2 = 1), ' ')
                   when 3 then md5(num || '-' || k) || ' ' || md5(k || '-' || num)
                   else 'the' end as text
  from drafts),
spans as materialized (
  select doc_id || '_A' || src_row as annotation_id, * from span_src where text <> '')"""

ALIGN = f"""
un as materialized (select unit_id, doc_id, position, unit_kind, {norm('unit_text')} as norm from units),
sn as materialized (select annotation_id, doc_id, label, ranumb, {norm('text')} as norm from spans),
st as materialized (select distinct doc_id, norm from sn),
ta as materialized (
  select s.doc_id, s.norm, u.unit_id, u.position, u.unit_kind,
         count(*) over (partition by s.doc_id, s.norm) as hits
  from st s join un u on u.doc_id = s.doc_id and u.norm <> '' and contains(u.norm, s.norm)),
left_b as materialized (select * from st where (doc_id, norm) not in (select (doc_id, norm) from ta)),
tb as materialized (
  select s.doc_id, s.norm, u.unit_id, u.position, u.unit_kind
  from left_b s join un u on u.doc_id = s.doc_id and length(u.norm) > 10 and contains(s.norm, u.norm)),
left_c as (
  select doc_id, norm, list_distinct(string_split(norm, ' ')) as st from left_b
  where (doc_id, norm) not in (select (doc_id, norm) from tb)),
scored as (
  select s.doc_id, s.norm, u.unit_id, u.position, u.unit_kind,
         len(list_intersect(s.st, string_split(u.norm, ' '))) as shared, len(s.st) as n
  from left_c s join un u on u.doc_id = s.doc_id where len(s.st) >= 3),
tc as materialized (
  select doc_id, norm, unit_id, position, unit_kind from scored where shared * 20 >= n * 11
  qualify row_number() over (partition by doc_id, norm order by shared desc, position) = 1),
found as materialized (
  select doc_id, norm, unit_id, position, unit_kind, 'annotation_in_sentence' as alignment_type from ta where hits = 1
  union all select *, 'sentence_in_annotation_paragraph' from tb
  union all select *, 'partial_overlap' from tc),
outcome as (
  select doc_id, norm, 'aligned' as status, null::bigint as n_hits from (select distinct doc_id, norm from found)
  union all select distinct doc_id, norm, 'ambiguous', hits from ta where hits > 1),
annotations as materialized (
  select s.annotation_id, s.doc_id, s.ranumb, p.text, s.label, coalesce(o.status, 'unmatched') as status,
         o.n_hits, p.src_row
  from sn s join spans p using (annotation_id) left join outcome o on o.doc_id = s.doc_id and o.norm = s.norm),
alignment as materialized (
  select f.unit_id, s.annotation_id, f.alignment_type, s.doc_id, s.label, s.ranumb, f.unit_kind, f.position
  from found f join sn s on s.doc_id = f.doc_id and s.norm = f.norm)"""

TABLES = """
evidence as (
  select unit_id, list_sort(list_distinct(list(label) filter (unit_kind = 'sentence'))) as labels,
         list_sort(list_distinct(list(ranumb))) as annotators,
         array_to_string(list_sort(list_distinct(list(alignment_type) filter (unit_kind = 'sentence'))), ';') as types,
         count(*) filter (unit_kind = 'sentence') as n_spans
  from alignment group by unit_id),
text_units as materialized (
  select u.unit_id, u.doc_id, u.subset, u.position, u.block_seq, u.block_kind, u.unit_text, u.unit_kind, u.fragment_type,
         case when u.unit_kind <> 'sentence' then 'not-eligible' when coalesce(len(e.labels), 0) = 0 then 'unlabeled'
              when len(e.labels) = 1 then 'single_label' else 'multi_label' end as label_category,
         (case when u.unit_kind = 'sentence' then coalesce(len(e.annotators), 0) else 0 end)::int as annotator_count,
         (case when u.unit_kind = 'sentence' then coalesce(e.n_spans, 0) else 0 end)::int as source_annotation_count,
         nullif(e.types, '') as alignment_types,
         nullif(array_to_string(e.labels, ';'), '') as verbatim_labels,
         nullif(array_to_string(e.annotators, ';'), '') as annotators,
         coalesce(e.labels, []) as labels
  from units u left join evidence e using (unit_id)),
unit_labels as materialized (select unit_id, unnest(labels) as label, doc_id from text_units),
docs as materialized (
  select doc_id, subset, num::int as num, ls[1] as title, source || '/' || num as link from lines)"""


def support(threshold: int) -> str:
    return f"""
pool as materialized (select doc_id, count(distinct ranumb) as pool from annotations group by doc_id),
support as materialized (
  select doc_id, unit_id, label, k, pool,
         (case when k = pool then 3 when k >= (pool + 1) // 2 then 2 else 1 end)::int as stars
  from (select doc_id, unit_id, label, count(*) as k
        from (select g.doc_id, g.unit_id, g.label, g.ranumb
              from unit_labels l join alignment g on g.unit_id = l.unit_id and g.label = l.label
              group by all having count(*) >= {threshold})
        group by all) join pool using (doc_id))"""


def with_units(select: str, extra: str = "") -> str:
    """``extra``: further CTEs behind the shared ones."""
    return f"with {UNITS}{',' + extra if extra else ''}\n{select}"


def with_spans(select: str) -> str:
    return f"with {UNITS},{SPANS}\n{select}"


def with_tables(select: str, extra: str = "") -> str:
    parts = [UNITS, SPANS, ALIGN, TABLES] + ([extra] if extra else [])
    return "with " + ",".join(parts) + "\n" + select


def with_support(select: str, threshold: int = 1, extra: str = "") -> str:
    return with_tables(select, support(threshold) + (("," + extra) if extra else ""))


TOKEN_CASE = "case label " + " ".join(
    f"when {lit(k)} then {lit(v)}" for k, v in LABEL_TOKENS.items()) + (
    " else upper(regexp_replace(replace(replace(replace(label, '/', ' OR '), '-', '_'), ' ', '_'),"
    " '[^\\pL\\pN_]', '', 'g')) end")

# Fixed parameters of the registered queries.
TWO = f"({lit(LABELS[0])}, {lit(LABELS[11])})"
FLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LABEL_SETS = {
    "any_two": f"unit_id in (select unit_id from unit_labels where label in {TWO})",
    "none_two": f"unit_id not in (select unit_id from unit_labels where label in {TWO})",
}
SHOWN = "case when label_category = 'single_label' and len(labels) = 1 then labels[1] when label_category = 'multi_label' then 'MULTI_LABEL' else '' end"


def gate(tier: int, mode: str = "at_least") -> str:
    test = {("at_least", 1): "mk >= 1", ("at_least", 2): "mk >= (pool + 1) // 2", ("at_least", 3): "mk = pool",
            ("exact", 1): "mk >= 1 and mk < (pool + 1) // 2",
            ("exact", 2): "mk >= (pool + 1) // 2 and mk < pool", ("exact", 3): "mk = pool"}[mode, tier]
    return f"(select unit_id from (select unit_id, max(k) as mk, any_value(pool) as pool from support group by unit_id) where {test})"


def unit_filter(where: str, threshold: int = 1) -> str:
    return with_support(f"select unit_id, label_category, unit_kind from text_units where {where}", threshold)


SINGLE = "(unit_kind = 'sentence' and label_category = 'single_label')"
MULTI = "(unit_kind = 'sentence' and label_category = 'multi_label')"
NULL = "(unit_kind = 'sentence' and label_category = 'unlabeled')"
DEFINED = "label_category in ('single_label', 'multi_label')"


def fill(docs: str, train: int, ev: int, te: int, seed: int) -> str:
    """CTEs from doc rows (doc_id, bin, n) to ``assigned`` (doc_id, bin, n, split)."""
    active = [s for s, p in (("train", 1), ("eval", ev), ("test", te)) if p > 0]
    rest = "'test'" if te > 0 else "'train'"
    out = f"""
docs0 as materialized ({docs}),
placed0 as (
  select *, md5('{seed}:' || doc_id) as o,
         sum(n) over (partition by bin) as total from docs0),
placed1 as (
  select *, sum(n) over (partition by bin order by o, doc_id) - n as before from placed0),
placed2 as (
  select *, (before < round_even(total * {train} / 100.0, 0) or {str(ev == 0 and te == 0).lower()}) as tr from placed1),
placed3 as (select *, sum(case when tr then n else 0 end) over (partition by bin) as filled from placed2),
a0 as materialized (
  select doc_id, bin, n, o, case when tr then 'train'
    when {str(ev > 0).lower()} and before - filled < round_even(total * {ev} / 100.0, 0) then 'eval' else {rest} end as split from placed3),
lacking as materialized (
  select bin, {', '.join(f"count(*) filter (split = '{s}') = 0 as no_{s}" for s in active)}
  from a0 group by bin having count(*) >= {len(active)})"""
    prev = "a0"
    for i, s in enumerate(active, 1):
        out += f""",
part{i} as (select bin, split, count(*) as c, min(o || doc_id) as f from {prev} group by all),
give{i} as (
  select p.bin, p.split as src, p.f from part{i} p join lacking l on l.bin = p.bin and l.no_{s}
  qualify row_number() over (partition by p.bin order by p.c desc, p.f) = 1 and p.c > 1),
a{i} as materialized (
  select a.doc_id, a.bin, a.n, a.o, case when g.f = a.o || a.doc_id then '{s}' else a.split end as split
  from {prev} a left join give{i} g on g.bin = a.bin)"""
        prev = f"a{i}"
    return out + f",\nassigned as materialized (select doc_id, bin, n, split from {prev})"


def bins(rows: str) -> str:
    """Document rows with the bin of their rarest label; ``rows`` has doc_id, labels."""
    return f"""
  select doc_id, coalesce(min_by(label, (dc, label)), '__unlabeled__') as bin, any_value(n) as n
  from (select r.doc_id, r.n, p.label, p.dc
        from (select doc_id, count(*) as n from {rows} group by doc_id) r
        left join (select doc_id, label, count(*) over (partition by label) as dc
                   from (select distinct doc_id, unnest(labels) as label from {rows})) p using (doc_id))
  group by doc_id"""


def capped(rows: str, pct: float) -> str:
    """Recursive replay of the cap; ``rows`` has doc_id, i (1..), labels, m (rows per label allowed)."""
    return f"""
base as materialized ({rows}),
walk as (
  select doc_id, i, true as kept, labels as used from base where i = 1
  union all
  select b.doc_id, b.i,
         not list_bool_or(list_transform(b.labels, lambda l: len(list_filter(w.used, lambda u: u = l)) >= b.m)),
         case when list_bool_or(list_transform(b.labels, lambda l: len(list_filter(w.used, lambda u: u = l)) >= b.m))
              then w.used else list_concat(w.used, b.labels) end
  from walk w join base b on b.doc_id = w.doc_id and b.i = w.i + 1)"""


def line_rows(*labels: str, pct: float = 34.0) -> str:
    return f"""select l_orderkey as doc_id, l_linenumber as position, l_partkey, [{', '.join(labels)}] as labels,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as i,
  greatest(1, ceil(count(*) over (partition by l_orderkey) * {pct} / 100.0)) as m from lineitem"""


EXPORTED = f"""
exported as materialized (
  select *, list_transform(labels, lambda label: {TOKEN_CASE}) as tok0 from text_units),
rows_x as materialized (
  select *, case when len(tok0) = 0 then ['UNLABELED'] else tok0 end as tokens,
         case when len(labels) = 0 then ['Unlabeled'] else labels end as names from exported)"""

SPLIT_UNITS = EXPORTED + "," + fill(bins("text_units"), 70, 15, 15, 42)


def capped_units(where: str, pct: int) -> str:
    rows = (f"select unit_id, doc_id, tokens as labels, row_number() over (partition by doc_id order by position) as i, "
            f"greatest(1, ceil(count(*) over (partition by doc_id) * {pct}.0 / 100.0)) as m from rows_x where {where}")
    return capped(rows, pct)


def recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


MATRIX = """
raw as (select label, count(*) as raw, count(*) filter (status = 'aligned') as aligned,
        count(*) filter (status = 'unmatched') as unmatched, count(*) filter (status = 'ambiguous') as ambiguous
        from annotations group by label),
sen as (select label, count(*) as sentences from unit_labels group by label),
mtx as (select coalesce(raw.label, sen.label) as label, coalesce(raw, 0) as raw, coalesce(aligned, 0) as aligned,
        coalesce(unmatched, 0) as unmatched, coalesce(ambiguous, 0) as ambiguous, coalesce(sentences, 0) as sentences
        from raw full join sen using (label)),
tot as (select count(*) filter (unit_kind = 'sentence') as all_s,
        count(*) filter (label_category in ('single_label', 'multi_label')) as all_d from text_units)"""

TITLE = "trim(regexp_replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g'))"

LINE_COLUMNS = (
    [f"{c}::varchar" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    + [f"round({c} * 100)::bigint::varchar" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    + ["l_returnflag", "l_linestatus", "strftime(l_shipdate, '%Y-%m-%d')"])

SQL: dict[str, str] = {
    "page_titles": f"select page_id, {TITLE} as title from pages",
    "unit_split": with_units("select doc_id, position, block_seq, unit_text from units"),
    "unit_classify": with_units("select unit_id, unit_kind, fragment_type from units"),
    "unit_initial": with_units(
        "select unit_kind, case when unit_kind = 'sentence' then 'unlabeled' else 'not-eligible' end as label_category,"
        " count(*) as n, 0::bigint as votes from units group by all"),
    "fragment_types": with_units(
        "select fragment_type, count(*) as n from units where fragment_type is not null group by all"),
    "leadin_merge": with_units("""
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as block_seq, kind as block_kind, text from merged""", """
src as (select doc_id, k as i, case when k % 2 = 1 then 'list' else 'prose' end as kind,
                case when k % 3 = 0 then line || ':' else line end as text from blocks),
near as (select *, lead(kind) over w as nk, lead(text) over w as nt, lag(kind) over w as pk, lag(text) over w as pt
         from src window w as (partition by doc_id order by i)),
merged as (select doc_id, i, kind, case when kind = 'prose' and nk = 'list' and right(rtrim(text), 1) = ':'
                  then rtrim(text) || ' ' || nt else text end as text from near
           where not (kind = 'list' and coalesce(pk = 'prose' and right(rtrim(pt), 1) = ':', false)))"""),
    "turn_sentences": f"""with s as (select conv_id, turn, role, {sentences(collapse('text'))} as ss from conversations)
select conv_id, turn, role, unnest(range(len(ss)))::int as i, unnest(ss) as sentence from s""",
    "normalized_units": with_units(f"select unit_id, {norm('unit_text')} as norm from units"),
    "plain_text": with_units("select doc_id, array_to_string(ls, chr(10)) as text from lines"),
    "align_benchmark": with_units(
        "select item_unit, unit_id, copies from needles n join hay h on h.norm <> '' and contains(h.norm, n.norm) where n.norm <> ''", f"""
hay as materialized (select {norm('unit_text')} as norm, min(unit_id) as unit_id, count(*) as copies from units group by 1),
items as (select item_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: {collapse('l')}),
                 lambda l: regexp_matches(l, '[\\pL\\pN]')) as ls from benchmark),
ib as (select item_id, unnest(range(len(ls))) as k, unnest(ls) as line from items),
ic as (select item_id, k, {sentences('line')} as ss from ib),
iu as (select item_id, k, unnest(range(len(ss))) as i, unnest(ss) as t from ic),
needles as (select 'B_' || item_id || '_U' || row_number() over (partition by item_id order by k, i) as item_unit,
                   {norm('t')} as norm from iu)"""),
    "align_contained": with_tables("select unit_id, annotation_id from alignment where alignment_type = 'annotation_in_sentence'"),
    "align_paragraph": with_tables("select unit_id, annotation_id from alignment where alignment_type = 'sentence_in_annotation_paragraph'"),
    "align_overlap": with_tables("select unit_id, annotation_id from alignment where alignment_type = 'partial_overlap'"),
    "overlap_best": with_tables("""
select doc_id, span_rep, position as unit_rep from (
  select s.doc_id, s.src_row as span_rep, u.position,
         row_number() over (partition by s.doc_id, s.norm
           order by len(list_intersect(s.st, string_split(u.norm, ' '))) desc, u.position) as r,
         len(list_intersect(s.st, string_split(u.norm, ' '))) as shared, len(s.st) as n
  from (select n.doc_id, n.norm, min(p.src_row) as src_row, list_distinct(string_split(n.norm, ' ')) as st
        from sn n join spans p using (annotation_id) group by n.doc_id, n.norm) s
  join un u on u.doc_id = s.doc_id where len(s.st) >= 3) where r = 1 and shared * 20 >= n * 11"""),
    "span_status": with_tables("select annotation_id, doc_id, src_row, ranumb, label, status, n_hits from annotations"),
    "span_matched_units": with_tables(
        "select t.doc_id, r.span_rep, t.unit_id, t.position from ta t join (select s.doc_id, s.norm, min(p.src_row) as span_rep"
        " from sn s join spans p using (annotation_id) group by all) r on r.doc_id = t.doc_id and r.norm = t.norm where t.hits > 1"),
    "alignment_table": with_tables("select unit_id, annotation_id, alignment_type from alignment"),
    "unit_evidence": with_tables(
        "select unit_id, annotator_count, source_annotation_count, alignment_types, verbatim_labels from text_units where source_annotation_count > 0"),
    "label_category": with_tables("select unit_id, unit_kind, label_category from text_units"),
    "unit_labels": with_tables("select unit_id, label from unit_labels"),
    "annotator_pool": with_support("select doc_id, pool from pool"),
    "unit_support_t1": with_support("select unit_id, label, k, pool, stars from support"),
    "unit_support_t2": with_support("select unit_id, label, k, pool, stars from support", 2),
    "unit_support_t5": with_support("select unit_id, label, k, pool, stars from support", 5),
    "event_support": """with e as (
  select user_id || '_' || strftime(ts, '%Y-%m-%d') as unit_id, user_id, event_type as label, event_id % 6 as a from events),
p as (select user_id, count(distinct a) as pool from e group by 1),
v as (select unit_id, user_id, label, count(distinct a) as k from e group by all)
select unit_id, label, k, pool, (case when k = pool then 3 when k >= (pool + 1) // 2 then 2 else 1 end)::int as stars
from v join p using (user_id)""",
    "event_stars": """with e as (
  select user_id || '_' || strftime(ts, '%Y-%m-%d') as unit_id, user_id, event_type as label, event_id % 6 as a from events),
p as (select user_id, count(distinct a) as pool from e group by 1),
v as (select unit_id, user_id, label, count(distinct a) as k from e group by all)
select label, (case when k = pool then 3 when k >= (pool + 1) // 2 then 2 else 1 end)::int as stars, count(*) as n
from v join p using (user_id) group by all""",
    "units_filter_subset": unit_filter("subset = 'de'"),
    "units_filter_doc": unit_filter("doc_id = 'en_115'"),
    "units_filter_category": unit_filter("label_category = 'single_label'"),
    "units_filter_kind": unit_filter("unit_kind = 'fragment'"),
    "units_filter_fragment_type": unit_filter("fragment_type = 'heading'"),
    "units_filter_min_annotators": unit_filter("annotator_count >= 2"),
    "units_filter_high_confidence": unit_filter("label_category = 'single_label' and annotator_count >= 2"),
    "units_filter_q": unit_filter(f"contains({FLD.format('unit_text')}, 'the a')"),
    "units_filter_labels": unit_filter(f"{LABEL_SETS['any_two']} and {DEFINED} and unit_id in {gate(1)}"),
    "units_filter_exclude_labels": unit_filter(f"{LABEL_SETS['none_two']} and {DEFINED} and unit_id in {gate(1)}"),
    "units_filter_threshold": unit_filter(f"{DEFINED} and unit_id in {gate(1)}", 2),
    "sample_view_single_multi": unit_filter(f"({SINGLE} or {MULTI}) and unit_id in {gate(1)}"),
    "sample_view_null": unit_filter(NULL),
    "sample_view_null_single_ms3": unit_filter(f"{SINGLE} and unit_id in {gate(3)}"),
    "sample_view_fragments": unit_filter("unit_kind = 'fragment'"),
    "sample_view_mixed": unit_filter(f"({MULTI} and unit_id in {gate(1)}) or {NULL} or unit_kind = 'fragment'"),
    "sample_view_exact": unit_filter(f"({SINGLE} or {MULTI}) and unit_id in {gate(2, 'exact')}"),
    "sample_view_all_gated": unit_filter(f"{DEFINED} and unit_id in {gate(2)}"),
    "sample_view_unknown": unit_filter(LABEL_SETS["any_two"]),
    "underdefined": with_support(f"select unit_id, label_category from text_units where {DEFINED} and unit_id not in {gate(3)}"),
    "annotations_filter": with_tables(
        f"select annotation_id, label, status from annotations where ranumb = 'ra2' and label in ({', '.join(lit(x) for x in LABELS[:6])}) and label not in ({lit(LABELS[2])})"),
    "annotations_status": with_tables("select annotation_id, ranumb from annotations where status = 'unmatched' and label = 'Others'"),
    "unit_view": with_tables(
        f"select unit_id, subset, position, block_kind, unit_kind, fragment_type, label_category, annotator_count, source_annotation_count, alignment_types, verbatim_labels, annotators, {SHOWN} as verbatim_label from text_units"),
    "units_supported": with_support("""
select u.unit_id, string_agg(s.label || '|' || s.k || '|' || s.pool || '|' || s.stars, ';' order by s.label) as support,
       max(s.stars) as support_stars, max(s.k) as support_evidence
from text_units u left join support s using (unit_id) where u.label_category <> 'not-eligible' group by u.unit_id"""),
    "units_page": with_support("""
select unit_id, unit_text, verbatim_labels, annotators, (select max(stars) from support s where s.unit_id = p.unit_id) as support_stars
from (select * from text_units order by doc_id, position limit 50 offset 7) p"""),
    "units_page_deep": with_support("""
select unit_id, unit_text, verbatim_labels, annotators, (select max(stars) from support s where s.unit_id = p.unit_id) as support_stars
from (select * from text_units order by doc_id, position
      limit 50 offset (select greatest(0, count(*) - 200) from text_units)) p"""),
    "units_page_filtered": with_support("""
select unit_id, unit_text, verbatim_labels, (select max(stars) from support s where s.unit_id = p.unit_id) as support_stars,
  (select max(k) from support s where s.unit_id = p.unit_id) as support_evidence
from (select * from text_units t where label_category in ('single_label', 'multi_label')
      and exists (select 1 from support s where s.unit_id = t.unit_id group by s.unit_id having max(k) * 2 >= max(pool))
      order by doc_id, position limit 40 offset 30) p"""),
    "units_total": with_tables("select count(*) as total from text_units where annotator_count >= 2"),
    "unit_alignment": with_tables(
        "select g.unit_id, g.annotation_id, g.ranumb, a.text, g.label, g.alignment_type from alignment g join annotations a using (annotation_id)"),
    "span_units": with_tables(
        "select g.annotation_id, u.unit_id, u.position, u.unit_text, u.unit_kind, u.fragment_type, u.label_category, g.alignment_type from alignment g join text_units u using (unit_id)"),
    "documents_list": with_tables("""
select d.doc_id, d.title, d.link,
 (select count(*) from text_units u where u.doc_id = d.doc_id and unit_kind = 'sentence') as sentence_count,
 (select count(*) from text_units u where u.doc_id = d.doc_id and unit_kind = 'fragment') as fragment_count,
 (select count(*) from annotations a where a.doc_id = d.doc_id) as annotation_count,
 (select count(distinct label) from annotations a where a.doc_id = d.doc_id) as label_count,
 (select count(*) from annotations a where a.doc_id = d.doc_id and status = 'aligned') as aligned_count from docs d"""),
    "documents_sorted": with_tables("""
select d.doc_id,
 (select count(*) from text_units u where u.doc_id = d.doc_id and unit_kind = 'sentence') as sentence_count,
 (select count(*) from annotations a where a.doc_id = d.doc_id and status = 'aligned') as aligned_count from docs d
where subset = 'en' and (link like '%src1_%' or d.doc_id like '%src1_%')
order by sentence_count desc, subset, num limit 20 offset 1"""),
    **{f"documents_by_{key}": with_tables(f"""
select * from (select d.doc_id,
 (select count(*) from text_units u where u.doc_id = d.doc_id and unit_kind = 'fragment') as fragment_count,
 (select count(*) from annotations a where a.doc_id = d.doc_id) as annotation_count,
 (select count(distinct label) from annotations a where a.doc_id = d.doc_id) as label_count, subset, num from docs d)
order by {order} limit 30""").replace("select * from (select d.doc_id", "select doc_id, fragment_count, annotation_count, label_count from (select d.doc_id")
       for key, order in (("fragment_count", "fragment_count desc, subset, num"),
                          ("annotation_count", "annotation_count desc, subset, num"),
                          ("doc_id", "subset desc, num desc"))},
    "document_frames": with_tables("""
select doc_id, -1 as src_row, title as text, 'document' as status from docs where doc_id in ('en_115', 'de_187')
union all select doc_id, src_row, text, status from annotations where doc_id in ('en_115', 'de_187')"""),
    "document_order": with_units("select doc_id, subset, num::int as num from lines"),
    "doc_neighbours": with_units(
        "select doc_id, lag(doc_id) over (order by subset, num) as prev_id, lead(doc_id) over (order by subset, num) as next_id from lines"),
    "document_units": with_tables("select unit_id, unit_text, verbatim_labels from text_units where doc_id in ('en_115', 'de_187')"),
    "rendered_blocks": with_tables(
        "select doc_id, block_seq, block_kind, position = min(position) over (partition by doc_id, block_seq) as opens_block, unit_id, unit_kind, verbatim_labels from text_units"),
    "doc_annotations": with_tables(
        "select a.annotation_id, a.src_row, a.label, a.status, g.unit_id from annotations a left join alignment g using (annotation_id) where a.ranumb = 'ra1'"),
    "annotations_page": with_tables("""
select p.annotation_id, p.ranumb, p.label, p.status,
  case when p.status = 'ambiguous' then (select string_agg(t.unit_id, ';' order by t.position)
    from ta t join sn s on s.doc_id = t.doc_id and s.norm = t.norm where s.annotation_id = p.annotation_id) end as matched_units
from (select * from annotations order by doc_id, src_row limit 100 offset 5) p"""),
    "stats_counts": with_tables("""
select (select count(*) from docs) as documents, u.*, a.* from (
 select count(*) as units, count(*) filter (unit_kind = 'sentence') as sentences,
  count(*) filter (unit_kind = 'fragment') as fragments,
  count(*) filter (label_category = 'single_label') as single_label_sentences,
  count(*) filter (label_category = 'multi_label') as multi_label_sentences,
  count(*) filter (label_category = 'unlabeled') as unlabeled_sentences,
  count(*) filter (label_category = 'single_label' and annotator_count >= 2) as high_confidence_single,
  count(distinct unit_text) filter (unit_kind = 'sentence') as unique_sentences,
  count(distinct unit_text) filter (unit_kind = 'fragment') as unique_fragments,
  count(distinct unit_text) filter (label_category = 'single_label') as unique_single_label_sentences,
  count(distinct unit_text) filter (label_category = 'multi_label') as unique_multi_label_sentences,
  count(distinct unit_text) filter (label_category = 'unlabeled') as unique_unlabeled_sentences,
  count(distinct unit_text) filter (label_category in ('single_label', 'multi_label')) as unique_defined_samples
 from text_units) u, (
 select count(*) as annotations, count(distinct text) as unique_annotations,
  count(*) filter (status = 'aligned') as aligned, count(*) filter (status = 'unmatched') as unmatched,
  count(*) filter (status = 'ambiguous') as ambiguous from annotations) a"""),
    "sketched_counts": with_tables("""
select subset, count(*) as units,
 count(distinct unit_text) filter (unit_kind = 'sentence') as unique_sentences,
 count(distinct unit_text) filter (unit_kind = 'fragment') as unique_fragments,
 count(distinct unit_text) filter (label_category in ('single_label', 'multi_label')) as unique_defined_samples,
 count(distinct unit_text) filter (label_category in ('single_label', 'multi_label') and not loose) as never_unlabeled
from marked group by subset""",
        "\nmarked as (select *, bool_or(label_category = 'unlabeled') over (partition by subset, unit_text) as loose from text_units)"),
    "stats_of_annotators": with_tables("""
 select count(*) as annotations, count(distinct text) as unique_annotations,
  count(*) filter (status = 'aligned') as aligned, count(*) filter (status = 'unmatched') as unmatched,
  count(*) filter (status = 'ambiguous') as ambiguous from annotations where ranumb in ('ra1', 'ra2')"""),
    "kind_histogram": with_tables("select unit_kind, label_category, count(*) as n from text_units group by all"),
    "subset_histogram": "select lang as subset, count(*) as n from documents group by all",
    "label_distribution": with_tables("""
select l.label, count(distinct unit_id) as count, count(*) filter (u.label_category = 'single_label') as single_label_count
from unit_labels l join text_units u using (unit_id) group by l.label"""),
    "label_counts": with_tables("select label, count(distinct unit_id) as unit_count from unit_labels group by label"),
    "annotator_profile": with_spans(
        "select ranumb, count(*) as n, count(distinct doc_id) as docs, count(distinct label) as labels from spans group by ranumb"),
    "span_label_distribution": with_spans("select label, count(*) as count from spans group by label"),
    "status_by_label": with_tables("""
select label, count(*) filter (status = 'aligned') as aligned, count(*) filter (status = 'unmatched') as unmatched,
 count(*) filter (status = 'ambiguous') as ambiguous from annotations group by label"""),
    "hits_by_label": with_tables("select label, count(distinct unit_id) as hits from unit_labels group by label"),
    "star_histogram": with_support("""
select label_category, stars, count(*) as units, count(distinct unit_text) as texts
from text_units join (select unit_id, max(stars) as stars from support group by 1) using (unit_id) group by 1, 2"""),
    "star_histogram_t2": with_support("""
select label_category, stars, count(*) as units, count(distinct unit_text) as texts
from text_units join (select unit_id, max(stars) as stars from support group by 1) using (unit_id) group by 1, 2""", 2),
    "label_matrix": with_tables("select label, raw, aligned, unmatched, ambiguous, sentences, sentences as hits, "
        + ", ".join(f"case when sum({c}) over () > 0 then {c} / sum({c}) over () else 0.0 end as {c}_share" for c in ("raw", "aligned", "unmatched", "ambiguous"))
        + ", case when all_s > 0 then sentences / all_s else 0.0 end as sentences_share, case when all_d > 0 then sentences / all_d else 0.0 end as hits_share, "
        + ", ".join(f"{c} / greatest(1, max({c}) over ()) as {n}_of_max" for c, n in (
            ("raw", "raw"), ("aligned", "aligned"), ("unmatched", "unmatched"), ("ambiguous", "ambiguous"), ("sentences", "sentences"), ("sentences", "hits")))
        + " from mtx, tot", MATRIX),
    "doc_summary": with_tables("""
select doc_id, u.*exclude (doc_id), coalesce(aligned, 0) as aligned, coalesce(unmatched, 0) as unmatched,
       coalesce(ambiguous, 0) as ambiguous, coalesce(labels, 0) as labels
from (select doc_id, count(*) filter (unit_kind = 'sentence') as sentences, count(*) filter (unit_kind <> 'sentence') as fragments,
  count(*) filter (label_category = 'single_label') as single_label, count(*) filter (label_category = 'multi_label') as multi_label,
  count(*) filter (label_category = 'unlabeled') as unlabeled from text_units group by doc_id) u
left join (select doc_id, count(*) filter (status = 'aligned') as aligned, count(*) filter (status = 'unmatched') as unmatched,
  count(*) filter (status = 'ambiguous') as ambiguous, count(distinct label) as labels from annotations group by doc_id) s using (doc_id)"""),
    "doc_labels": with_tables("select doc_id, label, count(*) as n from unit_labels group by all"),
    "quality_histogram": "select quality, toxic, count(*) as n from labels group by all",
    "search_documents": with_tables(f"""
select doc_id, title, link from docs where {FLD.format('doc_id')} like '%src1_/%' or {FLD.format('title')} like '%src1_/%' or {FLD.format('link')} like '%src1_/%'
order by doc_id limit 5"""),
    "search_labels": with_spans(f"select label, count(*) as count from spans where {FLD.format('label')} like '%right to%' group by label order by count desc, label limit 5"),
    "search_annotators": with_spans(
        "select ranumb, count(*) as count, count(distinct doc_id) as docs from spans where ranumb like '%ra%' group by ranumb order by ranumb limit 5"),
    "search_units": with_tables(f"""
select unit_id, unit_text, unit_kind, label_category, verbatim_labels, {SHOWN} as verbatim_label
from text_units where {FLD.format('unit_text')} like '%ing the%' order by doc_id, position limit 6"""),
    "search_all": with_tables(f"""
select * from (select 'documents' as entity, doc_id as key, link as detail from docs
 where {FLD.format('doc_id')} like '%ing%' or {FLD.format('title')} like '%ing%' or {FLD.format('link')} like '%ing%' order by doc_id limit 5)
union all select * from (select 'provisions', label, count(*)::varchar from annotations where {FLD.format('label')} like '%ing%' group by label order by count(*) desc, label limit 5)
union all select * from (select 'annotators', ranumb, count(*)::varchar from annotations where ranumb like '%ing%' group by ranumb order by ranumb limit 5)
union all select * from (select 'units', unit_id, unit_text from text_units where {FLD.format('unit_text')} like '%ing%' order by doc_id, position limit 6)"""),
    "match_term_table": with_units(f"""
select term_id, unit_id from units join (
 select item_id || '-' || k || '-' || i as term_id, {collapse(FLD.format("array_to_string(w[i:i + k - 1], ' ')"))} as term
 from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from (
   select item_id, string_split(text, ' ') as w,
          unnest(case when len(string_split(text, ' ')) < 3 then [len(string_split(text, ' '))]
                      when len(string_split(text, ' ')) < 6 then [3] else [3, 6] end) as k from benchmark))) b
 on contains({FLD.format('unit_text')}, b.term) where b.term <> ''"""),
    "match_terms": with_units("select term, unit_id from units, (values ('privacy'), ('the and'), ('ing the'), ('Und der')) v(term) where "
        f"contains({FLD.format('unit_text')}, {FLD.format('term')})"),
    "tokenize_labels": with_spans(
        f"select label, {TOKEN_CASE} as token from (select distinct label from spans union select distinct 'A-b é / ' || label from spans)"),
    "cap_single": f"with base as ({line_rows('l_returnflag')}) select doc_id, position, l_partkey, labels[1] as label from base "
        "qualify row_number() over (partition by doc_id, labels[1] order by i) <= m",
    "cap_multi": f"with recursive {capped(line_rows('l_returnflag', 'l_linestatus'), 34)}\n"
        "select doc_id, position, l_partkey, array_to_string(labels, ';') as label from base join walk using (doc_id, i) where kept",
    "cap_repeated_tokens": f"with recursive {capped(line_rows('l_returnflag', 'l_linestatus', 'l_linestatus', pct=60.0), 60)}\n"
        "select doc_id, position, l_partkey from base join walk using (doc_id, i) where kept",
    "cap_units": recursive(with_tables("select unit_id from base join walk using (doc_id, i) where kept",
                                       EXPORTED + "," + capped_units("true", 5))),
    "split_plain": "with " + fill("select l_orderkey as doc_id, '' as bin, count(*) as n from lineitem group by 1", 70, 15, 15, 42)
        + "\nselect doc_id, n, split from assigned",
    "split_stratified": "with lr as (select l_orderkey as doc_id, [l_returnflag] as labels from lineitem),"
        + fill(bins("lr"), 70, 15, 15, 42) + "\nselect doc_id, bin, n, split from assigned",
    "split_fallback": "with " + fill(
        "select o_orderkey as doc_id, o_custkey::varchar as bin, count(*) as n from orders join lineitem on l_orderkey = o_orderkey group by all",
        70, 15, 15, 7) + "\nselect doc_id, bin, n, split from assigned",
    "split_no_train": "with " + fill("select o_orderkey as doc_id, o_custkey::varchar as bin, 1::bigint as n from orders", 0, 50, 50, 7)
        + "\nselect doc_id, bin, n, split from assigned",
    "split_rows_single": """select o_orderkey, case when p <= round_even(t * 70 / 100.0, 0) then 'train'
 when p <= round_even(t * 70 / 100.0, 0) + round_even(t * 15 / 100.0, 0) then 'eval' else 'test' end as split
from (select o_orderkey, row_number() over (order by md5('42:' || o_orderkey), o_orderkey) as p, count(*) over () as t from orders)""",
    "split_units": with_tables("select unit_id, split from text_units join assigned using (doc_id)", SPLIT_UNITS),
    "split_counts": with_tables(
        "select " + ", ".join(f"count(*) filter (split = '{s}') as {s}" for s in ("train", "eval", "test"))
        + " from text_units join assigned using (doc_id)", SPLIT_UNITS),
    "export_rows": with_support(f"""
select unit_id as id, doc_id as "group", unit_text as text, array_to_string(tokens, '; ') as label, array_to_string(names, '; ') as label_name,
 coalesce((select max(stars)::varchar from support s where s.unit_id = r.unit_id), '') as support_stars,
 coalesce((select max(k)::varchar from support s where s.unit_id = r.unit_id), '') as support_evidence, alignment_types, 'data' as split
from rows_x r where not list_contains(labels, 'Others') and ({SINGLE} or {MULTI}) and unit_id in {gate(1)}""", 1, EXPORTED),
    "export_report": recursive(with_support("""
select count(*) as total, """ + ", ".join(f"count(*) filter (split = '{s}') as {s}" for s in ("train", "eval", "test")) + """,
 count(*) filter (label_category = 'unlabeled') as unlabeled_count, count(*) filter (unit_kind = 'fragment') as fragment_count,
 (select count(*) from base) as original_total, (select count(*) from base) - count(*) as capped_units_removed
from kept join assigned using (doc_id)""", 1, EXPORTED + "," + capped_units(f"({SINGLE} or {MULTI}) and unit_id in {gate(1)} or {NULL}", 20)
        + ",\nkept as materialized (select t.* from text_units t join base b using (unit_id) join walk w on w.doc_id = b.doc_id and w.i = b.i and w.kept),"
        + fill(bins("kept"), 70, 15, 15, 42))),
    "label_dist_export": with_tables("select token, count(*) as n from (select unnest(tokens) as token from rows_x) group by token", EXPORTED),
    "support_analysis": with_support(f"""
select token, count(*) as raw_count, round_even(count(*) / (select count(*) from rows_x) * 100.0, 2) as percentage_of_corpus,
 count(distinct doc_id) as distinct_documents,
 case when count(k) > 0 then round_even(sum(k)::bigint / count(k), 2) else 0.0 end as avg_supporting_annotators,
 case when count(k) > 0 then round_even(sum(k / pool) / count(k), 4) else 0.0 end as mean_agreement_rate,
 count(*) filter (stars = 3) as unanimous_count, count(*) filter (stars = 1) as disputed_count
from (select unit_id, doc_id, unnest(tokens) as token from rows_x) r
left join (select unit_id, {TOKEN_CASE} as token, k, pool, stars from support) s using (unit_id, token) group by token""", 1, EXPORTED),
    "text_overlap": with_tables("""
select count(*) as overlapping_texts_count from (
 select trim(unit_text) from text_units join assigned using (doc_id) where trim(unit_text) <> '' group by 1 having count(distinct split) > 1)""", SPLIT_UNITS),
    "split_leaks": with_tables("""
select 'one split per document' as rule, count(*) as violations from (
 select doc_id from text_units join assigned using (doc_id) group by doc_id having count(distinct split) > 1)""", SPLIT_UNITS),
    "split_leaks_damaged": with_tables("""
select 'one split per document' as rule, count(*) as violations from (
 select doc_id from text_units join assigned using (doc_id) group by doc_id
 having count(distinct case when position = 2 then 'test' else split end) > 1)""", SPLIT_UNITS),
    "export_csv": with_tables("""
select unit_id as id, doc_id, unit_text as text, array_to_string(tokens, '; ') as label,
 array_to_string(names, '; ') as label_name, split, true as same from rows_x join assigned using (doc_id)""", SPLIT_UNITS),
    "export_json": with_tables("""
select split, unit_id as id, subset, array_to_string(tokens, '|') as label,
 array_to_string(names, '|') as label_name from rows_x join assigned using (doc_id)""", SPLIT_UNITS),
    "export_meta": with_tables("""
select count(*) as total, count(*) as original_total, 0::bigint as capped_units_removed, """
        + ", ".join(f"count(*) filter (split = '{s}') as {s}" for s in ("train", "eval", "test")) + """,
 (select count(*) from (select trim(unit_text) from text_units join assigned using (doc_id) where trim(unit_text) <> ''
   group by 1 having count(distinct split) > 1)) as overlapping_texts_count,
 count(*) filter (label_category = 'unlabeled') as unlabeled_count
from rows_x join assigned using (doc_id)""", SPLIT_UNITS),
    "preview_report": recursive(with_tables("""
select true as valid, count(*) as total, (select count(*) from base) - count(*) as removed, """
        + ", ".join(f"count(*) filter (split = '{s}') as {s}" for s in ("train", "eval", "test")) + """,
 (select count(*) from (select trim(unit_text) from kept join assigned using (doc_id) where trim(unit_text) <> ''
   group by 1 having count(distinct split) > 1)) as overlap,
 (count(*) filter (split = 'train') = 0)::int + (count(*) filter (split = 'eval') = 0)::int
 + (count(*) filter (split = 'test') = 0)::int + ((select count(*) from (
   select trim(unit_text) from kept join assigned using (doc_id) where trim(unit_text) <> ''
   group by 1 having count(distinct split) > 1)) > 0)::int::bigint as warnings
from kept join assigned using (doc_id)""", EXPORTED + "," + capped_units("subset = 'fr'", 20)
        + ",\nkept as materialized (select t.* from text_units t join base b using (unit_id) join walk w on w.doc_id = b.doc_id and w.i = b.i and w.kept),"
        + fill(bins("kept"), 70, 15, 15, 42))),
    "corpus_slice": with_tables("""
select 'documents' as "table", count(*) as n from keep union all select 'annotations', count(*) from annotations semi join keep using (doc_id)
union all select 'text_units', count(*) from text_units semi join keep using (doc_id)
union all select 'unit_labels', count(*) from unit_labels semi join keep using (doc_id)
union all select 'alignment', count(*) from alignment semi join keep using (doc_id)
union all select 'ambiguous', count(*) from (select * from ta where hits > 1) semi join keep using (doc_id)""",
        "\nkeep as materialized (select doc_id from docs qualify row_number() over (partition by subset order by num) <= 5)"),
    "slice_rows": with_tables("""
select 'text_units' as "table", doc_id, unit_id as key from text_units semi join keep using (doc_id)
union all select 'annotations', doc_id, annotation_id from annotations semi join keep using (doc_id)
union all select 'alignment', doc_id, unit_id || '/' || annotation_id from alignment semi join keep using (doc_id)
union all select 'unit_labels', doc_id, unit_id || '/' || label from unit_labels semi join keep using (doc_id)""",
        "\nkeep as materialized (select doc_id from docs qualify row_number() over (partition by subset order by num) <= 5)"),
    "row_manifest": with_tables("""
select 'documents' as "table", count(*) as n from docs union all select 'annotations', count(*) from annotations
union all select 'text_units', count(*) from text_units union all select 'unit_labels', count(*) from unit_labels
union all select 'alignment', count(*) from alignment
union all select 'ambiguous', (select count(*) from ta where hits > 1)"""),
    "fingerprint": f"""
select count(*) as n, bit_xor(h) as xor_hash, sum(h::hugeint)::varchar as sum_hash from (
 select ('0x' || left(md5(concat_ws(chr(31), {', '.join(LINE_COLUMNS)})), 15))::bigint as h from lineitem)""",
    "unit_fingerprint": with_tables("""
select count(*) as n, bit_xor(h) as xor_hash, sum(h::hugeint)::varchar as sum_hash from (
 select ('0x' || left(md5(concat_ws(chr(31), unit_id, doc_id, subset, position::varchar, block_seq::varchar, block_kind, unit_text, unit_kind,
 coalesce(fragment_type, chr(0)), label_category, annotator_count::varchar, source_annotation_count::varchar, coalesce(alignment_types, chr(0)),
 array_to_string(labels, ';'), coalesce(annotators, ''))), 15))::bigint as h from text_units)"""),
}
for _mode in ("at_least", "exact"):
    for _tier in (1, 2, 3):
        SQL[f"support_gate_{_mode}_{_tier}"] = with_support(f"select unit_id from {gate(_tier, _mode)}")


def page_piece(pattern: str) -> str:
    """Text of one part of a page: tags become spaces, entities are decoded."""
    text = f"regexp_replace(regexp_extract(html, {lit(pattern)}, 1), '<[^>]*>', ' ', 'g')"
    for entity, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', {lit(char)})"
    return collapse(text)


# The pages hold a notice, a heading and one article whose first paragraph is
# never closed, so that everything behind the heading is one block.
PAGES = f"""
page_parts as materialized (
  select page_id, [{{'k': 'prose', 't': {page_piece('(?s)<div class="ad">(.*?)</div>')}}},
                   {{'k': 'heading', 't': {page_piece('(?s)<h1>(.*?)</h1>')}}},
                   {{'k': 'prose', 't': {page_piece('(?s)</h1>(.*?)(?:</article>|$)')}}}] as parts from pages),
page_lists as (select page_id, list_filter(parts, lambda p: regexp_matches(p.t, '[\\pL\\pN]')) as ps from page_parts),
page_rows as materialized (
  select page_id, unnest(range(len(ps)))::int as block_seq, unnest(ps).k as block_kind, unnest(ps).t as text from page_lists)"""

PAGE_UNITS = f"""{PAGES},
page_cut as (select 'P_' || page_id as doc_id, block_seq, block_kind, {sentences('text')} as ss from page_rows),
page_numbered as (select doc_id, block_seq, block_kind, unnest(ss) as t, unnest(range(len(ss))) as i from page_cut),
page_placed as (
  select doc_id, block_seq, block_kind, t, row_number() over (partition by doc_id order by block_seq, i) as position,
         {N} as n, {PROBE} as probe from page_numbered)"""

SQL["page_blocks"] = f"with {PAGES}\nselect page_id, block_seq, block_kind, text from page_rows"
SQL["page_text"] = f"with {PAGES}\nselect page_id as doc_id, string_agg(text, chr(10) order by block_seq) as text from page_rows group by page_id"
SQL["page_units"] = f"""with {PAGE_UNITS}
select doc_id || '_U' || position as unit_id, block_seq, block_kind, t as unit_text,
       case when ft is null then 'sentence' else 'fragment' end as unit_kind, ft as fragment_type
from (select *, {FRAGMENT_TYPE} as ft from page_placed)"""

RULES = (
    "unique documents(doc_id)", "unique documents(subset, num)", "unique annotations(annotation_id)",
    "unique annotations(doc_id, src_row)", "unique text_units(unit_id)", "unique text_units(doc_id, position)",
    "unique unit_labels(unit_id, label)", "unique alignment(unit_id, annotation_id)",
    "reference annotations.doc_id", "reference text_units.doc_id", "reference unit_labels.unit_id",
    "reference alignment.unit_id", "reference alignment.annotation_id", "domain documents.subset",
    "domain annotations.status", "domain text_units.unit_kind", "domain text_units.block_kind",
    "domain text_units.fragment_type", "domain text_units.label_category", "domain alignment.alignment_type",
    "not null documents", "not null annotations", "not null text_units", "not null unit_labels", "not null alignment")


def integrity(docs="docs", annotations="annotations", units="text_units", labels="unit_labels",
              alignment="alignment", subsets=("en", "de", "fr", "es")) -> str:
    """Violations of every rule, counted in the given tables."""
    frags = ("phone", "email", "url", "nav", "button", "copyright", "heading", "list_item", "lead_in", "short", "other")

    def twice(table, key):
        return f"(select count(*) from (select 1 from {table} group by {key} having count(*) > 1))"

    def lost(table, key, target):
        return f"(select count(*) from {table} x where not exists (select 1 from {target} y where y.{key} = x.{key}))"

    def outside(table, column, values, nullable=False):
        given = f"{column} not in ({', '.join(lit(v) for v in values)})"
        return f"(select count(*) from {table} where {given if nullable else f'coalesce({given}, true)'})"

    def missing(table, columns):
        return f"(select count(*) from {table} where {' or '.join(c + ' is null' for c in columns.split())})"

    counted = [
        twice(docs, "doc_id"), twice(docs, "subset, num"), twice(annotations, "annotation_id"),
        twice(annotations, "doc_id, src_row"), twice(units, "unit_id"), twice(units, "doc_id, position"),
        twice(labels, "unit_id, label"), twice(alignment, "unit_id, annotation_id"),
        lost(annotations, "doc_id", docs), lost(units, "doc_id", docs), lost(labels, "unit_id", units),
        lost(alignment, "unit_id", units), lost(alignment, "annotation_id", annotations),
        outside(docs, "subset", subsets), outside(annotations, "status", ("aligned", "unmatched", "ambiguous")),
        outside(units, "unit_kind", ("sentence", "fragment")), outside(units, "block_kind", ("prose", "heading", "list")),
        outside(units, "fragment_type", frags, True),
        outside(units, "label_category", ("single_label", "multi_label", "unlabeled", "not-eligible")),
        outside(alignment, "alignment_type", ("annotation_in_sentence", "sentence_in_annotation_paragraph", "partial_overlap")),
        missing(docs, "doc_id subset num"), missing(annotations, "annotation_id doc_id ranumb text label status src_row"),
        missing(units, "unit_id doc_id subset position block_seq block_kind unit_text unit_kind label_category annotator_count source_annotation_count"),
        missing(labels, "unit_id label doc_id"), missing(alignment, "unit_id annotation_id alignment_type doc_id label ranumb unit_kind")]
    return " union all ".join(f"select {lit(r)} as rule, {n} as violations" for r, n in zip(RULES, counted))


SQL["integrity"] = with_tables(integrity())
SQL["integrity_damaged"] = with_tables(
    integrity(units="bad_units", labels="bad_labels", annotations="bad_annotations", alignment="bad_alignment",
              subsets=("en", "de", "fr")), """,
bad_units as materialized (select * replace (case when position = 1 then 'odd' else unit_kind end as unit_kind,
  case when position = 3 then 'nowhere' else doc_id end as doc_id) from text_units),
bad_labels as materialized (select * from unit_labels union all select * from unit_labels where label = 'Others'),
bad_annotations as materialized (select * replace (case when ranumb <> 'ra3' then label end as label) from annotations),
bad_alignment as materialized (select * replace (case when ranumb = 'ra1' then 'nowhere_U1' else unit_id end as unit_id) from alignment)""".lstrip(","))

COUNTS = {
    "aligned": "(select count(*) from annotations where status = 'aligned')",
    "ambiguous": "(select count(*) from annotations where status = 'ambiguous')",
    "annotations": "(select count(*) from annotations)", "documents": "(select count(*) from docs)",
    "fragments": "(select count(*) from text_units where unit_kind = 'fragment')",
    "high_confidence_single": "(select count(*) from text_units where label_category = 'single_label' and annotator_count >= 2)",
    "multi_label_sentences": "(select count(*) from text_units where label_category = 'multi_label')",
    "sentences": "(select count(*) from text_units where unit_kind = 'sentence')",
    "single_label_sentences": "(select count(*) from text_units where label_category = 'single_label')",
    "unlabeled_sentences": "(select count(*) from text_units where label_category = 'unlabeled')",
    "units": "(select count(*) from text_units)",
    "unmatched": "(select count(*) from annotations where status = 'unmatched')",
}
COUNTS["subsets"] = ("('{' || (select string_agg('\"' || subset || '\":' || n, ',' order by subset)"
                     " from (select subset, count(*) as n from docs group by subset)) || '}')")
_PAIRS = " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in sorted(COUNTS.items()))
SQL["build_manifest"] = with_tables(f"select 'counts' as key, '{{' || {_PAIRS} || '}}' as value")

SOURCE = """
src as materialized (
  select case when page_id % 2 = 0 then 'DB' else 'WS' end as subset, (page_id // 2 + 1)::int as num, url, html,
         regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) as head from pages),
named as materialized (select *, subset || '_' || num as doc_id from src)"""
SQL["source_html"] = f"with {SOURCE}\nselect subset, num, md5(html) as html_md5 from named"
SQL["source_spans"] = f"""with {SOURCE}
select doc_id || '_A' || j as annotation_id, doc_id, 'ra' || (j + 1) as ranumb, head as text,
       case j when 0 then 'Others' else 'Methods to exercise rights' end as label, j::int as src_row
from named, range(2) r(j) where trim(head) <> ''"""
SQL["source_crawl"] = f"with {SOURCE}\nselect subset, num, url as link, 'y' as is_homepage from named"
SQL["source_pages"] = f"with {SOURCE}\nselect doc_id, subset, num, url as link, length(html) as n from named"
SQL["source_max_docs"] = f"with {SOURCE}\nselect doc_id, url as link from named order by subset, num::varchar || '.csv' limit 25"

SQL["units_filter_q_indexed"] = SQL["units_filter_q"]
SQL["search_units_indexed"] = SQL["search_units"]
SQL["snapshot_diff"] = with_tables("""
select distinct doc_id || case n when 13 then 'x' else '' end as doc_id,
  case n when 7 then 'removed' when 11 then 'changed' else 'added' end as change
from (select doc_id, string_split(doc_id, '_')[2]::int % 50 as n from text_units) where n in (7, 11, 13)""")
SQL["export_order"] = with_tables("""
select split as part, row_number() over (partition by split order by doc_id, position)::int as place, unit_id as id,
  count(*) over (partition by split) as n_in_part
from rows_x join assigned using (doc_id)""", SPLIT_UNITS)
SQL["export_meta_fields"] = with_support(f"""
select 'units' as entity, 'json' as format, 'fr' as subset, {lit(LABELS[0] + '|' + LABELS[11])} as labels,
  2::bigint as min_support, 'at_least' as support_mode, 1::bigint as evidence_threshold, 70::bigint as train,
  'doc_id' as grouped_by, count(*) as total, 'id|label' as selected, true as dated,
  count(*) filter (list_contains(labels, 'Others')) as n_others, false as noted
from text_units where subset = 'fr' and {LABEL_SETS['any_two']} and {DEFINED} and unit_id in {gate(2)}""")
SQL["export_unsplit"] = with_tables("""
select unit_id as id, 'data' as split, fragment_type, 'data' as part, (select count(*) from text_units) as total from text_units""")
SQL["export_notes"] = with_tables("""
select case when count(*) filter (label_category = 'unlabeled') > 0 then
    'No annotator marked the unlabeled sentences; that does not make them negatives.' end as unlabeled_note,
  case when count(*) filter (unit_kind = 'fragment') > 0 then 'Fragments never carry labels.' end as fragments_note,
  'All units of a document are in the same split.' as grouping_note, true as dated from text_units""")
SQL["manifest_checks"] = """
select *, (select count(*) from range(5)) as entries from (values ('same', true, null), ('other', false, 'version_mismatch'),
  ('missing', false, 'missing'), ('no_version', false, 'missing_version')) v("case", ok, reason)"""
SQL["sql_units"] = with_support(f"""
select t.unit_id, t.position, b.stars, array_to_string(t.labels, ';') as labels, s.label, {TOKEN_CASE} as token, s.k, s.stars as tier
from text_units t join (select unit_id, max(stars) as stars from support group by unit_id) b on b.unit_id = t.unit_id
join support s on s.unit_id = t.unit_id
where b.stars >= 2 and contains({FLD.format('t.unit_text')}, 'the')""")
