"""The catalog queries again as DuckDB SQL over the raw tables, written independently of the jobs.

Only fixed values (templates, word lists, labels, whitespace set) are shared with the package.
"""

from __future__ import annotations

from ticketloom.catalog.tables import AS_OF, ORDERS_AS_OF
from ticketloom.functions.language import HINGLISH_LEXICON
from ticketloom.functions.text import SPACE_CLASS, STOP_WORDS
from ticketloom.operators.replies import BODIES, FRAMES
from ticketloom.sources.synthetic import AMOUNTS, GENERATED_CHANNELS, NOISE, SUFFIXES, TEMPLATES
from ticketloom.taxonomy import DEPARTMENT_KEYWORDS, TAXONOMY


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def values(rows) -> str:
    cells = lambda r: ", ".join(str(x) if isinstance(x, (int, float)) else q(x) for x in r)
    return "(VALUES " + ", ".join(f"({cells(r)})" for r in rows) + ")"


SP = SPACE_CLASS
SLA = "CASE {u} WHEN 'P1' THEN 1 WHEN 'P2' THEN 4 WHEN 'P3' THEN 24 WHEN 'P4' THEN 72 ELSE 24 END"
LABEL = "CASE {u} WHEN 'P1' THEN 'Critical' WHEN 'P2' THEN 'High' WHEN 'P3' THEN 'Normal' WHEN 'P4' THEN 'Low' ELSE {e} END"


def sla(u: str) -> str:
    return "CAST(" + SLA.format(u=u) + " AS INTEGER)"


def label(u: str, other: str = "''") -> str:
    return LABEL.format(u=u, e=other)


def hours(n: str) -> str:
    return f"to_hours({n})"


SUFFIX_CASE = " ".join(
    f"WHEN {q(lang)} THEN ({lst(c)})[(id % 999983) // 7 % {len(c)} + 1]" for lang, c in SUFFIXES.items()
)
TICKETS = f"""
bank AS (SELECT * FROM {values([(i, *t) for i, t in enumerate(TEMPLATES)])} b(tid, department, urgency, language, template)),
spine AS (SELECT event_id AS id, user_id, ts AS created_at,
  (event_id % 999983 * 31 + user_id % 999983 * 17) % {len(TEMPLATES)} AS tid FROM events),
tickets AS (
  SELECT id, created_at, department, urgency, language,
    ({lst(GENERATED_CHANNELS)})[(id % 999983) // 3 % {len(GENERATED_CHANNELS)} + 1] AS channel,
    trim(replace(replace(template || CASE language {SUFFIX_CASE} END,
        '{{n}}', CAST(id % 90000 * 7919 % 90000 + 10000 AS VARCHAR)),
        '{{amt}}', ({lst(AMOUNTS)})[(id % 999983) // {len(TEMPLATES)} % {len(AMOUNTS)} + 1])
      || CASE WHEN (id % 999983 * 37 + 11) % 100 < 8 THEN ' ' || ({lst(NOISE)})[id % 999983 % {len(NOISE)} + 1] ELSE '' END, ' ') AS text
  FROM spine JOIN bank USING (tid))"""


def language(t: str) -> str:
    toks = f"regexp_extract_all(lower({t}), '[a-zA-Z'']+')"
    hits = f"len(list_filter({toks}, lambda w: list_contains({lst(HINGLISH_LEXICON)}, w)))"
    ratio = f"length(regexp_replace({t}, '[^a-zA-Z]', '', 'g')) / length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))::DOUBLE"
    return f"""CASE WHEN {t} IS NULL OR NOT regexp_matches({t}, '[^{SP}]') THEN 'other'
      WHEN regexp_matches({t}, '[\\x{{900}}-\\x{{97F}}]') THEN 'hi'
      WHEN regexp_matches({t}, '[\\x{{980}}-\\x{{D7F}}]') THEN 'other'
      WHEN len({toks}) = 0 THEN 'other'
      WHEN {hits} >= 2 OR ({hits} = 1 AND len({toks}) <= 8) THEN 'hinglish'
      WHEN {ratio} < 0.5 THEN 'other' ELSE 'en' END"""


def norm(t: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(replace(nfc_normalize(coalesce({t}, '')), chr(160), ' '), "
        f"'https?://[^{SP}]+', ' ', 'g'), '[{SP}]+', ' ', 'g'), ' ')"
    )


def squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '[{SP}]+', ' ', 'g'), ' ')"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{SP}]+|[{SP}]+$', '', 'g')"


TEXTS = f"""{TICKETS},
texts AS (SELECT 'ticket' AS src, id, text FROM tickets
  UNION ALL SELECT 'document', doc_id, text FROM documents)"""

DECOMPOSED_PARTS = """parts AS (SELECT 'part' AS src, p_partkey AS id, CASE p_partkey % 4
    WHEN 0 THEN replace(p_name, 'e', 'e' || chr(769)) WHEN 1 THEN replace(p_name, 'r', 'o' || chr(803) || chr(775))
    WHEN 2 THEN replace(p_name, 'i', chr(4370) || chr(4449) || chr(4523))
    ELSE replace(p_name, 'l', chr(2325) || chr(2364) || chr(2344) || chr(2364)) END AS text FROM part)"""

INBOX = f"""{TICKETS},
raw_inbox AS (SELECT id, created_at, text, channel, {language('text')} AS language, department, urgency,
    round(0.30 + id * 13 % 70 / 100.0::DOUBLE, 2) AS confidence FROM tickets),
inbox AS (SELECT *, confidence < 0.45 AS needs_human, {sla('urgency')} AS sla_hours,
    created_at + {hours(sla('urgency'))} AS due_at,
    CASE WHEN confidence < 0.45 THEN 'needs_human' ELSE 'open' END AS status FROM raw_inbox)"""

CORRECTIONS = f"""
corrections AS (SELECT event_id AS id,
    CASE WHEN user_id % 3 = 0 THEN 0 ELSE 2 * event_id - user_id END AS ticket_id,
    ts + INTERVAL 1 DAY AS ts,
    ({lst(TAXONOMY.departments)})[(event_id + user_id) % 7 + 1] AS override_dept,
    ({lst(TAXONOMY.urgencies)})[CAST(floor(value) AS BIGINT) % 4 + 1] AS override_urg,
    'note ' || event_id AS note
  FROM events WHERE event_type = 'error'),
accepted AS (SELECT * FROM corrections WHERE ticket_id IN (SELECT id FROM inbox))"""

CURRENT = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY id DESC) AS rn FROM accepted),
current_inbox AS (SELECT i.id, coalesce(o.override_dept, i.department) AS department, i.language,
    coalesce(o.override_urg, i.urgency) AS urgency,
    {sla('coalesce(o.override_urg, i.urgency)')} AS sla_hours,
    i.created_at + {hours(sla('coalesce(o.override_urg, i.urgency)'))} AS due_at,
    CASE WHEN o.id IS NOT NULL THEN 'overridden' ELSE i.status END AS status, i.needs_human
  FROM inbox i LEFT JOIN ranked o ON o.ticket_id = i.id AND o.rn = 1)"""

AUDIT = """
audit AS (SELECT c.id, c.ticket_id, c.ts,
    coalesce(lag(c.override_dept) OVER w, i.department) AS pred_dept,
    coalesce(lag(c.override_urg) OVER w, i.urgency) AS pred_urg,
    c.override_dept, c.override_urg, c.note
  FROM accepted c JOIN inbox i ON i.id = c.ticket_id
  WINDOW w AS (PARTITION BY c.ticket_id ORDER BY c.id))"""

_HEAD = "replace(replace(replace(f.head, '{urg}', t.urgency), '{label}', " + label("t.urgency", "t.urgency") + "), '{dept}', t.department)"
_BODY = f"coalesce(b.body, {q(BODIES['en']['Feedback / General'])})"
DRAFTED = f"""{TICKETS},
bodies AS (SELECT * FROM {values([(la, d, t) for la, m in BODIES.items() for d, t in m.items()])} b(lang, department, body)),
frames AS (SELECT * FROM {values([(la, h, t) for la, (h, t) in FRAMES.items()])} f(lang, head, quote)),
odd AS (SELECT id, text, channel, CASE WHEN id % 17 = 0 THEN 'Gift cards' ELSE department END AS department,
    CASE WHEN id % 17 = 1 THEN 'other' ELSE {language('text')} END AS language,
    CASE WHEN id % 17 = 2 THEN 'P9' ELSE urgency END AS urgency FROM tickets),
drafted AS (SELECT t.*, substring({squeeze('t.text')}, 1, 140) AS snippet,
    {_HEAD} || ' ' || replace({_BODY}, '{{sla}}', CAST({sla('t.urgency')} AS VARCHAR))
      || replace(f.quote, '{{quote}}', substring({squeeze('t.text')}, 1, 140)) AS template_reply
  FROM odd t JOIN frames f ON f.lang = CASE WHEN t.language = 'other' THEN 'en' ELSE t.language END
  LEFT JOIN bodies b ON b.lang = f.lang AND b.department = t.department)"""

W = "[^\\p{L}\\p{N}_]"


def mentions(text: str, n: str) -> str:
    return (
        f"regexp_matches({text}, '(?i)(^|\\P{{Nd}})' || {n} || '[{SP}]*"
        f"(h({W}|$)|hours?({W}|$)|hour\\(s\\)|hrs?({W}|$)|घंटे|ghante)')"
    )


TERMS = """
toks AS (SELECT id, regexp_extract_all(lower(norm), '[\\p{L}\\p{N}_]{2,}') AS t FROM normed),
occ AS (SELECT id, unnest(t) AS term FROM toks
  UNION ALL SELECT id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks),
tf AS (SELECT id, term, count(*) AS tf FROM occ GROUP BY ALL),
freq AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term)"""


def weights(min_df: int, tf: str) -> str:
    return f"""
vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM normed))::DOUBLE / (1 + df)) + 1 AS idf
  FROM freq WHERE df >= {min_df} ORDER BY cf DESC, term LIMIT 20000),
raw AS (SELECT id, term, {tf} * idf AS w FROM tf JOIN vocab USING (term)),
weighted AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"""


DOCS_NORMED = f"normed AS (SELECT doc_id AS id, text, {norm('text')} AS norm FROM documents)"
TICKETS_NORMED = f"{TICKETS}, normed AS (SELECT *, {norm('text')} AS norm FROM tickets)"


def hits(t: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({t}), {q(w)}) AS INTEGER)" for w in words) + ")"


def keyword(t: str) -> str:
    scores = [hits(t, w) for w in DEPARTMENT_KEYWORDS.values()]
    best = f"greatest({', '.join(scores)})"
    arms = " ".join(f"WHEN {s} = {best} THEN {q(d)}" for s, d in zip(scores, DEPARTMENT_KEYWORDS))
    return f"CASE WHEN {best} = 0 THEN 'Feedback / General' {arms} END"


SPLIT = """
keyed AS (SELECT *, row_number() OVER (PARTITION BY department ORDER BY md5('42:' || id), id) AS rk,
    count(*) OVER (PARTITION BY department) AS cnt FROM {src}),
splitted AS (SELECT *, CASE WHEN rk <= round(cnt * 0.70::DOUBLE) THEN 'train' WHEN rk <= round(cnt * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM keyed)"""
EVALUATED = f"""{TICKETS_NORMED}, {SPLIT.format(src='normed')},
evaluated AS (SELECT *, {keyword('norm')} AS pred_dept,
    CASE WHEN id % 10 = 0 THEN 'P3' ELSE urgency END AS pred_urg FROM splitted)"""


def report(name: str, src: str, gold: str, pred: str, labels) -> str:
    """CTEs {name}_report(split, class, metric, value)."""
    return f"""
{name}_pairs AS (SELECT split, {gold} AS g, {pred} AS p, count(*) AS n FROM {src} GROUP BY ALL),
{name}_cls AS (SELECT s.split, c.class,
    coalesce((SELECT sum(n) FROM {name}_pairs x WHERE x.split = s.split AND g = c.class), 0) AS sup,
    coalesce((SELECT sum(n) FROM {name}_pairs x WHERE x.split = s.split AND p = c.class), 0) AS prd,
    coalesce((SELECT sum(n) FROM {name}_pairs x WHERE x.split = s.split AND g = c.class AND p = c.class), 0) AS tp
  FROM (SELECT DISTINCT split FROM {name}_pairs) s, (SELECT unnest({lst(labels)}) AS class) c),
{name}_sc AS (SELECT *, CASE WHEN prd = 0 THEN 0 ELSE tp / prd::DOUBLE END AS precision,
    CASE WHEN sup = 0 THEN 0 ELSE tp / sup::DOUBLE END AS recall,
    CASE WHEN sup + prd = 0 THEN 0 ELSE 2.0 * tp / (sup + prd)::DOUBLE END AS f1 FROM {name}_cls),
{name}_all AS (SELECT split, sum(n) AS n, sum(CASE WHEN g = p THEN n ELSE 0 END) AS ok,
    bool_or(NOT list_contains({lst(labels)}, g) OR NOT list_contains({lst(labels)}, p)) AS open FROM {name}_pairs GROUP BY split),
{name}_tot AS (SELECT split, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
    sum(precision * sup) / sum(sup) AS wp, sum(recall * sup) / sum(sup) AS wr, sum(f1 * sup) / sum(sup) AS wf,
    sum(sup)::DOUBLE AS s, sum(tp)::DOUBLE AS tp, sum(prd)::DOUBLE AS prd FROM {name}_sc GROUP BY split),
{name}_report AS (
  SELECT split, class, 'precision' AS metric, precision::DOUBLE AS value FROM {name}_sc
  UNION ALL SELECT split, class, 'recall', recall FROM {name}_sc
  UNION ALL SELECT split, class, 'f1', f1 FROM {name}_sc
  UNION ALL SELECT split, class, 'support', sup FROM {name}_sc
  UNION ALL SELECT split, 'accuracy', 'accuracy', ok / n::DOUBLE FROM {name}_all WHERE NOT open
  UNION ALL SELECT t.split, 'micro avg', m.metric, m.value FROM {name}_tot t JOIN {name}_all a USING (split),
    LATERAL (VALUES ('precision', tp / prd), ('recall', tp / s), ('f1', 2 * tp / (prd + s)), ('support', s)) m(metric, value) WHERE a.open
  UNION ALL SELECT split, 'macro avg', m.metric, m.value FROM {name}_tot,
    LATERAL (VALUES ('precision', mp), ('recall', mr), ('f1', mf), ('support', s)) m(metric, value)
  UNION ALL SELECT split, 'weighted avg', m.metric, m.value FROM {name}_tot,
    LATERAL (VALUES ('precision', wp), ('recall', wr), ('f1', wf), ('support', s)) m(metric, value))"""


RANKED_TOKENS = f"""
tk AS (SELECT src, id, regexp_extract_all(lower({norm('text')}), '[a-zA-Z\\x{{900}}-\\x{{97F}}'']+') AS t FROM texts),
ex AS (SELECT src, id, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM tk),
cn AS (SELECT src, id, tok, count(*) AS n, min(pos) AS pos FROM ex
  WHERE length(tok) > 2 AND NOT list_contains({lst(STOP_WORDS)}, tok) GROUP BY src, id, tok),
rk AS (SELECT src, id, tok AS token, row_number() OVER (PARTITION BY src, id ORDER BY n DESC, pos) AS rank FROM cn)"""

ANSWERS = """
full_answer AS (SELECT *, '{"suggested_reply":' || to_json('Rewritten: ' || template_reply)::VARCHAR || ',"rationale":"clearer"}' AS good FROM drafted),
answered AS (SELECT *, channel <> 'email' AS has_answer, id % 9 AS kind FROM full_answer),
judged AS (SELECT *, 'Rewritten: ' || template_reply AS cand FROM answered)"""

# kind 0-2 carry a good object, 3 another SLA, 4 an array, 5 an empty object, 6 a blank reply, 7 no JSON, 8 a failure.
POLISH = f"""{DRAFTED}, {ANSWERS},
verdict AS (SELECT *, {sla('urgency')} AS h, has_answer AND language <> 'other' AND kind <= 2 AND CASE {sla('urgency')} WHEN 1 THEN {mentions('cand', "'1'")} WHEN 4 THEN {mentions('cand', "'4'")}
    WHEN 24 THEN {mentions('cand', "'24'")} ELSE {mentions('cand', "'72'")} END AS used FROM judged)
SELECT id, CASE WHEN used THEN {strip('cand')} ELSE template_reply END AS suggested_reply,
  CASE WHEN used THEN 'sklearn+llm:groq' ELSE 'sklearn' END AS source,
  CASE WHEN language = 'other' OR NOT has_answer THEN 'none' ELSE 'groq' END AS llm_backend,
  CASE WHEN language = 'other' OR used THEN NULL WHEN NOT has_answer THEN 'no LLM backend'
    WHEN kind = 8 THEN 'TimeoutError: read timed out' WHEN kind IN (4, 7) THEN 'LLM did not return JSON'
    WHEN kind = 5 THEN NULL WHEN kind = 6 THEN 'empty reply'
    ELSE 'SLA ' || h || 'h missing in LLM reply; using template' END AS llm_error,
  CASE WHEN used THEN 'clearer' ELSE '' END AS rationale
FROM verdict"""

SIMILAR = f"""
WITH {DOCS_NORMED}, {TERMS}, {weights(1, 'tf')},
dots AS (SELECT a.id AS q, b.id AS d, sum(a.weight * b.weight) AS s FROM weighted a JOIN weighted b USING (term) GROUP BY ALL),
others AS (SELECT x.id AS q, y.id AS d, coalesce(s, 0.0::DOUBLE) AS s FROM normed x JOIN normed y ON x.norm <> y.norm AND x.norm <> ''
  LEFT JOIN dots ON dots.q = x.id AND dots.d = y.id),
ranked AS (SELECT q, d, s, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, d) AS rank FROM others)
SELECT q AS query_id, CAST(rank AS INTEGER) AS rank, d AS similar_id, round(s, 3) AS score, substring(text, 1, 240) AS text
FROM ranked JOIN normed n ON n.id = d WHERE rank <= 3"""


def by_shares(name: str, target: str) -> str:
    """CTE {name}_ranked (id, label, p, rk): classes of every ticket by whole-number shares of its terms."""
    return f"""
{name}_classes AS (SELECT DISTINCT {target} AS label FROM train),
{name}_shares AS (SELECT term, {target} AS label, count(*) * 1000 // any_value(df) AS share
  FROM tf JOIN train USING (id) JOIN known USING (term) GROUP BY term, {target}),
{name}_sums AS (SELECT id, label, CAST(sum(tf * (share * share // 1000)) AS BIGINT) AS s FROM tf JOIN {name}_shares USING (term) GROUP BY ALL),
{name}_all AS (SELECT n.id, c.label, 1 + coalesce(s, 0) AS s FROM normed n CROSS JOIN {name}_classes c LEFT JOIN {name}_sums x ON x.id = n.id AND x.label = c.label),
{name}_ranked AS (SELECT id, label, s::DOUBLE / (sum(s) OVER (PARTITION BY id))::DOUBLE AS p,
  row_number() OVER (PARTITION BY id ORDER BY s DESC, label) AS rk FROM {name}_all),
{name}_top AS (SELECT id, string_agg(label, ' | ' ORDER BY rk) FILTER (rk <= 3) AS top3, max(label) FILTER (rk = 1) AS label,
  max(p) FILTER (rk = 1) AS p, max(p) FILTER (rk = 3) AS third FROM {name}_ranked GROUP BY id)"""


ROUTED_BY_SHARES = f"""
WITH {TICKETS_NORMED}, {SPLIT.format(src='normed')}, {TERMS},
train AS (SELECT id, department, urgency FROM splitted WHERE split = 'train'),
known AS (SELECT term, count(*) AS df FROM tf JOIN train USING (id) GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 20000),
{by_shares('dept', 'department')}, {by_shares('urg', 'urgency')},
judged AS (SELECT n.id, {language('n.text')} AS language, d.label AS dept, u.label AS urgency, d.p AS dp, u.p AS up, least(d.p, u.p) AS conf,
    d.top3 AS department_top3, u.top3 AS urgency_top3, d.third
  FROM normed n JOIN dept_top d ON d.id = n.id JOIN urg_top u ON u.id = n.id)
SELECT id, language, CASE WHEN conf < 0.45 THEN 'Other / Unknown' ELSE dept END AS department, round(dp, 3) AS department_confidence,
  urgency, round(up, 3) AS urgency_confidence, round(conf, 3) AS confidence, conf < 0.45 OR language = 'other' AS needs_human,
  {sla('urgency')} AS sla_hours, 'sklearn' AS source, department_top3, urgency_top3, round(third, 6) AS third_p FROM judged"""


def oracle_queries() -> dict[str, str]:
    recall = "count(*) FILTER (urgency = 'P1' AND pred_urg = 'P1') / nullif(count(*) FILTER (urgency = 'P1'), 0)::DOUBLE"
    return {
        "q00_routed_volume": f"""WITH {TICKETS}
SELECT {keyword('text')} AS routed, {language('text')} AS tagged, urgency, count(*) AS n,
  min(created_at + {hours(sla('urgency'))}) AS next_due FROM tickets GROUP BY 1, 2, 3""",
        "q01_ticket_volume": f"""WITH {TICKETS},
g AS (SELECT department, language, urgency, count(*) AS n, min(created_at) AS f FROM tickets GROUP BY ALL)
SELECT department, language, urgency || ' (' || {label('urgency')} || ')' AS urgency, {sla('urgency')} AS sla_hours, n,
  f + {hours(sla('urgency'))} AS first_due FROM g""",
        "q02_language_tag": f"""WITH {TEXTS}
SELECT src, id, {language('text')} AS language,
  len(list_filter(regexp_extract_all(lower(text), '[a-zA-Z'']+'), lambda w: list_contains({lst(HINGLISH_LEXICON)}, w))) AS hits,
  round(coalesce(length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')), 0), 0), 6) AS latin_ratio
FROM texts""",
        "q03_language_confusion": f"""WITH {TICKETS}
SELECT language AS gold, {language('text')} AS pred, count(*) AS n FROM tickets GROUP BY 1, 2""",
        "q04_normalize": f"""WITH {TEXTS}, {DECOMPOSED_PARTS}, every AS (SELECT * FROM texts UNION ALL SELECT * FROM parts)
SELECT src, id, {norm('text')} AS norm, length({norm('text')}) AS n_chars FROM every""",
        "q05_token_highlight": f"WITH {TEXTS}, {RANKED_TOKENS} SELECT src, id, CAST(rank AS INTEGER) AS rank, token FROM rk WHERE rank <= 8",
        "q06_sla_clock": f"""WITH o AS (SELECT o_orderkey, o_orderdate AS c,
  CASE o_orderpriority[1] WHEN '1' THEN 'P1' WHEN '2' THEN 'P2' WHEN '3' THEN 'P3' ELSE 'P4' END AS urgency FROM orders)
SELECT o_orderkey, urgency, {sla('urgency')} AS sla_hours, c + {hours(sla('urgency'))} AS due_at,
  CAST(floor((epoch_us(c + {hours(sla('urgency'))}) - epoch_us(TIMESTAMP '{ORDERS_AS_OF}')) / 60000000.0::DOUBLE) AS BIGINT) AS sla_remaining_min FROM o""",
        "q07_inbox_filtered": f"""WITH {INBOX}
SELECT id, created_at, channel, language, department, urgency, confidence, needs_human, sla_hours,
  CAST(floor((epoch_us(due_at) - epoch_us(TIMESTAMP '{AS_OF}')) / 60000000.0::DOUBLE) AS BIGINT) AS sla_remaining_min, status, text
FROM inbox WHERE department = 'Billing & Payments' AND NOT needs_human ORDER BY id DESC LIMIT 200""",
        "q07c_inbox_filters": " UNION ALL ".join(
            f"""SELECT * FROM (WITH {INBOX} SELECT '{name}' AS listing, id, language, urgency, needs_human, confidence FROM inbox WHERE {wanted} ORDER BY id DESC LIMIT 200)"""
            for name, wanted in (("language", "language = 'hinglish'"), ("urgency", "urgency = 'P1'"), ("human", "needs_human"), ("all", "language = 'en' AND urgency = 'P2' AND needs_human"), ("none", "true"))
        ),
        "q07b_inbox_point_lookup": f"WITH {INBOX} SELECT id, text, status, due_at, needs_human FROM inbox WHERE id = 7",
        "q08_override_current_state": f"""WITH {INBOX}, {CORRECTIONS}, {CURRENT}
SELECT id, department, urgency, sla_hours, due_at, status, needs_human FROM current_inbox""",
        "q09_override_audit": f"WITH {INBOX}, {CORRECTIONS}, {AUDIT} SELECT * FROM audit",
        "q09b_override_listing": f"WITH {INBOX}, {CORRECTIONS}, {AUDIT} SELECT * FROM audit ORDER BY id DESC LIMIT 100",
        "q10_kpis": f"""WITH {INBOX}, {CORRECTIONS}, {CURRENT},
n AS (SELECT (SELECT count(*) FROM current_inbox) AS t, (SELECT count(*) FROM accepted) AS o,
  (SELECT count(*) FROM current_inbox WHERE needs_human) AS h)
SELECT 'n_tickets' AS metric, NULL::VARCHAR AS key, t::DOUBLE AS value FROM n
UNION ALL SELECT 'n_overrides', NULL, o FROM n
UNION ALL SELECT 'n_needs_human', NULL, h FROM n
UNION ALL SELECT 'override_rate', NULL, round(o::DOUBLE / t, 3) FROM n
UNION ALL SELECT 'needs_human_rate', NULL, round(h::DOUBLE / t, 3) FROM n
UNION ALL SELECT 'by_department', department, count(*) FROM current_inbox GROUP BY department
UNION ALL SELECT 'by_language', language, count(*) FROM current_inbox GROUP BY language""",
        "q11_override_validity": f"""WITH {INBOX}, {CORRECTIONS}
SELECT id, ticket_id, CASE WHEN ticket_id IN (SELECT id FROM inbox) THEN 'accepted' ELSE 'rejected' END AS verdict FROM corrections""",
        "q12_draft_reply": f"WITH {DRAFTED} SELECT id, snippet, template_reply FROM drafted",
        "q13_polish_merge": f"WITH {POLISH}",
        "q13b_sla_guard": f"WITH {DRAFTED} SELECT id, "
        + ", ".join(f"{mentions('template_reply', q(str(h)))} AS h{h}" for h in (1, 2, 4, 24, 72))
        + " FROM drafted",
        "q14_tfidf_terms": f"WITH {DOCS_NORMED}, {TERMS}, {weights(1, 'tf')} SELECT id, term, round(weight, 6) AS weight FROM weighted",
        "q14b_term_frequencies": f"WITH {DOCS_NORMED}, {TERMS} SELECT * FROM freq",
        "q14c_tfidf_sublinear": f"WITH {TICKETS_NORMED}, {TERMS}, {weights(2, '(1 + ln(tf))')} SELECT id, term, round(weight, 6) AS weight FROM weighted",
        "q15_keyword_baseline": f"WITH {TICKETS_NORMED} SELECT id, "
        + ", ".join(f"{hits('norm', w)} AS hits_{i}" for i, w in enumerate(DEPARTMENT_KEYWORDS.values()))
        + f", {keyword('norm')} AS kw_dept FROM normed",
        "q15b_keyword_documents": f"SELECT {keyword('text')} AS kw_dept, count(*) AS n FROM documents GROUP BY 1",
        "q16_stratified_split": f"WITH {TICKETS}, {SPLIT.format(src='tickets')} SELECT id, department, split FROM splitted",
        "q16b_split_sizes": f"WITH {TICKETS}, {SPLIT.format(src='tickets')} SELECT split, count(*) AS n FROM splitted GROUP BY split",
        "q17_class_report": f"""WITH {EVALUATED},
{report('dept', 'evaluated', 'department', 'pred_dept', TAXONOMY.routeable)},
{report('urg', 'evaluated', 'urgency', 'pred_urg', ('P1', 'P2', 'P4'))}
SELECT split, class, metric, round(value, 6) AS value, 'department' AS target FROM dept_report
UNION ALL SELECT split, class, metric, round(value, 6), 'urgency' FROM urg_report""",
        "q17b_recall_and_slices": f"""WITH {EVALUATED}
SELECT split, language, n, department_acc, urgency_acc, p1_recall, kw_acc FROM (
  SELECT split, language, count(*) AS n, round(avg((department = pred_dept)::INT), 6) AS department_acc,
    round(avg((urgency = pred_urg)::INT), 6) AS urgency_acc FROM evaluated GROUP BY ALL)
JOIN (SELECT split, round({recall}, 6) AS p1_recall, round(avg((department = pred_dept)::INT), 6) AS kw_acc
  FROM evaluated GROUP BY split) USING (split)""",
        "q17c_quality_report": f"""WITH given AS (SELECT lang AS split, quality::VARCHAR AS gold, CASE WHEN n_chars > 1000 THEN '1' ELSE '0' END AS pred
  FROM labels JOIN documents USING (doc_id)), {report('ql', 'given', 'gold', 'pred', ('0', '1'))}
SELECT split, class, metric, round(value, 6) AS value FROM ql_report""",
        "q18_similar_topk": SIMILAR,
        "q18c_similar_saved_index": SIMILAR,
        "q21c_route_counts": ROUTED_BY_SHARES,
        "q19_batch_defaults": f"""WITH {TICKETS},
up AS (SELECT id AS row_no, CASE WHEN id % 5 = 0 THEN NULL ELSE id END AS id, CASE WHEN id % 5 = 1 THEN NULL ELSE channel END AS channel,
  CASE WHEN id % 5 = 2 THEN '   ' ELSE ' ' || text || chr(10) END AS text, CASE WHEN id % 5 = 3 THEN '' ELSE urgency END AS urgency,
  CASE WHEN id % 5 = 4 THEN NULL ELSE id % 2 = 0 END AS nh, created_at FROM tickets)
SELECT row_no, CAST(id AS VARCHAR) AS ext_id, coalesce(channel, 'email') AS channel, {strip('text')} AS text, urgency,
  {sla("coalesce(nullif(urgency, ''), 'P3')")} AS sla_hours,
  created_at + {hours(sla("coalesce(nullif(urgency, ''), 'P3')"))} AS due_at,
  coalesce(nh, false) AS needs_human, CASE WHEN nh THEN 'needs_human' ELSE 'open' END AS status
FROM up WHERE {strip('text')} <> ''""",
        "q19b_rejected_rows": f"""WITH {TICKETS}
SELECT id AS row_no, 'T' || id AS ext_id, 'blank' AS reason, CASE WHEN id % 3 = 0 THEN '' ELSE '  ' || chr(160) END AS record FROM tickets WHERE id % 5 = 2
UNION ALL SELECT id, NULL, 'malformed', 'T' || id || ',only,' || language || ',' || id || ',too,many' FROM tickets WHERE id % 7 = 3""",
        "q19c_upload_scan": f"""WITH {TICKETS}
SELECT CASE WHEN id % 4 = 0 THEN '' ELSE 'say "' || text || '", ok' END AS text, CAST(id AS VARCHAR) AS id, nullif(channel, 'chat') AS channel FROM tickets""",
        "q20_prompt_export": f"""WITH {DRAFTED}
SELECT id, 'language=' || language || chr(10) || 'department=' || department || chr(10) || 'urgency=' || urgency || chr(10)
  || 'SLA_HOURS=' || {sla('urgency')} || chr(10) || chr(10) || 'Ticket:' || chr(10) || {strip('text')} || chr(10) || chr(10)
  || 'Template (keep SLA ' || {sla('urgency')} || '):' || chr(10) || template_reply AS prompt
FROM drafted WHERE language <> 'other'""",
        "q22_stream_equals_batch": f"""WITH {TICKETS_NORMED}
SELECT row_number() OVER (ORDER BY created_at, CAST(id AS VARCHAR)) AS id, CAST(id AS VARCHAR) AS ext_id, text, channel,
  {language('text')} AS language, {keyword('norm')} AS department, urgency, {sla('urgency')} AS sla_hours, 'open' AS status,
  created_at + {hours(sla('urgency'))} AS due_at FROM normed""",
        "q22b_stream_daily_counts": f"""WITH {TICKETS}
SELECT date_trunc('day', created_at)::TIMESTAMP AS window_start, department, count(*) AS n FROM tickets GROUP BY 1, 2""",
        "q25_csv_round_trip": f"""WITH {TICKETS}
SELECT 'T' || id AS id, text, department, urgency, language, channel, created_at::TIMESTAMP AS timestamp FROM tickets""",
        "q25b_extra_round_trip": f"""WITH {TICKETS}
SELECT id, department AS label, round(id % 97 / 97.0::DOUBLE, 6) AS p, urgency AS second_label, CASE WHEN id % 3 = 0 THEN NULL ELSE 'because "' || language || '" \\ ' || channel END AS rationale,
  CAST(id % 4 AS INTEGER) AS n_explain, CASE WHEN id % 4 > 0 THEN language END AS first_explain FROM tickets""",
        "q26_store_round_trip": f"""WITH {TICKETS_NORMED},
inbox AS (SELECT id, id + 1 AS tid, created_at, {keyword('norm')} AS department, urgency, 'open' AS status FROM normed),
{CORRECTIONS.replace("accepted AS", "acc0 AS")},
phased AS (SELECT *, ts >= TIMESTAMP '2024-01-16' AS late FROM acc0),
accepted AS (SELECT * EXCLUDE (id, late), row_number() OVER (ORDER BY late, id) AS id FROM phased), {AUDIT},
lasts AS (SELECT ticket_id, count(*) AS n_overrides, arg_max(pred_dept, id) AS replaced_dept, max(id) AS last_override,
  arg_max(override_dept, id) AS od, arg_max(override_urg, id) AS ou FROM audit GROUP BY ticket_id)
SELECT i.tid AS id, CAST(i.id AS VARCHAR) AS ext_id, coalesce(od, i.department) AS department, coalesce(ou, i.urgency) AS urgency,
  {sla('coalesce(ou, i.urgency)')} AS sla_hours, CASE WHEN l.ticket_id IS NULL THEN 'open' ELSE 'overridden' END AS status,
  i.created_at + {hours(sla('coalesce(ou, i.urgency)'))} AS due_at, coalesce(n_overrides, 0) AS n_overrides, replaced_dept, coalesce(last_override, 0) AS last_override
FROM inbox i LEFT JOIN lasts l ON l.ticket_id = i.id""",
        "q23_sequential_ids": "SELECT event_id, ts, 1000000 + row_number() OVER (ORDER BY ts, event_id) AS ticket_id FROM events",
        "q24_taxonomy_usage": f"""WITH {TICKETS},
dim AS (SELECT unnest({lst(TAXONOMY.departments)}) AS department, unnest(range(7)) AS ord)
SELECT d.department, CAST(d.ord AS INTEGER) AS ord, d.department <> 'Other / Unknown' AS routeable, count(t.id) AS n
FROM dim d LEFT JOIN tickets t ON t.department = d.department GROUP BY ALL""",
    }
