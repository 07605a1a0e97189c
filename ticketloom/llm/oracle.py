"""DuckDB SQL equivalents of the queries that SQL can express."""

from __future__ import annotations

from ticketloom.llm.license_scan import COPYRIGHT_LINE, SPELLINGS
from ticketloom.llm.license_texts import TEXTS, notices, titled
from ticketloom.llm.url_rules import PATTERNS, SITES


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_rules() -> str:
    sites = ", ".join(f"({_quote(s)}, {_quote(s.split('/')[0])}, {_quote('/' + s.split('/', 1)[1])}, {_quote(a)})" for s, a in SITES)
    patterns = ", ".join(f"({_quote(n)}, {_quote(a)}, {_quote(p)})" for n, a, p, *_ in PATTERNS)
    return f"""WITH sites(site, site_host, site_path, action) AS (VALUES {sites}),
    patterns(name, action, pattern) AS (VALUES {patterns}),
    parts AS (SELECT rowid AS r, page_id,
        CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
      FROM (SELECT row_number() OVER () AS rowid, * FROM pages)),
    split AS (SELECT r, page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
    fit AS (SELECT r, arg_max(site, length(site)) AS rule, arg_max(action, length(site)) AS action FROM split, sites
      WHERE (host = site_host OR ends_with(host, '.' || site_host)) AND starts_with(path, site_path) GROUP BY r),
    hit AS (SELECT r, max(p.action = 'block') AS blocked FROM split, patterns p
      WHERE regexp_matches(host || path, pattern) GROUP BY r)
    SELECT page_id, host, path, rule,
      coalesce(fit.action, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
    FROM split LEFT JOIN fit USING (r) LEFT JOIN hit USING (r)"""


def _canonical_lines(text: str) -> str:
    out = f"regexp_replace(replace(lower(coalesce({text}, '')), chr(13) || chr(10), chr(10)), {_quote(COPYRIGHT_LINE)}, chr(10), 'g')"
    framed = f"regexp_replace(chr(10) || chr(10) || ({out}) || chr(10) || chr(10), '\\n[ \\t]+', chr(10), 'g')"
    other = "list_filter(string_split(p, chr(10)), lambda x: NOT starts_with(x, 'copyright'))"
    kept = f"array_to_string(list_filter(regexp_split_to_array({framed}, '\\n{{2,}}'), lambda p: len({other}) > 0), chr(10) || chr(10))"
    out = f"CASE WHEN contains({out}, 'copyright') THEN {kept} ELSE {out} END"
    for written, canonical in SPELLINGS:
        out = f"replace({out}, {_quote(written)}, {_quote(canonical)})"
    return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


def license_scan() -> str:
    texts = ", ".join(f"({_quote(n)}, {_quote(t)})" for n, t in titled(TEXTS))
    forms = ", ".join(f"({_quote(t)}, {_quote(n)})" for t, n in notices().items())
    whole = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'))"
    return f"""WITH texts(license_id, text) AS (VALUES {texts}), forms(text, license_id) AS (VALUES {forms}),
    known AS (SELECT sha256({whole.format(_canonical_lines("text"))}) AS digest, min(license_id) AS license_id FROM texts GROUP BY 1),
    form AS (SELECT DISTINCT {whole.format(_canonical_lines("text"))} AS form, license_id FROM forms),
    docs AS (SELECT row_number() OVER () AS r, doc_id, {_canonical_lines("text")} AS lines FROM documents),
    full_text AS (SELECT r, doc_id, lines, {whole.format("lines")} AS whole FROM docs),
    line AS (SELECT r, trim(unnest(string_split(lines, chr(10)))) AS form FROM docs),
    noticed AS (SELECT r, list_sort(list(DISTINCT license_id)) AS notice_ids FROM line JOIN form USING (form) GROUP BY r)
    SELECT doc_id, sha256(whole) AS digest, length(whole) AS n_canonical,
      CASE WHEN whole <> '' THEN license_id END AS license_id, coalesce(notice_ids, []) AS notice_ids
    FROM full_text LEFT JOIN known ON known.digest = sha256(whole) LEFT JOIN noticed USING (r)"""


def source_divergence() -> str:
    p = "1 + 1000000000 * ({} + 1) // ({} + V)"
    f = "(p - q) * (p - q) // q"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    words AS (SELECT lang, source, r, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
    counted AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM words GROUP BY ALL),
    kept AS (SELECT lang, term, sum(n)::BIGINT AS lang_n FROM counted GROUP BY ALL HAVING sum(docs) >= 3),
    sizes AS (SELECT lang, count(*) AS V, sum(lang_n)::BIGINT AS lang_total FROM kept GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)),
    totals AS (SELECT lang, source, sum(n)::BIGINT AS total FROM grid GROUP BY ALL),
    shares AS (SELECT lang, source, term, n, {p.format("n", "total")} AS p, {p.format("lang_n", "lang_total")} AS lang_p
      FROM grid JOIN totals USING (lang, source) JOIN sizes USING (lang)),
    both_sides AS (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source),
    sums AS (SELECT lang, source, item, sum({f}) AS value FROM both_sides GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM groups a JOIN groups b USING (lang) LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source WHERE a.source <> b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, ({f.replace("q", "lang_p")})::BIGINT AS value FROM shares WHERE n > 0 AND p > lang_p),
    ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": license_scan(), "op10_url_rules": url_rules(), "op11_source_divergence": source_divergence()}
