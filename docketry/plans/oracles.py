"""SQL for the named queries, computed from the star-schema columns alone: no citation is read back from a text here."""

from __future__ import annotations

from docketry.plans.fixtures import COURTS, REPORTERS


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


INJ = f"""
line1 AS (SELECT l_orderkey, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey),
base AS (
    SELECT o_orderkey AS cite_no, o_orderkey % (SELECT count(*) FROM documents) AS doc_id, o_orderkey % 7 AS damage,
        replace(c_name, '#', ' ') AS plaintiff, replace(s_name, '#', ' ') || CASE WHEN l_suppkey % 4 = 1 THEN ' & Co., Inc.' ELSE '' END AS defendant,
        (l_partkey % 900 + 1)::VARCHAR AS volume, {_list(REPORTERS)}[1 + l_suppkey % {len(REPORTERS)}] AS reporter,
        (o_orderkey % 1500 + 1)::VARCHAR AS page, (o_orderkey % 1500 + 2)::VARCHAR AS pin, year(o_orderdate)::VARCHAR AS year,
        c_nationkey % {len(COURTS)} AS court_no, CASE WHEN o_orderkey % 7 = 5 THEN (c_nationkey + 1) % {len(COURTS)} ELSE c_nationkey % {len(COURTS)} END AS w_court_no
    FROM orders JOIN line1 ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
), inj AS (
    SELECT *, {_list([c for c, _ in COURTS])}[1 + court_no] AS court, {_list([i for _, i in COURTS])}[1 + court_no] AS court_id,
        {_list([c for c, _ in COURTS])}[1 + w_court_no] AS w_court, {_list([i for _, i in COURTS])}[1 + w_court_no] AS w_court_id,
        CASE WHEN damage <> 3 THEN plaintiff WHEN cite_no // 7 % 2 = 0 THEN 'Wrong Party' ELSE plaintiff || ' Company' END AS w_plaintiff, CASE WHEN damage = 4 THEN (year::INT + 1)::VARCHAR ELSE year END AS w_year,
        CASE damage WHEN 1 THEN '  ' WHEN 2 THEN chr(10) ELSE ' ' END AS gap, pin || CASE WHEN cite_no // 7 % 4 = 1 THEN ' n.3' ELSE '' END AS w_pin,
        CASE WHEN cite_no // 7 % 4 = 2 AND reporter = 'U.S.' AND damage NOT IN (1, 2) THEN ' (1 Cranch) ' ELSE ' ' END AS by_name
    FROM base
), cited AS (
    SELECT *, w_plaintiff || ' v. ' || defendant || ', ' AS names, w_plaintiff || ' v. ' || defendant || ', ' || volume || gap || reporter || by_name || page || ', ' || w_pin || ' (' || w_court || ' ' || w_year || ')' AS cite FROM inj
), placed AS (
    SELECT c.*, length(substr(coalesce(d.text, ''), 1, 200)) + 5 + coalesce(sum(length(cite) + 6) OVER (PARTITION BY c.doc_id ORDER BY cite_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at
    FROM cited c JOIN documents d ON d.doc_id = c.doc_id
), texts AS (
    SELECT d.doc_id, CASE WHEN cites IS NULL THEN coalesce(d.text, '') ELSE substr(coalesce(d.text, ''), 1, 200) || ' see ' || cites || CASE WHEN length(d.text) > 200 THEN '.' || chr(10) || substr(d.text, 201) ELSE '' END END AS text
    FROM documents d LEFT JOIN (SELECT doc_id, string_agg(cite, '; see ' ORDER BY cite_no) AS cites FROM placed GROUP BY doc_id) c ON c.doc_id = d.doc_id
), found AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cite_no) - 1 AS ordinal FROM placed WHERE damage <> 2)
"""
AUTH = """
known AS (SELECT volume, reporter, page, min(cite_no) AS k FROM inj WHERE cite_no % 5 <> 0 GROUP BY volume, reporter, page),
each AS (
    SELECT k.*, i.plaintiff || ' v. ' || i.defendant AS case_name, i.year AS found_year, i.court_id AS cluster_court, i.pin AS true_pin,
        CASE WHEN k % 17 <> 0 THEN 'd' || k END AS docket_id, unnest(range(CASE WHEN k % 13 = 0 THEN 5 WHEN k % 11 = 0 THEN 2 ELSE 1 END)) AS copy
    FROM known k JOIN inj i ON i.cite_no = k.k
), clusters AS (SELECT *, 'c' || k || '-' || copy AS cluster_id FROM each),
dockets AS (SELECT 'd' || cite_no AS docket_id, CASE WHEN cite_no % 19 <> 0 THEN court_id END AS docket_court, plaintiff || ' v. ' || defendant AS case_name FROM inj),
looked AS (
    SELECT f.*, coalesce(n, 0) AS n_clusters, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS lookup
    FROM found f LEFT JOIN (SELECT volume, reporter, page, count(*) AS n FROM clusters GROUP BY ALL) USING (volume, reporter, page)
), checked AS (
    SELECT l.*, c.cluster_id, CASE WHEN lower(l.w_plaintiff || ' v. ' || l.defendant) = lower(c.case_name) THEN 'match' ELSE 'mismatch' END AS name_check,
        CASE WHEN l.w_year = c.found_year THEN 'match' ELSE 'mismatch' END AS year_check,
        coalesce(d.docket_court, CASE WHEN c.docket_id IS NULL THEN c.cluster_court END) AS known_court,
        CASE WHEN lower(l.w_plaintiff || ' v. ' || l.defendant) <> lower(c.case_name) THEN
            CASE WHEN l.w_plaintiff = l.plaintiff || ' Company' AND l.plaintiff || ' v. ' || l.defendant = c.case_name THEN 'match' ELSE 'mismatch' END END AS semantic_check
    FROM looked l JOIN clusters c USING (volume, reporter, page) LEFT JOIN dockets d ON d.docket_id = c.docket_id WHERE l.n_clusters <= 3
), assessed AS (
    SELECT *, CASE WHEN known_court IS NULL THEN 'unavailable' WHEN known_court = w_court_id THEN 'match' ELSE 'mismatch' END AS court_check,
        coalesce(semantic_check, name_check) AS name_outcome,
        CASE WHEN coalesce(semantic_check, name_check) = 'mismatch' OR court_check = 'mismatch' THEN 'mismatch' WHEN year_check <> 'mismatch' THEN 'match' ELSE 'partial_match' END AS verdict
    FROM checked
), pool AS (
    SELECT cluster_court AS court_id, case_name, found_year, cluster_id AS found_id, 'opinion' AS source FROM clusters
    UNION ALL SELECT docket_court, case_name, NULL, docket_id, 'recap' FROM dockets WHERE docket_court IS NOT NULL
), every_hit AS (
        SELECT l.doc_id, l.cite_no, l.start_at, p.source, p.found_id, count(*) OVER w AS total, row_number() OVER (w ORDER BY p.found_id) AS candidate,
            CASE WHEN p.source = 'recap' OR p.found_year = l.w_year THEN 'possible_match' ELSE 'mismatch' END AS verdict
        FROM looked l JOIN pool p ON p.court_id = l.w_court_id AND lower(p.case_name) = lower(l.w_plaintiff || ' v. ' || l.defendant) WHERE l.lookup = 'not_found'
        WINDOW w AS (PARTITION BY l.cite_no, p.source)
), searched AS (SELECT * FROM every_hit WHERE total <= 3
), overall AS (
    SELECT l.*, coalesce(a.n, 0) AS n_candidates,
        CASE WHEN lookup = 'not_found' THEN CASE WHEN s.possible THEN 'possible_match' ELSE 'not_found' END WHEN a.rank = 3 THEN 'match' WHEN a.rank = 2 THEN 'possible_match' WHEN a.rank = 1 THEN 'mismatch' END AS overall
    FROM looked l LEFT JOIN (SELECT cite_no, count(*) AS n, max(CASE verdict WHEN 'match' THEN 3 WHEN 'mismatch' THEN 1 ELSE 2 END) AS rank FROM assessed GROUP BY cite_no) a USING (cite_no)
    LEFT JOIN (SELECT cite_no, bool_or(verdict = 'possible_match') AS possible FROM searched GROUP BY cite_no) s USING (cite_no)
), steps AS (
    SELECT cite_no, 'exact_locator_lookup' AS node_type, lookup AS outcome, 0 AS parents FROM looked
    UNION ALL SELECT cite_no, 'locator_candidate_evaluation', 'ready', 1 FROM assessed UNION ALL SELECT cite_no, 'exact_case_name_check', name_check, 1 FROM assessed
    UNION ALL SELECT cite_no, 'semantic_case_name_check', semantic_check, 1 FROM assessed WHERE semantic_check IS NOT NULL UNION ALL SELECT cite_no, 'local_party_reextraction', 'complete', 1 FROM assessed WHERE semantic_check = 'mismatch'
    UNION ALL SELECT cite_no, 'reextracted_case_name_check', 'mismatch', 1 FROM assessed WHERE semantic_check = 'mismatch' UNION ALL SELECT cite_no, 'year_check', year_check, 1 FROM assessed
    UNION ALL SELECT cite_no, 'court_check', court_check, 1 FROM assessed UNION ALL SELECT cite_no, 'locator_candidate_assessment', verdict, 1 FROM assessed
), search_steps AS (
    SELECT cite_no, 'search_term_preparation' AS node_type, CASE WHEN w_court_id IS NULL THEN 'skipped' ELSE 'succeeded' END AS status, CASE WHEN w_court_id IS NULL THEN 'missing_terms' ELSE 'prepared' END AS outcome FROM looked WHERE lookup = 'not_found'
    UNION ALL SELECT l.cite_no, k.kind || '_search' AS node_type, CASE WHEN l.w_court_id IS NULL THEN 'skipped' ELSE 'succeeded' END AS status,
        CASE WHEN l.w_court_id IS NULL THEN 'missing_terms' WHEN s.total <= 3 THEN 'candidates' WHEN s.total > 3 THEN 'deferred_over_limit' ELSE 'none' END AS outcome
    FROM looked l CROSS JOIN (VALUES ('opinion'), ('recap')) k(kind) LEFT JOIN (SELECT DISTINCT cite_no, source, total FROM every_hit) s ON s.cite_no = l.cite_no AND s.source = k.kind WHERE l.lookup = 'not_found'
    UNION ALL SELECT cite_no, source || '_search_candidate', 'succeeded', 'ready' FROM searched UNION ALL SELECT cite_no, source || '_search_candidate_assessment', 'succeeded', verdict FROM searched
    UNION ALL SELECT cite_no, 'exact_case_name_check', 'succeeded', 'match' FROM searched UNION ALL SELECT cite_no, 'court_check', 'succeeded', 'match' FROM searched
    UNION ALL SELECT cite_no, 'year_check', 'succeeded', CASE WHEN source = 'recap' THEN 'unavailable' WHEN verdict = 'possible_match' THEN 'match' ELSE 'mismatch' END FROM searched
)
"""
_INJ, _AUTH = f"WITH {INJ}\n", f"WITH {INJ}, {AUTH}\n"
#: Places of the citations of a table ``formed`` (doc_id, cite_no, cite) in the filings they are written into.
_PUT = """
    SELECT c.*, length(substr(coalesce(d.text, ''), 1, 200)) + 5 + coalesce(sum(length(cite) + 6) OVER (PARTITION BY c.doc_id ORDER BY cite_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at
    FROM formed c JOIN documents d ON d.doc_id = c.doc_id"""
MARK = "'--- Plain text ---' || chr(10)"
ORACLES: dict[str, str] = {
    "header_split": """
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'source ' || lang END AS header, length(coalesce(text, ''))::BIGINT AS n_chars, md5(coalesce(text, '')) AS body_md5 FROM documents""",
    "format_dispatch": """
        WITH p AS (SELECT ['txt', 'pdf', 'docx', 'htm', 'md', 'zip'][1 + p_partkey % 6] AS s FROM part)
        SELECT CASE s WHEN 'txt' THEN 'plain_text' WHEN 'htm' THEN 'html' WHEN 'md' THEN 'markdown' WHEN 'zip' THEN 'unknown' ELSE s END AS format, s NOT IN ('txt', 'zip') AS converted,
            CASE s WHEN 'txt' THEN 'plain_text' WHEN 'zip' THEN 'none' ELSE 'converter' END AS reader, count(*) AS n FROM p GROUP BY ALL""",
    "http_failures": """
        WITH r AS (SELECT [200, 400, 401, 403, 404, 418, 429, 500, 503][1 + event_id % 9]::INT AS status, length(props) + event_id % 700 AS n FROM events)
        SELECT status, CASE WHEN status = 429 THEN 'api_limit' WHEN status IN (401, 403) THEN 'authentication' WHEN status = 404 THEN 'not_found' WHEN status < 500 THEN 'request_rejected' ELSE 'upstream_error' END AS failure,
            status = 429 OR status >= 500 AS can_retry, count(*) AS n, max(least(r.n, 500))::BIGINT AS longest FROM r WHERE status >= 400 GROUP BY ALL""",
    "decoded_clusters": """
        SELECT p_partkey::VARCHAR AS cluster_id, CASE WHEN p_partkey % 2 = 1 THEN 'A v. ' ELSE 'B v. ' END || p_partkey AS case_name, p_partkey::VARCHAR AS docket_id, p_partkey || ',null' AS opinions, p_partkey::VARCHAR AS volume FROM part""",
    "lookup_payloads": """
        SELECT CASE WHEN event_id % 3 = 0 THEN 404 ELSE 200 END::INT AS status, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS n_clusters, CASE WHEN event_id % 2 = 0 THEN 'none' END AS message, count(*) AS n FROM events GROUP BY ALL""",
    "link_parts": """
        SELECT page_id, page_id::VARCHAR AS docket_id, NULL::VARCHAR AS opinion_id, 'c' || page_id AS cursor, CASE WHEN page_id % 4 <> 0 THEN 'https://h.example/docket/' || page_id END AS url FROM pages""",
    "collapsed_blanks": """
        WITH f AS (SELECT doc_id, regexp_replace(replace(coalesce(text, ''), 'e', ' ' || chr(9) || ' '), '[ \\t]{2,}', ' ', 'g') AS flat FROM documents)
        SELECT doc_id, length(flat)::BIGINT AS n_chars, md5(flat) AS flat_md5 FROM f""",
    "extracted_citations": _INJ + """
        SELECT doc_id, ordinal::INT AS ordinal, start_at::INT AS start, (start_at + length(cite))::INT AS "end", 'full_case' AS kind, w_plaintiff AS plaintiff, defendant, volume, reporter, page, w_pin AS pin_cite, w_year AS year, w_court AS court FROM found""",
    "span_slices": _INJ + "SELECT count(*) AS n, count(*) AS n_right, count(*) AS n_valid FROM found",
    "extraction_arms": _INJ + """
        SELECT 'baseline' AS arm, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM placed WHERE damage NOT IN (1, 2)
        UNION ALL SELECT 'production', count(*), count(DISTINCT doc_id) FROM found UNION ALL SELECT 'layout_tolerant', count(*), count(DISTINCT doc_id) FROM placed""",
    "recovery_arms": _INJ + """
        SELECT arm, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM placed, (VALUES ('baseline'), ('production'), ('layout_tolerant'), ('production_recovery'), ('layout_tolerant_recovery')) a(arm)
        WHERE arm NOT IN ('baseline', 'production') OR damage <> 2 AND (arm <> 'baseline' OR damage <> 1) GROUP BY arm""",
    "arms_first_of_span": _INJ + "SELECT CASE damage WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END::INT AS arm_order, count(*) AS n FROM placed GROUP BY ALL",
    "antecedents": _INJ + """
        SELECT doc_id, CASE WHEN cite_no % 3 = 0 THEN 'id' ELSE 'short_case' END AS kind, count(*) AS n, count(*) AS n_resolved, sum(page::BIGINT)::BIGINT AS pages FROM found WHERE cite_no % 3 < 2 GROUP BY ALL""",
    "citation_forms": f"""WITH {INJ}, formed AS (
            SELECT doc_id, cite_no, cite_no % 6 AS form, plaintiff, defendant, volume, reporter, page, pin, court, year, CASE cite_no % 6
                WHEN 0 THEN 'In re ' || defendant || ', ' || volume || ' ' || reporter || ' ' || page || ' (' || court || ' ' || year || ')'
                WHEN 1 THEN volume || ' U.S.C. § ' || page || '(b)(1) (' || year || ')'
                WHEN 2 THEN plaintiff || ' v. ' || defendant || ', ' || volume || ' ' || reporter || ' ' || page || ', ' || pin || ' S. Ct. ' || page || ' (' || year || ')'
                WHEN 3 THEN plaintiff || ' v. ' || defendant || ', ' || year || ' WL ' || page || ', at *' || pin || ' (' || court || ' Jan. 5, ' || year || ')'
                WHEN 4 THEN plaintiff || ' v. ' || defendant || ', ' || volume || ' ' || reporter || ' ' || page || ' (' || year || '); ' || plaintiff || ' at ' || pin
                ELSE volume || ' U.S. (2 Cranch) ' || page || ', ' || pin || ' n.4' END AS cite FROM inj
        ), put AS ({_PUT})
        SELECT doc_id, start_at + off AS start, start_at + off + size AS "end", kind, u.plaintiff, u.defendant, u.volume, u.reporter, u.page, u.pin_cite, u.extra, u.year, u.court FROM (
            SELECT doc_id, start_at, unnest(CASE form
                WHEN 0 THEN [{{'off': 0, 'size': length(cite), 'kind': 'full_case', 'plaintiff': NULL, 'defendant': 'In re ' || defendant, 'volume': volume, 'reporter': reporter, 'page': page, 'pin_cite': NULL, 'extra': NULL, 'year': year, 'court': court}}]
                WHEN 1 THEN [{{'off': 0, 'size': length(cite), 'kind': 'full_law', 'plaintiff': NULL, 'defendant': NULL, 'volume': volume, 'reporter': 'U.S.C.', 'page': page, 'pin_cite': '(b)(1)', 'extra': NULL, 'year': year, 'court': NULL}}]
                WHEN 2 THEN [{{'off': 0, 'size': names + length(volume || reporter || page) + 2, 'kind': 'full_case', 'plaintiff': plaintiff, 'defendant': defendant, 'volume': volume, 'reporter': reporter, 'page': page, 'pin_cite': NULL, 'extra': NULL, 'year': year, 'court': NULL}},
                    {{'off': names + length(volume || reporter || page) + 4, 'size': length(pin || page || year) + 11, 'kind': 'full_case', 'plaintiff': plaintiff, 'defendant': defendant, 'volume': pin, 'reporter': 'S. Ct.', 'page': page, 'pin_cite': NULL, 'extra': NULL, 'year': year, 'court': NULL}}]
                WHEN 3 THEN [{{'off': 0, 'size': length(cite), 'kind': 'full_case', 'plaintiff': plaintiff, 'defendant': defendant, 'volume': year, 'reporter': 'WL', 'page': page, 'pin_cite': '*' || pin, 'extra': NULL, 'year': year, 'court': court}}]
                WHEN 4 THEN [{{'off': 0, 'size': length(cite) - length(plaintiff || pin) - 6, 'kind': 'full_case', 'plaintiff': plaintiff, 'defendant': defendant, 'volume': volume, 'reporter': reporter, 'page': page, 'pin_cite': NULL, 'extra': NULL, 'year': year, 'court': NULL}},
                    {{'off': length(cite) - length(plaintiff || pin) - 4, 'size': length(plaintiff || pin) + 4, 'kind': 'reference', 'plaintiff': plaintiff, 'defendant': NULL, 'volume': NULL, 'reporter': NULL, 'page': NULL, 'pin_cite': pin, 'extra': NULL, 'year': NULL, 'court': NULL}}]
                ELSE [{{'off': 0, 'size': length(cite), 'kind': 'full_case', 'plaintiff': NULL, 'defendant': NULL, 'volume': volume, 'reporter': 'U.S.', 'page': page, 'pin_cite': pin || ' n.4', 'extra': '2 Cranch', 'year': NULL, 'court': NULL}}] END) AS u
            FROM (SELECT *, length(plaintiff || defendant) + 6 AS names FROM put)
        ) t, LATERAL (SELECT u.off AS off, u.size AS size, u.kind AS kind) x""",
    "reference_citations": f"""WITH {INJ}, formed AS (
            SELECT doc_id, cite_no, plaintiff, pin, page, lower(plaintiff || ' v. ' || defendant) AS name, cite_no % 3 = 0 AS again,
                plaintiff || ' v. ' || defendant || ', ' || volume || ' ' || reporter || ' ' || page || ' (' || year || ')' || CASE WHEN cite_no % 3 = 0 THEN '; see ' || plaintiff || ' at ' || pin ELSE '' END AS cite FROM inj
        ), put AS ({_PUT})
        SELECT p.doc_id, (p.start_at + length(p.cite) - length(p.plaintiff || p.pin) - 4)::INT AS start, p.pin AS pin_cite, CASE WHEN count(DISTINCT o.name) = 1 THEN p.page END AS to_page
        FROM put p JOIN put o ON o.doc_id = p.doc_id AND o.plaintiff = p.plaintiff AND o.cite_no <= p.cite_no WHERE p.again GROUP BY p.doc_id, p.cite_no, p.start_at, p.cite, p.plaintiff, p.pin, p.page""",
    "locator_keys": _INJ + """
        SELECT cite_no, 0::BIGINT AS place, volume || ' ' || reporter || ' ' || page AS locator, regexp_replace(lower(volume || reporter || page), '[^a-z0-9]', '', 'g') AS identity, false AS implausible FROM inj
        UNION ALL SELECT cite_no, 1, pin || ' S.Ct. ' || page, pin || 'sct' || page, false FROM inj""",
    "masked_filings": _INJ + """
        SELECT t.doc_id, length(text)::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS n_citations, (length(replace(text, ' ', '')) - coalesce(marks, 0))::BIGINT AS n_left
        FROM texts t LEFT JOIN (SELECT doc_id, count(*) AS n, sum(length(replace(cite, ' ', ''))) AS marks FROM found GROUP BY doc_id) USING (doc_id)""",
    "suspected_locators": f"""WITH {INJ}, courts AS (SELECT *, start_at + length(cite) - length(w_court) - 6 AS court_at FROM placed WHERE damage = 2)
        SELECT doc_id, (start_at + length(names) + length(volume) + 1)::INT AS start, (start_at + length(names) + length(volume) + 1 + length(reporter))::INT AS "end", reporter FROM placed WHERE damage = 2
        UNION ALL SELECT doc_id, (court_at + 4)::INT, (court_at + 8)::INT, 'N.Y.' FROM courts WHERE w_court = 'S.D.N.Y.' UNION ALL SELECT doc_id, (court_at + 3)::INT, (court_at + 8)::INT, 'Mass.' FROM courts WHERE w_court = 'D. Mass.'""",
    "docket_courts": _INJ + """
        SELECT cite_no AS doc_id, 3::BIGINT AS start, length('In Civil Action No. 1:00-cv-00000')::BIGINT AS "end", 'Civil Action No. 1:' || (cite_no % 90 + 10) || '-cv-' || (cite_no % 90000 + 10000) AS docket, court_id AS courts FROM inj""",
    "sliding_windows": """
        WITH w AS (SELECT doc_id, length(text) AS n, greatest(ceil((length(text) - 1500) / 1200.0), 0)::BIGINT AS steps FROM documents WHERE length(text) > 0)
        SELECT doc_id, steps + 1 AS n, steps * 1200 AS last, (steps * 1500 + n - steps * 1200)::BIGINT AS n_chars FROM w""",
    "scalar_checks": _INJ + """
        SELECT cite_no, ['442', '627', '627', NULL, '12', NULL, NULL][1 + cite_no % 7] AS pin, plaintiff || CASE WHEN damage = 0 THEN '' ELSE ' v. ' || defendant END AS case_name,
            volume || '-' || regexp_replace(regexp_replace(lower(reporter), '[^a-z0-9]+', '-', 'g'), '-$', '') || '-' || page AS slug, '"' || plaintiff || '\\"x\\\\"' AS term,
            lower(regexp_replace(court, '[.]$', '')) AS court, '1' || page || 'cv' AS docket, greatest(least(cite_no % 3000 - 900, 1860), 0)::BIGINT AS low, greatest(least(cite_no % 3000 - 900, 1860), 0)::BIGINT + 1200 AS high FROM inj""",
    "lookup_outcomes": _AUTH + """
        SELECT lookup, CASE lookup WHEN 'found' THEN 200 WHEN 'not_found' THEN 404 ELSE 300 END::BIGINT AS status, n_clusters::BIGINT AS n_clusters, CASE WHEN n_clusters <= 3 THEN 'all_selected' ELSE 'deferred_over_limit' END AS selection, count(*) AS n FROM looked GROUP BY ALL""",
    "field_checks": _AUTH + "SELECT lookup, name_check, year_check, court_check, verdict, count(*) AS n FROM assessed GROUP BY ALL",
    "search_candidates": _AUTH + "SELECT doc_id, start_at::INT AS start, source, candidate::BIGINT AS candidate, found_id, verdict FROM searched",
    "citation_verdicts": _AUTH + "SELECT lookup, overall, count(*) AS n, sum(n_candidates)::BIGINT AS n_candidates FROM overall GROUP BY ALL",
    "exported_verdicts": _AUTH + """
        SELECT 'cite:' || doc_id || ':' || slug || ':' || start_at || '-' || (start_at + length(cite)) AS id, slug AS locator_id, start_at::INT AS start, (start_at + length(cite))::INT AS "end", coalesce(overall, 'unavailable') AS verdict
        FROM (SELECT *, trim(regexp_replace(lower(volume || ' ' || reporter || ' ' || page), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM overall)""",
    "step_table": _AUTH + "SELECT node_type, 'succeeded' AS status, outcome, count(*) AS n, sum(parents)::BIGINT AS n_parents FROM steps GROUP BY ALL",
    "search_steps": _AUTH + "SELECT node_type, status, outcome, count(*) AS n, count(*) AS n_parents FROM search_steps GROUP BY ALL",
    "step_ancestors": _AUTH + """
        SELECT 'exact_locator_lookup' AS ancestor_type, 1::BIGINT AS distance, count(*) AS n FROM assessed
        UNION ALL SELECT 'exact_locator_lookup', 2, count(*) FROM steps WHERE node_type NOT IN ('exact_locator_lookup', 'locator_candidate_evaluation')
        UNION ALL SELECT 'locator_candidate_evaluation', 1, count(*) FROM steps WHERE node_type NOT IN ('exact_locator_lookup', 'locator_candidate_evaluation')""",
    "step_children": _AUTH + """
        SELECT 'locator_candidate_evaluation' AS parent_type, node_type AS child_type, count(*) AS n_parents, count(*) AS n_single FROM steps WHERE node_type NOT IN ('exact_locator_lookup', 'locator_candidate_evaluation') GROUP BY ALL
        UNION ALL SELECT 'exact_locator_lookup', 'locator_candidate_evaluation', count(*), count(*) FILTER (n = 1) FROM (SELECT cite_no, count(*) AS n FROM assessed GROUP BY cite_no)""",
    "step_invariants": "SELECT unnest(['repeated node id', 'empty node id', 'unknown dependency', 'not one lookup', 'not one assessment', 'selection and total differ']) AS rule, 0::BIGINT AS n",
    "pinpoint_pages": _AUTH + """
        SELECT doc_id, start_at::INT AS start, CASE WHEN l.w_pin = c.true_pin THEN '*' || l.pin || ' cited rule ' || k END AS page_text FROM looked l JOIN clusters c USING (volume, reporter, page) WHERE l.lookup = 'found' AND k % 3 <> 0""",
    "grounded_quotes": """
        SELECT p_partkey, CASE WHEN k = 3 THEN NULL WHEN k = 0 THEN 13 WHEN k = 1 THEN 8 END::BIGINT AS start, CASE WHEN k < 2 THEN 26 + length(p_partkey::VARCHAR) + 6 END::BIGINT AS "end", CASE k WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized' END AS method
        FROM (SELECT p_partkey, p_partkey % 4 AS k FROM part)""",
    "extraction_scores": _INJ + """
        SELECT tp, 0::BIGINT AS fp, fn, 1.0::DOUBLE AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fn)) / (1 + tp / (tp + fn)) AS f1 FROM (SELECT count(*) FILTER (damage <> 2) AS tp, count(*) FILTER (damage = 2) AS fn FROM placed)""",
    "verdict_matrix": """
        SELECT CASE WHEN coalesce(length(text), 0) < 200 THEN 'not_found' WHEN contains(text, '###') THEN 'mismatch' ELSE 'match' END AS observed, count(*) FILTER (quality = 1) AS match, count(*) FILTER (quality IS NULL OR quality <> 1) AS mismatch
        FROM labels JOIN documents USING (doc_id) GROUP BY ALL""",
    "verdict_disagreements": """
        SELECT id, CASE WHEN verdict = 'not_found' THEN 'non_confident_verdict' ELSE 'verdict_disagreement' END AS reason, expected_verdict, verdict FROM (
            SELECT l.doc_id AS id, CASE WHEN quality = 1 THEN 'match' ELSE 'mismatch' END AS expected_verdict, CASE WHEN coalesce(length(text), 0) < 200 THEN 'not_found' WHEN contains(text, '###') THEN 'mismatch' ELSE 'match' END AS verdict
            FROM labels l JOIN documents d ON d.doc_id = l.doc_id) WHERE verdict <> expected_verdict""",
    "run_documents": "SELECT p_partkey, p_partkey::BIGINT AS document FROM part",
    "ranked_search": _AUTH + """
        , names AS (SELECT cluster_id AS found_id, list_filter(regexp_split_to_array(lower(case_name), '[^a-z0-9]+'), lambda w: w <> '') AS terms FROM clusters
        ), stats AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM names
        ), df AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS word FROM names) GROUP BY word
        ), asked AS (SELECT c_custkey AS query_id, list_filter(regexp_split_to_array(lower(c_name), '[^a-z0-9]+'), lambda w: w <> '') AS wanted FROM customer
        ), owners AS (SELECT found_id, terms, unnest(list_distinct(terms)) AS word FROM names
        ), met AS (SELECT a.query_id, o.found_id, o.terms, a.wanted FROM asked a JOIN owners o ON o.word = a.wanted[2] WHERE list_has_all(o.terms, a.wanted)
        ), each_word AS (SELECT query_id, found_id, terms, unnest(wanted) AS word FROM met
        ), scored AS (
            SELECT query_id, found_id, sum(CAST(round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (len(list_filter(terms, lambda t: t = word)) * 2.2::DOUBLE
                / (len(list_filter(terms, lambda t: t = word)) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(terms) / mean))) * 1000000) AS BIGINT))::BIGINT AS score
            FROM each_word JOIN df USING (word), stats GROUP BY ALL
        ), placed_at AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, found_id) AS place FROM scored)
        SELECT query_id, ((place + 1) // 2)::INT AS page, ((place - 1) % 2 + 1)::INT AS rank, found_id, score FROM placed_at WHERE place <= 4""",
    "aligned_citations": _INJ + """
        SELECT doc_id, start_at AS start, start_at + length(cite) AS "end", 1::BIGINT AS distance, round(1 - 1 / length(cite), 6) AS score FROM found""",
    "summary_candidates": _AUTH + """
        , every AS (SELECT doc_id, cite_no, start_at, 0 AS rank, cluster_id AS found_id, 'opinion' AS provenance, verdict AS outcome FROM assessed
            UNION ALL SELECT doc_id, cite_no, start_at, CASE source WHEN 'opinion' THEN 1 ELSE 2 END, found_id, source, verdict FROM searched)
        SELECT doc_id, start_at::BIGINT AS start, row_number() OVER (PARTITION BY cite_no ORDER BY rank, found_id) AS place, provenance, found_id, outcome,
            CASE WHEN provenance = 'opinion' AND found_id LIKE '%-0' THEN 'https://h.example/opinion/' || found_id || '/' END AS opinion_url,
            CASE WHEN provenance = 'recap' AND found_id NOT LIKE '%3' THEN 'https://h.example/docket/' || found_id || '/' END AS docket_url FROM every""",
    "repeated_keys": _INJ + "SELECT volume, reporter, count(*) AS n FROM inj GROUP BY ALL HAVING count(*) > 1",
    "artifact_round_trip": _INJ + """
        SELECT t.doc_id, md5(text) AS text_md5, coalesce(n, 0)::BIGINT AS n, coalesce(pages, '') AS pages FROM texts t LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(page, ',' ORDER BY cite_no) AS pages FROM found GROUP BY doc_id) USING (doc_id)""",
    "annotation_rows": _INJ + """
        SELECT 'label' AS row_type, 'full_case' AS name, count(*) AS n, sum(length(cite))::BIGINT AS n_chars FROM found UNION ALL SELECT 'field', 'volume', count(*), sum(length(volume)) FROM found
        UNION ALL SELECT 'field', 'reporter', count(*), sum(length(reporter)) FROM found UNION ALL SELECT 'field', 'page', count(*), sum(length(page)) FROM found UNION ALL SELECT 'field', 'year', count(*), sum(length(w_year)) FROM found""",
    "recovered_names": _AUTH + """
        , named AS (SELECT i.cite_no % 4 AS kind, c.case_name = i.plaintiff || ' v. ' || i.defendant AS same, count(*) OVER (PARTITION BY i.cite_no) AS total FROM inj i JOIN clusters c USING (volume, reporter, page)
        ), exact AS (SELECT *, CASE WHEN kind = 3 THEN 'unavailable' WHEN kind = 0 AND same THEN 'match' ELSE 'mismatch' END AS name_check FROM named WHERE total <= 3
        ), sensed AS (SELECT *, CASE WHEN name_check = 'mismatch' THEN CASE WHEN kind = 1 AND same THEN 'match' ELSE 'mismatch' END END AS semantic_check FROM exact
        ), again AS (SELECT *, name_check = 'unavailable' OR coalesce(semantic_check, '') = 'mismatch' AS retry FROM sensed
        ), judged AS (SELECT *, CASE WHEN retry THEN 'complete' END AS reextraction, CASE WHEN retry THEN CASE WHEN kind = 3 AND same THEN 'match' ELSE 'mismatch' END END AS reextracted_check FROM again)
        SELECT name_check, semantic_check, reextraction, reextracted_check, coalesce(reextracted_check, semantic_check, name_check) AS name_outcome,
            CASE WHEN retry THEN 'reextracted' WHEN semantic_check IS NOT NULL THEN 'semantic' ELSE 'exact' END AS name_evidence, count(*) AS n FROM judged GROUP BY ALL""",
    "searched_names": _AUTH + """
        , told AS (SELECT *, source = 'opinion' AND coalesce(try_cast(regexp_extract(found_id, 'c([0-9]+)-', 1) AS BIGINT), 0) % 2 = 1 AS odd FROM searched)
        SELECT source, CASE WHEN odd THEN 'mismatch' ELSE 'match' END AS name_check, CASE WHEN odd THEN 'match' END AS semantic_check, verdict,
            CASE WHEN verdict <> 'possible_match' THEN 'Available search evidence does not support this candidate as a possible match.' WHEN source = 'recap' THEN 'Case name and court support this retrieved RECAP candidate as a possible match.'
                ELSE 'Case name, year, and court support this retrieved candidate as a possible match.' END AS message, count(*) AS n FROM told GROUP BY ALL""",
    "pinpoint_support": _AUTH + """
        , one AS (SELECT volume, reporter, page FROM clusters GROUP BY ALL HAVING count(*) = 1
        ), alone AS (
            SELECT i.cite_no, CASE WHEN c.k % 3 = 0 OR i.pin <> c.true_pin THEN 'unavailable' WHEN i.cite_no % 2 = 0 THEN 'supports' ELSE 'inconclusive' END AS pinpoint,
                c.case_name = i.plaintiff || ' v. ' || i.defendant AS same, i.year = c.found_year AS same_year, coalesce(d.docket_court, CASE WHEN c.docket_id IS NULL THEN c.cluster_court END) AS known, i.court_id
            FROM inj i JOIN one USING (volume, reporter, page) JOIN clusters c USING (volume, reporter, page) LEFT JOIN dockets d ON d.docket_id = c.docket_id)
        SELECT pinpoint, CASE WHEN same AND same_year AND (known IS NULL OR known = court_id) THEN pinpoint <> 'supports' END AS needs_review, count(*) AS n, count(*) FILTER (pinpoint = 'supports') AS n_placed FROM alone GROUP BY ALL""",
    "assessment_messages": _AUTH + """
        SELECT verdict, CASE WHEN verdict = 'match' THEN 'Case name, year, and court do not disagree with this candidate.' WHEN verdict = 'partial_match' THEN 'Case name and court do not disagree; verify the differing year.'
            WHEN name_outcome = 'mismatch' AND court_check = 'mismatch' THEN 'The retrieved candidate has a different case name and court.' WHEN name_outcome = 'mismatch' THEN 'The retrieved candidate has a different case name.'
            ELSE 'The retrieved candidate has a different court.' END AS message, count(*) AS n FROM assessed GROUP BY ALL""",
    "validated_round_trip": _AUTH + """
        , paged AS (SELECT l.cite_no, c.k % 3 <> 0 AND l.w_pin = c.true_pin AS page, l.cite_no % 2 = 0 AS supports FROM looked l JOIN clusters c USING (volume, reporter, page) WHERE l.lookup = 'found'
        ), reviews AS (SELECT a.cite_no, NOT bool_and(p.page AND p.supports) AS needs_review FROM assessed a JOIN paged p USING (cite_no) WHERE a.lookup = 'found' AND a.verdict = 'match' GROUP BY a.cite_no
        ), every_step AS (SELECT cite_no, node_type, outcome FROM steps UNION ALL SELECT cite_no, node_type, outcome FROM search_steps
            UNION ALL SELECT cite_no, 'reporter_page_retrieval', CASE WHEN page THEN 'found' ELSE 'unavailable' END FROM paged UNION ALL SELECT cite_no, 'citing_proposition', 'identified' FROM paged WHERE page
            UNION ALL SELECT cite_no, 'pinpoint_support', CASE WHEN supports THEN 'supports' ELSE 'inconclusive' END FROM paged WHERE page
        ), about AS (SELECT cite_no, node_type, outcome, node_type NOT IN ('pinpoint_support', 'local_party_reextraction', 'year_check', 'court_check') AS told FROM every_step)
        SELECT overall, node_type, outcome, count(*) AS n, count(*) FILTER (needs_review) AS n_review, count(*) FILTER (told OR node_type IN ('year_check', 'court_check') AND outcome <> 'unavailable') AS n_about
        FROM about JOIN overall USING (cite_no) LEFT JOIN reviews USING (cite_no) GROUP BY ALL""",
    "prompts_asked_once": _INJ + """
        , judged AS (SELECT w_plaintiff || ' v. ' || defendant AS said, plaintiff || ' v. ' || defendant AS retrieved, CASE WHEN cite_no // 7 % 2 = 0 THEN 'mismatch' ELSE 'match' END AS semantic_check FROM inj WHERE damage = 3)
        SELECT semantic_check, count(*) AS n, count(DISTINCT said || chr(10) || retrieved) AS n_distinct, count(DISTINCT said || chr(10) || retrieved) AS n_answers FROM judged GROUP BY ALL""",
    "model_citations": _INJ + """SELECT doc_id, start_at AS start, start_at + length(cite) AS "end", 'unknown' AS kind FROM placed""",
    "extracted_by_sql": _INJ + """
        SELECT doc_id, ordinal::INT AS ordinal, start_at::INT AS start, (start_at + length(cite))::INT AS "end", 'full_case' AS kind, w_plaintiff AS plaintiff, defendant, volume, reporter, page, w_pin AS pin_cite, w_year AS year, w_court AS court FROM found""",
    "recovered_locators": _INJ + """
        SELECT doc_id, start_at::INT AS start, (start_at + length(cite))::INT AS "end", volume, reporter, page FROM found
        UNION ALL SELECT doc_id, (start_at + length(names))::INT, (start_at + length(names) + length(volume) + length(reporter) + length(page) + 2)::INT, volume, reporter, page FROM placed WHERE damage = 2""",
    "recovered_dockets": _INJ + """
        SELECT cite_no AS doc_id, 3::BIGINT AS start, length('In Civil Action No. 1:00-cv-00000')::BIGINT AS "end", 'Civil Action No. 1:' || (cite_no % 90 + 10) || '-cv-' || (cite_no % 90000 + 10000) AS docket, w_court_id AS court_id FROM inj""",
    "docket_claims": _INJ + "SELECT count(*) FILTER (court_id = w_court_id) AS tp, count(*) FILTER (court_id <> w_court_id) AS fp, count(*) FILTER (court_id <> w_court_id) AS fn FROM inj",
    "courts_in_windows": _INJ + """
        SELECT cite_no AS doc_id, 0::BIGINT AS at, court_id FROM inj UNION ALL SELECT cite_no, length(court || ' ruled. In Civil Action No. 1:00-cv-00000 (')::BIGINT, court_id FROM inj
        UNION ALL SELECT cite_no, length(court || ' ruled. In Civil Action No. 1:00-cv-00000 (' || court || ' 2001), filed. Later ')::BIGINT, w_court_id FROM inj""",
    "decoded_opinions": """
        SELECT p_partkey::VARCHAR AS opinion_id, p_partkey::VARCHAR AS cluster_id, 'lead' AS opinion_type, CASE WHEN p_partkey % 2 = 1 THEN '<p>x</p>' END AS html, 3::INT AS ordering_key FROM part""",
    "decoded_dockets": """
        SELECT p_partkey::VARCHAR AS docket_id, CASE WHEN p_partkey % 2 = 1 THEN 'ca2' ELSE 'ca9' END AS court_id, CASE WHEN p_partkey % 2 = 1 THEN 'A v. B' END AS case_name FROM part""",
    "decoded_searches": """
        SELECT 1::INT AS candidate, 'opinion' AS source, p_partkey::VARCHAR AS found_id, 'A v. B' AS retrieved_name, '2001-02-03' AS date_filed, 'ca2' AS court_id, '/o/1' AS url, 2::BIGINT AS total, 'c' || p_partkey AS next_cursor, NULL::VARCHAR AS previous_cursor FROM part
        UNION ALL SELECT 2, 'recap', p_partkey::VARCHAR, 'C v. D', NULL, 'ca9', '/d/1', 2, 'c' || p_partkey, NULL FROM part""",
    "located_candidates": """
        SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN 15 + length('Roe v. Doe ' || p_partkey || ',  ') ELSE 15 END::BIGINT AS start, ['exact', 'without_year', 'whitespace', 'locator'][1 + p_partkey % 4] AS method, true AS whole FROM part""",
}
