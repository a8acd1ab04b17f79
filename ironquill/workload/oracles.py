"""Independent SQL for every query that SQL can express, for another engine to check against.

Written with that engine's own means (list functions, RE2 patterns, joins on
rule tables), not from the Spark expressions.  RE2 has no look-ahead: a
placeholder rule is written as match AND NOT placeholder-prefix.
"""

from __future__ import annotations

import re

from ..rules import compliance_rules as cr
from ..rules import literal_rules as lr
from ..rules import plan_limits as pl
from ..rules import scan_limits as sl
from ..rules.advisories import ADVISORIES, EOL_PREFIXES
from ..rules.secret_rules import ENV_FILE_RULE, SECRET_RULES
from .views import TODAY, duckdb_sql


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return str(value)
    return "'" + str(value).replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


def values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def listed(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def _rule_matches(i: int, rule) -> str:
    """Matches of one rule per line; the look-ahead becomes a test of each match."""
    ahead = re.search(r"\(\?!(.*?)\)", rule.regex.replace(r"|\s*$", ""))
    plain = re.sub(r"\(\?!.*?\)", "", rule.regex.replace(r"|\s*$", ""))
    keep = "true"
    if ahead:
        head = rule.regex[:rule.regex.index("(?!")]
        keep = f"NOT regexp_matches(raw, {q(head + '(' + ahead.group(1) + ')')})"
    return f"""SELECT repo, path, line, {i} AS rule_ord, {q(rule.label)} AS label, raw, match_pos FROM (
        SELECT repo, path, line, unnest(ms) AS raw, unnest(range(len(ms))) AS match_pos FROM (
        SELECT repo, path, line, regexp_extract_all(text, {q(plain)}) AS ms FROM o_lines)) WHERE {keep}"""


SEV_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 9 END"
SEV_POINTS = "CASE upper(severity) WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 20 WHEN 'MEDIUM' THEN 10 ELSE 5 END"
OLD_POINTS = "CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 10 ELSE 3 END"
BAND = ("CASE WHEN {0} >= 90 THEN 'Excellent' WHEN {0} >= 75 THEN 'Good' WHEN {0} >= 50 THEN 'Moderate' "
        "WHEN {0} >= 25 THEN 'High Risk' ELSE 'Critical' END")
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
PLAN = "lower(CASE WHEN plan IS NULL OR plan = '' THEN 'free' ELSE plan END)"
ENTROPY = ("list_sum([-(len(list_filter(string_split({0}, ''), lambda y: y = x)) / length({0})) * "
           "log2(len(list_filter(string_split({0}, ''), lambda y: y = x)) / length({0})) "
           "FOR x IN list_distinct(string_split({0}, ''))])")
VERSION = ("CASE WHEN len(regexp_extract_all({0}, '[0-9]+')) = 0 THEN [0::BIGINT] ELSE "
           "list_transform(regexp_extract_all({0}, '[0-9]+'), lambda x: x::BIGINT) END")


def _in_dirs(dirs) -> str:
    return f"list_has_any(list_slice(string_split(path, '/'), 1, -2), {listed(dirs)})"


HELP: dict[str, str] = {
    "o_ext": """SELECT *, lower(CASE WHEN contains(ltrim(base, '.'), '.') THEN '.' || string_split(base, '.')[-1]
                ELSE '' END) AS ext FROM (SELECT *, string_split(path, '/')[-1] AS base FROM v_tree)""",
    "o_scan": f"""SELECT * FROM o_ext WHERE list_contains({listed(sl.SCAN_EXTENSIONS)}, ext) AND size <= 512000
                AND NOT {_in_dirs(sl.SCAN_SKIP_DIRS)}""",
    "o_all_lines": """SELECT repo, path, text, line FROM (SELECT *, len(ls) AS n FROM (
                SELECT repo, path, ls, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT repo, path,
                string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls
                FROM v_tree))) WHERE NOT (line = n AND text = '')
                AND length(text) + CASE WHEN line < n THEN 1 ELSE 0 END <= 2000""",
    "o_lines": "SELECT l.* FROM o_all_lines l SEMI JOIN o_scan s ON l.repo = s.repo AND l.path = s.path",
    "o_matches": " UNION ALL ".join(_rule_matches(i, r) for i, r in enumerate(SECRET_RULES)),
    "o_firsts": """SELECT repo, path, label, raw, line, rule_ord, match_pos FROM o_matches QUALIFY
                row_number() OVER (PARTITION BY repo, path, label, raw ORDER BY line, rule_ord, match_pos) = 1""",
    "o_rules": values([(i, r.severity, r.description, r.fix, r.category) for i, r in enumerate(SECRET_RULES)],
                      "rule_ord, severity, description, fix, category"),
    "o_env": f"""SELECT repo, path, {q(ENV_FILE_RULE.label)} AS type, 0 AS line, 'MEDIUM' AS severity,
                {q(ENV_FILE_RULE.description)} AS description, {q(ENV_FILE_RULE.fix)} AS fix, base AS match, '' AS category,
                -1 AS rule_ord, 0 AS match_pos FROM o_scan
                WHERE base = '.env' OR (base LIKE '.env.%' AND base <> '.env.example')""",
    "o_findings": """SELECT repo, path, label AS type, line, severity, description, fix,
                CASE WHEN length(raw) <= 6 THEN '***' ELSE left(raw, 6) || repeat('*', least(8, length(raw) - 6))
                     || '  (redacted)' END AS match, category, rule_ord, match_pos FROM o_firsts JOIN o_rules USING (rule_ord)
                UNION ALL SELECT * FROM o_env""",
    "o_needles": values([(i, *r) for i, r in enumerate(cr.COMPLIANCE_RULES)], "ord, needle, owasp, nist"),
    "o_literals": values([(i, r.literal, r.title, r.severity, r.description, r.fix, r.cvss)
                          for i, r in enumerate(lr.LITERAL_RULES)],
                         "rule_ord, literal, title, severity, description, fix, cvss"),
    "o_literal_hits": """SELECT text_id, title, literal AS match, severity, description, fix, 'N/A' AS cve,
                cvss::DOUBLE AS cvss, rule_ord, 0 AS match_pos
                FROM v_texts JOIN o_literals ON contains(lower(text), lower(literal))""",
    "o_tokens": f"""SELECT text_id, token, p FROM (SELECT text_id, unnest(ms) AS token, unnest(range(len(ms))) AS p FROM (
                SELECT text_id, regexp_extract_all(text, {q(lr.ENTROPY_TOKEN_REGEX)}, 1) AS ms FROM v_texts))
                WHERE length(token) >= 32 AND regexp_full_match(token, '[A-Za-z0-9+/=]*')""",
    "o_bits": f"""SELECT text_id, left(token, 6) || '···' || right(token, 4) AS match, bits, p FROM (
                SELECT *, {ENTROPY.format('token')} AS bits FROM o_tokens) WHERE bits >= 4.5
                QUALIFY row_number() OVER (PARTITION BY text_id, left(token, 6), right(token, 4) ORDER BY p) = 1""",
    "o_entropy_hits": f"""SELECT text_id, {q(lr.ENTROPY_TITLE)} AS title, match, 'HIGH' AS severity,
                'A high-entropy string (entropy=' || printf('%.2f', bits) || ' bits/char) was found embedded in code. This '
                || 'pattern is consistent with API keys, auth tokens, or passwords.' AS description,
                {q(lr.ENTROPY_FIX)} AS fix, 'N/A' AS cve, 7.5::DOUBLE AS cvss, 44 AS rule_ord,
                row_number() OVER (PARTITION BY text_id ORDER BY p) - 1 AS match_pos FROM o_bits""",
    "o_paste": "SELECT * FROM o_literal_hits UNION ALL SELECT * FROM o_entropy_hits",
    "o_limits": values(pl.PLAN_LIMITS, ", ".join(pl.PLAN_COLUMNS)),
    "o_uplan": f"""SELECT *, CASE WHEN {PLAN} IN ('free', 'pro_trial', 'pro', 'enterprise') THEN {PLAN} ELSE 'free' END AS lp
                FROM v_users""",
    "o_ulimits": "SELECT u.*, l.* EXCLUDE (plan) FROM o_uplan u JOIN o_limits l ON u.lp = l.plan",
    "o_manifest_files": f"""SELECT *, string_split(path, '/')[-1] AS manifest FROM v_tree
                WHERE list_contains({listed(sl.MANIFESTS)}, string_split(path, '/')[-1])
                AND NOT {_in_dirs(sl.MANIFEST_SKIP_DIRS)}""",
    "o_req": """SELECT repo, path, 'requirements.txt' AS manifest, p, lower(replace(CASE WHEN pin <> '' THEN pin ELSE nm END,
                '_', '-')) AS name, ver AS version FROM (
                SELECT repo, path, p, regexp_extract(l, '^([A-Za-z0-9_.-]+)\\s*[=<>~!]{{1,2}}\\s*[0-9][A-Za-z0-9.-]*', 1) AS pin,
                regexp_extract(l, '^[A-Za-z0-9_.-]+\\s*[=<>~!]{{1,2}}\\s*([0-9][A-Za-z0-9.-]*)', 1) AS ver,
                regexp_extract(l, '^[A-Za-z0-9_.-]+') AS nm, l FROM (SELECT repo, path, unnest(range(len(ls))) AS p,
                trim(unnest(ls), ' ' || chr(13)) AS l FROM (SELECT repo, path, string_split(replace(content, chr(13), ''),
                chr(10)) AS ls FROM o_manifest_files WHERE manifest = 'requirements.txt')))
                WHERE l <> '' AND l[1] NOT IN ('#', '-') AND nm <> ''""",
    # A key may stand twice in the file, so the pairs are read from the text.
    "o_pkgjson": """SELECT repo, path, 'package.json' AS manifest, p, lower(z[1]) AS name,
                regexp_replace(z[2], '^[\\^~>=<\\s]+', '') AS version FROM (
                SELECT repo, path, unnest(range(len(zs))) AS p, unnest(zs) AS z FROM (SELECT repo, path,
                list_zip(regexp_extract_all(t, '"([^"]+)": "', 1), regexp_extract_all(t, '": "([^"]*)"', 1)) AS zs FROM (
                SELECT repo, path, substr(content, strpos(content, '"dependencies"')) AS t FROM o_manifest_files
                WHERE manifest = 'package.json' AND json_valid(content))))""",
    "o_lock": """SELECT repo, path, 'package-lock.json' AS manifest, p, lower(string_split(e.key, 'node_modules/')[-1]) AS name,
                e.value->>'$.version' AS version FROM (SELECT repo, path, unnest(range(len(es))) AS p, unnest(es) AS e FROM (
                SELECT repo, path, map_entries(CAST(json_extract(content, '$.packages') AS MAP(VARCHAR, JSON))) AS es
                FROM o_manifest_files WHERE manifest = 'package-lock.json'))
                WHERE contains(e.key, 'node_modules/')
                UNION ALL SELECT repo, path, 'package-lock.json', p, lower(name), version FROM (
                SELECT repo, path, unnest(range(len(ps))) AS p, unnest(ps)[1] AS name, unnest(ps)[2] AS version FROM (
                -- of two equal keys side by side the later replaces the earlier and what is nested in it
                SELECT repo, path, CASE WHEN ps[1][1] = ps[3][1] THEN [ps[3]] ELSE ps END AS ps FROM (
                SELECT repo, path, list_zip(regexp_extract_all(replace(content, '"dependencies": ', ''),
                '"([^"]+)": [{{]"version": "', 1), regexp_extract_all(content, '"version": "([^"]+)"', 1)) AS ps
                FROM o_manifest_files WHERE manifest = 'package-lock.json'
                AND json_extract(content, '$.packages') IS NULL)))""",
    "o_piplock": """SELECT repo, path, 'Pipfile.lock' AS manifest, p, lower(z[1]) AS name, ltrim(z[2], '=') AS version FROM (
                SELECT repo, path, unnest(range(len(zs))) AS p, unnest(zs) AS z FROM (SELECT repo, path, list_zip(
                regexp_extract_all(content, '"([^"]+)": [{{]"version": "', 1),
                regexp_extract_all(content, '"version": "([^"]*)"', 1)) AS zs FROM (
                SELECT repo, path, replace(replace(content, '"default": ', ''), '"develop": ', '') AS content
                FROM o_manifest_files WHERE manifest = 'Pipfile.lock')))""",
    "o_pipfile": """SELECT repo, path, 'Pipfile' AS manifest, p, replace(lower(m[1]), '_', '-') AS name,
                CASE WHEN ltrim(m[2], '=~^<>') = '*' THEN '' ELSE ltrim(m[2], '=~^<>') END AS version FROM (
                SELECT repo, path, p, [regexp_extract(l, '^([A-Za-z0-9_.-]+)\\s*=\\s*"', 1),
                regexp_extract(l, '=\\s*"([^"]*)"', 1)] AS m FROM (
                SELECT repo, path, unnest(range(len(ls))) AS p, unnest(ls) AS l FROM (SELECT repo, path,
                string_split(split_part(split_part(content, '[packages]', 2), chr(10) || '[', 1), chr(10)) ||
                string_split(split_part(content, '[dev-packages]', 2), chr(10)) AS ls
                FROM o_manifest_files WHERE manifest = 'Pipfile'))) WHERE m[1] <> ''""",
    "o_poetry": """SELECT repo, path, 'poetry.lock' AS manifest, p, lower(regexp_extract(b, '(?m)^name\\s*=\\s*"([^"]+)"', 1))
                AS name, regexp_extract(b, '(?m)^version\\s*=\\s*"([^"]+)"', 1) AS version FROM (
                SELECT repo, path, unnest(range(len(bs))) AS p, unnest(bs) AS b FROM (
                SELECT repo, path, string_split(content, '[[package]]')[2:] AS bs
                FROM o_manifest_files WHERE manifest = 'poetry.lock'))""",
    "o_parsed": " UNION ALL ".join(f"SELECT repo, path, manifest, p, name, version FROM {t}" for t in (
        "o_req", "o_pkgjson", "o_lock", "o_piplock", "o_pipfile", "o_poetry")),
    "o_priority": values([(m, i) for i, m in enumerate(sl.MANIFESTS)], "manifest, priority"),
    "o_deps": """SELECT repo, name, version, path, manifest, priority, min(pos) OVER (PARTITION BY repo, name, path) AS pos
                FROM v_declared JOIN o_priority USING (manifest) QUALIFY
                row_number() OVER (PARTITION BY repo, name ORDER BY priority, path, v_declared.pos DESC) = 1""",
    "o_parsed_deps": """SELECT repo, name, version, path, priority, min(p) OVER (PARTITION BY repo, name, path) AS pos FROM o_parsed JOIN o_priority USING (manifest) QUALIFY
                row_number() OVER (PARTITION BY repo, name ORDER BY priority, path, p DESC) = 1""",
    "o_adv": values([(a.name, i, a.max_version, a.severity, a.cve, a.description) for i, a in enumerate(ADVISORIES)],
                    "name, ord, max_version, severity, cve, description"),
    "o_eol": values([(n, ".".join(map(str, p))) for n, p in EOL_PREFIXES], "name, prefix"),
}


def _cve_findings(source: str, known: str = "o_adv") -> str:
    return f"""SELECT repo, 'Vulnerable Dependency' AS title, 'Vulnerable Dependency' AS type,
        'Dependency Vulnerability' AS category, d.name AS package, d.version, severity,
        description || ' Affects versions <= ' || max_version || '.' AS description,
        'Upgrade ' || d.name || ' to a version newer than ' || max_version || '.' AS fix, cve,
        d.name || '==' || d.version AS match FROM {source} d JOIN {known} a ON d.name = a.name AND d.version <> ''
        AND {VERSION.format('d.version')} <= {VERSION.format('a.max_version')}
        QUALIFY row_number() OVER (PARTITION BY repo, d.name ORDER BY a.ord) = 1"""


def _eol_findings(source: str, cves: str) -> str:
    return f"""SELECT repo, 'Outdated Dependency' AS title, 'Outdated Dependency' AS type,
        'Dependency Vulnerability' AS category, d.name AS package, version, 'LOW' AS severity,
        d.name || ' ' || version || ' is an end-of-life or significantly outdated major version.' AS description,
        'Upgrade ' || d.name || ' to a currently supported major version.' AS fix, 'N/A' AS cve,
        d.name || '==' || version AS match FROM {source} d JOIN o_eol e ON d.name = e.name AND version <> ''
        AND list_slice({VERSION.format('version')}, 1, 2) <= {VERSION.format('prefix')}
        WHERE NOT EXISTS (SELECT 1 FROM {cves} c WHERE c.repo = d.repo AND c.package = d.name)"""


HELP["o_dep_cves"] = _cve_findings("o_deps")
HELP["o_many_cves"] = _cve_findings("o_deps", "(SELECT *, detail AS description FROM v_advisories)")
HELP["o_dep_eol"] = _eol_findings("o_deps", "o_dep_cves")
HELP["o_dep_found"] = "SELECT * FROM o_dep_cves UNION ALL SELECT * FROM o_dep_eol"
HELP["o_pdep_cves"] = _cve_findings("o_parsed_deps")
HELP["o_pdep_found"] = f"SELECT * FROM o_pdep_cves UNION ALL {_eol_findings('o_parsed_deps', 'o_pdep_cves')}"
HELP["o_compliance"] = """SELECT f.*, coalesce(n.owasp, 'A05 Security Misconfiguration') AS owasp, coalesce(n.nist, 'SI-2') AS nist
    FROM (SELECT f.*, (SELECT min(ord) FROM o_needles WHERE contains(f.hay, needle)) AS o FROM (
    SELECT *, lower(concat_ws(' ', '', title, '', description, match)) AS hay FROM o_paste) f) f LEFT JOIN o_needles n ON f.o = n.ord"""
HELP["o_secret_compliance"] = """SELECT f.*, coalesce(n.owasp, 'A05 Security Misconfiguration') AS owasp FROM (
    SELECT f.*, (SELECT min(ord) FROM o_needles WHERE contains(f.hay, needle)) AS o FROM (SELECT *,
    lower(concat_ws(' ', type, '', category, description, match)) AS hay FROM o_findings) f) f LEFT JOIN o_needles n ON f.o = n.ord"""
HELP["o_owasp"] = f"""SELECT *, row_number() OVER (PARTITION BY repo ORDER BY findings DESC, seen) AS rank FROM (
    SELECT repo, owasp, count(*) AS findings, min(row({SEV_RANK}, path, line, rule_ord, match_pos)) AS seen
    FROM o_secret_compliance GROUP BY 1, 2)"""
SECRET_HAY = "lower(concat_ws(' ', type, category))"
HELP["o_is_secret"] = f"""SELECT repo, severity, (len(list_filter({listed(cr.SECRET_TERMS)},
    lambda t: contains({SECRET_HAY}, t))) > 0)::INT AS secret FROM o_findings"""
HELP["o_scan_marks"] = """SELECT repo, severity, secret, 1 AS own, 0 AS dep, 0 AS pkg FROM o_is_secret
    UNION ALL SELECT repo, severity, 0, 0, 1, 0 FROM o_pdep_found UNION ALL SELECT repo, NULL, 0, 0, 0, 1 FROM o_parsed_deps"""
HELP["o_scan_report"] = f"""SELECT *, {BAND.format('security_score')} AS score_risk_level,
    NOT is_pro AND total_secrets > 5 AS truncated, CASE WHEN NOT is_pro AND total_secrets > 5 THEN 'Upgrade to Pro to see all '
    || total_secrets || ' findings and download the PDF report.' ELSE '' END AS upgrade_message FROM (
    SELECT r.repo, is_pro, source, CASE WHEN coalesce(total_secrets, 0) = 0 THEN 'NONE' WHEN critical > 0 THEN 'CRITICAL'
    WHEN high > 0 THEN 'HIGH' WHEN medium > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    greatest(0, 100 - coalesce(points, 0))::BIGINT AS security_score, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high,
    coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(total_secrets, 0) AS total_secrets,
    coalesce(health_critical, 0) AS health_critical, coalesce(health_high, 0) AS health_high,
    coalesce(health_medium, 0) AS health_medium, coalesce(health_low, 0) AS health_low,
    coalesce(secret_count, 0) AS secret_count, coalesce(dependency_count, 0) AS dependency_count,
    coalesce(outdated_packages, 0) AS outdated_packages FROM v_repos r LEFT JOIN (SELECT repo,
    sum(CASE WHEN severity IS NULL THEN 0 ELSE {SEV_POINTS} END) AS points,
    count(*) FILTER (severity = 'CRITICAL' AND own = 1) AS critical, count(*) FILTER (severity = 'HIGH' AND own = 1) AS high,
    count(*) FILTER (severity = 'MEDIUM' AND own = 1) AS medium, count(*) FILTER (severity = 'LOW' AND own = 1) AS low,
    sum(own)::BIGINT AS total_secrets, count(*) FILTER (severity = 'CRITICAL') AS health_critical,
    count(*) FILTER (severity = 'HIGH') AS health_high, count(*) FILTER (severity = 'MEDIUM') AS health_medium,
    count(*) FILTER (severity = 'LOW') AS health_low, sum(secret)::BIGINT AS secret_count, sum(pkg)::BIGINT AS dependency_count,
    sum(dep)::BIGINT AS outdated_packages FROM o_scan_marks GROUP BY 1) m ON r.repo = m.repo)"""
HELP["o_keyed"] = """SELECT req_id, ts, epoch_us(ts) AS t, CASE WHEN path LIKE '/auth/%' THEN 'auth'
    WHEN contains(path, '/analyze') OR contains(path, '/scan') THEN 'scan' WHEN path LIKE '/payment/%' THEN 'payment'
    ELSE 'default' END AS bucket, CASE WHEN cf_ip <> '' THEN trim(split_part(cf_ip, ',', 1))
    WHEN real_ip <> '' THEN trim(split_part(real_ip, ',', 1)) WHEN fwd_for <> '' THEN trim(split_part(fwd_for, ',', 1))
    ELSE coalesce(peer, 'unknown') END AS ip FROM {src}"""
HELP["o_burst_keyed"] = HELP["o_keyed"].replace("{src}", "v_burst")
HELP["o_keyed"] = HELP["o_keyed"].replace("{src}", "v_requests")
# Window starts: follow each key from its first request to the first one past the window, and so on.
HELP["o_windows"] = """SELECT ip, bucket, s, lead(s) OVER (PARTITION BY ip, bucket ORDER BY s) AS e FROM o_chain"""
RATE = """SELECT req_id, ip, bucket, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, n AS request_number, n <= lim AS allowed,
    greatest(0, lim - n) AS remaining, ((60000000 - (t - s)) // 1000000)::BIGINT AS reset_in FROM (
    SELECT k.*, w.s, row_number() OVER (PARTITION BY k.ip, k.bucket, w.s ORDER BY t, req_id) AS n,
    CASE k.bucket WHEN 'auth' THEN 5 WHEN 'scan' THEN 30 WHEN 'payment' THEN 10 ELSE 60 END AS lim
    FROM o_burst_keyed k ASOF JOIN o_chain w ON k.ip = w.ip AND k.bucket = w.bucket AND k.t >= w.s)"""
HELP["o_trend"] = f"""SELECT user_id, id, date, score FROM (SELECT user_id, id, ts2::DATE AS date, CASE
    WHEN list_contains(json_keys(result_json), 'security_score') THEN json_extract_string(result_json, '$.security_score')::INT
    ELSE json_extract_string(result_json, '$.score')::INT END AS score FROM (SELECT *, created_at AS ts2 FROM v_scans
    WHERE created_at >= TIMESTAMP '{TODAY} 00:00:00' - INTERVAL 30 DAY
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) <= 500)) WHERE score IS NOT NULL"""
HELP["o_trial"] = f"""SELECT *, running OR p IN ('pro', 'enterprise') AS good FROM (
    SELECT *, p = 'pro_trial' AND coalesce(trial_active, true) AND te IS NOT NULL AND DATE '{TODAY}' <= te AS running FROM (
    SELECT *, {PLAN} AS p, coalesce(trial_end_date, CASE WHEN {PLAN} = 'pro_trial' THEN created_at::DATE + 30 END) AS te
    FROM v_users))"""
HELP["o_cve"] = """SELECT *, coalesce(v31, v30, v2) AS cvss_score, CASE WHEN coalesce(v31, v30, v2) IS NULL THEN 'UNKNOWN'
    WHEN coalesce(v31, v30, v2) >= 9 THEN 'CRITICAL' WHEN coalesce(v31, v30, v2) >= 7 THEN 'HIGH'
    WHEN coalesce(v31, v30, v2) >= 4 THEN 'MEDIUM' WHEN coalesce(v31, v30, v2) > 0 THEN 'LOW' ELSE 'NONE' END AS severity
    FROM v_cve_flat"""
CVE_FLAT = """SELECT id, cvss_score, severity, published, left(description, 500) AS description, array_to_string(list_slice(
    list_transform(list_filter(range(cpes + 1), lambda i: i % 3 <> 1), lambda i: 'cpe:' || k || ':' || i), 1, 5), ' | ')
    AS affected_products, 'Review the references for ' || id || ' and apply the vendor''s recommended patch or upgrade '
    || 'affected packages to a non-vulnerable version.' AS remediation, array_to_string(list_slice(list_transform(
    range(1, cpes + 2), lambda i: 'https://ref.example/' || i), 1, 5), ' | ') AS references FROM o_cve"""
EPSS = "round(try_cast(epss AS DOUBLE), 4) AS epss_score, try_cast(epss AS DOUBLE) >= 0.1 AS exploit_available"
HELP["o_pe"] = """SELECT *, event_type IN ('BILLING.SUBSCRIPTION.ACTIVATED', 'PAYMENT.CAPTURE.COMPLETED', 'USER_CANCELLED',
    'MANUAL', 'SUBSCRIPTION_ACTIVATED', 'ORDER_CAPTURED') AS by_user, CASE WHEN event_type IN ('BILLING.SUBSCRIPTION.RENEWED', 'PAYMENT.SALE.COMPLETED')
    THEN coalesce(nullif(agreement_id, ''), nullif(res_id, '')) WHEN event_type LIKE 'BILLING.%'
    OR event_type IN ('SUBSCRIPTION_ACTIVATED', 'USER_CANCELLED') THEN nullif(res_id, '') END AS sub,
    CASE WHEN event_type IN ('BILLING.SUBSCRIPTION.ACTIVATED', 'SUBSCRIPTION_ACTIVATED') THEN coalesce(nullif(custom_id, ''), nullif(sub_email, ''))
    WHEN event_type IN ('PAYMENT.CAPTURE.COMPLETED', 'ORDER_CAPTURED') THEN coalesce(nullif(custom_id, ''), nullif(invoice_id, ''))
    WHEN event_type IN ('USER_CANCELLED', 'MANUAL') THEN nullif(custom_id, '') END AS usr FROM v_payment_events"""
HELP["o_direct"] = "SELECT p.*, u.id AS user_id FROM o_pe p JOIN v_users u ON p.by_user AND p.usr = u.id"
HELP["o_grants"] = """SELECT user_id, sub, seq AS s, lead(seq, 1, 9223372036854775807) OVER (PARTITION BY user_id ORDER BY seq) AS e
    FROM (SELECT user_id, sub, seq FROM o_direct WHERE event_type IN ('BILLING.SUBSCRIPTION.ACTIVATED', 'SUBSCRIPTION_ACTIVATED') AND sub IS NOT NULL
    UNION ALL SELECT id, nullif(paypal_subscription_id, ''), -1 FROM v_users)"""
HELP["o_routed"] = """SELECT seq, ts, event_type, sub, res_id, billing, user_id FROM o_direct WHERE NOT (
    event_type IN ('BILLING.SUBSCRIPTION.ACTIVATED', 'SUBSCRIPTION_ACTIVATED') AND sub IS NULL)
    UNION ALL SELECT p.seq, any_value(ts), any_value(event_type), any_value(p.sub), any_value(res_id), any_value(billing), min(g.user_id) FROM o_pe p
    JOIN o_grants g ON NOT p.by_user AND p.sub = g.sub AND p.seq > g.s AND p.seq < g.e GROUP BY p.seq"""


def _last(column: str, branches: str, stored: str | None) -> str:
    old = stored or "NULL"
    return f"coalesce((SELECT arg_max(v, seq) FROM (SELECT seq, CASE {branches} END AS v)), {old}) AS {column}"


ACT, CAP, DOWN = "'BILLING.SUBSCRIPTION.ACTIVATED'", "'PAYMENT.CAPTURE.COMPLETED'", (
    "'BILLING.SUBSCRIPTION.PAYMENT.FAILED', 'BILLING.SUBSCRIPTION.SUSPENDED', 'BILLING.SUBSCRIPTION.CANCELLED'")
CHK, ORD = "'SUBSCRIPTION_ACTIVATED'", "'ORDER_CAPTURED'"
MONTHLY, ANNUAL = (f"(event_type = {ACT} OR event_type = {CHK} AND billing IS DISTINCT FROM 'annual')",
                   f"(event_type = {CHK} AND billing = 'annual')")
REN = "'BILLING.SUBSCRIPTION.RENEWED', 'PAYMENT.SALE.COMPLETED'"
_FOLD = {
    "is_pro": (f"WHEN event_type IN ({DOWN}) THEN false WHEN event_type <> 'USER_CANCELLED' THEN true", "is_pro"),
    "plan": (f"WHEN event_type IN ({DOWN}) THEN 'free' WHEN event_type <> 'USER_CANCELLED' THEN 'pro'", "plan"),
    "trial_active": (f"WHEN event_type IN ({DOWN}, {ACT}, {CAP}, {CHK}, {ORD}, 'MANUAL') THEN false", "trial_active"),
    "paypal_order_id": (f"WHEN {MONTHLY} THEN '' WHEN event_type IN ({CAP}, {ORD}) THEN res_id", None),
    "paypal_subscription_id": (f"WHEN event_type IN ({ACT}, {CHK}) THEN sub", "paypal_subscription_id"),
    "subscription_status": (f"WHEN event_type IN ({ACT}, {CHK}, {REN}) THEN 'ACTIVE' WHEN event_type IN ({DOWN}) THEN 'INACTIVE' "
                            "WHEN event_type = 'MANUAL' THEN 'MANUAL' WHEN event_type = 'USER_CANCELLED' THEN 'CANCELLING'",
                            "subscription_status"),
    "subscription_billing": (f"WHEN {MONTHLY} THEN 'monthly' WHEN {ANNUAL} THEN 'annual'", "subscription_billing"),
    "subscription_renewed_at": (f"WHEN event_type IN ({REN}) OR {ANNUAL} THEN ts::DATE::STRING", None),
    "downgraded_at": (f"WHEN event_type IN ({DOWN}) THEN ts::DATE::STRING", None),
    "downgrade_reason": ("WHEN event_type = 'BILLING.SUBSCRIPTION.CANCELLED' THEN 'subscription_cancelled' "
                         f"WHEN event_type IN ({DOWN}) THEN 'payment_failed'", None),
}
HELP["o_sub_new"] = "SELECT user_id, count(*) AS events, " + ", ".join(
    f"arg_max(CASE {b} END, seq) FILTER (CASE {b} END IS NOT NULL) AS n_{c}" for c, (b, _) in _FOLD.items()
) + " FROM o_routed GROUP BY user_id"
SUB_STATE = "SELECT u.id, {0}" + ", ".join(
    f"coalesce(n_{c}, {'u.' + s if s else 'NULL'}) AS {c}" for c, (_, s) in _FOLD.items()
) + " FROM v_users u LEFT JOIN o_sub_new n ON u.id = n.user_id"
LINE = " || ' | ' || "
PAD = "SELECT repo, {0} AS {1} FROM o_scan_report"


def _fix_case(field: str) -> str:
    def branch(r):
        value = {"explanation": q(r.explanation), "confidence": str(r.confidence), "before": f"trim(text, {WS})",
                 "after": f"trim(regexp_replace(text, {q(r.regex)}, {q(r.replacement)}), {WS})"}[field]
        return f"WHEN regexp_matches(text, {q(r.regex)}) THEN {value}"
    return "CASE " + " ".join(branch(r) for r in cr.AUTOFIX_RULES) + " END"


INJECTION = " OR ".join(f"regexp_matches(query, {q('(?i)' + r)})" for r in lr.INJECTION_REGEXES)
DEP_COLS = "repo, title, type, category, package, version, severity, description, fix, cve, match"

WORDS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'))"
HELP["o_asked"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY rule_ord, match_pos) AS rn
    FROM o_paste) WHERE rn <= 5 AND cve = 'N/A'"""
HELP["o_best"] = f"""SELECT title, id, v31 AS cvss_score FROM (SELECT DISTINCT title FROM o_asked) a JOIN o_cve c
    ON list_has_all({WORDS.format('c.description')}, {WORDS.format('a.title')})
    QUALIFY row_number() OVER (PARTITION BY title ORDER BY published DESC, id DESC) = 1""".replace(
    "{L}", "{{L}}").replace("{N}", "{{N}}")

RAW: dict[str, str] = {
    "finding_cve_lookup": """SELECT text_id, a.title, match, b.id AS top_cve, b.cvss_score AS top_cvss
        FROM o_asked a LEFT JOIN o_best b ON a.title = b.title""",
    "src_file_corpus": f"""SELECT repo, path, FALSE AS is_link, octet_length(encode(content))::BIGINT AS size, md5(content) AS content_md5
        FROM o_ext WHERE list_contains({listed(sl.SCAN_EXTENSIONS)}, ext) AND octet_length(encode(content)) <= 512000
        AND NOT {_in_dirs(sl.SCAN_SKIP_DIRS)}""",
    "src_lines": "SELECT repo, path, line, text FROM o_all_lines",
    "src_manifests": "SELECT repo, path, manifest FROM o_manifest_files",
    "src_cve_feed": "SELECT id, published, description, cpes + 1 AS n_references FROM v_cve_flat",
    "src_epss_feed": "SELECT cve, epss FROM v_epss",
    "src_tables": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderdate >= TIMESTAMP '1998-01-01' ORDER BY 1",
    "sink_scan_results": """SELECT id, user_id, source, risk_level, total_secrets, result_json, created_at::DATE::STRING AS scan_date
        FROM v_scans""",
    "sink_upsert_usage": "SELECT user_id, date::STRING AS date, request_count FROM v_usage",
    "sink_latest_state": """SELECT id, arg_max(state, updated_at) AS state, arg_max(progress, updated_at) AS progress,
        arg_max(result_json, updated_at) FILTER (result_json IS NOT NULL) AS result_json, max(updated_at) AS updated_at
        FROM v_tasks GROUP BY id""",
    "sink_append_log": "SELECT id, user_id, action, resource, least(500, length(metadata)) AS metadata_chars FROM v_audit",
    "secret_match": "SELECT repo, path, line, label, match_pos, raw FROM o_matches",
    "env_file_match": "SELECT repo, path, type, line, severity, match, category FROM o_env",
    "dedup_matches": "SELECT repo, path, label, raw, line, match_pos FROM o_firsts",
    "sort_findings": f"""SELECT repo, path, type, line, severity, description, fix, match, category FROM o_findings
        ORDER BY repo, {SEV_RANK}, path, line, rule_ord, match_pos""",
    "redact": """SELECT text_id, CASE WHEN length(text) <= 6 THEN '***' ELSE left(text, 6) || repeat('*', least(8,
        length(text) - 6)) || '  (redacted)' END AS redacted, CASE WHEN length(text) <= 6 THEN '***' WHEN length(text) = 7
        THEN left(text, 6) || '*  (redacted)' ELSE left(text, 6) || '**  (redacted)' END AS short FROM v_snippets""",
    "literal_rule_match": "SELECT * EXCLUDE (rule_ord, match_pos) FROM o_literal_hits",
    "entropy_secrets": "SELECT * EXCLUDE (rule_ord, match_pos) FROM o_entropy_hits",
    "analyze_text": "SELECT * EXCLUDE (rule_ord, match_pos) FROM o_paste",
    "injection_filter": f"SELECT req_id, query, ({INJECTION}) AS flagged FROM v_requests",
    "request_bucket": "SELECT req_id, bucket FROM o_keyed",
    "client_ip": "SELECT req_id, ip FROM o_keyed",
    "content_type_guard": """SELECT req_id, method IN ('POST', 'PUT', 'PATCH') AND content_type LIKE '%text/html%'
        AND path LIKE '/api/%' AS reject FROM v_requests""",
    "validate_repo_urls": """SELECT url_id, reason IS NULL AS ok, reason FROM (SELECT url_id, CASE
        WHEN u LIKE 'https://github.com/%' THEN CASE WHEN len(list_filter(string_split(regexp_extract(u,
             '^https://github.com/([^?#]*)', 1), '/'), lambda x: x <> '')) < 2
             THEN 'URL must point to a specific repository: https://github.com/owner/repo' END
        WHEN u NOT LIKE 'https:%' THEN 'Only HTTPS repository URLs are accepted.'
        ELSE 'Only GitHub (github.com) repositories are supported.' END AS reason
        FROM (SELECT url_id, trim(url) AS u FROM v_urls))""",
    "validate_registrations": """SELECT reg_id, e AS email, replace(replace(replace(replace(replace(o, '&', '&amp;'), '<',
        '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS org_name, email_error, password_error, org_error,
        email_error IS NULL AND password_error IS NULL AND org_error IS NULL AS ok FROM (SELECT *,
        CASE WHEN NOT contains(e, '@') OR NOT contains(string_split(e, '@')[-1], '.') THEN 'Invalid email address'
             WHEN length(e) > 254 THEN 'Email address too long' WHEN regexp_matches(e, '[<>";'']|--|/\\*')
             THEN 'Invalid characters in email address' END AS email_error,
        CASE WHEN length(password) < 8 THEN 'Password must be at least 8 characters' WHEN length(password) > 128
             THEN 'Password too long (max 128 characters)' END AS password_error,
        CASE WHEN o = '' THEN 'Organization name is required' WHEN length(o) > 100
             THEN 'Organization name too long (max 100 characters)' END AS org_error
        FROM (SELECT *, trim(lower(email)) AS e, trim(org_name) AS o FROM v_registrations))""",
    "validate_text": f"""SELECT text_id, length(t) AS chars, t <> '' AND length(t) <= 50000 AS ok,
        CASE WHEN t = '' THEN 'Code text cannot be empty' WHEN length(t) > 50000 THEN 'Input too large (max 50,000 chars)' END AS reason FROM (SELECT text_id, trim(text, {WS}) AS t FROM v_texts)""",
    "archive_guard": """SELECT archive, n AS members, b AS total_bytes, reason, reason IS NULL AS ok FROM (SELECT archive, n, b,
        CASE WHEN n > 1000 THEN 'ZIP contains too many files (' || format('{{:,}}', n) || '). Limit is 1,000.'
        WHEN b > 52428800 THEN 'ZIP uncompressed size exceeds 50 MB limit.'
        WHEN bad IS NOT NULL THEN 'Unsafe path in ZIP (path traversal): ' || bad END AS reason FROM (
        SELECT archive, count(*) AS n, sum(size)::BIGINT AS b, min(member) FILTER (member LIKE '/%' OR member LIKE '../%') AS bad
        FROM v_members GROUP BY archive))""",
    "repo_size_guard": f"""SELECT repo, n AS files, b AS total_bytes, reason, reason IS NULL AS ok FROM (SELECT repo, n, b,
        CASE WHEN n > 1000 THEN 'Repository exceeds 1,000 file limit.' WHEN b > 52428800
        THEN 'Repository exceeds 50 MB size limit.' END AS reason FROM (SELECT repo, count(*) FILTER (c) AS n,
        coalesce(sum(size) FILTER (c), 0)::BIGINT AS b FROM (SELECT *, NOT is_link AND NOT {_in_dirs(sl.SCAN_SKIP_DIRS)} AS c
        FROM v_tree) GROUP BY repo))""",
    "audit_search": f"""SELECT id, user_id, action, {STAMP.format('created_at')} AS created_at FROM v_audit
        WHERE org_id = 'org3' AND action ILIKE '%S_a%' ORDER BY v_audit.created_at DESC, id DESC LIMIT 60""",
    "plan_gate": f"SELECT id, plan, {PLAN} IN ('pro', 'pro_trial', 'enterprise') AS allowed FROM v_users",
    "expired_trials": """SELECT id, 'free' AS plan, false AS trial_active, false AS is_pro FROM o_trial
        WHERE p = 'pro_trial' AND plan = 'pro_trial' AND NOT running""",
    "team_members": """SELECT org_id, id, email, plan, trial_active, is_pro, created_at::STRING AS created_at FROM v_users
        WHERE org_id IS NOT NULL""",
    "user_org_limits": f"""SELECT u.id, email, o.name AS org_name, CASE {PLAN} WHEN 'pro_trial' THEN 'Pro Trial' WHEN 'pro' THEN 'Pro'
        WHEN 'enterprise' THEN 'Enterprise' ELSE 'Free' END AS plan_label, daily_scans, history_limit, ai_depth, pdf_download
        FROM o_ulimits u LEFT JOIN v_orgs o ON u.org_id = o.id""",
    "dashboard_bundle": f"""SELECT u.id AS user_id, {PLAN} AS plan, daily_scans AS usage_limit, coalesce((SELECT request_count
        FROM v_usage x WHERE x.user_id = u.id AND date = DATE '2024-01-15'), 0) AS usage_today,
        CASE WHEN org_id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY org_id) END AS team_size, s.series, h.history
        FROM o_ulimits u LEFT JOIN (SELECT user_id, string_agg(date || '=' || request_count, ' | ' ORDER BY date DESC) AS series
        FROM (SELECT * FROM v_usage QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC) <= 30) GROUP BY 1) s
        ON s.user_id = u.id LEFT JOIN (SELECT user_id, string_agg(id, ' | ' ORDER BY created_at DESC, id DESC) AS history
        FROM (SELECT * FROM v_scans QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 10)
        GROUP BY 1) h ON h.user_id = u.id""",
    "usage_daily": "SELECT user_id, ts::DATE::STRING AS date, count(*) AS request_count FROM v_requests GROUP BY 1, 2",
    "quota_check": f"""SELECT req_id, user_id, plan, usage_count, daily_scans, daily_scans = -1 OR usage_count <= daily_scans
        AS allowed FROM (SELECT r.req_id, r.user_id, {PLAN.replace('plan', 'u.plan')} AS plan, coalesce(daily_scans, 5) AS daily_scans, row_number() OVER (
        PARTITION BY r.user_id, ts::DATE ORDER BY ts, req_id) AS usage_count
        FROM v_requests r LEFT JOIN o_ulimits u ON r.user_id = u.id)""",
    "usage_meter": """SELECT user_id, date::STRING AS date, request_count, unlimited, CASE WHEN NOT unlimited THEN pct END AS pct,
        CASE WHEN unlimited THEN NULL WHEN pct >= 90 THEN 'danger' WHEN pct >= 70 THEN 'warning' ELSE 'success' END AS band FROM (
        SELECT x.*, daily_scans < 1 AS unlimited, least(100, floor(request_count * 100.0 / daily_scans + 0.5))::BIGINT AS pct
        FROM v_usage x JOIN o_ulimits u ON x.user_id = u.id)""",
    "usage_history": """SELECT user_id, date::STRING AS date, request_count, row_number() OVER (PARTITION BY user_id
        ORDER BY date DESC) AS rank FROM v_usage QUALIFY rank <= 7""",
    "usage_7day_series": """SELECT u.id AS user_id, d.date::DATE::STRING AS date, coalesce(x.request_count, 0) AS request_count
        FROM v_users u CROSS JOIN (SELECT unnest(range(DATE '2024-01-14', DATE '2024-01-21', INTERVAL 1 DAY))::DATE AS date) d
        LEFT JOIN v_usage x ON x.user_id = u.id AND x.date = d.date""",
    "recent_scans": """SELECT user_id, s.id, s.risk_level, row_number() OVER (PARTITION BY user_id ORDER BY s.created_at DESC,
        s.id DESC) AS rank FROM v_scans s JOIN o_ulimits u ON s.user_id = u.id QUALIFY rank <= least(20, u.history_limit)""",
    "security_trend": """SELECT u.id AS user_id, coalesce(round_even(avg(score)::DECIMAL(20, 12), 1)::DOUBLE, 0) AS average_score,
        coalesce(max(score), 0) AS best_score, coalesce(min(score), 0) AS worst_score, count(score) AS count
        FROM v_users u LEFT JOIN o_trend t ON t.user_id = u.id GROUP BY u.id""",
    "trend_points": "SELECT user_id, id, date::STRING AS date, score FROM o_trend",
    "sort_history": f"""SELECT id, {STAMP.format('created_at')} AS created_at FROM v_scans
        ORDER BY v_scans.created_at DESC, id DESC LIMIT 100""",
    "sort_audit": f"""SELECT id, {STAMP.format('created_at')} AS created_at FROM v_audit
        ORDER BY v_audit.created_at DESC, id DESC LIMIT 100""",
    "sort_trend": f"""SELECT id, {STAMP.format('created_at')} AS created_at FROM v_scans ORDER BY v_scans.created_at, id
        LIMIT 500""",
    "trial_status": f"""SELECT id, CASE WHEN good THEN p ELSE 'free' END AS eff_plan, good AS eff_is_pro, running AS in_trial,
        p = 'pro_trial' AND NOT running AS trial_expired, CASE WHEN running THEN te - DATE '{TODAY}' ELSE 0 END AS days_left,
        CASE WHEN p = 'pro_trial' AND coalesce(trial_active, true) THEN coalesce(te::STRING, '') ELSE '' END AS trial_end,
        p = 'free' AND trial_start_date IS NULL AS can_start_trial,
        coalesce(paypal_subscription_id <> '' AND subscription_status = 'ACTIVE', false) AS can_cancel,
        CASE WHEN NOT good THEN 'Free' WHEN p = 'pro_trial' THEN 'Pro Trial' WHEN p = 'pro' THEN 'Pro' ELSE 'Enterprise' END
        AS plan_label FROM o_trial""",
    "dedup_in_manifest": """SELECT repo, path, name, arg_max(version, pos) AS version, min(pos) AS pos FROM v_declared
        GROUP BY repo, path, manifest, name""",
    "dedup_packages": "SELECT repo, name, version, path, manifest, pos FROM o_deps",
    "dependency_count": "SELECT repo, count(DISTINCT name) AS dependency_count FROM v_declared GROUP BY 1",
    "distinct_deps": "SELECT repo, name FROM v_declared UNION SELECT repo, name FROM o_parsed",
    "advisory_match": "SELECT * FROM o_dep_cves",
    "advisory_match_many": "SELECT * FROM o_many_cves",
    "eol_match": "SELECT * FROM o_dep_eol",
    "version_parse": f"""SELECT repo, name, version, array_to_string({VERSION.format('version')}, ' | ') AS parts
        FROM v_declared""",
    "dep_risk_top20": """SELECT f.repo, row_number() OVER (PARTITION BY f.repo ORDER BY d.priority, d.path, d.pos, package) AS rank,
        package, f.version, severity, cve, left(title, 50) AS issue FROM o_dep_found f JOIN o_deps d ON f.repo = d.repo
        AND f.package = d.name QUALIFY rank <= 20""",
    "dependency_report": f"SELECT {DEP_COLS} FROM o_pdep_found",
    "severity_summary": """SELECT r.repo, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH')
        AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low,
        count(severity) AS total_secrets FROM v_repos r LEFT JOIN o_findings f ON r.repo = f.repo GROUP BY 1""",
    "severity_distribution": """SELECT ord, label, (SELECT count(*) FROM o_findings WHERE severity = upper(label)) AS findings
        FROM (VALUES (0, 'Critical'), (1, 'High'), (2, 'Medium'), (3, 'Low')) AS t(ord, label)""",
    "risk_level": "SELECT repo, risk_level FROM o_scan_report",
    "security_score": f"""SELECT text_id, security_score, {BAND.format('security_score')} AS score_risk_level FROM (
        SELECT t.text_id, greatest(0, 100 - coalesce(sum(CASE WHEN severity IS NULL THEN 0 ELSE {SEV_POINTS} END), 0))::BIGINT
        AS security_score FROM v_texts t LEFT JOIN o_paste p ON t.text_id = p.text_id GROUP BY 1)""",
    "legacy_score": f"""SELECT t.text_id, least(100, sum(CASE WHEN severity IS NULL THEN 0 ELSE {OLD_POINTS} END))::BIGINT AS score,
        CASE WHEN count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) >= 3 THEN 'CRITICAL'
        WHEN count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) >= 1 THEN 'HIGH' WHEN count(severity) > 0 THEN 'MEDIUM'
        ELSE 'LOW' END AS risk FROM v_texts t LEFT JOIN o_paste p ON t.text_id = p.text_id GROUP BY 1""",
    "status_label": """SELECT t.text_id, CASE WHEN count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) > 0 THEN 'Vulnerable'
        WHEN count(*) FILTER (severity = 'MEDIUM') > 0 THEN 'Caution' ELSE 'Secure' END AS status
        FROM v_texts t LEFT JOIN o_paste p ON t.text_id = p.text_id GROUP BY 1""",
    "finding_summary_text": """SELECT a.text_id, 'Found ' || total || ' security issue' || CASE WHEN total > 1 THEN 's' ELSE '' END
        || ': ' || parts || '. Review each finding below and apply the suggested fixes.' AS explanation, fixes FROM (
        SELECT text_id, sum(n) AS total, string_agg(n || ' ' || lower(severity) || '-severity issue' || CASE WHEN n > 1 THEN 's'
        ELSE '' END, ', ' ORDER BY first_at) AS parts FROM (SELECT text_id, severity, count(*) AS n,
        min(rule_ord * 100000 + match_pos) AS first_at FROM o_paste GROUP BY 1, 2) GROUP BY 1) a JOIN (SELECT text_id,
        string_agg(fix, ' | ' ORDER BY rule_ord, match_pos) AS fixes FROM (SELECT * FROM o_paste QUALIFY row_number() OVER (
        PARTITION BY text_id ORDER BY rule_ord, match_pos) <= 3) GROUP BY 1) b ON a.text_id = b.text_id""",
    "repo_health": f"""SELECT r.repo, greatest(0, 100 - coalesce(points, 0))::BIGINT AS security_score,
        {BAND.format('(100 - coalesce(points, 0))')} AS risk_level, coalesce(c, 0) AS critical_count, coalesce(h, 0) AS high_count,
        coalesce(m, 0) AS medium_count, coalesce(l, 0) AS low_count, coalesce(secret, 0)::BIGINT AS secret_count,
        coalesce((SELECT count(DISTINCT name) FROM v_declared d WHERE d.repo = r.repo), 0) AS dependency_count,
        coalesce(dep, 0)::BIGINT AS outdated_packages FROM v_repos r LEFT JOIN (SELECT repo, sum({SEV_POINTS}) AS points,
        count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h,
        count(*) FILTER (severity = 'MEDIUM') AS m, count(*) FILTER (severity = 'LOW') AS l, sum(secret) AS secret,
        sum(dep) AS dep FROM (SELECT repo, severity, secret, 0 AS dep FROM o_is_secret UNION ALL
        SELECT repo, severity, 0, 1 FROM o_dep_found) GROUP BY 1) x ON r.repo = x.repo""",
    "owasp_coverage": "SELECT repo, owasp, findings, rank FROM o_owasp",
    "free_tier_topk": f"""SELECT repo, path, line, type, severity, match FROM (SELECT f.*, is_pro, row_number() OVER (
        PARTITION BY f.repo ORDER BY {SEV_RANK}, path, line, rule_ord, match_pos) AS rn FROM o_findings f JOIN v_repos r
        ON f.repo = r.repo) WHERE is_pro OR rn <= 5""",
    "sort_cards": """SELECT text_id, title, match, severity FROM o_paste ORDER BY text_id, CASE severity WHEN 'CRITICAL' THEN 1
        WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END, rule_ord, match_pos""",
    "union_findings": """SELECT repo, type, severity, NULL AS package, path, match FROM o_findings UNION ALL
        SELECT f.repo, type, severity, package, d.path, match FROM o_dep_found f JOIN o_deps d ON f.repo = d.repo
        AND f.package = d.name""",
    "report_sections": """SELECT repo, type, severity, category, match, severity IN ('CRITICAL', 'HIGH') AS in_serious,
        category = 'Secrets Exposure' AS in_secrets, category = 'Dependency Vulnerability' AS in_dependencies
        FROM (SELECT repo, type, severity, category, match FROM o_findings UNION ALL
        SELECT repo, type, severity, category, match FROM o_dep_found)""",
    "compliance_map": "SELECT text_id, title, match, owasp, nist FROM o_compliance",
    "auto_fix": "SELECT text_id, " + ", ".join(f"{_fix_case(f)} AS {f}" for f in (
        "before", "after", "explanation", "confidence")) + " FROM v_snippets",
    "redact_entropy": "SELECT text_id, left(text, 6) || '···' || right(text, 4) AS redacted FROM v_snippets",
    "shannon_entropy": """SELECT t.text_id, coalesce(round(-sum(n / len * log2(n / len)), 6), 0) AS bits FROM v_texts t LEFT JOIN (
        SELECT text_id, c, count(*) AS n, any_value(len) AS len FROM (SELECT text_id, length(text) AS len,
        unnest(string_split(text, '')) AS c FROM v_texts) GROUP BY 1, 2) x ON t.text_id = x.text_id GROUP BY 1""",
    "file_ext": "SELECT repo, path, ext FROM o_ext",
    "cvss_severity": """SELECT id, severity, CASE WHEN severity IN ('CRITICAL', 'HIGH', 'MEDIUM') THEN lower(severity) ELSE 'low' END
        AS badge FROM o_cve""",
    "key_hash": "SELECT text_id, sha256(text) AS key_hash FROM v_snippets",
    "html_escape": """SELECT text_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
        '"', '&quot;'), chr(39), '&#x27;')) AS escaped_md5, length(replace(replace(replace(replace(text, '&', '&amp;'), '<',
        '&lt;'), '>', '&gt;'), '"', '&quot;')) AS chars_without_quote FROM v_texts""",
    "cve_flatten": CVE_FLAT,
    "epss_enrich": f"SELECT c.id, severity, {EPSS} FROM o_cve c LEFT JOIN v_epss e ON c.id = e.cve",
    "cve_keyword_search": """SELECT id, published, severity FROM o_cve WHERE description ILIKE '%sql injection%'
        ORDER BY published DESC, id LIMIT 5""",
    "cve_search_v1": """SELECT id, left(description, 300) AS description, v31 AS cvss FROM o_cve WHERE description ILIKE '%sql injection%'
        ORDER BY published DESC, id LIMIT 3""",
    "cve_search_many": """SELECT query, rank, id, left(description, 300) AS description, v31 AS cvss FROM (
        SELECT query, c.*, row_number() OVER (PARTITION BY query ORDER BY published DESC, id) AS rank FROM (
        SELECT DISTINCT unnest([p_name, ' ' || upper(p_brand), split_part(p_brand, '#', 2), left(p_name, 2), p_name || ' ' || p_brand]) AS query
        FROM part) q JOIN o_cve c ON contains(lower(c.description), lower(trim(query))) WHERE length(trim(query)) >= 2) WHERE rank <= 3""",
    "cve_report": f"SELECT c.*, {EPSS} FROM ({CVE_FLAT}) c LEFT JOIN v_epss e ON c.id = e.cve",
    "llm_reply_parse": f"""SELECT reply_id, CASE WHEN has THEN array_to_string({{dash}}(a), chr(10)) ELSE trim(content, {WS}) END
        AS explanation, CASE WHEN has THEN array_to_string({{dash}}(b), ' | ') ELSE '' END AS fixes FROM (SELECT *,
        contains(content, 'FIXES:') AS has, split_part(content, 'FIXES:', 1) AS a,
        substr(content, strpos(content, 'FIXES:') + 6) AS b FROM v_replies)""",
    "recommendations": "SELECT repo, concat_ws(' | ', " + ", ".join(
        f"CASE WHEN {cond} THEN {q(text)} END" for cond, text in (
            ("critical > 0", "Rotate all exposed credentials immediately — treat CRITICAL findings as already compromised."),
            ("EXISTS (SELECT 1 FROM o_findings f WHERE f.repo = o_scan_report.repo AND f.category = 'Secrets Exposure')", "Move all secrets to environment variables or a secrets manager (e.g. HashiCorp Vault, AWS "
                                 "Secrets Manager, or your platform's secret store)."),
            ("outdated_packages > 0", "Update vulnerable dependencies to the versions specified in this report, prioritising "
                                      "CRITICAL and HIGH severity packages."),
            ("high > 0", "Review and remediate HIGH severity findings — these represent significant exploitable risk."),
            ("true", "Add automated security checks to your CI/CD pipeline to catch new issues before merge."),
            ("true", "Re-run this scan after remediation to confirm your security score has improved."))
    ) + ") AS recommendations FROM o_scan_report",
    "exec_summary": """SELECT repo, CASE WHEN total_secrets = 0 THEN 'No security findings were detected in this scan. The codebase '
        || 'appears to follow secure coding practices for the patterns checked.' ELSE 'This assessment identified '
        || total_secrets || ' finding(s) across the scanned ' || CASE WHEN source LIKE 'http%' THEN 'repository'
        ELSE 'submission' END || ', resulting in an overall security score of ' || security_score || '/100 (' || score_risk_level
        || '). ' || CASE WHEN critical > 0 THEN critical || ' CRITICAL finding(s) require immediate attention as they represent '
        || 'direct exposure of credentials or code-execution risks. ' ELSE '' END END AS exec_summary FROM o_scan_report""",
    "scan_report": "SELECT * EXCLUDE (source) FROM o_scan_report",
    "analyze_report": f"""SELECT text_id, findings, score, risk, security_score, {BAND.format('security_score')} AS score_risk_level
        FROM (SELECT t.text_id, count(severity) AS findings, least(100, sum(CASE WHEN severity IS NULL THEN 0
        ELSE {OLD_POINTS} END))::BIGINT AS score, CASE WHEN count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) >= 3 THEN 'CRITICAL'
        WHEN count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) >= 1 THEN 'HIGH' WHEN count(severity) > 0 THEN 'MEDIUM'
        ELSE 'LOW' END AS risk, greatest(0, 100 - sum(CASE WHEN severity IS NULL THEN 0 ELSE {SEV_POINTS} END))::BIGINT
        AS security_score FROM v_texts t LEFT JOIN o_paste p ON t.text_id = p.text_id GROUP BY 1)""",
    "executive_report": f"""
        SELECT s.repo, 'summary' AS section, exec_summary AS title, recommendations AS detail, risk_level AS level, security_score AS number
        FROM ({{exec_summary}}) e JOIN ({{recommendations}}) r ON e.repo = r.repo JOIN ({{scan_report}}) s ON s.repo = e.repo UNION ALL
        SELECT repo, 'serious', type, path, severity, line FROM o_findings WHERE severity IN ('CRITICAL', 'HIGH') UNION ALL
        SELECT repo, 'secrets', type, path, severity, line FROM o_findings WHERE category = 'Secrets Exposure' UNION ALL
        SELECT repo, 'dependencies', package, cve, severity, rank FROM (SELECT f.repo, package, coalesce(cve, 'N/A') AS cve, severity,
        row_number() OVER (PARTITION BY f.repo ORDER BY d.priority, d.path, d.pos, package) AS rank FROM o_pdep_found f
        JOIN o_parsed_deps d ON f.repo = d.repo AND f.package = d.name QUALIFY rank <= 20) UNION ALL
        SELECT repo, 'owasp', owasp, '', '', findings FROM o_owasp UNION ALL
        SELECT repo, 'shown', type, path, severity, line FROM (SELECT f.*, is_pro, row_number() OVER (
        PARTITION BY f.repo ORDER BY {SEV_RANK}, path, line, rule_ord, match_pos) AS rn
        FROM o_findings f JOIN v_repos r ON f.repo = r.repo) WHERE is_pro OR rn <= 5""",
    "subscription_lookup": """SELECT seq, sub AS subscription_id, (SELECT min(id) FROM v_users u WHERE u.paypal_subscription_id = sub)
        AS user_id FROM o_pe WHERE NOT by_user AND sub IS NOT NULL""",
    "subscription_state": SUB_STATE.format("coalesce(events, 0) AS events, "),
    "revenue_monthly": """SELECT strftime(created_at, '%Y-%m') AS month, event_type, sum(paid)::DOUBLE AS revenue,
        count(*) AS payments FROM (SELECT *, try_cast(amount AS DECIMAL(10, 2)) AS paid FROM v_payments) WHERE paid IS NOT NULL
        GROUP BY 1, 2""",
    "rate_limit_batch": RATE,
    "rate_limit_hot_keys": RATE,
    "stream_rate_limit": RATE,
    "stream_usage_daily": """SELECT user_id, ts::DATE::STRING AS date, count(*) AS request_count FROM v_requests
        GROUP BY 1, 2""",
    "stream_injection_alerts": f"SELECT req_id, path, left(query, 80) AS query FROM v_requests WHERE {INJECTION}",
    "stream_audit_append": "SELECT id, user_id, action, least(500, length(metadata)) AS metadata_chars FROM v_audit",
    "stream_secret_scan": """SELECT m.repo, m.path, label, line, match_pos, CASE WHEN length(raw) <= 6 THEN '***' ELSE left(raw, 6)
        || repeat('*', least(8, length(raw) - 6)) || '  (redacted)' END AS match FROM o_firsts m SEMI JOIN v_files f
        ON m.repo = f.repo AND m.path = f.path""",
    "stream_subscription_state": SUB_STATE.format(""),
}
for _name, _table in (("src_requirements", "o_req"), ("src_package_json", "o_pkgjson"), ("src_package_lock", "o_lock"),
                      ("src_pipfile_lock", "o_piplock"), ("src_pipfile", "o_pipfile"), ("src_poetry_lock", "o_poetry")):
    RAW[_name] = f"SELECT repo, path, name, version FROM {_table}"
RAW["llm_reply_parse"] = re.sub(
    r"\{\{dash\}\}\((\w)\)|\{dash\}\((\w)\)", lambda m: (
        f"list_transform(list_filter(list_transform(string_split({m.group(1) or m.group(2)}, chr(10)), "
        f"lambda x: trim(x, {WS})), lambda x: x LIKE '-%' AND length(x) > 2), lambda x: trim(ltrim(x, '- '), {WS}))"),
    RAW["llm_reply_parse"])
for _name in ("exec_summary", "recommendations", "scan_report"):
    RAW["executive_report"] = RAW["executive_report"].replace(f"{{{_name}}}", RAW[_name])

_CHAIN = """WITH RECURSIVE o_chain0 AS (
    SELECT ip, bucket, min(t) AS s FROM {keyed} GROUP BY 1, 2 UNION ALL
    SELECT c.ip, c.bucket, (SELECT min(t) FROM {keyed} k WHERE k.ip = c.ip AND k.bucket = c.bucket AND k.t > c.s + 60000000) AS s
    FROM o_chain0 c WHERE s IS NOT NULL) SELECT ip, bucket, s FROM o_chain0 WHERE s IS NOT NULL"""
HELP["o_chain"] = _CHAIN.replace("{keyed}", "o_burst_keyed")

ORACLES: dict[str, str] = {name: duckdb_sql(sql, HELP) for name, sql in RAW.items()}
