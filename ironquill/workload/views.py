"""Domain tables derived from the star-schema tables, in SQL that Spark and other engines share.

The given tables hold few rule hits, so files, manifests, users, events and so
on are derived from them row by row: every view grows with its base table.
Key-shaped strings are put together from parts at run time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.bind import bind
from ..session import spread
from ..rules.advisories import ADVISORIES, EOL_PREFIXES

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations")
TODAY = "2024-01-31"

# h = 32 hex digits that depend on the row, q = double quote, nl = line feed
_LINES = (
    "'import os'",
    "concat('AWS_ACCESS_KEY_ID = ', q, 'AK', 'IA', upper(substr(h, 1, 16)), q)",
    "concat('password = ', q, substr(h, 1, 8), q)",
    "concat('JWT_SECRET = ', q, h, q)",
    "concat('JWT_SECRET = ', q, 'changeme-please-now', q)",
    "concat('url = ', q, 'https://api.example.com/v1?token=', substr(h, 1, 12), q)",
    "concat('DATABASE_URL=postgres://admin:', substr(h, 1, 6), '@db.internal/app')",
    "'# TODO rotate the password before release'",
    "'digest = hashlib.md5(data)'",
    "concat('-----BEGIN ', 'OPENSSH PRIVATE KEY-----')",
    "concat('-----BEGIN ', 'RSA PRIVATE KEY-----')",
    "concat('api_key: ', q, h, q)",
    "concat('token = ', q, 'gh', 'p_', h, substr(h, 1, 4), q, ' # ', 'gh', 'p_', h, substr(h, 1, 4))",
    "concat('export HF_API_KEY=h', 'f_', h, substr(h, 1, 2))",
    "concat('Authorization: ', q, 'Bearer ', h, q)",
    "concat('key = ', q, 's', 'k-', h, q)",
    "concat('print(', q, 'hello world', q, ')')",
    "'x = eval(user_input)'",
    "concat('sk_', 'live_', h)",
    "concat('pwd: ', q, substr(h, 1, 5), q)",
    "concat('var j = ', q, 'ey', 'J', h, '.', h, '.', h, q)",
    "concat(repeat('x', 1985), ' AK', 'IA', upper(substr(h, 1, 16)))",
    "concat('supabase_service_role = ', q, 'ey', 'J', h, q)",
    "'requests.get(url, verify=False)'",
    "concat('twilio_auth_token = ', q, h, q)",
    "concat('secret: wh', 'sec_', h)",
    "concat('aws_secret_access_key = ', q, h, substr(h, 1, 8), q)",
    "concat('SECRET_KEY: ', q, substr(h, 1, 14), q)",
    "''",
    "concat('mysql://root:', substr(h, 1, 7), '@10.0.0.5/db?api_key=', substr(h, 3, 9))",
    "concat('PAYPAL_CLIENT_SECRET = ', q, h, q)",
)

_SNIPPETS = (
    "'value = eval(expression)'",
    "concat('cur.execute(f', q, 'SELECT * FROM t WHERE id = {{uid}}', q, ')')",
    "'data = pickle.loads(blob)'",
    "'def add(a, b): return a + b'",
    "'requests.get(url, verify=False)'",
    "concat('token = ', q, upper(substr(h, 1, 16)), substr(h, 5, 16), 'XyZwQrStUv', q)",
    "'subprocess.call(cmd, shell=True)'",
    "'el.innerHTML = payload'",
    "concat('key = ', q, h, h, q)",
    "'nonce = random.random()'",
    "'os.system(command)'",
    "'yaml.load(stream)'",
    "concat('open(', q, '../etc/config', q, ')')",
    "concat('password = ', q, 'hunter', substr(h, 1, 4), q)",
    "'hash = md5(value)'",
    "'curl http://internal.example/x'",
    "'return total'",
    "'const id = Math.random()'",
    "concat('k1=', q, 'GhIjKlMnOpQrStUvWxYz', upper(substr(h, 1, 12)), substr(h, 1, 12), q, ' k2=', q, "
    "'GhIjKlMnOpQrStUvWxYz', upper(substr(h, 1, 12)), substr(h, 1, 12), q)",
)


def _pick(index: str, options) -> str:
    cases = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    text = f"CASE {index} {cases} END"
    return re.sub(r"\bq\b", "chr(34)", re.sub(r"\bnl\b", "chr(10)", text))


PACKAGES = tuple(dict.fromkeys([a.name for a in ADVISORIES])) + tuple(
    n for n, _ in EOL_PREFIXES if n not in {a.name for a in ADVISORIES}) + ("left-pad", "Some_Pkg")


def _names(index: str) -> str:
    return _pick(f"({index}) % {len(PACKAGES)}", [f"'{p}'" for p in PACKAGES])


VIEWS: dict[str, str] = {
    "v_lines_src": """
        SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, o_totalprice AS price,
               md5(concat('k', cast(o_orderkey AS string))) AS h FROM {orders}""",
    "v_files": f"""
        SELECT concat('repo-', cast(c % 50 AS string)) AS repo,
               concat(CASE k % 11 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/' WHEN 2 THEN 'src/app/'
                      WHEN 3 THEN 'dist/' ELSE '' END, 'f', cast(k AS string),
                      CASE k % 13 WHEN 0 THEN '/.env' WHEN 1 THEN '/.env.local' WHEN 2 THEN '/.env.json'
                      WHEN 3 THEN '/Dockerfile' WHEN 4 THEN '.lock' WHEN 5 THEN '/.env.example'
                      WHEN 6 THEN '.JS' WHEN 7 THEN '.yml' ELSE '.py' END) AS path,
               k % 97 = 0 AS is_link, cast(200 + k % 700 + CASE WHEN k % 89 = 0 THEN 600000 ELSE 0 END AS bigint) AS size,
               concat(replace(JOIN_LIST(MAP_LIST(LIST(k % 31, (k * 7 + 3) % 31, (k + c) % 31,
                                              CASE WHEN k % 4 = 0 THEN k % 31 ELSE 28 END),
                                         LAMBDA_I {_pick('i', _LINES)}), chr(10)), chr(10),
                                CASE k % 5 WHEN 0 THEN chr(13) WHEN 1 THEN concat(chr(13), chr(10)) ELSE chr(10) END),
                      CASE WHEN k % 7 = 0 THEN chr(10) ELSE '' END) AS content
        FROM v_lines_src""",
    "v_repos": """
        SELECT DISTINCT concat('repo-', cast(o_custkey % 50 AS string)) AS repo, o_custkey % 50 % 3 <> 0 AS is_pro,
               concat(CASE WHEN o_custkey % 50 % 4 = 0 THEN 'zip_upload/' ELSE 'https://github.com/acme/' END,
                      'repo-', cast(o_custkey % 50 AS string)) AS source FROM {orders}""",
    "v_snippets": f"""
        SELECT concat('o', cast(k AS string)) AS text_id, JOIN_LIST(MAP_LIST(
                 LIST(k % 19, (k * 5 + 2) % 19, CASE WHEN k % 3 = 0 THEN (k + c) % 19 ELSE 3 END),
                 LAMBDA_I {_pick('i', _SNIPPETS)}), chr(10)) AS text
        FROM v_lines_src""",
    "v_texts": """
        SELECT concat('d', cast(doc_id AS string)) AS text_id, text FROM {documents}
        UNION ALL SELECT concat('p', cast(page_id AS string)), html FROM {pages}
        UNION ALL SELECT text_id, text FROM v_snippets""",
    "v_part": f"""
        SELECT p_partkey AS k, p_size AS z, concat(cast(p_size % 5 AS string), '.', cast(p_partkey % 30 AS string), '.',
               cast(p_partkey % 10 AS string)) AS ver,
               {_names('p_partkey')} AS n1, {_names('p_partkey * 3 + 1')} AS n2, {_names('p_partkey * 7 + 2')} AS n3
        FROM {{part}}""",
    "v_manifests": """
        SELECT concat('repo-', cast(k % 50 AS string)) AS repo, concat(CASE WHEN k % 17 = 0 THEN 'node_modules/'
                 WHEN k % 5 = 0 THEN 'apps/' ELSE '' END, concat('svc', cast(k AS string), '/'), manifest) AS path,
               manifest, k % 101 = 0 AS is_link, cast(100 + k % 50 AS bigint) AS size, content
        FROM (SELECT k, CASE k % 6 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'package.json'
                 WHEN 2 THEN 'package-lock.json' WHEN 3 THEN 'Pipfile.lock' WHEN 4 THEN 'Pipfile'
                 ELSE 'poetry.lock' END AS manifest,
               CASE k % 6
               WHEN 0 THEN concat('# pinned', chr(10), n1, '==', ver, chr(10), '-r other.txt', chr(10), ' ', n2, ' >= ',
                    ver, ' ', chr(13), chr(10), n3, chr(10), n1, CASE WHEN k % 4 = 0 THEN '~=9.9.9' ELSE '[extra]==1' END,
                    chr(10), '!bad')
               WHEN 1 THEN CASE WHEN k % 43 = 0 THEN '{{ broken'
                    ELSE concat('{{"name": "x", "dependencies": {{"', n1, '": "^', ver, '", "', n2,
                    '": "latest"}}, "devDependencies": {{"', n3, '": "~', ver, '"}}}}') END
               WHEN 2 THEN CASE WHEN k % 12 = 2 THEN concat('{{"lockfileVersion": 1, "dependencies": {{"', n1,
                    '": {{"version": "', ver, '", "dependencies": {{"', n2, '": {{"version": "1.', ver, '"}}}}}}, "', n3,
                    '": {{"version": "', ver, '"}}}}}}')
                    ELSE concat('{{"lockfileVersion": 3, "packages": {{"": {{"version": "9.9.9"}}, "node_modules/', n1,
                    '": {{"version": "', ver, '"}}, "node_modules/', n1, '/node_modules/', n2,
                    '": {{"version": "3.', ver, '"}}}}}}') END
               WHEN 3 THEN concat('{{"_meta": {{}}, "default": {{"', n1, '": {{"version": "==', ver, '"}}}}, "develop": {{"',
                    n2, '": {{"version": "==1.', ver, '"}}, "', n3, '": {{"index": "pypi"}}}}}}')
               WHEN 4 THEN concat('[[source]]', chr(10), 'name = "pypi"', chr(10), '[packages]', chr(10), n1, ' = "==', ver,
                    '"', chr(10), n2, ' = "*"', chr(10), '[dev-packages]', chr(10), n3, ' = "~=', ver, '"', chr(10))
               ELSE concat('[[package]]', chr(10), 'name = "', n1, '"', chr(10), 'version = "', ver, '"', chr(10),
                    '[[package]]', chr(10), 'name = "', n2, '"', chr(10), 'version = "2.', ver, '"', chr(10))
               END AS content FROM v_part) AS s""",
    "v_tree": """
        SELECT repo, path, is_link, size, content FROM v_files
        UNION ALL SELECT repo, path, is_link, size, content FROM v_manifests""",
    "v_declared": """
        SELECT concat('repo-', cast(k % 100 AS string)) AS repo, concat('m', cast(k % 7 AS string), '/', manifest) AS path,
               manifest, cast(k AS int) AS pos, name, version
        FROM (SELECT k, CASE k % 4 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'package-lock.json'
                WHEN 2 THEN 'Pipfile' ELSE 'package.json' END AS manifest, n1 AS name,
                CASE WHEN k % 19 = 0 THEN '' WHEN k % 23 = 0 THEN 'latest' ELSE ver END AS version FROM v_part) AS s""",
    "v_advisories": """
        SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'lodash' WHEN o_orderkey % 3 = 1 THEN n1 ELSE concat('pkg-', cast(o_custkey AS string)) END AS name,
               o_orderkey AS ord, concat(cast(o_orderkey % 6 AS string), '.', cast((o_custkey + ver_step) % 40 AS string), '.',
               cast(o_orderkey % 31 AS string)) AS max_version, CASE o_custkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'CRITICAL' END
               AS severity, concat('CVE-30', cast(o_custkey % 90 AS string), '-', cast(o_orderkey AS string)) AS cve, 'Known flaw.' AS detail
        FROM (SELECT *, o_orderkey % 17 AS ver_step FROM {orders}) o JOIN v_part ON k = o_custkey""",
    "v_members": """
        SELECT concat('zip-', cast(l_orderkey % 40 AS string)) AS archive,
               concat(CASE WHEN l_orderkey % 40 = 7 AND l_linenumber = 3 THEN '../../' WHEN l_orderkey % 40 = 9 THEN 'a/../b/'
                 WHEN l_orderkey % 40 = 11 AND l_linenumber = 1 THEN '/abs/' ELSE 'src/' END, 'f',
                 cast(l_partkey AS string), '-', cast(l_linenumber AS string)) AS member,
               cast(l_quantity * (l_orderkey % 40) * 60 AS bigint) AS size FROM {lineitem}""",
    "v_requests": """
        SELECT event_id AS req_id, ts, concat('u', cast(user_id AS string)) AS user_id,
               CASE event_id % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'PUT' ELSE 'GET' END AS method,
               CASE event_type WHEN 'signup' THEN '/auth/register' WHEN 'purchase' THEN '/payment/create'
                    WHEN 'error' THEN '/api/analyze' WHEN 'click' THEN '/api/scan-repo' ELSE '/' END AS path,
               CASE event_id % 23 WHEN 0 THEN 'q=<script>alert(1)' WHEN 1 THEN 'id=1; DROP TABLE users'
                    WHEN 2 THEN 'a=1 UNION ALL SELECT 1' WHEN 3 THEN concat('n=x', chr(39), ' or 1=1')
                    WHEN 4 THEN 'u=JavaScript :x' WHEN 5 THEN concat('onload = ', chr(34), 'x') WHEN 6 THEN ''
                    ELSE concat('q=', props) END AS query,
               CASE event_id % 7 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/plain'
                    ELSE 'application/json' END AS content_type,
               CASE WHEN event_id % 5 = 0 THEN concat('10.1.0.', cast(user_id % 9 AS string)) ELSE '' END AS cf_ip,
               CASE WHEN event_id % 5 = 1 THEN concat(' 10.2.0.', cast(user_id % 9 AS string), ' , 9.9.9.9') ELSE '' END
                    AS real_ip,
               CASE WHEN event_id % 5 = 2 THEN concat('10.3.0.', cast(user_id % 9 AS string), ',8.8.8.8') ELSE NULL END
                    AS fwd_for,
               CASE WHEN event_id % 5 = 3 THEN NULL ELSE concat('10.0.0.', cast(user_id % 9 AS string)) END AS peer
        FROM {events}""",
    # The month of events in a few hours, so that windows fill up.
    "v_burst": """
        SELECT req_id, FROM_US(cast(floor((TO_US(ts) - 1704067200000000) / 300) AS bigint) + 1704067200000000) AS ts,
               user_id, method, path, query, content_type, cf_ip, real_ip, fwd_for, peer FROM v_requests""",
    "v_users": """
        SELECT concat('u', cast(c_custkey AS string)) AS id, concat(lower(c_name), '@example.com') AS email,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'free' WHEN 'MACHINERY' THEN 'pro_trial' WHEN 'AUTOMOBILE' THEN 'Pro'
                    WHEN 'HOUSEHOLD' THEN 'enterprise' ELSE NULL END AS plan,
               c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD') AS is_pro,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 7 <> 0 END AS trial_active,
               CASE WHEN c_custkey % 3 = 0 THEN cast(DATE '2024-01-01' - cast(c_custkey % 60 AS int) AS date) END
                    AS trial_start_date,
               CASE WHEN c_custkey % 3 = 0 THEN cast(DATE '2024-02-20' - cast(c_custkey % 60 AS int) AS date) END
                    AS trial_end_date,
               CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'org-gone' ELSE concat('org', cast(c_nationkey AS string)) END AS org_id,
               'member' AS role,
               CASE WHEN c_custkey % 5 = 0 THEN concat('S', cast(c_custkey AS string))
                    WHEN c_custkey % 5 = 1 THEN '' END AS paypal_subscription_id,
               CASE WHEN c_custkey % 10 = 0 THEN 'ACTIVE' WHEN c_custkey % 10 = 5 THEN 'INACTIVE' END
                    AS subscription_status,
               'monthly' AS subscription_billing,
               cast(DATE '2024-01-01' - cast(c_custkey % 60 AS int) AS date) AS created_at
        FROM {customer}""",
    "v_orgs": "SELECT concat('org', cast(n_nationkey AS string)) AS id, n_name AS name FROM {nation}",
    "v_usage": """
        SELECT concat('u', cast(user_id AS string)) AS user_id, cast(ts AS date) AS date, count(*) AS request_count
        FROM {events} GROUP BY 1, 2""",
    "v_scans": """
        SELECT concat('s', cast(event_id AS string)) AS id, concat('u', cast(user_id AS string)) AS user_id,
               concat('repo-', cast(event_id % 50 AS string)) AS source,
               CASE event_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'NONE' END AS risk_level,
               cast(event_id % 17 AS int) AS total_secrets,
               CASE event_id % 5 WHEN 0 THEN concat('{{"security_score": ', cast(event_id % 101 AS string), '}}')
                    WHEN 1 THEN concat('{{"score": ', cast(event_id % 97 AS string), '}}')
                    WHEN 2 THEN concat('{{"security_score": null, "score": ', cast(event_id % 89 AS string), '}}')
                    WHEN 3 THEN '{{"other": 1}}'
                    ELSE concat('{{"score": 3, "security_score": ', cast(event_id % 83 AS string), '}}') END AS result_json,
               ts AS created_at
        FROM {events}""",
    "v_audit": """
        SELECT concat('a', cast(event_id AS string)) AS id, concat('u', cast(user_id AS string)) AS user_id,
               concat('org', cast(user_id % 25 AS string)) AS org_id,
               CASE event_type WHEN 'error' THEN 'scan' WHEN 'signup' THEN 'login' WHEN 'purchase' THEN 'Subscription_Cancel'
                    ELSE 'admin_export' END AS action,
               '/api/analyze' AS resource, concat('10.0.0.', cast(user_id AS string)) AS ip_address,
               concat(props, repeat('x', 600)) AS metadata, ts AS created_at FROM {events}""",
    "v_tasks": """
        SELECT concat('t', cast(l_orderkey AS string)) AS id,
               CASE l_linenumber WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'CLONING' WHEN 3 THEN 'VALIDATING' WHEN 4 THEN 'SCANNING'
                    WHEN 5 THEN 'SCANNING' WHEN 6 THEN 'DONE' ELSE 'FAILED' END AS state,
               cast(l_linenumber * 15 AS int) AS progress,
               CASE WHEN l_linenumber >= 6 THEN '{{}}' END AS result_json,
               l_linenumber * 1000000 + l_partkey * 10 + cast(l_quantity AS int) % 10 AS updated_at
        FROM {lineitem}""",
    "v_payment_events": """
        SELECT o_orderkey AS seq, o_orderdate AS ts,
               CASE o_orderkey % 9 WHEN 0 THEN 'BILLING.SUBSCRIPTION.ACTIVATED' WHEN 1 THEN 'BILLING.SUBSCRIPTION.RENEWED'
                    WHEN 2 THEN 'PAYMENT.SALE.COMPLETED' WHEN 3 THEN 'BILLING.SUBSCRIPTION.PAYMENT.FAILED'
                    WHEN 4 THEN 'BILLING.SUBSCRIPTION.CANCELLED' WHEN 5 THEN 'PAYMENT.CAPTURE.COMPLETED'
                    WHEN 6 THEN 'BILLING.SUBSCRIPTION.SUSPENDED' WHEN 7 THEN
                         CASE WHEN o_orderkey % 2 = 0 THEN 'USER_CANCELLED' ELSE 'ORDER_CAPTURED' END
                    ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'MANUAL' ELSE 'SUBSCRIPTION_ACTIVATED' END END AS event_type,
               CASE WHEN o_orderkey % 9 IN (0, 3, 4, 6) THEN
                         CASE WHEN o_orderkey % 2 = 0 THEN concat('S', cast(o_custkey % 40 AS string))
                              ELSE concat('S', cast(o_custkey AS string)) END
                    WHEN o_orderkey % 9 = 1 THEN concat('S', cast(o_custkey AS string))
                    WHEN o_orderkey % 9 = 5 OR o_orderkey % 18 = 7 THEN concat('ORD', cast(o_orderkey AS string))
                    WHEN o_orderkey % 9 = 7 OR o_orderkey % 18 = 17 THEN concat('S', cast(o_custkey % 40 AS string)) ELSE '' END AS res_id,
               CASE WHEN o_orderkey % 9 IN (0, 5, 7, 8) AND o_orderkey % 4 <> 3 THEN concat('u', cast(o_custkey % 60 AS string))
                    ELSE '' END AS custom_id,
               CASE WHEN o_orderkey % 9 = 2 THEN concat('S', cast(o_custkey % 40 AS string)) ELSE NULL END AS agreement_id,
               CASE WHEN o_orderkey % 9 = 5 THEN concat('u', cast(o_custkey AS string)) END AS invoice_id,
               CASE WHEN o_orderkey % 9 = 0 THEN concat('u', cast(o_custkey % 200 AS string)) END AS sub_email,
               CASE WHEN o_orderkey % 5 = 0 THEN cast(o_custkey AS string) ELSE '' END AS total,
               CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat(cast(o_custkey % 90 AS string), '.50') END AS val,
               CASE WHEN o_orderkey % 18 = 17 THEN CASE o_orderkey % 3 WHEN 0 THEN 'annual' ELSE CASE WHEN o_orderkey % 5 < 2 THEN 'annual'
                    WHEN o_orderkey % 5 = 2 THEN '' ELSE 'monthly' END END END AS billing
        FROM {orders}""",
    "v_payments": """
        SELECT concat('u', cast(o_custkey AS string)) AS user_id,
               CASE o_orderkey % 3 WHEN 0 THEN 'PAYMENT.SALE.COMPLETED' WHEN 1 THEN 'SUBSCRIPTION_ACTIVATED'
                    ELSE 'ORDER_CAPTURED' END AS event_type,
               CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN NULL
                    ELSE concat(cast(o_custkey % 90 AS string), '.', cast(10 + o_orderkey % 90 AS string)) END AS amount,
               o_orderdate AS created_at FROM {orders}""",
    "v_cve_flat": """
        SELECT p_partkey AS k, concat('CVE-20', cast(10 + p_partkey % 15 AS string), '-', cast(1000 + p_partkey AS string)) AS id,
               CASE WHEN p_partkey % 6 < 3 THEN cast(p_size AS double) / 5 END AS v31,
               CASE WHEN p_partkey % 6 IN (2, 3) THEN cast(p_size AS double) / 10 END AS v30,
               CASE WHEN p_partkey % 6 = 4 THEN cast(p_size AS double) / 20 END AS v2,
               concat(p_name, ' ', p_brand, repeat(' pad', CASE WHEN p_partkey % 2 = 1 THEN p_size * 4 ELSE 0 END), CASE p_partkey % 7 WHEN 0 THEN ' allows insecure use of eval'
                      WHEN 1 THEN ' hash: high entropy string, possible secret detected' WHEN 2 THEN ' SQL injection in search'
                      WHEN 3 THEN ' Detected verify=False flaw' ELSE ' overflow' END, repeat(' pad', CASE WHEN p_partkey % 2 = 0 THEN p_size * 4 ELSE 0 END)) AS description,
               concat('20', cast(10 + p_partkey % 15 AS string), '-0', cast(1 + p_partkey % 9 AS string), '-11T00:00:00.000')
                      AS published,
               p_partkey % 8 AS cpes FROM {part}""",
    "v_epss": """
        SELECT id AS cve, CASE WHEN k % 10 = 0 THEN 'n/a' ELSE cast(cast(k % 977 AS double) / 1000 AS string) END AS epss
        FROM v_cve_flat""",
    "v_replies": """
        SELECT concat('c', cast(conv_id AS string), '-', cast(turn AS string)) AS reply_id,
               CASE turn % 3 WHEN 0 THEN concat('SECURITY_ISSUES:', chr(10), '- ', substr(text, 1, 40), chr(10), ' -- two',
                      chr(10), '-', chr(10), 'plain', chr(10), chr(10), 'FIXES:', chr(10), '- fix ', role, chr(10),
                      '-use FIXES: twice', chr(10), text)
                    WHEN 1 THEN concat('  ', text, chr(10)) ELSE concat('- only', chr(10), text) END AS content
        FROM {conversations}""",
    "v_registrations": """
        SELECT c_custkey AS reg_id, CASE c_custkey % 9 WHEN 0 THEN 'not-an-email' WHEN 1 THEN concat(' ', c_name, '@Example.COM ')
                 WHEN 2 THEN concat('a', chr(39), 'b@example.com') WHEN 3 THEN 'x@nodot'
                 WHEN 4 THEN concat(repeat('a', 250), '@e.com') WHEN 5 THEN 'a--b@e.com' ELSE concat(lower(c_name), '@e.com') END
                 AS email,
               repeat('p', cast(c_custkey % 140 AS int)) AS password,
               CASE c_custkey % 6 WHEN 0 THEN '   ' WHEN 1 THEN repeat('o', 101) WHEN 2 THEN concat('A&B <', chr(34), c_name, '>')
                 ELSE concat(' ', c_mktsegment, ' ') END AS org_name
        FROM {customer}""",
    "v_urls": """
        SELECT c_custkey AS url_id, CASE c_custkey % 8 WHEN 0 THEN 'https://github.com/acme' WHEN 1 THEN 'http://github.com/a/b'
                 WHEN 2 THEN concat('https://github.com/acme/r', cast(c_custkey AS string)) WHEN 3 THEN 'https://gitlab.com/a/b'
                 WHEN 4 THEN ' https://github.com/a//b/ ' WHEN 5 THEN 'https://github.com.evil.io/a/b'
                 WHEN 6 THEN 'ssh://git@github.com/a/b' ELSE concat('https://github.com/', c_name, '/x?tab=1#top') END AS url
        FROM {customer}""",
}

_TOKENS = {"spark": {"TO_US(ts)": "unix_micros(cast(ts AS timestamp))", "FROM_US(": "timestamp_micros(",
                     "MAP_LIST(": "transform(", "JOIN_LIST(": "array_join(", "LAMBDA_I": "i ->", "LIST(": "array("},
           "duckdb": {"TO_US(ts)": "epoch_us(ts)", "FROM_US(": "make_timestamp(",
                      "MAP_LIST(": "list_transform(", "JOIN_LIST(": "array_to_string(", "LAMBDA_I": "lambda i:",
                      "LIST(": "list_value("}}


def with_views(sql: str, dialect: str, extra: dict[str, str] | None = None) -> str:
    """Put the views that ``sql`` needs in front of it, in order of need."""
    known = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b[vo]_\w+\b", text)):
            if name in known and name not in ordered:
                visit(known[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if ordered:
        sql = "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in ordered) + "\n" + sql
    for token, text in _TOKENS[dialect].items():
        sql = sql.replace(token, text)
    return sql


def view(spark: SparkSession, folder: str, name: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """A derived view over the parquet tables in ``folder``, or some of its columns: then no other is read or built."""
    sql = with_views(f"SELECT * FROM {name}", "spark")
    used = [b for b in BASE if "{" + b + "}" in sql]
    wide = name in ("v_tree", "v_files", "v_texts", "v_snippets", "v_cve_flat")
    tables = {b: spark.read.parquet(f"{folder}/{b}.parquet") for b in used}
    df = spark.sql(sql, **{b: spread(t) if wide else t for b, t in tables.items()})
    return settled(df.select(*only) if only else df)


BOUND = ("content", "text", "description", "event_type", "res_id", "custom_id", "path", "query", "plan")


def settled(df: DataFrame) -> DataFrame:
    """Long derived texts count as stored columns: they are built once per row."""
    return bind(df, **{c: df[c] for c in df.columns if c in BOUND})


def duckdb_sql(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` for an engine in which the base tables are views of their own names."""
    return with_views(sql, "duckdb", extra).format(**{b: b for b in BASE})
