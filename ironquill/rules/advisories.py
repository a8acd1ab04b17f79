"""Known-vulnerable versions and end-of-life prefixes.

Any version <= ``max_version`` is vulnerable; per package the first row that
applies wins.  Packages are listed with their rows in precedence order.
"""

from __future__ import annotations

from typing import NamedTuple


class Advisory(NamedTuple):
    name: str
    max_version: str
    severity: str
    cve: str
    description: str


ADVISORIES: tuple[Advisory, ...] = (
    Advisory("django", "2.2.27", "CRITICAL", "CVE-2022-28346",
             "SQL injection via QuerySet.annotate(), aggregate(), and extra() on PostgreSQL."),
    Advisory("django", "3.2.12", "HIGH", "CVE-2022-28347",
             "SQL injection via QuerySet.explain() on PostgreSQL/SQLite/Oracle."),
    Advisory("django", "4.0.3", "HIGH", "CVE-2022-34265",
             "SQL injection via Trunc() and Extract() with crafted kind/lookup_name."),
    Advisory("flask", "0.12.2", "HIGH", "CVE-2018-1000656", "Denial of service via crafted JSON in request."),
    Advisory("requests", "2.19.1", "MEDIUM", "CVE-2018-18074",
             "Authorization header leaked on cross-domain redirects."),
    Advisory("requests", "2.31.0", "MEDIUM", "CVE-2024-35195",
             "Session verify=False persists across requests after redirect."),
    Advisory("urllib3", "1.26.17", "HIGH", "CVE-2023-45803", "Cookie header not stripped on cross-origin redirect."),
    Advisory("urllib3", "2.0.6", "HIGH", "CVE-2023-43804",
             "Cookie header leaked via redirect to different origin."),
    Advisory("pyyaml", "5.3.1", "CRITICAL", "CVE-2020-1747",
             "yaml.load() allows arbitrary code execution via crafted YAML."),
    Advisory("pyyaml", "5.4", "HIGH", "CVE-2020-14343", "Full execution via yaml.full_load on untrusted input."),
    Advisory("jinja2", "2.11.2", "HIGH", "CVE-2020-28493", "ReDoS via crafted email address in urlize filter."),
    Advisory("jinja2", "3.1.2", "MEDIUM", "CVE-2024-22195", "XSS via xmlattr filter with crafted keys."),
    Advisory("cryptography", "3.3.1", "HIGH", "CVE-2020-36242",
             "Bleichenbacher timing oracle attack on RSA decryption."),
    Advisory("cryptography", "41.0.2", "MEDIUM", "CVE-2023-38325", "Memory exhaustion via crafted PKCS7 / X509."),
    Advisory("pillow", "9.0.0", "CRITICAL", "CVE-2022-22817", "Arbitrary code execution via ImageMath.eval()."),
    Advisory("pillow", "9.3.0", "HIGH", "CVE-2022-45198",
             "DoS via crafted FLI file leading to large memory allocation."),
    Advisory("pillow", "10.0.0", "HIGH", "CVE-2023-44271", "Heap buffer overflow in path drawing."),
    Advisory("fastapi", "0.65.2", "MEDIUM", "CVE-2021-32677", "ReDoS in regex used for CORS handling."),
    Advisory("sqlalchemy", "1.3.24", "HIGH", "CVE-2019-7164", "SQL injection via crafted order_by clause."),
    Advisory("paramiko", "2.10.1", "CRITICAL", "CVE-2022-24302",
             "Race condition allows privilege escalation via agent forwarding."),
    Advisory("lxml", "4.6.5", "HIGH", "CVE-2022-2309", "NULL pointer dereference via crafted XML."),
    Advisory("pyjwt", "1.7.1", "CRITICAL", "CVE-2022-29217",
             "Algorithm confusion allows forged tokens via 'none' or mismatched alg."),
    Advisory("werkzeug", "2.2.3", "HIGH", "CVE-2023-25577", "Multipart form data DoS via large file uploads."),
    Advisory("werkzeug", "2.3.7", "MEDIUM", "CVE-2023-46136",
             "Resource exhaustion via crafted multipart boundaries."),
    Advisory("aiohttp", "3.9.0", "HIGH", "CVE-2023-49081",
             "HTTP request smuggling via inconsistent chunked encoding parsing."),
    Advisory("lodash", "4.17.20", "HIGH", "CVE-2020-8203", "Prototype pollution via zipObjectDeep."),
    Advisory("lodash", "4.17.21", "CRITICAL", "CVE-2021-23337", "Command injection via template function."),
    Advisory("express", "4.17.2", "MEDIUM", "CVE-2022-24999",
             "DoS via crafted query string parsing (qs dependency)."),
    Advisory("axios", "0.21.1", "HIGH", "CVE-2021-3749", "ReDoS via crafted trim regex."),
    Advisory("axios", "1.5.1", "MEDIUM", "CVE-2023-45857",
             "Cross-site request forgery via baseURL absolute URL bypass."),
    Advisory("minimist", "1.2.5", "CRITICAL", "CVE-2021-44906", "Prototype pollution via crafted argument keys."),
    Advisory("node-fetch", "2.6.6", "MEDIUM", "CVE-2022-0235",
             "Information exposure via redirect to different protocol."),
    Advisory("moment", "2.29.3", "HIGH", "CVE-2022-24785", "Path traversal via crafted locale string."),
    Advisory("jsonwebtoken", "8.5.1", "CRITICAL", "CVE-2022-23529",
             "Arbitrary code execution via crafted secret/key argument."),
    Advisory("jsonwebtoken", "9.0.0", "HIGH", "CVE-2022-23540", "Algorithm confusion allows signature forgery."),
    Advisory("next", "12.1.0", "HIGH", "CVE-2022-21703", "Server-side request forgery in image optimisation."),
    Advisory("next", "13.4.1", "MEDIUM", "CVE-2023-46298", "DoS via crafted cache-control headers."),
    Advisory("ws", "7.4.6", "HIGH", "CVE-2021-32640", "DoS via crafted Sec-WebSocket-Extensions header."),
    Advisory("semver", "7.5.1", "HIGH", "CVE-2022-25883", "ReDoS via crafted version range string."),
    Advisory("tar", "6.1.11", "HIGH", "CVE-2021-37713",
             "Path traversal allows writing outside extraction directory."),
    Advisory("follow-redirects", "1.15.3", "MEDIUM", "CVE-2023-26159",
             "Improper handling of absolute URL in redirect."),
    Advisory("json5", "1.0.1", "HIGH", "CVE-2022-46175", "Prototype pollution via crafted JSON5 input."),
)

EOL_PREFIXES: tuple[tuple[str, tuple[int, ...]], ...] = (
    ("django", (2, 2)), ("flask", (1, 1)), ("react", (16, 0)), ("vue", (2, 0)),
    ("angular", (10, 0)), ("node", (14, 0)), ("python", (3, 8)),
)
