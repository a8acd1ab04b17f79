"""Compliance needles, score weights, auto-fix rules."""

from __future__ import annotations

from typing import NamedTuple

A01 = "A01 Broken Access Control"
A02 = "A02 Cryptographic Failures"
A03 = "A03 Injection"
A05 = "A05 Security Misconfiguration"
A06 = "A06 Vulnerable and Outdated Components"
A07 = "A07 Identification and Authentication Failures"
A08 = "A08 Software and Data Integrity Failures"
A09 = "A09 Security Logging and Monitoring Failures"
A10 = "A10 Server-Side Request Forgery"

# (needle, OWASP, NIST); the first needle found in the finding's text wins.
COMPLIANCE_RULES: tuple[tuple[str, str, str], ...] = (
    ("sql injection", A03, "SI-10"), ("f-string sql", A03, "SI-10"), ("union select", A03, "SI-10"),
    ("command injection", A03, "SI-10"), ("os.popen", A03, "SI-10"), ("shell=true", A03, "SI-10"),
    ("eval(", A03, "SI-10"), ("exec(", A03, "SI-10"),
    ("deserialize", A08, "SI-7"), ("pickle.loads", A08, "SI-7"), ("yaml.load", A08, "SI-7"),
    ("xss", A03, "SI-10"), ("innerhtml", A03, "SI-10"), ("dangerouslysetinnerhtml", A03, "SI-10"),
    ("document.write", A03, "SI-10"), ("prototype pollution", A03, "SI-10"), ("__proto__", A03, "SI-10"),
    ("path traversal", A01, "AC-3"), ("access control", A01, "AC-3"), ("authoriz", A01, "AC-3"),
    ("private key", A02, "SC-12"), ("rsa key", A02, "SC-12"), ("ssh key", A02, "SC-12"),
    ("aws access key", A02, "SC-28"), ("aws secret", A02, "SC-28"), ("openai", A02, "SC-28"),
    ("anthropic", A02, "SC-28"), ("huggingface", A02, "SC-28"), ("github pat", A02, "SC-28"),
    ("github oauth", A02, "SC-28"), ("slack bot token", A02, "SC-28"), ("sendgrid", A02, "SC-28"),
    ("twilio", A02, "SC-28"), ("stripe", A02, "SC-28"), ("paypal secret", A02, "SC-28"),
    ("supabase service role", A02, "SC-28"), ("database connection", A02, "SC-28"),
    ("jwt secret", A02, "SC-13"),
    ("hardcoded password", A07, "IA-5"), ("hardcoded token", A07, "IA-5"), ("hardcoded api key", A07, "IA-5"),
    ("high-entropy", A02, "SC-28"), ("secrets exposure", A02, "SC-28"), (".env file", A05, "CM-6"),
    ("md5", A02, "SC-13"), ("sha1", A02, "SC-13"), ("sha-1", A02, "SC-13"), ("des.new", A02, "SC-13"),
    ("rc4", A02, "SC-13"), ("math.random", A02, "SC-13"), ("random.random", A02, "SC-13"),
    ("ssrf", A10, "SC-7"), ("curl ", A10, "SC-7"), ("wget ", A10, "SC-7"),
    ("verify=false", A02, "SC-8"), ("check_hostname=false", A02, "SC-8"), ("http://", A02, "SC-8"),
    ("vulnerable dependency", A06, "SI-2"), ("outdated", A06, "SI-2"),
    ("audit", A09, "AU-2"), ("logging", A09, "AU-2"),
)
DEFAULT_OWASP = A05
DEFAULT_NIST = "SI-2"

# Points per finding; any other severity counts as LOW.
SCORE_WEIGHTS = {"CRITICAL": 40, "HIGH": 20, "MEDIUM": 10, "LOW": 5}
SCORE_BANDS = ((90, "Excellent"), (75, "Good"), (50, "Moderate"), (25, "High Risk"))
SCORE_FLOOR_LABEL = "Critical"
LEGACY_WEIGHTS = {"CRITICAL": 40, "HIGH": 25, "MEDIUM": 10, "LOW": 3}

# Words that make a finding count as a secret in repository health.
SECRET_TERMS = (
    "key", "token", "secret", "password", "credential",
    "private key", "entropy", "jwt", "connection string",
)


class FixRule(NamedTuple):
    regex: str
    replacement: str
    explanation: str
    confidence: int


AUTOFIX_RULES: tuple[FixRule, ...] = (
    FixRule(r"\beval\s*\((.+?)\)", r"ast.literal_eval(\1)",
            "eval() executes arbitrary Python code. ast.literal_eval() only parses literal "
            "Python data structures (strings, numbers, tuples, lists, dicts, booleans, None), "
            "making it safe for parsing user-supplied data.", 95),
    FixRule(r"\bexec\s*\((.+?)\)",
            r"# exec(\1)  — remove dynamic execution; use explicit function dispatch instead",
            "exec() runs arbitrary code with full interpreter access. Replace dynamic code "
            "execution with an explicit mapping of allowed operations (e.g. a dict of functions).", 80),
    FixRule(r"os\.system\s*\((.+?)\)", r"subprocess.run(\1, shell=False, check=True)",
            "os.system() invokes a full shell, enabling shell injection via unsanitised input. "
            "subprocess.run() with shell=False and an argument list avoids shell interpretation entirely.", 90),
    FixRule(r"subprocess\.call\((.+?),\s*shell\s*=\s*True\)", r"subprocess.run(\1, shell=False, check=True)",
            "shell=True passes your command through a shell, allowing injection if any part "
            "of the command includes untrusted input. Pass arguments as a list with shell=False.", 90),
    FixRule(r"pickle\.loads?\((.+?)\)", r"json.loads(\1)",
            "pickle.loads() can execute arbitrary code embedded in the pickled data. If the "
            "data is simple (dicts, lists, strings, numbers), json.loads() is a safe drop-in "
            "replacement with no code-execution risk.", 70),
    FixRule(r"yaml\.load\((.+?)\)", r"yaml.safe_load(\1)",
            "yaml.load() can instantiate arbitrary Python objects from the YAML document, "
            "which can lead to code execution. yaml.safe_load() restricts parsing to basic "
            "YAML tags only.", 95),
    FixRule(r"hashlib\.md5\((.+?)\)", r"hashlib.sha256(\1)",
            "MD5 is cryptographically broken and vulnerable to collision attacks. "
            "SHA-256 is a drop-in replacement for non-password hashing needs.", 85),
    FixRule(r"hashlib\.sha1\((.+?)\)", r"hashlib.sha256(\1)",
            "SHA-1 is deprecated for security-sensitive use due to demonstrated collision "
            "attacks. SHA-256 provides a stronger, drop-in replacement.", 85),
    FixRule(r"verify\s*=\s*False", r"verify=True",
            "Disabling SSL/TLS certificate verification allows man-in-the-middle attacks. "
            "Re-enable verification; if using a private CA, pass the CA bundle path instead "
            "of disabling verification entirely.", 90),
    FixRule(r"random\.random\(\)", r"secrets.token_hex(16)",
            "random.random() is a non-cryptographic PRNG and is predictable. For security "
            "tokens, session IDs, or password reset codes, use the `secrets` module which "
            "is designed for cryptographic use.", 80),
    FixRule(r"Math\.random\(\)", r"crypto.getRandomValues(new Uint32Array(1))[0]",
            "Math.random() in JavaScript is not cryptographically secure. For tokens or "
            "security-relevant randomness, use the Web Crypto API's getRandomValues().", 80),
    FixRule(r"\.innerHTML\s*=\s*(.+)", r".textContent = \1",
            "Assigning to innerHTML with untrusted data allows XSS via injected <script> or "
            "event-handler attributes. textContent renders the value as plain text, neutralising "
            "any HTML/JS payload. If HTML rendering is required, sanitise with DOMPurify first.", 75),
    FixRule(r"""f["\']SELECT.+?\{.+?\}.+?["\']""",
            'cursor.execute("SELECT ... WHERE id = %s", (value,))',
            "f-string interpolation directly into SQL allows SQL injection if any "
            "interpolated value comes from user input. Use parameterised queries — the "
            "driver escapes values safely.", 85),
)
