"""Literal rules for pasted text, in evaluation order."""

from __future__ import annotations

from typing import NamedTuple


class LiteralRule(NamedTuple):
    literal: str
    severity: str
    description: str
    extra: bool = False

    @property
    def title(self) -> str:
        name = self.literal.strip()
        return f"Detected: `{name}`" if self.extra else f"Insecure use of `{name}`"

    @property
    def fix(self) -> str:
        return EXTRA_FIX if self.extra else CORE_FIX

    @property
    def cvss(self) -> float:
        return EXTRA_CVSS.get(self.severity, 5.0) if self.extra else 5.0


CORE_FIX = "Review this pattern and sanitize inputs. See OWASP for secure alternatives."
EXTRA_FIX = "Review this pattern and apply the recommended remediation. See provider security docs."
EXTRA_CVSS = {"CRITICAL": 9.0, "HIGH": 7.5}

_CORE = (
    ("eval(", "HIGH", "eval() executes arbitrary code — dangerous with user input."),
    ("exec(", "HIGH", "exec() runs dynamic code — avoid with untrusted input."),
    ("os.system(", "HIGH", "os.system() executes shell commands; use subprocess with a list instead."),
    ("subprocess.call", "MEDIUM", "subprocess.call with shell=True can lead to shell injection."),
    ("pickle.loads(", "CRITICAL", "pickle.loads() can execute arbitrary code from untrusted data."),
    ("__import__(", "HIGH", "Dynamic __import__ can load malicious modules."),
    ("open(", "LOW", "File operations should validate paths to prevent traversal."),
    ("SELECT *", "MEDIUM", "Wildcard SELECT may expose sensitive columns; be explicit."),
    ('f"SELECT', "HIGH", "f-string SQL is vulnerable to injection — use parameterized queries."),
    ("f'SELECT", "HIGH", "f-string SQL is vulnerable to injection — use parameterized queries."),
    (".format(request", "HIGH", "String-formatted queries with request data risk SQL injection."),
    ("SECRET", "MEDIUM", "Possible hardcoded secret — use environment variables."),
    ("PASSWORD", "MEDIUM", "Possible hardcoded password — use environment variables."),
    ("curl ", "LOW", "Direct curl usage may allow SSRF — validate URLs."),
    ("wget ", "LOW", "wget in code may allow SSRF — validate URLs."),
    ("document.write(", "MEDIUM", "document.write() with user data can cause XSS."),
    ("innerHTML", "MEDIUM", "Setting innerHTML with unsanitized data can cause XSS."),
    ("dangerouslySetInnerHTML", "HIGH", "React dangerouslySetInnerHTML bypasses XSS protection."),
    ("base64.b64decode(", "LOW", "Decoding user-supplied base64 without validation can introduce injection."),
    ("yaml.load(", "HIGH", "yaml.load() allows arbitrary code execution — use yaml.safe_load()."),
    ("deserialize(", "HIGH", "Deserialization of untrusted data is a critical attack vector."),
    ("md5(", "LOW", "MD5 is cryptographically broken — use SHA-256 or better."),
    ("sha1(", "LOW", "SHA-1 is deprecated for security — use SHA-256 or better."),
)

_EXTRA = (
    ("AKIA", "CRITICAL", "Possible AWS Access Key ID — rotate immediately via AWS IAM."),
    ("ghp_", "CRITICAL", "Possible GitHub Personal Access Token — revoke at github.com/settings/tokens."),
    ("xoxb-", "CRITICAL", "Possible Slack bot token — revoke at api.slack.com/apps."),
    ("sk-", "HIGH", "Possible OpenAI or Stripe secret key — check provider dashboard and rotate."),
    ("AIza", "HIGH", "Possible Google API key — restrict scopes and rotate in Cloud Console."),
    ("SG.", "HIGH", "Possible SendGrid API key — rotate in SendGrid dashboard."),
    ("DES.new(", "MEDIUM", "DES is cryptographically broken — use AES-256-GCM."),
    ("RC4(", "MEDIUM", "RC4 is deprecated — use AES-GCM or ChaCha20."),
    ("random.random()", "LOW", "random.random() is not cryptographically secure — use the secrets module."),
    ("Math.random()", "LOW", "Math.random() is not cryptographically secure for tokens or session IDs."),
    ("verify=False", "MEDIUM", "SSL verification disabled — allows MITM attacks. Remove verify=False."),
    ("check_hostname=False", "MEDIUM", "Hostname verification disabled — SSL is ineffective."),
    ("../", "MEDIUM", "Possible path traversal — use os.path.realpath() and validate against allowlist."),
    ("shell=True", "HIGH", "shell=True in subprocess enables shell injection — pass args as a list."),
    ("os.popen(", "HIGH", "os.popen() executes shell commands — use subprocess.run() with a list."),
    ("__proto__", "HIGH", "Prototype pollution risk — sanitize user-controlled object keys."),
    ("constructor[prototype]", "HIGH", "Prototype pollution vector — validate property access on user input."),
    ('password = "', "MEDIUM", "Possible hardcoded password — use environment variables instead."),
    ('passwd = "', "MEDIUM", "Possible hardcoded password — use environment variables instead."),
    ('token = "', "MEDIUM", "Possible hardcoded token — use environment variables instead."),
    ('api_key = "', "MEDIUM", "Possible hardcoded API key — use environment variables instead."),
)

LITERAL_RULES: tuple[LiteralRule, ...] = tuple(
    [LiteralRule(*r) for r in _CORE] + [LiteralRule(*r, extra=True) for r in _EXTRA])

# High-entropy tokens.
ENTROPY_TOKEN_REGEX = r"""["\']([A-Za-z0-9+/=_\-]{20,120})["\']"""
ENTROPY_MIN_CHARS = 32
ENTROPY_THRESHOLD = 4.5
ENTROPY_TITLE = "High-entropy string detected (possible secret)"
ENTROPY_FIX = "Move this value to an environment variable and rotate it immediately if live."
ENTROPY_CVSS = 7.5

# Markers of hostile query strings (all case-insensitive).
INJECTION_REGEXES = (
    r"<script[\s>]",
    r"javascript\s*:",
    r"""on\w+\s*=\s*["\']""",
    r";\s*(drop|delete|insert|update|alter|truncate)\s+",
    r"\bunion\b.{0,20}\bselect\b",
    r"'\s*or\s+'?\d",
)
