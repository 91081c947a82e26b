"""The rule catalog: what to look for in a line, in which languages, and how bad it is.

A rule is a row. `need` is a lower-case text that every match contains; it is tested before the pattern. `unless` is a
second pattern that must not be in the line: portable patterns have no lookaround. Patterns are those that
Java and RE2 read alike, ignore case, and avoid `\\b`, which they define differently. Families of rules that
differ only by language are made by rule at the end. `Catalog.register` adds own rules after validation.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions import dims


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    cwe: int
    owasp: str
    category: str
    languages: tuple[str, ...]
    title: str
    need: str
    pattern: str
    unless: str = ""
    confidence: str = "medium"

    @property
    def family(self) -> str:
        return self.rule_id.split("-")[0]


W = r"(^|[^0-9A-Za-z_])"  # a word begins here
REQ = r"(request|req)[.\[]"
TAINTED = r"(request|req|input|params|\$_(GET|POST|REQUEST|COOKIE))"

#: id, severity, CWE, OWASP, category, languages, title, needed text, pattern, and what excludes a match
_ROWS = (
    ("INJ-SQL-001", "critical", 89, "A03", "sql", "python", "f-string in execute()", "execute", r"execute\w*\(\s*f[\"']"),
    ("INJ-SQL-002", "critical", 89, "A03", "sql", "python java csharp", "SQL literal joined with +", "+", r"[\"'](select|insert|update|delete)\s[^\"']*[\"']\s*\+"),
    ("INJ-SQL-003", "critical", 89, "A03", "sql", "python", "SQL literal with %", "%", r"[\"'](select|insert|update|delete)\s[^\"']*%s[^\"']*[\"']\s*%"),
    ("INJ-SQL-004", "critical", 89, "A03", "sql", "python", "SQL literal with format()", ".format(", r"[\"'](select|insert|update|delete)\s[^\"']*[\"']\.format\("),
    ("INJ-NOSQL-001", "high", 943, "A03", "nosql", "python javascript", "operator in a document query", "$", r"[\"']?\$(where|ne)[\"']?\s*:"),
    ("INJ-CMD-001", "critical", 78, "A03", "command", "python", "subprocess with a shell", "shell", r"subprocess\.\w+\(.*shell\s*=\s*true"),
    ("INJ-CMD-002", "high", 78, "A03", "command", "python", "os command call", "os.", W + r"os\.(system|popen|exec\w*|spawn\w*)\("),
    ("INJ-CMD-003", "critical", 78, "A03", "command", "javascript typescript", "child process with interpolation", "exec", r"exec(sync)?\(\s*(`[^`]*\$\{|[\"'][^\"']*[\"']\s*\+)"),
    ("INJ-LDAP-001", "high", 90, "A03", "ldap", "python java", "LDAP filter by concatenation", "+", r"(search|bind)\w*\(.*\(\w+=[\"']?\s*[\"']\s*\+"),
    ("INJ-XPATH-001", "high", 643, "A03", "xpath", "python java csharp", "XPath by concatenation", "xpath", r"xpath\w*\(.*\+"),
    ("INJ-SSTI-001", "critical", 94, "A03", "ssti", "python", "template string by concatenation", "render_template_string", r"render_template_string\(.*(\+|f[\"'])"),
    ("INJ-EVAL-001", "critical", 95, "A03", "rce", "python", "eval()", "eval", W + r"eval\("),
    ("INJ-EXEC-001", "critical", 95, "A03", "rce", "python", "exec()", "exec", W + r"exec\("),
    ("INJ-SSTI-002", "critical", 94, "A03", "ssti", "python", "Template() of input", "template(", W + r"template\(\s*" + TAINTED),
    ("INJ-XXE-001", "high", 611, "A05", "xxe", "python", "XML parsed without hardening", "parse", r"(etree|minidom|elementtree)\.(parse|fromstring|parsestring)\("),
    ("INJ-CRLF-001", "medium", 93, "A03", "crlf", "python", "header by concatenation", "headers", r"headers\[[^\]]+\]\s*=.*\+"),
    ("INJ-LOG-001", "medium", 117, "A09", "log", "python java", "log line by concatenation", "log", r"log(ger|ging)?\.(info|warn|warning|error|debug)\([^)]*\+"),
    ("CRY-HASH-001", "high", 327, "A02", "crypto", "python", "MD5", "md5", r"md5\("),
    ("CRY-HASH-002", "high", 327, "A02", "crypto", "python", "SHA-1", "sha1", r"sha1\("),
    ("CRY-RAND-001", "medium", 338, "A02", "crypto", "python", "random for secrets", "random", r"(token|secret|password|key|nonce)\w*\s*=.*random\.(random|randint|choice)"),
    ("CRY-RAND-002", "medium", 338, "A02", "crypto", "javascript typescript", "Math.random()", "math.random", r"math\.random\("),
    ("CRY-ECB-001", "high", 327, "A02", "crypto", "python", "AES in ECB mode", "ecb", r"mode_ecb"),
    ("CRY-ECB-002", "high", 327, "A02", "crypto", "java", "ECB transformation", "ecb", r"/ecb/"),
    ("CRY-TIMING-001", "medium", 208, "A02", "crypto", "python javascript typescript", "secret compared with ==", "==", r"(password|secret|token|signature|hmac)\w*\s*===?\s*\w"),
    ("CRY-KEY-001", "critical", 321, "A02", "crypto", "python", "key or IV in the code", "=", W + r"(aes_key|encryption_key|iv)\s*=\s*b[\"']"),
    ("CRY-TLS-001", "high", 326, "A02", "crypto", "python", "old TLS version", "protocol_", r"protocol_(sslv2|sslv3|tlsv1(_1)?)(\W|$)"),
    ("CRY-HMAC-001", "high", 327, "A02", "crypto", "python", "hash of secret and data", "secret", r"sha\d+\(\s*secret\w*\s*\+"),
    ("CRY-DES-001", "high", 327, "A02", "crypto", "python java", "DES, RC4 or Blowfish", "", W + r"(des3?|arc4|rc4|blowfish)\.new\(|getinstance\([\"'](des|rc4|blowfish)"),
    ("CRY-STATIC-IV-001", "high", 329, "A02", "crypto", "python", "static nonce", "nonce", r"nonce\s*=\s*b[\"']"),
    ("CRY-WEAK-KEY-001", "high", 326, "A02", "crypto", "python", "short RSA key", "key_size", r"key_size\s*=\s*(512|768|1024)(\D|$)"),
    ("CRY-PBKDF-001", "medium", 916, "A02", "crypto", "python", "few iterations", "iterations", r"iterations\s*=\s*\d{1,4}(\D|$)"),
    ("AUTH-SECRET-001", "critical", 798, "A07", "secrets", "*", "password or key in the code", "", W + r"(password|passwd|secret|api_?key|access_?token)\s*[:=]\s*[\"'][^\"']{6,}[\"']"),
    ("AUTH-SECRET-002", "critical", 798, "A07", "secrets", "*", "AWS access key", "akia", r"akia[0-9a-z]{16}"),
    ("AUTH-SECRET-003", "critical", 798, "A07", "secrets", "*", "private key", "-----begin", r"-----begin [a-z ]*private key-----"),
    ("SEC-GITHUB-001", "critical", 798, "A07", "secrets", "*", "GitHub token", "gh", W + r"gh[pousr]_[0-9a-z]{36}"),
    ("SEC-SLACK-001", "critical", 798, "A07", "secrets", "*", "Slack token", "xox", W + r"xox[abprs]-[0-9a-z-]{10}"),
    ("SEC-STRIPE-001", "critical", 798, "A07", "secrets", "*", "Stripe key", "_live_", W + r"[sr]k_live_[0-9a-z]{16}"),
    ("SEC-GOOGLE-001", "high", 798, "A07", "secrets", "*", "Google key", "aiza", W + r"aiza[0-9a-z_-]{35}"),
    ("AUTH-JWT-001", "critical", 345, "A07", "jwt", "python javascript", "JWT without algorithm", "none", r"algorithms?\s*[:=]\s*\[?\s*[\"']none[\"']"),
    ("AUTH-JWT-002", "critical", 347, "A07", "jwt", "python", "JWT not verified", "verify", r"jwt\.decode\(.*verify(_signature)?[\"']?\s*[:=]\s*false"),
    ("AUTH-JWT-003", "high", 326, "A07", "jwt", "python javascript", "guessable JWT secret", "jwt", r"jwt\.(encode|sign)\(.*[\"'](secret|password|changeme)[\"']"),
    ("AUTH-PWD-001", "high", 256, "A07", "password", "python", "password stored as it is", "password", r"\.password\s*=\s*" + REQ),
    ("AUTH-SESS-001", "high", 330, "A07", "session", "python", "guessable session id", "session", r"session_?id\s*=\s*(str\()?(time|random)\."),
    ("AUTH-COOKIE-001", "medium", 614, "A05", "cookie", "python", "cookie without flags", "set_cookie", r"set_cookie\(", r"secure\s*=\s*true"),
    ("AUTH-COOKIE-002", "medium", 1004, "A05", "cookie", "python", "cookie readable by scripts", "set_cookie", r"set_cookie\(", r"httponly\s*=\s*true"),
    ("AUTH-SESSION-002", "low", 384, "A07", "session", "python", "permanent session", "session.permanent", r"session\.permanent\s*=\s*true"),
    ("AUTH-BASIC-001", "medium", 319, "A02", "config", "python", "basic authentication", "basicauth", r"httpbasicauth\("),
    ("DES-PICKLE-001", "critical", 502, "A08", "deserialization", "python", "pickle", "pickle", W + r"c?pickle\.loads?\("),
    ("DES-YAML-001", "high", 502, "A08", "deserialization", "python", "yaml.load without a safe loader", "yaml.load", r"yaml\.load\(", r"safe_?loader"),
    ("DES-MARSHAL-001", "high", 502, "A08", "deserialization", "python", "marshal", "marshal", r"marshal\.loads?\("),
    ("DES-NODE-001", "critical", 502, "A08", "deserialization", "javascript typescript", "unserialize()", "unserialize", r"unserialize\("),
    ("DES-PHP-001", "critical", 502, "A08", "deserialization", "php", "unserialize()", "unserialize", r"unserialize\(\s*\$"),
    ("ACC-PATH-001", "high", 22, "A01", "access", "python", "open() of a joined path", "open", W + r"open\([^)]*\+"),
    ("ACC-PATH-002", "high", 22, "A01", "access", "python", "file sent by request", "send_file", r"send_(file|from_directory)\(.*" + REQ),
    ("ACC-REDIRECT-001", "medium", 601, "A01", "access", "python", "redirect by request", "redirect", r"redirect\(\s*" + REQ),
    ("ACC-MASS-001", "high", 915, "A01", "access", "python", "request spread into a model", "**", r"\*\*\s*" + REQ),
    ("ACC-PRIV-001", "high", 269, "A01", "access", "python", "privilege by request", "is_", r"\.(is_admin|is_staff|is_superuser)\s*=\s*" + REQ),
    ("ACC-UPLOAD-001", "high", 434, "A04", "access", "python", "upload under its own name", ".filename", r"\.save\(.*\.filename"),
    ("ACC-IDOR-001", "medium", 639, "A01", "access", "python", "object by request id", ".get(", r"\.get\(\s*(id|pk)\s*=\s*" + REQ),
    ("ACC-DEBUG-ROUTE-001", "medium", 489, "A05", "access", "python", "debug or admin route", "route(", r"route\(\s*[\"']/(debug|admin)"),
    ("SSRF-001", "high", 918, "A10", "ssrf", "python", "request to a computed URL", "(", r"(requests|httpx)\.(get|post|put|delete)\(\s*[^\"'\s]", r"(requests|httpx)\.\w+\(\s*[\"']"),
    ("SSRF-002", "high", 918, "A10", "ssrf", "python", "urlopen of a computed URL", "urlopen", r"urlopen\(\s*[^\"'\s]"),
    ("SSRF-METADATA-001", "high", 918, "A10", "ssrf", "*", "cloud metadata address", "169.254.169.254", r"169\.254\.169\.254"),
    ("CFG-SSL-001", "high", 295, "A05", "config", "python", "certificate not verified", "verify", r"verify\s*=\s*false"),
    ("CFG-DEBUG-001", "medium", 489, "A05", "config", "python", "debug mode", "debug", W + r"debug\s*=\s*true"),
    ("CFG-CORS-001", "medium", 942, "A05", "config", "python javascript", "any origin", "*", r"(origins?|access-control-allow-origin)[\"']?\s*[:=,]\s*\[?\s*[\"']\*[\"']"),
    ("CFG-BIND-001", "low", 668, "A05", "config", "python", "bound to all interfaces", "0.0.0.0", r"0\.0\.0\.0"),
    ("CFG-ASSERT-001", "medium", 617, "A04", "config", "python", "authorization by assert", "assert", r"^\s*assert\s.*(is_admin|is_authenticated|has_perm|role)"),
    ("CFG-GQL-001", "low", 200, "A05", "config", "python javascript", "introspection on", "introspection", r"introspection\s*[:=]\s*true"),
    ("CFG-SECRET-001", "high", 798, "A02", "config", "python", "empty or default SECRET_KEY", "secret_key", r"secret_key\s*=\s*[\"'](changeme|secret|dev|)[\"']"),
    ("CFG-HOST-001", "medium", 16, "A05", "config", "python", "any host allowed", "allowed_hosts", r"allowed_hosts\s*=\s*\[\s*[\"']\*"),
    ("CFG-PICKLE-CACHE-001", "high", 502, "A08", "deserialization", "python", "pickle as serializer", "pickle", r"serializer\w*\s*=\s*[\"']?\w*pickle"),
    ("CFG-CORS-CRED-001", "high", 942, "A05", "config", "python javascript", "credentials for any origin", "credentials", r"credentials\s*[:=]\s*true.*[\"']\*[\"']|[\"']\*[\"'].*credentials\s*[:=]\s*true"),
    ("CFG-TRUST-PROXY-001", "medium", 348, "A05", "config", "python", "every proxy trusted", "prox", r"(trusted_proxies|forwarded_allow_ips)\s*=\s*\[?\s*[\"']\*"),
    ("DOS-REDOS-001", "medium", 1333, "A06", "dos", "python javascript", "nested quantifier", "+", r"\([^()]*[+*]\)[+*]"),
    ("HTML-XSS-001", "high", 79, "A03", "xss", "html javascript typescript", "innerHTML of a computed value", "innerhtml", r"\.innerhtml\s*\+?=\s*[^\"'\s=]"),
    ("HTML-XSS-002", "high", 79, "A03", "xss", "html javascript typescript", "document.write", "document.write", r"document\.write(ln)?\("),
    ("HTML-XSS-003", "medium", 79, "A03", "xss", "html", "inline handler", "on", r"<[a-z][^>]*\son(click|load|error|mouseover)\s*="),
    ("HTML-JS-001", "critical", 95, "A03", "rce", "html javascript typescript", "eval()", "eval", W + r"eval\("),
    ("HTML-CFG-001", "low", 1022, "A05", "config", "html", "new window without rel", "_blank", r"target\s*=\s*[\"']?_blank", r"noopener"),
    ("HTML-CFG-002", "medium", 319, "A02", "config", "html", "script over http", "http:", r"<script[^>]*src\s*=\s*[\"']http:"),
    ("HTML-PW-AUTOCOMPLETE-001", "low", 200, "A04", "config", "html", "password field kept", "password", r"<input[^>]*type\s*=\s*[\"']password", r"autocomplete"),
    ("HTML-HTTP-FORM-001", "high", 319, "A02", "config", "html", "form over http", "http:", r"<form[^>]*action\s*=\s*[\"']http:"),
    ("HTML-IFRAME-SANDBOX-001", "medium", 1021, "A05", "config", "html", "frame without sandbox", "<iframe", r"<iframe", r"sandbox"),
    ("XSS-DJANGO-001", "high", 79, "A03", "xss", "python", "mark_safe", "safe", r"mark_safe\(|\|\s*safe\s*}}"),
    ("XSS-REACT-001", "high", 79, "A03", "xss", "javascript typescript", "dangerouslySetInnerHTML", "dangerouslysetinnerhtml", r"dangerouslysetinnerhtml"),
    ("INJ-TEMPLATE-003", "high", 1336, "A03", "ssti", "python", "format_map of a request", "format_map", r"format_map\(\s*" + REQ),
    ("INJ-HEADER-001", "high", 113, "A03", "crlf", "python", "header by request", "headers", r"headers\[[^\]]+\]\s*=\s*" + REQ),
    ("MISC-TODO-SEC-001", "low", 546, "A09", "config", "*", "open security task", "todo", r"todo.*(security|auth|password|vuln)"),
    ("MISC-PRINT-SECRET-001", "low", 532, "A09", "log", "python", "secret printed", "print", W + r"print\(.*(password|secret|token)"),
    ("MISC-EXEC-IMPORT-001", "high", 470, "A03", "rce", "python", "import by request", "import", r"(__import__|import_module)\(\s*" + REQ),
    ("MISC-GETATTR-001", "medium", 470, "A03", "rce", "python", "getattr by request", "getattr", r"getattr\([^,]+,\s*" + REQ),
    ("MISC-TEMPFILE-001", "medium", 377, "A01", "access", "python", "mktemp", "mktemp", r"mktemp\("),
    ("MISC-YAML-CLOAD-001", "high", 502, "A08", "deserialization", "python", "unsafe YAML loader", "yaml", r"yaml\.(unsafe_load|load\(.*(unsafeloader|fullloader))"),
    ("MISC-JINJA-AUTOESCAPE-001", "high", 79, "A03", "xss", "python", "autoescape off", "autoescape", r"autoescape\s*=\s*false"),
    ("MISC-WILDCARD-IMPORT-001", "low", 710, "A06", "config", "python", "import of everything", "import", r"^from\s+\S+\s+import\s+\*"),
    ("MISC-HTTP-NOVERIFY-CTX-001", "high", 295, "A02", "config", "python", "unverified TLS context", "unverified", r"_create_unverified_context"),
    ("MISC-DJANGO-CSRF-EXEMPT-001", "medium", 352, "A01", "config", "python", "CSRF check off", "csrf_exempt", r"@csrf_exempt"),
    ("MISC-SQL-RAW-001", "high", 89, "A03", "sql", "python", "raw SQL by concatenation", "(", r"\.(raw|extra)\(.*(\+|%|f[\"'])"),
    ("MISC-EVAL-INPUT-001", "critical", 95, "A03", "rce", "python", "eval(input())", "input", r"eval\(\s*input\("),
    ("MISC-WEAK-SALT-001", "high", 759, "A02", "crypto", "python", "password hashed without salt", "password", r"(sha\d+|md5)\(\s*password"),
    ("MISC-JS-SETTIMEOUT-STR-001", "medium", 95, "A03", "rce", "javascript typescript", "timer with a string", "settimeout", r"settimeout\(\s*[\"']"),
    ("MISC-JS-LOCALSTORAGE-TOKEN-001", "low", 922, "A04", "session", "javascript typescript", "token in localStorage", "localstorage", r"localstorage\.setitem\(\s*[\"'][^\"']*(token|jwt)"),
    ("MISC-PROTO-POLLUTION-001", "high", 1321, "A08", "deserialization", "javascript typescript", "prototype key", "proto", r"\[\s*[\"']__proto__[\"']\s*\]|__proto__\s*[.=]"),
    ("FW-FASTAPI-001", "low", 862, "A01", "access", "python", "mutation without Depends", "@", r"@(app|router)\.(post|put|delete|patch)\(", r"depends"),
    ("FW-FASTAPI-002", "medium", 489, "A05", "config", "python", "reload on", "reload", r"uvicorn\.run\(.*reload\s*=\s*true"),
    ("FW-DJANGO-001", "high", 89, "A03", "sql", "python", "RawSQL", "rawsql", r"rawsql\("),
    ("FW-DJANGO-004", "high", 79, "A03", "xss", "python", "request in a response", "httpresponse", r"httpresponse\(.*" + REQ),
    ("FW-DJANGO-005", "low", 319, "A02", "config", "python", "no redirect to https", "secure_ssl_redirect", r"secure_ssl_redirect\s*=\s*false"),
    ("FW-FLASK-001", "critical", 1336, "A03", "ssti", "python", "template by request", "render_template_string", r"render_template_string\(\s*" + REQ),
    ("FW-FLASK-003", "high", 798, "A02", "secrets", "python", "secret_key literal", "secret_key", r"\.secret_key\s*=\s*[\"']"),
    ("FW-FLASK-DEBUG-001", "high", 489, "A05", "config", "python", "app.run(debug=True)", "debug", r"\.run\(.*debug\s*=\s*true"),
    ("FW-EXPRESS-001", "high", 79, "A03", "xss", "javascript typescript", "request sent back", "res.send", r"res\.send\(\s*req\."),
    ("FW-EXPRESS-004", "low", 400, "A05", "dos", "javascript typescript", "body without limit", "bodyparser", r"bodyparser\.json\(", r"limit"),
    ("FW-NODE-001", "high", 22, "A01", "access", "javascript typescript", "file by request", "fs.", r"fs\.\w+\(\s*req\."),
    ("FW-VUE-001", "high", 79, "A03", "xss", "javascript typescript html", "v-html", "v-html", r"v-html\s*="),
    ("FW-ANGULAR-001", "high", 79, "A03", "xss", "typescript javascript", "trust bypassed", "bypasssecuritytrust", r"bypasssecuritytrust"),
    ("FW-SPRING-001", "medium", 942, "A05", "config", "java kotlin", "any origin", "crossorigin", r"@crossorigin\(.*\*"),
    ("FW-SPRING-002", "critical", 94, "A03", "rce", "java", "expression of input", "parseexpression", r"parseexpression\(\s*[^\"'\s]"),
    ("FW-RAILS-001", "high", 915, "A08", "access", "ruby", "permit!", "permit!", r"\.permit!"),
    ("FW-RAILS-002", "critical", 89, "A03", "sql", "ruby", "where with interpolation", "where", r"\.where\(\s*\"[^\"]*#\{"),
    ("FW-RAILS-003", "high", 79, "A03", "xss", "ruby", "html_safe", "html_safe", r"\.html_safe"),
    ("FW-LARAVEL-001", "critical", 89, "A03", "sql", "php", "DB::raw of a variable", "db::raw", r"db::raw\([^)]*\$"),
    ("FW-LARAVEL-002", "high", 79, "A03", "xss", "php html", "unescaped output", "{!!", r"\{!!\s*\$"),
    ("FW-PHP-003", "critical", 95, "A03", "rce", "php", "preg_replace /e", "preg_replace", r"preg_replace\(\s*[\"']/.*/\w*e\w*[\"']"),
    ("PHP-EXEC-001", "critical", 78, "A03", "command", "php", "command of a variable", "$", W + r"(exec|system|shell_exec|passthru)\(\s*\$"),
    ("PHP-EVAL-002", "critical", 95, "A03", "command", "php", "eval of a variable", "eval", W + r"eval\(\s*\$"),
    ("PHP-SQL-002", "high", 89, "A03", "sql", "php", "SQL by concatenation", "query", r"query\(\s*\"[^\"]*(\$|\"\s*\.)"),
    ("PHP-INCLUDE-001", "critical", 98, "A03", "rce", "php", "include by request", "$_", W + r"(include|require)(_once)?\W*\$_(get|post|request)"),
    ("PHP-XSS-001", "high", 79, "A03", "xss", "php", "request echoed", "$_", W + r"echo\s+\$_(get|post|request)"),
    ("PHP-EXTRACT-001", "high", 915, "A08", "config", "php", "extract of a request", "extract", r"extract\(\s*\$_(get|post|request)"),
    ("FW-DOCKER-001", "low", 250, "A05", "config", "*", "root user", "user", r"^user\s+root\s*$"),
    ("FW-K8S-001", "high", 250, "A05", "config", "yaml", "privileged container", "privileged", r"privileged:\s*true"),
    ("FW-K8S-002", "high", 250, "A05", "config", "yaml", "host namespaces", "host", r"host(network|pid|ipc):\s*true"),
    ("FW-TERRAFORM-001", "high", 284, "A05", "config", "*", "open to everyone", "0.0.0.0/0", r"cidr_blocks\s*=\s*\[\s*[\"']0\.0\.0\.0/0"),
    ("FW-ENV-001", "medium", 798, "A07", "secrets", "*", "secret in an environment file", "=", r"^[a-z_]*(secret|password|token)[a-z_]*=[^\s\"']{8,}$"),
    ("FW-NGINX-001", "low", 200, "A05", "config", "*", "version shown", "server_tokens", r"server_tokens\s+on"),
    ("YAML-PYTHON-TAG-001", "critical", 502, "A08", "deserialization", "yaml", "Python tag", "!!python", r"!!python/"),
    ("YAML-LATEST-001", "low", 1104, "A06", "config", "yaml", "image tag latest", ":latest", r"image:\s*\S+:latest"),
    ("RUST-UNSAFE-001", "medium", 242, "A06", "config", "rust", "unsafe block", "unsafe", W + r"unsafe\s*\{"),
    ("RUST-UNWRAP-001", "low", 248, "A06", "config", "rust", "unwrap", ".unwrap", r"\.unwrap\(\)|\.expect\("),
    ("RUST-TRANSMUTE-001", "high", 704, "A06", "memory", "rust", "transmute", "transmute", r"mem::transmute"),
    ("C-STRCPY-001", "high", 120, "A06", "memory", "c cpp", "unbounded copy", "(", W + r"(strcpy|strcat|sprintf|vsprintf)\("),
    ("C-GETS-001", "critical", 120, "A06", "memory", "c cpp", "gets()", "gets", W + r"gets\("),
    ("C-FORMAT-001", "high", 134, "A03", "memory", "c cpp", "format from a variable", "printf", W + r"printf\(\s*[a-z_]\w*\s*\)"),
    ("C-SYSTEM-001", "critical", 78, "A03", "command", "c cpp", "system() of a variable", "system", W + r"system\(\s*[^\"\s]"),
    ("C-SCANF-001", "high", 120, "A06", "memory", "c cpp", "scanf without a width", "scanf", r"scanf\(\s*\"[^\"]*%s"),
    ("CSS-EXPRESSION-001", "high", 79, "A03", "xss", "css scss", "expression()", "expression", r"expression\("),
    ("CSS-JS-URL-001", "high", 79, "A03", "xss", "css scss", "script URL", "javascript:", r"url\(\s*[\"']?javascript:"),
    ("CSS-IMPORT-HTTP-001", "medium", 319, "A02", "config", "css scss", "import over http", "http:", r"@import\s+(url\()?\s*[\"']?http:"),
    ("CSS-IMPORTANT-001", "low", 1078, "A06", "config", "css scss", "!important", "!important", r"!important"),
    ("CSS-BEHAVIOR-001", "high", 79, "A03", "xss", "css scss", "behavior", "", r"(^|[^a-z-])behavior\s*:|-moz-binding"),
    ("SH-EVAL-001", "critical", 78, "A03", "command", "shell", "eval of a variable", "eval", W + r"eval\s+\"?\$"),
    ("SH-CURL-PIPE-001", "high", 494, "A08", "command", "shell", "download run at once", "|", r"(curl|wget)\s[^|]*\|\s*(sudo\s+)?(ba)?sh"),
    ("SH-RM-RF-001", "high", 22, "A01", "config", "shell", "rm -rf of a variable", "rm", W + r"rm\s+-rf\s+\"?\$"),
    ("SH-CHMOD-777-001", "medium", 732, "A01", "config", "shell", "chmod 777", "777", r"chmod\s+(-r\s+)?777"),
    ("SQL-GRANT-ALL-001", "high", 732, "A01", "config", "sql", "all privileges", "grant", r"grant\s+all"),
    ("SQL-DROP-001", "medium", 89, "A03", "sql", "sql", "DROP without a check", "drop", r"drop\s+(table|database)", r"if\s+exists"),
    ("SQL-XP-CMDSHELL-001", "critical", 78, "A03", "command", "sql", "xp_cmdshell", "xp_cmdshell", r"xp_cmdshell"),
    ("MVN-VERSION-RANGE-001", "medium", 1104, "A06", "config", "maven", "version range", "<version>", r"<version>\s*[\[(]"),
    ("MVN-SNAPSHOT-001", "low", 1104, "A06", "config", "maven", "snapshot version", "-snapshot", r"<version>[^<]*-snapshot"),
    ("MVN-HTTP-REPO-001", "high", 319, "A08", "config", "maven", "repository over http", "http:", r"<url>\s*http:"),
    ("GRADLE-HTTP-REPO-001", "high", 319, "A08", "config", "gradle", "repository over http", "http:", r"url\s*[=(]?\s*[\"']http:"),
    ("GRADLE-DYNAMIC-VER-001", "medium", 1104, "A06", "config", "gradle", "open version", "+", r"[\"'][^\"':]+:[^\"':]+:[^\"']*\+[\"']"),
    ("MISC-SUBPROCESS-PARTIAL-001", "high", 78, "A03", "command", "python", "command by concatenation", "subprocess", r"subprocess\.\w+\([^)]*[\"']\s*\+"),
    ("MISC-OPEN-WRITE-001", "high", 22, "A01", "access", "python", "open() of a path by request", "open", W + r"open\(\s*(f[\"']|" + REQ + ")"),
    ("MISC-GO-SQL-001", "critical", 89, "A03", "sql", "go", "Sprintf in a query", "sprintf", r"(query|exec)\w*\(\s*fmt\.sprintf"),
    ("MISC-GO-CMD-001", "high", 78, "A03", "command", "go", "shell command", "exec.command", r"exec\.command\(\s*\"(ba)?sh\""),
    ("FW-FASTAPI-003", "high", 79, "A03", "xss", "python", "templates without autoescape", "jinja2templates", r"jinja2templates\(", r"autoescape"),
    ("FW-REACT-001", "medium", 79, "A03", "xss", "javascript typescript", "link from state", "href", r"href\s*=\s*\{\s*(this\.)?(props|state)"),
    ("KT-INTENT-001", "medium", 927, "A01", "access", "kotlin", "implicit intent", "intent(", r"intent\(\s*intent\.action"),
    ("KT-WEBVIEW-001", "medium", 749, "A05", "config", "kotlin", "scripts in a web view", "javascriptenabled", r"javascriptenabled\s*(=|\()\s*true"),
    ("SWIFT-STORE-001", "medium", 922, "A04", "secrets", "swift", "secret in UserDefaults", "userdefaults", r"userdefaults.*(password|token|secret)"),
    ("SWIFT-FORCE-UNWRAP-001", "low", 248, "A06", "config", "swift", "forced try or cast", "!", r"try!|as!"),
    ("SWIFT-WEBVIEW-001", "medium", 939, "A05", "config", "swift", "script run in a web view", "evaluatejavascript", r"evaluatejavascript\("),
    ("C-MALLOC-001", "low", 690, "A06", "config", "c cpp", "allocation unchecked", "malloc", r"=\s*(\([^)]*\)\s*)?malloc\(", r"if\s*\("),
    ("CSS-EXTERNAL-URL-001", "low", 319, "A05", "config", "css scss", "URL over http", "http:", r"url\(\s*[\"']?http:"),
    ("CSS-DATA-URI-001", "low", 79, "A03", "config", "css scss", "active data URL", "data:", r"url\(\s*[\"']?data:(text/html|image/svg)"),
    ("SQL-PLAIN-PW-001", "high", 256, "A02", "secrets", "sql", "password in a statement", "'", r"(password\s*=|identified\s+by)\s*'[^']+'"),
    ("PY-TARFILE-001", "high", 22, "A01", "access", "python", "archive unpacked unchecked", "extractall", r"\.extractall\("),
    ("PY-HARDCODED-TMP-001", "medium", 377, "A01", "path", "python", "fixed temporary path", "/tmp/", r"[\"']/tmp/"),
    ("PY-REQUESTS-TIMEOUT-001", "low", 400, "A06", "dos", "python", "request without timeout", "requests.", r"requests\.(get|post|put|delete|patch)\(", r"timeout"),
    ("JS-POSTMSG-001", "medium", 346, "A07", "config", "javascript typescript", "message from any origin", "message", r"addeventlistener\(\s*[\"']message[\"']", r"origin"),
    ("JS-REDIRECT-001", "medium", 601, "A01", "access", "javascript typescript", "redirect by request", "req.", r"(res\.redirect\(|location(\.href)?\s*=)\s*req\."),
    ("PHP-MAIL-001", "medium", 93, "A03", "crlf", "php", "mail by request", "mail", r"mail\([^)]*\$_(get|post|request)"),
    ("PHP-UPLOAD-001", "high", 434, "A04", "upload", "php", "upload stored", "move_uploaded_file", r"move_uploaded_file\("),
    ("JAVA-REDIRECT-001", "medium", 601, "A01", "access", "java", "redirect by parameter", "sendredirect", r"sendredirect\(\s*request\."),
    ("JAVA-SSRF-002", "high", 918, "A10", "ssrf", "java", "URL by parameter", "url(", r"new url\(\s*request\."),
    ("JAVA-TRUST-001", "high", 295, "A07", "crypto", "java kotlin", "trust manager of one's own", "checkservertrusted", r"checkservertrusted\("),
    ("GRADLE-ALLOW-INSECURE-001", "high", 319, "A08", "config", "gradle", "insecure protocol allowed", "allowinsecureprotocol", r"allowinsecureprotocol\W{0,4}true"),
    ("GO-TEMPLATE-001", "high", 79, "A03", "xss", "go", "text templates", "text/template", r"\"text/template\""),
    ("CS-DESERIALIZE-JS-001", "high", 502, "A08", "deserialization", "csharp", "types from data", "typenamehandling", r"typenamehandling\.(all|auto|objects|arrays)"),
    ("CS-XXE-001", "high", 611, "A05", "xxe", "csharp", "XML reader unhardened", "xml", r"new xml(document|textreader)\("),
    ("CS-PATH-001", "high", 22, "A01", "path", "csharp", "path from input", "path.combine", r"path\.combine\([^)]*(request|input)"),
    ("RB-YAML-001", "high", 502, "A08", "deserialization", "ruby", "YAML.load", "yaml.load", r"yaml\.load\(", r"safe"),
    ("RB-SEND-001", "high", 470, "A03", "command", "ruby", "method by request", "send", r"\.(public_)?send\(\s*params"),
    ("RUST-PANIC-001", "low", 248, "A06", "config", "rust", "panic!", "panic!", r"panic!\("),
    ("SH-UNQUOTED-001", "medium", 78, "A03", "command", "shell", "unquoted variable in a command", "$(", r"\$\([^)\"]*\s\$[a-z_]"),
    ("LUA-IOPOPEN-001", "high", 78, "A03", "command", "lua", "popen by concatenation", "io.popen", r"io\.popen\(.*\.\."),
    ("LUA-SETFENV-001", "low", 668, "A05", "config", "lua", "environment changed", "etfenv", r"[sg]etfenv\("),
    ("R-DOWNLOAD-001", "medium", 319, "A08", "config", "r", "download over http", "http:", r"download\.file\(\s*[\"']http:"),
    ("DART-HTTP-001", "medium", 319, "A08", "config", "dart", "request over http", "uri.", r"uri\.(parse\(\s*[\"']http:|http\()"),
)

#: Other ids in use for the same finding, so that older suppressions and baselines can be carried over.
SAME = {
    "AUTH-SECRET-003": "SEC-PK-001", "ACC-MASS-001": "ACC-MASS-002", "ACC-REDIRECT-001": "ACC-REDIR-001", "CRY-TIMING-001": "CRY-TIMING-002 JS-TIMING-001", "INJ-XPATH-001": "INJ-XPATH-002", "INJ-LOG-001": "INJ-LOG-002", "AUTH-COOKIE-001": "AUTH-COOKIE-003",
    "FW-FLASK-DEBUG-001": "CFG-FLASK-DEBUG-001 PY-FLASK-DEBUG-001 PY-FLASK-RUN-DEBUG-001", "CRY-TLS-001": "CFG-TLS-VER-001", "CFG-ASSERT-001": "MISC-ASSERT-PERM-002 PY-ASSERT-001 PY-ASSERT-AUTH-001", "ACC-PATH-002": "MISC-FLASK-SEND-FILE-001 FW-FLASK-002 PY-FLASK-SEND-001",
    "INJ-CMD-003": "MISC-NODE-CHILD-001 JS-CHILD-EXEC-002", "JAVA-DESER-001": "MISC-JAVA-DESER-001", "PHP-INCLUDE-001": "MISC-PHP-INCLUDE-001", "MISC-DJANGO-CSRF-EXEMPT-001": "FW-DJANGO-002", "CFG-DEBUG-001": "FW-DJANGO-003", "CFG-CORS-001": "FW-EXPRESS-003",
    "RB-DESER-001": "FW-RUBY-001 RB-MARSHAL-001", "DES-PHP-001": "FW-PHP-001", "PHP-EXTRACT-001": "FW-PHP-002", "RUST-EXEC-001": "RUST-CMD-001", "SWIFT-TLS-001": "SWIFT-SSL-001", "C-STRCPY-001": "C-BUF-001 C-SPRINTF-001", "GO-HASH-001": "GO-MD5-001", "CS-HASH-001": "CS-MD5-001",
    "LUA-EVAL-001": "LUA-LOADSTRING-001", "R-EXEC-001": "R-SYSTEM-001", "DART-EXEC-001": "DART-PROCESS-001", "MISC-TEMPFILE-001": "PY-TEMPFILE-001", "MISC-PROTO-POLLUTION-001": "JS-PROTO-001", "XSS-REACT-001": "JS-REACT-XSS-001", "HTML-CFG-001": "HTML-BLANK-001 HTML-TARGET-BLANK-001",
    "CFG-SSL-001": "PY-REQUESTS-NOVERIFY-001", "MISC-JINJA-AUTOESCAPE-001": "PY-JINJA-AUTOESCAPE-001", "JS-EVAL-001": "JS-FUNC-CTOR-001", "HTML-XSS-001": "JS-INNERHTML-002", "HTML-XSS-002": "JS-DOCUMENT-WRITE-001", "FW-JAVA-XXE-001": "JAVA-XXE-002", "JAVA-TRUST-001": "JAVA-TRUST-002",
    "KT-EXEC-001": "KT-RUNTIME-001", "INJ-SSTI-001": "PY-SSTI-001", "INJ-CMD-001": "PY-SUBPROCESS-SHELL-002", "INJ-XXE-001": "PY-XML-ETREE-001", "MISC-WEAK-SALT-001": "PY-HASH-NOSALT-001", "MISC-OPEN-WRITE-001": "PY-OPEN-WRITE-INPUT-001", "GO-TLS-001": "GO-TLS-SKIP-001",
    "GO-RANDOM-001": "GO-RAND-001", "MISC-GO-SQL-001": "GO-SQL-FORMAT-001", "CS-EXEC-001": "CS-PROCESS-001", "RB-EXEC-001": "RB-SYSTEM-001", "SH-CURL-PIPE-001": "SH-WGET-PIPE-001", "SCALA-EXEC-001": "SCALA-PROCESS-001", "LUA-EXEC-001": "LUA-OSEXECUTE-001", "R-DESER-001": "R-READRDS-001",
    "DART-TLS-001": "DART-CERT-001", "SQL-PLAIN-PW-001": "SQL-PLAINTEXT-PW-001", "FW-K8S-001": "YAML-PRIVILEGED-001",
}
CURRENT = {old: rule for rule, olds in SAME.items() for old in olds.split()}

#: Rules that differ only by language: prefix of the id, language, and what the language calls the thing.
_BY_LANGUAGE = {
    "SECRET": {"JAVA": "java kotlin", "GO": "go", "CS": "csharp", "RUST": "rust", "SWIFT": "swift", "SH": "shell", "C": "c cpp", "DART": "dart", "SCALA": "scala", "YAML": "yaml", "MVN": "maven", "GRADLE": "gradle"},
    "EXEC": {"JAVA": r"\.exec\(", "GO": r"exec\.command\(", "CS": r"process\.start\(", "KT": r"\.exec\(", "RUST": r"command::new\(", "RB": r"(^|[^0-9A-Za-z_])system\(", "LUA": r"os\.execute\(", "DART": r"process\.run\(", "SCALA": r"process\(", "R": r"(^|[^0-9A-Za-z_])system\("},
    "SQL": {"GO": "go", "CS": "csharp", "KT": "kotlin", "RUST": "rust", "SWIFT": "swift", "DART": "dart", "SCALA": "scala"},
    "HASH": {"JAVA": r"getinstance\([\"'](md5|sha-?1)", "GO": r"(md5|sha1)\.(new|sum)", "CS": r"(md5|sha1)\.create\(", "PHP": r"(^|[^0-9A-Za-z_])(md5|sha1)\("},
    "RANDOM": {"JAVA": r"new random\(", "GO": r"rand\.intn?\(", "SWIFT": r"arc4random", "SCALA": r"random\.next"},
    "DESER": {"JAVA": "objectinputstream", "KT": "objectinputstream", "CS": "binaryformatter", "RB": "marshal.load", "R": "readrds("},
    "TLS": {"GO": "insecureskipverify: true", "DART": "badcertificatecallback", "SWIFT": "allowsarbitraryloads", "JAVA": "trustallcerts"},
    "EVAL": {"RB": "instance_eval", "LUA": "loadstring(", "R": "eval(parse(", "SCALA": "toolbox.eval", "JS": "new function("},
}
_NAMES = {"JAVA": "java", "GO": "go", "CS": "csharp", "KT": "kotlin", "RUST": "rust", "RB": "ruby", "LUA": "lua", "DART": "dart", "SCALA": "scala", "R": "r", "PHP": "php", "SWIFT": "swift", "JS": "javascript"}


def _families() -> Iterable[Rule]:
    name = lambda p: tuple(_NAMES[p].split())
    for p, langs in _BY_LANGUAGE["SECRET"].items():
        yield Rule(f"{p}-SECRET-001", "critical", 798, "A07", "secrets", tuple(langs.split()), "secret in the code", "", r"(password|secret|api_?key|token)\w*\"?\s*(:=|=|:|>)\s*\"?[A-Za-z0-9_/+.-]{8,}")
    for p, call in _BY_LANGUAGE["EXEC"].items():
        yield Rule(f"{p}-EXEC-001", "critical", 78, "A03", "command", name(p), "command by concatenation", "(", call + r".*([\"']\s*(\+|\.\.)|\$\{?\w|#\{|paste)")
    for p, lang in _BY_LANGUAGE["SQL"].items():
        yield Rule(f"{p}-SQL-001", "high", 89, "A03", "sql", (lang,), "SQL by concatenation", "\"", r"(query|execute|exec|rawquery)\w*!?\(.*\"\s*(select|insert|update|delete)\s[^\"]*(\"\s*\+|\$|\\\(|\{)")
    for kind, severity, cwe, owasp, category, title in (("HASH", "high", 327, "A02", "crypto", "weak hash"), ("RANDOM", "medium", 338, "A02", "crypto", "weak random numbers")):
        for p, call in _BY_LANGUAGE[kind].items():
            yield Rule(f"{p}-{kind}-001", severity, cwe, owasp, category, name(p), title, "", call)
    for kind, severity, cwe, owasp, category, title in (("DESER", "critical", 502, "A08", "deserialization", "unsafe deserialization"), ("TLS", "critical", 295, "A07", "config", "certificate not verified"), ("EVAL", "critical", 95, "A03", "command", "code from text")):
        for p, text in _BY_LANGUAGE[kind].items():
            yield Rule(f"{p}-{kind}-001", severity, cwe, owasp, category, name(p), title, text, re.escape(text).replace("\\ ", " ").replace("\\:", ":").replace("\\-", "-"))


BUILT_IN = (*(Rule(*r[:5], tuple(r[5].split()), *r[6:]) for r in _ROWS), *_families())


@dataclass
class Catalog:
    rules: list[Rule] = field(default_factory=lambda: list(BUILT_IN))

    def register(self, rule: Rule) -> None:
        """Adds a rule whose id is new and whose pattern is portable and not exponential."""
        if any(r.rule_id == rule.rule_id for r in self.rules):
            raise ValueError(f"{rule.rule_id} is taken")
        if rule.severity not in dims.SEVERITIES:
            raise ValueError(f"{rule.severity} is no severity")
        for p in filter(None, (rule.pattern, rule.unless)):
            re.compile(p)
            if re.search(r"\(\?[=!<]|\\b|\\[1-9]", p):
                raise ValueError("no lookaround, \\b or back references: engines differ in them")
            if re.search(r"\([^()]*[+*]\)[+*]", p):
                raise ValueError("a repeated group that repeats may take exponential time")
        self.rules.append(rule)

    def of(self, depth: int = 3, categories: Iterable[str] = (), families: Iterable[str] = ()) -> list[tuple[int, Rule]]:
        """(sequence number, rule) of the rules of a scan; depth 1 has only critical and high ones."""
        keep = lambda r: (depth > 1 or r.severity in ("critical", "high")) and (not categories or r.category in categories) and (not families or r.family in families)
        return [(i, r) for i, r in enumerate(self.rules) if keep(r)]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, r.rule_id, r.severity, f"CWE-{r.cwe}", f"{r.owasp}:2021", r.category, list(r.languages), r.title, r.need, r.pattern, r.unless, r.confidence) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "rule_seq int, rule_id string, severity string, cwe string, owasp string, category string, languages array<string>, title string, need string, pattern string, unless string, confidence string")
