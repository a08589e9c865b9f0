"""Rule rows: the seed packs and a prose pack. User packs are further lists of Rule."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    pack: str
    rule_id: str
    title: str
    regex: str
    severity: str
    category: str
    description: str
    fix: str
    cwe: str = ""
    owasp: str = ""
    flags: str = "i"
    scope: str = "line"          # line | match (one finding per match)
    languages: tuple[str, ...] = ()
    redact: bool = False
    snippet_len: int = 120


def _security(rule_id, title, regex, severity, cwe, owasp, description, fix) -> Rule:
    return Rule("security", rule_id, title, regex, severity, "SECURITY", description, fix, cwe, owasp)


def _secret(rule_id, regex, title, cwe) -> Rule:
    return Rule(
        "secrets", rule_id, title, regex, "HIGH", "SECURITY",
        "Potential secret credential detected.", "Remove immediately, rotate, use env vars.",
        cwe, "A07:2021", flags="", redact=True,
    )


def _script(rule_id, title, regex, severity, category, description, fix, flags="i") -> Rule:
    return Rule(
        "javascript", rule_id, title, regex, severity, category, description, fix, flags=flags,
        languages=("JavaScript", "TypeScript"), snippet_len=100,
    )


def _speed(rule_id, title, regex, severity, description, fix, flags="") -> Rule:
    return Rule(
        "performance", rule_id, title, regex, severity, "PERFORMANCE", description, fix,
        flags=flags, scope="match", snippet_len=0,
    )


# Security patterns, matched case-insensitively on single lines.
SECURITY = [
    _security("jwt_none", "Insecure JWT Algorithm (none)", r'algorithm[s]?\s*=\s*[\["]none["\]]|"alg"\s*:\s*"none"', "HIGH", "CWE-347", "A02:2021", "JWT 'none' algorithm bypasses signature verification.", "Use RS256 or HS256."),
    _security("jwt_weak", "Weak JWT Secret", r'jwt\.encode\(.*secret.*=\s*["\'][a-zA-Z0-9]{1,12}["\']', "HIGH", "CWE-326", "A02:2021", "Short/predictable JWT secret.", "Use a 256-bit random secret."),
    _security("hardcoded_pw", "Hardcoded Password", r'(password|passwd|pwd)\s*=\s*["\'][^"\']{4,}["\']', "HIGH", "CWE-798", "A07:2021", "Hardcoded password in source.", "Use os.environ.get('DB_PASSWORD')"),
    _security("hardcoded_key", "Hardcoded API Key", r'(api_key|apikey|api_token|auth_token|access_token|secret_key)\s*=\s*["\'][A-Za-z0-9\-_]{16,}["\']', "HIGH", "CWE-798", "A07:2021", "Hardcoded API key.", "Store in environment variables or vault."),
    _security("aws_key", "AWS Access Key Exposed", r"AKIA[0-9A-Z]{16}", "HIGH", "CWE-798", "A07:2021", "AWS Access Key ID detected.", "Revoke immediately and use IAM roles."),
    _security("sql_fstr", "SQL Injection via f-string", r'(?:execute|query)\s*\(\s*f["\'].*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)', "HIGH", "CWE-89", "A03:2021", "SQL query built with f-string.", "Use parameterized queries."),
    _security("cmd_inject", "OS Command Injection", r"os\.system\s*\(|subprocess\.(run|call|Popen)\s*\([^)]*shell\s*=\s*True", "HIGH", "CWE-78", "A03:2021", "Shell execution risk.", "Avoid shell=True; pass args as list."),
    _security("eval_exec", "Use of eval()/exec()", r"\b(eval|exec)\s*\(", "HIGH", "CWE-95", "A03:2021", "Arbitrary code execution risk.", "Use ast.literal_eval() instead."),
    _security("weak_md5", "Weak Hash (MD5)", r"hashlib\.md5\s*\(", "MEDIUM", "CWE-328", "A02:2021", "MD5 is cryptographically broken.", "Use hashlib.sha256()."),
    _security("weak_sha1", "Weak Hash (SHA1)", r"hashlib\.sha1\s*\(", "MEDIUM", "CWE-328", "A02:2021", "SHA1 is vulnerable to collision attacks.", "Use hashlib.sha256()."),
    _security("weak_rand", "Insecure Random", r"\brandom\.(random|randint|choice|shuffle)\s*\(", "MEDIUM", "CWE-338", "A02:2021", "random module is not cryptographically secure.", "Use the secrets module."),
    _security("pickle", "Insecure Deserialization (pickle)", r"\bpickle\.(loads?|Unpickler)\s*\(", "HIGH", "CWE-502", "A08:2021", "Pickle executes arbitrary code on load.", "Use JSON or msgpack instead."),
    _security("yaml_unsafe", "Unsafe YAML Load", r"yaml\.load\s*\([^,)]+\)", "HIGH", "CWE-502", "A08:2021", "yaml.load() can execute arbitrary Python.", "Use yaml.safe_load()."),
    _security("debug_mode", "Debug Mode in Production", r"DEBUG\s*=\s*True|app\.run\([^)]*debug\s*=\s*True", "MEDIUM", "CWE-215", "A05:2021", "Debug mode exposes internals.", "Set DEBUG=False via env var."),
    _security("ssl_off", "SSL Verification Disabled", r"verify\s*=\s*False|check_hostname\s*=\s*False", "HIGH", "CWE-295", "A02:2021", "MITM attack possible.", "Never disable SSL verification."),
    _security("cors_star", "CORS Wildcard", r'Access-Control-Allow-Origin["\s:]+\*|allow_origins\s*=\s*\[.*["\*].*\]', "MEDIUM", "CWE-942", "A05:2021", "Wildcard CORS allows any origin.", "Restrict to specific trusted domains."),
    _security("no_timeout", "HTTP Request Without Timeout", r"requests\.(get|post|put|delete|patch)\s*\([^)]*\)(?!\s*\.|#)", "LOW", "CWE-400", "A04:2021", "No timeout causes potential DoS.", "Add timeout=10 parameter."),
    _security("template_inj", "SSTI Risk", r"render_template_string\s*\(|Template\s*\([^)]*request\.", "HIGH", "CWE-94", "A03:2021", "User input in template engine.", "Never pass user input to templates."),
    _security("sensitive_log", "Sensitive Data in Logs", r"log(?:ger)?\.(?:info|debug|warning|error)\s*\(.*(?:password|token|secret|key|credit)", "MEDIUM", "CWE-532", "A09:2021", "Secrets may appear in logs.", "Mask sensitive values before logging."),
    _security("open_redir", "Open Redirect", r"redirect\s*\(\s*request\.(args|GET|POST|params)\[", "MEDIUM", "CWE-601", "A01:2021", "Unvalidated redirect URL.", "Validate redirect URLs against allowlist."),
    _security("path_trav", "Path Traversal Risk", r'open\s*\(\s*(?:request\.|f["\'].*\{)', "HIGH", "CWE-22", "A01:2021", "File path from user input.", "Sanitize with os.path.realpath()."),
    _security("hardcoded_iv", "Hardcoded Crypto IV", r'\biv\s*=\s*b["\'][^"\']{8,}["\']', "HIGH", "CWE-329", "A02:2021", "Hardcoded IV weakens encryption.", "Generate IV with os.urandom(16)."),
]

# Credential patterns, case-sensitive, snippet withheld.
SECRETS = [
    _secret("private_key", r"-----BEGIN (RSA|EC|OPENSSH) PRIVATE KEY-----", "Private Key Exposed", "CWE-321"),
    _secret("postgres_url", r"postgres(?:ql)?://[^:]+:[^@]+@", "DB Connection String", "CWE-522"),
    _secret("mysql_url", r"mysql://[^:]+:[^@]+@", "MySQL Connection String", "CWE-522"),
    _secret("mongodb_url", r"mongodb\+srv://[^:]+:[^@]+@", "MongoDB Connection String", "CWE-522"),
    _secret("openai_key", r"sk-[a-zA-Z0-9]{20,}", "OpenAI API Key", "CWE-798"),
    _secret("github_pat", r"ghp_[a-zA-Z0-9]{36}", "GitHub PAT", "CWE-798"),
    _secret("slack_token", r"xox[baprs]-[0-9A-Za-z\-]{10,}", "Slack Token", "CWE-798"),
    _secret("google_key", r"AIza[0-9A-Za-z\-_]{35}", "Google API Key", "CWE-798"),
]

# JavaScript / TypeScript patterns.
JAVASCRIPT = [
    _script("no-eval", "Dangerous eval()", r"\beval\s*\(", "HIGH", "SECURITY", "eval() is a major XSS vector.", "Use JSON.parse() or refactor."),
    _script("no-innerHTML", "Unsafe innerHTML", r"\.innerHTML\s*=(?!=)", "HIGH", "SECURITY", "innerHTML can introduce XSS.", "Use textContent or DOMPurify.sanitize()."),
    _script("no-dangerouslySetInnerHTML", "React dangerouslySetInnerHTML", r"dangerouslySetInnerHTML\s*=", "MEDIUM", "SECURITY", "Bypasses React XSS protection.", "Sanitize with DOMPurify first."),
    _script("hardcoded-secret", "Hardcoded Secret", r'(api[_-]?key|secret|password|token|auth)\s*[:=]\s*["\'][A-Za-z0-9\-_]{10,}["\']', "HIGH", "SECURITY", "Hardcoded credential.", "Use process.env.API_KEY or import.meta.env."),
    _script("no-document-write", "document.write()", r"document\.write\s*\(", "MEDIUM", "SECURITY", "XSS risk and overwrites page.", "Use DOM manipulation methods."),
    _script("no-async-forEach", "async/await in forEach", r"\.forEach\s*\(\s*async\s", "MEDIUM", "PERFORMANCE", "async callbacks in forEach don't await.", "Use Promise.all(items.map(async i => ...))"),
    _script("promise-antipattern", "Promise Constructor Anti-pattern", r"new\s+Promise\s*\(\s*(?:async\s*)?\(?resolve", "LOW", "QUALITY", "Wrapping existing promise is redundant.", "Return the existing promise directly."),
    _script("react-hooks-cond", "Conditional Hook Call", r"if\s*\([^)]+\)\s*\{[^}]*\buse[A-Z]\w+\s*\(", "HIGH", "QUALITY", "Violates Rules of Hooks.", "Move hook to top level."),
    _script("missing-dep-array", "useEffect Without Deps", r"useEffect\s*\(\s*(?:async\s*)?\(?(?:\(\)|\w+)\s*=>\s*\{[^}]+\}\s*\)", "MEDIUM", "QUALITY", "Runs on every render.", "Add dependency array: useEffect(() => {}, [dep])"),
    _script("react-key-prop", "Missing key Prop in List", r"\.map\s*\([^)]*=>\s*(?:\(?\s*)?<(?!React\.Fragment)", "MEDIUM", "QUALITY", "Elements in .map() need key prop.", "Add key={item.id} to rendered element."),
    _script("state-mutation", "Direct State Mutation", r"(?:this\.state\.\w+|state\.\w+)\s*=(?!=)", "HIGH", "QUALITY", "Bypasses React rendering cycle.", "Use setState() or useState() setter."),
    _script("no-any", "Explicit any Type", r":\s*any\b|as\s+any\b", "LOW", "QUALITY", "Defeats TypeScript type safety.", "Use specific types or unknown with guards."),
    _script("ts-ignore", "@ts-ignore Comment", r"//\s*@ts-ignore|//\s*@ts-nocheck", "MEDIUM", "QUALITY", "Suppresses TypeScript errors.", "Fix the underlying type error."),
    _script("non-null-assert", "Non-null Assertion Overuse", r"\w+!\.", "LOW", "QUALITY", "Can cause runtime errors.", "Use optional chaining ?. instead."),
    _script("console-log", "console.log in Production", r"\bconsole\.(log|debug|info)\s*\(", "LOW", "PERFORMANCE", "Leaks info and degrades performance.", "Remove or replace with proper logger."),
    _script("large-bundle", "Whole-Library Import", r"import\s+\w+\s+from\s+['\"](?:lodash|moment|rxjs|antd)['\"]", "MEDIUM", "PERFORMANCE", "Prevents tree-shaking.", "Import only: import debounce from 'lodash/debounce'"),
    _script("sync-xhr", "Synchronous XHR", r'\.open\s*\(\s*["\'][A-Z]+["\'],\s*[^,]+,\s*false\s*\)', "HIGH", "PERFORMANCE", "Blocks the main thread.", "Use fetch() with async/await."),
    _script("var-decl", "var Declaration", r"\bvar\s+\w+", "LOW", "QUALITY", "var has hoisting issues.", "Replace with const or let."),
    _script("loose-eq", "Loose Equality (==)", r"(?<!=)={2}(?!=)", "LOW", "QUALITY", "Type coercion causes bugs.", "Use === for strict equality."),
    _script("empty-catch", "Empty catch Block", r"catch\s*\([^)]*\)\s*\{\s*\}", "MEDIUM", "QUALITY", "Silently swallows errors.", "At minimum: catch (err) { console.error(err); }"),
    _script("debugger", "debugger Statement", r"^\s*debugger\s*;", "MEDIUM", "QUALITY", "Halts execution in DevTools.", "Remove before committing.", flags="m"),
]

# Performance patterns, one finding per match.
PERFORMANCE = [
    _speed("print_prod", "print() in Production", r"^\s*print\s*\(", "LOW", "print() pollutes stdout.", "Replace with logging.debug/info.", flags="m"),
    _speed("bare_except", "Bare except Clause", r"except\s*:", "MEDIUM", "Bare except catches all errors silently.", "Specify exception type: except ValueError as e:"),
    _speed("mutable_default", "Mutable Default Argument", r"def \w+\([^)]*=\s*(\[\]|\{\}|\(\))", "MEDIUM", "Shared mutable default causes bugs.", "Use None default and initialize inside."),
    _speed("global_state", "Mutable Global State", r"^\s*global\s+\w+", "LOW", "Globals cause hidden coupling.", "Pass state as arguments or use a class.", flags="m"),
    _speed("list_in_agg", "Unnecessary List in Aggregation", r"\b(sum|min|max|any|all)\s*\(\s*\[", "LOW", "Builds an unneeded list.", "Use generator: sum(x for x in ...)"),
]


class SpanRule(NamedTuple):
    """A loop header followed, on a later line, by a costly statement."""

    rule_id: str
    title: str
    header: str
    target: str
    severity: str
    description: str
    fix: str


# Header line and later target line of the span patterns.
SPAN = [
    SpanRule("regex_str", "Regex Compiled Inside Loop", r"for .+:$", r"^\s*re\.(compile|match|search|findall)\(", "MEDIUM", "Recompiling regex every iteration wastes CPU.", "Compile outside the loop: pat = re.compile(...)"),
    SpanRule("open_in_loop", "File Open Inside Loop", r"for .+:$", r"^\s*open\s*\(", "MEDIUM", "Excessive I/O syscalls.", "Open outside loop and pass the handle."),
    SpanRule("str_concat", "String Concatenation in Loop", r"for .+:$", r"^\s*\w+\s*\+=\s*[\"']", "LOW", "O(n²) string copies.", "Use a list and ''.join(parts) at the end."),
]


def _prose(rule_id, title, regex, severity, category, redact=False) -> Rule:
    return Rule("prose", rule_id, title, regex, severity, category, title, "Review the line.",
                redact=redact)


# User pack for natural-language corpora.
PROSE = [
    _prose("license_line", "License Line", r"(released|licensed) under the ", "LOW", "QUALITY"),
    _prose("hex_token", "Hexadecimal Token", r"[0-9a-f]{32,}", "HIGH", "SECURITY", True),
    _prose("email", "E-mail Address", r"[a-z0-9._-]+@[a-z0-9-]+\.[a-z]+", "MEDIUM", "SECURITY"),
    _prose("digit_run", "Long Digit Run", r"[0-9]{9,}", "MEDIUM", "SECURITY", True),
    _prose("junk_run", "Junk Symbol Run", r"[%*#]{3,}", "LOW", "QUALITY"),
    _prose("url", "Plain URL", r"https?://", "LOW", "QUALITY"),
    _prose("assignment", "Assigned Secret Word", r"(key|secret|password|token)\s*[:=]", "HIGH", "SECURITY", True),
]
