"""Path, URL and module-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.text import capitalize, strip

# File extension -> language.
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "JavaScript",
    ".tsx": "TypeScript", ".java": "Java", ".go": "Go", ".rb": "Ruby", ".php": "PHP",
    ".cs": "C#", ".cpp": "C++", ".c": "C", ".h": "C/C++ Header", ".rs": "Rust",
    ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala", ".sh": "Shell",
    ".yaml": "YAML", ".yml": "YAML", ".json": "JSON", ".toml": "TOML", ".md": "Markdown",
}

# Directory names that are never read.
IGNORED_DIRS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build",
    ".next", ".nuxt", "coverage", ".pytest_cache", ".mypy_cache", "vendor", "target",
    ".tox", "eggs", ".eggs", "htmlcov", ".cache",
)

# Path keyword -> architecture domain, first match wins.
DOMAIN_KEYWORDS = {
    "auth": "Auth", "authentication": "Auth", "login": "Auth", "jwt": "Auth", "oauth": "Auth",
    "user": "User", "account": "Account", "profile": "User",
    "api": "API", "route": "API", "view": "API", "endpoint": "API", "controller": "API",
    "handler": "API",
    "service": "Service", "business": "Service", "logic": "Service", "manager": "Service",
    "model": "Model", "schema": "Model", "entity": "Model", "dto": "Model",
    "repo": "Repository", "repository": "Repository", "dao": "Repository", "store": "Repository",
    "util": "Utils", "helper": "Utils", "common": "Utils", "shared": "Utils", "lib": "Utils",
    "test": "Test", "spec": "Test", "mock": "Test", "fixture": "Test",
    "config": "Config", "setting": "Config", "env": "Config",
    "hook": "Hooks", "middleware": "Middleware", "decorator": "Middleware",
    "core": "Core", "base": "Core", "abstract": "Core",
    "ui": "UI", "component": "UI", "widget": "UI", "page": "UI", "screen": "UI",
    "db": "Database", "database": "Database", "migration": "Database", "seed": "Database",
    "cache": "Cache", "redis": "Cache", "celery": "Queue", "task": "Queue", "worker": "Queue",
    "notification": "Notification", "email": "Notification", "sms": "Notification",
    "payment": "Payment", "billing": "Payment", "invoice": "Payment",
}

# Test directories, test file-name patterns, affixes of test stems.
TEST_DIRS = ("tests", "test", "__tests__", "spec", "specs", "testing")
TEST_NAME = r"test[_-]|[_-]test|\.test\.|\.spec\.|_spec\.|spec_"
STEM_AFFIX = r"^test[_-]|[_-]test$|[_-]spec$"
TEST_AFFIX = r"^test[_-]|[_-]test$|[_-]spec$|^spec[_-]"


def unix_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(unix_path(path), "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix of the file name; a leading dot does not start one."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def detect_language(path: Column) -> Column:
    """Language of a path, or Unknown. The lookup is a constant-size map."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("Unknown"))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*LANGUAGES)


def in_ignored_dir(path: Column) -> Column:
    parts = F.split(unix_path(path), "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def module_of(path: Column) -> Column:
    """First directory, capitalised; Root for a bare file name."""
    parts = F.split(unix_path(path), "/")
    return F.when(F.size(parts) >= 2, capitalize(F.element_at(parts, 1))).otherwise(F.lit("Root"))


def coverage_module(path: Column) -> Column:
    """Parent directory, capitalised, with the file name."""
    parts = F.split(unix_path(path), "/")
    return F.when(
        F.size(parts) >= 2,
        F.concat(capitalize(F.element_at(parts, -2)), F.lit("/"), F.element_at(parts, -1)),
    ).otherwise(path)


def _domain(segments: Column, keywords: dict[str, str]) -> Column:
    any_keyword = "|".join(keywords)
    hit = F.get(F.filter(segments, lambda s: s.rlike(any_keyword)), F.lit(0))

    def label(seg: Column) -> Column:
        chain = F
        for word, domain in keywords.items():
            chain = chain.when(seg.contains(word), F.lit(domain))
        return chain

    found = F.get(F.transform(F.array(hit), label), F.lit(0))
    return F.nullif(F.coalesce(found, capitalize(F.element_at(segments, 1))), F.lit(""))


def domain_of_path(path: Column, keywords: dict[str, str] = DOMAIN_KEYWORDS) -> Column:
    return _domain(F.split(F.lower(unix_path(path)), "/"), keywords)


def domain_of_import(target: Column, keywords: dict[str, str] = DOMAIN_KEYWORDS) -> Column:
    """Domain of an import path; null when nothing is left to name it."""
    return _domain(F.split(F.lower(target), r"[./\\]"), keywords)


def is_test_file(path: Column) -> Column:
    parts = F.split(F.lower(unix_path(path)), "/")
    in_dir = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in TEST_DIRS]))
    return in_dir | F.element_at(parts, -1).rlike(TEST_NAME)


def file_stem(path: Column) -> Column:
    """File name without its last extension, lower-cased."""
    return F.lower(F.regexp_replace(file_name(path), r"(?s)(?<=.)\.[^.]*$", ""))


def source_stem(path: Column) -> Column:
    return F.regexp_replace(file_stem(path), STEM_AFFIX, "")


def test_stem(path: Column) -> Column:
    """Stem of a test file with its test prefix or suffix removed."""
    return F.regexp_replace(source_stem(path), TEST_AFFIX, "")


def _no_trailing_slash(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def repo_name(url: Column) -> Column:
    """Last two segments of a repository URL."""
    parts = F.split(_no_trailing_slash(url), "/")
    return F.when(
        F.size(parts) >= 2,
        F.concat(F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1)),
    ).otherwise(F.element_at(parts, -1))


def cache_key(url: Column, commit: Column) -> Column:
    """Sixteen hex digits that name one repository snapshot."""
    text = F.concat(_no_trailing_slash(F.lower(url)), F.lit("@"), commit)
    return F.substr(F.sha2(text, 256), F.lit(1), F.lit(16))


def normalize_repo_url(url: Column) -> Column:
    """Canonical https form of a user-typed repository address; null if none fits."""
    u = strip(url)
    full = (
        F.when(u.rlike("^(http://|https://|git@)"), u)
        .when(u.rlike("(?i)^github\\.com/"), F.concat(F.lit("https://"), u))
        .when(u.contains("/"), F.concat(F.lit("https://github.com/"), u))
    )
    secure = F.regexp_replace(full, r"(?i)^http://github\.com/", "https://github.com/")
    return F.regexp_replace(secure, "/$", "")


def decode_repo_key(key: Column) -> Column:
    """URL-safe base64 text, or the raw key where it does not decode."""
    plain = F.translate(key, "-_", "+/")
    body = F.regexp_replace(plain, "=+$", "")
    pad = F.pmod(F.lit(4) - F.length(body) % 4, F.lit(4)).cast("int")
    raw = F.try_to_binary(F.concat(body, F.repeat(F.lit("="), pad)), F.lit("base64"))
    return F.coalesce(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")), key)
