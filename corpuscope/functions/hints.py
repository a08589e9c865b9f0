"""Type hints, docstring texts and fix templates inferred from names and source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Return-statement patterns, first match wins.
RETURN_TYPES = [
    (r"\breturn\s+True\b|\breturn\s+False\b", "bool"),
    (r"\breturn\s+\[", "List"),
    (r"\breturn\s+\{", "Dict"),
    (r"\breturn\s+None\b", "None"),
    (r"\breturn\s+[\"']", "str"),
    (r"\breturn\s+\d+\b", "int"),
    (r"\breturn\s+\d+\.\d+", "float"),
    (r"\basync\s+def\b", "Awaitable"),
]

# Parameter-name fragments, first match wins.
PARAM_TYPES = {
    "name": "str", "title": "str", "url": "str", "path": "str", "message": "str", "text": "str",
    "count": "int", "limit": "int", "offset": "int", "size": "int", "id": "int", "page": "int",
    "flag": "bool", "enabled": "bool", "active": "bool", "debug": "bool",
    "data": "Dict", "config": "Dict", "params": "Dict", "options": "Dict",
    "items": "List", "files": "List", "results": "List", "values": "List",
    "callback": "Callable", "handler": "Callable", "func": "Callable",
}

# Verb -> opening word of a docstring.
VERBS = {
    "get": "Retrieves", "fetch": "Fetches", "load": "Loads", "create": "Creates",
    "make": "Creates", "build": "Builds", "update": "Updates", "set": "Sets",
    "save": "Saves", "delete": "Deletes", "remove": "Removes", "validate": "Validates",
    "check": "Checks", "verify": "Verifies", "parse": "Parses", "process": "Processes",
    "handle": "Handles", "send": "Sends", "run": "Executes", "execute": "Executes",
    "start": "Starts", "stop": "Stops", "init": "Initializes", "convert": "Converts",
    "transform": "Transforms", "render": "Renders", "analyze": "Analyzes",
    "scan": "Scans", "detect": "Detects", "calculate": "Calculates", "compute": "Computes",
    "filter": "Filters", "sort": "Sorts", "search": "Searches", "log": "Logs",
}

# Sentence for each inferred return type.
RETURN_TEXT = {
    "bool": "True if successful, False otherwise.", "str": "Result as string.",
    "int": "Computed integer value.", "List": "List of results.",
    "Dict": "Dictionary of results.", "None": "Nothing.",
}


def infer_return_type(source: Column) -> Column:
    chain = F
    for pattern, kind in RETURN_TYPES:
        chain = chain.when(source.rlike("(?U)" + pattern), F.lit(kind))
    return chain.otherwise(F.lit("Unknown"))


def infer_param_type(name: Column) -> Column:
    low = F.lower(name)
    chain = F
    for fragment, kind in PARAM_TYPES.items():
        chain = chain.when(low.contains(fragment), F.lit(kind))
    return (
        chain.when(F.endswith(low, F.lit("_id")), F.lit("int"))
        .when(low.rlike("(_url|_path)$"), F.lit("str"))
        .otherwise(F.lit("Any"))
    )


def docstring_purpose(name: Column) -> Column:
    """One sentence read off a function name."""
    parts = F.split(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")), "_")
    verbs = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])
    verb = F.get(F.filter(parts, lambda p: p.isin(*VERBS)), F.lit(0))
    subject = F.array_join(F.filter(parts, lambda p: (p != verb) & (F.length(p) > 1)), " ")
    subject = F.when(subject == "", "the resource").otherwise(subject)
    return F.when(
        verb.isNotNull(),
        F.concat(F.try_element_at(verbs, verb), F.lit(" "), subject, F.lit(".")),
    ).otherwise(
        F.concat(F.lit("Performs the "), F.replace(name, F.lit("_"), F.lit(" ")),
                 F.lit(" operation."))
    )


#: parameters that the reference's docstrings list at most
REFERENCE_PARAMS = 6


def docstring_text(name: Column, params: Column, source: Column, limit: int | None = None) -> Column:
    """Full docstring with an Args block of all or the first ``limit`` parameters and a Returns block.

    ``params`` is an array of structs with a ``name`` field.
    """
    quotes = F.lit('"""')
    args = F.transform(
        params if limit is None else F.slice(params, 1, limit),
        lambda p: F.concat(
            F.lit("    "), p["name"], F.lit(" ("), infer_param_type(p["name"]), F.lit("): The "),
            F.replace(p["name"], F.lit("_"), F.lit(" ")), F.lit(" value."),
        ),
    )
    kind = infer_return_type(source)
    sentence = F
    for known, text in RETURN_TEXT.items():
        sentence = sentence.when(kind == known, F.lit(text))
    sentence = sentence.otherwise(F.lit("Result of operation."))
    none = F.array().cast("array<string>")
    arg_lines = F.when(
        F.size(params) > 0, F.concat(F.array(F.lit(""), F.lit("Args:")), args)
    ).otherwise(none)
    return_lines = F.when(
        ~kind.isin("Unknown", "None"),
        F.array(F.lit(""), F.lit("Returns:"), F.concat(F.lit("    "), kind, F.lit(": "), sentence)),
    ).otherwise(none)
    return F.array_join(
        F.concat(F.array(quotes, docstring_purpose(name)), arg_lines, return_lines,
                 F.array(quotes)),
        "\n",
    )


def hint_confidence(missing: Column, return_type: Column) -> Column:
    """0.5, plus 0.2 for a known return type, plus 0.3 of the share of typed parameters."""
    typed = F.size(F.filter(missing, lambda p: infer_param_type(p) != "Any"))
    share = F.when(F.size(missing) > 0, typed * F.lit(0.3) / F.size(missing)).otherwise(F.lit(0.0))
    return F.lit(0.5) + F.when(return_type != "Unknown", F.lit(0.2)).otherwise(F.lit(0.0)) + share


# Issue key -> (replacement code, explanation), first match wins.
FIX_TEMPLATES = {
    "SQL Injection": (
        "# Use parameterized queries\ncursor.execute('SELECT * FROM users WHERE id = %s', (user_id,))",
        "Replace string formatting with parameterized queries to prevent SQL injection.",
    ),
    "Hardcoded Password": (
        "import os\npassword = os.environ.get('DB_PASSWORD')\nif not password:\n    raise ValueError('DB_PASSWORD environment variable not set')",
        "Move secrets to environment variables. Never hardcode credentials.",
    ),
    "Hardcoded API Key": (
        "import os\napi_key = os.environ.get('API_KEY')\nif not api_key:\n    raise ValueError('API_KEY environment variable not set')",
        "Store API keys in environment variables or a secrets manager.",
    ),
    "Weak Hash Algorithm": (
        "import hashlib\nhash = hashlib.sha256(data.encode()).hexdigest()\n# For passwords, use bcrypt:\nimport bcrypt\nhashed = bcrypt.hashpw(password.encode(), bcrypt.gensalt())",
        "Replace MD5/SHA1 with SHA-256 or bcrypt for password hashing.",
    ),
    "SSL Certificate Verification Disabled": (
        "import requests\n# Always verify SSL certificates\nresponse = requests.get(url, verify=True, timeout=10)\n# Or with a custom CA bundle:\nresponse = requests.get(url, verify='/path/to/ca-bundle.crt')",
        "Never disable SSL verification. Use proper certificates in production.",
    ),
    "Blocking I/O in Async Function": (
        "import asyncio\nimport aiofiles\nimport httpx\n\nasync def fetch_data():\n    # Use async sleep\n    await asyncio.sleep(1)\n    # Use async file I/O\n    async with aiofiles.open('file.txt') as f:\n        content = await f.read()\n    # Use async HTTP client\n    async with httpx.AsyncClient() as client:\n        response = await client.get(url)",
        "Replace blocking I/O with async equivalents to avoid blocking the event loop.",
    ),
    "N+1 Query Pattern": (
        "# Bad: N+1\nfor user in users:\n    orders = Order.filter(user_id=user.id)  # N queries\n\n# Good: single query with JOIN or IN\nuser_ids = [u.id for u in users]\norders = Order.filter(user_id__in=user_ids)  # 1 query\n# Or use select_related / prefetch_related in Django:\nusers = User.objects.prefetch_related('order_set').all()",
        "Batch database queries to avoid the N+1 problem. Use prefetch_related, select_related, or IN queries.",
    ),
    "God Class": (
        "# Split into focused, single-responsibility classes\nclass UserAuthentication:\n    def login(self): ...\n    def logout(self): ...\n    def validate_token(self): ...\n\nclass UserProfile:\n    def update_profile(self): ...\n    def get_avatar(self): ...\n\nclass UserNotifications:\n    def send_email(self): ...\n    def send_push(self): ...",
        "Break the God Class into smaller classes following the Single Responsibility Principle.",
    ),
    "eval": (
        "import ast\n# Safe: only evaluates literals\nresult = ast.literal_eval(user_input)\n# If you need dynamic code, use a safe sandbox:\n# Consider using RestrictedPython or rewriting the logic",
        "Replace eval() with ast.literal_eval() for safe literal evaluation. Never eval user input.",
    ),
    "Use of eval": (
        "import ast\nresult = ast.literal_eval(user_input)",
        "Replace eval() with ast.literal_eval() for safe literal evaluation.",
    ),
    "Insecure Deserialization": (
        "import json\n# Safe: use JSON instead of pickle\ndata = json.loads(serialized_string)\n# Or use msgpack with strict schema validation\nimport msgpack\ndata = msgpack.unpackb(raw, raw=False)",
        "Replace pickle with JSON or msgpack. Pickle can execute arbitrary code on deserialization.",
    ),
    "HTTP Request Without Timeout": (
        "import requests\n# Always set a timeout to prevent hanging\nresponse = requests.get(\n    url,\n    timeout=(3.05, 27)  # (connect timeout, read timeout)\n)\nresponse.raise_for_status()",
        "Always set request timeouts to prevent indefinite hangs that cause resource exhaustion.",
    ),
    "Long Function": (
        "# Refactor using the Extract Method pattern:\ndef validate_input(data):\n    \"\"\"Single responsibility: input validation.\"\"\"\n    ...\n\ndef process_data(data):\n    \"\"\"Single responsibility: data processing.\"\"\"\n    ...\n\ndef save_result(result):\n    \"\"\"Single responsibility: persistence.\"\"\"\n    ...\n\ndef main_function(data):\n    validated = validate_input(data)\n    processed = process_data(validated)\n    return save_result(processed)",
        "Apply the Extract Method refactoring pattern to break large functions into focused units.",
    ),
    "Debug Mode": (
        "import os\nDEBUG = os.environ.get('DEBUG', 'false').lower() == 'true'\n# In production, ensure DEBUG=false in your environment",
        "Control debug mode via environment variables. Never hardcode DEBUG=True.",
    ),
    "Weak JWT": (
        "import secrets\nimport os\n# Generate a cryptographically secure secret\nJWT_SECRET = os.environ.get('JWT_SECRET') or secrets.token_hex(32)\nif len(JWT_SECRET) < 32:\n    raise ValueError('JWT_SECRET must be at least 32 characters')\n# Use RS256 for asymmetric signing:\nfrom jose import jwt\ntoken = jwt.encode(payload, private_key, algorithm='RS256')",
        "Use a cryptographically random JWT secret of at least 256 bits. Prefer RS256 over HS256.",
    ),
}
DEFAULT_FIX = "# Review the issue and apply best practices for your specific context."


def fix_template(title: Column) -> Column:
    """Struct of template key, code, explanation and confidence for an issue title."""
    low = F.lower(title)
    chain = F
    for key, (code, why) in FIX_TEMPLATES.items():
        known = key.lower()
        chain = chain.when(
            low.contains(known) | F.contains(F.lit(known), low),
            F.struct(
                F.lit(key).alias("template"), F.lit(code).alias("fixed_code"),
                F.lit(why).alias("explanation"), F.lit(0.7).alias("confidence"),
            ),
        )
    return chain.otherwise(
        F.struct(
            F.lit(None).cast("string").alias("template"), F.lit(DEFAULT_FIX).alias("fixed_code"),
            F.concat(F.lit("Manual review recommended for: "), title).alias("explanation"),
            F.lit(0.3).alias("confidence"),
        )
    )
