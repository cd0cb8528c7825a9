"""Programming language of a text: name, shebang, modeline, extension, then weighted patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and weights of each language (multi-line, without case; True: the dot
# also takes line ends), weaker shared patterns, special names, extensions, interpreters.
PATTERNS: dict[str, list[tuple]] = {
    "python": [
        (r"^from\s+[\w.]+\s+import\s+", 0.35),
        (r"^def\s+\w+\s*\([^)]*\)\s*->\s*\w+:", 0.35),
        (r"^def\s+\w+\s*\([^)]*\)\s*:", 0.3),
        (r"""if\s+__name__\s*==\s*['\"]__main__['\"]""", 0.4),
        (r"^\s*@\w+(?:\.\w+)*(?:\([^)]*\))?\s*$", 0.25),
        (r"self\.\w+", 0.2),
        ('__init__|__str__|__repr__|__call__', 0.3),
        (r"^\s*async\s+def\s+\w+", 0.3),
        (r"print\s*\([^)]*\)", 0.15),
        (r"raise\s+\w+(?:Error|Exception)", 0.25),
    ],
    "rust": [
        (r"^(?:pub\s+)?fn\s+\w+\s*(?:<[^>]+>)?\s*\([^)]*\)\s*(?:->\s*[^{]+)?\s*\{", 0.4),
        (r"^(?:pub\s+)?struct\s+\w+(?:\s*<[^>]+>)?\s*\{", 0.35),
        (r"^impl(?:\s*<[^>]+>)?\s+\w+", 0.4),
        (r"^use\s+[\w:]+(?:::\{[^}]+\})?;", 0.35),
        (r"#\[derive\([^\]]+\)\]", 0.4),
        (r"#\[\w+(?:\([^\]]*\))?\]", 0.25),
        (r"&mut\s+\w+|&\w+", 0.2),
        (r"let\s+mut\s+\w+", 0.3),
        ('Option<|Result<|Vec<|Box<', 0.35),
        (r"\.unwrap\(\)|\.expect\(|\.ok\(\)|\.err\(\)", 0.3),
        (r"println!\s*\(|eprintln!\s*\(|format!\s*\(", 0.35),
    ],
    "go": [
        (r"^package\s+\w+\s*$", 0.4),
        (r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?\w+\s*\([^)]*\)(?:\s+(?:\([^)]+\)|\w+))?\s*\{", 0.4),
        (r"^import\s+\(", 0.35),
        (r"^type\s+\w+\s+struct\s*\{", 0.4),
        (r"^type\s+\w+\s+interface\s*\{", 0.4),
        (':=', 0.25),
        (r"go\s+\w+\s*\(", 0.3),
        (r"defer\s+\w+", 0.3),
        (r"make\s*\(\s*(?:chan|map|\[\])", 0.3),
        (r"fmt\.Print|fmt\.Sprint|fmt\.Errorf", 0.3),
    ],
    "typescript": [
        (r"^interface\s+\w+(?:\s+extends\s+\w+)?\s*\{", 0.4),
        (r"^type\s+\w+(?:\s*<[^>]+>)?\s*=", 0.35),
        (r":\s*(?:string|number|boolean|any|void|never|unknown)\s*[;=,)]", 0.3),
        (r"<\w+(?:,\s*\w+)*>\s*\(", 0.25),
        (r"\w+\s*:\s*\w+\s*\[\]", 0.25),
        (r"as\s+(?:const|string|number|boolean|\w+)", 0.25),
        (r"\?\.\w+|!\.\w+", 0.2),
        (r"private\s+\w+:|public\s+\w+:|protected\s+\w+:", 0.3),
    ],
    "javascript": [
        (r"^(?:export\s+)?(?:default\s+)?function\s+\w+\s*\(", 0.3),
        (r"^const\s+\w+\s*=\s*(?:async\s+)?\([^)]*\)\s*=>", 0.35),
        (r"^const\s+\w+\s*=\s*require\s*\(", 0.35),
        (r"module\.exports\s*=", 0.4),
        (r"console\.(?:log|error|warn|info)\s*\(", 0.25),
        (r"document\.(?:getElementById|querySelector|createElement)", 0.35),
        (r"window\.\w+|localStorage\.\w+", 0.3),
        (r"async\s+function\s+\w+|await\s+\w+", 0.25),
    ],
    "java": [
        (r"^public\s+class\s+\w+(?:\s+extends\s+\w+)?(?:\s+implements\s+[\w,\s]+)?\s*\{", 0.45),
        (r"^(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?(?:\w+(?:<[^>]+>)?)\s+\w+\s*\(", 0.4),
        (r"^package\s+[\w.]+;", 0.4),
        (r"^import\s+(?:static\s+)?[\w.]+(?:\.\*)?;", 0.35),
        (r"System\.out\.print(?:ln)?\s*\(", 0.35),
        ('@Override|@SuppressWarnings|@Deprecated', 0.3),
        (r"new\s+\w+(?:<[^>]+>)?\s*\(", 0.25),
        (r"(?:public|private|protected)\s+(?:static\s+)?void\s+\w+\s*\(", 0.35),
        (r"(?:public|private|protected)\s+String\s+\w+", 0.3),
        (r"class\s+\w+[^}]*System\.out\.print", 0.35, True),
    ],
    "csharp": [
        (r"^(?:public|private|internal)\s+(?:partial\s+)?class\s+\w+", 0.4),
        (r"^namespace\s+[\w.]+", 0.4),
        (r"^using\s+[\w.]+;", 0.3),
        (r"Console\.Write(?:Line)?\s*\(", 0.35),
        (r"\[(?:Serializable|Obsolete|DllImport|Attribute)\]", 0.3),
        (r"get\s*\{|set\s*\{|get;|set;", 0.3),
        (r"(?:async\s+)?Task<\w+>", 0.3),
    ],
    "cpp": [
        (r"^#include\s*<[\w./]+>", 0.35),
        (r'^#include\s*"[\w./]+"', 0.3),
        (r"^using\s+namespace\s+\w+;", 0.4),
        (r"std::\w+", 0.3),
        (r"cout\s*<<|cin\s*>>", 0.35),
        (r"^template\s*<", 0.4),
        (r"nullptr|auto\s+\w+\s*=", 0.25),
        (r"::\s*\w+\s*\(", 0.2),
        ('unique_ptr<|shared_ptr<|weak_ptr<|make_unique<|make_shared<', 0.4),
        (r"^\s*(?:public|private|protected)\s*:", 0.35),
        (r"virtual\s+\w+\s+\w+\s*\(|override\s*[;{]", 0.35),
        (r"\[[^\]]*\]\s*\([^)]*\)\s*(?:->|\{)", 0.35),
        (r"for\s*\(\s*(?:auto|const\s+auto)[&\s]+\w+\s*:\s*\w+", 0.35),
        ('std::(?:vector|map|unordered_map|set|list|deque|array)<', 0.35),
        (r"^namespace\s+\w+\s*\{", 0.35),
        (r"^class\s+\w+\s*:\s*(?:public|private|protected)\s+\w+", 0.35),
    ],
    "c": [
        (r"^#include\s*<\w+\.h>", 0.35),
        (r"^int\s+main\s*\(", 0.35),
        (r"printf\s*\(|scanf\s*\(", 0.3),
        (r"malloc\s*\(|free\s*\(|sizeof\s*\(", 0.3),
    ],
    "ruby": [
        (r"""^require\s+[\'"][\w/]+[\'"]""", 0.35),
        (r"^require_relative\s+", 0.4),
        (r"^class\s+\w+(?:\s*<\s*\w+)?", 0.3),
        (r"^module\s+\w+", 0.35),
        (r"^\s*def\s+\w+(?:\s*\([^)]*\))?", 0.3),
        (r"@\w+\s*=", 0.25),
        ('attr_(?:reader|writer|accessor)', 0.4),
        (r"\.each\s*do\s*\|", 0.3),
        (r"""puts\s+[\'"]|puts\s+\w+""", 0.25),
        (r"end\s*$", 0.15),
    ],
    "php": [
        (r"^<\?php", 0.5),
        (r"^\$\w+\s*=", 0.25),
        (r"^function\s+\w+\s*\([^)]*\)", 0.3),
        (r"^class\s+\w+(?:\s+extends\s+\w+)?", 0.3),
        (r"""echo\s+[\'"\$]""", 0.3),
        (r"\$this->\w+", 0.35),
        (r"->\w+\s*\(", 0.2),
    ],
    "bash": [
        ('^#!/bin/(?:ba)?sh', 0.5),
        (r"^#!/usr/bin/env\s+(?:ba)?sh", 0.5),
        (r"""^\s*\w+=(?:\$\(|[\'"])""", 0.25),
        (r"\$\{\w+\}|\$\w+", 0.2),
        (r"\|\s*grep|\|\s*awk|\|\s*sed|\|\s*cut", 0.3),
        (r"^\s*if\s+\[\[?\s+", 0.3),
        (r"^\s*for\s+\w+\s+in\s+", 0.3),
        (r"^\s*function\s+\w+\s*\(\s*\)|^\s*\w+\s*\(\s*\)\s*\{", 0.3),
    ],
    "sql": [
        (r"^SELECT\s+(?:DISTINCT\s+)?\*?\s*(?:\w+|\w+\.\w+)", 0.4),
        (r"^INSERT\s+INTO\s+\w+", 0.4),
        (r"^UPDATE\s+\w+\s+SET", 0.4),
        (r"^DELETE\s+FROM\s+\w+", 0.4),
        (r"^CREATE\s+(?:TABLE|INDEX|VIEW|DATABASE)", 0.4),
        (r"^ALTER\s+TABLE\s+\w+", 0.4),
        (r"FROM\s+\w+\s+(?:WHERE|JOIN|GROUP BY|ORDER BY)", 0.3),
        (r"INNER\s+JOIN|LEFT\s+JOIN|RIGHT\s+JOIN|OUTER\s+JOIN", 0.35),
    ],
    "html": [
        (r"^<!DOCTYPE\s+html", 0.5),
        (r"<html(?:\s+[^>]*)?>|</html>", 0.4),
        (r"<head>|<body>|<div\s|<span\s|<p\s|<a\s", 0.25),
    ],
    "css": [
        (r"^\s*\.\w+\s*\{", 0.3),
        (r"^\s*#\w+\s*\{", 0.3),
        (r"@media\s*\(|@keyframes\s+\w+|@import\s+", 0.35),
        (r"(?:color|background|margin|padding|font-size)\s*:", 0.25),
    ],
    "yaml": [
        (r"^---\s*$", 0.3),
        (r"^\w+:\s*$", 0.2),
        (r"^\s+-\s+\w+", 0.2),
    ],
    "json": [
        (r"^\s*\{", 0.2),
        (r"^\s*\[", 0.2),
        (r'"[\w-]+"\s*:', 0.25),
    ],
    "markdown": [
        (r"^#{1,6}\s+.+$", 0.25),
        (r"^\s*[-*+]\s+\w+", 0.15),
        (r"\[.+\]\(.+\)", 0.2),
        (r"```\w*\n", 0.25),
    ],
    "kotlin": [
        (r"^fun\s+\w+\s*\(", 0.35),
        (r"^data\s+class\s+\w+", 0.4),
        (r"^(?:open\s+|sealed\s+)?class\s+\w+\s*\([^)]+\)", 0.35),
        (r"val\s+\w+\s*:", 0.25),
        (r"var\s+\w+\s*:", 0.25),
        (r"println\s*\(|print\s*\(", 0.2),
        (r"suspend\s+fun|runBlocking|launch\s*\{", 0.35),
        (r"object\s+\w+\s*:", 0.3),
    ],
    "swift": [
        (r"^(?:public\s+|private\s+|internal\s+)?func\s+\w+\s*\([^)]*\)\s*->\s*\w+", 0.4),
        (r"^(?:public\s+|private\s+|internal\s+)?func\s+\w+\s*\([^)]*\)\s*\{", 0.3),
        (r"^(?:public\s+|private\s+)?(?:class|struct)\s+\w+\s*:\s*\w+(?:\s*,\s*\w+)*\s*\{", 0.35),
        (r"^\s*let\s+\w+\s*:\s*\w+\s*=", 0.3),
        (r"^\s*var\s+\w+\s*:\s*\w+\s*=", 0.3),
        (r"guard\s+let\s+\w+\s*=", 0.35),
        (r"if\s+let\s+\w+\s*=", 0.35),
        (r"\?\?|\?\.\w+", 0.25),
        (r'print\s*\("[^"]*\\?\([^)]*\)[^"]*"\)', 0.3),
        ('@(?:IBOutlet|IBAction|objc|available)', 0.4),
    ],
}
SHARED = [
    (r"^\s*class\s+\w+", 0.15),
    (r"^import\s+", 0.1),
    (r"function\s+\w+", 0.1),
    ('=>', 0.1),
    (r"\{[^}]+\}", 0.05),
    (r";\s*$", 0.05),
    (r"//.*$|/\*.*?\*/", 0.05),
    ('#.*$', 0.05),
]
SPECIAL = {
    "Makefile": "makefile",
    "makefile": "makefile",
    "GNUmakefile": "makefile",
    "Dockerfile": "dockerfile",
    "dockerfile": "dockerfile",
    "Containerfile": "dockerfile",
    "Vagrantfile": "ruby",
    "Gemfile": "ruby",
    "Rakefile": "ruby",
    "Jenkinsfile": "groovy",
    "BUILD": "starlark",
    "WORKSPACE": "starlark",
    ".gitignore": "gitignore",
    ".dockerignore": "dockerignore",
    ".editorconfig": "editorconfig",
    "CMakeLists.txt": "cmake",
    "package.json": "json",
    "tsconfig.json": "json",
    "requirements.txt": "requirements",
    "Pipfile": "toml",
    "pyproject.toml": "toml",
    "Cargo.toml": "toml",
    "go.mod": "gomod",
    "go.sum": "gosum",
}
EXTENSIONS = {
    "python": ".py .pyi .pyw .pyx",
    "rust": ".rs",
    "go": ".go",
    "typescript": ".cts .mts .ts .tsx",
    "javascript": ".cjs .js .jsx .mjs",
    "java": ".java",
    "csharp": ".cs .csx",
    "cpp": ".c++ .cc .cpp .cxx .h++ .hpp .hxx",
    "c": ".c .h",
    "ruby": ".gemspec .rake .rb",
    "php": ".php .php3 .php4 .php5 .php7 .phtml",
    "bash": ".bash .sh .zsh",
    "sql": ".sql",
    "html": ".htm .html .xhtml",
    "css": ".css",
    "yaml": ".yaml .yml",
    "json": ".json .jsonl",
    "markdown": ".markdown .md .mdown",
    "kotlin": ".kt .kts",
    "swift": ".swift",
}
ORDER = "python javascript typescript java go rust cpp c csharp php ruby bash sql html css yaml json markdown kotlin swift".split()
INTERPRETERS = [("python3?", "python"), ("node", "javascript"), ("ruby", "ruby"), ("perl", "perl"), ("php", "php"), ("bash", "bash"), ("sh", "bash"), ("zsh", "bash")]
MODES = {"python3": "python", "js": "javascript", "ts": "typescript", "golang": "go", "sh": "bash", "zsh": "bash"}
EMBEDDED = [
    ("javascript", r"<script(?:\s+[^>]*)?>.*?</script>"),
    ("css", r"<style(?:\s+[^>]*)?>.*?</style>"),
    ("php", r"<\?(?:php|=)"),
    ("jinja", r"\{\{.*?\}\}|\{%.*?%\}"),
    ("erb", r"<%=?.*?%>"),
]
VUE = r"<template>.*?</template>"
SURE, EARLY = 0.95, 0.90


def _flags(dotall: bool = False) -> str:
    return "(?mids)" if dotall else "(?mid)"


def language_of_extension(ext: Column) -> Column:
    pairs = [(e, lang) for lang, es in EXTENSIONS.items() for e in es.split()]
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in dict(pairs).items() for x in kv]), ext)


def embedded(content: Column) -> Column:
    """Languages embedded in a document, in a fixed order."""
    found = F.array(*[F.when(content.rlike(_flags(True) + p), lang) for lang, p in EMBEDDED])
    found = F.filter(found, lambda x: x.isNotNull())
    vue = F.array_union(found, F.array(F.lit("javascript"), F.lit("css")))
    return F.when(content.rlike(_flags(True) + VUE), vue).otherwise(found)


def _by_shebang(content: Column) -> Column:
    who = F.lower(F.regexp_extract(F.substring(content, 1, 500), r"^#!\s*(?:/usr/bin/env\s+)?(?:\S*/)?(\w+)", 1))
    out = F.lit(None).cast("string")
    for pattern, lang in reversed(INTERPRETERS):
        out = F.when(who.rlike(f"^{pattern}"), lang).otherwise(out)
    return out


def _by_modeline(content: Column) -> Column:
    lines = F.split(content, "\n")
    text = F.array_join(F.concat(F.slice(lines, 1, 5), F.slice(lines, F.greatest(-F.size(lines), F.lit(-5)), F.lit(5))), "\n")
    vim, emacs = F.regexp_extract(text, r"vim:.*(?:ft|filetype)=(\w+)", 1), F.regexp_extract(text, r"-\*-.*mode:\s*(\w+).*-\*-", 1)
    named = F.lower(F.when(vim != "", vim).otherwise(emacs))
    lang = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv]), named), named)
    return F.when(lang.isin(*PATTERNS), lang)


def detect(df: DataFrame, path: str | None, content: str) -> DataFrame:
    """Add ``language``, ``confidence``, ``method``, ``is_code`` and ``embedded``.

    The scores of all languages are built-in pattern tests in one projection; the
    first language in order with a score of 0.9 wins outright (that of the extension
    goes first), else the highest score, the earlier one on a tie.
    """
    c = F.coalesce(F.col(content), F.lit(""))
    name = F.element_at(F.split(F.col(path), "/"), -1) if path else F.lit(None).cast("string")
    ext = F.lower(F.regexp_extract(F.regexp_replace(name, r"^\.+", ""), r"(\.[^.]+)$", 1))
    special = F.try_element_at(F.create_map(*[F.lit(x) for kv in SPECIAL.items() for x in kv]), name)
    hits = []
    for lang in ORDER:
        tests = [(F.when(c.rlike(_flags(bool(p[2:])) + p[0]), F.lit(float(p[1]))).otherwise(0.0)) for p in PATTERNS[lang]]
        hits.append(F.array(*tests))
    shared = F.lit(0.0)
    for p, w in SHARED:
        shared = shared + F.when(c.rlike(_flags() + p), w).otherwise(0.0)
    df = df.withColumns({"__hits": F.array(*hits), "__shared": F.round(shared, 6), "__hint": language_of_extension(ext), "__special": special, "__bang": _by_shebang(c), "__mode": _by_modeline(c)})
    scores = F.transform("__hits", lambda h: F.struct(F.round(F.aggregate(h, F.lit(0.0), lambda a, x: a + x), 6).alias("s"), F.size(F.filter(h, lambda x: x > 0)).alias("n")))
    ranked = F.zip_with(scores, F.array(*[F.lit(x) for x in ORDER]), lambda x, y: F.struct(x["s"].alias("s"), x["n"].alias("n"), y.alias("l")))
    hinted = F.concat(F.filter(ranked, lambda x: x["l"] == F.col("__hint")), F.filter(ranked, lambda x: F.coalesce(x["l"] != F.col("__hint"), F.lit(True))))
    df = df.withColumn("__r", hinted)
    first = F.get(F.filter("__r", lambda x: x["s"] >= EARLY), F.lit(0))
    top = F.array_max(F.transform("__r", lambda x: x["s"]))
    best = F.coalesce(first, F.get(F.filter("__r", lambda x: (x["s"] == top) & (x["s"] > 0)), F.lit(0)))
    df = df.withColumn("__b", F.when(F.trim(F.regexp_replace(c, r"\s", "")) != "", best))
    s, n = F.col("__b.s"), F.col("__b.n")
    conf = F.least(0.5 + F.least(s, F.lit(0.45)) + F.when(n >= 3, 0.05).otherwise(0.0) + F.when(n >= 5, 0.05).otherwise(0.0), F.lit(0.95))
    conf = F.when(F.col("__b.l") == F.col("__hint"), F.greatest(conf, F.lit(0.80))).otherwise(conf)
    blank = F.regexp_replace(c, r"\s", "") == ""
    loose = ~blank & (F.col("__shared") > 0.15)
    by_content = F.when(F.col("__b").isNotNull(), F.struct(F.col("__b.l").alias("language"), conf.alias("confidence"), ((conf >= 0.4) | (s > 0.3)).alias("is_code"))).otherwise(
        F.struct(F.when(loose, "code").alias("language"), F.when(blank, 0.0).when(loose, F.least(F.col("__shared") + 0.1, F.lit(0.4))).otherwise(0.1).alias("confidence"), loose.alias("is_code"))
    )
    df = df.withColumn("__c", by_content)
    pick = lambda lang, conf, method, code: F.struct(lang.alias("language"), F.round(conf, 6).alias("confidence"), F.lit(method).alias("method"), code.alias("is_code"))
    yes = F.lit(True)
    out = (
        F.when(F.col("__special").isNotNull(), pick(F.col("__special"), F.lit(SURE), "special_file", yes))
        .when(F.col("__bang").isNotNull(), pick(F.col("__bang"), F.lit(0.90), "shebang", yes))
        .when(F.col("__mode").isNotNull(), pick(F.col("__mode"), F.lit(0.90), "modeline", yes))
        .when(F.col("__hint").isNotNull(), pick(F.col("__hint"), F.greatest(F.lit(0.85), F.col("__c.confidence")), "extension", yes))
        .otherwise(pick(F.col("__c.language"), F.col("__c.confidence"), "content", F.col("__c.is_code")))
    )
    df = df.withColumn("__o", out)
    keep = [x for x in df.columns if not x.startswith("__")]
    return df.select(*keep, "__o.language", "__o.confidence", "__o.method", "__o.is_code", embedded(c).alias("embedded"))
