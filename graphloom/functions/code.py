"""Source files as columns: language, role, symbols, headings, URL and HTML facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension.
LANGUAGES = {
    "typescript": ("ts", "tsx", "mts", "cts"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "python": ("py",),
    "go": ("go",),
    "rust": ("rs",),
    "java": ("java",),
    "kotlin": ("kt",),
    "ruby": ("rb",),
    "php": ("php",),
    "csharp": ("cs",),
    "swift": ("swift",),
    "c": ("c", "h"),
    "cpp": ("cc", "cpp", "cxx", "hpp"),
    "shell": ("sh", "bash", "zsh"),
    "markdown": ("md", "mdx"),
    "json": ("json",),
    "yaml": ("yaml", "yml"),
    "toml": ("toml",),
    "sql": ("sql",),
}

# The first pattern that a lower-cased path has decides its role; "source" else.
ROLES = (
    ("test", r"(^|/)(test|tests|__tests__|spec)/|\.(test|spec)\.[a-z]+$"),
    ("documentation", r"\.mdx?$|(^|/)(docs?|adr)/"),
    ("config", r"\.(json|ya?ml|toml)$"),
    ("ui_component", r"(^|/)(pages|app|components|ui|views)/(.*)\.(tsx|jsx|vue|svelte)$"),
    ("api_route", r"(^|/)(api|routes?|handlers?|controllers?)/"),
    ("entrypoint", r"(^|/)(bin|cli|scripts?)/|(^|/)(main|index|cli)\.[a-z]+$"),
    ("config", r"(^|/)\.[^/]*$|\.(example|sample|template|dist|lock)$|(^|[/.\-_])env([.\-_][^/]*)?$"),
    ("config", r"(^|/)(constants?|config|configuration|settings?|env|types?|schema|enums?)(\.[a-z0-9]+)?$|(^|/)(config|constants?|settings)/"),
)

# What a language exports, defines and imports; group 1 is the name.
SYMBOLS = {
    "typescript": {
        "exported": r"export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)",
        "local": r"(?m)^\s*(?:(?:async\s+)?function|class)\s+([A-Za-z_$][\w$]*)",
        "imports": "(?:import[^\"']*?from\\s*|require\\(\\s*)[\"']([^\"']+)[\"']",
    },
    "python": {"exported": r"(?m)^\s*(?:def|class)\s+([A-Za-z]\w*)", "local": r"(?m)^\s*(?:def|class)\s+([A-Za-z_]\w*)", "imports": r"(?m)^\s*(?:from|import)\s+([\w.]+)"},
    "go": {"exported": r"(?m)^func\s+(?:\([^)]*\)\s*)?([A-Z]\w*)", "local": r"(?m)^(?:type|func)\s+([A-Za-z_]\w*)", "imports": r'"\s*([\w.-]*/[\w./-]*)\s*"'},
    "rust": {"exported": r"pub\s+(?:fn|struct|enum|trait|mod|const)\s+([A-Za-z_]\w*)", "local": r"(?:fn|struct|enum|trait|mod)\s+([A-Za-z_]\w*)", "imports": r"use\s+([\w:]+)"},
    "java": {"exported": r"public\s+(?:final\s+|abstract\s+|static\s+)*(?:class|interface|enum|record)\s+([A-Za-z_]\w*)", "local": r"(?:class|interface|enum)\s+([A-Za-z_]\w*)", "imports": r"import\s+([\w.]+)"},
    "c": {"exported": None, "local": r"(?m)^[A-Za-z_][\w<>:\s\*&]*\s+([A-Za-z_]\w*)\s*\([^;{]*\)\s*\{", "imports": r'#include\s*[<"]([^>"]+)[>"]'},
    "shell": {"exported": None, "local": r"(?m)^\s*(?:function\s+)?([A-Za-z_]\w*)\s*\(\)\s*\{", "imports": None},
}
SAME_SYMBOLS = {"javascript": "typescript", "kotlin": "java", "csharp": "java", "cpp": "c"}
MOST_SYMBOLS, MOST_HEADINGS, MOST_ALIASES = 64, 8, 24


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(basename(path), r".\.([^.]+)$", 1))
    out = F.lit("text")
    for name, exts in LANGUAGES.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def role(path: Column) -> Column:
    low = F.lower(path)
    return F.coalesce(*(F.when(low.rlike(pattern), name) for name, pattern in ROLES), F.lit("source"))


def symbols(lang: Column, text: Column, kind: str) -> Column:
    """Distinct names in order of first appearance, at most ``MOST_SYMBOLS``."""
    out = F.array().cast("array<string>")
    for name, patterns in SYMBOLS.items():
        if patterns[kind]:
            names = [name, *(k for k, v in SAME_SYMBOLS.items() if v == name)]
            out = F.when(lang.isin(names), F.regexp_extract_all(text, F.lit(patterns[kind]), F.lit(1))).otherwise(out)
    if kind == "exported":  # lists: a name and what it is called outside, of which the first counts
        lists = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"export\s*\{([^}]+)\}"), F.lit(1)), lambda x: F.split(x, ",")))
        named = F.transform(lists, lambda x: F.regexp_extract(x, r"^\s*([^\s,]*)", 1))
        out = F.when(lang.isin("typescript", "javascript"), F.concat(out, named)).otherwise(out)
    return F.slice(F.array_distinct(F.filter(out, lambda x: x != "")), 1, MOST_SYMBOLS)


def headings(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?m)^#{1,3}\s+(.+)$"), F.lit(1))
    return F.slice(F.transform(found, F.trim), 1, MOST_HEADINGS)


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))
