"""Language and file-selection dimensions.

The tables are fixed values: they must equal the published rules for results
to agree. Everything derived from them (lexer patterns, joins) is generated.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Str:
    """A string literal form: opening mark, and how it may continue."""

    quote: str
    escape: bool = True
    multiline: bool = False
    doubled: bool = False


@dataclass(frozen=True)
class Syntax:
    """Comment and string syntax of one language family."""

    line: tuple[str, ...] = ()
    doc_line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    strings: tuple[Str, ...] = ()
    needs_space: bool = False  # line comments open only after white space
    doc_block: bool = False  # /** ... */ is API documentation
    nested: bool = False
    special: str = ""  # js | python | shell | php | yaml | rust


SINGLE, DOUBLE = Str("'"), Str('"')
RAW_SINGLE = Str("'", escape=False)
TRIPLE_DOUBLE = Str('"""', multiline=True)
TRIPLE_SINGLE = Str("'''", multiline=True)
C_BLOCK = (("/*", "*/"),)

# ---- fixed values: syntax per language ------------------------------------
_JS = Syntax(line=("//",), block=C_BLOCK, strings=(SINGLE, DOUBLE), doc_block=True, special="js")
_JVM = Syntax(line=("//",), block=C_BLOCK, strings=(TRIPLE_DOUBLE, DOUBLE, SINGLE), doc_block=True)
_HASH = Syntax(line=("#",), strings=(SINGLE, DOUBLE), needs_space=True)

SYNTAX: dict[str, Syntax] = {
    "javascript": _JS,
    "typescript": _JS,
    "python": Syntax(
        line=("#",), strings=(TRIPLE_DOUBLE, TRIPLE_SINGLE, DOUBLE, SINGLE), special="python"
    ),
    "css": Syntax(block=C_BLOCK, strings=(SINGLE, DOUBLE), doc_block=True),
    "scss": Syntax(line=("//",), block=C_BLOCK, strings=(SINGLE, DOUBLE), doc_block=True),
    "html": Syntax(block=(("<!--", "-->"),)),
    "c": Syntax(
        line=("//",), doc_line=("///", "//!"), block=C_BLOCK, strings=(SINGLE, DOUBLE), doc_block=True
    ),
    "java": _JVM,
    "kotlin": _JVM,
    "scala": _JVM,
    "csharp": Syntax(
        line=("//",), doc_line=("///", "//!"), block=C_BLOCK,
        strings=(TRIPLE_DOUBLE, DOUBLE, SINGLE), doc_block=True,
    ),
    "go": Syntax(
        line=("//",), block=C_BLOCK,
        strings=(DOUBLE, SINGLE, Str("`", escape=False, multiline=True)), doc_block=True,
    ),
    "rust": Syntax(
        line=("//",), doc_line=("///", "//!"), block=C_BLOCK, strings=(DOUBLE,), doc_block=True,
        nested=True, special="rust",
    ),
    "swift": Syntax(
        line=("//",), doc_line=("///", "//!"), block=C_BLOCK, strings=(TRIPLE_DOUBLE, DOUBLE),
        doc_block=True, nested=True,
    ),
    "php": Syntax(
        line=("//", "#"), block=C_BLOCK, strings=(SINGLE, DOUBLE), doc_block=True, special="php"
    ),
    "ruby": Syntax(line=("#",), block=(("=begin", "=end"),), strings=(SINGLE, DOUBLE)),
    "sql": Syntax(
        line=("--", "#"), block=C_BLOCK, strings=(Str("'", doubled=True), DOUBLE), needs_space=True
    ),
    "shell": Syntax(line=("#",), strings=(RAW_SINGLE, DOUBLE), needs_space=True, special="shell"),
    "yaml": Syntax(
        line=("#",), strings=(Str("'", escape=False, doubled=True), DOUBLE), needs_space=True,
        special="yaml",
    ),
    "toml": Syntax(
        line=("#",),
        strings=(TRIPLE_DOUBLE, Str("'''", escape=False, multiline=True), DOUBLE, RAW_SINGLE),
        needs_space=True,
    ),
    "ini": Syntax(line=("#", ";"), strings=(SINGLE, DOUBLE), needs_space=True),
    "dockerfile": _HASH,
    "makefile": _HASH,
    "lua": Syntax(line=("--",), block=(("--[[", "]]"),), strings=(SINGLE, DOUBLE)),
}

# Markup files are split into regions, each lexed with its own syntax.
MARKUP = ("html", "vue", "svelte")
# Languages whose empty `{ }` left by a removed comment is not code.
BRACE_WRAPPED = ("javascript", "typescript")

# ---- fixed values: extensions ----------------------------------------------
EXTENSIONS: dict[str, tuple[str, ...]] = {
    "javascript": (".js", ".mjs", ".cjs", ".jsx"),
    "typescript": (".ts", ".mts", ".cts", ".tsx"),
    "python": (".py", ".pyi", ".pyw"),
    "css": (".css",),
    "scss": (".scss", ".sass", ".less"),
    "html": (".html", ".htm", ".xml", ".svg", ".xhtml"),
    "vue": (".vue",),
    "svelte": (".svelte",),
    "php": (".php", ".phtml"),
    "go": (".go",),
    "java": (".java", ".dart"),
    "kotlin": (".kt", ".kts"),
    "scala": (".scala", ".sc"),
    "csharp": (".cs",),
    "ruby": (".rb", ".rake", ".gemspec"),
    "rust": (".rs",),
    "swift": (".swift",),
    "c": (".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".m", ".mm"),
    "sql": (".sql",),
    "shell": (".sh", ".bash", ".zsh", ".ksh", ".env"),
    "yaml": (".yml", ".yaml"),
    "toml": (".toml",),
    "ini": (".ini", ".cfg", ".conf", ".editorconfig"),
    "lua": (".lua",),
}
EXT_DIM = [(ext, lang) for lang, exts in EXTENSIONS.items() for ext in exts]

# ---- fixed values: whole file names, and name prefixes ---------------------
NAME_DIM = [
    ("Dockerfile", "dockerfile"),
    ("Containerfile", "dockerfile"),
    ("Makefile", "makefile"),
    ("GNUmakefile", "makefile"),
    ("Gemfile", "ruby"),
    ("Rakefile", "ruby"),
    ("Vagrantfile", "ruby"),
    (".env", "shell"),
    (".bashrc", "shell"),
    (".zshrc", "shell"),
    (".profile", "shell"),
]
NAME_PREFIXES = [("Dockerfile", "dockerfile"), (".env", "shell")]

# ---- fixed values: file selection ------------------------------------------
EXCLUDED_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "bower_components", "vendor",
    "dist", "build", "out", "target", ".next", ".nuxt", ".svelte-kit",
    "__pycache__", ".venv", "venv", "env", ".tox", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", "coverage", ".coverage", "htmlcov", ".idea", ".vscode",
    ".gradle", "Pods", "DerivedData", ".terraform",
)
EXCLUDED_SUFFIXES = (
    ".min.js", ".min.css", ".bundle.js", ".map", ".lock",
    ".generated.ts", "_pb2.py", ".pb.go", ".g.dart",
)
MAX_BYTES = 1_000_000
