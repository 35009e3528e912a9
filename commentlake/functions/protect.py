"""Why a comment must be kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentlake.functions.hof import find, let, rlike, strings, strip

# ---- fixed values: tool directives -----------------------------------------
DIRECTIVES = (
    # JavaScript and TypeScript
    r"eslint-(?:disable|enable|env)", r"\beslint\s*\{", r"jshint\b", r"jslint\b",
    r"tslint:", r"stylelint-(?:disable|enable)", r"jscs:",
    r"@ts-\w+", r"@flow\b", r"\$FlowFixMe", r"@jsx\b",
    r"prettier-ignore", r"biome-ignore", r"dprint-ignore", r"rome-ignore",
    r"deno-lint-ignore", r"oxlint-disable", r"@formatter:(?:off|on)",
    r"webpack\w+:", r"@vite-ignore", r"vite-ignore",
    r"istanbul ignore", r"\bc8 ignore", r"\bv8 ignore", r"coverage:ignore",
    r"sourceMappingURL", r"sourceURL=",
    # Python
    r"\bnoqa\b", r"type:\s*ignore", r"pylint:", r"mypy:", r"pyright:", r"\bruff:",
    r"flake8:", r"isort:", r"fmt:\s*(?:on|off|skip)", r"yapf:", r"\bnosec\b",
    r"bandit:", r"pragma:\s*no\s*cover", r"noinspection",
    # C family, JVM, Swift
    r"#\s*pragma\b", r"#\s*(?:region|endregion)\b", r"\bNOLINT",
    r"clang-format\s+(?:on|off)", r"checkstyle:", r"SuppressWarnings",
    r"@SuppressLint", r"sonar\.", r"NOSONAR",
    r"swiftlint:", r"@formatter",
    # Go
    r"go:(?:build|generate|embed|linkname|noinline|nosplit)", r"^\s*//\s*\+build",
    r"\bnolint\b",
    # Ruby and PHP
    r"rubocop:", r"frozen_string_literal:", r"typed:\s*\w+",
    r"phpcs:", r"@phpstan-", r"@psalm-", r"psalm-", r"codingStandardsIgnore",
    r"@codeCoverageIgnore",
    # Shell, infrastructure, security scanners
    r"shellcheck\s+disable", r"hadolint\b", r"yamllint\b", r"gitleaks:allow",
    r"nosemgrep", r"trivy:ignore", r"tflint-ignore", r"checkov:skip",
    r"ansible-lint", r"kics-scan",
    # Editors and generated files
    r"vim:\s*set", r"-\*-\s*\w+", r"DO NOT EDIT", r"@generated\b", r"auto-?generated",
    r"Code generated by",
)

# ---- fixed values: licence headers and work markers ------------------------
LICENSE = (
    r"SPDX-License-Identifier|copyright|\(c\)\s*\d{4}|licen[cs]ed?\b|"
    r"all rights reserved|@license|@preserve|GNU General Public|MIT License|"
    r"Apache License"
)
MARKERS = (
    "TODO", "FIXME", "HACK", "XXX", "BUG", "NOTE", "OPTIMIZE", "REVIEW", "REFACTOR",
    "DEPRECATED", "WARNING", "IMPORTANT", "CAUTION", "SAFETY", "SECURITY",
)
ANY_CASE_MARKERS = ("todo", "fixme", "hack", "bug")
HEADER_LINES = 8

SHEBANG, PRESERVED, DIRECTIVE = "shebang", "preserved", "directive"
HEADER, MARKER, API_DOC = "header", "marker", "api_doc"



def required_literal(pattern: str) -> str:
    """The longest plain text that every match of a pattern contains."""
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        ch = pattern[i]
        escaped = ch == "\\"
        if escaped:
            i += 1
            ch = pattern[i]
        if depth or (not escaped and ch in "()"):
            depth += 0 if escaped else (ch == "(") - (ch == ")")
            ch = ""
        elif (escaped and ch.isalnum()) or (not escaped and ch in "^$."):
            ch = ""
        elif not escaped and ch in "?*{+":
            run, ch = (run if ch == "+" else run[:-1]), ""
        if ch:
            run += ch
        else:
            runs.append(run)
            run = ""
        i += 1
    return max([*runs, run], key=len)


DIRECTIVE_PATTERN = "(?im)" + "|".join(DIRECTIVES)
# Both words of this group hold "region"; its plain text alone is one character.
_IN_GROUP = {r"#\s*(?:region|endregion)\b": "region"}
_LITERALS = sorted({_IN_GROUP.get(p, required_literal(p)).lower() for p in DIRECTIVES}, key=len)
DIRECTIVE_LITERALS = [
    x for i, x in enumerate(_LITERALS) if not any(y in x for y in _LITERALS[:i])
]


# Pieces that many of them share, and the others: one of these is in every text that holds one of those.
_SHARED = (":", "@", "lint")
DIRECTIVE_PIECES = [*_SHARED, *(x for x in DIRECTIVE_LITERALS if not any(y in x for y in _SHARED))]


def _holds(low: Column, pieces) -> Column:
    return F.exists(strings(pieces), lambda x: F.contains(low, x))


def is_directive(text: Column) -> Column:
    """Substring search rules out almost every comment before the regular
    expression with its eighty alternatives is tried at every character."""
    possible = let(F.lower(text), lambda low: _holds(low, DIRECTIVE_PIECES) & _holds(low, DIRECTIVE_LITERALS))
    return possible & rlike(text, DIRECTIVE_PATTERN)


LICENSE_PATTERN = "(?i)" + LICENSE
LICENSE_PIECES = ("copyright", "licen", "(c)", "spdx-", "all rights", "@preserve", "gnu general")
MARKER_PATTERN = rf"\b({'|'.join(MARKERS)})\b"
ANY_CASE_PATTERN = rf"(?i)\b({'|'.join(ANY_CASE_MARKERS)})\s*[:(\[]"


# Each search is tried only on a text that holds what all its matches hold.
def is_header(text: Column) -> Column:
    return let(F.lower(text), lambda low: _holds(low, LICENSE_PIECES)) & rlike(text, LICENSE_PATTERN)


def is_marked(text: Column) -> Column:
    strong = rlike(text, "[A-Z][A-Z][A-Z]") & rlike(text, MARKER_PATTERN)
    return strong | (rlike(text, r"[:(\[]") & rlike(text, ANY_CASE_PATTERN))


@dataclass(frozen=True)
class Protections:
    """Which classes of comments are kept; all by default."""

    directives: bool = True
    headers: bool = True
    markers: bool = True
    docs: bool = True


def reason(text: Column, line: Column, kind: Column, doc: Column, prot: Protections) -> Column:
    """Protection code of the first rule that holds, else null."""
    rules = []
    if prot.directives:
        rules += [
            (text.startswith("#!") & (line == 1), SHEBANG),
            (text.startswith("/*!"), PRESERVED),
            (is_directive(text), DIRECTIVE),
        ]
    if prot.headers:
        rules.append(((line <= HEADER_LINES) & is_header(text), HEADER))
    if prot.markers:
        rules.append((is_marked(text), MARKER))
    if prot.docs:
        rules.append((doc | (kind == "docstring"), API_DOC))
    out = F.lit(None).cast("string")
    for cond, code in reversed(rules):
        out = F.when(cond, F.lit(code)).otherwise(out)
    return out


def detail(text: Column, protected: Column) -> Column:
    """What matched: the directive, or the marker word in capitals."""
    strong = find(text, MARKER_PATTERN, 1)
    marker = F.when(strong != "", strong).otherwise(find(text, ANY_CASE_PATTERN, 1))
    return (
        F.when(protected == DIRECTIVE, strip(find(text, DIRECTIVE_PATTERN)))
        .when(protected == MARKER, F.upper(marker))
    )
