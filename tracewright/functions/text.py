"""Text normalisers as Column expressions: no user-defined functions.

Python's and Java's regular expressions differ in their classes; ``(?U)`` makes Java's
``\\d``, ``\\s`` and ``\\b`` follow Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masks of a command template, applied in this order.
URL = r"""https?://[^\s'"]+"""
QUOTED = r"""(?s)(['"]).*?\1"""
ABSOLUTE_PATH = r"""(?U)(?:[A-Za-z]:[\\/]|/)[^\s'"]+"""
HASH = r"(?U)\b[0-9a-fA-F]{7,40}\b"
NUMBER = r"(?U)\b\d+\b"
MASKS = [(URL, "<URL>"), (QUOTED, "<STR>"), (ABSOLUTE_PATH, "<PATH>"), (HASH, "<HASH>"), (NUMBER, "<N>")]

# Words that make a command look like a check.
GUARD_WORDS = ["test", "lint", "format", "prettier", "eslint", "ruff", "mypy", "tsc", "typecheck", "vitest", "jest", "pytest", "validate", "build", "gofmt", "clippy", "black", "flake8"]

# Line classes of plan documents.
STEP_LINE = r"(?iU)^\s*(?:\d+[.)]|[-*]\s|#{2,4}\s*(?:step|phase|stage))"
TITLE_LINE = r"(?U)^#\s+(.*)$"
HEADING_LINE = r"(?U)^#{2,3}\s+(.*)$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def command_template(c: Column) -> Column:
    """A command with its volatile operands masked, at most 200 characters."""
    out = strip(F.coalesce(c, F.lit("")))
    for pattern, mask in MASKS:
        out = F.regexp_replace(out, pattern, mask)
    return F.substring(squeeze(out), 1, 200)


def prompt_key(c: Column) -> Column:
    """Clustering key of a prompt."""
    return F.substring(F.lower(command_template(c)), 1, 100)


def plan_key(c: Column) -> Column:
    """T4: clustering key of a plan title."""
    return F.substring(F.lower(command_template(c)), 1, 80)


def slugify(c: Column, most: int = 48) -> Column:
    """T5: lower-case words joined by hyphens."""
    out = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-")
    out = F.regexp_replace(F.substring(F.regexp_replace(out, "^-+|-+$", ""), 1, most), "-+$", "")
    return F.when(out == "", "candidate").otherwise(out)


def project_slug(c: Column) -> Column:
    """The last two segments of a path."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"[\\/]+"), lambda x: x != "")
    return F.when(F.size(parts) == 0, "unknown").otherwise(F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(2)), 2), "/"))


def repo_relative(path: Column, cwd: Column) -> Column:
    """The path below cwd (compared without case), else its last segment."""
    p = F.translate(F.coalesce(path, F.lit("")), "\\", "/")
    base = F.concat(F.regexp_replace(F.translate(cwd, "\\", "/"), "/+$", ""), F.lit("/"))
    below = cwd.isNotNull() & (cwd != "") & F.lower(p).startswith(F.lower(base))
    return F.when(below, F.substr(p, F.length(base) + 1)).otherwise(F.substring_index(p, "/", -1))


def slash_command(c: Column) -> Column:
    """The command of a prompt that is one, else ''."""
    return F.when(F.startswith(c, F.lit("/")), F.split(c, r"(?U)\s+")[0]).otherwise(F.lit(""))


def long_tokens(tokens: Column) -> Column:
    """Distinct tokens of three characters or more."""
    return F.array_distinct(F.filter(tokens, lambda x: F.length(x) > 2))


def white_space_tokens(c: Column) -> Column:
    return F.split(c, r"(?U)\s+")


def slug_tokens(c: Column) -> Column:
    return F.split(slugify(c), "-")


def overlap(tokens: Column, known: Column) -> Column:
    """M1: share of the (long, distinct) tokens that are known; 0 without tokens."""
    wanted = long_tokens(tokens)
    return F.when(F.size(wanted) > 0, F.round(F.size(F.array_intersect(wanted, known)) / F.size(wanted), 3)).otherwise(F.lit(0.0))


def looks_like_guard(c: Column) -> Column:
    """F16: a guard word occurs anywhere in the text."""
    return F.lower(c).rlike("|".join(GUARD_WORDS))
