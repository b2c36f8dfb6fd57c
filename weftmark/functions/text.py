"""Column helpers for Python-compatible text handling.

Everything here returns a ``Column`` built from native Spark SQL functions, so
it stays inside whole-stage codegen; there is no Python UDF.

Java regex differs from Python's ``re`` in three ways that matter here and are
handled by the flags and classes below:
* ``str.strip`` and Python's ``\\s`` also treat U+001C..U+001F as whitespace;
  Java's ``(?U)\\s`` does not, so the whitespace class is written out.
* ``$`` and ``.`` must only treat ``\\n`` as a line end (``(?d)``).
* ``\\w`` / ``\\b`` / case folding must be Unicode-aware (``(?U)``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's for identical output).
# Python's str.isspace() set, spelled out so Java and RE2 agree on it.
WS = (
    "\\t\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x1f \\x85\\xa0\\x{1680}"
    "\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
)
WS_CLASS = f"[{WS}]"
# whitespace except the newline, used for per-line stripping
HWS_CLASS = (
    "[\\t\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x1f \\x85\\xa0\\x{1680}"
    "\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)

TRUNCATION_SUFFIX = "\n\n... [content truncated]"
DEFAULT_MAX_LENGTH = 100000

# Noise patterns, applied in this order with IGNORECASE | MULTILINE.
NOISE_PATTERNS = [
    ("top_stories", r"info\s*The top.*?preferences\."),
    ("favorite_repeat", r"(\b\w+\s+favorite\b)\s+\1"),
    ("cookie_notice", r"(?:We use cookies|This site uses cookies|By continuing|Accept all cookies).*?(?:\.|$)"),
    ("footer_repeat", r"(\b(?:copyright|all rights reserved|privacy policy|terms of service)\b.*?)\s+\1"),
    ("share_buttons", r"(?:Share on|Follow us on|Connect with us).*?(?:Facebook|Twitter|LinkedIn|Instagram)"),
    ("newsletter", r"(?:Subscribe|Sign up|Newsletter|Email updates).*?(?:newsletter|updates|alerts)"),
    ("breadcrumb_repeat", r"(\bHome\s*>\s*.*?)\s+\1"),
]
# Literals each pattern needs (one of them, case-insensitively) before it can match.
NOISE_REQUIRED = {
    "top_stories": ["preferences"],
    "favorite_repeat": ["favorite"],
    "cookie_notice": ["we use cookies", "this site uses cookies", "by continuing", "accept all cookies"],
    "footer_repeat": ["copyright", "all rights reserved", "privacy policy", "terms of service"],
    "share_buttons": ["share on", "follow us on", "connect with us"],
    "newsletter": ["subscribe", "sign up", "newsletter", "email updates"],
    "breadcrumb_repeat": ["home"],
}
# Non-ASCII letters that case-insensitively match an ASCII letter of those literals.
CASE_FOLD_SPECIALS = ["\u017f", "\u0131", "\u0130", "\u212a"]
# Java flags giving Python `re` semantics for the patterns above.
_JAVA_FLAGS = "(?imdU)"


def _java_pattern(pat: str) -> str:
    """Python `\\s` includes U+001C..U+001F; make Java's agree."""
    return _JAVA_FLAGS + pat.replace(r"\s", WS_CLASS)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(pairs: dict[str, str]) -> Column:
    """A constant map as one small expression, which the optimizer folds; a map of hundreds of literals
    slows every rule of every plan that holds it. Keys and values hold neither U+E000 nor U+E001."""
    assert not any("\ue000" in x or "\ue001" in x for kv in pairs.items() for x in kv)
    return F.str_to_map(F.lit("\ue000".join(f"{k}\ue001{v}" for k, v in sorted(pairs.items()))), F.lit("\ue000"), F.lit("\ue001"))


# The characters Python's str.strip() removes, derived from str.isspace() (the same set as WS).
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def py_strip(c) -> Column:
    """Python ``str.strip()`` (P1, N10): ``btrim`` with Python's whitespace set (no regex scan)."""
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def is_blank(c) -> Column:
    """True when ``str.strip()`` would give the empty string (null counts as blank)."""
    return F.coalesce(F.length(py_strip(c)) == 0, F.lit(True))


def token_estimate(c) -> Column:
    """P5: 0 for empty text, else max(1, len // 4); code points, as BIGINT."""
    n = F.coalesce(F.length(_col(c)), F.lit(0)).cast("bigint")
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(1).cast("bigint"), F.floor(n / 4).cast("bigint")))


def truncate_content(content, truncate, max_length) -> Column:
    """Cut to ``max_length`` code points and append the suffix.

    Invalid or non-positive limits leave the content as it is.
    """
    content = _col(content)
    ml = _col(max_length).cast("bigint")
    cut = (
        F.coalesce(_col(truncate), F.lit(True))
        & ml.isNotNull()
        & (ml > 0)
        & (F.length(content) > ml)
    )
    head = content.substr(F.lit(1), ml.cast("int"))
    return F.when(cut, F.concat(head, F.lit(TRUNCATION_SUFFIX))).otherwise(content)


def normalize_lines(c) -> Column:
    """Strip every line, keep at most one blank line in a row, strip the whole."""
    s = F.array_join(F.transform(F.split(_col(c), "\n"), py_strip), "\n")
    s = F.regexp_replace(s, "\\n{3,}", "\n\n")
    return py_strip(s)


def noise_step(c, name: str) -> Column:
    pat = dict(NOISE_PATTERNS)[name]
    return F.regexp_replace(_col(c), _java_pattern(pat), "")


def noise_may_match(c, names) -> Column:
    """False only when none of the selected patterns can match ``c``.

    Each pattern needs one of its literals (case-insensitively). If the text holds
    one of the few non-ASCII letters that fold onto ASCII ones, assume a match.
    """
    c = _col(c)
    low = F.lower(c)
    cond = F.lit(False)
    for ch in CASE_FOLD_SPECIALS:
        cond = cond | c.contains(ch)
    for name in names:
        for lit in NOISE_REQUIRED[name]:
            cond = cond | low.contains(lit)
    return cond


def noise_filter(c, patterns: list[str] | None = None) -> Column:
    """The sequential boilerplate filter, all native ``regexp_replace``.

    ``patterns`` selects a subset of N1-N7 by name (all by default); N8-N10 always run.
    """
    src = _col(c)
    names = [n for n, _ in NOISE_PATTERNS if patterns is None or n in patterns]
    s = src
    for name in names:
        s = noise_step(s, name)
    # Exact shortcut: when no pattern can match the input, step 1 leaves it as it is,
    # so step 2 sees the same text and cannot match either, and so on; the whole
    # chain is the identity and its regex scans are skipped.
    s = F.when(noise_may_match(src, names), s).otherwise(src)
    s = F.regexp_replace(s, f"(?U)\\n{WS_CLASS}*\\n{WS_CLASS}*\\n", "\n\n")
    s = F.regexp_replace(s, "[ \\t]+", " ")
    s = py_strip(s)
    # Empty (or null) input is returned unchanged
    return F.when(src.isNull() | (src == ""), src).otherwise(s)


def noise_hits(c, name: str) -> Column:
    """Number of matches of one noise pattern (X3 audit)."""
    pat = dict(NOISE_PATTERNS)[name]
    return F.regexp_count(_col(c), F.lit(_java_pattern(pat)))
