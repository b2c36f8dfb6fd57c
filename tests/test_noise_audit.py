"""X3 runs each pattern once over a text, and counts as a document-by-document audit does."""

import re
from collections import defaultdict

from weftmark.functions.text import NOISE_PATTERNS
from weftmark.plans.reports import noise_audit

DOCS = [
    ("a", "We use cookies here. x\nSubscribe to our newsletter and Share on Facebook"),
    ("a", "plain text"),
    ("a", "info The top stories. Set preferences. my favorite my favorite"),
    ("b", "privacy policy y privacy policy y Home > a Home > a"),
    ("b", "ſubscribe for alerts"),
    ("b", None),
    ("b", ""),
    ("c", None),
    (None, "Email updates now: alerts"),
]


def test_noise_audit_matches_python(spark):
    want = defaultdict(lambda: [None, None, 0])
    for host, s in DOCS:
        for name, pat in NOISE_PATTERNS:
            row = want[host, name]
            if s is not None:
                found = re.findall(pat, s, re.I | re.M)
                after = re.sub(pat, "", s, flags=re.I | re.M)
                row[:] = (row[0] or 0) + len(found), (row[1] or 0) + len(s) - len(after), row[2] + bool(found)
                s = after
    got = {(r.host, r.pattern): [r.hits, r.removed_chars, r.documents_hit] for r in noise_audit(spark.createDataFrame(DOCS, "host string, content string")).collect()}
    assert got == dict(want)
    assert any(v[0] for v in got.values())


def test_each_pattern_is_written_once(spark):
    """Before, the text that a pattern saw held all earlier patterns again, for each of its uses."""
    plan = noise_audit(spark.createDataFrame(DOCS, "host string, content string").repartition(2))._jdf.queryExecution().optimizedPlan().toString()
    assert 7 <= plan.count("regexp_replace(") <= 14
    assert "explode" in plan and plan.index("explode") < plan.index("Aggregate")
