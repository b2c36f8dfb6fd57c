"""One query for each corpus operator, over whole tables with production parameters.

Each query applies its operator and derives the contract's digest columns from the
operator's output. ``ORACLES`` holds DuckDB statements where SQL can express the result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.llm.common import BLANK_CLASS, fold, fresh_path, staged, table
from weftmark.llm.decontaminate import find_contamination
from weftmark.llm.line_dedup import line_dedup
from weftmark.llm.mixing import mix_sources, source_weights, word_count
from weftmark.llm.packing import pack_documents
from weftmark.llm.pivot_search import exact_top_k
from weftmark.llm.quality_fm import fit_quality, with_quality
from weftmark.llm.quality_rules import STOP_WORDS, quality_rules
from weftmark.llm.rans import read_token_file, write_token_file
from weftmark.llm.runs import collapse_runs
from weftmark.llm.simhash import simhash_components
from weftmark.llm.toxicity import fit_toxicity, with_toxicity
from weftmark.llm.url_filter import UrlRule, canonical_url, url_filter, url_parts
from weftmark.llm.whitening import whiten

URL_RULES = [
    UrlRule("net/", "block"),
    UrlRule("example.net/en/", "allow"),
    UrlRule("example.com/de/", "block"),
    UrlRule("org/fr/", "allow"),
]
#: Pages on hosts with these words, and canonical URLs that several pages share, make the list.
UNWANTED_HOSTS = "casino|bets|pills"
#: Weights half-way to the greatest entropy, over three quarters of the tokens.
MIX = {"entropy_gain": 0.5, "budget_share": 0.75}


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_documents=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), folds=4, held_out_fold=2)
    scored = with_quality(docs.withColumn("held_out", fold("doc_id", 4) == 2), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-file")
    write_token_file(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_pack_gga(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048, keep_ids=False).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50, max_repeat_percent=50)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix_sources(docs, **MIX)
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_order", "mix_weight", "mix_repeats")


def mix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and quota of each source that op8 realises."""
    docs = table(spark, sf_dir, "documents")
    counts = staged(docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
        F.sum(word_count(F.col("text"))).alias("tokens"), F.count("*").alias("rows")), "mix-sources")
    return source_weights(counts, **MIX).select("source", "tokens", F.round("weight", 8).alias("weight"), F.round("repeats", 8).alias("repeats"), "full", "rest")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    parts = url_parts(F.col("url"))
    found = pages.select(canonical_url(parts["host"], parts["path"]).alias("canonical"), parts["host"].rlike(UNWANTED_HOSTS).alias("unwanted"))
    listed = found.groupBy("canonical").agg(F.count("*").alias("n"), F.max("unwanted").alias("unwanted")).filter("n > 1 or unwanted")
    return url_filter(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), folds=5, held_out_fold=0)
    scored = with_toxicity(docs.withColumn("held_out", fold("doc_id", 5) == 0), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """The contract's texts for op11: where crc32 of the id ends in 0, the words from one place on repeat with a period."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    w, n = F.col("w"), F.col("n")
    plain = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(
        F.coalesce("text", F.lit("")), F.lit(BLANK_CLASS.replace("[", "[^") + "+"), 0)).alias("w")).withColumn("n", F.size("w"))
    at = plain.withColumn("a", (F.col("g") % n).cast("int")).withColumn(
        "p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    a, p = F.col("a"), F.col("p")
    cycle = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(cycle, F.lit(1), n - a)), " ")
    return at.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), changed).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(with_planted_period(table(spark, sf_dir, "documents")), min_words=24, min_repeats=3)
    best = F.col("best_run")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best_run.length div best_run.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), scale=1024, shift=100_000, components=8)
    return done.select("vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c"), "n", "deviation", "identity_error").select(
        "vec_id", (F.col("k") + 1).alias("component"), "n", F.col("deviation").cast("long").alias("deviation"), "c.whitened", "c.explained", "identity_error")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_fm": op3_quality_fm,
    "op4_rans_tokens": op4_rans_tokens,
    "op5_pack_gga": op5_pack_gga,
    "op6_pivot_topk": op6_pivot_topk,
    "op7_quality_rules": op7_quality_rules,
    "op8_mix_sources": op8_mix_sources,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_runs": op11_runs,
    "op12_decontaminate": op12_decontaminate,
    "op13_whitening": op13_whitening,
    "mix_weights": mix_weights,
}

_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_ENTROPY = "(ln(list_sum(list_transform(lp, lambda x: exp({a} * x)))) - {a} * list_sum(list_transform(lp, lambda x: exp({a} * x) * x)) / list_sum(list_transform(lp, lambda x: exp({a} * x))))"

ORACLES: dict[str, str] = {
    "mix_weights": f"""
        WITH RECURSIVE s AS (SELECT coalesce(source, '') AS source, sum(greatest(1, len({_WORDS}))) AS tokens FROM documents GROUP BY 1),
             t AS (SELECT sum(tokens) AS t, count(*) AS n FROM s),
             l AS (SELECT list(ln(tokens / t) ORDER BY source) AS lp, any_value(t) AS t, any_value(n) AS n FROM s, t),
             g AS (SELECT *, {_ENTROPY.format(a="1.0")} AS found FROM l),
             b(i, lo, hi) AS (
               SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
               SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
               FROM (SELECT i, lo, hi, mid, {_ENTROPY.format(a="mid")} >= found + {MIX["entropy_gain"]} * (ln(n) - found) AS ok
                     FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE i < 45) m, g)),
             a AS (SELECT lo AS a, list_sum(list_transform(lp, lambda x: exp(lo * x))) AS z, t FROM b, g WHERE i = 45),
             w AS (SELECT source, tokens, exp(a * ln(tokens / t)) / z AS weight, exp(a * ln(tokens / t)) / z * round_even({MIX["budget_share"]} * t, 0) / tokens AS repeats FROM s, a)
        SELECT source, tokens::BIGINT AS tokens, round(weight, 8) AS weight, round(repeats, 8) AS repeats,
               (round(repeats * tokens)::BIGINT // tokens)::BIGINT AS full, (round(repeats * tokens)::BIGINT % tokens)::BIGINT AS rest FROM w""",
    "op6_pivot_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op2_line_dedup": f"""
        WITH l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], {_STRIP}), {_AZ}) AS k
                   FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
                         FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
             bad AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(bad.k)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.k IS NULL), '')) AS kept_sha256
        FROM l LEFT JOIN bad ON l.k = bad.k GROUP BY doc_id""",
    "op7_quality_rules": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
                          list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_STRIP}) <> '') AS l FROM documents),
             g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
                   FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
             r AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (
                     SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
                       SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
             s AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                          length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                          (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
                          len(l) AS n_lines, length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS caps,
                          length(regexp_replace(text, '[^!]+', '', 'g')) AS excl,
                          len(list_filter(w, lambda x: list_contains({sorted({w for x in STOP_WORDS.values() for w in x.split()})}, lower(trim(x, '.,;:!?"()'))))) AS stops,
                          len(list_filter(l, lambda x: regexp_matches(trim(x, {_STRIP}), '^[-*•]'))) AS bullets,
                          len(list_filter(l, lambda x: regexp_matches(trim(x, {_STRIP}), '(\\.\\.\\.|…)$'))) AS dots
                   FROM t LEFT JOIN r USING (doc_id)),
             b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12.0 AND n_symbols / n_words <= 0.1 AND stops / n_words >= 0.02
               AND n_dup_lines / n_lines <= 0.6 AND caps / word_chars <= 0.3 AND excl / n_words <= 0.5 AND bullets / n_lines <= 0.9
               AND dots / n_lines <= 0.5 AS kept
        FROM b""",
    "op9_url_filter": f"""
        WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
             p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
             c AS (SELECT *, regexp_replace(regexp_replace(host, '\\.?(:[0-9]*)?$', ''), '^(www|m)\\.', '') || regexp_replace(path, '(/|\\.html)$', '') AS canonical,
                          CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                               WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                               WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                               WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p),
             listed AS (SELECT canonical FROM c GROUP BY canonical HAVING count(*) > 1 OR bool_or(regexp_matches(host, '{UNWANTED_HOSTS}')))
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
               WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
        FROM c""",
    "op11_runs": f"""
        WITH c AS (SELECT doc_id, {_WORDS} AS w, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
                            string_split(doc_id::VARCHAR, ''), lambda ch: [ord(ch)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
                            lambda v, x: CASE WHEN x < 256 THEN xor(v, x) ELSE xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) AS h
                   FROM documents),
             g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS e FROM c),
             x AS (SELECT *, CASE WHEN planted THEN 1 + (n - a) // (3 + e) END AS p FROM g),
             t AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE w END AS w FROM x),
             k AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 16], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, n - 15)) AS i FROM t)),
             m AS (SELECT k.doc_id, j.i - k.i AS q, k.i FROM k JOIN k j ON k.doc_id = j.doc_id AND k.s = j.s AND j.i > k.i),
             d AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
             l AS (SELECT doc_id, min(i) AS start, count(*) + 15 + q AS length, q FROM d GROUP BY doc_id, q, island),
             r AS (SELECT doc_id, start, length, min(q) AS period FROM l WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
             o AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s,
                          first({{'start': start, 'length': length, 'period': period}} ORDER BY length / period DESC, start, period) AS b FROM r GROUP BY doc_id),
             u AS (SELECT doc_id, i, w[i + 1] AS word FROM (SELECT doc_id, w, unnest(range(0, n)) AS i FROM t)),
             z AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM u
                   WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = u.doc_id AND u.i >= r.start + r.period AND u.i < r.start + r.length) GROUP BY doc_id)
        SELECT t.doc_id, coalesce(o.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
               (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(o.s, '')) AS runs_sha256, sha256(coalesce(z.s, '')) AS collapsed_sha256
        FROM t LEFT JOIN o USING (doc_id) LEFT JOIN z USING (doc_id)""",
    "op12_decontaminate": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
             i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
             n AS (SELECT item, w, least(10, len(w)) AS l FROM i WHERE len(w) > 0),
             v AS (SELECT DISTINCT item, l, array_to_string(w[k:k + l - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS k FROM n)),
             p AS (SELECT doc_id, l, k, array_to_string(w[k:k + l - 1], ' ') AS s
                   FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT l FROM n))),
             f AS (SELECT p.doc_id, p.k, p.l, v.item FROM p JOIN v ON p.l = v.l AND p.s = v.s),
             h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS x FROM f) GROUP BY doc_id),
             t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(t.s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
