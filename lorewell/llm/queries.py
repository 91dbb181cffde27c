"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.llm import (
    bpe, chat_format, decontamination, license_scan, lm_scoring, merkle, mixing, pii_spans, quality_rules, ranked_search, secret_scan,
    simhash_dedup, toxicity,
)
from lorewell.llm.common import id_remainder, table
from lorewell.session import configure


def op1_chat_format(spark, sf_dir):
    """Maximal conversations, rendered."""
    return chat_format.format_chats(table(configure(spark), sf_dir, "conversations"))


def op2_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from labelled documents that are not held out."""
    docs, labels = table(configure(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, id_remainder("doc_id") != 0)
    found = toxicity.score(docs, model, "text", ["doc_id"])
    return found.select(
        "row.doc_id", (id_remainder(F.col("row.doc_id")) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op3_pii_spans(spark, sf_dir):
    """Personal data in every document."""
    found = pii_spans.spans(table(configure(spark), sf_dir, "documents"), "text", ["doc_id"])
    kinds = pii_spans.BASE_KINDS
    base = pii_spans.spans_text(F.filter("spans", lambda c: c["rank"] < len(kinds)))

    def of_kind(rank):
        return F.size(F.filter("spans", lambda c: c["rank"] == rank)).cast("bigint")

    return found.select(
        "row.doc_id", *[of_kind(i).alias(f"n_{k}") for i, k in enumerate(kinds)],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), pii_spans.spans_text(F.col("spans")).alias("spans"),
    )


def op4_secret_scan(spark, sf_dir):
    """Secrets in every document."""
    found = secret_scan.scan(table(configure(spark), sf_dir, "documents"), "text", keep=["doc_id"])
    base_kinds = [r.kind for r in secret_scan.BASE_RULES]
    base = secret_scan.spans_text(F.filter("spans", lambda s: s["rank"] < len(base_kinds)))
    return found.select(
        "row.doc_id", *[secret_scan.of_kind("spans", k).alias(f"n_{k}") for k in base_kinds],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


def op5_decontamination(spark, sf_dir):
    """Documents that hold a passage of a benchmark item, with the alignment's share of a full match."""
    spark = configure(spark)
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lm_scoring(spark, sf_dir):
    """Unigram and attention-model scores of every document, learned from those that are not held out."""
    docs = table(configure(spark), sf_dir, "documents")
    found = lm_scoring.score(docs, id_remainder("doc_id") != 1, vocabulary_path())
    return found.withColumn("held_out", id_remainder("doc_id") == 1)


def op7_quality_rules(spark, sf_dir):
    """Measurements, failed rules and the production verdict of every document."""
    rows = quality_rules.ledger(table(configure(spark), sf_dir, "documents"), "text", ["doc_id"])
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.POLICIES["base"])) != 0
    return rows.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & quality_rules.verdict(quality_rules.PRODUCTION)).alias("kept"),
        "n_lines", "n_letters", "n_capitals", "failed",
    )


def op8_simhash_dedup(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    found = simhash_dedup.near_duplicates(table(configure(spark), sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hex_digits("fp").alias("fingerprint"), "component_id")


def op9_license_scan(spark, sf_dir):
    """License phrases and notices of every document."""
    found = license_scan.scan(table(configure(spark), sf_dir, "documents"), "text", keep=["doc_id"], windows=True)
    return found.select(
        "row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark, sf_dir):
    """Every document encoded and decoded again, as digests."""
    found = bpe.digests(table(configure(spark), sf_dir, "documents"), vocabulary_path(), "text", ["doc_id"])
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_ranked_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    segments = ranked_search.index(table(configure(spark), sf_dir, "documents"))
    found = ranked_search.search(segments, table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("item", "item_id")


def op12_source_mixing(spark, sf_dir):
    """How many words of every document the mix of all sources takes."""
    found = mixing.taken(table(configure(spark), sf_dir, "documents"))
    return found.withColumnRenamed("key", "doc_id")


def op13_merkle_manifest(spark, sf_dir):
    """Leaf, roots and proof of every document, and whether a copy that may have lost its line breaks still leads to the root."""

    def stripped(columns):
        tampered = F.coalesce((id_remainder(columns["doc_id"], 2) == 0) & columns["doc_id"].isNotNull(), F.lit(False))
        return {"text": F.when(tampered, F.replace(columns["text"], F.lit("\n"), F.lit(""))).otherwise(columns["text"])}

    manifest = merkle.build(table(configure(spark), sf_dir, "documents"), claim=stripped)
    root = F.lit(manifest.root).cast("string")
    return merkle.check(manifest).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


QUERIES = {f.__name__: f for f in (
    op1_chat_format, op2_toxicity, op3_pii_spans, op4_secret_scan, op5_decontamination, op6_lm_scoring, op7_quality_rules, op8_simhash_dedup, op9_license_scan, op10_bpe,
    op11_ranked_search, op12_source_mixing, op13_merkle_manifest,
)}

OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, a, b, c) >= 2),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
ln AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
),
m AS (
  SELECT d.doc_id, len(w.ws) AS n_words,
    CAST(coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(ln.n_lines, 0) AS n_lines, coalesce(ln.n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(regexp_extract_all(d.text, '[A-Za-z]')) AS n_letters, len(regexp_extract_all(d.text, '[A-Z]')) AS n_capitals
  FROM d JOIN w USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)
),
f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_capitals > 7 * n_letters THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END AS failed
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  (failed & 47) = 0 AS kept, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_letters AS BIGINT) AS n_letters,
  CAST(n_capitals AS BIGINT) AS n_capitals, CAST(failed AS BIGINT) AS failed
FROM f
"""

OP1_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM t
),
c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY pos) AS turns FROM p GROUP BY conv_id),
reps AS (SELECT min(conv_id) AS conv_id, n_turns, turns FROM c GROUP BY n_turns, turns),
proper AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM reps)),
kept AS (SELECT * FROM reps WHERE NOT EXISTS (SELECT 1 FROM proper WHERE proper.turns = reps.turns))
SELECT p.conv_id, kept.n_turns, CAST((p.pos - 1) // 256 AS BIGINT) AS part,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY pos) AS text
FROM p JOIN kept ON p.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY p.conv_id, kept.n_turns, (p.pos - 1) // 256
"""

_SECRETS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']{0,1}[ ]*[:=][ ]*["']{0,1}([0-9A-Za-z=._/+-]+)""", 2, 12),
    ("access", "AKIA[0-9A-Z]+", 0, 18), ("hex", "[a-f0-9]+", 0, 16), ("github", "gh[oprsu]_[0-9A-Za-z]{36,}", 0, 0),
    ("slack", "xox[abprs]-[0-9A-Za-z-]{10,}", 0, 0), ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", 0, 0), ("pem", "-----BEGIN [ A-Z]*PRIVATE KEY-----", 0, 0),
    ("jwt", "eyJ[0-9A-Za-z_-]{8,}[.]eyJ[0-9A-Za-z_-]{8,}[.][0-9A-Za-z_-]{8,}", 0, 0),
]


def _secret_rule(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT r, {rank} AS rank, '{kind}' AS kind, {least} AS least, generate_subscripts(hits, 1) AS i,
    unnest(list_transform(gaps[1:len(hits)], lambda x: length(x))) AS gap, unnest(list_transform(hits, lambda x: length(x))) AS len,
    unnest(list_transform(parts, lambda x: length(x))) AS part
  FROM (SELECT r, string_split_regex(text, {quoted}) AS gaps, regexp_extract_all(text, {quoted}) AS hits,
    regexp_extract_all(text, {quoted}, {group}) AS parts FROM d WHERE regexp_matches(text, {quoted}))"""


OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS ({" UNION ALL ".join(_secret_rule(i, *rule) for i, rule in enumerate(_SECRETS))}),
s AS (SELECT *, CAST(sum(gap + len) OVER (PARTITION BY r, rank ORDER BY i) AS BIGINT) AS e FROM u),
a AS (
  SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(kind || ':' || (e - len) || ':' || e, ',' ORDER BY e - len, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || (e - len) || ':' || e, ',' ORDER BY e - len, rank) AS spans
  FROM s WHERE part >= least GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT row_number() OVER () AS no, label, list_distinct(string_split(words, ' ')) AS tw FROM (VALUES
  ('mit', 'released under the mit license'),
  ('mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software'),
  ('apache', 'licensed under the apache license version 2 0'),
  ('gpl', 'this work is licensed under the gnu general public license version 3'),
  ('gpl', 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license'),
  ('lgpl', 'licensed under the gnu lesser general public license'),
  ('agpl', 'licensed under the gnu affero general public license'),
  ('cc-by', 'licensed under cc by 4 0'), ('cc-by-nc', 'licensed under cc by nc 4 0'), ('cc-by-sa', 'licensed under cc by sa 4 0'),
  ('cc0', 'to the extent possible under law the author has waived all copyright and related rights to this work'),
  ('bsd', 'redistribution and use in source and binary forms with or without modification are permitted'),
  ('mpl', 'this source code form is subject to the terms of the mozilla public license'),
  ('isc', 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted'),
  ('unlicense', 'this is free and unencumbered software released into the public domain')) v(label, words)
),
part AS (
  SELECT x.no AS small, y.no AS large FROM t x, t y
  WHERE len(x.tw) < len(y.tw) AND len(list_intersect(x.tw, y.tw)) = len(x.tw)
),
w AS (SELECT r, doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS ws FROM d),
p AS (
  SELECT r, i - 1 AS place, CASE WHEN ws[i] = 'mit' THEN 'mit' WHEN ws[i] = 'apache' THEN 'apache' ELSE 'gpl' END AS label
  FROM (SELECT r, ws, generate_subscripts(ws, 1) AS i FROM w)
  WHERE (ws[i] IN ('mit', 'apache') AND ws[i + 1] = 'license') OR (ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license')
),
b AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM p GROUP BY r
),
ln AS (SELECT r, row_number() OVER () AS line, text FROM (SELECT r, unnest(string_split(text, chr(10))) AS text FROM d)),
lw AS (SELECT r, line, list_distinct(regexp_extract_all({_LOWER}, {_WORDS})) AS own FROM ln),
hit AS (
  SELECT r, line, no, label, len(list_intersect(own, tw)) / len(tw) AS share FROM lw, t
  WHERE len(list_intersect(own, tw)) >= 0.8 * len(tw) - 0.000000001
),
told AS (
  SELECT r, label FROM p UNION
  SELECT r, label FROM hit h WHERE NOT EXISTS (
    SELECT 1 FROM part JOIN hit o ON o.no = part.large WHERE part.small = h.no AND o.line = h.line)
),
l AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM told GROUP BY r),
top AS (SELECT r, max(share) AS share FROM hit GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN top USING (r)
"""

_TERMS = rf"regexp_extract_all({_LOWER}, {_WORDS})"
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
big AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_words FROM d WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term
),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), big
),
m AS (SELECT r, doc_id, 10 + (90 * len(ws) * n_docs) // n_words AS m FROM d, big WHERE len(ws) > 0),
s AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

OP13_SQL = r"""
WITH RECURSIVE
bits(k, i, c) AS (
  SELECT 0, range, range FROM range(256)
  UNION ALL SELECT k + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
ids AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda crc, b: xor(crc >> 8, t[CAST(xor(crc, b) & 255 AS INT) + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), tab
),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('1' || source, '0') AS tree, text,
    CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents LEFT JOIN ids USING (doc_id)
),
h AS (
  SELECT r, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) AS claim
  FROM d
),
leaf AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM h
),
low(tree, level, idx, node, n) AS (
  SELECT tree, 0, idx, leaf, n FROM leaf
  UNION ALL SELECT tree, level + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (n + 2) // 3
  FROM low WHERE n > 1 GROUP BY tree, level, idx // 3, n
),
sub AS (SELECT tree AS name, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
high(tree, level, idx, node, n) AS (
  SELECT '', 0, place, node, n FROM sub
  UNION ALL SELECT tree, level + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (n + 2) // 3
  FROM high WHERE n > 1 GROUP BY tree, level, idx // 3, n
),
sib AS (
  SELECT tree, level, idx, n,
    coalesce(string_agg(node, '') OVER (PARTITION BY tree, level, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '') OVER (PARTITION BY tree, level, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS g
  FROM (SELECT * FROM low UNION ALL SELECT * FROM high) WHERE n > 1
),
climb(r, tree, level, idx, n, cur, proof) AS (
  SELECT r, tree, 0, idx, n, claim, '' FROM leaf
  UNION ALL
  SELECT c.r, CASE WHEN c.n > 1 THEN c.tree ELSE '' END, CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END,
    CASE WHEN c.n > 1 THEN c.idx // 3 ELSE sub.place END, CASE WHEN c.n > 1 THEN (c.n + 2) // 3 ELSE sub.n END,
    CASE WHEN c.n > 1 THEN sha256(s.l || c.cur || s.g) ELSE c.cur END, CASE WHEN c.n > 1 THEN c.proof || s.l || s.g ELSE c.proof END
  FROM climb c LEFT JOIN sib s ON s.tree = c.tree AND s.level = c.level AND s.idx = c.idx LEFT JOIN sub ON sub.name = c.tree
  WHERE c.n > 1 OR c.tree <> ''
),
fin AS (SELECT r, cur, sha256(proof) AS proof FROM climb WHERE n = 1 AND tree = ''),
top AS (SELECT node AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, sub.node AS subroot, root, proof AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM leaf JOIN fin USING (r) JOIN sub ON sub.name = leaf.tree, top
"""

SQL: dict[str, str] = {
    "op11_ranked_search": OP11_SQL, "op13_merkle_manifest": OP13_SQL,
    "op1_chat_format": OP1_SQL, "op4_secret_scan": OP4_SQL, "op7_quality_rules": OP7_SQL, "op9_license_scan": OP9_SQL,
}
