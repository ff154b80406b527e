"""Queries by name: Spark plans, and the SQL that gives the same rows.

Most operators are relational as they stand. They are written once, in SQL that both engines
read; dialects differ in the placeholders of DIALECT alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import frequency
from ..operators.ranking import ranked, written
from ..sources import TABLES, read
from . import rules

#: (Spark, DuckDB) for each placeholder. Items of arrays come with their place.
DIALECT = {
    "<words>": (
        r"(SELECT doc_id, lang, source, pos, w FROM {documents} LATERAL VIEW posexplode(regexp_extract_all(lower(text), r'\pL+', 0)) AS pos, w)",
        r"(SELECT doc_id, lang, source, unnest(range(len(a))) AS pos, unnest(a) AS w FROM (SELECT *, regexp_extract_all(lower(text), '\pL+') AS a FROM documents))",
    ),
    "<sentences>": (
        r"(SELECT doc_id, lang, source, spos, trim(s) AS s FROM {documents} LATERAL VIEW posexplode(split(text, r'[.!?…\n]+')) AS spos, s WHERE trim(s) <> '')",
        r"(SELECT * FROM (SELECT doc_id, lang, source, unnest(range(len(a))) AS spos, trim(unnest(a)) AS s FROM (SELECT *, string_split_regex(text, '[.!?…\n]+') AS a FROM documents)) WHERE s <> '')",
    ),
    "<cased>": (
        r"(SELECT doc_id, lang, spos, pos, w FROM <sentences> LATERAL VIEW posexplode(regexp_extract_all(s, r'\pL+', 0)) AS pos, w)",
        r"(SELECT doc_id, lang, spos, unnest(range(len(a))) AS pos, unnest(a) AS w FROM (SELECT *, regexp_extract_all(s, '\pL+') AS a FROM <sentences>))",
    ),
    "<benchmark words>": (
        r"(SELECT item_id, w FROM {benchmark} LATERAL VIEW explode(regexp_extract_all(lower(text), r'\pL+', 0)) AS w)",
        r"(SELECT item_id, unnest(regexp_extract_all(lower(text), '\pL+')) AS w FROM benchmark)",
    ),
    "<tokens in s>": (r"size(regexp_extract_all(s, r'\pL+', 0))", r"len(regexp_extract_all(s, '\pL+'))"),
    "<reviews>": (
        r"(SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type <> 'error' AS ok FROM {events})",
        r"(SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type <> 'error' AS ok FROM events)",
    ),
    "<day>": ("to_date", "date"),
    "<days between>": ("datediff(DATE '2024-12-31', d)", "date_diff('day', d, DATE '2024-12-31')"),
    "<trimmed>": (r"regexp_replace(coalesce(text, ''), r'^\s+|\s+$', '')", r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"),
    "<first two words>": (
        r"array_join(slice(regexp_extract_all(regexp_replace(lower(text), r'[^a-z\s]', ''), '[a-z]+', 0), 1, 2), ' ')",
        r"array_to_string(regexp_extract_all(regexp_replace(lower(text), '[^a-z\s]', '', 'g'), '[a-z]+')[1:2], ' ')",
    ),
    "<letter words>": (r"""size(regexp_extract_all(text, r"\pL+(?:'\pL+)?", 0))""", r"len(regexp_extract_all(text, '\pL+(?:''\pL+)?'))"),
    "<blank-cut tokens>": (r"size(regexp_extract_all(text, r'\S+', 0))", r"len(regexp_extract_all(text, '\S+'))"),
    "<utf16 length>": ("octet_length(encode(text, 'UTF-16BE')) / 2", r"length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]'))"),
    "<no blank before ?!>": (r"regexp_replace(text, r'\s+([?!])', '$1')", r"regexp_replace(text, '\s+([?!])', '\1', 'g')"),
    "<set numbers>": ("explode(sequence(0L, {n} - 1))", "unnest(range({n}))"),
}


DIALECT |= rules.DIALECT | {"<forty letters>": ("[A-Za-z]{{40,}}", "[A-Za-z]{40,}"), "<no letter>": (r"[^\\pL]", r"[^\pL]"), "<new line>": (r"\\n", r"\n")}


def dialect(sql: str, k: int) -> str:
    for _ in range(4):
        for name, texts in DIALECT.items():
            sql = sql.replace(name, texts[k])
    if k:
        for t in TABLES:
            sql = sql.replace("{" + t + "}", t)
    return sql


SQL: dict[str, str] = dict(rules.SQL)

# Readings (here languages) with at least 2.5 % of a word and two tokens share its count in proportion.
SQL["surface_share_split"] = """
WITH c AS (SELECT w, lang, count(*) AS n FROM <words> GROUP BY w, lang),
t AS (SELECT *, sum(n) OVER (PARTITION BY w) AS total FROM c),
k AS (SELECT *, sum(n) OVER (PARTITION BY w) AS kept FROM t WHERE n >= 2 AND n >= 0.025 * total)
SELECT w, lang, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, round(CAST(total AS DOUBLE) * n / kept, 6) AS share FROM k"""

# A key ignores case, outer blanks and the form of the apostrophe; null is ''.
SQL["surface_keys"] = "SELECT conv_id, turn, translate(lower(<trimmed>), '’ʼ', concat(chr(39), chr(39))) AS surface_key FROM {conversations}"

# The first two words of a gloss, of the letters a-z alone.
SQL["first_two_words"] = "SELECT conv_id, turn, <first two words> AS first_two FROM {conversations}"

# Text made safe for HTML.
SQL["html_escaped"] = """
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped FROM {pages}"""

# German letters in their ASCII spelling.
SQL["german_ascii"] = """
SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue') AS folded
FROM {documents} WHERE lang = 'de'"""

# A sentence's first word loses its capital where the corpus mostly writes it small inside sentences.
SQL["truecased_initials"] = """
WITH c AS (SELECT * FROM <cased>),
m AS (SELECT lower(w) AS lw, count(CASE WHEN left(w, 1) = lower(left(w, 1)) THEN 1 END) AS low, count(CASE WHEN left(w, 1) <> lower(left(w, 1)) THEN 1 END) AS cap FROM c WHERE pos > 0 GROUP BY lower(w))
SELECT doc_id, spos, w AS first_word, CASE WHEN w = concat(upper(left(w, 1)), lower(substring(w, 2))) AND coalesce(low, 0) >= coalesce(cap, 0) AND (coalesce(low, 0) > 0 OR coalesce(cap, 0) = 0) THEN lower(w) ELSE w END AS shown
FROM c LEFT JOIN m ON lower(c.w) = m.lw WHERE pos = 0"""

# Lengths in code points and in UTF-16 units.
SQL["utf16_lengths"] = "SELECT doc_id, CAST(length(text) AS BIGINT) AS points, CAST(<utf16 length> AS BIGINT) AS units FROM {documents}"

# Words of letters, one apostrophe inside allowed, and tokens between blanks.
SQL["word_counts"] = "SELECT doc_id, CAST(<letter words> AS BIGINT) AS n_words, CAST(<blank-cut tokens> AS BIGINT) AS n_tokens FROM {documents}"

# No blanks before a question or exclamation mark.
SQL["clean_spacing"] = "SELECT doc_id, <no blank before ?!> AS cleaned FROM {documents}"

# The scalar functions that scores are made of.
SQL["math_scalars"] = """
SELECT p_partkey, round(ln(p_retailprice), 6) AS ln_price, round(log2(p_retailprice), 6) AS log2_price, round(log10(p_retailprice), 6) AS log10_price, round(power(10, p_size / 10.0), 3) AS zipf_back,
CAST(ceil(p_retailprice / 7 - 1e-9) AS BIGINT) AS up, CAST(floor(p_retailprice / 7) AS BIGINT) AS down FROM {part}"""

# Rows of two corpora, all kept.
SQL["corpus_union"] = "SELECT 'document' AS kind, doc_id AS id, text FROM {documents} UNION ALL SELECT 'benchmark' AS kind, item_id AS id, text FROM {benchmark}"

# Distinct words of a text in the order of their first use.
SQL["distinct_in_order"] = """
SELECT doc_id, w, CAST(min(pos) AS BIGINT) AS first_pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS BIGINT) AS place FROM <words> GROUP BY doc_id, w"""

# Each word's commonest reading; ties by name.
SQL["lang_majority"] = """
WITH c AS (SELECT w, lang, count(*) AS n FROM <words> GROUP BY w, lang),
r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, lang) AS k FROM c)
SELECT w, lang, CAST(n AS BIGINT) AS n FROM r WHERE k = 1"""

# The lowest translation linked by source, '' without one.
SQL["lowest_translation"] = """
WITH en AS (SELECT source, min(doc_id) AS en_id FROM {documents} WHERE lang = 'en' GROUP BY source)
SELECT d.doc_id, d.lang, coalesce(en.en_id, -1) AS en_id FROM {documents} d LEFT JOIN en ON d.source = en.source WHERE d.lang <> 'en'"""

# Recorders by licence.
SQL["recorder_rollup"] = """
SELECT n_name AS licence, c_mktsegment AS recorder, count(*) AS clips, count(DISTINCT o_custkey) AS people
FROM {orders} JOIN {customer} ON o_custkey = c_custkey LEFT JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment"""

# Lower-case and capitalised counts of words that don't begin a sentence.
SQL["truecase_stats"] = """
SELECT lower(w) AS word, count(CASE WHEN w = lower(w) THEN 1 END) AS low, count(CASE WHEN substr(w, 1, 1) <> lower(substr(w, 1, 1)) AND substr(w, 2) = lower(substr(w, 2)) THEN 1 END) AS cap
FROM <cased> WHERE pos > 0 GROUP BY lower(w)"""

# The first reason that rejects a sentence.
SQL["reject_reasons"] = """
WITH s AS (SELECT *, <tokens in s> AS n FROM <sentences>),
r AS (SELECT lang, CASE WHEN length(s) < 4 THEN 'short' WHEN s LIKE '%|%' THEN 'bad text' WHEN s = upper(s) AND s <> lower(s) THEN 'shouted' WHEN n < 3 THEN 'too few' WHEN n > 14 THEN 'too many' ELSE 'kept' END AS reason FROM s)
SELECT lang, reason, count(*) AS n FROM r GROUP BY lang, reason"""

# Sensitive texts go to the top level; a policy drops them everywhere, except hand-reviewed ones; subjects have a ceiling, but not in medicine.
SQL["sensitive_split"] = r"""
WITH d AS (SELECT doc_id, lower(text) AS t FROM {documents}),
f AS (SELECT d.doc_id, regexp_extract(t, '(^|<no letter>)(idiot|scum|stupid|moron|worthless|hate)', 0) <> '' AS sensitive, regexp_extract(t, '(password|api[_-]?key|secret) *[=:]', 0) <> '' AS policy,
  regexp_extract(t, '(^|<no letter>)(drugs?|weapons?|beer|whisky)(<no letter>|$)', 0) <> '' AND regexp_extract(t, '(^|<no letter>)(medic|clinic|doctor)', 0) = '' AS ceiling, l.quality IS NOT NULL AS reviewed FROM d LEFT JOIN {labels} l ON d.doc_id = l.doc_id)
SELECT CASE WHEN policy AND NOT reviewed THEN 'dropped' WHEN sensitive OR ceiling THEN 'top' ELSE 'any' END AS level, reviewed, count(*) AS n FROM f GROUP BY 1, 2"""

# Association of words with a language, p * log2(p / q), q smoothed by one.
SQL["cooccur_pmi"] = """
WITH fg AS (SELECT lang, w, count(DISTINCT doc_id) AS n FROM <words> GROUP BY lang, w), fb AS (SELECT lang, w, n, sum(n) OVER (PARTITION BY w) AS df FROM fg),
docs AS (SELECT lang, count(*) AS docs FROM {documents} GROUP BY lang),
total AS (SELECT count(*) AS total FROM {documents}),
p AS (SELECT fb.lang, fb.w, n, CAST(n AS DOUBLE) / docs.docs AS p, (df + 1.0E0) / total.total AS q FROM fb JOIN docs ON fb.lang = docs.lang CROSS JOIN total WHERE n >= 3)
SELECT lang, w, CAST(n AS BIGINT) AS n, round(CASE WHEN p <= q THEN 0E0 ELSE p * log2(p / q) END, 6) AS score FROM p"""

# Words of the first 400 sentences of each language and source, in corpus order.
SQL["bag_cap_400"] = """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id, spos) AS k FROM <sentences>)
SELECT lang, source, count(*) AS sentences, CAST(sum(<tokens in s>) AS BIGINT) AS tokens FROM s WHERE k <= 400 GROUP BY lang, source"""

SQL["length_hist"] = """
WITH s AS (SELECT lang, <tokens in s> AS n FROM <sentences>) SELECT lang, CAST(least(n, 30) AS BIGINT) AS n_words, count(*) AS sentences FROM s GROUP BY lang, least(n, 30)"""

# Words with no, one, or more sentences as evidence.
SQL["coverage_0_1_2"] = """
WITH b AS (SELECT DISTINCT w FROM <benchmark words>), c AS (SELECT b.w, count(DISTINCT d.doc_id) AS n FROM b LEFT JOIN <words> d ON b.w = d.w GROUP BY b.w)
SELECT CAST(least(n, 2) AS BIGINT) AS covered, count(*) AS words FROM c GROUP BY least(n, 2)"""

# Q13: share of an item's words that are among the 3000 commonest, against 0.93.
SQL["passage_coverage"] = """
WITH c AS (SELECT w, count(*) AS n FROM <words> GROUP BY w), k AS (SELECT w FROM (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS r FROM c) x WHERE r <= 3000),
i AS (SELECT item_id, count(*) AS words, count(k.w) AS known FROM <benchmark words> b LEFT JOIN k ON b.w = k.w GROUP BY item_id)
SELECT item_id, words, known, known >= 0.93 * words AS passes FROM i"""

# A12
SQL["passage_stats_by_level"] = """
WITH s AS (SELECT doc_id, lang, count(*) AS n FROM <sentences> GROUP BY doc_id, lang)
SELECT lang, count(*) AS passages, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, CAST(median(n) AS DOUBLE) AS middle FROM s GROUP BY lang"""

# W06 without the term for earlier use.
SQL["top2_examples"] = """
WITH b AS (SELECT DISTINCT w FROM <benchmark words>), h AS (SELECT DISTINCT d.w, d.doc_id, lang FROM <words> d JOIN b ON b.w = d.w),
r AS (SELECT h.w, h.doc_id, row_number() OVER (PARTITION BY h.w ORDER BY abs(x.n_chars - 600), h.doc_id) AS k FROM h JOIN {documents} x ON h.doc_id = x.doc_id)
SELECT w, doc_id, CAST(k AS BIGINT) AS k FROM r WHERE k <= 2"""

# The own tier first, each in its original order.
SQL["example_tiers"] = """
WITH r AS (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, doc_id) AS k FROM {documents})
SELECT source, doc_id, CAST(k AS BIGINT) AS k FROM r WHERE k <= 5"""

# Sets of ten in four contiguous buckets for each level, by floors of doubles.
SQL["strata_buckets"] = """
WITH l AS (SELECT o_orderpriority AS level, CAST(ceil(count(*) / 10.0E0) AS BIGINT) AS sets FROM {orders} GROUP BY o_orderpriority),
b AS (SELECT 0 AS b UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3),
s AS (SELECT level, b, sets, CAST(floor(b * (sets / 4.0E0)) AS BIGINT) AS s0, CAST(floor((b + 1) * (sets / 4.0E0)) AS BIGINT) AS up FROM l CROSS JOIN b)
SELECT level, CAST(b AS BIGINT) AS bucket, s0, greatest(s0 + 1, up) AS s1, CAST(CASE WHEN b % 2 = 0 THEN 2 ELSE 3 END AS BIGINT) AS items FROM s WHERE sets > 0"""

# The first bucket with nothing right, or under 0.75 right over three buckets.
SQL["placement_stop"] = """
WITH e AS (SELECT user_id, CAST(floor((k) / 10) AS BIGINT) AS bucket, ok FROM <reviews>),
c AS (SELECT user_id, bucket, count(*) AS n, count(CASE WHEN ok THEN 1 END) AS r FROM e GROUP BY user_id, bucket),
w AS (SELECT user_id, bucket, r, sum(r) OVER o AS r3, sum(n) OVER o AS n3 FROM c WINDOW o AS (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT user_id, min(CASE WHEN r = 0 OR r3 < 0.75 * n3 THEN bucket END) AS stop FROM w GROUP BY user_id"""

# Sets of twenty in the order of the list; the first with an untaught unit.
SQL["chunk_sets_next"] = """
WITH p AS (SELECT p_brand AS level, p_partkey, CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / 20) AS BIGINT) AS chunk FROM {part}),
t AS (SELECT DISTINCT k FROM <reviews>), g AS (SELECT level, chunk, count(*) AS units, count(t.k) AS taught FROM p LEFT JOIN t ON p.p_partkey = t.k GROUP BY level, chunk)
SELECT level, min(CASE WHEN taught < units THEN chunk END) AS next_set, CAST(sum(taught) AS BIGINT) AS taught FROM g GROUP BY level"""

# ST01: right, wrong, and the streak since the last miss.
SQL["record_fold"] = """
WITH e AS (SELECT user_id, k, ok, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS i FROM <reviews>)
SELECT user_id, k, count(CASE WHEN ok THEN 1 END) AS r, count(CASE WHEN NOT ok THEN 1 END) AS w, CAST(max(i) - coalesce(max(CASE WHEN NOT ok THEN i END), 0) AS BIGINT) AS s FROM e GROUP BY user_id, k"""

# ST02, P14: items of completed sets or drilled ahead.
SQL["learned_items"] = """
WITH p AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM {part}), d AS (SELECT DISTINCT k FROM <reviews> WHERE ok)
SELECT p_partkey, i <= 20 AS in_sets, d.k IS NOT NULL AS drilled FROM p LEFT JOIN d ON p_partkey = d.k WHERE i <= 20 OR d.k IS NOT NULL"""

# 3 w - s, highest first; ties by item.
SQL["weakest_items"] = """
WITH e AS (SELECT user_id, k, ok, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS i FROM <reviews>),
f AS (SELECT user_id, k, count(CASE WHEN NOT ok THEN 1 END) AS w, max(i) - coalesce(max(CASE WHEN NOT ok THEN i END), 0) AS s FROM e GROUP BY user_id, k),
r AS (SELECT user_id, k, CAST(3 * w - s AS BIGINT) AS score, row_number() OVER (PARTITION BY user_id ORDER BY 3 * w - s DESC, k) AS n FROM f)
SELECT user_id, k, score, CAST(n AS BIGINT) AS n FROM r WHERE n <= 15"""

# Misses by item, most missed first, then first seen.
SQL["miss_groups"] = """
WITH m AS (SELECT user_id, k, count(*) AS n, min(event_id) AS first_event FROM <reviews> WHERE NOT ok GROUP BY user_id, k)
SELECT user_id, k, n, first_event, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_event) AS BIGINT) AS place FROM m"""

# A16, ST04: the greatest weight of an item's reasons; records take it as misses.
SQL["weak_word_merge"] = """
WITH x AS (SELECT user_id, k, max(CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) AS weight, count(CASE WHEN event_type = 'error' THEN 1 END) AS w FROM <reviews> GROUP BY user_id, k)
SELECT user_id, k, CAST(weight AS BIGINT) AS weight, CAST(w + weight AS BIGINT) AS w, CAST(0 AS BIGINT) AS s FROM x WHERE weight > 0"""

# Items last missed seven days ago or more, oldest first.
SQL["reread_due"] = """
WITH m AS (SELECT user_id, k, max(<day>(ts)) AS d FROM <reviews> WHERE NOT ok GROUP BY user_id, k), a AS (SELECT user_id, k, d, CAST(<days between> AS BIGINT) AS age FROM m),
r AS (SELECT user_id, k, age, row_number() OVER (PARTITION BY user_id ORDER BY d, k) AS n FROM a WHERE age >= 7)
SELECT user_id, k, age FROM r WHERE n = 1"""

# P15
SQL["session_gates"] = """
WITH c AS (SELECT user_id, count(DISTINCT k) AS items, count(DISTINCT CASE WHEN ok THEN k END) AS learned FROM <reviews> GROUP BY user_id)
SELECT user_id, learned >= 5 AS review, learned >= 4 AS listen, items > learned AS recall, learned >= 8 AS test FROM c"""

# 70 % of a level's items open the next.
SQL["level_progress"] = """
WITH d AS (SELECT DISTINCT k FROM <reviews> WHERE ok), l AS (SELECT p_brand AS level, count(*) AS total, count(d.k) AS learned FROM {part} LEFT JOIN d ON p_partkey = d.k GROUP BY p_brand)
SELECT level, total, learned, CAST(ceil(0.7E0 * total - 1E-9) AS BIGINT) AS need, learned >= ceil(0.7E0 * total - 1E-9) AS unlocked FROM l"""

# Confusion matrix of two gradings.
SQL["confusion_pivot"] = """
SELECT source, count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS good_clean, count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS good_toxic, count(CASE WHEN quality = 0 AND toxic = 0 THEN 1 END) AS bad_clean, count(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END) AS bad_toxic
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY source"""

# Old keys without a target, and targets claimed twice.
SQL["legacy_migrate_unmapped"] = """
WITH old AS (SELECT DISTINCT l_partkey AS k FROM {lineitem}), m AS (SELECT p_partkey AS k, p_size AS target FROM {part} WHERE p_size > 5),
u AS (SELECT old.k FROM old LEFT JOIN m ON old.k = m.k WHERE m.k IS NULL), j AS (SELECT old.k, row_number() OVER (PARTITION BY m.target ORDER BY old.k) AS claim FROM old JOIN m ON old.k = m.k)
SELECT 'unmapped' AS state, count(*) AS n, min(k) AS first_key FROM u HAVING count(*) > 0 UNION ALL SELECT CASE WHEN claim > 1 THEN 'duplicate target' ELSE 'mapped' END, count(*), min(k) FROM j GROUP BY 1"""

# What either of two versions of a table has alone or otherwise.
SQL["roundtrip_diff"] = """
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM {orders} WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM {orders} WHERE o_orderkey % 5 <> 0)
SELECT CASE WHEN a.k IS NULL THEN 'only in b' WHEN b.k IS NULL THEN 'only in a' ELSE 'differs' END AS state, count(*) AS n FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v GROUP BY 1"""

# The same surface more than once in a level.
SQL["dup_surface_warnings"] = """
WITH c AS (SELECT p_brand AS level, lower(trim(p_name)) AS surface, count(*) AS n, min(p_partkey) AS first_key FROM {part} GROUP BY p_brand, lower(trim(p_name))) SELECT level, surface, n, first_key FROM c WHERE n > 1"""

# References without a target.
SQL["referential_violations"] = """
SELECT 'order without customer' AS rule, count(*) AS n FROM {orders} o LEFT JOIN {customer} c ON o_custkey = c_custkey WHERE c_custkey IS NULL
UNION ALL SELECT 'customer without order', count(*) FROM {customer} c LEFT JOIN {orders} o ON o_custkey = c_custkey WHERE o_custkey IS NULL
UNION ALL SELECT 'line without part', count(*) FROM {lineitem} l LEFT JOIN {part} p ON l_partkey = p_partkey WHERE p_partkey IS NULL
UNION ALL SELECT 'label without document', count(*) FROM {labels} l LEFT JOIN {documents} d ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL"""

# Junk patterns, with the first text of each.
SQL["gloss_patterns"] = r"""
WITH x AS (SELECT 'bars' AS pattern, '[|]' AS rx UNION ALL SELECT 'shouts', '!!' UNION ALL SELECT 'stars', '[*][*][*]' UNION ALL SELECT 'rights', '(?i)all rights reserved' UNION ALL SELECT 'blank before a mark', ' [,.;]' UNION ALL SELECT 'open bracket', '[(][^)]*$'
  UNION ALL SELECT 'empty bracket', '[(] *[)]' UNION ALL SELECT 'article alone', '(?i)(^|<new line>)(the|a|an|el|la|der|die|das|le) *(<new line>|$)' UNION ALL SELECT 'address', 'https?://' UNION ALL SELECT 'long run', '<forty letters>')
SELECT pattern, count(*) AS n, min(doc_id) AS first_doc FROM {documents} CROSS JOIN x WHERE regexp_extract(text, rx, 0) <> '' GROUP BY pattern"""

# Spans of frequent pairs that begin before the one before them ends.
SQL["span_overlap_violations"] = """
WITH t AS (SELECT doc_id, spos, pos, lower(w) AS w, lower(lead(w) OVER (PARTITION BY doc_id, spos ORDER BY pos)) AS next FROM <cased>), b AS (SELECT w, next FROM t WHERE next IS NOT NULL GROUP BY w, next HAVING count(*) >= 10),
s AS (SELECT t.doc_id, t.spos, t.pos AS a, t.pos + 2 AS z FROM t JOIN b ON t.w = b.w AND t.next = b.next),
o AS (SELECT doc_id, a, max(z) OVER (PARTITION BY doc_id, spos ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM s)
SELECT doc_id, count(*) AS spans, count(CASE WHEN a < past THEN 1 END) AS overlaps FROM o GROUP BY doc_id"""

# Candidates of the same class in tiers; another gloss, another surface.
SQL["distractor_pool"] = """
WITH q AS (SELECT * FROM {part} WHERE p_partkey % 50 = 0),
c AS (SELECT q.p_partkey, x.p_partkey AS other, CASE WHEN x.p_size = q.p_size THEN 0 WHEN abs(x.p_size - q.p_size) <= 5 THEN 1 ELSE 2 END AS tier FROM q JOIN {part} x ON q.p_brand = x.p_brand AND q.p_name <> x.p_name AND q.p_type <> x.p_type),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, other) AS k FROM c)
SELECT p_partkey, other, CAST(tier AS BIGINT) AS tier, CAST(k AS BIGINT) AS k FROM r WHERE k <= 3"""

# The nearest other words by edit distance, among the two hundred commonest, in letters without their marks (DuckDB counts the bytes of those).
SQL["edit_distance_nearest"] = """
WITH c AS (SELECT <fold w> AS w, count(*) AS n FROM <words> WHERE length(w) > 3 GROUP BY <fold w>), t AS (SELECT w FROM (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS r FROM c) x WHERE r <= 200),
d AS (SELECT a.w, b.w AS other, levenshtein(a.w, b.w) AS distance FROM t a JOIN t b ON a.w <> b.w),
r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY distance, other) AS k FROM d)
SELECT w, other, CAST(distance AS BIGINT) AS distance FROM r WHERE k <= 3"""

# Content signatures.
SQL["content_signatures"] = """
SELECT doc_id, substr(sha1(concat(lang, '|', source, '|', text)), 1, 8) AS signature FROM {documents}"""

# Rounded mean of percentages over items with questions.
SQL["reading_stats"] = """
WITH q AS (SELECT user_id, k, count(*) AS n, count(CASE WHEN ok THEN 1 END) AS sc FROM <reviews> GROUP BY user_id, k)
SELECT user_id, count(*) AS items, CAST(floor(avg(sc * 100.0E0 / n) + 0.5E0) AS BIGINT) AS score FROM q GROUP BY user_id"""
# Spark's own form: a mean of floats that is a half exactly falls to either side by the order of their sum, so wholes and
# rests are added apart, rests to 28 places; what is within 1e-18 of a whole is one.
EXACT = {
    "reading_stats": """
WITH q AS (SELECT user_id, k, count(*) AS n, count(CASE WHEN ok THEN 1 END) * 100 AS sc FROM <reviews> GROUP BY user_id, k),
t AS (SELECT user_id, count(*) AS items, sum(sc div n) AS whole, sum(CAST(sc % n AS DECIMAL(10, 0)) / CAST(n AS DECIMAL(27, 0))) AS rest FROM q GROUP BY user_id)
SELECT user_id, items, (2 * whole + items + CAST(floor(round(rest + rest, 18)) AS BIGINT)) div (2 * items) AS score FROM t"""
}

# Readings of surfaces, with clause-initial counts.
SQL["corpus_usage"] = """
SELECT lower(w) AS surface, lang, count(*) AS n, count(CASE WHEN pos = 0 THEN 1 END) AS initial FROM <cased> GROUP BY lower(w), lang"""

# Bound share, sentences with the phrase over those with its first word.
SQL["bound_share"] = """
WITH b AS (SELECT lang, w, follower, count(*) AS n FROM <pairs> GROUP BY lang, w, follower), c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY lang, w) AS BIGINT) AS total FROM b)
SELECT lang, w, follower, n, total FROM c WHERE follower IS NOT NULL AND n >= 5 AND n * 2 >= total"""

# ST05: the latest attempt, and how many there were.
SQL["latest_attempt"] = """
WITH r AS (SELECT user_id, k, event_type, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS i, count(*) OVER (PARTITION BY user_id, k) AS attempts FROM <reviews>)
SELECT user_id, k, event_type, CAST(attempts AS BIGINT) AS attempts FROM r WHERE i = 1"""

# ST08: states of wanted and present items.
SQL["item_states"] = """
WITH want AS (SELECT p_partkey AS id, md5(p_name) AS h FROM {part} WHERE p_size <= 40), have AS (SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN 'old' ELSE md5(p_name) END AS h FROM {part} WHERE p_size >= 10)
SELECT CASE WHEN have.id IS NULL THEN 'missing' WHEN want.id IS NULL THEN 'orphan' WHEN want.h <> have.h THEN 'stale' ELSE 'owned' END AS state, count(*) AS n FROM want FULL OUTER JOIN have ON want.id = have.id GROUP BY 1"""

# Levels against their bands.
SQL["band_check"] = """
WITH l AS (SELECT CASE WHEN p_size <= 10 THEN 'A1' WHEN p_size <= 25 THEN 'A2' ELSE 'B1' END AS level, count(*) AS n FROM {part} GROUP BY 1), b AS (SELECT 'A1' AS level, 400 AS band UNION ALL SELECT 'A2', 600 UNION ALL SELECT 'B1', 1000)
SELECT b.level, CAST(b.band AS BIGINT) AS band, coalesce(n, 0) AS n, coalesce(n, 0) >= 0.9 * band AS passes FROM b LEFT JOIN l ON b.level = l.level"""


def sql_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text = dialect(EXACT.get(name, SQL[name]), 0)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})

    run.__name__ = name
    return run


def least_unlike(rows: str, key: str) -> str:
    """Of rows (other, p_name, p_type, ...) of a key those among which are the three least by `other` that have neither a given name
    nor a given type, whatever these are. Three of the same name and type are enough; then six of a type (a name bars three) and six
    of a name; then fifteen (a name and a type bar six each). Spark cuts to each number before it shuffles, so a task sends few rows of a key.
    """
    for by, n in (("p_name, p_type", 3), ("p_type", 6), ("p_name", 6), (None, 15)):
        rows = f"(SELECT * EXCEPT (place) FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(filter(None, (key, by)))} ORDER BY other NULLS LAST) AS place FROM {rows}) WHERE place <= {n})"
    return rows


# Parts don't meet all of their class: the few of each class and size that can be the least are found first, then those of each tier
# that a class and size asks for. Sizes are joined within a class; at worst, where none is shared, that is the plain join.
EXACT["distractor_pool"] = f"""
WITH q AS (SELECT p_partkey, p_brand AS brand, p_size AS size, p_name AS name, p_type AS type FROM {{part}} WHERE p_partkey % 50 = 0),
x AS (SELECT p_partkey AS other, p_brand, p_size, p_name, p_type FROM {{part}} WHERE p_brand IS NOT NULL AND p_name IS NOT NULL AND p_type IS NOT NULL),
a AS (SELECT DISTINCT brand, size FROM q),
t AS (SELECT brand, size, other, p_name, p_type, CASE WHEN p_size = size THEN 0 WHEN abs(p_size - size) <= 5 THEN 1 ELSE 2 END AS tier FROM a JOIN {least_unlike("x", "p_brand, p_size")} ON brand = p_brand),
c AS (SELECT p_partkey, other, tier FROM q JOIN {least_unlike("t", "brand, size, tier")} l ON q.brand = l.brand AND q.size <=> l.size AND name <> p_name AND type <> p_type),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, other NULLS LAST) AS k FROM c)
SELECT p_partkey, other, CAST(tier AS BIGINT) AS tier, CAST(k AS BIGINT) AS k FROM r WHERE k <= 3"""


def lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Word counts of what is written (documents) and spoken (users' turns)."""
    written = frequency.words(read(spark, sf_dir, "documents").select("text"))
    spoken = frequency.words(read(spark, sf_dir, "conversations").where("role = 'user'").select("text"))
    return frequency.counts(written, "word"), frequency.counts(spoken, "word")


def freq_rank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole blended order."""
    out = ranked(frequency.blended(*lists(spark, sf_dir), "word"), "rank", "score", "word")
    return out.select("word", "rank_a", "rank_b", F.round("score", 6).alias("score"), "rank")


def freq_rank_blend_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = frequency.counts(frequency.words(read(spark, sf_dir, "benchmark").select("text")), "word")
    out = frequency.blended(*lists(spark, sf_dir), "word", third, 0.5)
    return out.select("word", "rank_a", "rank_b", "rank_c", F.round("score", 6).alias("score"))


#: Levels and the share of all items that they and those before them hold.
BANDS = (("A1", 0.25), ("A2", 0.5), ("B1", 0.75), ("B2", 1.0))


def level_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels by cumulative bands of rank, forced words first."""
    part = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") == 50).alias("forced"), "p_retailprice")
    rows = ranked(part, "r", F.col("forced").desc(), F.col("p_retailprice").desc(), "p_partkey")
    n = F.broadcast(part.agg(F.count("*").alias("n")))
    level = F.coalesce(*[F.when(F.col("r") <= F.floor(F.col("n") * share), name) for name, share in BANDS])
    return rows.crossJoin(n).select("p_partkey", "forced", level.alias("level"))


BANDS_SQL = """
WITH p AS (SELECT p_partkey, p_size = 50 AS forced, row_number() OVER (ORDER BY CASE WHEN p_size = 50 THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey) AS r, count(*) OVER () AS n FROM part)
SELECT p_partkey, forced, CASE WHEN r <= floor(n * 0.25) THEN 'A1' WHEN r <= floor(n * 0.5) THEN 'A2' WHEN r <= floor(n * 0.75) THEN 'B1' ELSE 'B2' END AS level FROM p"""


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen ids (every third part's, a made-up earlier version) are reused by their first claimant; others get new ones after the highest."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    frozen = part.where("p_partkey % 3 = 0").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    claims = part.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey")).join(frozen, "p_name").select("p_partkey", "id")
    old = part.join(claims, "p_partkey").select("p_partkey", "id", F.lit(True).alias("reused"))
    top = F.broadcast(frozen.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))
    new = ranked(part.join(claims, "p_partkey", "left_anti").select("p_partkey"), "k", "p_partkey").crossJoin(top)
    out = old.union(new.select("p_partkey", F.col("top") + F.col("k"), F.lit(False)))
    return out.select("p_partkey", F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("id"), "reused")


IDS_SQL = """
WITH p AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS claim FROM part),
frozen AS (SELECT p_name, min(p_partkey) AS id FROM part WHERE p_partkey % 3 = 0 GROUP BY p_name),
j AS (SELECT p.p_partkey, CASE WHEN claim = 1 THEN f.id END AS id FROM p LEFT JOIN frozen f ON p.p_name = f.p_name),
m AS (SELECT max(id) AS top FROM frozen),
n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS k FROM j WHERE id IS NULL)
SELECT j.p_partkey, 'w' || lpad(CAST(coalesce(j.id, m.top + n.k) AS VARCHAR), 7, '0') AS id, j.id IS NOT NULL AS reused FROM j CROSS JOIN m LEFT JOIN n ON j.p_partkey = n.p_partkey"""

_RANKS = r"""a AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS rank_a FROM (SELECT unnest(regexp_extract_all(lower(text), '\pL+')) AS word FROM documents) GROUP BY word),
b AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS rank_b FROM (SELECT unnest(regexp_extract_all(lower(text), '\pL+')) AS word FROM conversations WHERE role = 'user') GROUP BY word)"""
BLEND_SQL = f"WITH {_RANKS}, s AS (SELECT a.word, rank_a, rank_b, (ln(rank_a) + ln(rank_b)) / 2 AS score FROM a JOIN b ON a.word = b.word) SELECT word, rank_a, rank_b, round(score, 6) AS score, row_number() OVER (ORDER BY score, word) AS rank FROM s"
WEIGHTED_SQL = rf"""WITH {_RANKS},
c AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS rank_c FROM (SELECT unnest(regexp_extract_all(lower(text), '\pL+')) AS word FROM benchmark) GROUP BY word), m AS (SELECT count(*) + 1 AS last FROM c)
SELECT a.word, rank_a, rank_b, coalesce(rank_c, last) AS rank_c, round((ln(rank_a) + ln(rank_b) + 0.5 * ln(coalesce(rank_c, last))) / 2.5, 6) AS score FROM a JOIN b ON a.word = b.word LEFT JOIN c ON a.word = c.word CROSS JOIN m"""


#: Up to so many frequent pairs are sent to every executor; beyond, Spark joins by their words.
MOST_BROADCAST_PAIRS = 200_000


def spanned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences stay whole where words need not meet: pairs are counted before they are shuffled, and a sentence's spanned places are a row.

    Where rows repeat a doc_id the SQL's order of words is open; here the tokens of all count, and a place once. A null doc_id has no spanned tokens, as in the SQL.
    """
    texts = spark.sql(dialect(r"SELECT doc_id, spos, transform(regexp_extract_all(s, r'\pL+', 0), x -> lower(x)) AS a FROM <sentences>", 0), documents=read(spark, sf_dir, "documents")).where("size(a) > 0")
    pairs = texts.select("doc_id", "spos", "a", F.posexplode("a").alias("pos", "w")).select("doc_id", "spos", "pos", "w", F.expr("get(a, pos + 1)").alias("next")).where("next is not null")
    often = written(pairs.groupBy("w", "next").agg(F.count("*").alias("n")).where("n >= 10").select("w", "next"))
    found = pairs.where("doc_id is not null").join(F.broadcast(often) if often.count() <= MOST_BROADCAST_PAIRS else often, ["w", "next"])
    places = found.groupBy("doc_id", "spos").agg(F.collect_list("pos").alias("p"))
    spanned = F.size(F.array_distinct(F.concat("p", F.transform("p", lambda x: x + 1)))).cast("long")
    per = places.select("doc_id", spanned.alias("n")).groupBy("doc_id").agg(F.sum("n").alias("spanned"))
    tokens = texts.groupBy("doc_id").agg(F.sum(F.size("a")).alias("tokens"))
    return tokens.join(per, "doc_id", "left").select("doc_id", "tokens", F.coalesce("spanned", F.lit(0)).alias("spanned"))


#: Up to so many frequent pairs' hashes (about 50 bytes each) are sent to every executor to find spans; beyond, documents' pairs are
#: joined with them, of so many documents at a time, which bounds what the join keeps on disk.
MOST_BROADCAST_HASHES, DOCS_AT_ONCE = 1_000_000, 500_000
_HASHED = ("xxhash64(w, next) AS h", "hash(next, w) AS g")


def span_overlap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences stay whole, as in spanned_tokens. Pairs are told apart by 96 bits of hashes, which is what is shuffled to count them.

    A span overlaps the one before it if that begins a word before, so a word needs its two pairs alone. Where rows repeat a doc_id
    their words lie between one another's by place; those documents alone are ordered by windows, as the SQL does.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.lit("").alias("lang"), F.lit("").alias("source"))
    again = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again")))
    repeated, once = again.count(), docs
    if repeated:
        few = F.broadcast(again) if repeated <= MOST_BROADCAST_HASHES else again
        once = docs.join(few, F.expr("doc_id <=> again"), "left_anti")
    texts = spark.sql(dialect(r"SELECT doc_id, spos, transform(regexp_extract_all(s, r'\pL+', 0), x -> lower(x)) AS a FROM <sentences>", 0), documents=once)
    pairs = texts.where("size(a) > 1").select("doc_id", "spos", "a", F.posexplode("a").alias("pos", "w")).where("pos < size(a) - 1")
    pairs = pairs.selectExpr("doc_id", "spos", "pos", "w", "a[pos + 1] AS next", "get(a, pos - 1) AS before")
    every = single = pairs.selectExpr("doc_id", "spos", "pos", *_HASHED)
    if repeated:
        sql = "SELECT doc_id, spos, pos, lower(w) AS w, lower(lead(w) OVER (PARTITION BY doc_id, spos ORDER BY pos)) AS next FROM <cased>"
        others = written(spark.sql(dialect(sql, 0), documents=docs.join(few, F.expr("doc_id <=> again"), "left_semi")).where("next is not null").selectExpr("doc_id", "spos", "pos", *_HASHED))
        every = single.union(others)
    often = written(every.groupBy("h", "g").agg(F.count("*").alias("n")).where("n >= 10").select("h", "g"))
    small = often.count() <= MOST_BROADCAST_HASHES

    def spans(rows: DataFrame) -> DataFrame:
        found = rows.join(F.broadcast(often) if small else often, ["h", "g"]).select("doc_id", "spos", "pos").repartition("doc_id")
        past = F.max(F.col("pos") + 2).over(Window.partitionBy("doc_id", "spos").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
        return found.select("doc_id", (F.col("pos") < past).alias("over")).groupBy("doc_id").agg(F.count("*").alias("spans"), F.count_if("over").alias("overlaps"))

    if small:
        own, last = (F.broadcast(often.toDF(f"{x}h", f"{x}g")) for x in ("own", "last"))
        rows = pairs.selectExpr("doc_id", *_HASHED, "xxhash64(before, w) AS bh", "hash(w, before) AS bg", "before is not null AS inside")
        # A join by h alone keeps what is sent small.
        rows = rows.join(own, F.expr("h = ownh and (g ^ owng) = 0")).join(last, F.expr("bh = lasth and (bg ^ lastg) = 0 and inside"), "left")
        out = [rows.groupBy("doc_id").agg(F.count("*").alias("spans"), F.count("lasth").alias("overlaps"))]
    else:
        parts = -(-once.count() // DOCS_AT_ONCE)
        out = [written(spans(single.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == k))) for k in range(parts)]
    if repeated:
        out.append(spans(others))
    return reduce(DataFrame.union, out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: sql_query(n) for n in SQL} | {f.__name__: f for f in (freq_rank_blend, freq_rank_blend_weighted, level_bands, stable_ids, spanned_tokens, span_overlap_violations)}


def oracle_sql() -> dict[str, str]:
    return {"freq_rank_blend": BLEND_SQL, "freq_rank_blend_weighted": WEIGHTED_SQL, "level_bands": BANDS_SQL, "stable_ids": IDS_SQL} | {n: dialect(t, 1) for n, t in SQL.items()}
