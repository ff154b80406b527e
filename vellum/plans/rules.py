"""More relational operators of the blueprint, in the SQL that Spark and DuckDB both read (see queries.DIALECT)."""

from __future__ import annotations

# Latin letters with marks and the letters that they fold to.
ACCENTED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

#: (Spark, DuckDB) for each placeholder.
DIALECT = {
    "<spoken words>": (
        r"(SELECT conv_id, turn, w FROM {conversations} LATERAL VIEW explode(regexp_extract_all(lower(text), r'\pL+', 0)) AS w WHERE role = 'user')",
        r"(SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '\pL+')) AS w FROM conversations WHERE role = 'user')",
    ),
    "<numbered tokens>": (
        r"(SELECT doc_id, spos, pos, w FROM <sentences> LATERAL VIEW posexplode(regexp_extract_all(lower(s), r'[\pL\pN]+', 0)) AS pos, w)",
        r"(SELECT doc_id, spos, unnest(range(len(a))) AS pos, unnest(a) AS w FROM (SELECT *, regexp_extract_all(lower(s), '[\pL\pN]+') AS a FROM <sentences>))",
    ),
    "<letters of words>": (
        r"(SELECT DISTINCT w, c FROM <benchmark words> LATERAL VIEW explode(regexp_extract_all(w, '.', 0)) AS c)",
        r"(SELECT DISTINCT w, unnest(regexp_extract_all(w, '.')) AS c FROM <benchmark words>)",
    ),
    "<pairs>": (
        r"(SELECT lang, a[i] AS w, get(a, i + 1) AS follower FROM (SELECT lang, transform(regexp_extract_all(s, r'\pL+', 0), x -> lower(x)) AS a FROM <sentences>) LATERAL VIEW posexplode(a) AS i, unused)",
        r"(SELECT lang, unnest(a) AS w, unnest(list_concat(a[2:], [NULL])) AS follower FROM (SELECT lang, list_transform(regexp_extract_all(s, '\pL+'), lambda x: lower(x)) AS a FROM <sentences>))",
    ),
    "<features>": (
        r"(SELECT p_partkey, split(f, '=')[0] AS name, split(f, '=')[1] AS value FROM (SELECT p_partkey, concat('Brand=', p_brand, '|Size=', CAST(p_size AS STRING), '|Type=', p_type) AS m FROM {part}) LATERAL VIEW explode(split(m, '[|]')) AS f)",
        r"(SELECT p_partkey, string_split(f, '=')[1] AS name, string_split(f, '=')[2] AS value FROM (SELECT p_partkey, unnest(string_split(concat('Brand=', p_brand, '|Size=', CAST(p_size AS VARCHAR), '|Type=', p_type), '|')) AS f FROM part))",
    ),
    "<as sorted list of recorder>": ("array_join(array_sort(collect_set(recorder)), ', ')", "array_to_string(list_sort(list(DISTINCT recorder)), ', ')"),
    "<as sorted list of lang>": ("array_join(array_sort(collect_set(lang)), ' ')", "array_to_string(list_sort(list(DISTINCT lang)), ' ')"),
    "<as map of records>": (
        """concat('{{', array_join(transform(array_sort(collect_list(struct(k, r, w, s))), x -> concat('"', x.k, '":{{"r":', x.r, ',"w":', x.w, ',"s":', x.s, '}}')), ','), '}}')""",
        """concat('{', string_agg(concat('"', k, '":{"r":', r, ',"w":', w, ',"s":', s, '}'), ',' ORDER BY k), '}')""",
    ),
    "<draw of id>": ("CAST(conv(substring(md5(CAST(CAST(id AS STRING) AS BINARY)), 1, 8), 16, 10) AS DOUBLE) / 4294967296.0E0", "CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0"),
    "<hash of id>": ("md5(CAST(concat('303|', CAST(id AS STRING)) AS BINARY))", "md5(concat('303|', CAST(id AS VARCHAR)))"),
    "<hash of part and seed>": ("md5(CAST(concat(CAST(seed AS STRING), '|', CAST(p_partkey AS STRING)) AS BINARY))", "md5(concat(CAST(seed AS VARCHAR), '|', CAST(p_partkey AS VARCHAR)))"),
    "<two or three letters>": ("^[a-z]{{2,3}}", "^[a-z]{2,3}"),
    "<is a record>": ("j LIKE '{{%' AND json_object_keys(j) IS NOT NULL", "j LIKE '{%' AND json_valid(j)"),
    "<has k>": ("get_json_object(j, '$.k') IS NOT NULL", "json_extract_string(CASE WHEN json_valid(j) THEN j END, '$.k') IS NOT NULL"),
    "<as a date>": ("try_cast(d AS DATE)", "try_cast(d AS DATE)"),
    "<as a day number>": ("datediff(try_cast(d AS DATE), DATE '1970-01-01')", "date_diff('day', DATE '1970-01-01', try_cast(d AS DATE))"),
    "<hits of the in s>": (r"size(regexp_extract_all(lower(s), r'(?<![\pL\pM\pN])the(?![\pL\pM\pN])', 0))", r"len(list_filter(regexp_extract_all(lower(s), '[\pL\pM\pN]+'), lambda x: x = 'the'))"),
    "<place of the in s>": (r"regexp_instr(lower(s), r'(?<![\pL\pM\pN])the(?![\pL\pM\pN])') - 1", r"length(regexp_extract(lower(s), '^((?s:.*?)(?:^|[^\pL\pM\pN]))the(?:[^\pL\pM\pN]|$)', 1))"),
    "<fold w>": (f"translate(w, '{ACCENTED}', '{PLAIN}')",) * 2,
    "<digraphs of w>": ("replace(replace(replace(replace(w, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')",) * 2,
    "<words in first part>": (r"size(regexp_extract_all(regexp_extract(text, '^[^,]*', 0), r'\S+', 0))", r"len(regexp_extract_all(regexp_extract(text, '^[^,]*', 0), '\S+'))"),
}

SQL: dict[str, str] = {}

# Spellings without accents that a list holds in excess of the corpus give the excess to the accented ones.
SQL["accent_excess"] = """
WITH corpus AS (SELECT w, CAST(count(*) AS DOUBLE) AS c FROM <words> GROUP BY w),
spoken AS (SELECT w, <fold w> AS f, CAST(count(*) AS DOUBLE) AS n FROM <spoken words> GROUP BY w),
pairs AS (SELECT a.w AS plain, b.w AS accented, a.n, b.n AS n2, coalesce(ca.c, 0E0) AS c, cb.c AS c2 FROM spoken a JOIN spoken b ON a.w = b.f AND a.w <> b.w LEFT JOIN corpus ca ON a.w = ca.w JOIN corpus cb ON b.w = cb.w),
moved AS (SELECT plain, accented, (n / (n + n2) - c / (c + c2)) * (n + n2) AS x FROM pairs WHERE n / (n + n2) > c / (c + c2)),
deltas AS (SELECT w, sum(d) AS d FROM (SELECT plain AS w, -x AS d FROM moved UNION ALL SELECT accented, x FROM moved) u GROUP BY w)
SELECT s.w, CAST(n AS BIGINT) AS n, round(n + coalesce(d, 0E0), 6) AS adjusted FROM spoken s LEFT JOIN deltas ON s.w = deltas.w"""

# Typed words that fold to an entry are right, unless they spell another entry; German entries in their digraphs, too.
SQL["typed_accept"] = """
WITH entries AS (SELECT w, max(CASE WHEN lang = 'de' THEN 1 ELSE 0 END) AS german FROM <words> GROUP BY w),
typed AS (SELECT DISTINCT w FROM <spoken words> UNION SELECT DISTINCT <fold w> FROM entries WHERE w <> <fold w> UNION SELECT DISTINCT <digraphs of w> FROM entries WHERE w <> <digraphs of w> AND german = 1),
keys AS (SELECT w, <fold w> AS k FROM entries UNION SELECT w, translate(<digraphs of w>, 'áéèê', 'aeee') FROM entries WHERE german = 1),
pairs AS (SELECT DISTINCT keys.w AS entry, t.w AS typed FROM keys JOIN (SELECT w, <fold w> AS k FROM typed) t ON keys.k = t.k)
SELECT entry, typed, CASE WHEN entry = typed THEN 'exact' WHEN e.w IS NULL THEN 'folded' ELSE 'another entry' END AS verdict FROM pairs LEFT JOIN entries e ON pairs.typed = e.w"""

# T04 on Latin letters: words with marks and their folded spelling.
SQL["latin_folds"] = "SELECT w, <fold w> AS folded, count(*) AS n FROM <words> WHERE w <> <fold w> GROUP BY w"

# Whole-word hits of a surface, and its place where it stands once.
SQL["located_surface"] = """
SELECT doc_id, spos, CAST(<hits of the in s> AS BIGINT) AS hits, CASE WHEN <hits of the in s> = 1 THEN CAST(<place of the in s> AS BIGINT) END AS place FROM <sentences> WHERE lower(s) LIKE '%the%'"""

# Words that may be blanked: once in the sentence, of its own level, no function words, with something left outside.
SQL["cloze_blanks"] = """
WITH t AS (SELECT doc_id, lang, spos, lower(w) AS w FROM <cased>), c AS (SELECT lang, w, count(*) AS n FROM t GROUP BY lang, w),
r AS (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS r FROM c), l AS (SELECT lang, w, r <= 20 AS functional, CASE WHEN r <= 200 THEN 1 WHEN r <= 1000 THEN 2 ELSE 3 END AS level FROM r),
s AS (SELECT t.doc_id, t.lang, t.spos, t.w, l.level, l.functional, count(*) OVER (PARTITION BY t.doc_id, t.spos, t.w) AS times, max(l.level) OVER (PARTITION BY t.doc_id, t.spos) AS own, count(*) OVER (PARTITION BY t.doc_id, t.spos) AS words FROM t JOIN l ON t.lang = l.lang AND t.w = l.w)
SELECT doc_id, spos, w, CAST(level AS BIGINT) AS level FROM s WHERE times = 1 AND NOT functional AND level = own AND words > 1"""

# Of up to 15 slots 40 % are production, recall and typing by turns; the rest hears and reads at 2:1.
SQL["kind_mix"] = """
WITH u AS (SELECT user_id, least(15, count(DISTINCT k)) AS n FROM <reviews> GROUP BY user_id), p AS (SELECT user_id, n, CAST(ceil(n * 0.4E0 - 1E-9) AS BIGINT) AS prod FROM u)
SELECT user_id, CAST(n AS BIGINT) AS n, CAST(ceil(prod / 2.0E0) AS BIGINT) AS recall, CAST(floor(prod / 2.0E0) AS BIGINT) AS type, CAST(floor((n - prod) / 3.0E0) AS BIGINT) AS read, CAST(n - prod - floor((n - prod) / 3.0E0) AS BIGINT) AS hear FROM p"""

# As many of each level, in the order of a seeded hash of their ids.
SQL["stratified_sample"] = """
WITH d AS (SELECT doc_id AS id, lang FROM {documents}), n AS (SELECT greatest(1, floor(60 / count(DISTINCT lang))) AS per FROM {documents}),
r AS (SELECT id, lang, row_number() OVER (PARTITION BY lang ORDER BY <hash of id>, id) AS k FROM d)
SELECT lang, id AS doc_id, CAST(k AS BIGINT) AS k FROM r CROSS JOIN n WHERE k <= per"""

# A kind drawn by weights from a hash of the id.
SQL["weighted_kind"] = """
WITH d AS (SELECT p_partkey AS id FROM {part}), x AS (SELECT id, <draw of id> * 8.0E0 AS x FROM d)
SELECT id, CASE WHEN x < 3 THEN 'recall' WHEN x < 5 THEN 'hear' WHEN x < 7 THEN 'read' ELSE 'type' END AS kind FROM x"""

# Up to five provisional items a user, in the order of a hash.
SQL["provisional_pick"] = """
WITH g AS (SELECT user_id, k FROM <reviews> GROUP BY user_id, k HAVING count(*) = 1 AND count(CASE WHEN ok THEN 1 END) = 1), h AS (SELECT user_id, k, user_id * 1000 + k AS id FROM g),
r AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY <hash of id>, k) AS i FROM h) SELECT user_id, k, CAST(i AS BIGINT) AS i FROM r WHERE i <= 5"""

# The best entry by a tuple of qualities.
SQL["best_entry"] = """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderpriority, o_totalprice DESC, o_orderdate, o_orderkey) AS k FROM {orders})
SELECT o_custkey, o_orderkey FROM r WHERE k = 1"""

# Stages in order, their sets and what is done; the next is the first not done.
SQL["stage_path"] = """
WITH d AS (SELECT DISTINCT k FROM <reviews> WHERE ok), p AS (SELECT p_brand AS stage, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM {part}),
s AS (SELECT stage, floor((i - 1) / 20) AS chunk, count(*) AS n, count(d.k) AS got FROM p LEFT JOIN d ON p_partkey = d.k GROUP BY stage, floor((i - 1) / 20)),
g AS (SELECT stage, count(*) AS nsets, count(CASE WHEN got = n THEN 1 END) AS done, CAST(sum(got) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS frac FROM s GROUP BY stage)
SELECT stage, nsets, done, round(frac, 6) AS frac, done = nsets AS finished, stage = min(CASE WHEN done < nsets THEN stage END) OVER () AS next FROM g"""

# The first hundred by rank, and whether ranks are without gaps.
SQL["top_hundred"] = """
WITH c AS (SELECT lang, w, count(*) AS n FROM <words> GROUP BY lang, w), r AS (SELECT lang, w, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS rank FROM c),
g AS (SELECT lang, count(DISTINCT rank) = max(rank) - min(rank) + 1 AS whole FROM r GROUP BY lang)
SELECT r.lang, r.w, r.n, CAST(r.rank AS BIGINT) AS rank, g.whole FROM r JOIN g ON r.lang = g.lang WHERE r.rank <= 100"""

# Votes of tokens that are headwords.
SQL["lemma_votes"] = "SELECT d.lang, d.w, count(*) AS votes FROM <words> d WHERE d.w IN (SELECT w FROM <benchmark words>) GROUP BY d.lang, d.w"

# Share of a word's readings, one reading left out of the whole.
SQL["reading_share"] = """
WITH c AS (SELECT w, lang, count(*) AS n FROM <words> WHERE lang <> 'de' GROUP BY w, lang)
SELECT w, lang, round(CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY w) AS DOUBLE), 6) AS share FROM c"""

# Totals of records.
SQL["progress_totals"] = """
WITH e AS (SELECT user_id, k, ok, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS i FROM <reviews>),
f AS (SELECT user_id, k, count(CASE WHEN ok THEN 1 END) AS r, count(CASE WHEN NOT ok THEN 1 END) AS w, max(i) - coalesce(max(CASE WHEN NOT ok THEN i END), 0) AS s FROM e GROUP BY user_id, k)
SELECT count(*) AS records, CAST(sum(r) AS BIGINT) AS rights, CAST(sum(w) AS BIGINT) AS wrongs, CAST(sum(s) AS BIGINT) AS streaks FROM f"""

# Override keys that are taken, and those that nothing uses.
SQL["override_use"] = """
WITH o AS (SELECT DISTINCT w FROM <benchmark words>), t AS (SELECT DISTINCT w FROM <spoken words>)
SELECT 'taken' AS state, count(*) AS n, min(w) AS first_key FROM (SELECT w FROM o INTERSECT SELECT w FROM t) a UNION ALL SELECT 'unused', count(*), min(w) FROM (SELECT w FROM o EXCEPT SELECT w FROM t) b"""

# Distinct contributors of each licence, sorted.
SQL["contributors"] = """
WITH c AS (SELECT n_name AS licence, c_mktsegment AS recorder, o_orderkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey)
SELECT licence, <as sorted list of recorder> AS recorders, count(DISTINCT recorder) AS people, count(*) AS clips FROM c GROUP BY licence"""

# A number, then two words.
SQL["counted_nouns"] = r"""
WITH t AS (SELECT w, lead(w) OVER s AS classifier, lead(w, 2) OVER s AS noun FROM <numbered tokens> WINDOW s AS (PARTITION BY doc_id, spos ORDER BY pos))
SELECT classifier, noun, count(*) AS n FROM t WHERE regexp_extract(w, '^[0-9]+$', 0) <> '' AND regexp_extract(classifier, '^[^0-9]+$', 0) <> '' AND regexp_extract(noun, '^[^0-9]+$', 0) <> '' GROUP BY classifier, noun"""

# Written forms of each key.
SQL["form_inventory"] = "SELECT lower(w) AS word, w AS form, count(*) AS n FROM <cased> GROUP BY lower(w), w"

# Evidence from plain spellings with the tails that a word takes.
SQL["evidence_prior"] = """
WITH c AS (SELECT w, count(*) AS n FROM <words> GROUP BY w), tails AS (SELECT '' AS tail UNION ALL SELECT 's' UNION ALL SELECT 'n' UNION ALL SELECT 'en' UNION ALL SELECT 'es'),
h AS (SELECT DISTINCT w FROM <benchmark words>), f AS (SELECT h.w, concat(h.w, tail) AS form FROM h CROSS JOIN tails)
SELECT f.w, round(1.33E0 * log10(1E0 + CAST(coalesce(sum(c.n), 0) AS DOUBLE)), 6) AS prior FROM f LEFT JOIN c ON f.form = c.w GROUP BY f.w"""

# Shapes of values.
SQL["shape_checks"] = """
SELECT count(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 END) AS blank_texts, count(CASE WHEN n_chars IS NULL OR n_chars <= 0 THEN 1 END) AS bad_sizes, count(CASE WHEN n_chars <> length(text) THEN 1 END) AS wrong_sizes, count(*) AS n FROM {documents}"""

# Permissive licences and numeric ids.
SQL["permissive_rows"] = """
SELECT c_custkey, c_mktsegment AS licence FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND regexp_extract(substr(c_name, 10), '^[0-9]+$', 0) <> ''"""

# Profanity by exact word or stem.
SQL["profane_words"] = """
SELECT lang, w, count(*) AS n FROM <words> WHERE w IN ('idiot', 'scum') OR w LIKE 'stupid%' OR w LIKE 'moron%' GROUP BY lang, w"""

# Names: three or more capitals inside sentences, and more than small initials.
SQL["proper_nouns"] = """
WITH c AS (SELECT lower(w) AS word, count(CASE WHEN w = lower(w) THEN 1 END) AS low, count(CASE WHEN substr(w, 1, 1) <> lower(substr(w, 1, 1)) THEN 1 END) AS cap FROM <cased> WHERE pos > 0 GROUP BY lower(w))
SELECT word, low, cap, low >= 20 AS rescued FROM c WHERE cap >= 3 AND cap > low"""

# The first 6500 lemmas by rank with all their readings; a second reading needs a fifth of the lemma.
SQL["candidate_pool"] = """
WITH c AS (SELECT w, lang, count(*) AS n FROM <words> GROUP BY w, lang), t AS (SELECT w, lang, n, sum(n) OVER (PARTITION BY w) AS total FROM c),
l AS (SELECT w, row_number() OVER (ORDER BY sum(n) DESC, w) AS r FROM c GROUP BY w)
SELECT t.w, t.lang, CAST(t.n AS BIGINT) AS n, CAST(l.r AS BIGINT) AS rank FROM t JOIN l ON t.w = l.w WHERE l.r <= 6500 AND t.n * 5 >= t.total"""

# P10: the first reason that excludes a word.
SQL["exclusion_reasons"] = """
WITH c AS (SELECT w, count(*) AS n, count(DISTINCT doc_id) AS docs FROM <words> GROUP BY w), b AS (SELECT DISTINCT w FROM <benchmark words>),
r AS (SELECT CASE WHEN length(c.w) = 1 THEN 'single letter' WHEN c.w IN ('idiot', 'scum') THEN 'profanity' WHEN n < 2 THEN 'too few tokens' WHEN docs < 2 THEN 'one text' WHEN b.w IS NULL AND n < 20 THEN 'no entry' ELSE 'kept' END AS reason, c.w FROM c LEFT JOIN b ON c.w = b.w)
SELECT reason, count(*) AS n, min(w) AS first_word FROM r GROUP BY reason"""

# Glosses that define instead of translate.
SQL["definitional_glosses"] = """
SELECT conv_id, turn, <words in first part> > 5 OR lower(text) LIKE 'to %' OR lower(text) LIKE '%used to%' AS definitional FROM {conversations} WHERE role <> 'system'"""

# Sentences all of whose words are among the first thousand.
SQL["available_sentences"] = """
WITH c AS (SELECT w, count(*) AS n FROM <words> GROUP BY w), k AS (SELECT w FROM (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS r FROM c) x WHERE r <= 1000),
t AS (SELECT doc_id, spos, lower(w) AS w FROM <cased>) SELECT t.doc_id, t.spos, count(*) AS words FROM t LEFT JOIN k ON t.w = k.w GROUP BY t.doc_id, t.spos HAVING count(*) = count(k.w)"""

# Levels in order, with their items and sets.
SQL["level_projection"] = """
WITH l AS (SELECT p_brand AS level, count(*) AS items FROM {part} GROUP BY p_brand)
SELECT level, items, CAST(ceil(items / 10.0E0) AS BIGINT) AS sets, CAST(row_number() OVER (ORDER BY level) - 1 AS BIGINT) AS place FROM l"""

# The lowest clip with a permissive licence.
SQL["lowest_clip"] = """
WITH l AS (SELECT l_orderkey, min(l_linenumber) AS clip FROM {lineitem} WHERE l_returnflag IN ('A', 'N') GROUP BY l_orderkey)
SELECT o_orderkey, CAST(coalesce(clip, -1) AS BIGINT) AS clip FROM {orders} LEFT JOIN l ON o_orderkey = l_orderkey"""

# Readings of list words: the spelling itself, else its commonest accented one, else none.
SQL["reading_fallbacks"] = """
WITH corpus AS (SELECT w, count(*) AS n FROM <words> GROUP BY w), folded AS (SELECT w, <fold w> AS f, n FROM corpus WHERE w <> <fold w>),
best AS (SELECT f, w FROM (SELECT f, w, row_number() OVER (PARTITION BY f ORDER BY n DESC, w) AS k FROM folded) x WHERE k = 1), spoken AS (SELECT w, count(*) AS n FROM <spoken words> GROUP BY w)
SELECT s.w, s.n, coalesce(c.w, b.w, '?') AS reading, CASE WHEN c.w IS NOT NULL THEN 'exact' WHEN b.w IS NOT NULL THEN 'accented' ELSE 'none' END AS how FROM spoken s LEFT JOIN corpus c ON s.w = c.w LEFT JOIN best b ON s.w = b.f"""

# Tokens and dictionary entries by surface and class.
SQL["token_entries"] = """
WITH dict AS (SELECT p_name AS surface, p_brand AS class, min(p_partkey) AS id FROM {part} GROUP BY p_name, p_brand), t AS (SELECT p_partkey, p_name, p_brand FROM {part} WHERE p_size > 10)
SELECT t.p_partkey, dict.id FROM t JOIN dict ON t.p_name = dict.surface AND t.p_brand = dict.class"""

# Links of tokens to words: as written, small, or folded.
SQL["linked_tokens"] = """
WITH words AS (SELECT w, min(item_id) AS id FROM <benchmark words> GROUP BY w), folds AS (SELECT <fold w> AS f, min(id) AS id FROM words GROUP BY <fold w>),
t AS (SELECT w AS form, lower(w) AS w, count(*) AS n FROM <cased> GROUP BY w, lower(w)), f AS (SELECT form, w, <fold w> AS f, n FROM t)
SELECT f.form, f.n, CAST(coalesce(a.id, b.id, c.id) AS BIGINT) AS id, CASE WHEN a.id IS NOT NULL THEN 'form' WHEN b.id IS NOT NULL THEN 'small' WHEN c.id IS NOT NULL THEN 'folded' ELSE 'none' END AS how
FROM f LEFT JOIN words a ON f.form = a.w LEFT JOIN words b ON f.w = b.w LEFT JOIN folds c ON f.f = c.f"""

# Sentences whose words are all in the pack or among the commonest 3000.
SQL["in_pack_sentences"] = """
WITH c AS (SELECT w, count(*) AS n FROM <words> GROUP BY w), k AS (SELECT w FROM (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS r FROM c) x WHERE r <= 3000 UNION SELECT w FROM <benchmark words>),
t AS (SELECT doc_id, spos, lower(w) AS w FROM <cased>), o AS (SELECT DISTINCT t.doc_id, t.spos FROM t LEFT JOIN k ON t.w = k.w WHERE k.w IS NULL), s AS (SELECT DISTINCT doc_id, spos FROM t)
SELECT s.doc_id, s.spos FROM s LEFT JOIN o ON s.doc_id = o.doc_id AND s.spos = o.spos WHERE o.doc_id IS NULL"""

# Examples of a letter: words that hold it and otherwise letters of the first twelve alone.
SQL["glyph_examples"] = """
WITH l AS (SELECT w, c FROM <letters of words>), g AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) AS r FROM l GROUP BY c),
s AS (SELECT l.w, l.c, g.r, count(*) OVER (PARTITION BY l.w) AS letters, count(CASE WHEN g.r <= 12 THEN 1 END) OVER (PARTITION BY l.w) AS known FROM l JOIN g ON l.c = g.c),
e AS (SELECT c, w, row_number() OVER (PARTITION BY c ORDER BY length(w), w) AS k FROM s WHERE known - CASE WHEN r <= 12 THEN 1 ELSE 0 END = letters - 1)
SELECT c, w, CAST(k AS BIGINT) AS k FROM e WHERE k <= 3"""

# Tokens that a frequent pair of words spans.
SQL["spanned_tokens"] = """
WITH t AS (SELECT doc_id, spos, pos, lower(w) AS w, lower(lead(w) OVER (PARTITION BY doc_id, spos ORDER BY pos)) AS next FROM <cased>), b AS (SELECT w, next FROM t WHERE next IS NOT NULL GROUP BY w, next HAVING count(*) >= 10),
s AS (SELECT t.doc_id, t.spos, t.pos AS a, t.pos + 1 AS z FROM t JOIN b ON t.w = b.w AND t.next = b.next)
SELECT t.doc_id, CAST(count(*) AS BIGINT) AS tokens, count(CASE WHEN x.n > 0 THEN 1 END) AS spanned FROM t LEFT JOIN (SELECT doc_id, spos, p, count(*) AS n FROM (SELECT doc_id, spos, a AS p FROM s UNION ALL SELECT doc_id, spos, z FROM s) y GROUP BY doc_id, spos, p) x ON t.doc_id = x.doc_id AND t.spos = x.spos AND t.pos = x.p GROUP BY t.doc_id"""

# Links that are dropped here and linked nowhere else.
SQL["orphaned_links"] = """
WITH gone AS (SELECT DISTINCT l_partkey FROM {lineitem} WHERE l_returnflag = 'R'), kept AS (SELECT DISTINCT l_partkey FROM {lineitem} WHERE l_returnflag <> 'R')
SELECT gone.l_partkey FROM gone LEFT JOIN kept ON gone.l_partkey = kept.l_partkey WHERE kept.l_partkey IS NULL"""

# Endings are cut, three times at most, until a usable word is met.
SQL["form_chase"] = """
WITH c AS (SELECT w, count(*) AS n FROM <words> GROUP BY w), u AS (SELECT w FROM c WHERE n >= 20),
s AS (SELECT c.w, substr(c.w, 1, greatest(length(c.w) - 1, 1)) AS a, substr(c.w, 1, greatest(length(c.w) - 2, 1)) AS b, substr(c.w, 1, greatest(length(c.w) - 3, 1)) AS d FROM c)
SELECT s.w, coalesce(u0.w, u1.w, u2.w, u3.w) AS lemma, CAST(CASE WHEN u0.w IS NOT NULL THEN 0 WHEN u1.w IS NOT NULL THEN 1 WHEN u2.w IS NOT NULL THEN 2 WHEN u3.w IS NOT NULL THEN 3 END AS BIGINT) AS depth
FROM s LEFT JOIN u u0 ON s.w = u0.w LEFT JOIN u u1 ON s.a = u1.w LEFT JOIN u u2 ON s.b = u2.w LEFT JOIN u u3 ON s.d = u3.w"""

# Entries compacted to a line a word.
SQL["compact_lexicon"] = "SELECT w, <as sorted list of lang> AS readings, count(DISTINCT lang) AS n_readings, count(*) AS n FROM <words> GROUP BY w"

# Day numbers of dates as text; what is no date has none.
SQL["day_numbers"] = """
WITH t AS (SELECT o_orderkey, concat(CAST(1990 + o_custkey % 40 AS VARCHAR(4)), '-', lpad(CAST(1 + o_orderkey % 13 AS VARCHAR(2)), 2, '0'), '-', lpad(CAST(1 + o_custkey % 31 AS VARCHAR(2)), 2, '0')) AS d FROM {orders})
SELECT o_orderkey, d, CAST(<as a day number> AS BIGINT) AS day FROM t"""

# M04, ST06: fields of an import over those of the record before it, and defaults.
SQL["merged_records"] = """
WITH prev AS (SELECT c_custkey AS id, c_mktsegment AS theme, c_nationkey AS mix FROM {customer}), import AS (SELECT o_custkey AS id, max(o_orderpriority) AS theme FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT coalesce(i.id, p.id) AS id, coalesce(i.theme, p.theme, 'plain') AS theme, CAST(coalesce(p.mix, 0) AS BIGINT) AS mix, i.id IS NOT NULL AS imported FROM prev p FULL OUTER JOIN import i ON p.id = i.id"""

# What is wrong with a stored record.
SQL["stored_records"] = """
WITH j AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN substr(props, 2) WHEN event_id % 7 = 0 THEN replace(props, 'k', 'q') ELSE props END AS j FROM {events})
SELECT event_id, CASE WHEN NOT <is a record> THEN 'no JSON' WHEN NOT (<has k>) THEN 'no k' ELSE 'good' END AS reason FROM j"""

# Records of a user as one JSON map with sorted keys.
SQL["record_maps"] = """
WITH e AS (SELECT user_id, k, ok, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS i FROM <reviews>),
f AS (SELECT user_id, k, count(CASE WHEN ok THEN 1 END) AS r, count(CASE WHEN NOT ok THEN 1 END) AS w, max(i) - coalesce(max(CASE WHEN NOT ok THEN i END), 0) AS s FROM e GROUP BY user_id, k)
SELECT user_id, <as map of records> AS records FROM f GROUP BY user_id"""

# A map turned around; of several keys of a value the last stays.
SQL["inverted_map"] = "SELECT p_name AS value, max(p_partkey) AS last_key, count(*) AS n FROM {part} GROUP BY p_name"

# Features of a string of them.
SQL["feature_pairs"] = "SELECT p_partkey, name, value FROM <features>"

# ST03: counters after placement: never lowered; what placement adds is provisional.
SQL["placed_counters"] = """
WITH e AS (SELECT user_id, CAST(floor(k / 10) AS BIGINT) AS bucket, ok FROM <reviews>), c AS (SELECT user_id, bucket, count(*) AS n, count(CASE WHEN ok THEN 1 END) AS r FROM e GROUP BY user_id, bucket),
s AS (SELECT user_id, min(CASE WHEN r = 0 OR r < 0.75 * n THEN bucket END) AS stop, max(bucket) AS top FROM c GROUP BY user_id), h AS (SELECT user_id, count(DISTINCT CASE WHEN ok THEN k END) AS learned FROM <reviews> GROUP BY user_id)
SELECT s.user_id, greatest(CAST(floor(learned / 10) AS BIGINT), coalesce(stop, top + 1)) AS sets, coalesce(stop, top + 1) > CAST(floor(learned / 10) AS BIGINT) AS provisional FROM s JOIN h ON s.user_id = h.user_id"""

# ST07: flags that are set once, whatever repeats.
SQL["flag_states"] = """
SELECT user_id, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) = 1 AS choice_seen, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 AS unlocked, min(CASE WHEN event_type = 'error' THEN event_id END) AS first_notice FROM {events} GROUP BY user_id"""

# Findings of several rules as rows of a severity.
SQL["pack_findings"] = """
SELECT 'error' AS severity, 'part without name' AS rule, CAST(p_partkey AS BIGINT) AS id FROM {part} WHERE p_name IS NULL OR trim(p_name) = ''
UNION ALL SELECT 'error', 'size out of range', p_partkey FROM {part} WHERE p_size NOT BETWEEN 1 AND 50
UNION ALL SELECT 'warning', 'brand without number', p_partkey FROM {part} WHERE regexp_extract(p_brand, '[0-9]+', 0) = ''
UNION ALL SELECT 'warning', 'name of several parts', min(p_partkey) FROM {part} GROUP BY p_name HAVING count(*) > 1
UNION ALL SELECT 'error', 'line of unknown order', l_orderkey FROM {lineitem} LEFT JOIN {orders} ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL
UNION ALL SELECT 'warning', 'document of under 20 letters', doc_id FROM {documents} WHERE length(text) < 20"""

# Conversations whose turns have gaps, begin oddly, or repeat a role.
SQL["conversation_shapes"] = """
WITH t AS (SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, min(turn) OVER (PARTITION BY conv_id) AS first FROM {conversations})
SELECT conv_id, count(*) AS turns, count(CASE WHEN turn <> first + i - 1 THEN 1 END) AS gaps, count(CASE WHEN role = before THEN 1 END) AS repeats, count(CASE WHEN trim(coalesce(text, '')) = '' THEN 1 END) AS blanks, max(CASE WHEN i = 1 AND role = 'assistant' THEN 1 ELSE 0 END) = 1 AS odd_start FROM t GROUP BY conv_id"""

# Words of a language with letters that it doesn't have.
SQL["foreign_letters"] = """
SELECT lang, w, count(*) AS n FROM <words> WHERE (lang = 'en' AND w <> <fold w>) OR (lang = 'de' AND regexp_extract(w, '[çñéèêáàíó]', 0) <> '') OR (lang = 'es' AND regexp_extract(w, '[çßäöèêàâ]', 0) <> '') OR (lang = 'fr' AND regexp_extract(w, '[ñßäöáíóú]', 0) <> '') GROUP BY lang, w"""

# Bands of words that two lists share, counted against each other.
SQL["level_crosscheck"] = """
WITH c AS (SELECT w, count(*) AS n FROM <words> GROUP BY w), d AS (SELECT w, count(*) AS n FROM <spoken words> GROUP BY w),
a AS (SELECT w, r FROM (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS r FROM c) x WHERE r <= 2000), b AS (SELECT w, r FROM (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS r FROM d) x WHERE r <= 2000),
x AS (SELECT CASE WHEN a.r <= 500 THEN 'A' WHEN a.r <= 2000 THEN 'B' ELSE 'C' END AS own, CASE WHEN b.r <= 500 THEN 'A' WHEN b.r <= 2000 THEN 'B' ELSE 'C' END AS other FROM c JOIN d ON c.w = d.w LEFT JOIN a ON c.w = a.w LEFT JOIN b ON c.w = b.w)
SELECT own, other, count(*) AS n FROM x GROUP BY own, other"""

# Entries with a sense that isn't marked.
SQL["usable_entries"] = """
SELECT o_orderkey, count(l_orderkey) AS senses, count(CASE WHEN l_returnflag <> 'R' AND l_discount < 0.08 THEN 1 END) > 0 AS usable FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey"""

# Kinds of items that a pool has four options for.
SQL["option_fit"] = """
SELECT p_brand AS pool, count(DISTINCT p_name) >= 4 AS by_name, count(DISTINCT p_type) >= 4 AS by_type, count(DISTINCT p_size) >= 4 AS by_size, count(DISTINCT p_name) AS names FROM {part} GROUP BY p_brand"""

# Parts of a pool that would be a second right answer for each other: one name, another part.
SQL["second_answers"] = """
WITH c AS (SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_name) - 1 AS same_name, count(*) OVER (PARTITION BY p_brand, p_type, p_size) - 1 AS same_kind FROM {part})
SELECT p_partkey, same_name, same_kind FROM c WHERE same_name > 0 OR same_kind > 0"""

# Words of names that others in the pool share.
SQL["shared_surfaces"] = """
WITH w AS (SELECT p_brand, p_partkey, split_part(p_name, ' ', 1) AS s FROM {part} UNION SELECT p_brand, p_partkey, split_part(p_name, ' ', 2) FROM {part}), c AS (SELECT p_partkey, s, count(*) OVER (PARTITION BY p_brand, s) - 1 AS others FROM w WHERE s <> '')
SELECT p_partkey, CAST(sum(others) AS BIGINT) AS sharing, min(CASE WHEN others > 0 THEN s END) AS first_shared FROM c GROUP BY p_partkey"""

# P20: flags of a pack that its parts give, with defaults.
SQL["feature_flags"] = """
SELECT n_name AS pack, count(c_custkey) > 0 AS has_words, coalesce(max(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 END), 0) = 1 AS typing, coalesce(max(CASE WHEN c_acctbal < 0 THEN 1 END), 0) = 1 AS tones, coalesce(min(c_mktsegment), 'none') AS first_segment
FROM {nation} LEFT JOIN {customer} ON n_nationkey = c_nationkey GROUP BY n_name"""

# Function words: short and common in their language.
SQL["function_words"] = """
WITH c AS (SELECT lang, w, count(*) AS n FROM <words> GROUP BY lang, w), r AS (SELECT lang, w, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS r FROM c)
SELECT lang, w, n FROM r WHERE r <= 30 AND length(w) <= 4"""

# Records cut to the fields that are shipped.
SQL["shipped_fields"] = "SELECT p_partkey AS id, lower(trim(p_name)) AS w, p_brand AS lv, p_type AS pos, CAST(p_size AS BIGINT) AS set FROM {part} WHERE p_size <= 40"

# Language tags, and direction by the language.
SQL["language_tags"] = """
SELECT lang, concat(lang, '-', upper(lang)) AS tag, regexp_extract(concat(lang, '-', upper(lang)), '<two or three letters>', 0) AS key, CASE WHEN lang IN ('ar', 'fa', 'ur', 'he') THEN 'rtl' ELSE 'ltr' END AS direction, count(*) AS n FROM {documents} GROUP BY lang"""

# Units with their first word.
SQL["unit_heads"] = """
WITH u AS (SELECT item_id, regexp_extract(lower(text), '[a-z]+', 0) AS head FROM {benchmark}), c AS (SELECT w, count(*) AS n FROM <words> GROUP BY w)
SELECT item_id, head, coalesce(n, 0) AS n FROM u LEFT JOIN c ON u.head = c.w"""

# Tokens side by side that make a dictionary word.
SQL["merged_compounds"] = """
WITH c AS (SELECT w FROM <words> GROUP BY w HAVING count(*) >= 5), b AS (SELECT w, follower, count(*) AS n FROM <pairs> WHERE follower IS NOT NULL GROUP BY w, follower)
SELECT b.w, b.follower, b.n, c.w AS compound FROM b JOIN c ON concat(b.w, b.follower) = c.w WHERE b.n >= 2"""

# Words whose second reading has a fifth of their tokens, which split off as entries of their own.
SQL["split_entries"] = """
WITH c AS (SELECT w, lang, count(*) AS n FROM <words> GROUP BY w, lang), r AS (SELECT w, lang, n, sum(n) OVER (PARTITION BY w) AS total, row_number() OVER (PARTITION BY w ORDER BY n DESC, lang) AS k FROM c)
SELECT w, lang, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM r WHERE k > 1 AND n * 5 >= total AND total >= 10"""

# The fewest options of an item over eight seeded draws of its pool.
SQL["fewest_options"] = """
WITH s AS (SELECT 0 AS seed UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7),
d AS (SELECT p_brand, seed, p_name, row_number() OVER (PARTITION BY p_brand, seed ORDER BY <hash of part and seed>, p_partkey) AS k FROM {part} CROSS JOIN s)
SELECT p_brand AS pool, min(n) AS fewest FROM (SELECT p_brand, seed, count(DISTINCT p_name) AS n FROM d WHERE k <= 4 GROUP BY p_brand, seed) x GROUP BY p_brand"""
