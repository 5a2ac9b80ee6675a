"""SQL twins of the queries of this folder that SQL can express."""

from __future__ import annotations

from plantgauge.llm import license_scan as ls, quality_rules as qr


def text_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def quality() -> str:
    word = r"'[^\x20\x09-\x0D]+'"
    notice = " OR ".join("contains(lower(x), '" + p + "')" for p in qr.BOILERPLATE)
    fails = f"""(right(rtrim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN {text_list(qr.SENTENCE_MARKS)}
                 AND len(regexp_extract_all(x, {word})) < {qr.PROSE_WORDS})
        OR len(regexp_extract_all(x, '{qr.MENU_MARKS}')) >= {qr.MENU_COUNT}
        OR (length(x) <= {qr.NOTICE_CHARS} AND ({notice}))
        OR len(regexp_extract_all(x, '{qr.SYMBOL}')) > length(x) * {qr.SYMBOL_SHARE}"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {word}) AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
grams AS (SELECT doc_id, i, g, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
    SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i,
           unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM grams WHERE c > 1) GROUP BY doc_id),
f AS (SELECT doc_id, t, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             len(regexp_extract_all(t, '{qr.SYMBOL}')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             len(regexp_extract_all(array_to_string(list_filter(ls, lambda x: {fails}), chr(10)), {word})) AS lost FROM w),
q AS (SELECT f.*, coalesce(n, 0) AS n_repeat_words, n_words - lost AS kept_words,
             n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words AS base_failed FROM f LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND kept_words >= n_words * {qr.KEPT_SHARE} AS kept, kept_words::BIGINT AS kept_words FROM q"""


def licenses() -> str:
    word = rf"'{ls.WORD}'"
    low = lambda t: f"translate({t}, '{ls.UPPER}', '{ls.LOWER}')"
    hits = " UNION ALL ".join(
        f"SELECT k, unnest(list_filter(range(1, len(ws) + 1), lambda i: {' AND '.join(f"coalesce(ws[i + {j}] = '{p}', false)" for j, p in enumerate(phrase.split()))})) - 1 AS p, '{label}' AS label FROM w"
        for phrase, label in ls.PHRASES.items()
    )
    known = ", ".join(f"({i}, '{label}', {ws!r}, {ls.needed(len(ws), ls.THRESHOLD)})" for i, label, ws in ls.template_tokens(ls.TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all({low('t')}, {word}) AS ws FROM d),
hits AS ({hits}),
base AS (SELECT k, count(*) AS n, min(p) AS lo, max(p) AS hi, list(DISTINCT label) AS labels FROM hits GROUP BY k),
known(id, label, tokens, least) AS (VALUES {known}),
blocks AS (SELECT k, unnest(list_distinct(list_concat(string_split(t, chr(10)),
             list_filter(regexp_split_to_array(t, '\\n[\\x20\\x09\\r]*\\n'), lambda p: contains(p, chr(10)))))) AS b FROM d),
pairs AS (SELECT k, label, len(list_intersect(list_distinct(regexp_extract_all({low('b')}, {word})), tokens)) AS both_, least, len(tokens) AS size
          FROM blocks, known),
more AS (SELECT k, list(DISTINCT label) AS labels, max(both_ / size::DOUBLE) AS best FROM pairs WHERE both_ >= least GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (k) LEFT JOIN more USING (k)"""


REPEATED = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
keys AS (SELECT k, unnest(range(0, len(h) // 2 - 399)) AS q,
                unnest(list_transform(range(0, len(h) // 2 - 399), lambda q: md5(substr(h, 2 * q + 1, 800)))) AS s FROM d WHERE len(h) >= 800),
hit AS (SELECT k, q FROM (SELECT k, q, count(*) OVER (PARTITION BY s) AS c FROM keys) WHERE c > 1),
runs AS (SELECT k, min(q) AS a, max(q) + 400 AS b FROM (
    SELECT k, q, sum(fresh) OVER (PARTITION BY k ORDER BY q) AS run FROM (
      SELECT k, q, CASE WHEN q > lag(q) OVER (PARTITION BY k ORDER BY q) + 400 THEN 1 ELSE 0 END AS fresh FROM hit)) GROUP BY k, run),
gone AS (SELECT k, sum(b - a) AS n, count(*) AS spans FROM runs GROUP BY k),
pieces AS (SELECT k, a AS pos, lag(b, 1, 0) OVER (PARTITION BY k ORDER BY a) AS lo, a AS hi FROM runs
           UNION ALL SELECT k, 1000000000, max(b), 1000000000 FROM runs GROUP BY k),
cut AS (SELECT k, pos, substr(h, 2 * lo + 1, 2 * (least(hi, len(h) // 2) - lo)) AS p FROM pieces JOIN d USING (k)),
rest AS (SELECT k, string_agg(p, '' ORDER BY pos) AS r, string_agg(decode(unhex(regexp_replace(regexp_replace(p, '^([89AB].)+', ''),
             '([CD].|E.([89AB].)?|F.([89AB].){0,2})$', ''))), '' ORDER BY pos) AS t FROM cut GROUP BY k)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(r, h))) AS kept_sha256, coalesce(t, decode(unhex(h))) AS text
FROM d LEFT JOIN gone USING (k) LEFT JOIN rest USING (k)"""

NEAR = r"""
WITH RECURSIVE t AS (SELECT min(doc_id) AS id, coalesce(text, '') AS x, count(*) AS n FROM documents GROUP BY coalesce(text, '')),
w AS (SELECT id, regexp_extract_all(lower(x), '[^\x20\x09-\x0D]+') AS ws FROM t),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(2, len(ws) - 3)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w WHERE len(ws) > 0),
size AS (SELECT id, count(*) AS n FROM s GROUP BY id),
both_ AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
edge AS (SELECT a, b FROM both_ JOIN size x ON x.id = a JOIN size y ON y.id = b WHERE both_.n >= 0.8 * (x.n + y.n - both_.n) - 1e-9),
reach(id, other) AS (SELECT id, id FROM t UNION
    SELECT r.id, e.y FROM reach r JOIN (SELECT a AS x, b AS y FROM edge UNION SELECT b, a FROM edge) e ON e.x = r.other),
label AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id),
class AS (SELECT class_id, sum(n) AS class_size FROM label JOIN t USING (id) GROUP BY class_id)
SELECT d.doc_id, class_id, class_size::BIGINT AS class_size, d.doc_id = class_id AS kept
FROM documents d JOIN t ON coalesce(d.text, '') = t.x JOIN label USING (id) JOIN class USING (class_id)"""

ARCHIVED = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
SELECT page_id, url, size::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN first END AS refers_to FROM q"""

PHRASES = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
      FROM (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
total AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, (VALUES (1), (2), (3), (4), (5)) t(m) WHERE len(ws) >= m)
      GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE m > 1),
cuts AS (SELECT c.lang, c.phrase, k, a, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
         FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c JOIN total USING (lang)
         JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k], ' ')
         JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:c.m], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(a) AS most
           FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM cand)) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000"""

VARIANTS = """
WITH RECURSIVE crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT row_number() OVER () AS k, coalesce(doc_id::VARCHAR, '') || ':' AS id,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
runs AS (SELECT k, id, run, count(*) AS n FROM (SELECT k, id, unnest(regexp_extract_all(x, '[a-zÀ-ÿ]+')) AS run FROM d) GROUP BY ALL),
keyed AS (SELECT run, n, flatten(list_transform(string_split(id || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c) - 64::BIGINT] END)) AS b
    FROM runs WHERE length(run) >= 6),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) AS h FROM keyed, crc),
words AS (SELECT w, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w FROM hashed)
    WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
cut AS (SELECT w, n, i, left(w, i) || '_' || substr(w, i + 2) AS skip, left(w, i) || substr(w, i + 2) AS less
        FROM (SELECT w, n, unnest(range(0, length(w))) AS i FROM words)),
near AS (SELECT a.w, b.w AS o, b.n FROM cut a JOIN cut b ON a.skip = b.skip AND a.w <> b.w
         UNION SELECT c.w, s.w, s.n FROM cut c JOIN words s ON c.less = s.w
         UNION SELECT s.w, c.w, c.n FROM cut c JOIN words s ON c.less = s.w),
best AS (SELECT w, count(*) AS n_near, first(o ORDER BY n DESC, o) AS o, max(n) AS m FROM near GROUP BY w),
told AS (SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN o END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
         FROM words LEFT JOIN best USING (w)),
walk(w, last) AS (SELECT w, w FROM told UNION ALL SELECT walk.w, told.form FROM walk JOIN told ON told.w = walk.last WHERE told.form IS NOT NULL)
SELECT told.w AS word, told.form, walk.last AS root, told.n, told.n_near::BIGINT AS n_near, told.form_n
FROM told JOIN walk ON walk.w = told.w JOIN told e ON e.w = walk.last AND e.form IS NULL"""

TWINS = {
    "op3_repeated_strings": REPEATED,
    "op7_quality_rules": quality(),
    "op8_near_dedup": NEAR,
    "op10_license_scan": licenses(),
    "op11_collocations": PHRASES,
    "op12_spelling_variants": VARIANTS,
    "op13_warc": ARCHIVED,
}
