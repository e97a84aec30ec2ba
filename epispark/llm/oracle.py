"""DuckDB SQL of the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CONTROLS = "### System:|### User:|### Assistant:|### Tool:|### Role:|</role>|</turn>"


def _escaped(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '(\\\\*)({_CONTROLS})', '\\1\\1\\\\\\2', 'g'), '(\\\\+)$', '\\1\\1')"


#: (id, component) of the links table "link" (a, b), both directions in it.
_REACH = """
reach AS (SELECT a AS id, a AS other FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.other = l.a),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""

#: Rules of op13 as (good, bad), spelled out here.
_VOTES = [
    ("n_words >= 100", "n_words < 50"),
    ("word_chars >= 3 * n_words AND word_chars <= 9 * n_words", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words"),
    ("20 * n_symbols <= n_words", "4 * n_symbols > n_words"),
    ("5 * n_repeat_words <= n_words", "100 * n_repeat_words > 40 * n_words"),
    ("n_lines >= 3 AND 10 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("5 * n_upper <= n_letters", "2 * n_upper > n_letters"),
    ("10 * n_letters >= 9 * word_chars", "10 * n_letters < 8 * word_chars"),
    ("20 * n_shouts <= n_words", "4 * n_shouts > n_words"),
    ("20 * n_bare <= n_words", "5 * n_bare > n_words"),
]
_VOTE_LIST = ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 END" for good, bad in _VOTES)
_ODDS = """ln(prior / (1 - prior)) + list_sum(list_transform(range(1, 10), lambda j:
  CASE v[j] WHEN 1 THEN ln(s[j] / (1 - t[j])) WHEN 0 THEN ln((1 - s[j]) / t[j]) ELSE 0 END))"""


def _votes_sum(weight: str, vote: str) -> str:
    return f"list_sum(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN ps[i].v[j] {vote} THEN {weight} ELSE 0 END))"


ORACLE_SQL = {
    "op3_top_documents": """
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS len FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY ALL),
stat AS (SELECT count(*) AS n, avg(len) AS mean FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT doc_id AS query_id, term FROM tf WHERE doc_id % 100 = 0),
s AS (SELECT q.query_id, tf.doc_id,
             round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) ORDER BY q.term), 6) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.doc_id = tf.doc_id, stat GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op4_vector_duplicates": f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id
         AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
{_REACH},
n AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component, vec_id) AS component_id,
       vec_id = coalesce(component, vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.id = e.vec_id LEFT JOIN comp ON comp.id = e.vec_id""",
    "op5_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length('### ' || role || ':')
                     ELSE length('### Role:') + length({_escaped('role')}) + length('</role>') END
                + length({_escaped('text')}) + length('</turn>')) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op8_near_duplicates": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))
                          ELSE w END AS s FROM w),
class AS (SELECT s, min(doc_id) AS head FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT head, len(s) AS n, unnest(s) AS shingle FROM class),
pair AS (SELECT p.head AS a, q.head AS b, p.n AS pn, q.n AS qn, count(*) AS c
         FROM x p JOIN x q ON p.shingle = q.shingle AND p.head < q.head AND 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n) GROUP BY ALL),
near AS (SELECT a, b FROM pair WHERE 100 * c >= 80 * (pn + qn - c)),
link AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
{_REACH}
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(component, head, s.doc_id) AS component_id,
       s.doc_id = coalesce(component, head, s.doc_id) AS kept
FROM s LEFT JOIN class USING (s) LEFT JOIN comp ON comp.id = class.head""",
    "op11_spelling_variants": f"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
byte AS (SELECT run, length(run) AS len, list_concat([4294967295], flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c:
           CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END))) AS bytes FROM run),
h AS (SELECT run, len, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM byte, t),
word AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % len) || substring(run, h % len + 2) ELSE run END AS word FROM h),
w AS (SELECT word, count(*) AS n FROM word WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
del AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS s FROM cut),
shorter AS (SELECT DISTINCT del.word AS a, del.n AS an, w.word AS b, w.n AS bn FROM del JOIN w ON del.s = w.word),
near AS (SELECT x.word AS a, y.word AS b, y.n AS bn FROM del x JOIN del y ON x.i = y.i AND x.s = y.s AND x.word <> y.word
         UNION ALL SELECT a, b, bn FROM shorter UNION ALL SELECT b, a, an FROM shorter),
best AS (SELECT a, count(*) AS n_near, min_by(b, (-bn, b)) AS b, max(bn) AS bn FROM near GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 10 * n THEN b END AS form, CASE WHEN bn >= 10 * n THEN bn END AS form_n
      FROM w LEFT JOIN best ON word = a),
walk AS (SELECT word, word AS top, 0 AS step FROM f UNION ALL SELECT walk.word, form, step + 1 FROM walk JOIN f ON f.word = walk.top WHERE form IS NOT NULL),
last AS (SELECT word, max_by(top, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN last USING (word)""",
    "op12_collocations": f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
q AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
one AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM q) GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM one GROUP BY lang),
two AS (SELECT lang, x, y, count(*) AS f FROM (SELECT lang, w[i] AS x, w[i + 1] AS y FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM q)) GROUP BY ALL),
three AS (SELECT lang, x, y, z, count(*) AS f
          FROM (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM q)) GROUP BY ALL HAVING count(*) >= 10),
held AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL),
cut AS (
  SELECT two.lang, two.x || ' ' || two.y AS phrase, two.f AS a, 1 AS k, p.f AS l, r.f AS r
  FROM two JOIN one p ON p.lang = two.lang AND p.x = two.x JOIN one r ON r.lang = two.lang AND r.x = two.y LEFT JOIN held h ON h.lang = two.lang AND h.x = two.x AND h.y = two.y
  WHERE two.f >= 10 AND (h.f IS NULL OR 100 * h.f < 50 * two.f)
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, p.f, r.f
  FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, p.f, r.f
  FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one r ON r.lang = t.lang AND r.x = t.z),
scored AS (SELECT *, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS score FROM cut),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op13_quality_rules": f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM d),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c >= 2),
cover AS (SELECT r, count(DISTINCT i + o) AS n FROM again, (VALUES (0), (1), (2)) v(o) GROUP BY r),
c AS (SELECT d.r, doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words, length(regexp_replace(text, '\\P{{L}}+', '', 'g')) AS n_letters,
             length(regexp_replace(text, '\\P{{Lu}}+', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!?]+', '', 'g')) AS n_shouts,
             len(list_filter(w, lambda x: NOT regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) AS n_bare
      FROM d LEFT JOIN cover USING (r)),
f AS (SELECT * REPLACE (coalesce(word_chars, 0) AS word_chars) FROM c),
voted AS (SELECT *, [{_VOTE_LIST}] AS v FROM f),
pattern AS (SELECT v, count(*) AS n FROM voted GROUP BY v),
every AS (SELECT list(struct_pack(v := v, n := n)) AS ps FROM pattern),
em AS (
  SELECT 0 AS k, CAST(0.8 AS DOUBLE) AS prior, list_transform(range(1, 10), lambda j: CAST(0.98 AS DOUBLE)) AS s,
         list_transform(range(1, 10), lambda j: CAST(0.3 AS DOUBLE)) AS t
  UNION ALL
  SELECT k + 1, (list_sum(g) + 4) / (list_sum(g) + list_sum(b) + 5), s2,
         list_transform(range(1, 10), lambda j: greatest(1 - s2[j], ({_votes_sum("b[i]", "= 0")} + 5) / ({_votes_sum("b[i]", "IS NOT NULL")} + 10)))
  FROM (SELECT *, list_transform(range(1, 10), lambda j: ({_votes_sum("g[i]", "= 1")} + 9) / ({_votes_sum("g[i]", "IS NOT NULL")} + 10)) AS s2
        FROM (SELECT *, list_transform(range(1, len(ps) + 1), lambda i: ps[i].n - g[i]) AS b
              FROM (SELECT k, ps, list_transform(ps, lambda p: p.n / (1 + exp(-({_ODDS.replace("v[j]", "p.v[j]")})))) AS g FROM em, every WHERE k < 12))))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 1 / (1 + exp(-({_ODDS}))) >= 0.5 AS kept
FROM voted, (SELECT * FROM em WHERE k = 12)""",
}
