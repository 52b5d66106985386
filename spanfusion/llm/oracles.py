"""DuckDB SQL of the operators that SQL can express, over the tables of a folder."""

from __future__ import annotations

OP4_SUFFIX_DEDUP = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), starts AS (
  SELECT doc_id, x, unnest(range(0, len(x) // 2 - 399)) AS i FROM docs
), strings AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM starts
), repeated AS (
  SELECT h FROM strings GROUP BY h HAVING count(*) > 1
), hits AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens
  FROM strings SEMI JOIN repeated USING (h)
), numbered AS (
  SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits
), runs AS (
  SELECT doc_id, min(i) AS s, max(i) + 400 AS e FROM numbered GROUP BY doc_id, run
), before AS (
  SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS last FROM runs
), cut AS (
  SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS tail,
         string_agg(substr(x, 2 * last + 1, 2 * (s - last)), '' ORDER BY s) AS kept
  FROM before JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""

OP9_NEAR_DUPLICATES = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM texts WHERE len(w) > 0)
), sets AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS body FROM shingles GROUP BY doc_id
), classes AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY body) AS class_id FROM sets
), own AS (
  SELECT doc_id, n, s FROM shingles JOIN classes USING (doc_id) WHERE doc_id = class_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM own x JOIN own y ON x.s = y.s AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), lowest AS (
  SELECT a AS class_id, least(a, min(b)) AS low FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, class_id, doc_id) AS component_id,
       doc_id = coalesce(low, class_id, doc_id) AS kept, class_id
FROM documents LEFT JOIN classes USING (doc_id) LEFT JOIN lowest USING (class_id)
"""

OP10_SUBSTRING_DEDUP = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM texts)
), earliest AS (
  SELECT h, min(doc_id) AS low FROM windows GROUP BY h
), covered AS (
  SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN earliest USING (h), range(0, 13) AS steps(k) WHERE low < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM texts
), cut AS (
  SELECT doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE c.p IS NULL) AS kept
  FROM words w LEFT JOIN covered c USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""

OP11_CHAT_FORMAT = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, '<|im_start|>' || role || chr(10)
    || regexp_replace(text, '(<)(\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>))|(\[)(\\*(?:INST\]|/INST\]))', '\1\3\\\2\4', 'g')
    || '<|im_end|>' || chr(10) AS piece
  FROM given
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, piece)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, piece) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(piece))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP12_LEXICAL_SEARCH = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), stats AS (
  SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM docs WHERE len(w) > 0
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), counts AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counts, stats GROUP BY term, n_docs
), gains AS (
  SELECT r, doc_id, term, weights.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * len(docs.w) * n_docs) // n_terms)))) AS g
  FROM counts JOIN weights USING (term) JOIN docs USING (r), stats
), scores AS (
  SELECT item_id, r, doc_id, sum(g)::BIGINT AS score FROM asked JOIN gains USING (term) GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

OP13_SOURCE_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(w) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT lang, source, (SELECT count(*) FROM kept k WHERE k.lang = d.lang) AS v, (SELECT coalesce(sum(n), 0)::BIGINT FROM counted c WHERE c.lang = d.lang AND c.source = d.source) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) d
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), base AS (
  SELECT s.lang, s.term, 1 + (1000000000::HUGEINT * (sum(s.n) + 5)) // ((SELECT sum(total) FROM groups g WHERE g.lang = s.lang) + 5 * (SELECT count(*) FROM kept k WHERE k.lang = s.lang)) AS q
  FROM shares s GROUP BY s.lang, s.term
), apart AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
), found AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN apart a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares JOIN base USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""

ORACLES = {
    "op4_suffix_dedup": OP4_SUFFIX_DEDUP,
    "op9_near_duplicates": OP9_NEAR_DUPLICATES,
    "op10_substring_dedup": OP10_SUBSTRING_DEDUP,
    "op11_chat_format": OP11_CHAT_FORMAT,
    "op12_lexical_search": OP12_LEXICAL_SEARCH,
    "op13_source_divergence": OP13_SOURCE_DIVERGENCE,
}
