"""DuckDB SQL for the registered queries that SQL can express."""

from .quality_rules import CUTOFFS, RULES, Risk
from .url_filter import RULES as URL_RULES

_W = r"[^\x20\x09-\x0D]+"

_op1 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_op8 = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM parts
), split AS (
  SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM hosts
), rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
fits AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC, length(h) DESC, v = 'block' DESC) AS r
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM split LEFT JOIN (SELECT * FROM fits WHERE r = 1) USING (page_id)
"""

_risk = Risk()
_p = _risk.alpha / len(RULES)
_signal = {r: sql.replace("0D", "0.0").replace(" / ", "::DOUBLE / ") for r, sql in RULES.items()}
_tests = " UNION ALL ".join(
    f"SELECT stratum, '{r}' AS rule, {i} AS i, {c}::DOUBLE AS cutoff, count(*) AS n, count(*) FILTER (({_signal[r]}) > {c}::DOUBLE) AS k FROM good GROUP BY stratum" for r in RULES for i, c in enumerate(CUTOFFS)
)
_fails = " OR ".join(f"coalesce(({_signal[r]}) > cut_{r}, false)" for r in RULES)
_op10 = f"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM words, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i) AS r
), repeated AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM windows, (VALUES (0), (1), (2)) AS o(d) WHERE n > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS kinds FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) AS l WHERE regexp_matches(line, '{_W}') GROUP BY doc_id
), counted AS (
  SELECT doc_id, stratum, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_lines - kinds, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN repeated USING (doc_id) LEFT JOIN lines USING (doc_id)
), base AS (
  SELECT *, n_words < {_risk.min_words} OR 100 * n_repeat_words > {_risk.max_repeat_pct} * n_words AS base_failed FROM counted
), good AS (
  SELECT stratum, text, any_value(n_words) AS n_words, any_value(word_chars) AS word_chars, any_value(n_symbols) AS n_symbols, any_value(n_lines) AS n_lines, any_value(n_dup_lines) AS n_dup_lines, any_value(n_repeat_words) AS n_repeat_words
  FROM base JOIN (SELECT doc_id, min(quality) AS label FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed GROUP BY stratum, text HAVING min(label) = 1
), tests AS ({_tests}), tried AS (
  SELECT *, CASE WHEN k >= n * {_p!r} THEN false ELSE
    list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_p!r}) + (n - j) * ln(1 - {_p!r}))))
    <= {_risk.delta!r} / (SELECT greatest(1, {len(RULES)} * count(DISTINCT stratum)) FROM good) END AS ok FROM tests
), passed AS (
  SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY i) AS so_far FROM tried
), cuts AS (
  SELECT stratum, {", ".join(f"min(cutoff) FILTER (so_far AND rule = '{r}') AS cut_{r}" for r in RULES)} FROM passed GROUP BY stratum
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_fails}) AS kept
FROM base LEFT JOIN cuts USING (stratum)
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LW = r"regexp_extract_all(translate(coalesce(text, ''), " + _AZ + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_op11 = f"""
WITH docs AS (SELECT doc_id, {_LW} AS w FROM documents), items AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, {_LW} AS w FROM benchmark),
windows AS (SELECT row_number() OVER () AS win, item, n, w[k:k + n - 1] AS q FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, p.n, s FROM places p JOIN windows v ON p.n = v.n AND gram = array_to_string(q, ' ')),
covered AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
kinds AS (SELECT DISTINCT doc_id, unnest(w) AS token FROM docs), asked AS (SELECT win, n, unnest(q) AS token, unnest(range(1, n + 1)) AS j FROM windows),
pairs AS (SELECT doc_id, win FROM (SELECT doc_id, win, count(*) AS k FROM (SELECT DISTINCT win, token FROM asked) JOIN kinds USING (token) GROUP BY doc_id, win) JOIN (SELECT win, count(DISTINCT token) AS m FROM asked GROUP BY win) USING (win) WHERE k = m),
near AS (SELECT DISTINCT doc_id, item FROM (SELECT doc_id, win, p - j + d AS s FROM (SELECT doc_id, win, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS p FROM pairs JOIN docs USING (doc_id)) JOIN asked USING (win, token), (VALUES (-1), (0), (1)) AS o(d)
  GROUP BY doc_id, win, s HAVING count(DISTINCT j) = any_value(n)) JOIN windows USING (win)),
close AS (SELECT doc_id, count(*)::BIGINT AS n_near FROM near GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN close USING (doc_id)
"""

_leaf = "sha256(" + " || ".join(f"coalesce(strlen({{t}}{c}::VARCHAR)::VARCHAR || ':' || {{t}}{c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars")) + " || coalesce(strlen({x})::VARCHAR || ':' || {x}, '-'))"
_op13 = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
sums AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, crc),
rows AS (SELECT d.doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
  {_leaf.format(t='d.', x='text')} AS leaf, CASE WHEN h % 5 = 0 THEN {_leaf.format(t='d.', x=f"translate(text, {_AZ})")} END AS claimed FROM documents d JOIN sums USING (doc_id)),
tree AS (SELECT tree, 0 AS level, idx, n, leaf AS digest FROM rows UNION ALL SELECT tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY tree, level, idx // 16, n),
subroots AS (SELECT tree, digest AS subroot FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, tree AS idx, (SELECT count(*) FROM subroots) AS n, subroot AS digest FROM subroots UNION ALL SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 16, n),
nodes AS (SELECT tree, level, idx, n, digest, 0 AS part FROM tree WHERE n > 1 UNION ALL SELECT NULL, level, idx, n, digest, 1 FROM top WHERE n > 1),
own AS (SELECT doc_id, part, level, CASE WHEN part = 0 THEN r.idx ELSE r.tree END // (16 ** level)::BIGINT AS at, r.tree FROM rows r JOIN (SELECT DISTINCT tree, level, part FROM nodes) s ON s.tree = r.tree OR s.part = 1),
near AS (SELECT o.doc_id, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.part, o.level) AS step, o.at, string_agg(digest, '' ORDER BY x.idx) FILTER (x.idx < o.at) AS l, string_agg(digest, '' ORDER BY x.idx) FILTER (x.idx > o.at) AS r
  FROM own o JOIN nodes x ON x.part = o.part AND x.level = o.level AND (x.part = 1 OR x.tree = o.tree) AND x.idx // 16 = o.at // 16 GROUP BY o.doc_id, o.part, o.level, o.at),
proof AS (SELECT doc_id, sha256(string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY step)) AS proof_sha256 FROM near GROUP BY doc_id),
fold AS (SELECT doc_id, 0 AS step, coalesce(claimed, leaf) AS digest FROM rows UNION ALL SELECT doc_id, near.step, sha256(coalesce(l, '') || digest || coalesce(r, '')) FROM fold JOIN near USING (doc_id) WHERE near.step = fold.step + 1)
SELECT doc_id, leaf, subroot, (SELECT digest FROM top WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = (SELECT digest FROM top WHERE n = 1) AS verified
FROM rows JOIN subroots USING (tree) LEFT JOIN proof USING (doc_id) JOIN (SELECT doc_id, arg_max(digest, step) AS digest FROM fold GROUP BY doc_id) f USING (doc_id)
"""

SQL = {"op1_exact_dedup": _op1, "op8_url_filter": _op8, "op10_quality_rules": _op10, "op11_decontamination": _op11, "op13_merkle_manifest": _op13}
