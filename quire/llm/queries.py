"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from quire.llm import (
    extraction, interaction, merkle, mixing, ngram_join, pieces, quality, secrets, sharding, substrings, toxicity, vectors,
    warc,
)
from quire.llm.common import table


def op1_quality_rules(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op2_warc(spark, sf_dir):
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark, sf_dir):
    return pieces.piece_report(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("row")


def op6_sharding(spark, sf_dir):
    return sharding.shard_plan(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark, sf_dir):
    return substrings.repeat_report(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark, sf_dir):
    return extraction.extraction_report(table(spark, sf_dir, "pages"))


def op9_ngram_join(spark, sf_dir):
    return ngram_join.join_report(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark, sf_dir):
    return vectors.vector_report(table(spark, sf_dir, "embeddings"))


def op11_filter_interaction(spark, sf_dir):
    return interaction.interaction_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_warc, op3_sentencepiece, op4_secret_scans, op5_mixing, op6_sharding,
    op7_substring_dedup, op8_html_extraction, op9_ngram_join, op10_embedding_near_dedup,
    op11_filter_interaction, op12_toxicity, op13_merkle_manifest,
)}
#: op1, op3, op4, op5, op6 and op8 are held against brute force in the tests, op12 against held-out labels.
ORACLES: dict[str, str] = {
    "op2_warc": r"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY s, n) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest,
 CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM m""",
    "op7_substring_dedup": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
hit AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY gram) AS low FROM g) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM hit),
gl AS (SELECT doc_id, list(pos) AS ps FROM gone GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, coalesce(ps, []) AS ps FROM w LEFT JOIN gl ON gl.doc_id = w.doc_id),
x AS (SELECT doc_id, pos, ws[pos] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM k)),
y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.pos) AS kept FROM x
  ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.pos = x.pos GROUP BY x.doc_id)
SELECT k.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed,
 sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN y ON y.doc_id = k.doc_id""",
    "op9_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS g FROM w),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM t a JOIN t b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM s JOIN m ON m.a = s.doc_id""",
    "op10_embedding_near_dedup": r"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON n.a = c.vec_id""",
    "op11_filter_interaction": r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
low AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, concat(CASE WHEN len(w) < 100 THEN 'A' END,
  CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END,
  CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 10 * length(d.t) THEN 'C' END,
  CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' END, CASE WHEN d.doc_id > low THEN 'E' END) AS fails,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d JOIN low ON low.t = d.t LEFT JOIN g ON g.doc_id = d.doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS o FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, CAST(i AS INTEGER) AS step, o[i] AS letter, o[1:i - 1] AS before FROM o, range(1, 6) r(i)),
q AS (SELECT part, o, step, letter, n, good, toxic, fails = letter AS lone, contains(fails, letter) AS hit,
  translate(fails, before, '') = fails AS there FROM m, s),
r AS (SELECT part, o AS filter_order, step, letter,
  CAST(coalesce(sum(n) FILTER (WHERE there AND NOT hit), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (WHERE there AND hit), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE hit AND NOT there), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE lone), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE there AND hit), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (WHERE there AND hit), 0) AS BIGINT) AS toxic_lost FROM q GROUP BY ALL)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r""",
    "op13_merkle_manifest": r"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(
  [b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
d AS (SELECT *, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END,
  CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
  CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END,
  CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END) AS head,
  list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
   lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])) AS crc,
  replace(text, chr(10), '') AS flat FROM documents, crc),
l AS (SELECT doc_id, source, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
  CASE WHEN crc & 1 = 0 THEN text ELSE flat END AS other, head FROM d),
n AS (SELECT doc_id, leaf, sha256(concat(head, CASE WHEN other IS NULL THEN '-' ELSE concat(strlen(other), ':', other) END)) AS other,
  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY source) AS n FROM l),
low AS (SELECT tree, 0 AS lvl, pos, leaf AS h, n FROM n UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1
  GROUP BY tree, lvl, pos // 3, n),
sub AS (SELECT tree, h AS subroot, lvl AS height, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (SELECT 0 AS lvl, tree AS pos, subroot AS h, n FROM sub UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n),
root AS (SELECT h AS root FROM top WHERE n = 1),
sib AS (SELECT a.tree, a.pos, b.lvl AS k, b.h, b.pos AS place, a.pos // CAST(pow(3, b.lvl) AS BIGINT) AS mine
  FROM n a JOIN low b ON b.tree = a.tree AND b.n > 1 AND b.pos // 3 = a.pos // CAST(pow(3, b.lvl + 1) AS BIGINT)
 UNION ALL SELECT a.tree, a.pos, s.height + b.lvl, b.h, b.pos, a.tree // CAST(pow(3, b.lvl) AS BIGINT)
  FROM n a JOIN sub s ON s.tree = a.tree JOIN top b ON b.n > 1 AND b.pos // 3 = a.tree // CAST(pow(3, b.lvl + 1) AS BIGINT)),
way AS (SELECT tree, pos, k, coalesce(string_agg(h, '' ORDER BY place) FILTER (WHERE place < mine), '') AS before,
  coalesce(string_agg(h, '' ORDER BY place) FILTER (WHERE place > mine), '') AS after FROM sib GROUP BY tree, pos, k),
proof AS (SELECT tree, pos, sha256(string_agg(concat(before, after), '' ORDER BY k)) AS proof, count(*) AS steps FROM way GROUP BY tree, pos),
fold AS (SELECT tree, pos, CAST(0 AS BIGINT) AS k, other AS h FROM n UNION ALL
  SELECT f.tree, f.pos, f.k + 1, sha256(concat(before, f.h, after)) FROM fold f JOIN way w ON w.tree = f.tree AND w.pos = f.pos AND w.k = f.k)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM n JOIN sub ON sub.tree = n.tree CROSS JOIN root LEFT JOIN proof p ON p.tree = n.tree AND p.pos = n.pos
JOIN fold f ON f.tree = n.tree AND f.pos = n.pos AND f.k = coalesce(p.steps, 0)""",
}
