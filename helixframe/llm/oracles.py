"""DuckDB SQL for the queries whose contracts SQL can express, by direct definition rather than by the operators' methods."""

from __future__ import annotations

from helixframe.llm import licenses, mixing

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

#: The smallest id reachable over ``links(a, b)``, for every id in ``nodes(id)``: labels sink until nothing changes.
_COMPONENTS = """ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT w.b, r.root FROM reach r JOIN ways w ON r.id = w.a WHERE r.root < w.b),
roots AS (SELECT id, min(root) AS component_id FROM reach GROUP BY 1)"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM words) x),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN roots r ON r.id = d.doc_id
"""

NEAR_VECTORS = f"""
WITH RECURSIVE good AS (SELECT vec_id, embedding::double[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS},
counts AS (SELECT a, count(*) AS n FROM ways GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN counts ON a = vec_id JOIN roots ON id = vec_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to FROM q
"""

SUBSTRINGS = f"""
WITH words AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words) x),
owners AS (SELECT h, min(doc_id) AS owner FROM windows GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN owners USING (h) WHERE owner < doc_id) y),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words) w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY 1)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM words w LEFT JOIN kept k USING (doc_id)
"""


def _pick(values, rank: str) -> str:
    return "[" + ", ".join(f"cast({v!r} AS double)" for v in values) + f"][({rank}) % {len(values)} + 1]"


MIXING = rf"""
WITH sizes AS (SELECT doc_id, source, len({_WORDS.format('text')}) AS size, md5(concat(coalesce(cast(doc_id AS varchar), ''), ':', md5(coalesce(text, '')))) AS hash FROM documents),
named AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS rank FROM sizes GROUP BY 1),
weighed AS (SELECT *, {_pick(mixing.WEIGHTS, 'rank')} AS weight, {_pick([a for a, _ in mixing.SCHEDULES], 'rank')} AS w0, {_pick([b for _, b in mixing.SCHEDULES], 'rank')} AS w1 FROM named),
filled AS (SELECT *, source_size * cast({mixing.MOST} AS double) / weight AS full_at FROM weighed),
levels AS (SELECT *, (sum(source_size) OVER () - cast({mixing.MOST} AS double) * coalesce(sum(source_size) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled),
targets AS (SELECT source, source_size, w0, w1, CASE WHEN source_size = 0 THEN 0 ELSE least(source_size * cast({mixing.MOST} AS double), coalesce((SELECT level FROM levels x WHERE level <= full_at ORDER BY full_at, rank LIMIT 1), 0) * weight) END AS target FROM levels),
placed AS (SELECT s.*, t.source_size, t.target, t.w0, t.w1, floor(t.target + 0.5)::bigint AS words, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS place
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS copies FROM placed),
taken AS (SELECT *, greatest(0, least(size, words - copies * source_size - place)) AS part FROM cut),
mid AS (SELECT *, least(1.0::double, (place + (CASE WHEN copies > 0 THEN size ELSE part END) / 2.0::double) / target) AS demand, (w0 + w1) / 2 AS mean, (w1 - w0) / 2 AS bend FROM taken)
SELECT doc_id, size, source_size, round(target, 6) AS target, copies * size + part AS taken,
       CASE WHEN (CASE WHEN copies > 0 THEN size ELSE part END) > 0 THEN round(2 * demand * mean / (w0 + sqrt(greatest(0, w0 * w0 + 4 * bend * demand * mean))), 6) END AS first_position FROM mid
"""


def all_oracles() -> dict[str, str]:
    return {
        "op2_license_scan": licenses.oracle(),
        "op3_minhash_neardup": NEAR_DUPLICATES,
        "op5_lattice_neardup": NEAR_VECTORS,
        "op6_curriculum_mix": MIXING,
        "op8_warc_dictionary": WARC,
        "op10_substring_dedup": SUBSTRINGS,
    }
