"""SQL of the registered queries whose results SQL can express."""

from __future__ import annotations

FANOUT, LEVELS = 16, 7

#: The leaf digest of a row of documents, for a given text.
_LEAF = "sha256(" + " || ".join(
    f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    for c in ("documents.doc_id", "source", "lang", "n_chars", "{text}")
) + ")"

_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _crc(digits: int = 19) -> str:
    """crc(doc_id, crc): crc32 of the decimal doc_id, byte by byte with the table of 256 entries."""
    parts = ["b0 AS (SELECT i, i AS c FROM range(256) r(i))"]
    for k in range(8):
        step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
        parts.append(f"b{k + 1} AS (SELECT i, {step} AS c FROM b{k})")
    parts.append("crc_table AS (SELECT list(c ORDER BY i) AS t FROM b8)")
    parts.append("c0 AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS d, CAST(4294967295 AS BIGINT) AS c FROM documents)")
    for k in range(digits):
        step = f"xor(c >> 8, t[(xor(c, CAST(ascii(substr(d, {k + 1}, 1)) AS BIGINT)) & 255) + 1])"
        parts.append(f"c{k + 1} AS (SELECT doc_id, d, CASE WHEN length(d) > {k} THEN {step} ELSE c END AS c FROM c{k}, crc_table)")
    parts.append(f"crc AS (SELECT doc_id, xor(c, 4294967295) AS crc FROM c{digits})")
    return ",\n".join(parts)


def _merkle() -> str:
    """Trees of any number of leaves up to FANOUT ** LEVELS: a level is hashed while its tree has several nodes."""
    parts = [f"""WITH {_crc()},
leaves AS (
  SELECT documents.doc_id, coalesce('=' || source, '') AS tree, {_LEAF.format(text='text')} AS leaf,
         CASE WHEN crc % 5 = 0 THEN {_LEAF.format(text=_SMALL)} END AS tampered
  FROM documents JOIN crc ON documents.doc_id = crc.doc_id
),
s0 AS (
  SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         leaf AS digest, count(*) OVER (PARTITION BY tree) AS n, doc_id, tampered
  FROM leaves
)"""]
    for prefix, base in (("s", "tree"), ("t", None)):
        if not base:
            union = " UNION ALL ".join(f"SELECT tree, digest FROM s{k} WHERE n = 1" for k in range(LEVELS + 1))
            parts.append(f"roots AS ({union})")
            parts.append("""t0 AS (
  SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, digest, count(*) OVER () AS n, tree AS key
  FROM roots
)""")
        for k in range(1, LEVELS + 1):
            parts.append(f"""{prefix}{k} AS (
  SELECT tree, pos // {FANOUT} AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest,
         (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n
  FROM {prefix}{k - 1} WHERE n > 1 GROUP BY tree, pos // {FANOUT}
)""")
    # the siblings of each node, then a leaf's way up: w0 is the leaf, w(k) adds the level k
    for prefix in "st":
        for k in range(LEVELS + 1):
            run = f"OVER (PARTITION BY tree, pos // {FANOUT} ORDER BY pos ROWS BETWEEN"
            parts.append(f"""{prefix}{k}_sides AS (
  SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS lft,
         CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS rgt
  FROM {prefix}{k}
)""")
    parts.append("""w0 AS (
  SELECT doc_id, tree, pos, digest AS leaf, coalesce(tampered, digest) AS folded, '' AS proof FROM s0_sides
)""")
    for k in range(LEVELS + 1):
        parts.append(f"""w{k + 1} AS (
  SELECT w.doc_id, w.tree, w.pos // {FANOUT} AS pos, w.leaf, w.proof || coalesce(lft || rgt, '') AS proof,
         CASE WHEN lft IS NULL THEN folded ELSE sha256(lft || folded || rgt) END AS folded
  FROM w{k} w LEFT JOIN s{k}_sides s ON w.tree = s.tree AND w.pos = s.pos
)""")
    parts.append(f"""v0 AS (
  SELECT w.doc_id, '' AS tree, t.pos, w.leaf, r.digest AS subroot, w.proof, w.folded
  FROM w{LEVELS + 1} w JOIN roots r ON w.tree = r.tree JOIN t0 t ON t.key = w.tree
)""")
    for k in range(LEVELS + 1):
        parts.append(f"""v{k + 1} AS (
  SELECT v.doc_id, v.tree, v.pos // {FANOUT} AS pos, v.leaf, v.subroot, v.proof || coalesce(lft || rgt, '') AS proof,
         CASE WHEN lft IS NULL THEN folded ELSE sha256(lft || folded || rgt) END AS folded
  FROM v{k} v LEFT JOIN t{k}_sides s ON v.tree = s.tree AND v.pos = s.pos
)""")
    union = " UNION ALL ".join(f"SELECT digest FROM t{k} WHERE n = 1" for k in range(LEVELS + 1))
    return ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, (SELECT digest FROM ({union})) AS root, sha256(proof) AS proof_sha256,
       folded AS folded_root, folded = (SELECT digest FROM ({union})) AS verified
FROM v{LEVELS + 1}"""


def _components(nodes: str, links: str, rounds: int = 12) -> str:
    """p(id, label): the least id reachable over links (a, b), both ways: least label of the
    neighbours, then the label's label, so that distances covered double with each round."""
    parts = [f"""sides AS (SELECT a, b FROM {links} UNION ALL SELECT b, a FROM {links}),
p0 AS (SELECT id, id AS label FROM {nodes})"""]
    for k in range(rounds):
        parts.append(f"""h{k} AS MATERIALIZED (
  SELECT p.id, least(any_value(p.label), coalesce(min(q.label), any_value(p.label))) AS label
  FROM p{k} p LEFT JOIN sides ON p.id = sides.a LEFT JOIN p{k} q ON sides.b = q.id GROUP BY p.id
),
p{k + 1} AS MATERIALIZED (SELECT h.id, least(h.label, up.label) AS label FROM h{k} h JOIN h{k} up ON h.label = up.id)""")
    parts.append(f"p AS (SELECT id, label FROM p{rounds})")
    return ",\n".join(parts)


_EMBEDDING_LINKS = f"""WITH vectors AS MATERIALIZED (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v,
         embedding IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings
),
links AS MATERIALIZED (
  SELECT x.id AS a, y.id AS b FROM vectors x JOIN vectors y ON x.id < y.id AND len(x.v) = len(y.v)
  WHERE x.usable AND y.usable AND list_cosine_similarity(x.v, y.v) >= 0.9
),
{_components("vectors", "links")}
SELECT p.id AS vec_id, count(sides.b) AS n_links, any_value(label) AS component_id, p.id = any_value(label) AS kept
FROM p LEFT JOIN sides ON p.id = sides.a GROUP BY p.id"""


def _jaccard(words: int, percent: int) -> str:
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""WITH texts AS MATERIALIZED (
  SELECT doc_id AS id, regexp_extract_all({_SMALL}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
shingles AS MATERIALIZED (
  SELECT DISTINCT id, hash({shingle}) AS g
  FROM (SELECT id, w, unnest(range(1, len(w) - {words - 2})) AS i FROM texts WHERE len(w) >= {words})
  UNION ALL
  SELECT id, hash('few ' || array_to_string(w, ' ')) FROM texts WHERE len(w) BETWEEN 1 AND {words - 1}
),
sizes AS MATERIALIZED (SELECT id, count(*) AS n FROM shingles GROUP BY id),
shared AS (
  SELECT x.id AS a, y.id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.g = y.g AND x.id < y.id
  GROUP BY x.id, y.id
),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes s ON a = s.id JOIN sizes t ON b = t.id
  WHERE 100 * shared.n >= {percent} * (s.n + t.n - shared.n)
),
{_components("texts", "links")}
SELECT p.id AS doc_id, coalesce(n, 0) AS n_shingles, label AS component_id
FROM p LEFT JOIN sizes ON p.id = sizes.id"""


def _warc() -> str:
    """SHA-1 in base 32: each five hex digits give four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digest = " || ".join(
        f"substr('{letters}', CAST((CAST('0x' || substr(d, {5 * k + 1}, 5) AS BIGINT) >> {shift}) & 31 AS INTEGER) + 1, 1)"
        for k in range(8)
        for shift in (15, 10, 5, 0)
    )
    return f"""
SELECT page_id, payload_bytes, {digest} AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS d,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest
      FROM pages)"""


ORACLE_SQL: dict[str, str] = {
    "op3_hnsw_near_duplicates": _EMBEDDING_LINKS,
    "op4_jaccard_join": _jaccard(4, 85),
    "op7_warc_zip": _warc(),
    "op11_veb_merkle_manifest": _merkle(),
    "op12_progressive_exact": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
