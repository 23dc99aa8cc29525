"""DuckDB SQL of the longer queries."""

#: CRC-32 needs a table of 256 remainders, which the rule makes; `crc(x)` below stands for the checksum of a string's UTF-8 bytes.
_TABLE = "crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc(x: str, t: str) -> str:
    codes = f"list_transform(range(octet_length(encode({x}))), lambda i: CAST('0x' || substr(hex(encode({x})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda v, b: xor(v >> 8, {t}[1 + (xor(v, b) & 255)])), 4294967295)"


IMPORTANCE_RESAMPLING = rf"""
    WITH {_TABLE},
    texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
    w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
    runs AS (SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w),
    kinds AS (SELECT f, {_crc("f", "t")} % 10000 AS b FROM (SELECT DISTINCT f FROM runs), crc_table),
    features AS (SELECT kind, id, b, count(*) AS n FROM runs JOIN kinds USING (f) GROUP BY ALL),
    totals AS (SELECT range AS b, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range(10000)
               LEFT JOIN (SELECT b, sum(n) FILTER (WHERE kind = 0) AS s, sum(n) FILTER (WHERE kind = 1) AS t FROM features GROUP BY b) AS found ON range = b),
    gains AS (SELECT b, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS g FROM totals),
    weights AS (SELECT id, sum(n) AS n_features, sum(n * g) AS weight FROM features JOIN gains USING (b) WHERE kind = 0 GROUP BY id),
    noise AS (SELECT id, len(w) AS n_words, CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS z FROM w WHERE kind = 0),
    scored AS (SELECT id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + z AS score FROM noise LEFT JOIN weights USING (id)),
    ranked AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
    SELECT id AS doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
           CASE WHEN r <= 5 * n // 100 THEN r END AS rank, CAST(n_words AS BIGINT) AS n_words
    FROM scored LEFT JOIN ranked USING (id)"""

SUBSTRING_DEDUP = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM d)),
    later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
    covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
    counted AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
    words AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS j FROM d),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t FROM words ANTI JOIN covered USING (doc_id, j) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x} END"


_LEAF = " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", "text"))
_CHANGED = " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')"))

MERKLE_MANIFEST = rf"""
    WITH RECURSIVE {_TABLE},
    leaves AS (SELECT doc_id, source, sha256({_LEAF}) AS leaf, CASE WHEN {_crc("CAST(doc_id AS VARCHAR)", "t")} % 2 = 0 THEN sha256({_CHANGED}) ELSE sha256({_LEAF}) END AS now FROM documents, crc_table),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
    nodes AS (SELECT source, 0 AS lvl, i, leaf AS h, n FROM ranked
              UNION ALL SELECT source, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, lvl, i // 3, n),
    subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
    upper_nodes AS (SELECT 0 AS lvl, i, subroot AS h, n FROM subroots
              UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM upper_nodes WHERE n > 1 GROUP BY lvl, i // 3, n),
    top AS (SELECT h AS root FROM upper_nodes WHERE n = 1),
    beside AS (SELECT a.source, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
               FROM nodes AS a JOIN nodes AS b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
    upper_beside AS (SELECT a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
               FROM upper_nodes AS a JOIN upper_nodes AS b ON a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
    path AS (SELECT k.source, k.i, b.lvl AS k, l, r FROM ranked AS k JOIN beside AS b ON k.source IS NOT DISTINCT FROM b.source AND b.i = k.i // CAST(pow(3, b.lvl) AS BIGINT)
             UNION ALL SELECT k.source, k.i, 1000 + b.lvl, l, r FROM ranked AS k JOIN subroots AS s ON k.source IS NOT DISTINCT FROM s.source JOIN upper_beside AS b ON b.i = s.i // CAST(pow(3, b.lvl) AS BIGINT)),
    steps AS (SELECT *, row_number() OVER (PARTITION BY source, i ORDER BY k) AS step FROM path),
    proofs AS (SELECT source, i, sha256(string_agg(l || r, '' ORDER BY k)) AS proof, max(step) AS depth FROM steps GROUP BY source, i),
    folded AS (SELECT source, i, CAST(0 AS BIGINT) AS step, now AS h FROM ranked
               UNION ALL SELECT f.source, f.i, s.step, sha256(s.l || f.h || s.r) FROM folded AS f JOIN steps AS s ON f.source IS NOT DISTINCT FROM s.source AND f.i = s.i AND s.step = f.step + 1)
    SELECT k.doc_id, k.leaf, s.subroot, root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
    FROM ranked AS k JOIN subroots AS s ON k.source IS NOT DISTINCT FROM s.source CROSS JOIN top
    LEFT JOIN proofs AS p ON k.source IS NOT DISTINCT FROM p.source AND k.i = p.i
    JOIN folded AS f ON k.source IS NOT DISTINCT FROM f.source AND k.i = f.i AND f.step = coalesce(p.depth, 0)"""
