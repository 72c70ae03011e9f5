"""Reference SQL of the operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

EXACT_SQL = r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
               FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
           sha256(norm) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY norm)
"""


WORD = r"[^\x20\x09-\x0D]+"

JACCARD_SQL = rf"""
    WITH RECURSIVE
    w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                      'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
    s AS MATERIALIZED (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3
               THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
               FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS MATERIALIZED (
        SELECT a, b FROM common JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
        WHERE 100 * c >= 90 * (x.n + y.n - c)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
              UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
    SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id
    FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a
"""

PASSAGES_SQL = rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
    windows AS (SELECT doc_id, start, array_to_string(ws[start:start + 19], ' ') AS passage
                FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS start FROM w)),
    again AS (SELECT doc_id, start FROM windows
              QUALIFY row_number() OVER (PARTITION BY passage ORDER BY doc_id, start) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM again),
    words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM w),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
             FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed,
           sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
"""


CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")


def _escaped(text: str) -> str:
    """Every control string becomes the sign and its number; the sign itself number 0."""
    for i, control in enumerate(("␛", *CONTROLS)):
        text = f"replace({text}, '{control}', '␛{i}')"
    return text


# A turn is written <s>[INST] role [/INST]text</s>.
CHAT_SQL = f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length('<s>[INST] ' || {_escaped("role")} || ' [/INST]' || {_escaped("text")} || '</s>'))::BIGINT
               AS formatted_chars
    FROM t GROUP BY conv_id
"""


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    spelled = [f"coalesce(strlen(({f})::VARCHAR)::VARCHAR || ':' || ({f})::VARCHAR, '-')" for f in fields]
    return f"sha256({' || '.join(spelled)})"


# The crc32 of an id's digits, bit by bit; 3988292384 is the checksum's polynomial.
_CRC32 = """
    xor(4294967295::BIGINT, list_reduce(
        list_concat([4294967295::BIGINT],
                    list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, c: list_reduce(list_concat([xor(crc, c)], range(8)), lambda x, i:
            CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)))
"""

MERKLE_SQL = f"""
    WITH RECURSIVE
    d AS (SELECT doc_id, {_leaf("n_chars")} AS leaf,
                 CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS other,
                 dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM documents),
    leaves AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
               count(*) OVER (PARTITION BY tree) AS n FROM d),
    up AS (SELECT tree, 0 AS level, pos, leaf AS digest, n FROM leaves
           UNION ALL
           SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 1) // 2
           FROM up WHERE n > 1 GROUP BY tree, level, pos // 2),
    base AS MATERIALIZED (SELECT * FROM up),
    over AS (SELECT -1::BIGINT AS tree, 0 AS level, tree AS pos, digest, count(*) OVER () AS n
             FROM base WHERE n = 1
             UNION ALL
             SELECT -1, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 1) // 2
             FROM over WHERE n > 1 GROUP BY level, pos // 2),
    nodes AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM over),
    step AS MATERIALIZED (
        SELECT a.tree, a.level, a.pos, s.digest AS sibling, a.pos % 2 = 1 AS on_left
        FROM nodes a LEFT JOIN nodes s
          ON s.tree = a.tree AND s.level = a.level AND s.pos = CASE WHEN a.pos % 2 = 1 THEN a.pos - 1 ELSE a.pos + 1 END
        WHERE a.n > 1),
    climb AS (
        SELECT row_number() OVER () AS row, 0 AS k, tree AS home, tree, 0 AS level, pos,
               coalesce(other, leaf) AS folded, '' AS path, doc_id, leaf FROM leaves
        UNION ALL
        SELECT c.row, c.k + 1, c.home,
               CASE WHEN s.tree IS NULL THEN -1 ELSE c.tree END,
               CASE WHEN s.tree IS NULL THEN 0 ELSE c.level + 1 END,
               CASE WHEN s.tree IS NULL THEN c.home ELSE c.pos // 2 END,
               CASE WHEN s.tree IS NULL THEN c.folded WHEN s.sibling IS NULL THEN sha256(c.folded)
                    WHEN s.on_left THEN sha256(s.sibling || c.folded) ELSE sha256(c.folded || s.sibling) END,
               c.path || coalesce(s.sibling, ''), c.doc_id, c.leaf
        FROM climb c LEFT JOIN step s ON s.tree = c.tree AND s.level = c.level AND s.pos = c.pos
        WHERE s.tree IS NOT NULL OR c.tree >= 0),
    ended AS (SELECT row, any_value(doc_id) AS doc_id, any_value(leaf) AS leaf, any_value(home) AS home,
                     arg_max(folded, k) AS folded_root, sha256(arg_max(path, k)) AS proof_sha256
              FROM climb GROUP BY row)
    SELECT e.doc_id, e.leaf, b.digest AS subroot, o.digest AS root, e.proof_sha256, e.folded_root,
           e.folded_root = o.digest AS verified
    FROM ended e JOIN base b ON b.tree = e.home AND b.n = 1 JOIN over o ON o.n = 1
"""


def clustering_sql(rounds: int = 10, k: int = 8, dims: int = 64) -> str:
    """One pair of tables per round: the assignment, and the centroids after it."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
            a{i} AS MATERIALIZED (
                SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
                FROM (SELECT x.r, m.c, sum((x.x - m.x) * (x.x - m.x))::BIGINT AS d
                      FROM x JOIN c{i} m USING (p) GROUP BY x.r, m.c) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
            c{i + 1} AS MATERIALIZED (
                SELECT m.c, m.p, coalesce(n.x, m.x) AS x FROM c{i} m LEFT JOIN (
                    SELECT a.c, x.p, ((sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
                    FROM a{i} a JOIN x USING (r) GROUP BY a.c, x.p) n ON n.c = m.c AND n.p = m.p)""")
    last = rounds
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c,
                   list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE len(embedding) = {dims} AND
                  len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        x AS MATERIALIZED (SELECT r, c, unnest(range({dims})) AS p, unnest(v) AS x FROM v),
        c0 AS MATERIALIZED (SELECT c, p, x FROM x WHERE c < {k}),
        {",".join(steps)},
        digest AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS h FROM c{last} GROUP BY c)
        SELECT v.vec_id, a.c::INT AS cluster, a.d AS distance,
               sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
               digest.h AS centroid_sha256
        FROM a{last} a JOIN v USING (r) JOIN digest ON digest.c = a.c
    """


ORACLE_SQL = {
    "op3_jaccard_join": JACCARD_SQL,
    "op7_chat_formatting": CHAT_SQL,
    "op10_substring_dedup": PASSAGES_SQL,
    "op2_exact_dedup": EXACT_SQL,
    "op12_merkle_manifest": MERKLE_SQL,
    "op13_centroid_clustering": clustering_sql(),
}
