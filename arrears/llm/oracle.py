"""DuckDB SQL for the queries that SQL expresses."""

WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: Every run of as many document words as a window has, against the windows; and, for documents with all
#: words of a whole window, the slices of 15 words that hold each as often as the window.
DECONTAMINATE = rf"""
WITH item AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, w[k:k + least(10, len(w)) - 1] AS words
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM item WHERE len(w) > 0)),
doc AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
run AS (
    SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS phrase
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k
          FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, item_id, k, n FROM run JOIN (SELECT item_id, n, array_to_string(words, ' ') AS phrase FROM win) USING (n, phrase)),
place AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
held AS (SELECT r, count(id) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
         FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r),
term AS MATERIALIZED (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM doc) GROUP BY r, word),
bag AS MATERIALIZED (
    SELECT row_number() OVER () AS b, ids, words
    FROM (SELECT list(DISTINCT item_id) AS ids, words FROM (SELECT item_id, list_sort(words) AS words FROM win WHERE n = 10)
          GROUP BY words)),
ask AS MATERIALIZED (SELECT b, word, count(*) AS n FROM (SELECT b, unnest(words) AS word FROM bag) GROUP BY b, word),
rare AS (SELECT b, arg_min(word, coalesce(df, 0)) AS word
         FROM ask LEFT JOIN (SELECT word, count(*) AS df FROM term GROUP BY word) USING (word) GROUP BY b),
maybe AS MATERIALIZED (
    SELECT r, b FROM rare JOIN term USING (word) JOIN (SELECT b, count(*) AS terms FROM ask GROUP BY b) USING (b)
    WHERE (SELECT count(*) FROM ask JOIN term t USING (word) WHERE ask.b = rare.b AND t.r = term.r AND t.n >= ask.n) = terms),
slice AS (
    SELECT r, b, list_sort(w[k:k + 14]) AS s, words, ids
    FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM maybe JOIN doc USING (r) JOIN bag USING (b))
    WHERE list_contains(words, w[k])),
close AS (
    SELECT r, count(DISTINCT id) AS n_near, string_agg(DISTINCT id, ',' ORDER BY id) AS near
    FROM (SELECT r, CAST(unnest(ids) AS VARCHAR) AS id FROM slice
          WHERE len(list_filter(words, lambda x, i: len(list_filter(s, lambda y: y = x)) < len(list_filter(words, lambda z: z = x)))) = 0)
    WHERE id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0) AS n_near, sha256(coalesce(near, '')) AS near_sha256
FROM doc LEFT JOIN place USING (r) LEFT JOIN held USING (r) LEFT JOIN close USING (r)
"""

EXACT_DEDUP = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW best AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

#: Water filling by bisection-free levels: a source is full if its cap fits under the level at its turn.
MIX = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR))) AS key
    FROM documents),
s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk
    FROM d GROUP BY source),
t AS (
    SELECT *, CAST(1 + rk % 3 AS DOUBLE) AS w, 3.0 * source_size AS cap FROM s),
q AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rk
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
    FROM t),
g AS (
    SELECT source, source_size, rk, w,
           CAST(CASE WHEN cap <= w * lev THEN cap
                ELSE w * (SELECT arg_min(lev, struct_pack(a := cap / w, b := rk)) FROM q WHERE cap > w * lev) END
                AS DOUBLE) AS target
    FROM q),
p AS (
    SELECT doc_id, size, source_size, target, rk, w,
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rounds FROM p),
f AS (
    SELECT *, CAST(rounds + CASE WHEN ahead + size / 2.0 <= target - rounds * source_size THEN 1 ELSE 0 END AS BIGINT) AS uses,
           CASE WHEN target > 0 THEN least(ahead / target, 1.0) ELSE 0.0 END AS u,
           CASE WHEN rk % 2 = 0 THEN w * 1.5 ELSE w * 0.5 END AS w0,
           CASE WHEN rk % 2 = 0 THEN w * 0.5 ELSE w * 1.5 END AS w1
    FROM e)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * uses AS BIGINT) AS taken,
       CASE WHEN uses > 0 THEN CASE WHEN u <= 0 THEN 0.0 ELSE
           least(2 * u * ((w0 + w1) / 2) / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * u * ((w0 + w1) / 2), 0.0))), 1.0)
       END END AS position
FROM f
"""

HARD_NEGATIVES = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS alike,
           CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v AS a, v AS b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (
    SELECT * FROM s WHERE alike
    QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, br) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.id, s.br) AS INTEGER) AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.ar = s.ar AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.id, s.br) <= 10
"""


def _tree(name: str, source: str, depth: int) -> str:
    """Levels of the trees over ``source`` (t, i, h: tree, place, digest) with the siblings of
    every node (left, right; step: whether there is a level above)."""
    out = [f"{name}0 AS MATERIALIZED (SELECT t, i, h, count(*) OVER (PARTITION BY t) AS n FROM {source})"]
    for k in range(depth):
        out.append(f"""{name}s{k} AS MATERIALIZED (
            SELECT t, i, n > 1 AS step, CASE WHEN n > 1 THEN coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h) OVER w, '') END AS l,
                   CASE WHEN n > 1 THEN coalesce(lead(h) OVER w, '') || coalesce(lead(h, 2) OVER w, '') END AS r
            FROM {name}{k} WINDOW w AS (PARTITION BY t, i // 3 ORDER BY i))""")
        out.append(f"""{name}{k + 1} AS MATERIALIZED (
            SELECT t, i // 3 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h,
                   (any_value(n) + 2) // 3 AS n FROM {name}{k} GROUP BY t, i // 3)""")
    return ",\n".join(out)


def merkle(depth: int = 14, groups_depth: int = 6) -> str:
    """Levels written out one by one: up to 3 ** depth documents a source, 3 ** groups_depth sources."""
    field = lambda f, size: f"coalesce(CAST({size}(CAST({f} AS VARCHAR)) AS VARCHAR) || ':' || CAST({f} AS VARCHAR), '-')"
    head = " || ".join(field(f, "strlen") for f in ("doc_id", "source", "lang", "n_chars"))
    layers = []
    for k in range(depth + groups_depth):  # one step towards the root each
        s, place = (f"as{k}", f"s.t = f.t AND s.i = f.i // {3 ** k}") if k < depth else (
            f"bs{k - depth}", f"s.i = f.gi // {3 ** (k - depth)}")
        layers.append(f"""f{k + 1} AS MATERIALIZED (
            SELECT f.doc_id, f.leaf, f.t, f.i, f.gi, f.subroot, f.proof || coalesce(s.l || s.r, '') AS proof,
                   CASE WHEN s.step THEN sha256(s.l || f.fold || s.r) ELSE f.fold END AS fold
            FROM f{k} AS f JOIN {s} AS s ON {place})""")
    return f"""
WITH bits AS (
    SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY k) AS crc
    FROM (SELECT unnest(range(256)) AS k)),
leaf AS MATERIALIZED (
    SELECT doc_id, source, sha256({head} || {field("text", "strlen")}) AS leaf,
           CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                    lambda c: CAST(ord(c) AS BIGINT))), lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) % 2 = 0
                THEN sha256({head} || {field("replace(text, chr(10), '')", "strlen")}) END AS changed
    FROM documents, bits),
d AS (
    SELECT *, coalesce('=' || source, '') AS t, coalesce(changed, leaf) AS seen,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaf),
x AS (SELECT t, i, leaf AS h FROM d),
{_tree("a", "x", depth)},
g AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, h FROM a{depth}),
y AS (SELECT '' AS t, i, h FROM g),
{_tree("b", "y", groups_depth)},
f0 AS MATERIALIZED (
    SELECT d.doc_id, d.leaf, d.t, d.i, g.i AS gi, g.h AS subroot, '' AS proof, d.seen AS fold FROM d JOIN g ON g.t = d.t),
{", ".join(layers)}
SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root.h AS verified
FROM f{len(layers)}, b{groups_depth} AS root
"""
