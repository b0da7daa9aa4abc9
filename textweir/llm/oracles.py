"""SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from collections.abc import Mapping

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Windows of 13 words by the smallest document that has them; words under later ones go.
PASSAGES = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
 g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
 h AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS win FROM g),
 f AS (SELECT win, min(doc_id) AS first FROM h GROUP BY win),
 c AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT h.doc_id, h.i FROM h JOIN f ON h.win = f.win WHERE f.first < h.doc_id), range(13) AS r(k)),
 t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
 k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.p) AS kept, count(*) AS n FROM t ANTI JOIN c ON t.doc_id = c.doc_id AND t.p = c.p GROUP BY t.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""


def mixing(share: float, weights: Mapping[str, Mapping[str, float]], epochs: int, seed: int = 7) -> str:
    """Budgets down the tree level by level, then whole epochs and a prefix of the next."""

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in weights.get(level, {}).items())
        return f"CASE {level} {cases} ELSE 1::DOUBLE END" if cases else "1::DOUBLE"

    steps, above = [], []
    for level in ("domain", "lang", "source"):
        by = ", ".join(above) or "1"
        keys = ", ".join([*above, level])
        budget = "b0.budget" if not above else "p.budget"
        source = f"n{level} n CROSS JOIN b0" if not above else f"n{level} n JOIN d{above[-1]} p USING ({', '.join(above)})"
        order = f"PARTITION BY {by} ORDER BY room / weight, {level}"
        steps.append(
            f""" n{level} AS (SELECT {keys}, {epochs} * sum(held) AS room, {weight(level)} AS weight FROM l GROUP BY {keys}),
 r{level} AS (SELECT n.*, {budget} AS given FROM {source}),
 s{level} AS (SELECT *, (given - coalesce(sum(room) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r{level}),
 d{level} AS (SELECT {keys}, CASE WHEN level >= room / weight THEN room::DOUBLE ELSE weight * max(CASE WHEN level < room / weight THEN level END) OVER (PARTITION BY {by}) END AS budget FROM s{level})"""
        )
        above.append(level)
    return f"""
WITH d AS (SELECT doc_id, lang AS own_lang, source AS own_source, coalesce(lang, '') AS lang, coalesce(source, '') AS source, greatest(len({WORDS}), 1) AS tokens,
  'domain' || coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '[0-9]+'), '') AS BIGINT) % 4, 0) AS domain FROM documents),
 l AS (SELECT domain, lang, source, sum(tokens)::DOUBLE AS held FROM d GROUP BY ALL),
 b0 AS (SELECT least(floor(sum(held) * {share}::DOUBLE), sum(held) * {epochs}) AS budget FROM l),
{",".join(steps)},
 q AS (SELECT l.*, floor(floor(budget + 1e-6) / held)::BIGINT AS whole, floor(budget + 1e-6) AS quota FROM l JOIN dsource USING (domain, lang, source)),
 o AS (SELECT d.*, whole, quota - whole * held AS rest, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN q USING (domain, lang, source))
SELECT doc_id, domain, own_lang AS lang, own_source AS source, CAST(tokens AS BIGINT) AS tokens, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS copies FROM o WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0"""


def crc32(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes, a bit at a time."""
    code = f"hex(encode({text}))"
    steps = f"flatten(list_transform(range(0, CAST(len({code}) / 2 AS BIGINT)), lambda i: [CAST('0x' || substr({code}, i * 2 + 1, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"


#: Near words share what is left without one letter at the same place, or are that themselves.
SPELLING = rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents),
 d AS (SELECT doc_id, run, count(*) AS k FROM r GROUP BY ALL),
 h AS (SELECT run, k, {crc32("concat(doc_id, ':', run)")} AS h FROM d),
 w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
 v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
 x AS MATERIALIZED (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM v)),
 e AS (SELECT a.word, b.word AS other FROM x a JOIN x b ON a.p = b.p AND a.cut = b.cut AND a.word <> b.word UNION SELECT x.word, v.word FROM x JOIN v ON x.cut = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.cut = v.word),
 m AS (SELECT e.word, other, v.n, count(*) OVER (PARTITION BY e.word) AS n_near, row_number() OVER (PARTITION BY e.word ORDER BY v.n DESC, other) AS place FROM e JOIN v ON e.other = v.word),
 f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m.n >= 10 * v.n THEN other END AS form, CASE WHEN m.n >= 10 * v.n THEN m.n END AS form_n FROM v LEFT JOIN m ON v.word = m.word AND place = 1),
 g AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON g.up = f.word)
SELECT f.word, n, n_near, form, form_n, root FROM f JOIN g ON f.word = g.word WHERE g.up IS NULL"""

#: Each node adds its own to every prefix of the path of its smallest member.
TRIE = f"""
WITH t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS pos FROM (SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
 z AS MATERIALIZED (SELECT c, turns, {crc32("CAST(c AS VARCHAR)")} % 9 AS h FROM (SELECT c, count(*) AS turns FROM t GROUP BY c)),
 k AS MATERIALIZED (SELECT z.c, z.h, least(z.h, coalesce(b.turns, 0)) AS taken, least(z.h, coalesce(b.turns, 0)) + greatest(z.turns - z.h, 0) AS total FROM z LEFT JOIN z b ON b.c = z.c - z.c % 5),
 r AS (SELECT k.c, pos - h + taken AS depth, digest, bytes, total FROM t JOIN k ON t.c = k.c WHERE pos > h UNION ALL SELECT k.c, pos, digest, bytes, total FROM t JOIN k ON t.c = k.c - k.c % 5 WHERE pos <= h),
 p AS MATERIALIZED (SELECT c, depth, bytes, total, string_agg(digest, '') OVER (PARTITION BY c ORDER BY depth) AS path FROM r UNION ALL SELECT c, 0, 0, total, '' FROM k),
 n AS MATERIALIZED (SELECT path, depth, min(c) AS conv, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = total), '') AS ends FROM p GROUP BY path, depth),
 u AS MATERIALIZED (SELECT substr(path, 1, len(path) - 64) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
 o AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CAST(n_children IS NULL AS BIGINT) AS leaf, (n_convs - 1) * bytes AS saved FROM n LEFT JOIN u ON n.path = u.path),
 s AS (SELECT p.path, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM o JOIN p ON p.c = o.conv AND p.depth <= o.depth GROUP BY p.path)
SELECT o.conv AS conv_id, CAST(o.depth AS BIGINT) AS depth, a.conv AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, sha256(o.ends) AS ends_sha256 FROM o JOIN s ON o.path = s.path LEFT JOIN n a ON o.depth > 0 AND a.path = substr(o.path, 1, len(o.path) - 64)"""
