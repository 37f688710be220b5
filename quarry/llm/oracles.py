"""DuckDB SQL of operators whose modules run in Python workers: the join on shingles and the sharding permutation."""

from __future__ import annotations

from .sharding import MULTIPLIERS, PRIME

#: All pairs that share a shingle are counted, and links are closed by recursion: brute force, for small tables.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, words[i : i + 3] AS g FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 3, 1))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT w.doc_id, count(s.doc_id)::BIGINT AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (
  SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT i, j FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * c >= 85 * (a.n + b.n - c)
), r(node, other) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.node, l.j FROM r JOIN l ON r.other = l.i
)
SELECT n.doc_id, n.n AS n_shingles, min(r.other) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""


def _walk(source: str, rounds: int = 6, seed: int = 17) -> str:
    """One pass of the Feistel rounds over ``source(row, x, n, a, b)``."""
    sql = f"SELECT row, n, a, b, x % a AS lo, x // a AS hi FROM ({source})"
    for i in range(rounds):
        half, other, size = ("lo", "hi", "a") if i % 2 == 0 else ("hi", "lo", "b")
        y = f"(({other} * {MULTIPLIERS[i % len(MULTIPLIERS)]} + {(seed * 1_000_003 + i * 7_919) % PRIME}) % {PRIME})"
        z = f"((xor({y}, {y} >> 15) % {1 << 40} * 4194301) >> 20)"
        sql = f"SELECT row, n, a, b, {other}, ({half} + {z}) % {size} AS {half} FROM ({sql})"
    return f"SELECT row, hi * a + lo AS x, n, a, b FROM ({sql})"


#: CRC-32 byte by byte, its table from the polynomial; the walk goes on while an image is out of range.
OP8_SQL = rf"""
WITH RECURSIVE bit(v, c, k) AS (
  SELECT v, v, 0 FROM (SELECT unnest(range(256)) AS v) UNION ALL SELECT v, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8
), tab AS (SELECT list(c ORDER BY v) AS t FROM bit WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, row_number() OVER (ORDER BY doc_id) - 1 AS row, count(*) OVER () AS n FROM documents),
crc AS (
  SELECT doc_id, row, length(x) // 2 + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, v: xor(c >> 8, t[xor(c, v) % 256 + 1])), 4294967295::BIGINT) AS crc
  FROM d, tab
), start AS (SELECT row, row AS x, n, floor(sqrt(n - 1))::BIGINT + 1 AS a, ceil(n / (floor(sqrt(n - 1))::BIGINT + 1))::BIGINT AS b FROM d),
walk(row, x, n, a, b, k) AS (
  SELECT *, 0 FROM ({_walk('SELECT * FROM start')})
  UNION ALL SELECT *, 1 FROM ({_walk('SELECT row, x, n, a, b FROM walk WHERE x >= n')})
)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (x % 40)::INTEGER AS shard, x // 40 AS slot, NULL::INTEGER AS grown_shard
FROM crc JOIN walk USING (row) WHERE x < n
"""


#: All strings of 100 bytes, each but the first of its kind covering its bytes.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
st AS (SELECT doc_id, i, substr(h, 2 * i - 1, 200) AS w FROM (SELECT doc_id, h, unnest(generate_series(1, n - 99)) AS i FROM d WHERE n >= 100)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM st) WHERE r > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM again),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 99 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g
), pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
cut AS (
  SELECT p.doc_id, sum(b - a + 1) AS gone, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM pieces p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id
)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""


def _op9() -> str:
    """Rare words vote for starts, starts within the slack are one place, and there all words and mandatory phrases are checked."""
    from .licenses import SHARE, SLACK, Index

    index = Index()
    cells, rare, heads, keys = [], [], [], []
    for t, x in enumerate(index.templates):
        cells += [f"({t}, {k}, '{w}', {index.idf[w]!r}::DOUBLE)" for k, w in enumerate(x.words)]
        rare += [f"({t}, {k}, '{w}')" for w, k in x.rare]
        heads.append(f"({t}, {x.need}, {x.slack}, {len(x.words)}, {x.total!r}::DOUBLE, '{x.label}', {str(x.base).lower()}, {str(x.phrase).lower()})")
        keys += [f"({t}, ' {' '.join(k)} ')" for k in x.keys]
    return rf"""
WITH cells(t, k, word, idf) AS (VALUES {", ".join(cells)}), rare(t, k, word) AS (VALUES {", ".join(rare)}),
heads(t, need, slack, width, total, label, base, phrase) AS (VALUES {", ".join(heads)}), keys(t, key) AS (VALUES {", ".join(keys)}),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
w AS (SELECT doc_id, unnest(range(len(words))) AS pos, unnest(words) AS word FROM d),
votes AS (SELECT DISTINCT w.doc_id, r.t, w.pos - r.k AS v, word FROM w JOIN rare r USING (word)),
near AS (SELECT *, CASE WHEN v - lag(v) OVER o <= slack THEN 0 ELSE 1 END AS fresh FROM votes JOIN heads USING (t) WINDOW o AS (PARTITION BY doc_id, t ORDER BY v)),
places AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, t ORDER BY v) AS place FROM near),
met AS (SELECT doc_id, t, place, min(v) AS first, max(v) AS last FROM places GROUP BY doc_id, t, place HAVING count(DISTINCT word) >= any_value(need)),
starts AS (SELECT DISTINCT doc_id, t, place, v FROM places SEMI JOIN met USING (doc_id, t, place)),
stands AS (
  SELECT doc_id, t, place, sum(idf) AS got FROM (
    SELECT DISTINCT s.doc_id, s.t, s.place, c.k, c.idf FROM starts s JOIN cells c ON c.t = s.t JOIN w ON w.doc_id = s.doc_id AND w.pos = s.v + c.k AND w.word = c.word
  ) GROUP BY doc_id, t, place
), shares AS (SELECT doc_id, t, place, first, last, got / total AS share, label, base, phrase, width FROM met JOIN stands USING (doc_id, t, place) JOIN heads USING (t)),
lacks AS (
  SELECT DISTINCT s.doc_id, s.t, s.place FROM shares s JOIN keys ON keys.t = s.t JOIN d ON d.doc_id = s.doc_id
  WHERE NOT contains(' ' || array_to_string(words[greatest(first - {SLACK}, 0) + 1 : last + width + {SLACK}], ' ') || ' ', key)
), judged AS (
  SELECT s.*, (phrase AND share = 1) OR (NOT phrase AND share >= {SHARE} AND l.t IS NULL) AS found FROM shares s LEFT JOIN lacks l ON l.doc_id = s.doc_id AND l.t = s.t AND l.place = s.place
), p AS (
  SELECT doc_id, count(*) FILTER (base AND found) AS n_base, min(first) FILTER (base AND found) AS first_word, max(first) FILTER (base AND found) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND found) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found) AS labels,
    max(CASE WHEN found THEN share ELSE 0.5 * share END) AS score
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6)::DOUBLE AS score
FROM d LEFT JOIN p USING (doc_id)
"""


OP9_SQL = _op9()
