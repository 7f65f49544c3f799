"""SQL of the text operators that SQL can state on whole tables, written from their contracts."""

from __future__ import annotations

#: Kind, pattern, group whose length counts, least length; kinds in the order in which equal starts are listed.
SPANS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0),
    ("signed_token", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
]


def spans_of(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Start and end of each match: the lengths of what lies between matches and of the matches before it."""
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, first, first + length(found[k]) AS past
  FROM (SELECT *, coalesce(list_sum(list_transform(between[1:k], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0)::BIGINT AS first
    FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k
      FROM (SELECT doc_id, regexp_extract_all(body, {quoted}) AS found, regexp_extract_all(body, {quoted}, {group}) AS counted, regexp_split_to_array(body, {quoted}) AS between FROM texts)))
  WHERE length(counted[k]) >= {least}"""


def secret_scan() -> str:
    spans = "\n  UNION ALL ".join(spans_of(i, *s) for i, s in enumerate(SPANS))
    listed = "string_agg(kind || ':' || first || ':' || past, ',' ORDER BY first, rank)"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
spans AS ({spans}),
found AS (SELECT doc_id, {listed} AS spans, {listed} FILTER (WHERE rank < 3) AS base,
  count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex FROM spans GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(body) AS blob_id
FROM texts t LEFT JOIN found USING (doc_id)"""


LINE_DEDUP = r"""WITH raw AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
rows AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS place FROM raw WHERE regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') <> ''),
firsts AS (SELECT line, min(place) AS place FROM rows GROUP BY line),
variants AS (
  SELECT place, 0 AS i, line AS v FROM firsts WHERE length(line) >= 10
  UNION ALL SELECT place, i, substr(line, 1, i - 1) || substr(line, i + 1) FROM (SELECT *, unnest(range(1, length(line) + 1)) AS i FROM firsts WHERE length(line) >= 10)),
met AS (SELECT place, least(
    CASE WHEN i > 0 THEN min(place) OVER (PARTITION BY v, i) END,
    CASE WHEN i > 0 THEN min(place) FILTER (WHERE i = 0) OVER (PARTITION BY v) ELSE min(place) FILTER (WHERE i > 0) OVER (PARTITION BY v) END) AS earliest FROM variants),
gone AS (SELECT DISTINCT place FROM met WHERE earliest < place),
judged AS (SELECT r.*, f.place IS NULL AS exact, f.place IS NOT NULL AND g.place IS NOT NULL AS near FROM rows r LEFT JOIN firsts f USING (line, place) LEFT JOIN gone g USING (place)),
counted AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT exact AND NOT near) AS n_kept, count(*) FILTER (WHERE exact) AS n_exact, count(*) FILTER (WHERE near) AS n_near,
  string_agg(line_no, ',' ORDER BY line_no) FILTER (WHERE NOT exact AND NOT near) AS kept_lines FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, coalesce(kept_lines, '') AS kept_lines
FROM documents d LEFT JOIN counted USING (doc_id)"""

def clustering_rounds(k: int = 8, rounds: int = 10) -> str:
    """Every round as two common table expressions: nearest centroids, then floors of means. Integers up to 2^31 a component."""
    parts = [
        "kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL ORDER BY sha256('3:' || vec_id) LIMIT {k})",
    ]
    for i in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(kept.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(kept.vec_id) AS vec_id, any_value(kept.v) AS v, min({far}) AS distance, arg_min(k.c, {far}::HUGEINT * {k} + k.c) AS c FROM kept, c{i} k GROUP BY r)")
        mean = "list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v"
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, {mean} FROM (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY c, j) GROUP BY c) m USING (c))")
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.c::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM {last} a JOIN c{rounds} k ON a.c = k.c"""


REPEATED_SUBSTRINGS = r"""WITH words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents)),
windows AS (SELECT doc_id, i, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h, n FROM words),
judged AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS again FROM windows WHERE i + 50 <= n),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM judged WHERE again),
counted AS (SELECT doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE g.i IS NULL) AS kept FROM words LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN counted USING (doc_id)"""


JACCARD_JOIN = r"""WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, body, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g FROM texts),
docs AS MATERIALIZED (SELECT doc_id, body, g, md5(array_to_string(g, chr(10))) AS s FROM grams),
sets AS MATERIALIZED (SELECT s, any_value(g) AS g, len(any_value(g)) AS n, count(DISTINCT body) AS n_texts, count(*) AS n_copies, min(doc_id) AS copy_id FROM docs GROUP BY s),
each AS MATERIALIZED (SELECT s, n, unnest(g) AS gram FROM sets),
pairs AS MATERIALIZED (SELECT a.s AS x, b.s AS y FROM each a JOIN each b ON a.gram = b.gram AND a.s <> b.s GROUP BY a.s, b.s, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.8),
reach AS (SELECT s, s AS t FROM sets UNION SELECT r.s, y FROM reach r JOIN pairs ON x = t),
classes AS (SELECT r.s, min(copy_id) AS class_id FROM reach r JOIN sets ON sets.s = t GROUP BY r.s),
links AS (SELECT x AS s, sum(n_texts) AS links FROM pairs JOIN sets ON sets.s = y GROUP BY x)
SELECT doc_id, class_id, CASE WHEN n > 0 THEN n_texts - 1 + coalesce(links, 0) ELSE 0 END::BIGINT AS n_links, copy_id, n_copies
FROM docs JOIN sets USING (s) JOIN classes USING (s) LEFT JOIN links USING (s)"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text: the register meets each byte, then shifts eight times (-1 stands for a shift)."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"


def quality_rules(alpha: float = 0.05, delta: float = 0.05, levels: tuple[float, ...] = (1.0, 0.998, 0.995, 0.99, 0.985, 0.98)) -> str:
    names = ("symbols", "capitals", "lines", "windows")
    over = " OR ".join(f"{n} > cut_{n}" for n in names)
    cuts = ", ".join(f"quantile_cont(ceil({n} * 4096) / 4096, q) AS cut_{n}" for n in names)
    proposed = " UNION ALL ".join(f"SELECT stratum, {i} AS level, {cuts.replace('q)', f'{q})')} FROM held WHERE proposing AND good GROUP BY stratum" for i, q in enumerate(levels, 1))
    chance = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha}))"
    return rf"""WITH texts AS MATERIALIZED (SELECT doc_id, coalesce(lang, '(none)') AS stratum, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS v FROM documents),
words AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS i FROM texts),
windows AS (SELECT *, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM again GROUP BY doc_id),
counts AS (SELECT doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(v) AS n_lines, (len(v) - len(list_distinct(v)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(body, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals FROM texts LEFT JOIN repeats USING (doc_id)),
judged AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbols, n_capitals / greatest(word_chars, 1) AS capitals,
  n_dup_lines / greatest(n_lines, 1) AS lines, n_repeat_words / greatest(n_words, 1) AS windows FROM counts),
known AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
held AS MATERIALIZED (SELECT judged.*, quality = 1 AS good, {crc32('doc_id::VARCHAR')} % 4 = 0 AS proposing FROM judged JOIN known USING (doc_id) WHERE quality IS NOT NULL),
proposed AS ({proposed}),
tested AS (SELECT stratum, level, any_value(COLUMNS('cut_.*')), count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND ({over})) AS k, count(*) FILTER (WHERE NOT good) AS bad, count(*) FILTER (WHERE NOT good AND ({over})) AS caught
  FROM held JOIN proposed USING (stratum) WHERE NOT proposing GROUP BY stratum, level),
gains AS (SELECT *, caught / greatest(bad, 1) - k / greatest(n, 1) AS gain, CASE WHEN k >= n * {alpha} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: {chance})) END AS tail, count(*) OVER () AS candidates FROM tested),
best AS (SELECT * FROM gains WHERE gain > 0 AND tail <= {delta} / candidates QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, level) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({over}, false) AS kept, stratum, coalesce(level, 0) AS level
FROM judged LEFT JOIN best USING (stratum)"""

ORACLES = {
    "op1_secret_scan": secret_scan(), "op3_chosen_path_join": JACCARD_JOIN, "op7_quality_rules": quality_rules(), "op9_line_dedup": LINE_DEDUP,
    "op11_elkan_clustering": clustering_rounds(), "op13_compacted_substrings": REPEATED_SUBSTRINGS,
}
