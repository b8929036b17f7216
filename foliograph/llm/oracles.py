"""SQL for the corpus queries that SQL can express, for DuckDB.

The others are checked otherwise: an exact library (op9), brute force (op4),
plain Python and held-out accuracy (op6, op7).
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"
_DIGIT = "(instr('0123456789abcdef', substr(h, {j}, 1)) - 1)"

OP1 = f"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACED}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) END) AS g FROM dw WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM dw UNION SELECT ends.b, reach.root FROM reach JOIN ends ON ends.a = reach.node)
SELECT dw.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM dw LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) c ON c.node = dw.doc_id"""

OP2 = f"""
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({_DIGIT.format(j="(5 * i) // 4 + 1")} * 16 + {_DIGIT.format(j="(5 * i) // 4 + 2")}) >> (3 - (5 * i) % 4)) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, body, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))"""

OP8 = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS ws FROM documents),
iw AS (SELECT item_id, ws, least(10, len(ws)) AS m FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS ws FROM benchmark) WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item_id, m, array_to_string(ws[k:k + m - 1], ' ') AS w FROM (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM iw)),
dwin AS (SELECT doc_id, m, k, array_to_string(ws[k:k + m - 1], ' ') AS w FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM dw, (SELECT DISTINCT m FROM wins) WHERE len(ws) >= m)),
hits AS (SELECT doc_id, k, dwin.m AS m, item_id FROM dwin JOIN wins ON dwin.m = wins.m AND dwin.w = wins.w),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM hits) GROUP BY doc_id),
i AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""


def _grams(n: int) -> str:
    return f"g{n} AS (SELECT doc_id, k, array_to_string(ws[k:k + {n - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS k FROM dw WHERE len(ws) >= {n}))"


def _top(n: int, most: float) -> str:
    # characters of the n-gram that takes up most, over all its places
    return f"t{n} AS (SELECT doc_id, max(c * (length(g) - {n - 1})) AS mass FROM (SELECT doc_id, g, count(*) AS c FROM g{n} GROUP BY doc_id, g) WHERE c > 1 GROUP BY doc_id)"


def _dup(n: int) -> str:
    return f"d{n} AS (SELECT doc_id, count(*) AS words, sum(length(ws[p])) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(k, k + {n})) AS p FROM g{n} JOIN (SELECT doc_id, g FROM g{n} GROUP BY doc_id, g HAVING count(*) > 1) USING (doc_id, g)) JOIN dw USING (doc_id) GROUP BY doc_id)"


def op3() -> str:
    from .repetition import DUP_LINE_CHAR_SHARE, DUP_LINE_SHARE, DUP_NGRAM_SHARE, TOP_NGRAM_SHARE

    tables = [_grams(n) for n in (*TOP_NGRAM_SHARE, *DUP_NGRAM_SHARE)] + [_top(n, m) for n, m in TOP_NGRAM_SHARE.items()] + [_dup(n) for n in DUP_NGRAM_SHARE]
    bad = [f"least(coalesce(t{n}.mass, 0)::DOUBLE / greatest(word_chars, 1), 1) > {m}" for n, m in TOP_NGRAM_SHARE.items()] + [f"coalesce(d{n}.chars, 0)::DOUBLE / greatest(word_chars, 1) > {m}" for n, m in DUP_NGRAM_SHARE.items()]
    bad += [f"n_dup_lines::DOUBLE / greatest(n_lines, 1) > {DUP_LINE_SHARE}", f"dup_line_chars::DOUBLE / greatest(word_chars, 1) > {DUP_LINE_CHAR_SHARE}"]
    joins = " ".join(f"LEFT JOIN {t} USING (doc_id)" for t in [*(f"t{n}" for n in TOP_NGRAM_SHARE), *(f"d{n}" for n in DUP_NGRAM_SHARE)])
    base = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
    return f"""
WITH dw AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents),
{", ".join(tables)},
ln AS (SELECT doc_id, line, count(*) AS c, list_sum(list_transform(regexp_extract_all(line, '{_SPACED}'), lambda x: length(x))) AS chars FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM dw) WHERE regexp_matches(line, '{_SPACED}') GROUP BY doc_id, line),
li AS (SELECT doc_id, sum(c)::BIGINT AS n_lines, sum(c - 1)::BIGINT AS n_dup_lines, sum((c - 1) * chars)::BIGINT AS dup_line_chars FROM ln GROUP BY doc_id),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(d8.words, 0)::BIGINT AS n_repeat_words FROM dw LEFT JOIN li USING (doc_id) LEFT JOIN d8 USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, NOT {base} AND NOT ({" OR ".join(bad)}) AS kept FROM b {joins}"""


def op11(k: int = 8, rounds: int = 10) -> str:
    finite = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    gap = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT"
    floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
    tables = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE {finite})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, q FROM (SELECT sha256('3:' || vec_id) AS h, q FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        tables.append(f"a{r} AS MATERIALIZED (SELECT * FROM (SELECT v.vec_id, v.q, c.k, {gap} AS d FROM v, c{r} c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)")
        if r < rounds:
            sums = f"SELECT k, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT k, unnest(range(1, 65)) AS i, unnest(q) AS x FROM a{r}) GROUP BY k, i"
            tables.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (SELECT k, list({floor} ORDER BY i) AS q FROM ({sums}) GROUP BY k) m USING (k))")
    return f"""
WITH {", ".join(tables)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (k)"""


OP12 = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.node = vec_id"""


OP5 = f"""
WITH dw AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACED}') AS ws, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS target FROM documents),
tok AS MATERIALIZED (SELECT doc_id, target, len(ws) AS n, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, ws[len(ws)] AS final FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM dw)),
c1 AS MATERIALIZED (SELECT w, count(*) AS a, count(*) FILTER (target) AS t, count(*) FILTER (i = n) AS la, count(*) FILTER (target AND i = n) AS lt FROM tok GROUP BY w),
c2 AS MATERIALIZED (SELECT v, w, count(*) AS a2, count(*) FILTER (target) AS t2 FROM tok WHERE v IS NOT NULL GROUP BY v, w),
o1 AS MATERIALIZED (SELECT doc_id, w, count(*) AS o FROM tok GROUP BY doc_id, w),
o2 AS MATERIALIZED (SELECT doc_id, v, w, count(*) AS oo FROM tok WHERE v IS NOT NULL GROUP BY doc_id, v, w),
g AS (SELECT sum(a) AS na, sum(t) AS nt, count(*) + 1 AS vocab, CASE WHEN sum(t) > 0 THEN sum(t)::DOUBLE / sum(a) ELSE 1.0 END AS rate FROM c1),
x AS (SELECT tok.doc_id, tok.n, tok.v, target::INT AS inside, c1.t, c1.a, o1.o, p.t - p.lt AS ht, p.a - p.la AS ha, op.o - (tok.v = final)::INT AS hist, t2, a2, oo, nt, na, vocab, rate
  FROM tok JOIN c1 USING (w) JOIN o1 USING (doc_id, w) LEFT JOIN c1 p ON p.w = tok.v LEFT JOIN o1 op ON op.doc_id = tok.doc_id AND op.w = tok.v LEFT JOIN c2 ON c2.v = tok.v AND c2.w = tok.w LEFT JOIN o2 ON o2.doc_id = tok.doc_id AND o2.v = tok.v AND o2.w = tok.w, g),
y AS (SELECT *, ((t - inside * o) + 1.0::DOUBLE) / ((nt - inside * n) + vocab) AS pt, (rate * (a - o) + 1.0::DOUBLE) / (rate * (na - n) + vocab) AS pa FROM x),
z AS (SELECT doc_id, sum(ln(CASE WHEN v IS NULL THEN pa ELSE (rate * (a2 - oo) + 16 * pa) / (rate * (ha - hist) + 16) END) - ln(CASE WHEN v IS NULL THEN pt ELSE ((t2 - inside * oo) + 16 * pt) / ((ht - inside * hist) + 16) END)) AS s FROM y GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_tokens, round(coalesce(s / len(ws), 0.0), 6)::DOUBLE AS score FROM dw LEFT JOIN z USING (doc_id)"""


def _runs(name: str, size: int) -> str:
    """Maximal runs of bytes that repeated strings of this size cover: every string's MD5, bytes as hexadecimal digits."""
    return f"""{name}p AS (SELECT doc_id, n, j, substr(h, ({2 * size} * j + 1)::BIGINT, {4 * size}) AS p FROM (SELECT doc_id, h, n, unnest(range((n - 1) // {size} + 1)) AS j FROM d WHERE n >= {size})),
{name}w AS MATERIALIZED (SELECT doc_id, {size} * j + o AS k, md5(substr(p, (2 * o + 1)::BIGINT, {2 * size})) AS m FROM {name}p, (SELECT unnest(range({size})) AS o) WHERE {size} * j + o + {size} <= n),
{name}r AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM {name}w JOIN (SELECT m FROM {name}w GROUP BY m HAVING count(*) > 1) USING (m)),
{name} AS MATERIALIZED (SELECT doc_id, min(k) AS a, max(k) + {size} AS b FROM (SELECT doc_id, k, sum(CASE WHEN k <= prev + {size} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM {name}r) GROUP BY doc_id, g)"""


OP10 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
{_runs("cut", 400)},
{_runs("pass", 240)},
piece AS (SELECT doc_id, 0 AS s, min(a) AS e FROM cut GROUP BY doc_id UNION ALL SELECT doc_id, b, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), n) FROM cut JOIN d USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, (2 * s + 1)::BIGINT, (2 * (e - s))::BIGINT), '' ORDER BY s) AS h FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
byte AS (SELECT doc_id, a, i, substr(h, (2 * i + 1)::BIGINT, 2) IN ('20', '09', '0A', '0B', '0C', '0D') AS gap FROM (SELECT doc_id, h, a, unnest(range(a, b)) AS i FROM pass JOIN d USING (doc_id))),
words AS (SELECT doc_id, a, count(*) FILTER (NOT gap AND coalesce(before, true)) AS n FROM (SELECT *, lag(gap) OVER (PARTITION BY doc_id, a ORDER BY i) AS before FROM byte) GROUP BY doc_id, a)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(CASE WHEN gone IS NULL THEN d.h ELSE coalesce(kept.h, '') END)) AS kept_sha256, coalesce(many, 0)::BIGINT AS n_passage_words
FROM d LEFT JOIN (SELECT doc_id, sum(b - a) AS gone, count(*) AS runs FROM cut GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(n) AS many FROM words WHERE n > 50 GROUP BY doc_id) USING (doc_id)"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13 = f"""
WITH dt AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS t FROM documents) GROUP BY ALL),
l AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM dt GROUP BY doc_id),
g AS MATERIALIZED (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM l),
it AS MATERIALIZED (SELECT item_id, t, count(*) AS r FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS t FROM benchmark) GROUP BY ALL),
w AS MATERIALIZED (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM dt GROUP BY t), g),
p AS MATERIALIZED (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nn) // ll)))) AS share FROM dt JOIN l USING (doc_id) JOIN w USING (t), g),
s AS (SELECT item_id, doc_id, sum(r * share)::BIGINT AS score FROM it JOIN p USING (t) GROUP BY ALL HAVING sum(r * share) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 20"""


ORACLES = {"op1_ngram_join": OP1, "op2_warc": OP2, "op3_quality_rules": op3(), "op5_lm_score": OP5, "op8_decontamination": OP8, "op10_suffix_dedup": OP10, "op11_centroid_clustering": op11(), "op12_embedding_dedup": OP12, "op13_ranked_search": OP13}
