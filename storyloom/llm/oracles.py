"""SQL of the queries that DuckDB can express."""

from __future__ import annotations

from .line_dedup import BANDS
from .mixing import KNOTS, SHAPES, SHARE, TIMES, WEIGHTS
from .sharding import layout

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_SHORTER = "least(length(a.line), length(b.line))"
ALLOWED = "CASE " + " ".join(f"WHEN {_SHORTER} >= {n} THEN {k}" for n, k in reversed(BANDS)) + " ELSE 0 END"
# DuckDB's distance counts bytes, so the characters of a pair are numbered among themselves first; up to 127 are a byte each.
_CODED = "array_to_string(list_transform(string_split({}, ''), lambda c: chr(CAST(list_position(x, c) AS INT))), '')"
LINES = f"""WITH RECURSIVE l AS (SELECT doc_id, i - 1 AS line_no, trim(x[i], E' \\t\\n\\x0b\\x0c\\r') AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
 lines AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, line FROM l WHERE line <> ''),
 texts AS (SELECT line, min((doc_id, line_no)) AS first FROM lines GROUP BY line),
 met AS (SELECT a.line AS a, b.line AS b, {ALLOWED} AS k FROM texts a JOIN texts b ON a.first <> b.first AND abs(length(a.line) - length(b.line)) <= {ALLOWED} AND levenshtein(a.line, b.line) <= 4 * {ALLOWED}),
 links AS (SELECT a, b FROM (SELECT *, list_distinct(string_split(a || b, '')) AS x FROM met) WHERE levenshtein({_CODED.format('a')}, {_CODED.format('b')}) <= k),
 walk(line, up) AS (SELECT line, line FROM texts WHERE line IN (SELECT a FROM links) UNION SELECT w.line, k.b FROM walk w JOIN links k ON k.a = w.up),
 comp AS (SELECT w.line, min(t.first) AS first FROM walk w JOIN texts t ON t.line = w.up GROUP BY w.line),
 deg AS (SELECT a AS line, count(*) AS n FROM links GROUP BY a),
 named AS (SELECT s.*, coalesce(c.first, t.first) AS f, coalesce(n, 0) AS n_links FROM lines s JOIN texts t ON t.line = s.line LEFT JOIN comp c ON c.line = s.line LEFT JOIN deg d ON d.line = s.line)
SELECT doc_id, line_no, CAST(length(line) AS INT) AS n_chars, f[1] AS class_doc, f[2] AS class_line, n_links, f[1] = doc_id AND f[2] = line_no AS kept FROM named"""

_CHUNK = "translate(to_base(('0x' || substr(h, {}, 10))::BIGINT, 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
WARC = f"""SELECT page_id, payload_bytes, {' || '.join(_CHUNK.format(1 + 10 * k) for k in range(4))} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM (SELECT page_id, strlen(p) AS payload_bytes, sha1(p) AS h, min(page_id) OVER (PARTITION BY p) AS first FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))"""

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
 walk(id, up) AS (SELECT vec_id, vec_id FROM v UNION SELECT w.id, k.b FROM walk w JOIN links k ON k.a = w.up),
 comp AS (SELECT id, min(up) AS c FROM walk GROUP BY id), deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(c, e.vec_id) AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept FROM embeddings e LEFT JOIN comp ON id = e.vec_id LEFT JOIN deg ON a = e.vec_id"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
 walk(id, up) AS (SELECT doc_id, doc_id FROM n UNION SELECT v.id, k.b FROM walk v JOIN links k ON k.a = v.up), comp AS (SELECT id, min(up) AS c FROM walk GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON id = d.doc_id"""

_WEIGHT = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS))
_SHAPE = ", ".join(f"({k}, {t0}, {t1}, {a}, {b})" for k, s in enumerate(SHAPES) for t0, t1, a, b in zip(KNOTS, KNOTS[1:], s, s[1:], strict=False))
MIXING = f"""WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
 r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
 k AS (SELECT *, CASE kind {_WEIGHT} END::DOUBLE AS weight, {TIMES} * source_size AS cap FROM r),
 o AS (SELECT *, {SHARE} * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
   sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS n FROM k),
 f AS (SELECT *, CAST(cap AS DOUBLE) * ws <= lft * weight AS filled FROM o), g AS (SELECT *, min(n) FILTER (NOT filled) OVER () AS m FROM f),
 t AS (SELECT source, source_size, kind, coalesce(CASE WHEN filled THEN cap ELSE max(lft) FILTER (n = m) OVER () * weight / max(ws) FILTER (n = m) OVER () END, 0.0)::DOUBLE AS target FROM g),
 b AS (SELECT d.*, source_size, kind, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
   CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
 c AS (SELECT *, CAST(whole * size + greatest(least(round(target - whole * source_size) - before, size), 0) AS BIGINT) AS taken FROM b),
 s(kind, t0, t1, w0, w1) AS (VALUES {_SHAPE}), q AS (SELECT *, (w0 + w1) / 2 * (t1 - t0) AS area, coalesce(sum((w0 + w1) / 2 * (t1 - t0)) OVER (PARTITION BY kind ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM s),
 p AS (SELECT c.*, q.t0, q.t1, q.w0, q.w1, q.done, least(CASE WHEN target > 0 THEN before / target ELSE 0 END, 1) AS place FROM c JOIN q ON q.kind = c.kind
   AND least(CASE WHEN target > 0 THEN before / target ELSE 0 END, 1) >= done AND (least(CASE WHEN target > 0 THEN before / target ELSE 0 END, 1) < done + area OR done + area >= 1))
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(least(t0 + CASE WHEN place > done THEN 2 * (place - done) / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) / (t1 - t0) * (place - done), 0))) ELSE 0 END, t1), 6) END AS position FROM p"""


def _draw(name: str, weight: float) -> str:
    return f"-ln((('0x' || substr(md5('{name}:' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {weight}"


def _pick(children: list[tuple[str, float, str]]) -> str:
    if len(children) == 1:
        return children[0][2]
    rows = ", ".join(f"{{'d': {_draw(n, w)}, 'i': {i}}}" for i, (n, w, _) in enumerate(children))
    return f"CASE list_min([{rows}]).i " + " ".join(f"WHEN {i} THEN {v}" for i, (_, _, v) in enumerate(children)) + " END"


def shard_sql(shards: int) -> str:
    regions = []
    for region in layout(shards):
        racks = [(k["name"], sum(w for _, w in k["shards"]), _pick([(f"s{s}", w, str(s)) for s, w in k["shards"]])) for k in region["racks"]]
        regions.append((region["name"], sum(w for _, w, _ in racks), _pick(racks)))
    return _pick(regions)


ORACLES = {"op1_line_dedup": LINES, "op2_warc": WARC, "op3_embedding_dedup": EMBEDDINGS, "op4_minhash_dedup": NEAR, "op5_mixing": MIXING}

#: CRC-32 of a text's bytes, each in two halves, the low one first; the table follows from the polynomial.
_HALF = "(SELECT list(CAST(list_reduce([k, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS BIGINT) ORDER BY k) FROM range(16) r(k))"
_ONE = "xor(half[CAST(xor({c}, {b}) & 15 AS BIGINT) + 1], {c} >> 4)"
_BYTE = _ONE.format(c=_ONE.format(c="crc", b="b"), b="(b >> 4)")
CRC = f"""WITH t AS MATERIALIZED (SELECT {_HALF} AS half), x AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
 c AS (SELECT doc_id, strlen(s) + 1 AS size, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(s), '..'), lambda p: ('0x' || p)::BIGINT)), lambda crc, b: {_BYTE})) AS text_crc32 FROM x, t)"""
ORACLES["op6_sharding"] = f"""{CRC} SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard
FROM (SELECT *, {shard_sql(8)} AS shard, {shard_sql(9)} AS grown_shard FROM c)"""

_H = "('0x' || substr(h, {}, 8))::BIGINT"
FIM = f"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 c AS (SELECT *, len(u) AS n, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain, {_H.format(1)} % (len(u) + 1) AS x, {_H.format(9)} % (len(u) + 1) AS y, {_H.format(25)} % 100 < 50 AS spm FROM u),
 p AS (SELECT doc_id, n, t, plain, spm, coalesce(array_to_string(u[1:least(x, y)], ''), '') AS p, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS m, coalesce(array_to_string(u[greatest(x, y) + 1:], ''), '') AS s FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
 sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
ORACLES["op13_fim"] = FIM

COLLOCATIONS = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
 w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p), m AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) t(m)),
 g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM m GROUP BY ALL), t AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang),
 c AS (SELECT *, string_split(phrase, ' ') AS x FROM g WHERE f >= 30 AND m > 1), k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
 s AS (SELECT c.lang, c.phrase, c.f AS a, k, h.f AS l, r.f AS r, 2000000 * c.f // (h.f + r.f) AS score FROM k c JOIN g h ON h.lang = c.lang AND h.phrase = array_to_string(c.x[1:k], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.x[k + 1:], ' ')),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 z AS (SELECT DISTINCT lang, phrase FROM (SELECT q.lang, q.f, unnest(list_transform(range(2, q.m), lambda o: [o, 0])) AS o, q.x, q.m FROM c q) q JOIN LATERAL (SELECT unnest(list_transform(range(1, q.m - q.o[1] + 2), lambda i: array_to_string(q.x[i:i + q.o[1] - 1], ' '))) AS phrase) ON true JOIN c USING (lang, phrase) WHERE 100 * q.f >= 80 * c.f)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM b JOIN t USING (lang) WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM z) QUALIFY rank <= 2000"""
ORACLES["op11_collocations"] = COLLOCATIONS
