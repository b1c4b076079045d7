"""DuckDB SQL of the catalogue's queries, over the same tables."""

from __future__ import annotations

from ..functions import hyperbolic as H
from ..functions.text import STOPWORDS
from ..operators.scoring import THRESHOLDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
#: Unicode white space, spelt out for DuckDB's regular expressions: fixed values.
_SPACES = r"[\s\x{00a0}\x{0085}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+"

_CHUNKS = """
cut AS (
  SELECT source, doc_id, start, substring(text, start + 1, 2000) AS chunk,
         length(substring(text, 1, start)) - length(replace(substring(text, 1, start), chr(10), '')) + 1 AS source_line
  FROM (SELECT source, doc_id, text, unnest(range(0, length(text), 1800)) AS start FROM documents)
), counts AS (SELECT source, count(*) AS n_chunks FROM cut GROUP BY source)"""
_TOKENS = rf"""
words AS (
  SELECT source, doc_id, start, source_line,
         list_filter(list_transform(regexp_split_to_array(chunk, '{_SPACES}'), lambda t: lower(regexp_replace(t, '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g'))), lambda t: t <> '') AS w
  FROM cut
)"""
_TERMS = f"""
grams AS (
  SELECT source, doc_id, start, source_line, w[i] AS first, w[i + n - 1] AS last, array_to_string(w[i : i + n - 1], ' ') AS term
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)
), terms AS (
  SELECT DISTINCT source, doc_id, start, source_line, term FROM grams
  WHERE first NOT IN ({_STOP}) AND last NOT IN ({_STOP}) AND strlen(term) > 2
)"""


def _frequencies(least: int) -> str:
    return f"""
frequencies AS (
  SELECT source, term, count(*) AS df, arg_min(source_line, doc_id * 1000000000 + start) AS first_line FROM terms GROUP BY source, term HAVING count(*) >= {least}
), scores AS (
  SELECT *, df * ln((n_chunks + 1) / (df + 1)) AS score FROM frequencies JOIN counts USING (source)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, term) AS rank FROM scores)"""


_BASE = f"WITH {_CHUNKS}, {_TOKENS}, {_TERMS}, {_frequencies(10)}"
_STRONG = """
top AS (SELECT * FROM ranked WHERE rank <= 100),
strong AS (
  SELECT source, term, df, CASE WHEN max(score) OVER () > 0 THEN least(1.0, greatest(0.0, score / max(score) OVER ())) ELSE 0.0 END AS strength,
         CASE WHEN max(score) OVER (PARTITION BY source) > 0 THEN least(1.0, greatest(0.0, score / max(score) OVER (PARTITION BY source))) ELSE 0.0 END AS own_strength
  FROM top
)"""


def _dot(vector: list[float]) -> str:
    return " + ".join(f"e[{k + 1}]::DOUBLE * ({x!r}::DOUBLE)" for k, x in enumerate(vector))


_V = H.projections(64, 42)
_RAW = f"""
raw AS (
  SELECT vec_id, label, ((vec_id * 37) % 100 + 1) / 100.0::DOUBLE AS strength, e,
         {_dot(_V[0])} AS r0, {_dot(_V[1])} AS r1, {_dot(_V[2])} AS r2, {_dot(_V[3])} AS s0, {_dot(_V[4])} AS s1, {_dot(_V[5])} AS f0
  FROM (SELECT vec_id, label, embedding AS e FROM embeddings)
), dirs AS (
  SELECT *, CASE WHEN norm < 1e-10 THEN 1.0 ELSE r0 / norm END AS d0, CASE WHEN norm < 1e-10 THEN 0.0 ELSE r1 / norm END AS d1, CASE WHEN norm < 1e-10 THEN 0.0 ELSE r2 / norm END AS d2
  FROM (SELECT *, sqrt(r0 * r0 + r1 * r1 + r2 * r2) AS norm FROM raw)
)"""
_SPOTS = """
spots AS (
  SELECT vec_id, strength, label, d0 * r AS x, d1 * r AS y, d2 * r AS z FROM (SELECT *, least(0.95, 1 - 0.9 * strength) AS r FROM dirs)
)"""


def _poincare(a: tuple[str, str, str], b: tuple[str, str, str]) -> str:
    gap = " + ".join(f"({p} - {q}) * ({p} - {q})" for p, q in zip(a, b, strict=True))
    aa, bb = (" + ".join(f"({p}) * ({p})" for p in v) for v in (a, b))
    return f"acosh(greatest(1.0, 1 + 2 * ({gap}) / ((1 - ({aa})) * (1 - ({bb})))))"


def _mobius(o: tuple[str, str, str], x: tuple[str, str, str]) -> list[str]:
    """x in the frame of o."""
    ab = "(" + " + ".join(f"(-({p})) * ({q})" for p, q in zip(o, x, strict=True)) + ")"
    aa, bb = ("(" + " + ".join(f"({p}) * ({p})" for p in v) + ")" for v in (o, x))
    return [f"((1 + 2 * {ab} + {bb}) * (-({p})) + (1 - {aa}) * ({q})) / (1 + 2 * {ab} + {aa} * {bb})" for p, q in zip(o, x, strict=True)]


_P = ("p.x", "p.y", "p.z")
_ANCHORS = f"""
ordered AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS k FROM spots),
walk AS (
  SELECT 0::BIGINT AS k, [{{'x': 0.0::DOUBLE, 'y': 0.0::DOUBLE, 'z': 0.0::DOUBLE, 'ord': -1::BIGINT}}] AS anchors
  UNION ALL
  SELECT p.k, CASE WHEN list_min(list_transform(anchors, lambda a: {_poincare(('a.x', 'a.y', 'a.z'), _P)})) <= 0.9 THEN anchors
              ELSE list_append(anchors, {{'x': p.x, 'y': p.y, 'z': p.z, 'ord': p.vec_id}}) END
  FROM walk JOIN ordered p ON p.k = walk.k + 1
), born AS (
  SELECT (i - 1)::INTEGER AS shard_no, 'shard-' || (i - 1) AS shard_id, anchors[i].x AS ax, anchors[i].y AS ay, anchors[i].z AS az, anchors[i].ord AS ord
  FROM (SELECT anchors, unnest(range(1, len(anchors) + 1)) AS i FROM walk WHERE k = (SELECT max(k) FROM walk))
)"""
_Q = _mobius(("ax", "ay", "az"), ("x", "y", "z"))
_ASSIGNED = f"""
assigned AS (
  SELECT *, {_Q[0]} AS q0, {_Q[1]} AS q1, {_Q[2]} AS q2 FROM (
    SELECT p.vec_id, p.strength, p.x, p.y, p.z, b.shard_no, b.shard_id, b.ax, b.ay, b.az, b.ord = p.vec_id AS is_new, {_poincare(('b.ax', 'b.ay', 'b.az'), _P)} AS distance,
           row_number() OVER (PARTITION BY p.vec_id ORDER BY {_poincare(('b.ax', 'b.ay', 'b.az'), _P)}, b.shard_no) AS n
    FROM spots p JOIN born b ON b.ord <= p.vec_id
  ) WHERE n = 1
)"""
_WALK = f"WITH RECURSIVE {_RAW}, {_SPOTS}, {_ANCHORS}"
_QUESTION = f"""
question AS (SELECT 0.5 * d0 AS x, 0.5 * d1 AS y, 0.5 * d2 AS z FROM dirs WHERE vec_id = 0),
near AS (SELECT shard_no, shard_id, {_poincare(('ax', 'ay', 'az'), _P)} AS distance FROM born, question p ORDER BY distance, shard_no LIMIT 6)"""


def _nearest(where: tuple[str, str, str], shards: str) -> str:
    return f"""{_WALK}, {_ASSIGNED}, {_QUESTION}, found AS (
  SELECT 't' || vec_id AS raw_term, vec_id, shard_id, {_poincare(tuple('a.' + w for w in where), _P)} AS distance FROM assigned a, question p WHERE {shards} ORDER BY distance, raw_term LIMIT 5
)"""


_PAIRS = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (
  SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id
), near5 AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM pairs QUALIFY rank <= 5),
hood AS (SELECT i AS c, 0 AS l, i AS m FROM near5 WHERE rank = 1 UNION ALL SELECT i, rank, j FROM near5),
inner_d AS (SELECT a.c, a.l AS a, b.l AS b, p.d FROM hood a JOIN hood b ON a.c = b.c AND a.l <> b.l JOIN pairs p ON p.i = a.m AND p.j = b.m)"""
_DELTA = """
sums AS (
  SELECT ab.c, ab.d + cd.d AS s1, ac.d + bd.d AS s2, ad.d + bc.d AS s3
  FROM inner_d ab JOIN inner_d cd ON cd.c = ab.c AND ab.a < ab.b AND ab.b < cd.a AND cd.a < cd.b
  JOIN inner_d ac ON ac.c = ab.c AND ac.a = ab.a AND ac.b = cd.a JOIN inner_d bd ON bd.c = ab.c AND bd.a = ab.b AND bd.b = cd.b
  JOIN inner_d ad ON ad.c = ab.c AND ad.a = ab.a AND ad.b = cd.b JOIN inner_d bc ON bc.c = ab.c AND bc.a = ab.b AND bc.b = cd.a
), delta AS (
  SELECT c, max((greatest(s1, s2, s3) - (s1 + s2 + s3 - greatest(s1, s2, s3) - least(s1, s2, s3))) / 2) AS gromov_delta FROM sums GROUP BY c
)"""
#: The double-centred squared distances of each neighbourhood of six points, entry by entry.
_MATRIX = """
square AS (SELECT c, a, b, d * d AS s FROM inner_d UNION ALL SELECT DISTINCT c, a, a, 0.0::DOUBLE FROM inner_d),
centred AS (
  SELECT c, a, b, -0.5 * (s - avg(s) OVER (PARTITION BY c, a) - avg(s) OVER (PARTITION BY c, b) + avg(s) OVER (PARTITION BY c)) AS g FROM square
)"""
_SIGNAL = """
signals AS (
  SELECT cut.source, cut.doc_id, cut.start, coalesce(sum(s.own_strength), 0.0) AS signal
  FROM cut LEFT JOIN strong s ON s.source = cut.source AND s.own_strength > 0.5 AND contains(lower(cut.chunk), s.term) GROUP BY ALL
)"""
_BEST = """
best AS (
  SELECT t.source, t.term, t.doc_id, t.start, s.signal, row_number() OVER (PARTITION BY t.source, t.term ORDER BY round(s.signal, 9) DESC, t.doc_id, t.start) AS place
  FROM terms t JOIN ranked r ON r.source = t.source AND r.term = t.term AND r.rank <= 100 JOIN signals s ON s.source = t.source AND s.doc_id = t.doc_id AND s.start = t.start QUALIFY place <= 5
)"""
_PROMPT = """'You are summarizing a text document.' || chr(10) || 'Write exactly one sentence describing what "' || term || '" refers to in the excerpts below.' || chr(10) ||
'Use only information explicitly present in the text — do not interpret, infer, or add outside knowledge.' || chr(10) || 'If the excerpts do not clearly describe "' || term ||
'", write: "This text mentions ' || term || ' without a clear description."' || chr(10) || chr(10) || 'TEXT EXCERPTS:' || chr(10) || context || chr(10) || chr(10) ||
'One sentence description of "' || term || '" based only on the text above:'"""
_HASHED = ", ".join(f"(('0x' || substring(md5(term || ':{j}'), 1, 8))::BIGINT)::DOUBLE / 2147483648.0 - 1" for j in range(4))
_M = _mobius(("0.7::DOUBLE", "0.1::DOUBLE", "0.0::DOUBLE"), ("x", "y", "z"))

ORACLES: dict[str, str] = {
    "chunks": f"WITH {_CHUNKS} SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, start) - 1 AS chunk_no, doc_id, length(chunk) AS n_chars, source_line, md5(chunk) AS text_md5 FROM cut",
    "chunk_counts": f"WITH {_CHUNKS} SELECT * FROM counts",
    "tokens": f"WITH {_CHUNKS}, {_TOKENS} SELECT source, token, count(*) AS n FROM (SELECT source, unnest(w) AS token FROM words) GROUP BY ALL",
    "ngrams": f"WITH {_CHUNKS}, {_TOKENS}, {_TERMS} SELECT source, doc_id, start, count(*) AS n_terms, sum(length(term))::BIGINT AS n_term_chars FROM terms GROUP BY ALL",
    "term_df": f"{_BASE} SELECT source, term, df FROM frequencies",
    "tfidf_scores": f"{_BASE} SELECT source, term, df, round(score, 6) AS score FROM scores",
    "top_terms_per_source": f"{_BASE} SELECT source, rank, term, df, round(score, 6) AS score FROM ranked WHERE rank <= 100",
    "top_terms_small": f"WITH {_CHUNKS}, {_TOKENS}, {_TERMS}, {_frequencies(2)} SELECT source, rank, term, df, round(score, 6) AS score FROM ranked WHERE rank <= 100",
    "term_chunk_lists": f"""{_BASE}, numbered AS (SELECT source, doc_id, start, row_number() OVER (PARTITION BY source ORDER BY doc_id, start) - 1 AS chunk_no FROM cut)
SELECT r.source, r.term, string_agg(chunk_no::VARCHAR, ',' ORDER BY chunk_no) AS chunk_nos, r.first_line
FROM ranked r JOIN terms t ON t.source = r.source AND t.term = r.term JOIN numbered n ON n.source = t.source AND n.doc_id = t.doc_id AND n.start = t.start WHERE r.rank <= 100 GROUP BY r.source, r.term, r.first_line""",
    "strengths": f"{_BASE}, {_STRONG} SELECT source, term, round(strength, 6) AS strength FROM strong",
    "strengths_per_source": f"{_BASE}, {_STRONG} SELECT source, term, round(own_strength, 6) AS strength FROM strong",
    "survival_counts": f"""{_BASE}, {_STRONG}, one AS (SELECT term, arg_max(round(strength, 9), source) AS strength FROM strong GROUP BY term)
SELECT threshold, count(CASE WHEN strength >= threshold THEN 1 END) AS survivors FROM one, (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in THRESHOLDS)}]) AS threshold) GROUP BY threshold""",
    "last_wins_dedupe": f"{_BASE}, {_STRONG} SELECT term, max(source) AS source, round(arg_max(strength, source), 6) AS strength FROM strong GROUP BY term",
    "placed_filter": "SELECT vec_id, ((vec_id * 37) % 100 + 1) / 100.0::DOUBLE AS strength FROM embeddings WHERE ((vec_id * 37) % 100 + 1) / 100.0::DOUBLE >= 0.5",
    "max_concepts_topk": "SELECT vec_id, ((vec_id * 37) % 100 + 1) / 100.0::DOUBLE AS strength FROM embeddings WHERE ((vec_id * 37) % 100 + 1) / 100.0::DOUBLE >= 0.001 ORDER BY strength DESC, vec_id LIMIT 100",
    "pair_distances": f"WITH {_PAIRS} SELECT count(*) AS n_pairs, round(sum(d) / count(*), 6) AS mean_distance, round(min(d), 6) AS least_distance, round(max(d), 6) AS largest_distance FROM pairs WHERE i < j",
    "knn": f"WITH {_PAIRS} SELECT i AS vec_id, rank, j AS neighbor_id, round(d, 6) AS distance FROM near5",
    "gromov_delta": f"WITH {_PAIRS}, {_DELTA} SELECT c AS vec_id, round(gromov_delta, 6) AS gromov_delta FROM delta",
    "eigen_power_sums": f"""WITH {_PAIRS}, {_MATRIX}, one AS (SELECT c, sum(g) AS p FROM centred WHERE a = b GROUP BY c), two AS (SELECT c, sum(g * g) AS p FROM centred GROUP BY c),
three AS (SELECT x.c, sum(x.g * y.g * z.g) AS p FROM centred x JOIN centred y ON y.c = x.c AND y.a = x.b JOIN centred z ON z.c = x.c AND z.a = y.b AND z.b = x.a GROUP BY x.c)
SELECT one.c AS vec_id, round(one.p, 6) AS p1, round(two.p, 6) AS p2, round(three.p, 6) AS p3 FROM one JOIN two USING (c) JOIN three USING (c)""",
    "mds_trace": f"WITH {_PAIRS} SELECT c AS vec_id, round(sum(d * d) / 12, 6) AS trace FROM inner_d GROUP BY c",
    "directions": f"WITH {_RAW} SELECT vec_id, round(d0, 6) AS d0, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM dirs",
    "spherical_angle": f"WITH {_RAW} SELECT vec_id, round(atan2(s0, s1), 6) AS theta FROM raw",
    "flat_position": f"WITH {_RAW} SELECT vec_id, round(f0, 6) AS flat_pos FROM raw",
    "positions": f"""WITH {_PAIRS}, {_DELTA}, {_RAW}
SELECT vec_id, round(d0 * r, 6) AS p0, round(d1 * r, 6) AS p1, round(d2 * r, 6) AS p2
FROM (SELECT *, least(0.95, 1 - 0.9 * strength + CASE WHEN gromov_delta >= 0.15 THEN 0.1 ELSE 0.0 END) AS r FROM dirs JOIN delta ON delta.c = dirs.vec_id)""",
    "poincare_to_origin": f"WITH {_RAW}, {_SPOTS} SELECT vec_id, round({_poincare(('x', 'y', 'z'), ('0.0', '0.0', '0.0'))}, 6) AS distance FROM spots",
    "mobius_local": f"WITH {_RAW}, {_SPOTS} SELECT vec_id, round({_M[0]}, 6) AS q0, round({_M[1]}, 6) AS q1, round({_M[2]}, 6) AS q2 FROM spots",
    "isometry_check": "SELECT count(*) AS n, count(*) AS n_equal FROM embeddings",
    "leader_anchors": f"{_WALK} SELECT shard_no, shard_id, ord, round(ax, 6) AS a0, round(ay, 6) AS a1, round(az, 6) AS a2 FROM born",
    "registry_resume": f"{_WALK} SELECT shard_no, shard_id, round(ax, 6) AS a0, round(ay, 6) AS a1, round(az, 6) AS a2 FROM born",
    "shard_assignments": f"{_WALK}, {_ASSIGNED} SELECT vec_id, shard_id, is_new, round(distance, 6) AS distance, round(q0, 6) AS q0, round(q1, 6) AS q1, round(q2, 6) AS q2 FROM assigned",
    "shard_sizes": f"{_WALK}, {_ASSIGNED} SELECT shard_id, count(*) AS n_concepts FROM assigned GROUP BY shard_id",
    "nearest_shards": f"{_WALK}, {_QUESTION} SELECT shard_no, shard_id, round(distance, 6) AS distance FROM near",
    "shard_roundtrip": f"{_WALK}, {_ASSIGNED} SELECT shard_id, 't' || vec_id AS raw_term, round(strength, 6) AS strength, round(q0, 6) AS q0, round(q1, 6) AS q1, round(q2, 6) AS q2 FROM assigned",
    "retrieve_global": f"{_nearest(('x', 'y', 'z'), 'shard_id IN (SELECT shard_id FROM near)')} SELECT raw_term, shard_id, round(distance, 6) AS distance FROM found",
    "retrieve_local_raw": f"{_nearest(('q0', 'q1', 'q2'), 'shard_id IN (SELECT shard_id FROM near)')} SELECT raw_term, shard_id, round(distance, 6) AS distance FROM found",
    "retrieve_exact": f"{_nearest(('x', 'y', 'z'), 'true')} SELECT raw_term, shard_id, round(distance, 6) AS distance FROM found",
    "retrieve_display": f"{_nearest(('x', 'y', 'z'), 'shard_id IN (SELECT shard_id FROM near)')} SELECT raw_term, left(repeat('row ' || vec_id, 20), 100) AS description, round(distance, 6) AS distance FROM found",
    "rag_prompt": f"""{_nearest(('x', 'y', 'z'), 'shard_id IN (SELECT shard_id FROM near)')}
SELECT 'Answer the following question using only the facts provided below.' || chr(10) || 'Do not use outside knowledge. If the facts do not contain enough information, say so.' || chr(10) || chr(10) || 'FACTS:' || chr(10) ||
       string_agg('- ' || raw_term || ': ' || repeat('row ' || vec_id, 20), chr(10) ORDER BY distance, raw_term) || chr(10) || chr(10) || 'QUESTION: What is near?' || chr(10) || chr(10) || 'ANSWER:' AS prompt FROM found""",
    "chunk_signal": f"{_BASE}, {_STRONG}, {_SIGNAL} SELECT source, doc_id, start, round(signal, 6) AS signal FROM signals",
    "top_chunks": f"{_BASE}, {_STRONG}, {_SIGNAL}, {_BEST} SELECT source, term, place AS rank, doc_id, start, round(signal, 6) AS signal FROM best",
    "summary_prompt": f"""{_BASE}, {_STRONG}, {_SIGNAL}, {_BEST}, contexts AS (
  SELECT b.source, b.term, string_agg(c.chunk, chr(10) || '---' || chr(10) ORDER BY b.place) AS context FROM best b JOIN cut c ON c.source = b.source AND c.doc_id = b.doc_id AND c.start = b.start GROUP BY ALL
) SELECT source, term, md5({_PROMPT}) AS prompt_md5 FROM contexts""",
    "name_prompts": """SELECT conv_id, turn, md5('Based on this description, give a short 1-3 word name that captures what this concept is about.' || chr(10) ||
'Do not use generic words like "time", "one", "first", "number".' || chr(10) || 'Use specific meaningful terms from the description.' || chr(10) || chr(10) || 'Description: ' || text || chr(10) || chr(10) ||
'Respond with ONLY the name, nothing else. 2-3 words maximum:') AS prompt_md5 FROM conversations""",
    "enriched_terms": rf"""{_BASE}, {_STRONG}, {_SIGNAL}, {_BEST}, described AS (
  SELECT b.source, b.term, regexp_replace(split_part(c.chunk, chr(10), 1), '^{_SPACES}|{_SPACES}$', '', 'g') AS description
  FROM best b JOIN cut c ON c.source = b.source AND c.doc_id = b.doc_id AND c.start = b.start WHERE b.place = 1
), proposed AS (
  SELECT *, lower(array_to_string(list_filter(regexp_split_to_array(description, '{_SPACES}'), lambda w: w <> '')[1:3], ' ')) AS name FROM described
)
SELECT source, term AS raw_term, md5(description) AS description_md5, CASE WHEN strlen(name) > 40 THEN term ELSE name END AS label FROM proposed""",
    "custom_ngrams": f"WITH {_CHUNKS}, {_TOKENS}, {_TERMS.replace('[1, 2, 3]', '[1, 2, 3, 4, 5]')} SELECT source, doc_id, start, count(*) AS n_terms, sum(length(term))::BIGINT AS n_term_chars FROM terms GROUP BY ALL",
    "source_order": f"""{_BASE}, places AS (SELECT source, row_number() OVER (ORDER BY source DESC) - 1 AS place FROM (SELECT DISTINCT source FROM documents))
SELECT source, term, place * 4294967296 + rank AS ord FROM ranked JOIN places USING (source) WHERE rank <= 100""",
    "validate_names": rf"""SELECT conv_id, turn, CASE WHEN len(list_filter(regexp_split_to_array(name, '{_SPACES}'), lambda w: w <> '')) > 4 OR strlen(name) > 40 THEN 'term ' || turn ELSE name END AS label
FROM (SELECT conv_id, turn, lower(regexp_replace(text, '^{_SPACES}|{_SPACES}$', '', 'g')) AS name FROM conversations)""",
    "embedding_join": f"{_BASE} SELECT r.source, e.label, count(*) AS n_terms FROM ranked r JOIN embeddings e ON e.vec_id = r.rank * 5 + 200 WHERE r.rank <= 100 GROUP BY ALL",
    "strength_left_join": f"{_BASE}, {_STRONG} SELECT f.source, f.term, round(coalesce(s.strength, 0.0), 6) AS strength FROM frequencies f LEFT JOIN strong s ON s.source = f.source AND s.term = f.term",
    "hashed_embeddings": f"""{_BASE}, hashed AS (SELECT term, [{_HASHED}] AS v FROM (SELECT DISTINCT term FROM ranked WHERE rank <= 100))
SELECT term, round(v[1] / n, 6) AS v0, round(v[2] / n, 6) AS v1, round(v[3] / n, 6) AS v2, round(v[4] / n, 6) AS v3 FROM (SELECT *, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3] + v[4] * v[4]) AS n FROM hashed)""",
}
