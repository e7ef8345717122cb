"""DuckDB SQL for the catalogue's queries, put together from shared parts."""

from __future__ import annotations

from lodestone.functions.text import SPACES
from lodestone.plans.catalogue import HAN, LATIN
from lodestone.plans.stored import NOTE

#: White space as Python's str methods see it, at either end.
TRIM = f"trim({{}}, {' || '.join(f'chr({ord(c)})' for c in SPACES)})"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _chunks(text: str = "text", name: str = "chunks") -> str:
    """CTEs that end in doc_id, sequence, chunk_id, clean_text."""
    return rf"""
    {name}_p AS (
        SELECT doc_id, unnest(range(len(p))) AS pi, unnest(list_transform(p, lambda x: {STRIP.format('x')})) AS para
        FROM (SELECT doc_id, string_split_regex({STRIP.format(f"coalesce({text}, '')")}, '\n\s*\n+') AS p FROM documents)
    ),
    {name}_w AS (
        SELECT doc_id, pi, wi, CASE WHEN length(para) <= 800 THEN para ELSE {STRIP.format('substr(para, wi * 800 + 1, 800)')} END AS piece
        FROM (SELECT *, unnest(range(CAST(greatest(1, ceil(length(para) / 800.0)) AS BIGINT))) AS wi FROM {name}_p WHERE para <> '')
    ),
    {name} AS (
        SELECT *, doc_id || '::chunk_' || lpad(CAST(sequence AS VARCHAR), 6, '0') AS chunk_id
        FROM (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pi, wi) - 1 AS BIGINT) AS sequence, piece AS clean_text FROM {name}_w WHERE piece <> '')
    )"""


def _terms(source: str, key: str, text: str, name: str) -> str:
    return f"""
    {name}_all AS (SELECT {key}, unnest(list_filter(regexp_extract_all(lower({text}), '[a-z0-9_-]+'), lambda t: regexp_matches(t, '[a-z0-9]'))) AS term FROM {source}),
    {name}_tf AS (SELECT {key}, term, count(*) AS tf FROM {name}_all GROUP BY {key}, term),
    {name} AS (SELECT {key}, term, tf, CAST(sum(tf) OVER (PARTITION BY {key}) AS BIGINT) AS dl FROM {name}_tf)"""


QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)"


def _bm25(visible: str = "") -> str:
    """CTEs that end in lex: query_id, chunk_id, bm25, lexical_rank (40 best)."""
    return f"""
    {_terms('chunks', 'chunk_id', 'clean_text', 'postings')},
    asked AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9_-]+')) AS term FROM questions),
    stats AS (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT count(*) FROM postings_all) / (SELECT count(*) FROM chunks) AS avgdl),
    dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    scored AS (
        SELECT query_id, chunk_id,
               -sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END)
                    * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS bm25
        FROM asked JOIN dfs USING (term) JOIN postings USING (term), stats
        WHERE regexp_matches(term, '[a-z0-9]')
        GROUP BY query_id, chunk_id
    ),
    lex AS (
        SELECT query_id, chunk_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), chunk_id) AS lexical_rank
        FROM scored {visible} QUALIFY lexical_rank <= 40
    )"""


def _vectors(source: str, key: str, text: str, name: str) -> str:
    """CTEs that end in key, place, value of the deterministic embedding."""
    return rf"""
    {name}_s AS (
        SELECT {key}, unnest(s) AS c, unnest(range(len(s))) AS i, unnest(list_concat(s[2:], [NULL])) AS following
        FROM (SELECT {key}, string_split(regexp_replace(lower({text}), '\s', '', 'g'), '') AS s FROM {source})
        WHERE len(s) > 0
    ),
    {name}_b AS (
        SELECT {key}, CAST((unicode(c) + 17 * i) % 256 AS BIGINT) AS place, 1.0::DOUBLE AS v FROM {name}_s WHERE c <> ''
        UNION ALL SELECT {key}, CAST((31 * unicode(c) + unicode(following)) % 256 AS BIGINT), 0.5 FROM {name}_s WHERE following IS NOT NULL AND following <> ''
    ),
    {name}_t AS (SELECT {key}, place, sum(v) AS v FROM {name}_b GROUP BY ALL),
    {name} AS (SELECT {key}, place, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS value FROM {name}_t)"""


def _dense() -> str:
    return f"""
    {_vectors('chunks', 'chunk_id', 'clean_text', 'cv')},
    {_vectors('questions', 'query_id', 'question', 'qv')},
    near_all AS (SELECT query_id, chunk_id, sum(q.value * c.value) AS vector_score FROM qv q JOIN cv c USING (place) GROUP BY ALL),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(vector_score, 9) DESC, chunk_id) AS vector_rank FROM near_all QUALIFY vector_rank <= 40)"""


FUSED = """
    fused AS (
        SELECT query_id, chunk_id, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) AS fusion_score,
               vector_rank, vector_score, lexical_rank, bm25 AS lexical_score
        FROM near FULL JOIN lex USING (query_id, chunk_id)
    ),
    trace AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion_score, 12) DESC, chunk_id) AS fusion_rank FROM fused
    )"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


HYBRID = _with(_chunks(), QUESTIONS, _bm25(), _dense(), FUSED)
LEXICAL = _with(_chunks(), QUESTIONS, _bm25())


def _concepts(source: str, key: str, text: str, name: str = "concepts") -> str:
    return f"""
    {name}_c AS (SELECT {key}, unnest(x) AS concept, unnest(range(len(x))) AS pos FROM (SELECT {key}, regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9_-]{{1,23}}') AS x FROM {source})),
    {name} AS (
        SELECT {key}, concept, count(*) AS n, CAST(row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, min(pos)) AS BIGINT) AS place
        FROM {name}_c GROUP BY {key}, concept QUALIFY place <= 6
    )"""


EDGES = """
    edges AS (
        SELECT a.concept AS source, b.concept AS target, count(*) AS weight
        FROM concepts a JOIN concepts b ON a.chunk_id = b.chunk_id AND a.concept <> b.concept GROUP BY ALL
    )"""

NORMAL = r"""replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({}),
    '(\d),(\d{{3}})(\D|$)', '\1\2\3', 'g'), '(\d),(\d{{3}})(\D|$)', '\1\2\3', 'g'), '(\d),(\d{{3}})(\D|$)', '\1\2\3', 'g'),
    '[\s,;:，；：]+', '', 'g'), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '.', ''), chr(1), '.')"""

#: Query terms of a question without Han: identifiers of the normal form, then six concepts.
QUESTION_TERMS = f"""
    {_concepts('questions', 'query_id', 'question', 'qc')},
    qterms AS (
        SELECT query_id, unnest(regexp_extract_all({NORMAL.format('question')}, '[a-z0-9_-]{{2,}}')) AS term FROM questions
        UNION SELECT query_id, concept FROM qc
    )"""

HITS = """
    nodes AS (SELECT DISTINCT source AS concept FROM edges),
    touched AS (SELECT DISTINCT query_id, concept FROM qterms JOIN nodes ON contains(concept, term) OR contains(term, concept)),
    related AS (
        SELECT query_id, term FROM qterms UNION SELECT query_id, concept FROM touched
        UNION SELECT query_id, target FROM touched JOIN edges ON concept = source
    ),
    vocabulary AS (SELECT DISTINCT concept FROM concepts),
    pairs AS (SELECT DISTINCT term, concept FROM (SELECT DISTINCT term FROM related) JOIN vocabulary ON contains(concept, term) OR contains(term, concept)),
    matched AS (SELECT DISTINCT query_id, concept FROM related JOIN pairs USING (term)),
    hits AS (SELECT query_id, chunk_id, count(*) AS hits FROM matched JOIN concepts USING (concept) GROUP BY ALL)"""

KEYWORDS = f"""
    normals AS (SELECT chunk_id, {NORMAL.format('clean_text')} AS normal FROM chunks),
    nterms AS (SELECT query_id, {NORMAL.format('term')} AS term FROM qterms),
    counted AS (SELECT query_id, count(*) AS terms FROM nterms GROUP BY query_id),
    keyed AS (
        SELECT query_id, chunk_id, 0.2::DOUBLE * count(*) / any_value(terms) AS score
        FROM nterms JOIN counted USING (query_id) JOIN normals ON contains(normal, term) GROUP BY query_id, chunk_id
    )"""


#: CTEs that end in members: doc_id, sequence, chunk_id, topic (from 1) by leader clustering of the vectors cv.
TOPICS = """
    whole AS (
        SELECT doc_id, sequence, chunk_id, list(coalesce(value, 0) ORDER BY g.place) AS v
        FROM (SELECT doc_id, sequence, chunk_id, unnest(range(256)) AS place FROM chunks) g LEFT JOIN cv USING (chunk_id, place) GROUP BY ALL
    ),
    walk AS (
        SELECT doc_id, sequence, chunk_id, CAST(1 AS BIGINT) AS topic, [v] AS sums FROM whole WHERE sequence = 0
        UNION ALL
        SELECT doc_id, sequence, chunk_id, topic,
               CASE WHEN topic > len(sums) THEN list_append(sums, v) ELSE list_transform(sums, lambda s, i: CASE WHEN i = topic THEN list_transform(list_zip(s, v), lambda z: z[1] + z[2]) ELSE s END) END
        FROM (SELECT *, CAST(CASE WHEN list_max(near) >= 0.78 THEN list_position(near, list_max(near)) ELSE len(sums) + 1 END AS BIGINT) AS topic
              FROM (SELECT c.doc_id, c.sequence, c.chunk_id, c.v, w.sums, list_transform(w.sums, lambda s: list_dot_product(s, c.v) / sqrt(list_dot_product(s, s))) AS near
                    FROM walk w JOIN whole c ON c.doc_id = w.doc_id AND c.sequence = w.sequence + 1))
    ),
    members AS (SELECT doc_id, sequence, chunk_id, topic FROM walk)"""

#: What the members of a topic are called and listed as.
CHAPTERS = "chapters AS (SELECT chunk_id, CASE WHEN length(line) BETWEEN 2 AND 30 THEN line ELSE '未分类' END AS chapter FROM (SELECT chunk_id, trim(string_split(clean_text, chr(10))[1], ' #：:') AS line FROM chunks))"
NAMED = """
    named AS (
        SELECT doc_id, topic, string_agg(concept, ' / ' ORDER BY pos) AS names
        FROM (SELECT doc_id, topic, concept, min(sequence * 10 + place) AS pos FROM members JOIN concepts USING (chunk_id) GROUP BY ALL) GROUP BY ALL
    ),
    grouped AS (SELECT doc_id, topic, string_agg(chunk_id, ',' ORDER BY sequence) AS chunk_ids, arg_min(chapter, sequence) AS chapter FROM members JOIN chapters USING (chunk_id) GROUP BY ALL),
    clusters AS (SELECT doc_id || '::topic_' || lpad(CAST(topic - 1 AS VARCHAR), 4, '0') AS topic_id, doc_id, coalesce(substr(names, 1, 60), chapter) AS title, chunk_ids FROM grouped LEFT JOIN named USING (doc_id, topic))"""

#: Cosines of questions and topics, spread over the topics' members.
TOPIC_SCORES = """
    centre AS (SELECT doc_id, topic, place, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id, topic)) AS value FROM (SELECT doc_id, topic, place, sum(value) AS v FROM members JOIN cv USING (chunk_id) GROUP BY ALL)),
    alike AS (SELECT query_id, doc_id, topic, sum(q.value * c.value) AS cosine FROM qv q JOIN centre c USING (place) GROUP BY ALL)"""

EXACT = rf"""
    tokens AS (SELECT query_id, list_distinct(regexp_extract_all({NORMAL.format('question')}, '\d+(?:\.\d+)?%?')) AS t FROM questions),
    wanted AS (SELECT query_id, len(t) AS of, unnest(t) AS token FROM tokens),
    exact AS (SELECT query_id, chunk_id, 0.18::DOUBLE AS score FROM wanted JOIN normals ON contains(normal, token) GROUP BY query_id, chunk_id HAVING count(*) = any_value(of))"""

#: The neighbours of the six best get 0.82 of their scores, if that is more.
BRIDGED = """
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS pos FROM summed QUALIFY pos <= 6),
    reached AS (SELECT query_id, n.chunk_id, score * 0.82::DOUBLE AS score FROM best JOIN chunks c USING (chunk_id) JOIN chunks n ON n.doc_id = c.doc_id AND abs(n.sequence - c.sequence) = 1),
    total AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT query_id, chunk_id, score FROM summed UNION ALL SELECT * FROM reached) GROUP BY ALL)"""

MARKERS = ["分别", "比较", "原因", "条件", "步骤", "影响", "以及", "同时"]


def _most(budget: str) -> str:
    """How many passages a question gets, by its marks of complexity."""
    marks = " + ".join(f"contains(question, '{m}')::BIGINT" for m in MARKERS)
    return f"CAST(least({budget}, 3 + least(3, {marks} + greatest(0, len(regexp_extract_all(question, '[？?；;]')) - 1))) AS BIGINT)"


def _profile(keyword: bool = True, graph: bool = True, topic: bool = False, full: bool = False) -> str:
    parts = [_chunks(), QUESTIONS, _dense()]
    sums = ["SELECT query_id, chunk_id, 0.7::DOUBLE * vector_score AS score FROM near"]
    if keyword:
        parts += [QUESTION_TERMS, KEYWORDS]
        sums.append("SELECT * FROM keyed")
    if graph:
        parts += [_concepts("chunks", "chunk_id", "clean_text"), EDGES, HITS]
        sums.append("SELECT query_id, chunk_id, least(0.2::DOUBLE, hits * 0.07::DOUBLE) FROM hits")
    if topic:
        parts += [TOPICS, TOPIC_SCORES]
        sums.append("SELECT query_id, chunk_id, 0.08::DOUBLE * greatest(0, cosine) FROM alike JOIN members USING (doc_id, topic)")
    if full:
        parts.append(EXACT)
        sums.append("SELECT * FROM exact")
    parts.append(f"summed AS (SELECT query_id, chunk_id, sum(score) AS score FROM ({' UNION ALL '.join(sums)}) GROUP BY ALL)")
    parts.append(BRIDGED if full else "total AS (SELECT * FROM summed)")
    parts.append("ranked AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM total QUALIFY rank <= 6)")
    parts.append(f"most AS (SELECT query_id, {_most('6') if full else '6'} AS most FROM questions)")
    return f"{_with(*parts).replace('WITH', 'WITH RECURSIVE', 1)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ranked JOIN most USING (query_id) WHERE rank <= most"


JUDGED = f"""{LEXICAL},
    rankings AS (SELECT query_id, doc_id, min(lexical_rank) AS rank FROM lex JOIN chunks USING (chunk_id) GROUP BY ALL),
    relevance AS (SELECT query_id, doc_id FROM questions JOIN documents ON contains(text, question))"""


def _metrics(k: int, extra: str = "") -> str:
    return f"""
    top{k} AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS pos FROM rankings {extra} QUALIFY pos <= {k}),
    ideal{k} AS (
        SELECT query_id, max(pos) AS positives, sum(1 / log2(pos + 1)) FILTER (WHERE pos <= {k}) AS ideal
        FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS pos FROM relevance) GROUP BY query_id
    ),
    hit{k} AS (SELECT query_id, count(*) AS hits, min(pos) AS first, sum(1 / log2(pos + 1)) AS dcg FROM top{k} JOIN relevance USING (query_id, doc_id) GROUP BY query_id),
    m{k} AS (
        SELECT query_id, coalesce(hits / positives, 0) AS recall, coalesce(1 / first, 0) AS mrr, coalesce(dcg / ideal, 0) AS ndcg
        FROM ideal{k} LEFT JOIN hit{k} USING (query_id)
    )"""


STRUCTURED = """
    structured AS (
        SELECT doc_id, k, max(k) OVER (PARTITION BY doc_id) AS sections
        FROM (SELECT source || '-' || CAST(doc_id // 50 AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY source, doc_id // 50 ORDER BY doc_id) AS k FROM documents)
    )"""

#: CTEs that end in parsed: the chunks of the structured documents, a section a text, by the rules of lines, sentences and windows.
PARSED = rf"""
    bodies AS (
        SELECT doc, k, greatest(k - 1, 1) AS label, '# Section ' || greatest(k - 1, 1) || chr(10) || chr(10) || text || chr(10) || chr(10) || 'See section ' || (k % 3 + 1) || '. See clause 99.' || chr(10) || chr(10) AS body
        FROM (SELECT source || '-' || CAST(doc_id // 50 AS VARCHAR) AS doc, row_number() OVER (PARTITION BY source, doc_id // 50 ORDER BY doc_id) AS k, text FROM documents)
    ),
    placed AS (
        SELECT *, CAST(sum(length(body)) OVER w AS BIGINT) - length(body) AS begins, CAST(sum(length(body) - length(replace(body, chr(10), ''))) OVER w AS BIGINT) - (length(body) - length(replace(body, chr(10), ''))) AS above
        FROM bodies WINDOW w AS (PARTITION BY doc ORDER BY k)
    ),
    numbered AS (SELECT doc, k, begins, unnest(x) AS said, unnest(range(len(x))) AS i FROM (SELECT doc, k, begins, string_split(body, chr(10)) AS x FROM placed)),
    laid AS (SELECT doc, k, said, begins + CAST(sum(length(said) + 1) OVER (PARTITION BY doc, k ORDER BY i) AS BIGINT) - length(said) - 1 AS spot FROM numbered),
    tight AS (SELECT doc, k, spot + length(said) - length(regexp_replace(said, '^\s+', '')) AS a, {STRIP.format('said')} AS said FROM laid WHERE {STRIP.format('said')} <> ''),
    cut AS (
        SELECT doc, k, a, CASE WHEN length(said) <= 800 THEN [said]
               ELSE string_split(regexp_replace(regexp_replace(said, '([。！？!?；;]+["''”’）)]*)', '\1' || chr(1), 'g'), '\.(\s)', '.' || chr(1) || '\1', 'g'), chr(1)) END AS parts
        FROM tight
    ),
    dealt AS (SELECT doc, k, a, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM cut),
    sentences AS (SELECT doc, k, a + CAST(sum(length(part)) OVER (PARTITION BY doc, k, a ORDER BY i) AS BIGINT) - length(regexp_replace(part, '^\s+', '')) AS a, {STRIP.format('part')} AS said FROM dealt),
    windows AS (SELECT doc, k, a, length(said) AS size, unnest(range(0, length(said), 800)) AS x FROM sentences WHERE said <> ''),
    pieces AS (
        SELECT doc, k, a + x AS first, a + least(x + 800, size) AS last, size > 800 AS part, row_number() OVER (PARTITION BY doc, k ORDER BY a + x) AS n FROM windows
    ),
    steps AS (
        SELECT p.doc, p.k, p.n, any_value(p.first) AS first, any_value(p.part) AS part, CASE WHEN any_value(p.part) THEN p.n + 1 ELSE coalesce(min(q.n), any_value(p.most) + 1) END AS beyond
        FROM (SELECT *, max(n) OVER (PARTITION BY doc, k) AS most FROM pieces) p LEFT JOIN pieces q ON p.doc = q.doc AND p.k = q.k AND q.n > p.n AND (q.part OR q.last > p.first + 800)
        GROUP BY p.doc, p.k, p.n
    ),
    walked AS (
        SELECT doc, k, n, first, part, beyond FROM steps WHERE n = 1
        UNION ALL SELECT s.doc, s.k, s.n, s.first, s.part, s.beyond FROM walked w JOIN steps s ON s.doc = w.doc AND s.k = w.k AND s.n = w.beyond
    ),
    spans AS (SELECT w.doc, w.k, w.first, p.last, w.part, row_number() OVER (PARTITION BY w.doc ORDER BY w.first) - 1 AS sequence FROM walked w JOIN pieces p ON p.doc = w.doc AND p.k = w.k AND p.n = w.beyond - 1),
    parsed AS (
        SELECT doc AS doc_id, k, label, sequence, doc || '::chunk_' || lpad(CAST(sequence AS VARCHAR), 6, '0') AS chunk_id, doc || '::section_' || begins AS section_id, first, last, part,
               'lines ' || (1 + above + length(regexp_replace(substr(body, 1, first - begins), '[^\n]', '', 'g'))) || '-' || (1 + above + length(regexp_replace(substr(body, 1, last - 1 - begins), '[^\n]', '', 'g'))) AS locator,
               substr(body, first - begins + 1, last - first) AS said
        FROM spans JOIN placed USING (doc, k)
    )"""

#: CTEs over parsed that end in links.
LINKS = """
    held AS (SELECT doc_id, label, k, list(chunk_id ORDER BY sequence) AS ids FROM parsed GROUP BY doc_id, label, k),
    labels AS (SELECT doc_id, CAST(label AS VARCHAR) AS number, count(*) AS sections, any_value(ids) AS ids FROM held GROUP BY doc_id, label),
    told AS (
        SELECT doc AS doc_id, 'section' AS unit, CAST(k % 3 + 1 AS VARCHAR) AS number, begins + length(body) - length(k % 3 + 1 || '. See clause 99.' || chr(10) || chr(10)) - 8 AS spot FROM placed
        UNION ALL SELECT doc, 'clause', '99', begins + length(body) - 12 FROM placed
    ),
    found AS (SELECT t.doc_id, unit, t.number, spot, coalesce(sections, 0) AS sections, CASE WHEN sections = 1 AND unit = 'section' THEN ids ELSE [] END AS targets FROM told t LEFT JOIN labels l ON l.doc_id = t.doc_id AND l.number = t.number AND unit = 'section'),
    beside AS (SELECT a.doc_id, a.chunk_id AS a, b.chunk_id AS b FROM parsed a JOIN parsed b ON a.section_id = b.section_id AND b.sequence = a.sequence + 1),
    links AS (
        SELECT doc_id, chunk_id AS source_id, section_id AS target_id, 'section_member' AS kind, locator AS basis, 'resolved' AS status, first AS source_start, last AS source_end, '' AS target_ids FROM parsed
        UNION ALL SELECT doc_id, a, b, 'adjacent', 'consecutive chunks in same section', 'resolved', 0, 0, '' FROM beside
        UNION ALL SELECT doc_id, b, a, 'adjacent', 'consecutive chunks in same section', 'resolved', 0, 0, '' FROM beside
        UNION ALL SELECT f.doc_id, p.chunk_id, targets[1], 'explicit_reference', unit || ' ' || number, CASE sections WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END, spot, spot + length(unit) + 1 + length(number), array_to_string(targets, ',')
            FROM found f ASOF JOIN parsed p ON f.doc_id = p.doc_id AND f.spot >= p.first
    )"""

CATALOGUE = """
    known AS (
        SELECT doc_id, CASE WHEN n % 9 = 4 THEN 'same' ELSE 'name-' || n END AS name, '/data/' || doc_id AS path, CASE WHEN n = 2 THEN 'building' ELSE 'complete' END AS state
        FROM (SELECT DISTINCT source AS doc_id, CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS n FROM documents)
    )"""

SCOPED = """
    asked AS (
        SELECT doc_id AS query_id, CASE doc_id % 8 WHEN 0 THEN source WHEN 1 THEN 'name-' || n WHEN 2 THEN 'same' WHEN 3 THEN '/data/' || source WHEN 4 THEN 'src' WHEN 5 THEN 'nothing ' || n WHEN 6 THEN 'ta/src' || n END AS scope
        FROM (SELECT doc_id, source, regexp_extract(source, '([0-9]+)', 1) AS n FROM documents)
    )"""

SPLITS = """
    rows AS (SELECT d.doc_id, text, source, quality FROM documents d JOIN labels USING (doc_id)),
    q AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS question, CASE WHEN doc_id % 3 = 0 THEN 'test' WHEN doc_id % 11 = 5 THEN 'other' ELSE 'dev' END AS split FROM rows),
    r AS (SELECT CAST(doc_id AS VARCHAR) AS query_id, source AS doc_id, quality * CASE WHEN doc_id % 13 = 1 THEN 9 ELSE 2 END AS grade FROM rows),
    dd AS (SELECT DISTINCT source AS id, CASE WHEN source = 'src3' THEN ' ' ELSE 'x' END AS text FROM rows WHERE source <> 'src5')"""

COVERAGE = """
    o AS (SELECT o_custkey AS query_id, o_orderkey AS k FROM orders),
    lists AS (
        SELECT query_id,
               list_distinct(list(k % 50) FILTER (WHERE k % 2 = 0)) AS unordered,
               list_sort(list(k % 50) FILTER (WHERE k % 2 = 0)) AS docs,
               list(DISTINCT k % 50) FILTER (WHERE k % 3 = 0) AS rel,
               list(DISTINCT k % 20) FILTER (WHERE k % 5 = 0) AS core,
               list(DISTINCT k % 20) FILTER (WHERE k % 5 = 1) AS supp,
               list(DISTINCT k % 20) FILTER (WHERE k % 4 = 1) AS expl,
               list(DISTINCT k % 20) FILTER (WHERE k % 4 = 2) AS targ,
               query_id % 2 = 0 AS exhaustive
        FROM o GROUP BY query_id
    ),
    filled AS (SELECT query_id, exhaustive, coalesce(docs, []) AS docs, coalesce(rel, []) AS rel, coalesce(core, []) AS core, coalesce(supp, []) AS supp, coalesce(expl, []) AS expl, coalesce(targ, []) AS targ FROM lists),
    ranked AS (SELECT query_id, exhaustive, list_sort(list_distinct(docs)) AS docs, rel, core, supp, expl, targ FROM filled),
    per AS (
        SELECT CASE WHEN len(rel) > 0 THEN len(list_intersect(docs, rel)) / len(rel) END AS source_recall,
               CASE WHEN len(rel) > 0 THEN coalesce(1 / list_min(list_filter(list_transform(docs, lambda d, i: CASE WHEN list_contains(rel, d) THEN i END), lambda x: x IS NOT NULL)), 0) END AS source_mrr,
               CASE WHEN len(targ) > 0 THEN len(list_intersect(targ, list_concat(core, supp))) / len(targ) END AS reference_coverage,
               CASE WHEN len(targ) > 0 THEN len(list_intersect(targ, core)) / len(targ) END AS reference_core_coverage,
               CASE WHEN len(targ) > 0 THEN len(list_intersect(targ, supp)) / len(targ) END AS reference_supplement_coverage,
               CASE WHEN exhaustive THEN len(expl) - len(list_intersect(expl, targ)) ELSE 0 END AS wrong,
               CASE WHEN exhaustive THEN len(expl) ELSE 0 END AS checked
        FROM ranked
    ),
    long AS (
        SELECT 'source_recall' AS metric, sum(source_recall) AS x, count(source_recall) AS d FROM per
        UNION ALL SELECT 'source_mrr', sum(source_mrr), count(source_mrr) FROM per
        UNION ALL SELECT 'reference_coverage', sum(reference_coverage), count(reference_coverage) FROM per
        UNION ALL SELECT 'reference_core_coverage', sum(reference_core_coverage), count(reference_core_coverage) FROM per
        UNION ALL SELECT 'reference_supplement_coverage', sum(reference_supplement_coverage), count(reference_supplement_coverage) FROM per
        UNION ALL SELECT 'false_reference_expansion', sum(wrong), CAST(sum(checked) AS BIGINT) FROM per
    )"""

ORACLES: dict[str, str] = {
    "hybrid_retrieve": f"{HYBRID} SELECT query_id, chunk_id, round(fusion_score, 9) AS score, fusion_rank FROM trace WHERE fusion_rank <= 6",
    "candidate_trace": f"""{HYBRID} SELECT query_id, chunk_id, vector_rank, round(vector_score, 6) AS vector_score, lexical_rank, round(lexical_score, 6) AS lexical_score,
        fusion_rank, round(fusion_score, 9) AS fusion_score, CASE WHEN fusion_rank > 40 THEN 'fusion_cap' END AS omission_reason FROM trace""",
    "candidate_counts": f"""{HYBRID} SELECT query_id, count(vector_rank) AS vector_candidates, count(lexical_rank) AS lexical_candidates, count(*) AS fused_candidates,
        count(*) FILTER (WHERE fusion_rank <= 40) AS pool, count(*) FILTER (WHERE vector_rank IS NOT NULL AND lexical_rank IS NOT NULL) AS in_both FROM trace GROUP BY query_id""",
    "rerank": f"""{HYBRID},
        scored2 AS (SELECT t.*, CASE WHEN fusion_rank <= 40 AND length(clean_text) >= 400 THEN CAST(length(clean_text) AS DOUBLE) END AS rerank_score FROM trace t JOIN chunks USING (chunk_id))
        SELECT query_id, chunk_id, fusion_rank, rerank_score,
               CASE WHEN rerank_score IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, fusion_rank, chunk_id) END AS final_rank,
               CASE WHEN fusion_rank > 40 THEN 'fusion_cap' WHEN rerank_score IS NULL THEN 'reranker_omitted' END AS omission_reason
        FROM scored2""",
    "chunk_split_text": f"""{_with(_chunks())} SELECT doc_id, sequence, chunk_id, md5(clean_text) AS clean_md5,
        md5(coalesce(right(lag(clean_text) OVER (PARTITION BY doc_id ORDER BY sequence), 100) || chr(10), '') || clean_text) AS context_md5 FROM chunks""",
    "chunk_paragraphs": f"""{_with(_chunks("replace(text, chr(10), chr(10) || chr(10))"))} SELECT doc_id, sequence, clean_text,
        length(coalesce(right(lag(clean_text) OVER (PARTITION BY doc_id ORDER BY sequence), 100) || chr(10), '') || clean_text) AS context_length FROM chunks""",
    "chapter_guess": f"""{_with(_chunks())}, l AS (SELECT chunk_id, trim(string_split(clean_text, chr(10))[1], ' #：:') AS line FROM chunks)
        SELECT chunk_id, CASE WHEN length(line) BETWEEN 2 AND 30 THEN line ELSE '未分类' END AS chapter FROM l""",
    "normalize_evidence": f"SELECT doc_id, md5({NORMAL.format('text')}) AS normal_md5, length({NORMAL.format('text')}) AS size FROM documents",
    "lexical_terms_tf": f"{_with(_terms('documents', 'doc_id', 'text', 'postings'))} SELECT doc_id, term, tf, CAST(dl AS BIGINT) AS dl FROM postings",
    "lexical_terms_han": rf"""WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(lower(translate(text, '{LATIN}', '{HAN}')), '[\x{{4e00}}-\x{{9fff}}]+|[a-z0-9_-]+')) AS run FROM documents),
        terms AS (
            SELECT doc_id, unnest(CASE WHEN regexp_matches(run, '^[a-z0-9_-]') THEN CASE WHEN regexp_matches(run, '[a-z0-9]') THEN [run] ELSE [] END
                         WHEN length(run) = 1 THEN [run] ELSE list_transform(range(1, length(run)), lambda k: substr(run, k, 2)) END) AS term FROM runs
        ),
        counted AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL)
        SELECT doc_id, term, tf, CAST(sum(tf) OVER (PARTITION BY doc_id) AS BIGINT) AS dl FROM counted""",
    "term_encoding": f"{_with(_terms('documents', 'doc_id', 'text', 'postings'))} SELECT DISTINCT term, 't' || lower(hex(encode(term))) AS encoded FROM postings",
    "match_literals": rf"""SELECT item_id AS query_id, array_to_string(list_transform(t, lambda x: '"t' || lower(hex(encode(x))) || '"'), ' OR ') AS literals
        FROM (SELECT item_id, list_filter(x, lambda v, i: list_position(x, v) = i AND regexp_matches(v, '[a-z0-9]')) AS t
              FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_-]+') AS x FROM benchmark))""",
    "doc_ids": r"""WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages),
        n AS (SELECT *, regexp_extract(p, '([^/]*)$', 1) AS name FROM u),
        s AS (SELECT *, substr(regexp_replace(regexp_replace(CASE WHEN regexp_matches(name, '^\.+[^.]*$') THEN name ELSE regexp_replace(name, '\.[^.]*$', '') END, '\W+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 30) AS safe FROM n)
        SELECT page_id, CASE WHEN safe = '' THEN 'document' ELSE safe END || '_' || substr(md5(p), 1, 12) AS id FROM s""",
    "deterministic_embedding": f"{_with(_vectors('documents', 'doc_id', 'text', 'v'))} SELECT doc_id, place, round(value, 6) AS value FROM v WHERE value <> 0",
    "dense_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
        SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e), 6) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, v.e), 9) DESC, v.vec_id) AS vector_rank
        FROM v q, v WHERE q.vec_id % 20 = 0 QUALIFY vector_rank <= 40""",
    "bm25_topk": f"{LEXICAL} SELECT query_id, chunk_id, round(bm25, 6) AS bm25, lexical_rank FROM lex",
    "bm25_scoped": f"""{_with(_chunks(), QUESTIONS, _bm25("JOIN chunks USING (chunk_id) WHERE query_id % 2 = 1 OR doc_id = query_id"))}
        SELECT query_id, chunk_id, round(bm25, 6) AS bm25, lexical_rank FROM lex""",
    "rrf_fusion": """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        near AS (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, v.e), 9) DESC, v.vec_id) AS near_rank FROM v q, v WHERE q.vec_id % 20 = 0 QUALIFY near_rank <= 10),
        alike AS (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY v.vec_id) AS alike_rank FROM v q JOIN v USING (label) WHERE q.vec_id % 20 = 0 QUALIFY alike_rank <= 10),
        f AS (SELECT query_id, vec_id, near_rank, alike_rank, coalesce(1.0::DOUBLE / (60 + near_rank), 0) + coalesce(1.0::DOUBLE / (60 + alike_rank), 0) AS s FROM near FULL JOIN alike USING (query_id, vec_id))
        SELECT query_id, vec_id, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS fusion_rank, near_rank, alike_rank FROM f""",
    "extract_concepts": f"{_with(_concepts('documents', 'doc_id', 'text'))} SELECT doc_id, concept, n, place FROM concepts",
    "concept_edges": f"{_with(_chunks(), _concepts('chunks', 'chunk_id', 'clean_text'), EDGES)} SELECT source, target, weight FROM edges",
    "concept_graph_expand": f"{_with(_chunks(), QUESTIONS, _concepts('chunks', 'chunk_id', 'clean_text'), EDGES, QUESTION_TERMS, HITS)} SELECT query_id, chunk_id, hits FROM hits",
    "keyword_score": f"{_with(_chunks(), QUESTIONS, QUESTION_TERMS, KEYWORDS)} SELECT query_id, chunk_id, round(score, 6) AS score FROM keyed",
    "exact_number_guard": rf"""{_with(_chunks())},
        asked AS (SELECT doc_id AS query_id, substr(text, 1, 300) AS question FROM documents WHERE regexp_matches(substr(text, 1, 300), '[0-9]')),
        tokens AS (SELECT query_id, list_distinct(regexp_extract_all({NORMAL.format('question')}, '\d+(?:\.\d+)?%?')) AS t FROM asked),
        normals AS (SELECT chunk_id, {NORMAL.format('clean_text')} AS normal FROM chunks),
        numbered AS (SELECT * FROM normals WHERE regexp_matches(normal, '[0-9]')),
        wanted AS (SELECT query_id, len(t) AS n, unnest(t) AS token FROM tokens),
        held AS (SELECT token, chunk_id FROM (SELECT DISTINCT token FROM wanted) JOIN numbered ON contains(normal, token))
        SELECT query_id, chunk_id, 0.18::DOUBLE AS score FROM wanted JOIN held USING (token) GROUP BY query_id, chunk_id HAVING count(*) = any_value(n)""",
    "bridge_neighbours": f"""{LEXICAL}, s AS (SELECT query_id, chunk_id, -bm25 AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(-bm25, 12) DESC, chunk_id) AS pos FROM lex),
        reached AS (
            SELECT query_id, n.chunk_id, score * 0.82::DOUBLE AS score
            FROM s JOIN chunks c USING (chunk_id) JOIN chunks n ON n.doc_id = c.doc_id AND abs(n.sequence - c.sequence) = 1 WHERE pos <= 6
        )
        SELECT query_id, chunk_id, round(max(score), 6) AS score FROM (SELECT query_id, chunk_id, score FROM s UNION ALL SELECT * FROM reached) GROUP BY ALL""",
    "dynamic_limit": rf"""WITH q AS (
            SELECT doc_id, doc_id % 7 + 1 AS budget,
                   CASE WHEN doc_id % 3 = 1 THEN '原因' ELSE '' END || translate(text, ',:', '；?') || CASE WHEN doc_id % 3 = 0 THEN '分别比较' ELSE '' END AS question
            FROM documents
        )
        SELECT doc_id, budget, {_most('budget')} AS most FROM q""",
    "profile_vector": _profile(False, False),
    "profile_vector_keyword": _profile(True, False),
    "profile_vector_graph": _profile(True, True),
    "profile_vector_topic_graph": _profile(topic=True),
    "profile_full": _profile(topic=True, full=True),
    "topic_clusters": f"""{_with(_chunks(), _vectors('chunks', 'chunk_id', 'clean_text', 'cv'), TOPICS, _concepts('chunks', 'chunk_id', 'clean_text'), CHAPTERS, NAMED).replace('WITH', 'WITH RECURSIVE', 1)}
        SELECT topic_id, doc_id, title, chunk_ids FROM clusters""",
    "topic_centroids": """WITH e AS (SELECT label, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS place FROM embeddings),
        m AS (SELECT label, place, avg(v) AS v FROM e GROUP BY ALL)
        SELECT CAST(label AS BIGINT) AS label, CAST(place AS BIGINT) AS place, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS value FROM m""",
    "legacy_context": f"""{LEXICAL}, c AS (SELECT *, coalesce(right(lag(clean_text) OVER (PARTITION BY doc_id ORDER BY sequence), 100) || chr(10), '') || clean_text AS context_text FROM chunks),
        t AS (SELECT query_id, lexical_rank AS rank, chunk_id, '[S' || lexical_rank || '] 文档=' || doc_id || ' 片段=' || chunk_id || chr(10) || context_text AS block FROM lex JOIN c USING (chunk_id) WHERE lexical_rank <= 6),
        g AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM t GROUP BY query_id)
        SELECT query_id, chunk_ids, md5(context) AS context_md5, length(context) AS size FROM g""",
    "structure_chunks": f"""WITH RECURSIVE {PARSED} SELECT chunk_id, doc_id, sequence, section_id, 'Section ' || label AS path, locator, first AS source_start, last AS source_end, part AS partial, md5(said) AS text_md5 FROM parsed""",
    "structure_links": f"WITH RECURSIVE {PARSED}, {LINKS} SELECT * FROM links",
    "adjacent_links": f"""{_with(_chunks())}, p AS (SELECT a.chunk_id AS a, b.chunk_id AS b FROM chunks a JOIN chunks b ON a.doc_id = b.doc_id AND b.sequence = a.sequence + 1 AND a.sequence // 3 = b.sequence // 3)
        SELECT a AS source_id, b AS target_id, 'adjacent' AS kind FROM p UNION ALL SELECT b, a, 'adjacent' FROM p""",
    "reference_resolution": f"""{_with(STRUCTURED)}, asked AS (
            SELECT doc_id, CASE WHEN k % 3 + 1 = 1 THEN CASE WHEN sections >= 2 THEN 'ambiguous' ELSE 'resolved' END WHEN k % 3 + 1 <= sections - 1 THEN 'resolved' ELSE 'missing' END AS status FROM structured
            UNION ALL SELECT doc_id, 'missing' FROM structured
        )
        SELECT doc_id, status, count(*) AS n FROM asked GROUP BY ALL""",
    "interval_merge": """WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey % 1000 AS start, l_partkey % 1000 + 50 + l_linenumber * 20 AS stop FROM lineitem),
        r AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
        g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, stop, n) AS island FROM r)
        SELECT doc_id, min(start) AS start, max(stop) AS stop, count(*) AS members FROM g GROUP BY doc_id, island""",
    "offset_to_chunk": f"""{_with(_chunks())}, l AS (SELECT doc_id, unnest(x) AS said, unnest(range(len(x))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
        p AS (SELECT doc_id, line, CAST(floor(sum(length(said) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(said) / 2) AS BIGINT) AS place FROM l)
        SELECT p.doc_id, CAST(line AS BIGINT) AS line, place, chunk_id AS owner
        FROM p ASOF LEFT JOIN (SELECT doc_id, CAST(sequence AS BIGINT) * 800 AS begins, chunk_id FROM chunks) c ON p.doc_id = c.doc_id AND p.place >= c.begins""",
    "ranking_metrics": f"{JUDGED}, {_metrics(10)} SELECT query_id, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM m10",
    "summary_metrics": f"""{JUDGED}, runs AS (SELECT query_id, length(question) / 100.0::DOUBLE AS seconds, query_id % 7 = 3 AS failed FROM questions),
        {_metrics(5, "WHERE query_id % 7 <> 3")}, {_metrics(10, "WHERE query_id % 7 <> 3")}
        SELECT {', '.join(f"round(avg(coalesce(m{k}.{m}, 0)), 6) AS {m}_at_{k}" for k in (5, 10) for m in ("recall", "mrr", "ndcg"))},
               count(*) AS queries, count(*) FILTER (WHERE failed) AS failed_queries,
               round(quantile_cont(seconds, 0.5), 6) AS p50_seconds, round(quantile_cont(seconds, 0.95), 6) AS p95_seconds,
               round(quantile_cont(seconds, 0.5) FILTER (WHERE NOT failed), 6) AS successful_p50_seconds, round(quantile_cont(seconds, 0.95) FILTER (WHERE NOT failed), 6) AS successful_p95_seconds,
               round(count(*) FILTER (WHERE NOT failed) / sum(seconds), 6) AS serial_successful_queries_per_second
        FROM runs LEFT JOIN m5 USING (query_id) LEFT JOIN m10 USING (query_id)""",
    "latency_percentiles": """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(median(value), 6) AS median, count(*) AS n FROM events GROUP BY event_type""",
    "output_means": f"""{LEXICAL}, c AS (SELECT *, coalesce(right(lag(clean_text) OVER (PARTITION BY doc_id ORDER BY sequence), 100) || chr(10), '') || clean_text AS context_text FROM chunks),
        t AS (SELECT query_id, lexical_rank AS rank, chunk_id, '[S' || lexical_rank || '] 文档=' || doc_id || ' 片段=' || chunk_id || chr(10) || context_text AS block FROM lex JOIN c USING (chunk_id) WHERE lexical_rank <= 6),
        g AS (SELECT query_id, count(*) AS n, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM t GROUP BY query_id),
        s AS (SELECT coalesce(n, 0) AS n, coalesce(length(context), 0) AS size,
                     coalesce(len(list_filter(regexp_extract_all(lower(context), '[a-z0-9_-]+'), lambda x: regexp_matches(x, '[a-z0-9]'))) + 2 * n, 0) AS tokens FROM questions LEFT JOIN g USING (query_id))
        SELECT round(avg(n), 6) AS mean_returned_chunks, round(avg(size), 6) AS mean_returned_context_characters, round(avg(tokens), 6) AS mean_returned_context_tokens FROM s""",
    "stage_medians": "SELECT event_type AS stage, round(median(value), 6) AS median_seconds FROM events GROUP BY event_type",
    "coverage_metrics": f"{_with(COVERAGE)} SELECT metric, CASE WHEN d > 0 THEN round(x / d, 6) END AS value, CAST(d AS BIGINT) AS denominator, CASE WHEN d > 0 THEN 'available' ELSE 'unavailable' END AS status FROM long",
    "evidence_recall": f"""{LEXICAL}, normals AS (SELECT query_id, lexical_rank AS rank, {NORMAL.format('clean_text')} AS normal FROM lex JOIN chunks USING (chunk_id) WHERE lexical_rank <= 10),
        points AS (SELECT DISTINCT query_id, {NORMAL.format('p')} AS point FROM (SELECT query_id, unnest(string_split(question, '. ')) AS p FROM questions)),
        hit AS (SELECT query_id, point, min(rank) AS rank FROM points JOIN normals USING (query_id) WHERE contains(normal, point) GROUP BY ALL)
        SELECT query_id, count(*) AS points, count(rank) AS found, round(coalesce(1 / min(rank), 0), 6) AS reciprocal_rank FROM points LEFT JOIN hit USING (query_id, point) GROUP BY query_id""",
    "dedupe_sources": f"""SELECT min(doc_id) AS first, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS sources, md5(t) AS text_md5 FROM (SELECT doc_id, {TRIM.format('text')} AS t FROM documents) WHERE t <> '' GROUP BY t""",
    "complete_groups": "SELECT source, count(DISTINCT lang) AS kinds FROM documents GROUP BY source HAVING count(DISTINCT lang) = 4",
    "split_leakage": f"""{_with(SPLITS)} SELECT doc_id FROM r JOIN q ON query_id = id WHERE grade > 0 AND split = 'dev' INTERSECT SELECT doc_id FROM r JOIN q ON query_id = id WHERE grade > 0 AND split = 'test'""",
    "validate_dataset": f"""{_with(SPLITS)}, v AS (
            SELECT 'duplicate document id' AS rule, id FROM dd GROUP BY id HAVING count(*) > 1
            UNION ALL SELECT 'empty document text', id FROM dd WHERE {TRIM.format('text')} = ''
            UNION ALL SELECT 'duplicate query id', id FROM q GROUP BY id HAVING count(*) > 1
            UNION ALL SELECT 'empty question', id FROM q WHERE {TRIM.format('question')} = ''
            UNION ALL SELECT 'unknown split', id FROM q WHERE split NOT IN ('dev', 'test')
            UNION ALL SELECT 'grade out of range', query_id FROM r WHERE grade NOT BETWEEN 0 AND 4
            UNION ALL SELECT 'unknown document', doc_id FROM (SELECT DISTINCT doc_id FROM r) WHERE doc_id NOT IN (SELECT id FROM dd)
            UNION ALL SELECT 'document crosses splits', doc_id FROM r JOIN q ON query_id = id WHERE grade > 0 GROUP BY doc_id HAVING count(DISTINCT split) > 1
            UNION ALL SELECT 'no positive document', id FROM q WHERE id NOT IN (SELECT query_id FROM r WHERE grade > 0)
        ) SELECT rule, count(*) AS n, min(id) AS least FROM v GROUP BY rule""",
    "scope_resolution": f"""{_with(CATALOGUE, SCOPED)},
        b AS (SELECT query_id, max(doc_id) FILTER (WHERE scope = doc_id) AS exact, count(*) AS n, min(doc_id) AS least FROM asked JOIN known ON scope = doc_id OR scope = name OR scope = path GROUP BY query_id),
        f AS (SELECT a.query_id, scope, n, coalesce(exact, CASE WHEN n = 1 THEN least END) AS doc_id FROM asked a LEFT JOIN b USING (query_id))
        SELECT query_id, doc_id, CASE WHEN scope IS NULL THEN 'all' WHEN n IS NULL THEN 'unknown' WHEN doc_id IS NULL THEN 'ambiguous' WHEN state <> 'complete' THEN 'incomplete' ELSE 'ok' END AS outcome
        FROM f LEFT JOIN known USING (doc_id)""",
    "scope_legacy": f"""{_with(CATALOGUE, SCOPED)},
        h AS (SELECT query_id, min(doc_id) AS hit FROM asked JOIN known ON contains(doc_id || ' ' || name || ' ' || path, scope) WHERE scope <> '' GROUP BY query_id)
        SELECT query_id, coalesce(hit, scope) AS resolved FROM asked LEFT JOIN h USING (query_id)""",
    "document_tree": f"""{_with(_chunks(), _concepts('chunks', 'chunk_id', 'clean_text'))},
        l AS (SELECT *, trim(string_split(clean_text, chr(10))[1], ' #：:') AS line FROM chunks),
        c AS (SELECT doc_id, CASE WHEN length(line) BETWEEN 2 AND 30 THEN line ELSE '未分类' END AS chapter, concept, min(sequence * 10 + place) AS pos FROM l JOIN concepts USING (chunk_id) GROUP BY ALL)
        SELECT doc_id, chapter, string_agg(concept, ',' ORDER BY pos, concept) AS concepts FROM c GROUP BY doc_id, chapter""",
    "incremental_ingest": f"{_with(_chunks())} SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(clean_text)) AS BIGINT) AS n_chars FROM chunks GROUP BY doc_id",
}

#: What the index of plans.stored holds in the end: changed documents with their note, without the removed ones.
CORPUS = f"""
    corpus AS (
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, '/data/' || doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN {' || chr(10) || '.join(f"'{line}'" for line in NOTE.split(chr(10)))} ELSE '' END || coalesce(text, '') AS text
        FROM documents WHERE doc_id % 10 <> 1
    )"""
KEPT = (CORPUS, _chunks().replace("FROM documents", "FROM corpus"), _concepts("chunks", "chunk_id", "clean_text"))

ORACLES |= {
    "index_chunks": f"""{_with(*KEPT, CHAPTERS)}, named AS (SELECT chunk_id, string_agg(concept, ',' ORDER BY place) AS concepts FROM concepts GROUP BY chunk_id)
        SELECT chunk_id, doc_id, sequence, chapter, coalesce(concepts, '') AS concepts, md5(clean_text) AS text_md5 FROM chunks JOIN chapters USING (chunk_id) LEFT JOIN named USING (chunk_id)""",
    "index_edges": f"{_with(*KEPT, EDGES)} SELECT source, target, weight FROM edges",
    "index_documents": f"""{_with(*KEPT, _terms('chunks', 'chunk_id', 'clean_text', 'postings'))}, counted AS (SELECT doc_id, count(*) AS c FROM chunks GROUP BY doc_id),
        whole AS (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT count(*) FROM postings_all) AS terms)
        SELECT doc_id, source AS name, path, coalesce(c, 0) AS processed_chunks, coalesce(c, 0) AS total_chunks, 'complete' AS state, n, round(terms / n, 6) AS avgdl FROM corpus LEFT JOIN counted USING (doc_id), whole""",
    "index_topics": f"""{_with(*KEPT[:2], _vectors('chunks', 'chunk_id', 'clean_text', 'cv'), TOPICS, KEPT[2], CHAPTERS, NAMED).replace('WITH', 'WITH RECURSIVE', 1)}
        SELECT topic_id, doc_id, title, chunk_ids FROM clusters WHERE CAST(doc_id AS BIGINT) % 3 = 2
        UNION ALL SELECT doc_id || '::whole', doc_id, 'whole', string_agg(chunk_id, ',' ORDER BY sequence) FROM chunks WHERE CAST(doc_id AS BIGINT) % 3 = 0 GROUP BY doc_id""",
    "index_retrieve": f"""{_with(*KEPT, QUESTIONS, _dense(), QUESTION_TERMS, KEYWORDS, EDGES, HITS)},
        scoped AS (SELECT query_id, min(doc_id) AS scope FROM questions LEFT JOIN corpus ON contains(doc_id || ' ' || source || ' ' || path, '/data/' || query_id) WHERE query_id % 2 = 0 GROUP BY query_id),
        allowed AS (SELECT query_id, chunk_id FROM questions, chunks WHERE query_id % 2 = 1 UNION ALL SELECT query_id, chunk_id FROM scoped JOIN chunks ON scope = doc_id),
        close AS (SELECT query_id, chunk_id, vector_score FROM near_all JOIN allowed USING (query_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(vector_score, 9) DESC, chunk_id) <= 40),
        parts AS (
            SELECT query_id, chunk_id, 0.7::DOUBLE * vector_score AS score FROM close
            UNION ALL SELECT query_id, chunk_id, score FROM keyed JOIN allowed USING (query_id, chunk_id)
            UNION ALL SELECT query_id, chunk_id, least(0.2::DOUBLE, hits * 0.07::DOUBLE) FROM hits JOIN allowed USING (query_id, chunk_id)
        ),
        total AS (SELECT query_id, chunk_id, sum(score) AS score FROM parts GROUP BY ALL)
        SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM total QUALIFY rank <= 6""",
    "index_resume": f"""WITH RECURSIVE {PARSED}, {LINKS},
        c AS (SELECT doc_id, count(*) AS n FROM parsed GROUP BY doc_id)
        SELECT doc_id, any_value(n) AS processed_chunks, any_value(n) AS total_chunks, 'complete' AS state,
               count(*) FILTER (WHERE kind = 'section_member') AS members, count(*) FILTER (WHERE kind = 'adjacent') AS neighbours, count(*) FILTER (WHERE kind = 'explicit_reference') AS references
        FROM c JOIN links USING (doc_id) GROUP BY doc_id""",
}
