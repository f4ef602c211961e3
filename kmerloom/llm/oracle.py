"""SQL of the queries of problems 1 to 9 that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from kmerloom.llm.visual_form import IGNORABLE, INVISIBLE, POINTS, visual_form

_USABLE = "u AS (SELECT seqid, min(kfreqs) AS f FROM kmer_seq WHERE len(kfreqs) = 64 AND NOT isnan(kfreqs[1]) AND seqid IS NOT NULL GROUP BY seqid)"

# Pairs of records by their sets of 12-mers of canonical codes.
_PAIRS = """s AS (SELECT record_id, hex(data) AS h, octet_length(data) AS n FROM seq_array WHERE data IS NOT NULL),
x AS (SELECT record_id, substr(h, CAST(2 * i + 1 AS BIGINT), 24) AS w FROM (SELECT record_id, h, unnest(range(0, n - 11)) AS i FROM s WHERE n >= 12)),
v AS (SELECT DISTINCT record_id, w FROM x WHERE regexp_full_match(w, '(0[0-3])+')),
n AS (SELECT record_id, count(*) AS n FROM v GROUP BY 1),
c AS (SELECT a.record_id AS a, b.record_id AS b, count(*) AS shared FROM v a JOIN v b ON a.w = b.w AND a.record_id < b.record_id GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n na ON na.record_id = a JOIN n nb ON nb.record_id = b WHERE 20 * shared >= 9 * (na.n + nb.n - shared))"""



def _mapped() -> tuple[str, str]:
    """Single characters that the consistent form changes into one other, and what they become."""
    plain = (chr(c) for a, b in POINTS for c in range(a, b) if c not in range(0xD800, 0xE000))
    pairs = [(ch, f) for ch in plain if ch not in INVISIBLE and len(f := visual_form(ch)) == 1 and f != ch]
    return "".join(a for a, _ in pairs).replace("'", "''"), "".join(b for _, b in pairs).replace("'", "''")


_FROM, _TO = _mapped()
_GONE = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in IGNORABLE)
# The consistent form of texts without kept joiners: single characters are translated, then all is composed.
_FORM = f"nfc_normalize(translate(regexp_replace(text, '[{_GONE}]', '', 'g'), '{_FROM}', '{_TO}'))"
# Words of a text, tags and entities being separators.
_WORDS = f"regexp_extract_all(lower(regexp_replace({_FORM}, '<[^<>\\n]*>|\\[[^\\[\\]\\n]*\\]|&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+')"


def _runs(key: str, source: str) -> str:
    return f"SELECT {key}, array_to_string(w[i:i + 7], ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {key}, {_WORDS} AS w FROM {source} WHERE text IS NOT NULL) WHERE len(w) >= 8)"


ORACLE_SQL: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE {_USABLE},
e AS (SELECT a.seqid AS a, b.seqid AS b FROM u a JOIN u b ON a.seqid <> b.seqid WHERE list_distance(a.f, b.f) <= 0.08),
r(a, b) AS (SELECT seqid, seqid FROM u UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS seqid, min(b) AS cluster_key, count(*) AS n FROM r GROUP BY 1)
SELECT seqid, cluster_key FROM k WHERE n >= 5""",
    "p3_found": f"WITH {_PAIRS} SELECT a AS record_id_a, b AS record_id_b FROM p",
    "p4_found": f"""WITH {_PAIRS},
t AS (SELECT record_id, batch_id FROM seq_array),
o AS (SELECT CASE WHEN ta.batch_id > tb.batch_id THEN a ELSE b END AS record_id FROM p JOIN t ta ON ta.record_id = a JOIN t tb ON tb.record_id = b WHERE ta.batch_id <> tb.batch_id),
d AS (SELECT record_id FROM seq_array WHERE batch_id > 0 AND record_id IN (SELECT record_id FROM n) AND substr(md5(data), 1, 16) IN (SELECT lower(seqid_to_hash) FROM zarr_store WHERE seqid_to_hash IS NOT NULL))
SELECT record_id FROM o UNION SELECT record_id FROM d""",
    "p5_found": f"""WITH {_USABLE}, q AS (SELECT DISTINCT seqid FROM knn_probe),
d AS (SELECT a.seqid AS a, b.seqid AS b, round(list_distance(a.f, b.f), 9) AS d FROM u a JOIN q ON q.seqid = a.seqid JOIN u b ON a.seqid <> b.seqid),
k AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d)
SELECT DISTINCT least(a, b) AS seqid_a, greatest(a, b) AS seqid_b FROM k WHERE r <= 10""",
    "p6_found": """
WITH v AS (SELECT DISTINCT seqid, kfreqs FROM kmer_seq WHERE len(kfreqs) = 4096 AND NOT isnan(kfreqs[1])),
u AS (SELECT seqid, min(kfreqs) AS kfreqs FROM v GROUP BY seqid),
t AS (SELECT CAST(i - 1 AS INTEGER) AS kmer_index, count(*) AS n FROM (SELECT unnest(kfreqs) AS f, unnest(range(1, 4097)) AS i FROM u) WHERE f <> 0 GROUP BY 1),
m AS (SELECT kmer_index, CASE WHEN 100 * n < 3 * (SELECT count(*) FROM u) THEN 'rare' WHEN 100 * n > 28 * (SELECT count(*) FROM u) THEN 'common' END AS mark FROM t)
SELECT kmer_index, mark FROM m WHERE mark IS NOT NULL
""",
    "p3_groups": f"""WITH RECURSIVE {_PAIRS.replace("SELECT a, b FROM c", "SELECT a, b, shared = na.n AND shared = nb.n AS same FROM c")},
e AS (SELECT a, b, same FROM p UNION ALL SELECT b, a, same FROM p),
r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a, least(a, min(CASE WHEN same THEN b END)) AS rep FROM e GROUP BY 1),
l AS (SELECT e.a, count(DISTINCT kb.rep) AS links FROM e JOIN k ka ON ka.a = e.a JOIN k kb ON kb.a = e.b WHERE ka.rep <> kb.rep GROUP BY 1)
SELECT r.a AS record_id, min(r.b) AS group_id, coalesce(max(links), 0) AS links FROM r LEFT JOIN l ON l.a = r.a GROUP BY 1""",
    # occurrences: frequencies times the least total of whole counts, tried as multiples of the least frequency
    "p6_terms": """
WITH v AS (SELECT seqid, min(kfreqs) AS f FROM kmer_seq WHERE len(kfreqs) = 4096 AND NOT isnan(kfreqs[1]) AND seqid IS NOT NULL GROUP BY seqid),
y AS (SELECT seqid, f, list_min(list_filter(f, lambda y: y > 0)) AS least FROM v),
z AS (SELECT seqid, list_transform(f, lambda x: x / least) AS f FROM y),
t AS (SELECT seqid, f, unnest(range(1, 65)) AS m FROM z),
g AS (SELECT seqid, min(m) AS m FROM t WHERE list_max(list_transform(f, lambda x: abs(x * m - round(x * m)))) < 1e-6 * list_max(f) * m GROUP BY 1),
c AS (SELECT CAST(i - 1 AS INTEGER) AS kmer_index, CAST(sum(round(x * m)) AS BIGINT) AS occurrences, count(*) AS records FROM (SELECT unnest(f) AS x, unnest(range(1, 4097)) AS i, m FROM z JOIN g USING (seqid)) WHERE x > 0 GROUP BY 1)
SELECT *, CASE WHEN 100 * records < 3 * (SELECT count(*) FROM v) THEN 'rare' WHEN 100 * records > 28 * (SELECT count(*) FROM v) THEN 'common' END AS mark FROM c
""",
    "p8_found": f"WITH d AS ({_runs('doc_id', 'documents')}), i AS ({_runs('item_id', 'eval_items')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)",
    "p9_form": f"SELECT doc_id, {_FORM} AS form FROM documents",
    "p9_found": f"""WITH f AS (SELECT doc_id, text, {_FORM} AS form FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text WHERE length(regexp_replace(a.form, '[\\s\\x00-\\x1f\\x7f-\\x9f]', '', 'g')) > 0""",
    "p7_round_trip": "SELECT true AS equal, count(*) AS documents FROM documents",
}
