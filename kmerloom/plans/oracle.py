"""SQL of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from kmerloom.functions.hashing import C1, C2, DEFAULT_SEED, F1, F2, MASK, N5

# Encoded data as pairs of hex digits; code c of a symbol is the pair 0c.
_S = "s AS (SELECT record_id, hex(data) AS h, octet_length(data) AS n FROM seq_array WHERE data IS NOT NULL)"


def _windows(k: int, source: str = _S, key: str = "record_id") -> str:
    """CTEs s, x, v: v has key and the digits of each valid window."""
    return f"""{source},
x AS (SELECT {key}, substr(h, CAST(2 * i + 1 AS BIGINT), {2 * k}) AS w FROM (SELECT {key}, h, unnest(range(0, n - {k} + 1)) AS i FROM s WHERE n >= {k})),
v AS (SELECT {key}, regexp_replace(w, '0(.)', '\\1', 'g') AS w FROM x WHERE regexp_full_match(w, '(0[0-3])+'))"""


def _number(k: int, text: str = "w") -> str:
    return "CAST(" + " + ".join(f"(ascii(substr({text}, {i + 1}, 1)) - 48) * {4 ** (k - 1 - i)}" for i in range(k)) + " AS BIGINT)"


def _counts(k: int) -> str:
    return f"WITH {_windows(k)} SELECT record_id, {_number(k)} AS kmer, count(*) AS n FROM v GROUP BY 1, 2"


_TEXT = """t AS (SELECT record_id, CASE WHEN n IS NULL THEN NULL WHEN n = 0 THEN '' ELSE
array_to_string(list_transform(range(0, n), lambda i: CASE substr(h, CAST(2 * i + 1 AS BIGINT), 2) WHEN '00' THEN 'T' WHEN '01' THEN 'C' WHEN '02' THEN 'A' WHEN '03' THEN 'G' ELSE 'N' END), '') END AS text
FROM (SELECT record_id, hex(data) AS h, octet_length(data) AS n FROM seq_array))"""

_BACK = "translate(reverse(w), '0123', '2301')"

# Stored sets: members with usable vectors, in long form.
_SETS = """u AS (SELECT seqid, min(kfreqs) AS f FROM kmer_seq WHERE len(kfreqs) = 64 AND NOT isnan(kfreqs[1]) AND seqid IS NOT NULL GROUP BY seqid),
e AS (SELECT set_id, unnest(seqids) AS name, unnest(range(0, len(seqids))) AS member FROM summed_records),
m AS (SELECT set_id, CAST(member AS INTEGER) AS member, name, f FROM e JOIN u ON e.name = u.seqid),
l AS (SELECT set_id, member, name, unnest(range(0, 64)) AS kmer, unnest(f) AS freq FROM m),
h AS (SELECT set_id, member, name, -sum(CASE WHEN freq > 0 THEN freq * log2(freq) ELSE 0 END) AS entropy FROM l GROUP BY ALL),
z AS (SELECT set_id, count(*) AS size, sum(entropy) AS sh FROM h GROUP BY 1),
s AS (SELECT set_id, kmer, sum(freq) AS total FROM l GROUP BY 1, 2),
d AS (SELECT s.set_id, size, sh, -sum(CASE WHEN total > 0 THEN total / size * log2(total / size) ELSE 0 END) - sh / size AS total_jsd FROM s JOIN z USING (set_id) GROUP BY 1, 2, 3),
o AS (SELECT l.set_id, l.member, -sum(CASE WHEN total - freq > 2.220446049250313e-16 THEN (total - freq) / (size - 1) * log2((total - freq) / (size - 1)) ELSE 0 END) AS rest FROM l JOIN s ON l.set_id = s.set_id AND l.kmer = s.kmer JOIN z ON z.set_id = l.set_id WHERE size > 1 GROUP BY 1, 2),
q AS (SELECT h.set_id, h.member, h.name, size, entropy, total_jsd - (rest - (sh - entropy) / (size - 1)) AS delta_jsd, total_jsd FROM h JOIN d USING (set_id) LEFT JOIN o ON o.set_id = h.set_id AND o.member = h.member),
low AS (SELECT set_id, arg_min(member, (round(delta_jsd, 12), member)) AS lowest FROM q GROUP BY 1)"""

_REPLACED = f"""{_SETS},
r AS (SELECT s.set_id, s.kmer, CASE WHEN total - freq > 2.220446049250313e-16 THEN total - freq ELSE 0 END AS rest FROM s JOIN low ON low.set_id = s.set_id JOIN l ON l.set_id = s.set_id AND l.kmer = s.kmer AND l.member = low.lowest),
rh AS (SELECT h.set_id, sum(CASE WHEN member <> lowest THEN entropy ELSE 0 END) AS rest_h FROM h JOIN low USING (set_id) GROUP BY 1),
c AS (SELECT l.set_id - 1 AS set_id, l.member, l.name, -sum(CASE WHEN rest + freq > 0 THEN (rest + freq) / size * log2((rest + freq) / size) ELSE 0 END) AS mixed FROM l JOIN r ON r.set_id = l.set_id - 1 AND r.kmer = l.kmer JOIN z ON z.set_id = l.set_id - 1 GROUP BY 1, 2, 3),
p AS (SELECT c.set_id, c.member, c.name, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.set_id = c.set_id AND m.name = c.name) THEN 0.0 ELSE mixed - (rest_h + entropy) / size END AS replaced_jsd
FROM c JOIN rh USING (set_id) JOIN z ON z.set_id = c.set_id JOIN h ON h.set_id = c.set_id + 1 AND h.member = c.member)"""

_MIX = [((c * C1 & MASK) << 15 | (c * C1 & MASK) >> 17) & MASK for c in range(4)]
_MIX = [x * C2 & MASK for x in _MIX]


def _hash(k: int, source: str, text: str = "w") -> str:
    """CTEs that hash the distinct digits of `source`: f has w and hash."""
    steps = [f"g0 AS (SELECT DISTINCT {text} AS w, CAST({DEFAULT_SEED ^ k} AS BIGINT) AS a FROM {source})"]
    for i in range(k):
        mix = f"CASE substr(w, {i + 1}, 1) WHEN '0' THEN {_MIX[0]} WHEN '1' THEN {_MIX[1]} WHEN '2' THEN {_MIX[2]} ELSE {_MIX[3]} END"
        steps.append(f"b{i} AS (SELECT w, xor(a, CAST({mix} AS BIGINT)) AS b FROM g{i})")
        steps.append(f"g{i + 1} AS (SELECT w, ((((b << 13) & {MASK}) | (b >> 19)) * 5 + {N5}) & {MASK} AS a FROM b{i})")
    steps.append(f"y1 AS (SELECT w, CAST((CAST(xor(a, a >> 16) AS HUGEINT) * {F1}) % {MASK + 1} AS BIGINT) AS a FROM g{k})")
    steps.append(f"y2 AS (SELECT w, CAST((CAST(xor(a, a >> 13) AS HUGEINT) * {F2}) % {MASK + 1} AS BIGINT) AS a FROM y1)")
    steps.append("f AS (SELECT w, xor(a, a >> 16) AS hash FROM y2)")
    return ",\n".join(steps)


_SET_DATA = """e AS (SELECT set_id, unnest(seqids) AS name, unnest(range(0, len(seqids))) AS member FROM summed_records),
a AS (SELECT seqid, arg_min(record_id, record_id) AS r FROM seq_array WHERE seqid IS NOT NULL GROUP BY 1),
s AS (SELECT DISTINCT r AS record_id, hex(data) AS h, octet_length(data) AS n FROM a JOIN seq_array ON record_id = r WHERE seq_array.seqid IN (SELECT name FROM e) AND data IS NOT NULL)"""


def _sketches(canonical: bool, k: int = 6, size: int = 50) -> str:
    word = f"least(w, {_BACK})" if canonical else "w"
    return f"""{_windows(k, _SET_DATA)},
vv AS (SELECT record_id, {word} AS w FROM v),
{_hash(k, "vv")},
k AS (SELECT record_id, list_sort(list(DISTINCT hash))[1:{size}] AS sketch FROM vv JOIN f USING (w) GROUP BY 1),
m AS (SELECT set_id, CAST(member AS INTEGER) AS member, sketch FROM e JOIN a ON a.seqid = e.name JOIN k ON k.record_id = a.r),
p AS (SELECT x.set_id, x.member AS member_a, y.member AS member_b, x.sketch AS sa, y.sketch AS sb FROM m x JOIN m y ON x.set_id = y.set_id AND x.member < y.member)"""


def _mash(k: int = 6, size: int = 50) -> str:
    """CTE dist from _sketches(): the rank of a common hash in the union is told by list positions."""
    return f""",
w1 AS (SELECT *, list_sort(list_distinct(list_concat(sa, sb)))[1:{size}] AS un FROM p),
w2 AS (SELECT *, len(un) AS u, len(list_intersect(un, list_intersect(sa, sb))) AS i FROM w1),
dist AS (SELECT set_id, member_a, member_b, CASE WHEN i = u THEN 0.0 WHEN i = 0 THEN 1.0 ELSE least(1.0, -ln(2.0 * i / u / (1.0 + 1.0 * i / u)) / {k}) END AS distance FROM w2)"""


_ROUNDED = "SELECT set_id, member_a, member_b, round(distance, 6) + 0.0 AS distance FROM dist"

_PAIRS = ", p AS (SELECT x.set_id, x.member AS member_a, y.member AS member_b, x.f AS a, y.f AS b FROM m x JOIN m y ON x.set_id = y.set_id AND x.member < y.member)"
_EUCLID = f"WITH {_SETS}{_PAIRS}, w AS (SELECT set_id, member_a, member_b, unnest(a) AS p, unnest(b) AS q FROM p), dist AS (SELECT set_id, member_a, member_b, sqrt(sum((p - q) * (p - q))) AS distance FROM w GROUP BY 1, 2, 3)"

_EPS = "2.220446049250313e-16"


def _entropy(v: str) -> str:
    return f"-list_sum(list_transform({v}, lambda e: CASE WHEN e > {_EPS} THEN e * log2(e) ELSE 0 END))"


def _less(a: str, b: str) -> str:
    """Difference of lists, with 0 for rounding below it."""
    return f"list_transform(list_zip({a}, {b}), lambda e: CASE WHEN e[1] - e[2] > {_EPS} THEN e[1] - e[2] ELSE 0 END)"


def _settled(source: str, stat: str) -> str:
    """Adds to rows of (keep..., names, x) the members' entropies, sums, total, contributions, the lowest and the statistic."""
    sums = "list_transform(range(1, 65), lambda j: list_sum(list_transform(x, lambda v: v[j])))"
    a = f"SELECT *, list_transform(x, lambda v: {_entropy('v')}) AS h, {sums} AS s, len(names) AS n FROM {source}"
    b = f"SELECT *, list_sum(h) AS sh, {_entropy('list_transform(s, lambda q: q / n)')} - list_sum(h) / n AS total FROM ({a})"
    rest = f"list_transform({_less('s', 'x[i]')}, lambda q: q / (n - 1))"
    c = f"SELECT *, list_transform(range(1, n + 1), lambda i: total - ({_entropy(rest)} - (sh - h[i]) / (n - 1))) AS delta FROM ({b})"
    value = "list_aggregate(delta, 'stddev_samp')" + (" / list_avg(delta)" if stat == "cov" else "")
    return f"SELECT *, list_position(list_transform(delta, lambda q: round(q, 12)), list_min(list_transform(delta, lambda q: round(q, 12)))) AS low, {value} AS stat FROM ({c})"


def _fold(rows: str, out: str, least: int, most: int, stat: str = "stdev") -> str:
    """CTEs that fold rows (chunk, rn from 1, seqid, f) of each chunk; `out` has the last state of each."""
    columns = "chunk, i, names, x, h, s, n, sh, total, delta, low, stat"
    seeds = f"SELECT chunk, {least} AS i, list(seqid ORDER BY rn) AS names, list(f ORDER BY rn) AS x FROM {rows} WHERE rn <= {least} GROUP BY chunk"
    mixed = f"list_transform(list_zip({_less('p.s', 'p.x[p.low]')}, c.f), lambda q: (q[1] + q[2]) / p.n)"
    met = f"SELECT p.*, c.seqid, c.f, {_entropy(mixed)} - (p.sh - p.h[p.low] + {_entropy('c.f')}) / p.n > p.total + {_EPS} AS rises FROM {out}_r p JOIN {rows} c ON c.chunk = p.chunk AND c.rn = p.i + 1"
    full = f"n >= {most}"
    kept = "CASE WHEN {full} THEN list_concat({v}[:low - 1], {v}[low + 1:], [{w}]) ELSE list_append({v}, {w}) END"
    changed = f"SELECT chunk, i + 1 AS i, {kept.format(full=full, v='names', w='seqid')} AS names, {kept.format(full=full, v='x', w='f')} AS x, stat AS old, {full} AS was_full, m AS before FROM (SELECT *, {{'names': names, 'x': x, 'h': h, 's': s, 'n': n, 'sh': sh, 'total': total, 'delta': delta, 'low': low, 'stat': stat}} AS m FROM ({met}) WHERE rises)"
    taken = f"SELECT chunk, i, CASE WHEN was_full OR stat > old THEN {{'names': names, 'x': x, 'h': h, 's': s, 'n': n, 'sh': sh, 'total': total, 'delta': delta, 'low': low, 'stat': stat}} ELSE before END AS m FROM ({_settled(f'({changed})', stat)})"
    state = ", ".join(f"m.{c} AS {c}" for c in columns.split(", ")[2:])
    passed = f"SELECT chunk, i + 1 AS i, {columns.removeprefix('chunk, i, ')} FROM ({met}) WHERE NOT rises"
    return f"""{out}_r AS (SELECT {columns} FROM ({_settled(f'({seeds})', stat)})
UNION ALL SELECT * FROM (SELECT chunk, i, {state} FROM ({taken}) UNION ALL {passed})),
{out} AS (SELECT q.* FROM {out}_r q WHERE i = (SELECT max(i) FROM {out}_r z WHERE z.chunk = q.chunk))"""


# Vectors in the order of a seeded digest of their names.
_ORDERED = """one AS (SELECT 1 AS chunk, row_number() OVER (ORDER BY md5('7' || seqid), seqid) AS rn, seqid, min(kfreqs) AS f FROM kmer_seq WHERE len(kfreqs) = 64 AND NOT isnan(kfreqs[1]) AND seqid IS NOT NULL GROUP BY seqid)"""


def _chunked(least: int, most: int, stat: str = "stdev") -> str:
    """Eight chunks folded, and their members folded again: x."""
    return f"""{_ORDERED},
parts AS (SELECT chunk, row_number() OVER (PARTITION BY chunk ORDER BY rn) AS rn, seqid, f FROM (SELECT ntile(8) OVER (ORDER BY rn) AS chunk, rn, seqid, f FROM one)),
{_fold('parts', 'y', least, most, stat)},
again AS (SELECT 1 AS chunk, row_number() OVER (ORDER BY chunk, place) AS rn, seqid, f FROM (SELECT chunk, unnest(range(1, n + 1)) AS place, unnest(names) AS seqid, unnest(x) AS f FROM y)),
{_fold('again', 'x', least, most, stat)}"""


_SELECTED = "SELECT unnest(names) AS seqid, round(unnest(delta), 6) + 0.0 AS delta_jsd, round(total, 6) + 0.0 AS total_jsd FROM x"

# Average linkage of the distances in dist: the distance of two groups is the mean over their pairs of members; `r` has
# the state after each merge.
_TREE = """both_ways AS (SELECT set_id, member_a AS a, member_b AS b, distance FROM dist UNION ALL SELECT set_id, member_b, member_a, distance FROM dist),
leaf AS (SELECT set_id, list(DISTINCT a ORDER BY a) AS leaves FROM both_ways GROUP BY 1),
mat AS (SELECT set_id, map(list(a || ' ' || b), list(round(distance, 12))) AS d FROM both_ways GROUP BY 1),
r AS (SELECT set_id, 0 AS step, list_transform(leaves, lambda m: [m]) AS held, list_transform(leaves, lambda m: CAST(m AS VARCHAR)) AS parts, CAST(NULL AS INTEGER[]) AS left_members, CAST(NULL AS INTEGER[]) AS right_members, CAST(NULL AS DOUBLE) AS height FROM leaf
UNION ALL
SELECT set_id, step + 1, list_append(list_concat(held[:i - 1], held[i + 1:j - 1], held[j + 1:]), list_concat(held[i], held[j])), list_append(list_concat(parts[:i - 1], parts[i + 1:j - 1], parts[j + 1:]), '(' || parts[i] || ',' || parts[j] || ')'), held[i], held[j], best.h
FROM (SELECT *, best.i AS i, best.j AS j FROM (SELECT r.*, list_min(list_transform(list_filter(flatten(list_transform(range(1, len(held) + 1), lambda p: list_transform(range(1, len(held) + 1), lambda q: [p, q]))), lambda e: e[1] < e[2]),
lambda e: {'h': round(list_avg(flatten(list_transform(held[e[1]], lambda u: list_transform(held[e[2]], lambda w: d[u || ' ' || w])))), 12), 'i': e[1], 'j': e[2]})) AS best FROM r JOIN mat USING (set_id) WHERE len(held) > 1)))"""
_NEWICK = "SELECT r.set_id, CAST(len(leaves) AS INTEGER) AS leaves, parts[1] || ';' AS newick FROM r JOIN leaf USING (set_id) WHERE len(parts) = 1"

ORACLE_SQL: dict[str, str] = {
    "decoded_text": f"WITH {_TEXT} SELECT record_id, text FROM t",
    "encoded_text": """SELECT record_id, CASE WHEN data IS NULL THEN NULL WHEN octet_length(data) = 0 THEN '' ELSE
array_to_string(list_transform(range(0, octet_length(data)), lambda i: CASE WHEN substr(hex(data), CAST(2 * i + 1 AS BIGINT), 2) IN ('00', '01', '02', '03') THEN substr(hex(data), CAST(2 * i + 1 AS BIGINT), 2) ELSE '05' END), '') END AS codes FROM seq_array""",
    "cleaned_text": "SELECT doc_id, md5(translate(regexp_replace(text, '[\\n\\r\\t \\-]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS cleaned FROM documents",
    "canonical_length": f"WITH {_TEXT} SELECT record_id, CAST(length(replace(text, 'N', '')) AS INTEGER) AS n FROM t",
    "rna_reverse_complement": f"WITH {_TEXT} SELECT record_id, md5(translate(reverse(text), 'TCAG', 'AGUC')) AS digest FROM t",
    "window_totals": f"WITH {_windows(6)} SELECT q.record_id, count(v.record_id) AS total FROM seq_array q LEFT JOIN v ON v.record_id = q.record_id GROUP BY 1",
    "valid_records": f"WITH {_windows(12)} SELECT DISTINCT record_id FROM v",
    "monomer_counts": _counts(1),
    "kmer_counts_2": _counts(2),
    "kmer_counts_3": _counts(3),
    "kmer_numbers": f"WITH {_windows(4)} SELECT translate(w, '0123', 'TCAG') AS kmer, {_number(4)} AS kmer_index, count(*) AS n FROM v GROUP BY w",
    "canonical_counts": f"WITH {_windows(5)} SELECT translate(least(w, {_BACK}), '0123', 'TCAG') AS kmer, count(*) AS n FROM v GROUP BY 1",
    "kmer_freqs": f"WITH {_windows(3)}, c AS (SELECT record_id, {_number(3)} AS kmer, count(*) AS n FROM v GROUP BY 1, 2) SELECT record_id, kmer, n / sum(n) OVER (PARTITION BY record_id) AS freq FROM c",
    "record_entropy": f"WITH {_windows(3)}, c AS (SELECT record_id, w, count(*) AS n FROM v GROUP BY 1, 2), f AS (SELECT record_id, n / sum(n) OVER (PARTITION BY record_id) AS f FROM c) SELECT record_id, round(-sum(f * log2(f)), 6) + 0.0 AS entropy FROM f GROUP BY 1",
    "unique_content": "SELECT md5(data) AS content, max(seqid) AS seqid, count(*) AS n FROM seq_array WHERE octet_length(data) > 0 AND seqid IS NOT NULL GROUP BY 1",
    "store_sizes": "SELECT count(*) AS n, count(DISTINCT md5(data)) AS n_unique, count(DISTINCT seqid) AS n_names FROM seq_array WHERE octet_length(data) > 0",
    "chunk_sizes": "SELECT CAST(chunk AS INTEGER) AS chunk, count(*) AS n, min(record_id) AS first_id FROM (SELECT record_id, ntile(7) OVER (ORDER BY record_id) AS chunk FROM seq_array) GROUP BY 1",
    "seeded_limit": "SELECT record_id, md5('7' || CAST(record_id AS VARCHAR)) AS place FROM seq_array ORDER BY 2, 1 LIMIT 50",
    "set_sums": f"WITH {_SETS} SELECT set_id, CAST(kmer AS INTEGER) AS kmer, round(total, 6) + 0.0 AS total FROM s WHERE total > 0",
    "set_divergence": f"WITH {_SETS} SELECT set_id, size, round(sh, 6) + 0.0 AS summed_entropies, round(total_jsd, 6) + 0.0 AS total_jsd, round(total_jsd / size, 6) + 0.0 AS mean_jsd FROM d",
    "set_leave_one_out": f"WITH {_SETS} SELECT set_id, member, round(entropy, 6) + 0.0 AS entropy, round(delta_jsd, 6) + 0.0 AS delta_jsd, round(total_jsd, 6) + 0.0 AS total_jsd FROM q",
    "set_statistics": f"WITH {_SETS} SELECT q.set_id, max(size) AS size, max(lowest) AS lowest, round(avg(delta_jsd), 6) + 0.0 AS mean_delta_jsd, round(stddev_samp(delta_jsd), 6) + 0.0 AS std_delta_jsd FROM q JOIN low USING (set_id) GROUP BY 1",
    "set_cov": f"WITH {_SETS} SELECT set_id, round(stddev_samp(delta_jsd) / avg(delta_jsd), 4) AS cov_delta_jsd FROM q GROUP BY 1",
    "replaced_divergence": f"WITH {_REPLACED} SELECT set_id, member, name, round(replaced_jsd, 6) + 0.0 AS replaced_jsd FROM p",
    "increasing_candidates": f"WITH {_REPLACED} SELECT set_id, member, name, round(replaced_jsd, 6) + 0.0 AS replaced_jsd FROM p JOIN d USING (set_id) WHERE replaced_jsd > total_jsd + 2.220446049250313e-16",
    "pairwise_divergence": f"""WITH {_SETS}{_PAIRS}, w AS (SELECT set_id, member_a, member_b, unnest(a) AS p, unnest(b) AS q FROM p),
j AS (SELECT set_id, member_a, member_b, -sum(CASE WHEN p + q > 0 THEN (p + q) / 2 * log2((p + q) / 2) ELSE 0 END) AS mixed FROM w GROUP BY 1, 2, 3)
SELECT j.set_id, member_a, member_b, round(greatest(0.0, mixed - (ha.entropy + hb.entropy) / 2), 6) + 0.0 AS jsd FROM j JOIN h ha ON ha.set_id = j.set_id AND ha.member = member_a JOIN h hb ON hb.set_id = j.set_id AND hb.member = member_b""",
    "euclidean_distances": f"{_EUCLID} SELECT set_id, member_a, member_b, round(distance, 6) + 0.0 AS distance FROM dist",
    "nearest_member": f"""{_EUCLID}, both_ways AS (SELECT set_id, member_a AS member, member_b AS other, distance FROM dist UNION ALL SELECT set_id, member_b, member_a, distance FROM dist)
SELECT set_id, member, arg_min(other, (round(distance, 9), other)) AS nearest, round(min(distance), 6) + 0.0 AS distance FROM both_ways GROUP BY 1, 2""",
    "kmer_hashes": f"WITH {_windows(6)}, {_hash(6, 'v')} SELECT record_id, CAST(count(DISTINCT hash) AS INTEGER) AS n, min(hash) AS least, max(hash) AS greatest FROM v JOIN f USING (w) GROUP BY 1",
    "bottom_sketches": f"WITH {_windows(6)}, {_hash(6, 'v')}, y AS (SELECT DISTINCT record_id, hash FROM v JOIN f USING (w)), r AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY hash) - 1 AS place, hash FROM y) SELECT record_id, CAST(place AS INTEGER) AS place, hash FROM r WHERE place < 50",
    "sketch_jaccard": f"WITH {_sketches(False)} SELECT set_id, member_a, member_b, round(len(list_intersect(sa, sb)) / len(list_distinct(list_concat(sa, sb))), 6) + 0.0 AS jaccard FROM p",
    "mash_distances": f"WITH {_sketches(False)}{_mash()} {_ROUNDED}",
    "canonical_mash_distances": f"WITH {_sketches(True)}{_mash()} {_ROUNDED}",
    "default_mash_distances": f"WITH {_sketches(False, 12, 3000)}{_mash(12, 3000)} {_ROUNDED}",
    "nmost": f"WITH RECURSIVE {_ORDERED}, {_fold('one', 'x', 10, 10)} {_SELECTED}",
    "nmost_chunked": f"WITH RECURSIVE {_chunked(10, 10)} {_SELECTED}",
    "max_stdev": f"WITH RECURSIVE {_chunked(5, 30, 'stdev')} {_SELECTED}",
    "max_cov": f"WITH RECURSIVE {_chunked(5, 30, 'cov')} {_SELECTED}",
    "nmost_with_included": f"""WITH RECURSIVE {_chunked(10, 10)},
i AS (SELECT 1 AS chunk, row_number() OVER (ORDER BY late, rn) AS rn, seqid, f FROM (SELECT 0 AS late, row_number() OVER () AS rn, unnest(names) AS seqid, unnest(x) AS f FROM x
UNION ALL SELECT 1, 0, min(seqid), arg_min(f, seqid) FROM one WHERE (SELECT min(seqid) FROM one) NOT IN (SELECT unnest(names) FROM x))),
n AS (SELECT max(rn) AS n FROM i),
l AS (SELECT seqid, n, unnest(range(1, 65)) AS j, unnest(f) AS f FROM i, n),
h AS (SELECT seqid, -sum(CASE WHEN f > 0 THEN f * log2(f) ELSE 0 END) AS h FROM l GROUP BY 1),
s AS (SELECT j, sum(f) AS s FROM l GROUP BY 1),
t AS (SELECT -sum(CASE WHEN s > 0 THEN s / n * log2(s / n) ELSE 0 END) - (SELECT sum(h) FROM h) / max(n) AS total FROM s, n),
o AS (SELECT seqid, -sum(CASE WHEN s - f > 2.220446049250313e-16 THEN (s - f) / (n - 1) * log2((s - f) / (n - 1)) ELSE 0 END) AS rest, max(n) AS n FROM l JOIN s USING (j) GROUP BY 1)
SELECT o.seqid, round(total - (rest - ((SELECT sum(h) FROM h) - h) / (n - 1)), 6) + 0.0 AS delta_jsd, round(total, 6) + 0.0 AS total_jsd FROM o JOIN h USING (seqid), t""",
    "tree_merges": f"WITH RECURSIVE {_EUCLID.removeprefix('WITH ')}, {_TREE} SELECT set_id, CAST(step AS INTEGER) AS step, list_sort(left_members) AS left_members, list_sort(right_members) AS right_members, round(height, 6) + 0.0 AS height FROM r WHERE step > 0",
    "euclidean_trees": f"WITH RECURSIVE {_EUCLID.removeprefix('WITH ')}, {_TREE} {_NEWICK}",
    "mash_trees": f"WITH RECURSIVE {_sketches(False)}{_mash()}, {_TREE} {_NEWICK}",
    "fasta_records": f"WITH {_TEXT} SELECT CAST(record_id AS VARCHAR) AS name, md5(text) AS seq FROM t WHERE length(text) > 0",
    "genbank_records": f"WITH {_TEXT} SELECT 'R' || record_id AS name, md5(text) AS seq FROM t WHERE length(text) > 0",
    "whole_file_records": f"WITH {_TEXT}, b AS (SELECT string_agg(text, '-' ORDER BY record_id) AS seq FROM t JOIN seq_array USING (record_id) WHERE length(text) > 0 GROUP BY batch_id) SELECT md5(seq) AS seq, CAST(length(seq) AS INTEGER) AS n FROM b",
    "last_named_records": f"WITH {_TEXT} SELECT seqid AS name, md5(arg_max(text, record_id)) AS seq FROM t JOIN seq_array USING (record_id) WHERE length(text) > 0 AND seqid IS NOT NULL GROUP BY 1",
    "stored_contents": f"WITH {_TEXT} SELECT seqid, min(md5(unhex(replace(replace(replace(replace(replace(text, 'T', '00'), 'C', '01'), 'A', '02'), 'G', '03'), 'N', '05')))) AS content, 't:' || seqid AS source FROM t JOIN seq_array USING (record_id) WHERE length(text) > 0 AND seqid IS NOT NULL GROUP BY seqid",
    "written_selection": f"WITH RECURSIVE {_ORDERED}, {_fold('one', 'x', 10, 10)} SELECT unnest(names) AS names, round(unnest(delta), 6) + 0.0 AS delta_jsd FROM x",
    "written_trees": f"WITH RECURSIVE {_EUCLID.removeprefix('WITH ')}, {_TREE}, n AS ({_NEWICK}) SELECT newick FROM n",
    "probe_distances": f"""WITH a AS (SELECT seqid, min(record_id) AS r FROM seq_array WHERE seqid IN (SELECT seqid FROM knn_probe) GROUP BY 1),
{_windows(3, "s AS (SELECT r AS record_id, hex(data) AS h, octet_length(data) AS n FROM a JOIN seq_array ON record_id = r WHERE data IS NOT NULL)")},
c AS (SELECT record_id, {_number(3)} AS kmer, count(*) AS n FROM v GROUP BY 1, 2),
f AS (SELECT record_id, map(list(kmer), list(n)) AS m, sum(n) AS total FROM c GROUP BY 1),
d AS (SELECT a.seqid, list_transform(range(0, 64), lambda i: coalesce(m[i], 0) / total) AS x FROM f JOIN a ON a.r = f.record_id)
SELECT p.seqid AS member_a, q.seqid AS member_b, round(list_distance(p.x, q.x), 6) + 0.0 AS distance FROM d p JOIN d q ON p.seqid < q.seqid""",
    "degapped": "SELECT doc_id, md5(replace(text, '-', '')) AS text FROM documents",
    "set_names": "SELECT name, count(*) AS n, count(DISTINCT set_id) AS sets FROM (SELECT set_id, unnest(seqids) AS name FROM summed_records) GROUP BY 1",
    "stored_sets": f"""WITH {_SETS}, n AS (SELECT q.set_id, max(total_jsd) AS t, max(lowest) AS lo, avg(delta_jsd) AS m, stddev_samp(delta_jsd) AS sd FROM q JOIN low USING (set_id) GROUP BY 1)
SELECT r.set_id, abs(r.total_jsd - t) < 1e-6 AS total, lowest_index = lo AS lowest, abs(mean_delta_jsd - m) < 1e-6 AS mean, abs(std_delta_jsd - sd) < 1e-6 AS std FROM summed_records r LEFT JOIN n ON n.set_id = r.set_id""",
    "store_metadata": "SELECT lower(metadata['source']) AS source, lower(metadata['moltype']) AS moltype, count(*) AS n, count(DISTINCT lower(seqid_to_hash)) AS n_unique FROM zarr_store GROUP BY 1, 2",
    "stored_records": "SELECT record_id, substr(md5(data), 1, 16) AS digest FROM seq_array WHERE substr(md5(data), 1, 16) IN (SELECT lower(seqid_to_hash) FROM zarr_store WHERE seqid_to_hash IS NOT NULL)",
}
