"""DuckDB SQL that gives the rows of each query, written apart from the operators: joins on ranges, windows, dense grids."""

from __future__ import annotations

import re

W, H, L, THRESHOLD = 51, 25, 10_000, 0.9

PARTS = {
    "ctss": "SELECT 'chr' || l_suppkey AS seqname, 1 + (l_orderkey*37 + l_partkey*11 + l_linenumber) % 10000 AS pos, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, 's' || l_linenumber AS sample, CAST(sum(l_quantity) AS BIGINT) AS counts FROM lineitem GROUP BY 1, 2, 3, 4",
    "totals": "SELECT sample, CAST(sum(counts) AS BIGINT) AS total FROM ctss GROUP BY 1",
    "tpm": "SELECT c.*, c.counts / (t.total / 1e6) AS tpm FROM ctss c JOIN totals t USING (sample)",
    "pooled": "SELECT seqname, pos, strand, CAST(round(sum(tpm) * 1e9) AS BIGINT) AS n FROM tpm GROUP BY 1, 2, 3",
    "genes": "SELECT 'g' || p_partkey AS gene_id, 'chr' || (p_partkey % n) AS seqname, p_partkey AS row_idx, 1 + (p_partkey*53 + p_partkey // n * 457) % 9000 AS s, least(10000, 1 + (p_partkey*53 + p_partkey // n * 457) % 9000 + p_size*20) AS e, CASE WHEN p_partkey // n % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part, (SELECT count(*) AS n FROM supplier)",
    "exons": "SELECT 't' || row_idx AS tx_id, gene_id, seqname, strand, i, CASE i WHEN 0 THEN s WHEN 1 THEN s + 2*((e-s+1)//5) ELSE s + 4*((e-s+1)//5) END AS s, CASE i WHEN 0 THEN s + (e-s+1)//5 - 1 WHEN 1 THEN s + 3*((e-s+1)//5) - 1 ELSE e END AS e FROM genes, (SELECT unnest([0, 1, 2]) AS i)",
}


def stats(name: str, ranges: str) -> dict[str, str]:
    """Score and peak of ranges (seqname, strand, s, e), as the table `name`."""
    return {
        f"{name}_points": f"SELECT r.seqname, r.strand, r.s, r.e, p.pos, p.n FROM {ranges} r JOIN pooled p ON p.seqname = r.seqname AND p.strand = r.strand AND p.pos BETWEEN r.s AND r.e",
        f"{name}_sums": f"SELECT seqname, strand, s, e, CAST(sum(n) AS BIGINT) AS n, max(n) AS top FROM {name}_points GROUP BY 1, 2, 3, 4",
        f"{name}_runs": f"SELECT seqname, strand, s, e, min(pos) AS a, max(pos) AS b FROM (SELECT p.seqname, p.strand, p.s, p.e, p.pos, p.pos - row_number() OVER (PARTITION BY p.seqname, p.strand, p.s, p.e ORDER BY p.pos) AS run FROM {name}_points p JOIN {name}_sums q ON p.seqname = q.seqname AND p.strand = q.strand AND p.s = q.s AND p.e = q.e AND p.n = q.top) GROUP BY 1, 2, 3, 4, run",
        f"{name}_peaks": f"SELECT seqname, strand, s, e, min(a) AS a, arg_min(b, a) AS b FROM {name}_runs GROUP BY 1, 2, 3, 4",
        name: f"SELECT q.seqname || ':' || q.s || '-' || q.e || ';' || q.strand AS id, q.seqname, q.strand, q.s, q.e, q.n, k.a + (k.b - k.a) // 2 AS peak FROM {name}_sums q JOIN {name}_peaks k ON q.seqname = k.seqname AND q.strand = k.strand AND q.s = k.s AND q.e = k.e",
    }


def clusters(name: str, cutoff: int = 0, gap: int = 20) -> dict[str, str]:
    return {
        f"{name}_flags": f"SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY seqname, strand ORDER BY pos) <= {gap} THEN 0 ELSE 1 END AS f FROM pooled WHERE n > {cutoff}",
        f"{name}_ranges": f"SELECT seqname, strand, min(pos) AS s, max(pos) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY seqname, strand ORDER BY pos) AS k FROM {name}_flags) GROUP BY 1, 2, k",
    } | stats(name, f"{name}_ranges")


PARTS |= clusters("tc")
PARTS |= {
    "counted": "SELECT t.id, c.sample, CAST(sum(c.counts) AS BIGINT) AS counts FROM tc t JOIN ctss c ON c.seqname = t.seqname AND c.strand = t.strand AND c.pos BETWEEN t.s AND t.e GROUP BY 1, 2",
    "plain": "SELECT t.id, arg_min(g.gene_id, [greatest(0, greatest(t.s, CASE WHEN g.strand = '-' THEN g.e ELSE g.s END) - least(t.e, CASE WHEN g.strand = '-' THEN g.e ELSE g.s END) - 1), g.row_idx]) AS gene FROM tc t JOIN genes g ON t.seqname = g.seqname AND t.strand = g.strand AND t.s <= g.e AND t.e >= g.s GROUP BY 1",
    "in_gene": "SELECT c.*, p.gene FROM counted c JOIN plain p USING (id)",
    "shares": "SELECT id, gene, counts / sum(counts) OVER (PARTITION BY gene, sample) AS share FROM in_gene",
}


def grown(up: int, down: int) -> str:
    """Genes widened by the surroundings of their starts, clipped to the sequence."""
    return f"(SELECT *, CASE WHEN strand = '-' THEN e ELSE s END AS tss, greatest(1, least(s, CASE WHEN strand = '-' THEN e - {down} + 1 ELSE s - {up} END)) AS ws, least({L}, greatest(e, CASE WHEN strand = '-' THEN e + {up} ELSE s + {down} - 1 END)) AS we FROM genes)"


def widened_tx(up: int, a: str, b: str) -> str:
    return f"""SELECT t.id AS feature_id, string_agg('t' || g.row_idx, ';' ORDER BY 't' || g.row_idx) AS "txID"
        FROM tc t LEFT JOIN {grown(up, 0)} g ON t.seqname = g.seqname AND t.strand = g.strand AND {a} <= g.we AND {b} >= g.ws GROUP BY 1"""


def nearest_gene(up: int, down: int, a: str, b: str, ties: str = "row_idx") -> str:
    return f"""SELECT t.id AS feature_id, arg_min(g.gene_id, {{'d': greatest(0, greatest(t.s, g.tss) - least(t.e, g.tss) - 1), 'i': g.{ties}}}) FILTER (g.gene_id IS NOT NULL) AS "geneID"
        FROM tc t LEFT JOIN {grown(up, down)} g ON t.seqname = g.seqname AND t.strand = g.strand AND {a} <= g.we AND {b} >= g.ws GROUP BY 1"""


def promoter(table: str, up: int, down: int) -> str:
    return f"SELECT seqname, strand, greatest(1, CASE WHEN strand = '-' THEN e - {down} + 1 ELSE s - {up} END) AS s, least({L}, CASE WHEN strand = '-' THEN e + {up} ELSE s + {down} - 1 END) AS e FROM {table}"


def models(proximal: int, detailed: bool) -> str:
    parts = [
        ("promoter", promoter("genes", 100, 100)), ("proximal", promoter("genes", proximal, 0)),
        ("fiveUTR", "SELECT seqname, strand, s, e FROM exons WHERE i = CASE WHEN strand = '+' THEN 0 ELSE 2 END"), ("threeUTR", "SELECT seqname, strand, s, e FROM exons WHERE i = CASE WHEN strand = '+' THEN 2 ELSE 0 END"),
        ("CDS", "SELECT seqname, strand, s, e FROM exons WHERE i = 1"), ("exon", "SELECT seqname, strand, s, e FROM exons"),
        ("intron", "SELECT seqname, strand, e + 1 AS s, nxt - 1 AS e FROM (SELECT *, lead(s) OVER (PARTITION BY tx_id ORDER BY s) AS nxt FROM exons) WHERE nxt > e + 1"),
    ]
    turned = lambda q: f"SELECT seqname, CASE strand WHEN '+' THEN '-' ELSE '+' END AS strand, s, e FROM ({q})"
    parts += [(f"antisense_{n}", turned(q)) for n, q in parts] if detailed else [("antisense", turned("SELECT seqname, strand, s, e FROM genes"))]
    return " UNION ALL ".join(f"SELECT '{n}' AS category, {i} AS k, seqname, strand, s, e FROM ({q})" for i, (n, q) in enumerate(parts))


# the loci on a dense grid of bases, beyond the ends of the sequences as far as windows reach
PARTS |= {
    "runs": "SELECT seqname, strand, min(pos) AS s, max(pos) AS e FROM (SELECT *, pos - row_number() OVER (PARTITION BY seqname, strand ORDER BY pos) AS k FROM pooled) GROUP BY 1, 2, k",
    "edges": f"SELECT seqname, strand, CASE WHEN strand = '+' THEN s - {W - 1} ELSE e END AS s, CASE WHEN strand = '+' THEN s ELSE e + {W - 1} END AS e FROM runs",
    "edge_events": "SELECT seqname, pos, CAST(sum(CASE WHEN strand = '+' THEN d ELSE 0 END) AS BIGINT) AS dp, CAST(sum(CASE WHEN strand = '-' THEN d ELSE 0 END) AS BIGINT) AS dm FROM (SELECT seqname, strand, s AS pos, 1 AS d FROM edges UNION ALL SELECT seqname, strand, e + 1, -1 FROM edges) GROUP BY 1, 2",
    "wide_grid": f"SELECT 'chr' || s_suppkey AS seqname, i AS pos FROM supplier, (SELECT unnest(generate_series(-{W}, {L + W})) AS i)",
    "common": "SELECT seqname, pos FROM (SELECT g.seqname, g.pos, sum(coalesce(dp, 0)) OVER w AS p, sum(coalesce(dm, 0)) OVER w AS m FROM wide_grid g LEFT JOIN edge_events USING (seqname, pos) WINDOW w AS (PARTITION BY g.seqname ORDER BY g.pos)) WHERE p > 0 AND m > 0",
    "common_flags": f"SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY seqname ORDER BY pos) <= {2 * (W - 1) + 1} THEN 0 ELSE 1 END AS f FROM common",
    "regions": f"SELECT seqname, greatest(1, min(pos) - {W - 1}) AS s, least({L}, max(pos) + {W - 1}) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY seqname ORDER BY pos) AS k FROM common_flags) GROUP BY seqname, k",
    "near": "SELECT p.* FROM pooled p JOIN regions r ON p.seqname = r.seqname AND p.pos BETWEEN r.s AND r.e",
    "grid": f"SELECT g.seqname, g.pos, coalesce(sum(n) FILTER (strand = '+'), 0) AS p, coalesce(sum(n) FILTER (strand = '-'), 0) AS m FROM (SELECT * FROM wide_grid WHERE pos BETWEEN 1 AND {L}) g LEFT JOIN near USING (seqname, pos) GROUP BY 1, 2",
    "centred": f"SELECT seqname, pos, sum(p) OVER w AS p, sum(m) OVER w AS m FROM grid WINDOW w AS (PARTITION BY seqname ORDER BY pos ROWS BETWEEN {H} PRECEDING AND {H} FOLLOWING)",
    "capped": f"SELECT c.seqname, c.pos, CAST(d.p AS BIGINT) AS p, CAST(d.m AS BIGINT) AS m FROM centred c JOIN centred d ON d.seqname = c.seqname AND d.pos = least(greatest(c.pos, {H + 1}), {L - H})",
    "sums": f"SELECT seqname, pos, coalesce(lead(p, {H}) OVER w, 0) / 1e9 AS pd, coalesce(lag(m, {H}) OVER w, 0) / 1e9 AS md, coalesce(lag(p, {H}) OVER w, 0) / 1e9 AS pu, coalesce(lead(m, {H}) OVER w, 0) / 1e9 AS mu FROM capped WINDOW w AS (PARTITION BY seqname ORDER BY pos)",
    "balanced": "SELECT *, CASE WHEN pd + md + pu + mu = 0 THEN 0 ELSE sqrt(0.5 * pd / (pd + md + pu + mu)) + sqrt(0.5 * md / (pd + md + pu + mu)) END AS b FROM sums",
    "full_grid": f"SELECT g.seqname, g.pos, coalesce(sum(n) FILTER (strand = '+'), 0) AS p, coalesce(sum(n) FILTER (strand = '-'), 0) AS m FROM (SELECT * FROM wide_grid WHERE pos BETWEEN 1 AND {L}) g LEFT JOIN pooled USING (seqname, pos) GROUP BY 1, 2",
    "full_centred": f"SELECT seqname, pos, sum(p) OVER w AS p, sum(m) OVER w AS m FROM full_grid WINDOW w AS (PARTITION BY seqname ORDER BY pos ROWS BETWEEN {H} PRECEDING AND {H} FOLLOWING)",
    "full_capped": f"SELECT c.seqname, c.pos, CAST(d.p AS BIGINT) AS p, CAST(d.m AS BIGINT) AS m FROM full_centred c JOIN full_centred d ON d.seqname = c.seqname AND d.pos = least(greatest(c.pos, {H + 1}), {L - H})",
    "full_sums": f"SELECT seqname, pos, coalesce(lead(p, {H}) OVER w, 0) / 1e9 AS pd, coalesce(lag(m, {H}) OVER w, 0) / 1e9 AS md, coalesce(lag(p, {H}) OVER w, 0) / 1e9 AS pu, coalesce(lead(m, {H}) OVER w, 0) / 1e9 AS mu FROM full_capped WINDOW w AS (PARTITION BY seqname ORDER BY pos)",
    "full_balanced": "SELECT *, CASE WHEN pd + md + pu + mu = 0 THEN 0 ELSE sqrt(0.5 * pd / (pd + md + pu + mu)) + sqrt(0.5 * md / (pd + md + pu + mu)) END AS b FROM full_sums",
    "hot_flags": f"SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY seqname ORDER BY pos) <= {2 * (W - 1)} THEN 0 ELSE 1 END AS f FROM balanced WHERE b > {THRESHOLD}",
    "hot": "SELECT *, sum(f) OVER (PARTITION BY seqname ORDER BY pos) AS k FROM hot_flags",
    "loci_ranges": "SELECT seqname, k, min(pos) AS a, max(pos) AS b, max(b) AS top FROM hot GROUP BY 1, 2",
    "hot_runs": "SELECT seqname, k, min(pos) AS a, max(pos) AS b FROM (SELECT h.seqname, h.k, h.pos, h.pos - row_number() OVER (PARTITION BY h.seqname, h.k ORDER BY h.pos) AS run FROM hot h JOIN loci_ranges r ON h.seqname = r.seqname AND h.k = r.k AND h.b = r.top) GROUP BY 1, 2, run",
    "hot_peaks": "SELECT seqname, k, min(a) AS a, arg_min(b, a) AS b FROM hot_runs GROUP BY 1, 2",
    "loci": f"SELECT r.seqname || ':' || (r.a - {W - 1}) || '-' || (r.b + {W - 1}) AS id, r.seqname, r.a - {W - 1} AS s, r.b + {W - 1} AS e, r.top, p.a + (p.b - p.a) // 2 AS peak FROM loci_ranges r JOIN hot_peaks p USING (seqname, k)",
    "loci_scores": "SELECT l.id, CAST(sum(n) AS BIGINT) AS n FROM loci l JOIN pooled p ON p.seqname = l.seqname AND p.pos BETWEEN l.s AND l.e GROUP BY 1",
    "arms": "SELECT l.id, c.sample, sum(counts) FILTER (strand = '+' AND pos >= peak) AS p, sum(counts) FILTER (strand = '-' AND pos <= peak) AS m FROM loci l JOIN ctss c ON c.seqname = l.seqname AND c.pos BETWEEN l.s AND l.e GROUP BY 1, 2",
    "profile": "SELECT t.id, t.seqname, t.strand, t.s, t.e, p.pos, p.n, CAST(sum(p.n) OVER (PARTITION BY t.id ORDER BY p.pos) AS BIGINT) AS fwd, CAST(sum(p.n) OVER (PARTITION BY t.id ORDER BY p.pos DESC) AS BIGINT) AS rev, CAST(sum(p.n) OVER (PARTITION BY t.id) AS BIGINT) AS total FROM tc t JOIN pooled p ON p.seqname = t.seqname AND p.strand = t.strand AND p.pos BETWEEN t.s AND t.e",
    "symmetric_ranges": "SELECT seqname, strand, min(pos) FILTER (fwd >= total * 0.3 / 2) AS s, max(pos) FILTER (rev >= total * 0.3 / 2) AS e FROM profile GROUP BY id, 1, 2",
    "asymmetric_ranges": "SELECT seqname, strand, coalesce(min(pos) FILTER (gone > total * 0.3), any_value(s)) AS s, coalesce(max(pos) FILTER (gone > total * 0.3), any_value(e)) AS e FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY id ORDER BY least(fwd, rev), pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gone FROM profile) GROUP BY id, 1, 2",
    "peak_ranges": "SELECT seqname, strand, greatest(s, CASE WHEN strand = '-' THEN peak - 4 ELSE peak - 5 END) AS s, least(e, CASE WHEN strand = '-' THEN peak + 5 ELSE peak + 4 END) AS e FROM tc",
    "stretch_flags": "SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY seqname ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 < 10 THEN 0 ELSE 1 END AS f FROM tc",
    "stretch_members": "SELECT *, sum(f) OVER (PARTITION BY seqname ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM stretch_flags",
    "stretch": "SELECT seqname, k, min(s) AS s, max(e) AS e, CAST(count(*) AS INTEGER) AS n, string_agg(id, ',' ORDER BY s, e, id) AS members FROM stretch_members GROUP BY 1, 2 HAVING count(*) >= 3",
    "grid_counts": "SELECT t.id, x.i, coalesce(c.counts, 0) AS v FROM tc t CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS i) x LEFT JOIN counted c ON c.id = t.id AND c.sample = 's' || x.i",
    "vec": "SELECT id, list(CAST(v AS DOUBLE) ORDER BY i) AS v FROM grid_counts GROUP BY 1",
    "link": "SELECT a.id AS i, b.id AS j, greatest(a.s, b.s) - least(a.e, b.e) - 1 AS d, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2, a.strand AS strand1, a.seqname AS seq FROM tc a JOIN tc b ON a.seqname = b.seqname AND a.strand = b.strand AND greatest(a.s, b.s) - least(a.e, b.e) - 1 <= 100 AND a.id != b.id",
}
PARTS |= clusters("cut", 2 * 10**9, 5) | stats("sym", "symmetric_ranges") | stats("asy", "asymmetric_ranges") | stats("pk", "peak_ranges")


def needs(sql: str, seen: dict[str, None] | None = None) -> list[str]:
    """The parts that a statement reads, in an order that works."""
    seen = {} if seen is None else seen
    for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql)):
        if word in PARTS and word not in seen:
            needs(PARTS[word], seen)
            seen[word] = None
    return list(seen)


def with_parts(sql: str) -> str:
    listed = [f"{n} AS MATERIALIZED ({PARTS[n]})" for n in needs(sql)]
    return f"WITH {', '.join(listed)} {sql}" if listed else sql


def flat(table: str) -> str:
    return f"SELECT id AS feature_id, seqname, s AS start, e AS \"end\", strand, round(n / 1e9, 6) AS score, peak AS thick_start, peak AS thick_end FROM {table}"


def corr(a: str, b: str) -> str:
    """Pearson's correlation of two lists of seven, null for constant ones."""
    return f"(SELECT CASE WHEN sum((x - mx) ** 2) > 0 AND sum((y - my) ** 2) > 0 THEN sum((x - mx) * (y - my)) / sqrt(sum((x - mx) ** 2) * sum((y - my) ** 2)) END FROM (SELECT x, y, avg(x) OVER () AS mx, avg(y) OVER () AS my FROM (SELECT unnest({a}) AS x, unnest({b}) AS y)))"


MID1, MID2 = "s1 + (e1 - s1) // 2", "s2 + (e2 - s2) // 2"
_SQL = {
    "total_tags": 'SELECT sample, total AS "totalTags" FROM totals',
    "tpm": 'SELECT seqname, pos AS start, strand, sample, counts, round(tpm, 6) AS "TPM" FROM tpm',
    "pooled_scores": "SELECT seqname, pos AS start, strand, round(n / 1e9, 6) AS score FROM pooled",
    "support": "SELECT seqname, pos AS start, strand, CAST(count(*) FILTER (counts > 10) AS INTEGER) AS support FROM ctss GROUP BY 1, 2, 3",
    "support_negative": "SELECT seqname, pos AS start, strand, CAST(7 AS INTEGER) AS support FROM pooled",
    "subset_support": "SELECT id AS feature_id, CAST(count(*) AS INTEGER) AS support FROM counted GROUP BY 1 HAVING count(*) > 1",
    "composition": 'SELECT id AS feature_id, gene AS "geneID", CAST(count(*) FILTER (share > 0.1) AS INTEGER) AS composition FROM shares GROUP BY 1, 2',
    "subset_composition": "SELECT id AS feature_id, CAST(count(*) FILTER (share > 0.1) AS INTEGER) AS composition FROM shares GROUP BY 1 HAVING count(*) FILTER (share > 0.1) > 1",
    "tag_clusters": flat("tc"),
    "tag_clusters_cutoff": flat("cut"),
    "cluster_widths": "SELECT coalesce(w, 'Total') AS width, count(*) AS count, round(count(*) / (SELECT count(*) FROM tc) * 100, 6) AS percent FROM (SELECT CASE WHEN e - s + 1 <= 10 THEN '>=1' WHEN e - s + 1 <= 100 THEN '>=10' WHEN e - s + 1 <= 1000 THEN '>=100' ELSE '>=1000' END AS w FROM tc) GROUP BY ROLLUP (w)",
    "tune_thresholds": "SELECT round(h / 1e9, 6) AS threshold, sum(f)::BIGINT AS \"nTCs\" FROM (SELECT h, CASE WHEN pos - lag(pos) OVER (PARTITION BY h, seqname, strand ORDER BY pos) <= 20 THEN 0 ELSE 1 END AS f FROM pooled, (SELECT 0 AS h UNION ALL (SELECT DISTINCT n FROM pooled ORDER BY n LIMIT 5)) WHERE n > h) GROUP BY h",
    "tune_exponential": "SELECT round(h / 1e9, 6) AS threshold, sum(f)::BIGINT AS \"nTCs\" FROM (SELECT h, CASE WHEN pos - lag(pos) OVER (PARTITION BY h, seqname, strand ORDER BY pos) <= 20 THEN 0 ELSE 1 END AS f FROM pooled, (SELECT 0 AS h UNION ALL SELECT CAST(round((SELECT min(n) FROM pooled) * pow(2, 6 * i / 3)) AS BIGINT) FROM (SELECT unnest([0, 1, 2, 3]) AS i)) WHERE n > h) GROUP BY h",
    "quantify_tag_clusters": "SELECT id AS feature_id, sample, counts FROM counted",
    "quantify_dense": "SELECT id AS feature_id, 's' || i AS sample, CAST(v AS BIGINT) AS counts FROM grid_counts",
    "quantified_genes": 'SELECT g.gene AS "geneID", CAST(g.k AS INTEGER) AS "nClusters", c.sample, CAST(sum(c.counts) AS BIGINT) AS counts FROM in_gene c JOIN (SELECT gene, count(*) AS k FROM plain GROUP BY 1) g USING (gene) GROUP BY 1, 2, 3',
    "aggregated_rows": 'SELECT CAST(i AS INTEGER) AS "group", CAST(coalesce(sum(s_suppkey), 0) AS BIGINT) AS v FROM (SELECT unnest(generate_series(0, 24)) AS i) LEFT JOIN supplier ON s_nationkey = i AND s_nationkey % 5 != 0 GROUP BY 1',
    "overlap_scores": "SELECT gene_id AS feature_id, CAST(coalesce(sum(counts), 0) AS BIGINT) AS score FROM genes g LEFT JOIN ctss c ON c.seqname = g.seqname AND c.strand = g.strand AND c.pos BETWEEN g.s AND g.e GROUP BY 1",
    "clusters_in_genes": "SELECT id AS feature_id FROM tc t WHERE EXISTS (SELECT 1 FROM genes g WHERE g.seqname = t.seqname AND g.strand = t.strand AND g.s <= t.e AND g.e >= t.s)",
    "clusters_outside_genes": "SELECT id AS feature_id FROM tc t WHERE NOT EXISTS (SELECT 1 FROM genes g WHERE g.seqname = t.seqname AND g.strand = t.strand AND g.s <= t.e AND g.e >= t.s)",
    "tx_type": f"SELECT t.id AS feature_id, coalesce(arg_min(m.category, m.k), 'intergenic') AS \"txType\" FROM tc t LEFT JOIN ({models(500, False)}) m ON m.seqname = t.seqname AND m.strand = t.strand AND m.s <= t.e AND m.e >= t.s GROUP BY 1",
    "tx_type_swapped": f"SELECT t.id AS feature_id, coalesce(arg_min(m.category, m.k), 'intergenic') AS \"txType\" FROM tc t LEFT JOIN ({models(1000, True)}) m ON m.seqname = t.seqname AND m.strand = t.strand AND t.peak BETWEEN m.s AND m.e GROUP BY 1",
    "gene_id": nearest_gene(1000, 100, "t.s", "t.e"),
    "gene_id_swapped": nearest_gene(200, 50, "t.peak", "t.peak"),
    "tx_id": "SELECT t.id AS feature_id, string_agg('t' || g.row_idx, ';' ORDER BY g.row_idx) AS \"txID\" FROM tc t LEFT JOIN genes g ON g.seqname = t.seqname AND g.strand = t.strand AND g.s <= t.e AND g.e >= t.s GROUP BY 1",
    "tx_id_models": widened_tx(100, "t.s", "t.e"),
    "tx_id_swapped": widened_tx(1000, "t.peak", "t.peak"),
    "tx_id_compat": widened_tx(100, "t.s", "t.e"),
    "gene_id_models": nearest_gene(300, 50, "t.s", "t.e", "gene_id"),
    "missing_id": "SELECT id AS feature_id, CASE WHEN gene IS NULL THEN 'Novel' || row_number() OVER (PARTITION BY gene IS NULL ORDER BY CAST(substr(seqname, 4) AS BIGINT), strand, s, e) ELSE gene END AS \"geneID\" FROM tc LEFT JOIN plain USING (id)",
    "combined_clusters": "SELECT t.id AS feature_id, t.seqname, t.s AS start, t.e AS \"end\", t.strand, round(t.n / 1e9, 6) AS score FROM tc t WHERE NOT EXISTS (SELECT 1 FROM loci l WHERE l.seqname = t.seqname AND l.s <= t.e AND l.e >= t.s) UNION ALL SELECT l.id, l.seqname, l.s, l.e, '*', round(x.n / 1e9, 6) FROM loci l JOIN loci_scores x USING (id)",
    "combined_right": "SELECT t.id AS feature_id, t.seqname, t.s AS start, t.e AS \"end\", t.strand, round(t.n / 1e9, 6) AS score FROM tc t UNION ALL SELECT l.id, l.seqname, l.s, l.e, '*', round(x.n / 1e9, 6) FROM loci l JOIN loci_scores x USING (id) WHERE NOT EXISTS (SELECT 1 FROM tc t WHERE l.seqname = t.seqname AND l.s <= t.e AND l.e >= t.s)",
    "combined_all": "SELECT t.id AS feature_id, t.seqname, t.s AS start, t.e AS \"end\", t.strand, round(t.n / 1e9, 6) AS score FROM tc t UNION ALL SELECT l.id, l.seqname, l.s, l.e, '*', round(x.n / 1e9, 6) FROM loci l JOIN loci_scores x USING (id)",
    "swapped_ranges": 'SELECT id AS feature_id, peak AS start, peak AS "end", s AS whole_start, e AS whole_end FROM tc',
    "swapped_scores": "SELECT t.id AS feature_id, coalesce(c.counts, 0) AS score FROM tc t LEFT JOIN counted c ON c.id = t.id AND c.sample = 's3'",
    "bidir_regions": 'SELECT seqname, s AS start, e AS "end" FROM regions',
    "balance_bases": "SELECT seqname, pos, round(pd, 6) AS pd, round(md, 6) AS md, round(pu, 6) AS pu, round(mu, 6) AS mu, round(b, 6) AS balance FROM balanced WHERE pd + md + pu + mu > 0",
    "balance_directional": f"SELECT seqname || ':' || (min(pos) - {W - 1}) || '-' || (max(pos) + {W - 1}) AS feature_id, seqname, min(pos) - {W - 1} AS start, max(pos) + {W - 1} AS \"end\", round(max(b), 6) AS balance FROM (SELECT *, sum(f) OVER (PARTITION BY seqname ORDER BY pos) AS k FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY seqname ORDER BY pos) <= {2 * (W - 1)} THEN 0 ELSE 1 END AS f FROM (SELECT seqname, pos, CASE WHEN pd + md = 0 THEN 0 ELSE abs(abs((pd - md) / (pd + md)) - 1) END AS b FROM balanced) WHERE b > 0.8)) GROUP BY seqname, k",
    "tracks_balance": "SELECT seqname, pos, round(pd, 6) AS pd, round(md, 6) AS md, round(pu, 6) AS pu, round(mu, 6) AS mu, round(b, 6) AS balance FROM full_balanced WHERE pd + md + pu + mu > 0",
    "bidir_clusters": "SELECT id AS feature_id, seqname, s AS start, e AS \"end\", '*' AS strand, round(n / 1e9, 6) AS score, peak AS thick_start, peak AS thick_end, round(top, 6) AS balance FROM loci JOIN loci_scores USING (id)",
    "bidirectional_samples": "SELECT id AS feature_id, CAST(count(*) FILTER (p > 0 AND m > 0) AS INTEGER) AS bidirectionality FROM arms GROUP BY 1",
    "shape_iqrs": 'SELECT id AS feature_id, CAST(min(pos) FILTER (fwd >= total * 0.75) - min(pos) FILTER (fwd >= total * 0.25) AS DOUBLE) AS "IQR" FROM profile GROUP BY 1',
    "shape_entropies": "SELECT id AS feature_id, round(-sum(n / total * log2(n / total)) + 0.0, 6) AS entropy FROM profile GROUP BY 1",
    "shape_means": "SELECT id AS feature_id, (e - s + 2) / 2 AS mean, round(sum((pos - s + 1) * CAST(n AS DOUBLE)) / sum(CAST(n AS DOUBLE)), 6) AS weighted_mean FROM profile GROUP BY id, s, e",
    "trim_symmetric": flat("sym"),
    "trim_asymmetric": flat("asy"),
    "trim_peak": flat("pk"),
    "stretches": 'SELECT seqname, s AS start, e AS "end", n AS "nClusters", members FROM stretch',
    "stretches_cor": f"SELECT t.seqname || ':' || t.s || '-' || t.e AS feature_id, t.n AS \"nClusters\", x.r AS \"aveCor\" FROM stretch t JOIN (SELECT seqname, k, CASE WHEN count(*) = count(r) THEN round(avg(r), 6) END AS r FROM (SELECT a.seqname, a.k, {corr('va.v', 'vb.v')} AS r FROM stretch_members a JOIN stretch_members b ON a.seqname = b.seqname AND a.k = b.k AND (a.s, a.e, a.id) < (b.s, b.e, b.id) JOIN vec va ON va.id = a.id JOIN vec vb ON vb.id = b.id) GROUP BY 1, 2) x USING (seqname, k)",
    "links": "SELECT i AS anchor1, j AS anchor2, d AS distance FROM link WHERE (s1, e1, i) < (s2, e2, j)",
    "links_directional": f"SELECT i AS anchor1, j AS anchor2, d AS distance, CASE WHEN (strand1 = '+' AND {MID1} >= {MID2}) OR (strand1 != '+' AND {MID1} <= {MID2}) THEN 'upstream' ELSE 'downstream' END AS orientation FROM link WHERE s1 % 2 = 0 AND s2 % 2 = 1",
    "links_cor": f"SELECT i AS anchor1, j AS anchor2, d AS distance, round({corr('va.v', 'vb.v')}, 6) AS estimate FROM link JOIN vec va ON va.id = i JOIN vec vb ON vb.id = j WHERE d <= 20 AND (s1, e1, i) < (s2, e2, j)",
    "tracks_ctss": "SELECT seqname, pos AS start, pos AS \"end\", round(coalesce(sum(n) FILTER (strand = '+'), 0) / 1e9, 6) AS plus, round(-coalesce(sum(n) FILTER (strand = '-'), 0) / 1e9, 6) AS minus FROM pooled GROUP BY 1, 2",
    "tracks_clusters": "SELECT * FROM (SELECT seqname, s AS start, peak - 1 AS \"end\", 'thin' || CASE strand WHEN '+' THEN 'Plus' ELSE 'Minus' END AS feature, id AS transcript FROM tc UNION ALL SELECT seqname, peak, peak, 'thick' || CASE strand WHEN '+' THEN 'Plus' ELSE 'Minus' END, id FROM tc UNION ALL SELECT seqname, peak + 1, e, 'thin' || CASE strand WHEN '+' THEN 'Plus' ELSE 'Minus' END, id FROM tc) WHERE start <= \"end\"",
    "tracks_links": "SELECT i AS anchor1, j AS anchor2, d AS distance, seq AS seqname1, s1 AS start1, e1 AS end1, seq AS seqname2, s2 AS start2, e2 AS end2 FROM link WHERE d <= 20 AND (s1, e1, i) < (s2, e2, j)",
    "genome_tiles": "SELECT 'chr' || s_suppkey AS seqname, CAST(i AS BIGINT) AS start, CAST(least(i + 2999, 10000) AS BIGINT) AS \"end\" FROM supplier, (SELECT unnest([1, 3001, 6001, 9001]) AS i)",
    "expanded_ranges": "SELECT gene_id, e - s + 1 AS n, CAST((s + e) * (e - s + 1) // 2 AS BIGINT) AS total FROM genes",
    "gene_cover": "SELECT g.seqname, g.strand, i AS pos, count(*) AS value FROM genes g, (SELECT unnest(generate_series(1, 10000)) AS i) WHERE i BETWEEN g.s AND g.e GROUP BY 1, 2, 3",
    "gene_depth_over": "SELECT seqname, strand, min(i) AS start, max(i) AS \"end\" FROM (SELECT seqname, strand, i, i - row_number() OVER (PARTITION BY seqname, strand ORDER BY i) AS k FROM (SELECT g.seqname, g.strand, i FROM genes g, (SELECT unnest(generate_series(1, 10000)) AS i) WHERE i BETWEEN g.s AND g.e GROUP BY 1, 2, 3 HAVING count(*) > 1)) GROUP BY seqname, strand, k",
    "gene_parts": "SELECT gene_id, s + 2 AS inner_start, s + 9 AS inner_end, CASE strand WHEN '+' THEN s - 30 ELSE s - 7 END AS wide_start, CASE strand WHEN '+' THEN e + 7 ELSE e + 30 END AS wide_end, CASE strand WHEN '+' THEN '-' ELSE '+' END AS turned FROM genes",
    "genome_tiles_number": "SELECT 'chr' || s_suppkey AS seqname, CAST(a AS BIGINT) AS start, CAST(least(a + w - 1, 10000) AS BIGINT) AS \"end\" FROM (SELECT s_suppkey, w, unnest(generate_series(1, 10000, w)) AS a FROM supplier, (SELECT CAST(ceil(count(*) * 10000 / 37) AS BIGINT) AS w FROM supplier))",
    "import_bedgraph": "SELECT seqname, pos AS start, strand, sample, counts FROM ctss",
    "import_bigwig": "SELECT seqname, pos AS start, strand, sample, counts FROM ctss",
    "import_bigwig_tiles": "SELECT seqname, pos AS start, strand, sample, counts FROM ctss",
    "import_bigwig_former": "SELECT seqname, pos AS start, strand, sample, counts FROM ctss",
    "import_bam": "SELECT 'chr' || l_suppkey AS seqname, 1 + (l_orderkey*37 + l_partkey*11 + l_linenumber) % 9800 + CASE WHEN l_linestatus = 'O' THEN 0 ELSE 101 + l_partkey % 4 + l_orderkey % 4 END AS start, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, count(*) AS score FROM lineitem WHERE l_partkey % 4 + l_orderkey % 4 >= 3 GROUP BY 1, 2, 3",
    "converted_formats": "SELECT seqname, pos AS start, pos AS \"end\", strand, CAST(sum(counts) AS BIGINT) AS score FROM ctss GROUP BY 1, 2, 4",
    "reduced_genes": "SELECT seqname, strand, min(s) AS start, max(e) AS \"end\" FROM (SELECT *, sum(f) OVER (PARTITION BY seqname, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY seqname, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 < 50 THEN 0 ELSE 1 END AS f FROM genes)) GROUP BY seqname, strand, k",
    "antisense_genes": "SELECT seqname, min(i) AS start, max(i) AS \"end\" FROM (SELECT seqname, i, i - row_number() OVER (PARTITION BY seqname ORDER BY i) AS k FROM (SELECT DISTINCT g.seqname, i FROM genes g JOIN genes h ON g.seqname = h.seqname AND g.strand = '+' AND h.strand = '-' AND g.s <= h.e AND h.s <= g.e, (SELECT unnest(generate_series(1, 10000)) AS i) WHERE i BETWEEN greatest(g.s, h.s) AND least(g.e, h.e))) GROUP BY seqname, k",
    "genes_without_exons": "SELECT seqname, strand, min(i) AS start, max(i) AS \"end\" FROM (SELECT seqname, strand, i, i - row_number() OVER (PARTITION BY seqname, strand ORDER BY i) AS k FROM (SELECT DISTINCT seqname, strand, i FROM genes, (SELECT unnest(generate_series(1, 10000)) AS i) WHERE i BETWEEN s AND e EXCEPT SELECT DISTINCT seqname, strand, j FROM exons, (SELECT unnest(generate_series(1, 10000)) AS j) WHERE j BETWEEN s AND e)) GROUP BY seqname, strand, k",
    "quick_tss_counts": "SELECT id AS feature_id, sample, counts FROM counted",
    "quick_enhancer_counts": "SELECT id AS feature_id, sample, CAST(sum(counts) AS BIGINT) AS counts FROM (SELECT c.sample, c.counts, min({'s': l.s, 'e': l.e, 'id': l.id}).id AS id FROM loci l JOIN ctss c ON c.seqname = l.seqname AND c.pos BETWEEN l.s AND l.e WHERE l.id IN (SELECT id FROM arms WHERE p > 0 AND m > 0) GROUP BY c.seqname, c.pos, c.strand, c.sample, c.counts) GROUP BY 1, 2",
    "quick_gene_counts": f"SELECT \"geneID\", CAST(sum(counts) AS BIGINT) AS counts FROM counted c JOIN ({nearest_gene(1000, 100, 't.s', 't.e')}) g ON g.feature_id = c.id WHERE \"geneID\" IS NOT NULL GROUP BY 1",
    "event_sessions": "SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, k",
}
_SQL |= {
    "tx_type_summary": f"SELECT \"txType\", count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percentage FROM ({_SQL['tx_type']}) GROUP BY 1",
    "gene_id_summary": f"SELECT round(count(\"geneID\") * 100.0 / count(*), 2) AS percentage, count(DISTINCT \"geneID\") AS ids FROM ({_SQL['gene_id']})",
    "tx_id_summary": f"SELECT round(count(\"txID\") * 100.0 / count(*), 2) AS percentage, (SELECT count(DISTINCT id) FROM (SELECT unnest(string_split(\"txID\", ';')) AS id FROM ({_SQL['tx_id']}))) AS ids FROM ({_SQL['tx_id']})",
    "links_summary": f"SELECT count(*) AS n, min(distance) AS min_distance, round(avg(distance), 6) AS mean_distance, max(distance) AS max_distance FROM ({_SQL['links']})",
    "stretches_summary": f"SELECT count(*) AS n, min(e - s + 1) AS min_width, round(avg(e - s + 1), 6) AS mean_width, max(e - s + 1) AS max_width, CAST(min(n) AS INT) AS \"min_nClusters\", round(avg(n), 6) AS \"mean_nClusters\", CAST(max(n) AS INT) AS \"max_nClusters\" FROM stretch",
}
ORACLE_SQL = {name: with_parts(sql) for name, sql in _SQL.items()}
