"""Hand fixtures and brute force for the genomic engine."""

import itertools
import random
import struct
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions.balance import balance_bc, balance_d
from tidemark.model import Experiment, exact
from tidemark.operators import annotate, assay, bidirectional, checks, cluster, shape, spatial, tracks
from tidemark.plans import overlaps, ranges, tiles
from tidemark.sources import bam, bedgraph, bigwig, convert, ctss, genomes

SEQINFO = "seqname string, seqlength long, seq_rank int"
RANGE = "feature_id string, seqname string, start long, end long, strand string"


def genome(spark, length=1000):
    return spark.createDataFrame([("chr1", length, 1), ("chr2", length, 2)], SEQINFO)


def pooled(spark, rows):
    df = spark.createDataFrame(rows, "seqname string, start long, strand string, score double")
    return df.withColumn("end", F.col("start")).withColumn("score_n", exact(F.col("score")))


def small(spark):
    rows = [("chr1", 5, "+", "a", 2), ("chr1", 5, "+", "b", 4), ("chr1", 9, "+", "a", 6), ("chr1", 50, "-", "b", 1)]
    expr = spark.createDataFrame(rows, "seqname string, start long, strand string, sample string, counts long")
    samples = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "sample string, sample_rank int")
    return assay.ctss_experiment(expr, samples, genome(spark))


def test_score_overlaps(spark):
    query = spark.createDataFrame([(str(i), "c", a, b, "*") for i, (a, b) in enumerate([(4, 4), (9, 15), (10, 20), (30, 31)])], RANGE)
    subject = spark.createDataFrame([("c", 1, 2, "*", 10), ("c", 4, 4, "*", 20), ("c", 15, 20, "*", 15), ("c", 25, 26, "*", 5)], "seqname string, start long, end long, strand string, score long")
    assert [r.score for r in overlaps.score_overlaps(query, subject, "feature_id").orderBy("feature_id").collect()] == [20, 15, 15, 0]


def test_overlap_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    draw = lambda n: [(str(i), f"chr{rng.randint(1, 2)}", s := rng.randint(-20, 300), s + rng.randint(0, 40), rng.choice("+-*")) for i in range(n)]
    q, s = draw(40), draw(40)
    for gap in (-1, 0, 7):
        got = overlaps.overlap_pairs(spark.createDataFrame(q, RANGE), spark.createDataFrame(s, RANGE), gap, width=16).select("q.feature_id", F.col("s.feature_id").alias("x")).collect()
        want = [(a[0], b[0]) for a in q for b in s if a[1] == b[1] and max(a[2], b[2]) - min(a[3], b[3]) - 1 <= gap and (a[4] == b[4] or "*" in (a[4], b[4]))]
        assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("gap", [0, 1, 5])
def test_reduce_equals_brute_force_across_tiles(spark, gap):
    rng = random.Random(gap)
    rows = [("c", s := rng.randint(1, 400), s + rng.randint(0, 25), "+") for _ in range(60)]
    df = spark.createDataFrame(rows, "seqname string, start long, end long, strand string")
    found = tiles.islands(df, ["seqname", "strand"], gap, tile=32).groupBy("island").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    want = []
    for _, a, b, _ in sorted(rows, key=lambda r: r[1:3]):
        if want and a - want[-1][1] - 1 < gap:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    assert sorted((r.a, r.b) for r in found.collect()) == [tuple(w) for w in want]


def test_set_algebra(spark):
    rng = random.Random(3)
    draw = lambda: [("c", s := rng.randint(1, 80), s + rng.randint(0, 12), "+") for _ in range(8)]
    a, b = draw(), draw()
    frames = [spark.createDataFrame(x, "seqname string, start long, end long, strand string") for x in (a, b)]
    bases = [{i for r in x for i in range(r[1], r[2] + 1)} for x in (a, b)]
    for f, want in ((ranges.intersect_ranges, bases[0] & bases[1]), (ranges.setdiff_ranges, bases[0] - bases[1]), (ranges.union_ranges, bases[0] | bases[1])):
        assert {i for r in f(*frames).collect() for i in range(r.start, r.end + 1)} == want


def test_clusters_and_peaks(spark):
    rows = [("chr1", p, "+", v) for p, v in [(1, 1.0), (21, 1.0), (42, 3.0), (43, 3.0), (44, 3.0), (46, 3.0)]]
    got = {(r.start, r.end): (r.thick.start, r.score) for r in cluster.cluster_unidirectionally(pooled(spark, rows)).collect()}
    assert got == {(1, 21): (1, 2.0), (42, 46): (43, 12.0)}
    tuned = {r.threshold: r.nTCs for r in cluster.tune_tag_clustering(pooled(spark, rows), steps=3).collect()}
    assert tuned == {0.0: 2, 1.0: 1, 3.0: 0}
    counted = cluster.tune_tag_clustering(pooled(spark, rows), steps=2, method="exponential").collect()
    assert sorted(r.threshold for r in counted) == [0.0, 1.0, 2.0]


def test_shapes(spark):
    sharp, broad = [1, 1, 1, 4, 5, 2, 1, 1], [1, 2, 3, 5, 4, 3, 2, 1]
    rows = [(c, i + 1, "+", float(v)) for c, x in (("chr1", sharp), ("chr2", broad)) for i, v in enumerate(x)]
    p = pooled(spark, rows)
    tcs = cluster.cluster_unidirectionally(p)
    got = shape.shape_multimodality(shape.shape_weighted_mean(shape.shape_mean(shape.shape_entropy(shape.shape_iqr(tcs, p), p)), p), p).orderBy("seqname").collect()
    assert [r.IQR for r in got] == [1, 3] and [r["mean"] for r in got] == [4.5, 4.5]
    assert [round(r.entropy, 9) for r in got] == [2.649397470, 2.815202400]
    assert got[0].weighted_mean == pytest.approx(np.dot(range(1, 9), sharp) / 16)
    assert [r.multimodality for r in got] == [0.0, 0.0]
    assert shape.multimodality(np.array([3.0, 0, 3])) > 0
    assert {r.span for r in shape.calc_shape(tcs, p, lambda x: x.max() - x.min(), "span").collect()} == {4.0}


def test_trims(spark):
    rows = [("chr1", i + 1, "+", float(v)) for i, v in enumerate([1, 1, 1, 4, 5, 2, 1, 1])]
    p = pooled(spark, rows)
    tcs = cluster.cluster_unidirectionally(p)
    assert [(r.start, r.end) for r in cluster.trim_to_percentiles(tcs, p, 1.0).collect()] == [(1, 8)]  # nothing is over 1
    assert [(r.start, r.end) for r in cluster.trim_to_percentiles(tcs, p, 0.25, symmetric=True).collect()] == [(2, 7)]
    assert [(r.start, r.end) for r in cluster.trim_to_peak(tcs, p, 1, 2).collect()] == [(4, 6)]
    with pytest.raises(ValueError):
        cluster.trim_to_percentiles(tcs, p, 0)


def test_balance_functions(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    got = df.select(balance_bc(*map(F.col, "abcd")), balance_d(*map(F.col, "abcd"))).collect()
    assert [tuple(round(x, 6) for x in r) for r in got] == [(1.0, 1.0), (0.707107, 0.0), (0.0, 0.0)]


def test_window_segments_equal_dense_sums(spark):
    rng, length, w, h = np.random.default_rng(5), 60, 7, 3
    signal = {s: (rng.random(length) < 0.2) * rng.integers(1, 9, length) for s in "+-"}
    points = pooled(spark, [("chr1", int(i + 1), s, float(signal[s][i])) for s in "+-" for i in np.flatnonzero(signal[s])])
    got = np.zeros((4, length))
    for r in bidirectional.window_segments(points, genome(spark, length), w).collect():
        got[:, r.start - 1 : r.end] = np.array([r.PD, r.MD, r.PU, r.MU])[:, None] / 1e9
    def running(x):
        s = np.array([x[max(0, i - h) : i + h + 1].sum() for i in range(length)], dtype=float)
        s[:h], s[length - h :] = s[h], s[length - h - 1]
        return s
    plus, minus, pad = running(signal["+"]), running(signal["-"]), np.zeros(h)
    ahead, back = (lambda x: np.concatenate([x[h:], pad])), (lambda x: np.concatenate([pad, x[: length - h]]))
    assert np.allclose(got, [ahead(plus), back(minus), back(plus), ahead(minus)])


def test_bidirectional_locus(spark):
    rows = [("chr1", 500, "-", 10.0), ("chr1", 520, "+", 10.0), ("chr2", 100, "+", 5.0)]
    p = pooled(spark, rows)
    loci = bidirectional.cluster_bidirectionally(p, genome(spark), 51, 0.9).collect()
    assert [(r.seqname, r.thick.start, r.score) for r in loci] == [("chr1", 510, 20.0)]
    with pytest.raises(ValueError):
        bidirectional.cluster_bidirectionally(p, genome(spark), 50)


def test_assays(spark):
    exp = assay.calc_tpm(small(spark))
    assert {r.sample: r.totalTags for r in exp.samples.collect()} == {"a": 8, "b": 5, "c": 0}
    assert exp.expr.filter("sample = 'a'").agg(F.sum("TPM")).first()[0] == pytest.approx(1e6)
    scores = {r.start: r.score for r in assay.calc_pooled(exp).features.collect()}
    assert scores[5] == pytest.approx(2 / 8 * 1e6 + 4 / 5 * 1e6)
    assert {r.start: r.support for r in assay.calc_support(small(spark), unexpressed=2).features.collect()} == {5: 1, 9: 1, 50: 0}
    assert {r.support for r in assay.calc_support(small(spark), unexpressed=-1).features.collect()} == {3}
    assert sorted(r.start for r in assay.subset_by_support(small(spark), min_samples=1).features.collect()) == [5]
    with pytest.raises(ValueError):
        assay.calc_tpm(small(spark), assay="none")
    swapped = assay.swap_scores(small(spark), "b").features.collect()
    assert {r.start: r.score for r in swapped} == {5: 4, 9: 0, 50: 1}


def test_quantify_and_genes(spark):
    clusters = spark.createDataFrame([("x", "chr1", 1, 10, "+"), ("y", "chr1", 40, 60, "*"), ("z", "chr2", 1, 5, "+")], RANGE)
    exp = assay.quantify_clusters(small(spark), clusters, dense=True)
    assert {(r.feature_id, r.sample): r.counts for r in exp.expr.filter("counts > 0").collect()} == {("x", "a"): 8, ("x", "b"): 4, ("y", "b"): 1}
    assert exp.expr.count() == 9
    named = exp.with_(features=exp.features.withColumn("geneID", F.when(F.col("feature_id") != "z", F.lit("g"))))
    genes = assay.quantify_genes(named)
    assert [(r.feature_id, r.nClusters) for r in genes.features.collect()] == [("g", 2)]
    assert genes.expr.agg(F.sum("counts")).first()[0] == 13
    kept = assay.calc_composition(named.with_(features=named.features.filter("geneID = 'g'")), unexpressed=0.5).features.collect()
    assert {r.feature_id: r.composition for r in kept} == {"x": 2, "y": 0}
    filled = assay.assign_missing(named.features, genome(spark)).collect()
    assert {r.feature_id: r.geneID for r in filled}["z"] == "Novel1"


def test_aggregate_rows(spark):
    df = spark.createDataFrame([(g, 1) for g in (1, 1, None, None, 3, 3, None, None, 5, 5)], "g int, v int")
    assert {r.g: r.v for r in assay.aggregate_rows(df, "g", ["v"]).collect()} == {1: 2, 3: 2, 5: 2}
    assert {r.g: r.v for r in assay.aggregate_rows(df, "g", ["v"], [1, 2, 3, 4, 5], drop=False).collect()} == {1: 2, 2: 0, 3: 2, 4: 0, 5: 2}


def test_annotation_ties(spark):
    features = spark.createDataFrame([("f", "chr1", 100, 110, "+"), ("n", "chr2", 1, 2, "-")], RANGE)
    genes = spark.createDataFrame([("b", 2, "chr1", 90, 300, "+"), ("a", 1, "chr1", 120, 300, "+"), ("c", 3, "chr1", 100, 110, "-")], "gene_id string, row_idx long, seqname string, start long, end long, strand string")
    got = {r.feature_id: r.geneID for r in annotate.assign_gene_id(features, genes, genome(spark)).collect()}
    assert got == {"f": "a", "n": None}  # equal distances: the first gene
    tx = genes.withColumnRenamed("gene_id", "tx_id")
    assert {r.feature_id: r.txID for r in annotate.assign_tx_id(features, tx).collect()} == {"f": "b", "n": None}
    categories = tx.filter("strand = '+'").select("seqname", "start", "end", "strand", F.lit("exon").alias("category"), F.lit(3).alias("hierarchy"))
    assert {r.txType for r in annotate.assign_tx_type(features, categories).collect()} == {"exon", "intergenic"}
    assert annotate.combine_clusters(features, features, "object1").count() == 2


def test_links_and_stretches(spark):
    features = spark.createDataFrame([("a", "chr1", 1, 5, "+"), ("b", "chr1", 10, 12, "+"), ("c", "chr1", 11, 14, "-"), ("d", "chr1", 400, 410, "*")], RANGE)
    got = {(r.anchor1, r.anchor2): r.distance for r in spatial.find_links(features, 10).collect()}
    assert got == {("a", "b"): 4}
    assert [(r.start, r.end, r.nClusters) for r in spatial.find_stretches(features, 5, 3).collect()] == [(1, 14, 3)]
    assert spatial.find_stretches(features, 4, 3).count() == 0
    assert tracks.track_clusters(features.withColumn("thick", F.struct("start", F.col("start").alias("end")))).filter("feature LIKE 'thick%'").count() == 4


def test_correlations():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([2.0, 1, 4, 3, 5])
    assert stats.pearson(x, y)[0] == pytest.approx(0.8) and stats.pearson(x, y)[1] == pytest.approx(0.1040880, abs=1e-6)
    assert stats.spearman(x, y * y)[0] == pytest.approx(0.8)
    assert stats.kendall(x, y) == (pytest.approx(0.6), pytest.approx(0.2333333, abs=1e-6))
    assert stats.pearson(x, np.ones(5)) == (None, None) and stats.kendall(x, np.ones(5)) == (None, None)
    assert 0 < stats.kendall(np.array([1.0, 1, 2, 3]), np.array([1.0, 2, 2, 3]))[1] < 1


def test_file_round_trips(spark, tmp_path):
    lengths = {"chr1": 1000, "chr2": 1000, "chr10": 500}
    seqinfo = genomes.make_seqinfo(spark, lengths)
    assert [r.seqname for r in seqinfo.orderBy("seq_rank").collect()] == ["chr1", "chr2", "chr10"]
    rows = [("chr1", 5, 5, "+", 2.0), ("chr1", 900, 900, "+", 7.0), ("chr10", 500, 500, "-", 1.0)]
    bed = spark.createDataFrame(rows, "seqname string, start long, end long, strand string, score double")
    bedgraph.write_bed(bed, f"{tmp_path}/in.bed")
    convert.bed_to_bigwig(spark, f"{tmp_path}/in.bed", f"{tmp_path}/p.bw", f"{tmp_path}/m.bw", seqinfo)
    convert.bigwig_to_bed(spark, f"{tmp_path}/p.bw", f"{tmp_path}/m.bw", f"{tmp_path}/out.bed")
    back = bedgraph.read_bed(spark, f"{tmp_path}/out.bed").select(*bed.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    convert.bed_to_bedgraph(spark, f"{tmp_path}/in.bed", f"{tmp_path}/p.bedGraph", f"{tmp_path}/m.bedGraph")
    one = ctss.ctss_from_bigwig(spark, {"s": f"{tmp_path}/p.bw"}, {"s": f"{tmp_path}/m.bw"}, tile_width=300)
    two = ctss.ctss_from_bedgraph(spark, {"s": f"{tmp_path}/p.bedGraph"}, {"s": f"{tmp_path}/m.bedGraph"}, seqinfo)
    assert sorted(map(tuple, one.expr.collect())) == sorted(map(tuple, two.expr.collect())) == sorted((c, a, s, "s", v) for c, a, _, s, v in rows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    only = bigwig.read_bigwig(spark, f"{tmp_path}/p.bw", "+").filter("seqname = 'chr1' AND start > 100")
    assert [r.score for r in only.collect()] == [7.0]
    with pytest.raises(ValueError):
        genomes.check_bigwigs({"s": f"{tmp_path}/in.bed"})


def test_bigwig_with_many_blocks(tmp_path):
    rows = [("c", i * 3, i * 3 + 1, float(i % 7)) for i in range(300_000)]
    (tmp_path / "x.bw").write_bytes(bigwig.bigwig_bytes(rows, {"c": 1_000_000}))
    file = bigwig.BigWig(str(tmp_path / "x.bw"))
    assert list(file.records(file.blocks())) == rows
    assert len(file.blocks({0}, (0, 100))) == 1


def test_bam_five_prime_ends(spark, tmp_path):
    reads = [("chr1", 10, "20M", "+"), ("chr1", 10, "5M100N5M", "-"), ("chr1", 10, "3M", "+")]
    (tmp_path / "x.bam").write_bytes(bam.bam_bytes(reads, {"chr1": 1000}))
    got = bam.reads_to_ctss(bam.read_bam(spark, f"{tmp_path}/x.bam"), min_length=4)
    assert sorted((r.start, r.strand, r.score) for r in got.collect()) == [(10, "+", 1), (119, "-", 1)]


def indexed(path):
    """An index with the places of some alignments, and beside them a bin of numbers."""
    stream = bam.Stream(str(path))
    bam.names_of(stream)
    at = []
    while True:
        at.append(stream.tell())
        if not (size := stream.take(4)):
            break
        stream.take(struct.unpack("<i", size)[0])
    at = at[:-1:50]
    bins = struct.pack("<Ii", 4681, 1) + struct.pack("<QQ", at[0], at[-1]) + struct.pack("<Ii", 37450, 2) + struct.pack("<4Q", 1 << 40, 2, 3, 4)
    return b"BAI\1" + struct.pack("<i", 1) + struct.pack("<i", 2) + bins + struct.pack("<i", len(at)) + struct.pack(f"<{len(at)}Q", *at), at


def test_bam_split_by_its_index(spark, tmp_path):
    """Pieces of a file hold every read once, also those that lie across blocks."""
    rng = random.Random(5)
    reads = [("chr1", i // 3 + 1, f"{rng.randint(1, 30)}M", rng.choice("+-")) for i in range(20_000)]
    path = tmp_path / "x.bam"
    path.write_bytes(bam.bam_bytes(reads, {"chr1": 10_000}))
    whole = [r[:4] for r in bam.alignments(str(path))]
    assert whole == [(c, a, a + int(n[:-1]) - 1, s) for c, a, n, s in reads]
    assert len(bam.pieces(str(path), 1)) == 1
    raw, at = indexed(path)
    (tmp_path / "x.bam.bai").write_bytes(raw)
    assert bam.indexed_offsets(raw) == at
    parts = bam.pieces(str(path), 1)
    assert len(parts) > 5 and [r[:4] for p in parts for r in bam.alignments(p.path, p.low, p.high)] == whole
    got = bam.read_bam(spark, str(path), split=1)
    assert got.rdd.getNumPartitions() == len(parts)
    assert sorted((r.seqname, r.start, r.end, r.strand) for r in got.filter("quality >= 60 AND flag IN (0, 16)").collect()) == sorted(whole)
    path.write_bytes(path.read_bytes()[:-5])
    with pytest.raises(ValueError, match="ends within"):
        list(bam.alignments(str(path)))


def test_bigwig_of_many_sequences(tmp_path, monkeypatch):
    lengths = {f"s{i}": 50 for i in range(70_000)}  # more names than one node can count
    rows = [(f"s{i}", 7, 8, 1.0) for i in range(0, 70_000, 7)]
    (tmp_path / "x.bw").write_bytes(bigwig.bigwig_bytes(rows, lengths))
    file = bigwig.BigWig(str(tmp_path / "x.bw"))
    assert file.header.chromosomes == {n: (i, 50) for i, n in enumerate(sorted(lengths))}
    reader = bigwig.BigWigReader({"path": str(tmp_path / "x.bw"), "tileWidth": "20"})
    assert len(reader.partitions()) == 1  # tasks follow the data, not the number of sequences
    monkeypatch.setattr(bigwig, "TASK_BYTES", 1 << 16)
    parts = reader.partitions()
    got = [tuple(r) for part in parts for batch in reader.read(part) for r in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)]
    assert len(parts) > 3 and sorted(got) == sorted((n, a + 1, b, v) for n, a, b, v in rows)
    dense = [("c", i * 3, i * 3 + 1, float(i % 7)) for i in range(300_000)]
    (tmp_path / "y.bw").write_bytes(bigwig.bigwig_bytes(dense, {"c": 1_000_000}))
    reader = bigwig.BigWigReader({"path": str(tmp_path / "y.bw"), "tileWidth": "1000"})
    parts = reader.partitions()
    assert len(parts) > 3 and all(p.low is None or p.low[1] % 1000 == 0 for p in parts)
    assert len(bigwig.BigWigReader({"path": str(tmp_path / "y.bw")}).partitions()) > 3  # no task holds a whole file either
    assert sum((batch.column(1).to_pylist() for p in parts for batch in reader.read(p)), []) == [a + 1 for _, a, _, _ in dense]


def test_bigwig_of_many_tasks(spark, tmp_path):
    """Sections packed by many tasks make the same file as one task's, and an empty table an empty file."""
    rng = random.Random(6)
    lengths = {"a": 200_000, "b": 90_000, "c": 10}
    rows = [(c, p, p, "+", float(rng.randint(1, 9))) for c in "ab" for p in sorted(rng.sample(range(1, lengths[c]), 30_000))]
    df = spark.createDataFrame(rows, "seqname string, start long, end long, strand string, score double").repartition(7)
    seqinfo = genomes.make_seqinfo(spark, lengths)
    bigwig.write_bigwig(df, seqinfo, f"{tmp_path}/x.bw")
    file = bigwig.BigWig(f"{tmp_path}/x.bw")
    assert list(file.records(file.blocks())) == [(c, a - 1, b, v) for c, a, b, _, v in rows]
    assert {r[0] for r in file.records(file.blocks({1}))} == {"b"}
    bigwig.write_bigwig(df.filter("seqname = 'c'"), seqinfo, f"{tmp_path}/none.bw")
    none = bigwig.BigWig(f"{tmp_path}/none.bw")
    assert list(none.records(none.blocks())) == [] and list(none.header.chromosomes) == ["a", "b", "c"]


def test_checks(spark):
    df = spark.createDataFrame([("c", 1, 1, "+", 2.0), ("c", 1, 1, "+", 2.0)], "seqname string, start long, end long, strand string, score double")
    with pytest.raises(ValueError, match="more than once"):
        checks.check_ctss(df)
    with pytest.raises(ValueError, match="whole"):
        checks.check_ctss(df.limit(1).withColumn("score", F.lit(0.5)))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert checks.check_ctss(df.limit(1))
    with pytest.raises(ValueError):
        checks.check_peaked(df.withColumn("thick", F.struct(F.lit(5).alias("start"), F.lit(6).alias("end"))))
    positions = convert.ranges_to_positions(spark.createDataFrame([("chr2", 1, 5, "*", 2), ("chr2", 10, 10, "*", 1), ("chr3", 5, 5, "*", 3), ("chr4", 3, 4, "*", 11)], "seqname string, start long, end long, strand string, score long"))
    assert positions.count() == 9 and positions.agg(F.sum("score")).first()[0] == 36


def test_experiments_keep_their_kind(spark):
    exp = small(spark)
    assert isinstance(assay.subset(exp, "strand = '+'"), Experiment)
    assert assay.subset(exp, "strand = '+'").expr.count() == 3


def test_multimodality_equals_brute_force():
    """Every mode, both isotonic fits by the max-min formula over all blocks."""

    def rising(y):
        n = len(y)
        fit = [max(min(np.mean(y[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        return float(((np.array(y) - fit) ** 2).sum()) if n else 0.0

    rng = random.Random(3)
    for _ in range(150):
        x = np.array([rng.choice([0, 0, 1, 2, 3.5, 7]) for _ in range(rng.randint(1, 9))])
        want = min(rising(x[: k + 1]) + rising(x[k:][::-1]) for k in range(len(x)))
        assert shape.multimodality(x) == pytest.approx(want, abs=1e-9)


def test_link_p_values_equal_brute_force():
    """Student's law by summing its density, Kendall's by going through all orders."""
    rng = np.random.default_rng(4)
    for n in (3, 5, 7, 12):
        for _ in range(5):
            x, y = rng.normal(size=(2, n))
            r, p = stats.pearson(x, y)
            t, df = abs(r) * np.sqrt((n - 2) / (1 - r * r)), n - 2
            u = (np.arange(2_000_000) + 0.5) / 2_000_000  # from t on, as t / u
            tail = np.mean((1 + (t / u) ** 2 / df) ** (-(df + 1) / 2) * t / u**2)
            at = (np.arange(2_000_000) + 0.5) / 2_000_000 * np.pi / 2
            whole = np.mean((1 + np.tan(at) ** 2 / df) ** (-(df + 1) / 2) / np.cos(at) ** 2) * np.pi / 2
            assert p == pytest.approx(tail / whole, rel=1e-4)
    sign = lambda v: np.sign(v[:, None] - v[None, :])
    for n in (3, 4, 5, 6):
        orders = [np.array(o) for o in itertools.permutations(range(n))]
        sums = np.array([(sign(np.arange(n)) * sign(o)).sum() / 2 for o in orders])
        for o, s in list(zip(orders, sums, strict=True))[:: max(1, len(orders) // 12)]:
            tau, p = stats.kendall(np.arange(n, dtype=float), o.astype(float))
            assert tau == pytest.approx(s / (n * (n - 1) / 2)) and p == pytest.approx(min(1.0, 2 * min(np.mean(sums <= s), np.mean(sums >= s))))


def test_designs_and_genomes(spark):
    design = spark.createDataFrame([("b", "x"), ("a", "y")], "sample string, kind string")
    got = ctss.clean_design(spark, ["b", "a"], design).orderBy("sample_rank").collect()
    assert [(r.sample, r.kind, r.sample_rank) for r in got] == [("b", "x", 1), ("a", "y", 2)]
    with pytest.raises(ValueError):
        ctss.clean_design(spark, ["a", "b"], design)
    assert checks.check_genomes(genome(spark), genome(spark))
    with pytest.raises(ValueError):
        checks.check_genomes(genome(spark), genome(spark, 999))
    points = pooled(spark, [("chr1", 5, "+", 1.0)])
    assert checks.check_pooled(points, genome(spark))
    for wrong in (points.withColumn("end", F.col("end") + 1), points.unionByName(points), points.withColumn("seqname", F.lit("chr9")), points.withColumn("score", F.lit("x"))):
        with pytest.raises(ValueError):
            checks.check_pooled(wrong, genome(spark))


def test_compatible_genomes_of_files(spark, tmp_path):
    one, two = f"{tmp_path}/one.bw", f"{tmp_path}/two.bw"
    bigwig.write_bigwig(pooled(spark, [("chr1", 5, "+", 1.0)]), genome(spark), one)
    bigwig.write_bigwig(pooled(spark, [("chr1", 5, "+", 1.0)]), genome(spark, 999), two)
    assert genomes.check_compatible({"a": one}, {"a": one}, genome(spark))
    with pytest.raises(ValueError):
        genomes.check_compatible({"a": one}, {"a": two}, genome(spark))
    with pytest.raises(ValueError):
        genomes.common_genome(spark, {"a": one}, {"a": two}, "union")


def test_runs_and_sums_across_tiles(spark):
    rng = random.Random(8)
    rows = [("k", p, rng.randint(1, 2)) for p in range(1, 200) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "key string, pos long, v long")
    value = {p: v for _, p, v in rows}
    got = tiles.ends_of_runs(df, ["key"], "pos", "v", "ends", tile=8).collect()
    assert {(r.pos, r.ends) for r in got} == {(p, value.get(p + 1) != v) for p, v in value.items()} and len(got) == len(rows)
    summed = tiles.running_sums(df, ["key"], "pos", ["v"], tile=8, totals=True).collect()
    assert {(r.pos, r.v, r.total_v) for r in summed} == {(p, sum(v for q, v in value.items() if q <= p), sum(value.values())) for p in value}


def test_peaks_are_centers_of_first_runs_at_edges(spark):
    """Runs cut by a range's end, runs over a tile's border, clusters without a merge distance."""
    at = 1 << 16
    points = pooled(spark, [("chr1", at + i, "+", 2.0) for i in range(-2, 3)] + [("chr1", at + 40, "+", 1.0)])
    got = cluster.cluster_unidirectionally(points, merge_dist=5).orderBy("start").collect()
    assert [(r.start, r.end, r.thick.start) for r in got] == [(at - 2, at + 2, at), (at + 40, at + 40, at + 40)]
    cut = spark.createDataFrame([("chr1", at - 2, at + 1, "+")], "seqname string, start long, end long, strand string")
    assert cluster.tc_stats(cut, points).first().thick.start == at - 1
    assert [r.thick.start for r in cluster.cluster_unidirectionally(points, merge_dist=0).orderBy("start").collect()] == [at - 2, at - 1, at, at + 1, at + 2, at + 40]


def test_strands_and_summaries(spark):
    exp = small(spark)
    parts = assay.split_by_strand(exp)
    assert {k: v.features.count() for k, v in parts.items()} == {"+": 2, "-": 1, "*": 0}
    assert parts["-"].expr.count() == 1 and {k: v.count() for k, v in assay.split_by_strand(exp.features).items()} == {"+": 2, "-": 1, "*": 0}
    df = spark.createDataFrame([(1, 10, "a;b", "x"), (4, 4, None, "y"), (6, 7, "b", "y")], "start long, end long, ids string, kind string")
    assert tuple(assay.id_summary(df, "ids").first()) == (66.67, 2)
    assert sorted(map(tuple, assay.label_summary(df, "kind").collect())) == [("x", 1, 33.3), ("y", 2, 66.7)]
    assert tuple(assay.range_summary(df, "start").first()) == (3, 1, 13 / 3, 10, 1, 11 / 3, 6)
    assert tuple(assay.range_summary(df.filter("false")).first()) == (0, None, None, None)


def test_sources_of_conversions_are_checked(spark, tmp_path):
    seqinfo = genomes.make_seqinfo(spark, {"chr1": 100})
    with pytest.raises(ValueError, match="can't be read"):
        convert.bed_to_bigwig(spark, f"{tmp_path}/none.bed", f"{tmp_path}/p.bw", f"{tmp_path}/m.bw", seqinfo)
    rows = spark.createDataFrame([("chr1", 5, 5, "+", 2.0)], "seqname string, start long, end long, strand string, score double")
    bedgraph.write_bed(rows, f"{tmp_path}/in.txt")
    with pytest.warns(UserWarning, match="does not end with"):
        convert.bed_to_bigwig(spark, f"{tmp_path}/in.txt", f"{tmp_path}/p.wig", f"{tmp_path}/m.bw", seqinfo)
    (tmp_path / "x.bam").write_bytes(bam.bam_bytes([("chr1", 10, "20M", "+"), ("chr1", 10, "5M", "-")], {"chr1": 100}))
    assert convert.bam_to_bigwig(spark, f"{tmp_path}/x.bam", f"{tmp_path}/bp.bw", f"{tmp_path}/bm.bw", seqinfo, where="flag = 0") == (1, 1)
    part = bigwig.bigwig_bytes([("chr1", 4, 5, 2.75)], {"chr1": 100})
    (tmp_path / "half.bw").write_bytes(part)
    former = ctss.ctss_from_bigwig_tiles(spark, {"s": f"{tmp_path}/half.bw"}, {"s": f"{tmp_path}/m.bw"}, seqinfo=seqinfo)
    assert [r.counts for r in former.expr.collect()] == [2]


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_library_sizes_do_not_deal_rows_by_sample(spark):
    """A join by sample would send all rows of a sample to one task."""
    exp = small(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for found in (assay.calc_tpm(exp).expr, assay.pool_positions(exp).features):
            assert "BroadcastHashJoin [sample" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = assay.calc_pooled(assay.calc_tpm(exp)).features.select("seqname", "start", "end", "strand", "score_n", "score")
    assert sorted(want.collect()) == sorted(assay.pool_positions(exp).features.select(want.columns).collect())


def test_islands_deal_rows_once(spark):
    df = spark.range(10).selectExpr("concat('c', id % 2) seqname", "id * 3 start", "id * 3 + 1 end")
    found = tiles.islands(df, ["seqname"], 1)
    # the rows and, read from the same exchange, their summary; all further exchanges are of summaries, one row a tile
    dealt = [e for e in exchanges(found) if "REPARTITION_BY_COL" in e]
    assert len(dealt) == 2
    assert all("__key" in e or "__s_key" in e for e in exchanges(found))


def test_runs_over_tiles(spark):
    rng = random.Random(5)
    rows = sorted({(rng.randrange(200)) for _ in range(120)})
    df = spark.createDataFrame([("k", p, p, rng.randrange(2)) for p in rows], "key string, start long, end long, v int")
    value = {r.start: r.v for r in df.collect()}
    for gap in (1, 3):
        got = tiles.islands(df, ["key"], gap, tile=8, runs=("v", "ends")).collect()
        assert len(got) == len(rows) and all(r.ends == (value.get(r.start + 1) != r.v) for r in got)
        begins = [p for i, p in enumerate(rows) if not i or p - rows[i - 1] - 1 >= gap]
        assert all(r.island == max(b for b in begins if b <= r.start) for r in got)


def test_islands_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 40), (None, 30, 31), (None, 60, 61), ("a", 3, 4)], "key string, start long, end long")
    got = {(r.key, r.start): r.island for r in tiles.islands(df, ["key"], 5, tile=8).collect()}
    assert got == {(None, 1): 1, (None, 30): 1, (None, 60): 60, ("a", 3): 3}


def test_loci_over_tiles(spark, monkeypatch):
    """What tiles find is the same whatever their width; candidates are those of a plain reading."""
    rng, w, length = random.Random(11), 9, 400
    rows = [(c, p, s, float(rng.randrange(1, 4))) for c in ("chr1", "chr2") for p in range(1, length + 1) for s in "+-" if rng.random() < 0.06]
    exp, seqinfo = pooled(spark, rows), genome(spark, length)
    found = {}
    for tile in (1 << 16, 32, 7):
        monkeypatch.setattr(bidirectional, "TILE", tile)
        regions = sorted(map(tuple, bidirectional.bidirectional_regions(exp, seqinfo, w).select("seqname", "start", "end").collect()))
        sums = sorted((r.seqname, p, r.PD, r.MD, r.PU, r.MU) for r in bidirectional.balance_segments(exp, seqinfo, w).collect() for p in range(r.start, r.end + 1))
        loci = sorted(map(tuple, bidirectional.cluster_bidirectionally(exp, seqinfo, w, 0.8).select("feature_id", "score_n", "thick", "balance").collect()))
        found[tile] = regions, sums, loci
    assert found[1 << 16] == found[32] == found[7] and all(map(len, found[7]))
    inside = set()
    for c in ("chr1", "chr2"):
        at = {s: {p for n, p, t, _ in rows if n == c and t == s} for s in "+-"}
        up = {x for p in at["+"] if p - 1 not in at["+"] for x in range(p - w + 1, p + 1)}
        down = {x for p in at["-"] if p + 1 not in at["-"] for x in range(p, p + w)}
        inside |= {(c, y) for x in up & down for y in range(x - w + 1, x + w) if 1 <= y <= length}
    assert {(c, y) for c, a, b in found[7][0] for y in range(a, b + 1)} == inside
