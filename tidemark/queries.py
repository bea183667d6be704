"""Queries for every operator over the driver's tables, read as genomic inputs (see fixtures)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures
from .functions.balance import balance_d
from .functions.intervals import extend, invert_strand, narrow, tiles
from .model import Experiment
from .operators.annotate import assign_gene_id, assign_gene_id_from_models, assign_tx_id, assign_tx_id_from_models, assign_tx_type, assign_tx_type_from_models, combine_clusters, simplify_models
from .operators.assay import (
    aggregate_rows, assign_missing, calc_composition, calc_pooled, calc_support, calc_total_tags, calc_tpm, quantify_clusters, quantify_genes, subset_by_composition, subset_by_support, id_summary, label_summary, range_summary, split_by_strand,
    swap_ranges, swap_scores, width_summary,
)
from .operators.bidirectional import balance_segments, bidirectional_regions, bidirectionality, cluster_bidirectionally
from .operators.cluster import cluster_unidirectionally, trim_to_peak, trim_to_percentiles, tune_tag_clustering
from .operators.pipelines import pooled, quick_enhancers, quick_genes, quick_tss
from .operators.shape import shape_entropy, shape_iqr, shape_mean, shape_multimodality, shape_weighted_mean
from .operators.spatial import find_links, find_links_with_correlation, find_stretches, find_stretches_with_correlation, link_correlations
from .operators.tracks import track_balance, track_clusters, track_ctss, track_links
from .plans.overlaps import overlapping, score_overlaps
from .plans.ranges import coverage, intersect_ranges, reduce_ranges, setdiff_ranges, slice_above
from .plans.settle import new_path, settled
from .sources.bam import read_bam, reads_to_ctss, write_bam_parts
from .sources.bedgraph import read_bed, write_bed, write_bedgraph
from .sources.bigwig import write_bigwig
from .sources.convert import bed_to_bedgraph, bed_to_bigwig, bedgraph_to_bed, bedgraph_to_bigwig, bigwig_to_bed, bigwig_to_bedgraph, ranges_to_positions
from .sources.ctss import ctss_from_bedgraph, ctss_from_bigwig, ctss_from_bigwig_tiles
from .streaming.sessions import sessions

WINDOW, THRESHOLD, LINK_DIST, STRETCH_DIST = 51, 0.9, 100, 10


def _round(df, *columns):
    # halves are judged on the binary value, as SQL's round does; sums of nine digits often end in one
    return df.withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c in columns})


def _flat(df):
    """The peak as two numbers and rounded scores."""
    more = ["balance"] if "balance" in df.columns else []
    flat = df.withColumns({"thick_start": F.col("thick.start"), "thick_end": F.col("thick.end")}).select("feature_id", "seqname", "start", "end", "strand", "score", "thick_start", "thick_end", *more)
    return _round(flat, "score", *more)


def _pooled(s, d):
    """Normalised and pooled positions; a query that starts from them writes them once and reads them back."""
    exp = pooled(fixtures.ctss(s, d))
    return exp.with_(features=settled(exp.features))


def _clusters(s, d):
    exp = _pooled(s, d)
    return exp, settled(cluster_unidirectionally(exp))


def _quantified(s, d):
    exp, tcs = _clusters(s, d)
    exp = quantify_clusters(exp, tcs)
    return exp.with_(expr=settled(exp.expr))


def _with_genes(s, d):
    exp = _quantified(s, d)
    return assign_gene_id(exp, fixtures.genes(s, d), exp.seqinfo, upstream=0, downstream=0)


def _in_genes(s, d):
    exp = _with_genes(s, d)
    kept = settled(exp.features.filter("geneID IS NOT NULL"))
    return exp.with_(features=kept, expr=exp.expr.join(kept.select("feature_id"), "feature_id", "left_semi"))


def _loci(s, d):
    exp = _pooled(s, d)
    return exp, settled(cluster_bidirectionally(exp, exp.seqinfo, WINDOW, THRESHOLD))


def total_tags(s, d):
    return calc_total_tags(fixtures.ctss(s, d)).samples.select("sample", F.col("totalTags").cast("long").alias("totalTags"))


def tpm(s, d):
    return _round(calc_tpm(fixtures.ctss(s, d)).expr.select("seqname", "start", "strand", "sample", "counts", "TPM"), "TPM")


def pooled_scores(s, d):
    return _round(calc_pooled(calc_tpm(fixtures.ctss(s, d))).features.select("seqname", "start", "strand", "score"), "score")


def support(s, d):
    return calc_support(fixtures.ctss(s, d), unexpressed=10).features.select("seqname", "start", "strand", "support")


def support_negative(s, d):
    """Absent rows count, too: every position has the support of all samples."""
    return calc_support(fixtures.ctss(s, d), unexpressed=-1).features.select("seqname", "start", "strand", "support")


def subset_support(s, d):
    return subset_by_support(_quantified(s, d), unexpressed=0, min_samples=1).features.select("feature_id", "support")


def composition(s, d):
    return calc_composition(_in_genes(s, d), unexpressed=0.1).features.select("feature_id", "geneID", "composition")


def subset_composition(s, d):
    return subset_by_composition(_in_genes(s, d), unexpressed=0.1, min_samples=1).features.select("feature_id", "composition")


def tag_clusters(s, d):
    return _flat(_clusters(s, d)[1])


def tag_clusters_cutoff(s, d):
    return _flat(cluster_unidirectionally(_pooled(s, d), cutoff=2.0, merge_dist=5))


def cluster_widths(s, d):
    return _round(width_summary(_clusters(s, d)[1]), "percent")


def tune_thresholds(s, d):
    return _round(tune_tag_clustering(_pooled(s, d), steps=5, merge_dist=20), "threshold")


def tune_exponential(s, d):
    return _round(tune_tag_clustering(_pooled(s, d), steps=4, merge_dist=20, method="exponential", max_exponent=6), "threshold")


def quantify_tag_clusters(s, d):
    return _quantified(s, d).expr.select("feature_id", "sample", F.col("counts").cast("long").alias("counts"))


def quantify_dense(s, d):
    exp, tcs = _clusters(s, d)
    return quantify_clusters(exp, tcs, dense=True).expr.select("feature_id", "sample", F.col("counts").cast("long").alias("counts"))


def quantified_genes(s, d):
    exp = quantify_genes(_with_genes(s, d))
    return exp.expr.join(exp.features.select("feature_id", "nClusters"), "feature_id").select(F.col("feature_id").alias("geneID"), "nClusters", "sample", F.col("counts").cast("long").alias("counts"))


def aggregated_rows(s, d):
    supplier = s.read.parquet(f"{d}/supplier.parquet").withColumn("group", F.when(F.col("s_nationkey") % 5 != 0, F.col("s_nationkey"))).withColumn("v", F.col("s_suppkey"))
    return aggregate_rows(supplier, "group", ["v"], list(range(25)), drop=False)


def overlap_scores(s, d):
    genes = fixtures.genes(s, d).withColumnRenamed("gene_id", "feature_id")
    exp = fixtures.ctss(s, d)
    score = exp.expr.groupBy("seqname", "start", "strand").agg(F.sum("counts").alias("score")).withColumn("end", F.col("start"))
    return score_overlaps(genes, score, "feature_id").select("feature_id", F.col("score").cast("long").alias("score"))


def clusters_in_genes(s, d):
    return overlapping(_clusters(s, d)[1], fixtures.genes(s, d), "feature_id").select("feature_id")


def clusters_outside_genes(s, d):
    return overlapping(_clusters(s, d)[1], fixtures.genes(s, d), "feature_id", anti=True).select("feature_id")


def tx_type(s, d):
    exp, tcs = _clusters(s, d)
    return assign_tx_type_from_models(tcs, fixtures.transcripts(s, d), exp.seqinfo, proximal_upstream=500).select("feature_id", "txType")


def tx_type_swapped(s, d):
    exp, tcs = _clusters(s, d)
    models = simplify_models(fixtures.transcripts(s, d), exp.seqinfo, detailed_antisense=True)
    return assign_tx_type(tcs, models, swap="thick").select("feature_id", "txType")


def gene_id(s, d):
    exp, tcs = _clusters(s, d)
    return assign_gene_id(tcs, fixtures.genes(s, d), exp.seqinfo).select("feature_id", "geneID")


def gene_id_swapped(s, d):
    exp, tcs = _clusters(s, d)
    return assign_gene_id(tcs, fixtures.genes(s, d), exp.seqinfo, swap="thick", upstream=200, downstream=50).select("feature_id", "geneID")


def tx_id(s, d):
    tx = fixtures.transcripts(s, d).transcripts
    return assign_tx_id(_clusters(s, d)[1], tx).select("feature_id", "txID")


def tx_id_models(s, d):
    exp, tcs = _clusters(s, d)
    return assign_tx_id_from_models(tcs, fixtures.transcripts(s, d), exp.seqinfo, upstream=100).select("feature_id", "txID")


def tx_id_swapped(s, d):
    exp, tcs = _clusters(s, d)
    return assign_tx_id_from_models(tcs, fixtures.transcripts(s, d), exp.seqinfo, swap="thick").select("feature_id", "txID")


def tx_id_compat(s, d):
    """In the compatible way the interval column is left out of account."""
    exp, tcs = _clusters(s, d)
    return assign_tx_id_from_models(tcs, fixtures.transcripts(s, d), exp.seqinfo, swap="thick", upstream=100, compat=True).select("feature_id", "txID")


def gene_id_models(s, d):
    exp, tcs = _clusters(s, d)
    return assign_gene_id_from_models(tcs, fixtures.transcripts(s, d), exp.seqinfo, upstream=300, downstream=50).select("feature_id", "geneID")


def tx_type_summary(s, d):
    return label_summary(tx_type(s, d), "txType")


def gene_id_summary(s, d):
    return id_summary(gene_id(s, d), "geneID")


def tx_id_summary(s, d):
    return id_summary(tx_id(s, d), "txID")


def missing_id(s, d):
    exp = _with_genes(s, d)
    return assign_missing(exp.features, exp.seqinfo).select("feature_id", "geneID")


def combined_clusters(s, d):
    exp, loci = _loci(s, d)
    tcs = settled(cluster_unidirectionally(exp))
    return _round(combine_clusters(quantify_clusters(exp, tcs), quantify_clusters(exp, loci), "object1").features.select("feature_id", "seqname", "start", "end", "strand", "score"), "score")


def _combined(s, d, remove):
    exp, loci = _loci(s, d)
    tcs = settled(cluster_unidirectionally(exp))
    return _round(combine_clusters(tcs.drop("balance"), loci, remove).select("feature_id", "seqname", "start", "end", "strand", "score"), "score")


def combined_right(s, d):
    return _combined(s, d, "object2")


def combined_all(s, d):
    return _combined(s, d, "none")


def swapped_ranges(s, d):
    return swap_ranges(_clusters(s, d)[1], "thick", "whole").select("feature_id", "start", "end", F.col("whole.start").alias("whole_start"), F.col("whole.end").alias("whole_end"))


def swapped_scores(s, d):
    return swap_scores(_quantified(s, d), "s3").features.select("feature_id", F.col("score").cast("long").alias("score"))


def bidir_regions(s, d):
    exp = _pooled(s, d)
    return bidirectional_regions(exp, exp.seqinfo, WINDOW).select("seqname", "start", "end")


def _by_base(segments):
    # halves are judged on the binary value, as SQL's round does; sums of nine digits often end in one
    sums = [(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c.lower()) for c in ("PD", "MD", "PU", "MU")]
    return _round(segments.select("seqname", F.explode(F.sequence("start", "end")).alias("pos"), *sums, "balance"), "balance")


def balance_bases(s, d):
    """All bases with signal in a window."""
    exp = _pooled(s, d)
    return _by_base(balance_segments(exp, exp.seqinfo, WINDOW))


def balance_directional(s, d):
    """Directionality in place of the Bhattacharyya coefficient."""
    exp = _pooled(s, d)
    return _round(cluster_bidirectionally(exp, exp.seqinfo, WINDOW, 0.8, balance_d).select("feature_id", "seqname", "start", "end", "balance"), "balance")


def tracks_balance(s, d):
    exp = _pooled(s, d)
    return _by_base(track_balance(exp, exp.seqinfo, WINDOW))


def bidir_clusters(s, d):
    return _flat(_loci(s, d)[1])


def bidirectional_samples(s, d):
    exp, loci = _loci(s, d)
    return bidirectionality(loci, exp).select("feature_id", "bidirectionality")


def shape_iqrs(s, d):
    exp, tcs = _clusters(s, d)
    return shape_iqr(tcs, exp).select("feature_id", "IQR")


def shape_entropies(s, d):
    exp, tcs = _clusters(s, d)
    return _round(shape_entropy(tcs, exp).select("feature_id", (F.col("entropy") + 0.0).alias("entropy")), "entropy")


def shape_means(s, d):
    exp, tcs = _clusters(s, d)
    return _round(shape_weighted_mean(shape_mean(tcs), exp).select("feature_id", "mean", "weighted_mean"), "weighted_mean")


def shape_modes(s, d):
    exp, tcs = _clusters(s, d)
    return _round(shape_multimodality(tcs, exp).select("feature_id", "multimodality"), "multimodality")


def trim_symmetric(s, d):
    exp, tcs = _clusters(s, d)
    return _flat(trim_to_percentiles(tcs, exp, 0.3, symmetric=True))


def trim_asymmetric(s, d):
    exp, tcs = _clusters(s, d)
    return _flat(trim_to_percentiles(tcs, exp, 0.3))


def trim_peak(s, d):
    exp, tcs = _clusters(s, d)
    return _flat(trim_to_peak(tcs, exp, 5, 5))


def stretches(s, d):
    found = find_stretches(_clusters(s, d)[1], STRETCH_DIST)
    return found.select("seqname", "start", "end", "nClusters", F.array_join("revmap", ",").alias("members"))


def stretches_cor(s, d):
    found = find_stretches_with_correlation(_quantified(s, d), "counts", STRETCH_DIST)
    return _round(found.select("feature_id", "nClusters", "aveCor"), "aveCor")


def links(s, d):
    return find_links(_clusters(s, d)[1], LINK_DIST)


def links_summary(s, d):
    return _round(range_summary(links(s, d), "distance"), "mean_distance")


def stretches_summary(s, d):
    found = range_summary(stretches(s, d), "nClusters")
    return _round(found, "mean_width", "mean_nClusters")


def links_directional(s, d):
    tcs = _clusters(s, d)[1].withColumn("kind", F.when(F.col("start") % 2 == 0, "even").otherwise("odd"))
    return find_links(tcs, LINK_DIST, "kind", ("even", "odd"))


def links_cor(s, d):
    return _round(find_links_with_correlation(_quantified(s, d), "counts", 20, values=("estimate",)), "estimate")


def links_kendall(s, d):
    exp = _quantified(s, d)
    return _round(link_correlations(find_links(exp, 22), exp, "counts", "kendall"), "estimate", "p_value")


def tracks_ctss(s, d):
    return _round(track_ctss(_pooled(s, d)), "plus", "minus")


def tracks_clusters(s, d):
    return track_clusters(_clusters(s, d)[1]).select("seqname", "start", "end", "feature", "transcript")


def tracks_links(s, d):
    tcs = _clusters(s, d)[1]
    return track_links(find_links(tcs, 20), tcs)


def genome_tiles(s, d):
    return tiles(fixtures.seqinfo(s, d), width=3000).select("seqname", "start", "end")


def expanded_ranges(s, d):
    return ranges_to_positions(fixtures.genes(s, d)).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("total"))


def gene_cover(s, d):
    return coverage(fixtures.genes(s, d).withColumn("w", F.lit(1).cast("long")), "w").withColumn("pos", F.explode(F.sequence("start", "end"))).select("seqname", "strand", "pos", "value")


def gene_depth_over(s, d):
    """Maximal runs of bases in two genes at least."""
    depth = coverage(fixtures.genes(s, d).withColumn("w", F.lit(1).cast("long")), "w")
    return slice_above(depth, 1).select("seqname", "strand", "start", "end")


def gene_parts(s, d):
    """Of every gene the part from its third to its tenth base, the gene with flanks, and the strand turned round."""
    inner, wide = narrow(F.col("start"), 3, 10), extend(F.col("start"), F.col("end"), F.col("strand"), 30, 7)
    return fixtures.genes(s, d).select("gene_id", inner[0].alias("inner_start"), inner[1].alias("inner_end"), wide[0].alias("wide_start"), wide[1].alias("wide_end"), invert_strand(F.col("strand")).alias("turned"))


def genome_tiles_number(s, d):
    return tiles(fixtures.seqinfo(s, d), n=37).select("seqname", "start", "end")


def _by_sample(s, d, write, extension, more=0.0):
    """Files of both strands for every sample, written from the table; `more` is added to the counts."""
    expr, out = settled(fixtures.ctss(s, d).expr), {"+": {}, "-": {}}
    for i in range(1, 8):
        for strand, name in (("+", "plus"), ("-", "minus")):
            path = new_path(s, extension)
            out[strand][f"s{i}"] = path
            write(expr.filter((F.col("sample") == f"s{i}") & (F.col("strand") == strand)).select("seqname", "start", F.col("start").alias("end"), "strand", (F.col("counts") + more).cast("double").alias("score")), path)
    return out["+"], out["-"]


def _read_back(exp):
    return exp.expr.select("seqname", "start", "strand", "sample", F.col("counts").cast("long").alias("counts"))


def import_bedgraph(s, d):
    """The whole table written as bedGraph files and read back."""
    plus, minus = _by_sample(s, d, write_bedgraph, ".bedGraph")
    return _read_back(ctss_from_bedgraph(s, plus, minus, fixtures.seqinfo(s, d)))


def import_bigwig(s, d):
    """The whole table written as BigWig files and read back, whole files at a time; the genome is that of the headers."""
    genome = fixtures.seqinfo(s, d)
    plus, minus = _by_sample(s, d, lambda df, path: write_bigwig(df, genome, path), ".bw")
    return _read_back(ctss_from_bigwig(s, plus, minus))


def import_bigwig_tiles(s, d):
    """The same by tiles, with a design and a genome."""
    genome = fixtures.seqinfo(s, d)
    plus, minus = _by_sample(s, d, lambda df, path: write_bigwig(df, genome, path), ".bw")
    return _read_back(ctss_from_bigwig(s, plus, minus, fixtures.samples(s), genome, tile_width=35_000))


def import_bigwig_former(s, d):
    """The former import of scores that are no whole numbers."""
    genome = fixtures.seqinfo(s, d)
    plus, minus = _by_sample(s, d, lambda df, path: write_bigwig(df, genome, path), ".bw", 0.75)
    return _read_back(ctss_from_bigwig_tiles(s, plus, minus, tile_width=35_000))


def import_bam(s, d):
    """Every line item as a read, written to BAM files and read back; the 5' ends of those of five bases at least."""
    reads = s.read.parquet(f"{d}/lineitem.parquet").select(
        F.concat(F.lit("chr"), "l_suppkey").alias("seqname"),
        (1 + (F.col("l_orderkey") * 37 + F.col("l_partkey") * 11 + F.col("l_linenumber")) % (fixtures.LENGTH - 200)).alias("start"),
        F.concat(1 + F.col("l_partkey") % 4, F.lit("M100N"), 1 + F.col("l_orderkey") % 4, F.lit("M")).alias("cigar"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
    )
    paths = write_bam_parts(reads, fixtures.seqinfo(s, d), new_path(s))
    return reads_to_ctss(read_bam(s, paths), min_length=105).select("seqname", "start", "strand", "score")


def converted_formats(s, d):
    """Pooled counts through every conversion: BED to bedGraph to BigWig to bedGraph to BED to BigWig to BED."""
    genome = fixtures.seqinfo(s, d)
    total = fixtures.ctss(s, d).expr.groupBy("seqname", "start", "strand").agg(F.sum("counts").alias("score")).withColumn("end", F.col("start"))
    bed = [new_path(s, ".bed") for _ in range(3)]
    graphs, again, wigs, last = ([new_path(s, x) for _ in "+-"] for x in (".bedGraph", ".bedGraph", ".bw", ".bw"))
    write_bed(total, bed[0])
    bed_to_bedgraph(s, bed[0], *graphs)
    for source, wig, graph in zip(graphs, wigs, again, strict=True):
        bedgraph_to_bigwig(s, source, wig, genome)
        bigwig_to_bedgraph(s, wig, graph)
    bedgraph_to_bed(s, *again, bed[1])
    bed_to_bigwig(s, bed[1], *last, genome)
    bigwig_to_bed(s, *last, bed[2])
    return read_bed(s, bed[2]).select("seqname", "start", "end", "strand", F.col("score").cast("long").alias("score"))


def reduced_genes(s, d):
    return reduce_ranges(fixtures.genes(s, d), 50)


def antisense_genes(s, d):
    genes = split_by_strand(fixtures.genes(s, d))
    return intersect_ranges(genes["+"], genes["-"])


def genes_without_exons(s, d):
    models = fixtures.transcripts(s, d)
    return setdiff_ranges(models.transcripts, models.exons)


def quick_tss_counts(s, d):
    exp = quick_tss(fixtures.ctss(s, d))
    return exp.expr.select("feature_id", "sample", F.col("counts").cast("long").alias("counts"))


def quick_enhancer_counts(s, d):
    exp = quick_enhancers(fixtures.ctss(s, d), window=WINDOW, threshold=THRESHOLD)
    return exp.expr.select("feature_id", "sample", F.col("counts").cast("long").alias("counts"))


def quick_gene_counts(s, d):
    exp: Experiment = quick_genes(_quantified(s, d), fixtures.genes(s, d))
    return exp.expr.groupBy(F.col("feature_id").alias("geneID")).agg(F.sum("counts").cast("long").alias("counts"))


def event_sessions(s, d):
    found = sessions(s.read.parquet(f"{d}/events.parquet").withColumn("one", F.lit(1)), "ts", "user_id", "30 minutes", "1 hour", "one")
    return found.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        total_tags, tpm, pooled_scores, support, support_negative, subset_support, composition, subset_composition, tag_clusters, tag_clusters_cutoff, cluster_widths, tune_thresholds, tune_exponential, quantify_tag_clusters, quantify_dense,
        quantified_genes, aggregated_rows, overlap_scores, clusters_in_genes, clusters_outside_genes, tx_type, tx_type_swapped, gene_id, gene_id_swapped, tx_id, tx_id_models, tx_id_swapped, tx_id_compat, gene_id_models, tx_type_summary, gene_id_summary, tx_id_summary, missing_id, combined_clusters, combined_right, combined_all, swapped_ranges,
        swapped_scores, bidir_regions, balance_bases, balance_directional, bidir_clusters, bidirectional_samples, shape_iqrs, shape_entropies, shape_means, shape_modes, trim_symmetric, trim_asymmetric, trim_peak, stretches, stretches_cor, links,
        links_directional, links_cor, links_kendall, links_summary, stretches_summary, tracks_ctss, tracks_balance, tracks_clusters, tracks_links, genome_tiles, genome_tiles_number, expanded_ranges, gene_cover, gene_depth_over, gene_parts, import_bedgraph, import_bigwig, import_bigwig_tiles, import_bigwig_former, import_bam, converted_formats, reduced_genes, antisense_genes, genes_without_exons, quick_tss_counts,
        quick_enhancer_counts, quick_gene_counts, event_sessions,
    )
}
