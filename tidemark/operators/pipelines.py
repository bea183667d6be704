"""Pipelines from positions to quantified clusters and genes, with the usual settings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..model import CTSS_KEY, Experiment
from ..plans.settle import settled
from .annotate import assign_gene_id
from .assay import calc_pooled, calc_tpm, pool_positions, quantify_clusters, quantify_genes, subset
from .bidirectional import cluster_bidirectionally, subset_by_bidirectionality
from .cluster import cluster_unidirectionally


def pooled(ctss: Experiment) -> Experiment:
    """The positions with a pooled score, computed from tags per million where there is none."""
    if "score_n" in ctss.features.columns:
        return ctss
    return pool_positions(ctss) if ctss.plain and ctss.key == CTSS_KEY else calc_pooled(calc_tpm(ctss))


def quick_tss(ctss: Experiment, **options) -> Experiment:
    """Unidirectional clusters and their expression."""
    ctss = pooled(ctss)
    return quantify_clusters(ctss, settled(cluster_unidirectionally(ctss, **options)))


def quick_enhancers(ctss: Experiment, **options) -> Experiment:
    """Bidirectional clusters with expression on both arms in some sample, and their expression."""
    ctss = pooled(ctss)
    ctss = ctss.with_(features=settled(ctss.features))
    # what is read several times is written once
    loci = settled(cluster_bidirectionally(ctss, ctss.seqinfo, **options))
    loci = settled(subset_by_bidirectionality(loci, ctss))
    return quantify_clusters(ctss, loci)


def quick_genes(clusters: Experiment, genes: DataFrame | None = None, **options) -> Experiment:
    """The expression of genes by their stranded clusters."""
    if "geneID" not in clusters.features.columns:
        if genes is None:
            raise ValueError("clusters without geneID need gene models")
        clusters = assign_gene_id(clusters, genes, clusters.seqinfo, **options)
    return quantify_genes(subset(clusters, "strand != '*'"))
