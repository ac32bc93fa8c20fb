"""Options of a run, checked on creation."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    """All options of the command line.  Paths are anything Spark reads."""

    atac_bam: str | None = None
    rna_bam: str | None = None
    vcf: str | None = None
    gtf: str | None = None
    peaks: str | None = None
    exclude: str | None = None
    samples: str | None = None
    out: str = "cellwright"
    counts_only: bool = False
    no_counts_o: bool = False
    out_min: int = 100
    bc_wl: str | None = None
    rna_umi_tag: str = "UB"
    rna_bc_tag: str = "CB"
    atac_bc_tag: str = "CB"
    rna_nh_tag: str = "NH"
    atac_nh_tag: str = "NH"
    max_nh: int = 0
    min_phredq: int = 30
    rna_mapq: int = 30
    atac_mapq: int = 30
    region: str = "."
    eps: float = 1e-6
    amb_eps: float | None = None
    max_iter: int = 100
    amb_prior_w: float = 1e-8
    mdl_reads: str = "intra"
    threads: int = 1
    tx_basic: bool = False
    verbose: bool = False
    # Not on the command line.
    parity: bool = True
    max_miss: int = 0
    maf_cut: float = 0.0
    genotype_field: str = "GT"

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.out_min > 0, "out-min must be above 0")
        for name in ("rna_umi_tag", "rna_bc_tag", "atac_bc_tag", "rna_nh_tag", "atac_nh_tag"):
            need(len(getattr(self, name)) == 2, f"{name} must have two characters")
        for name in ("rna_mapq", "atac_mapq"):
            need(0 <= getattr(self, name) <= 255, f"{name} must be from 0 to 255")
        need(0 < self.eps < 1, "eps must be between 0 and 1")
        need(self.amb_eps is None or 0 < self.amb_eps < 1, "amb-eps must be between 0 and 1")
        need(0 <= self.max_iter < 1 << 16, "max-iter must be from 0 to 65535")
        need(self.amb_prior_w > 0, "amb-prior-w must be above 0")
        need(self.mdl_reads in ("intra", "inter", "all"), "mdl-reads must be intra, inter or all")
        need(self.threads > 0, "threads must be above 0")
        need(self.genotype_field in ("GT", "GP"), "genotype_field must be GT or GP")
        if self.amb_eps is not None:
            warnings.warn("amb-eps has no effect; eps is used", stacklevel=2)

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]
