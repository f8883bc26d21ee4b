"""Parameters of the two pipelines, with their published defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Association:
    """Case and control labels, the donors a group needs to be tested, and filters on the result."""

    case: str
    control: str
    min_donors: int = 10
    max_p: float | None = None
    max_q: float | None = None
    permute_seed: int | None = None


@dataclass(frozen=True)
class GroupParams:
    """Convergence groups (local and global, never merged)."""

    lcminp: float = 0.01
    lcminove: tuple[float, ...] = (1000.0, 100.0, 10.0)
    kmer_mindepth: int = 3
    motif_distance: int = 3
    boundary: int = 3
    motif_lengths: tuple[int, ...] = (2, 3, 4)
    discontinuous: bool = False
    min_seq_length: int = 0
    require_cf: bool = True
    all_aa_interchangeable: bool = False
    global_vgene: bool = False
    cluster_min_size: int = 2
    local: bool = True
    global_: bool = True
    max_global_p: float | None = None
    max_global_q: float | None = None
    min_subjects: int = 1
    association: Association | None = None

    def __post_init__(self) -> None:
        if len(self.lcminove) not in (1, len(self.motif_lengths)):
            raise ValueError("lcminove needs one value or one for each motif length")

    @property
    def least_length(self) -> int:
        return max(self.min_seq_length, 2 * self.boundary + 1)

    def min_ove(self) -> dict[int, float]:
        """Least fold by number of residues; other numbers have 0."""
        values = self.lcminove if len(self.lcminove) > 1 else self.lcminove * len(self.motif_lengths)
        return dict(zip(self.motif_lengths, values, strict=True))

    @classmethod
    def paper(cls, **changes) -> GroupParams:
        return replace(cls(lcminp=0.001, lcminove=(10.0,), min_seq_length=8, all_aa_interchangeable=True), **changes)


@dataclass(frozen=True)
class ClusterParams:
    """Merged clusters (one-mismatch edges and enriched motifs)."""

    motif_lengths: tuple[int, ...] = (2, 3, 4)
    gapped: bool = False
    trim: int = 3
    mismatch_trim: int = 0
    min_count: int = 3
    max_p: float = 0.001
    min_fold: tuple[tuple[int, float], ...] = ((2, 1000.0), (3, 100.0), (4, 10.0))
    default_min_fold: float = 10.0
    fdr: bool = False
    min_size: int = 2
    motifs: bool = True
