"""Seeded synthetic repertoires. Each draw depends on all before it, so they are made on the driver."""

from __future__ import annotations

# Residues of interiors by frequency, stems of both ends, planted motifs.
INTERIOR = "AAGGGSSSSTTLLQQEEDDNNPPRRYYVVKKIIHHFFMWC"
HEADS = ["CASS", "CASR", "CAST", "CSAR", "CASG", "CAWS"]
TAILS = ["YEQYF", "TQYF", "NEQFF", "GYTF", "TEAFF", "QPQHF"]
PLANTED = ["RGWG", "WDQY", "KHMP", "FWMK", "HWNC"]
_ALL = (1 << 64) - 1


class Rng:
    """The 64-bit xorshift* generator."""

    def __init__(self, seed: int):
        self.state = seed * 0x9E3779B97F4A7C15 & _ALL | 1

    def word(self) -> int:
        x = self.state
        x ^= x >> 12
        x = (x ^ x << 25) & _ALL
        self.state = x = x ^ x >> 27
        return x * 0x2545F4914F6CDD1D & _ALL

    def below(self, n: int) -> int:
        return self.word() % n

    def chance(self, p: float) -> bool:
        return (self.word() >> 11) / float(1 << 53) < p

    def one_of(self, items):
        return items[self.below(len(items))]


def sequence(rng: Rng) -> str:
    head = rng.one_of(HEADS)
    size = 3 + rng.below(7)
    return head + "".join(rng.one_of(INTERIOR) for _ in range(size)) + rng.one_of(TAILS)


def mutated(rng: Rng, cdr3: str) -> str:
    """One residue, of the interior if there is one, drawn anew."""
    at = min(3 + rng.below(max(1, len(cdr3) - 6)), len(cdr3) - 1)
    return cdr3[:at] + rng.one_of(INTERIOR) + cdr3[at + 1 :]


def reference(n: int, seed: int) -> list[str]:
    rng = Rng(seed)
    return [sequence(rng) for _ in range(n)]


def repertoire(n: int, seed: int) -> list[str]:
    """15 % near copies of what came before and 2 % of the rest with a planted motif."""
    rng, out = Rng(seed ^ 0xA5A55A5A), []
    for _ in range(n):
        if out and rng.chance(0.15):
            out.append(mutated(rng, rng.one_of(out)))
        elif rng.chance(0.02):
            own = sequence(rng)
            out.append(own[:4] + rng.one_of(PLANTED) + own[4:])
        else:
            out.append(sequence(rng))
    return out


def expand(base: list[str], factor: int, seed: int) -> list[str]:
    """The originals, then factor - 1 copies of each with one residue changed; short ones unchanged."""
    rng = Rng(seed)
    return base + [mutated(rng, x) if len(x) > 6 else x for _ in range(1, factor) for x in base]
