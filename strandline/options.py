"""Parameters of alignment, with the names of the command line beside them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Options:
    match: int = 1  # -A
    mismatch: int = 4  # -B
    open_del: int = 6  # -O
    ext_del: int = 1  # -E
    open_ins: int = 6
    ext_ins: int = 1
    clip5: int = 5  # -L
    clip3: int = 5
    unpaired: int = 17  # -U
    band: int = 100  # -w
    zdrop: int = 100  # -d
    min_score: int = 30  # -T
    min_seed: int = 19  # -k
    split_factor: float = 1.5  # -r
    split_width: int = 10  # -s
    max_mem_intv: int = 20  # -y
    max_occ: int = 500  # -c
    drop_ratio: float = 0.5  # -D
    min_chain_weight: int = 0  # -W
    max_chain_gap: int = 10000  # -G
    max_chain_extend: int = 1 << 30  # -N
    max_rescue: int = 50  # -m
    mask_level: float = 0.5  # -X
    redundant_level: float = 0.95
    xa_ratio: float = 0.8
    xa_hits: int = 5  # -h
    xa_hits_alt: int = 200
    mapq_len: int = 50  # -Q
    max_insert: int = 10000
    chunk_bases: int = 10_000_000  # -K
    no_rescue: bool = False  # -S
    no_pairing: bool = False  # -P
    all_hits: bool = False  # -a
    interleaved: bool = False  # -p
    mark_short_split: bool = False  # -M
    soft_clip: bool = False  # -Y
    primary5: bool = False  # -5
    keep_supp_mapq: bool = False  # -q
    copy_comment: bool = False  # -C
    ref_comment: bool = False  # -V
    ignore_alt: bool = False  # -j
    read_group: str | None = None  # -R
    header: tuple[str, ...] = ()  # -H
    insert_stats: tuple[float, ...] | None = None  # -I
    preset: str | None = field(default=None)  # -x; Options.of fills in its values

    @property
    def mapq_factor(self) -> int:
        """The logarithm of mapq_len is kept as a whole number."""
        return int(math.log(self.mapq_len)) if self.mapq_len > 0 else 0

    @property
    def matrix(self) -> list[list[int]]:
        """Scores of two bases; an ambiguous one costs 1 against all."""
        return [[self.match if i == j else -self.mismatch for j in range(4)] + [-1] for i in range(4)] + [[-1] * 5]

    @classmethod
    def of(cls, preset: str | None = None, **given) -> Options:
        """Options as a command line gives them: the values of a read type, if one is named, under what is given; else a match
        score above 1 scales the scores that are not given. A read group is named by its header line, which joins the header."""
        if line := given.pop("read_group_line", None):
            from .functions.sam import read_group

            text, given["read_group"] = read_group(line)
            given["header"] = (*given.get("header", ()), text)
        if preset is not None:
            return cls(preset=preset, **(PRESETS[preset] | given))
        return cls().scaled(**given)

    def scaled(self, **given) -> Options:
        """With a match score above 1 the other scores grow with it, unless they are given."""
        names = ("mismatch", "min_score", "open_del", "open_ins", "ext_del", "ext_ins", "zdrop", "clip5", "clip3", "unpaired")
        a = given.get("match", self.match)
        return replace(self, **{n: getattr(self, n) * a for n in names if n not in given}, **given)


#: Fixed values of the read types of -x.
PRESETS = {
    "intractg": {"open_del": 16, "open_ins": 16, "mismatch": 9, "clip5": 5, "clip3": 5},
    "pacbio": {"open_del": 1, "ext_del": 1, "open_ins": 1, "ext_ins": 1, "mismatch": 1, "split_factor": 10.0, "min_chain_weight": 40, "min_seed": 17, "clip5": 0, "clip3": 0},
    "ont2d": {"open_del": 1, "ext_del": 1, "open_ins": 1, "ext_ins": 1, "mismatch": 1, "split_factor": 10.0, "min_chain_weight": 20, "min_seed": 14, "clip5": 0, "clip3": 0},
}
PRESETS["pbref"] = PRESETS["pacbio"]


def preset(name: str, **given) -> Options:
    """Options of a read type; what is given holds over it, and nothing is scaled."""
    return Options.of(name, **given)
