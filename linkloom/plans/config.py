"""Parameters of a scaffolding run: KEY=value files, defaults, types."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields


@dataclass
class Config:
    k: int = 63
    min_pair_of_barcode: int = 10
    max_pair_of_barcode: int = 500
    sampling_ratio: float = 1.0
    bin_factor: float = 0.5
    order_bin: int = 7000
    order_reach: int = 30_000
    order_threshold: float = 0.1
    order_delete_share: float = 0.95
    order_rounds: int = 100
    end_bin: int = 3500
    end_reach: int = 15_000
    end_threshold: float = 0.1
    end_rank: int = 4
    pe_min_contig: int = 1000
    pe_margin: int = 100
    pe_shared: int = 10
    pe_max_insert: int = 5000
    pe_max_link: int = 5000
    pe_min_count: int = 3
    pe_search: int = 5000
    gap_bin: int = 4000
    gap_reach: int = 3_000_000
    gap_threshold: float = 0.1
    max_gap: int = 30_000
    gap_trunk: int = 5000
    gap_petrunk: int = 1
    gap_pe: int = 1
    min_gap: int = 1
    min_n: int = 10
    min_c: int = 1
    read_len: int = 100


def parse_config(text: str) -> Config:
    """KEY=value lines, comments after '#', quotes dropped; names in any case. Unknown keys are ignored, wrong types are errors."""
    known = {f.name: f.type for f in fields(Config)}
    values = {}
    for line in text.splitlines():
        if m := re.match(r"\s*([A-Za-z_]+)\s*=\s*\"?([^\"#]*?)\"?\s*(?:#.*)?$", line):
            name = m[1].lower()
            if name in known:
                values[name] = (float if known[name] == "float" else int)(m[2])
    return Config(**values)
