"""Parameters of a run, from ``name=value`` arguments (also ``name:value`` and ``name value``) or a file of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Parameters:
    nx: int = 10
    ny: int = 0
    nz: int = 0
    load_imbalance: float = 0.0
    mv_overlap_comm_comp: int = 0
    verify_solution: int = 0
    numthreads: int = 1
    use_locking: int = 0
    elem_group_size: int = 1
    use_elem_mat_fields: int = 1
    name: str = ""


def parse(arguments: str) -> Parameters:
    """Sizes not given follow the ones before: ny is nx, nz is ny. ``input_file`` replaces the arguments."""
    found = dict(re.findall(r"(?<!\S)-*(\w+)\s*[=:\s]\s*([^\s=:]+)", arguments))
    if "input_file" in found:
        return parse(Path(found["input_file"]).read_text())
    kinds = {f.name: type(f.default) for f in fields(Parameters)}
    own = replace(Parameters(), **{k: kinds[k](v) for k, v in found.items() if k in kinds})
    ny = own.ny or own.nx
    return replace(own, ny=ny, nz=own.nz or ny)
