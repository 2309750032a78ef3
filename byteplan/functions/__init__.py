"""Column functions: built-in expressions where they suffice, Arrow-batched kernels where they do not."""

from .builtin import (
    apply_magic,
    count_delimiters,
    first_bytes,
    human_size,
    leb_encode,
    leb_size,
    line_array,
    loop_gain,
    looks_json,
    macro_gain,
    mean_line_similarity,
    redundancy,
    smallest_period,
)
from .udfs import KERNELS, kernel, register

__all__ = [
    "KERNELS", "apply_magic", "count_delimiters", "first_bytes", "human_size", "kernel", "leb_encode", "leb_size",
    "line_array", "loop_gain", "looks_json", "macro_gain", "mean_line_similarity", "redundancy", "register", "smallest_period",
]
