"""Functions on array columns, and on numeric columns over the rows."""

from rowloom.functions.arrays import (
    chunk_array, chunk_by_partition, chunk_rows, falses_like, fill_like, flatten, normalise, normalise_rows, ones_like, rand_like, randn_like, rescale, rescale_rows, rpad_constant, rpad_constant2,
    searchsortedfirst, searchsortedlast, searchsorted_rows, stack, topk, topk_per_group, topk_rows, trues_like, unsqueeze, unstack, zeros_like,
)

__all__ = [
    "chunk_array", "chunk_by_partition", "chunk_rows", "falses_like", "fill_like", "flatten", "normalise", "normalise_rows", "ones_like", "rand_like", "randn_like", "rescale", "rescale_rows", "rpad_constant", "rpad_constant2",
    "searchsortedfirst", "searchsortedlast", "searchsorted_rows", "stack", "topk", "topk_per_group", "topk_rows", "trues_like", "unsqueeze", "unstack", "zeros_like",
]
