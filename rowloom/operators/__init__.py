"""Operators on tables of observations."""

from rowloom.operators.aggs import group_counts, group_indices
from rowloom.operators.batching import BatchView, DataLoader, batch, batch_sequence, batched, batchseq, collate, collate_with, eachobs, slidingwindow, unbatch
from rowloom.operators.order import Obs, getobs, numobs, obsdim, obsview, randobs, shuffleobs, with_obs
from rowloom.operators.partition import fold_column, kfolds, kfolds_long, leavepout, split_bounds, splitobs, timeseries_bounds, timeseries_kfolds
from rowloom.operators.resample import oversample, undersample
from rowloom.operators.transform import filterobs, groupobs, in_group, joinobs, mapobs

__all__ = [
    "BatchView", "DataLoader", "Obs", "batch", "batch_sequence", "batched", "batchseq", "collate", "collate_with", "eachobs", "filterobs", "fold_column", "getobs", "group_counts", "group_indices",
    "groupobs", "in_group", "joinobs", "kfolds", "kfolds_long", "leavepout", "mapobs", "numobs", "obsdim", "obsview", "oversample", "randobs", "shuffleobs", "slidingwindow", "split_bounds", "splitobs",
    "timeseries_bounds", "timeseries_kfolds", "unbatch", "undersample", "with_obs",
]
