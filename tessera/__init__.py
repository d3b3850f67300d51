"""Named, typed, N-dimensional arrays as Spark DataFrames: slicing, metadata, layers, conversion and inspection."""

from tessera.operators.array import ArrayFrame, arange, empty, from_numpy, full, ones, zeros
from tessera.operators.slicing import Slice, slice_all, slice_range
from tessera.sources.dataset import Config, Dataset, create, open_bytes, open_dataset

__version__ = "0.1.0"
__all__ = ["ArrayFrame", "Config", "Dataset", "Slice", "arange", "create", "empty", "from_numpy", "full", "ones", "open_bytes", "open_dataset", "slice_all", "slice_range", "zeros"]
