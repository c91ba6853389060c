"""Sources: generated datasets, files, containers of the caller's, and sinks."""

from rowloom.sources.containers import from_arrays, from_rows, register_container, working_folder, write_table
from rowloom.sources.datasets import load_iris, make_moons, make_poly, make_sin, make_spiral

__all__ = ["from_arrays", "from_rows", "load_iris", "make_moons", "make_poly", "make_sin", "make_spiral", "register_container", "working_folder", "write_table"]
