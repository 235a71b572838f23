"""The tables and the memory of ``palimpsest.functions.scratch``, under the name by which this package's modules know them."""

from palimpsest.functions.scratch import clear, cut, new_folder, shared_folder, trimmed

__all__ = ["clear", "cut", "new_folder", "shared_folder", "trimmed"]
