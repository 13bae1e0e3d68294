"""Limits of the steps that one task does on arrays."""

#: Cells whose distances fit in one task (twice 0.8 GB), and edges of one density tree.
MOST_CELLS, MOST_TREE = 10_000, 2_000_000
#: Cells of one cluster that one task refines; its memory grows with them, its time with their pairs.
MOST_REFINED = 40_000
#: A graph of communities with so many edges is finished on the driver (5 MB).
SMALL_EDGES = 200_000
