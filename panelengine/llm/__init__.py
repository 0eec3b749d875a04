"""Training-data operators: scoring, scanning, deduplication, decontamination and packing
of text corpora. Nothing else in the library imports this subpackage."""
