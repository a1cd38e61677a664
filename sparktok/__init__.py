"""Text to token ids on Spark: sources, normalizers, pretokenizers, BPE, results, counting, training."""

__version__ = "0.2.0"
