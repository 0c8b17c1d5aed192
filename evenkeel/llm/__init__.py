"""Data-pipeline operators for training corpora; nothing else in the package imports this subpackage."""
