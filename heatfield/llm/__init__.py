"""Operators for preparing training corpora: ten building blocks, each a set of Spark jobs."""
