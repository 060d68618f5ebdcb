"""Operators for preparing training corpora: each module has one operator with a general interface."""
