"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

from kinloom.sources.scratch import Scratch, shared_dir, shuffle_partitions

__all__ = ["Scratch", "shared_dir", "shuffle_partitions"]
