"""Readers and writers of boreholes, geological models, surfaces and meshes."""

from __future__ import annotations

#: File suffixes and the kind of source they hold (SRC-20, WIN-13).
SUFFIXES = {".csv": "borehole_csv", ".txt": "borehole_csv", ".json": "geology_json", ".stl": "stl", ".msh": "gmsh", ".vtu": "vtu"}


def kind_of(path: str, explicit: str | None = None) -> str:
    """The kind of a source: as stated, else by its suffix."""
    if explicit:
        return explicit.strip().lower().replace("-", "_")
    for suffix, kind in SUFFIXES.items():
        if path.lower().endswith(suffix):
            return kind
    raise ValueError(f"no reader for {path}")
