"""Registered queries over the provided tables and the SQL that states the same results."""

from . import blocks, faces, files, geology, graphs, layers, material, meshes, models, outlines, reports, shapes, stages, states, topology, voxels

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (meshes, blocks, stages, geology, states, models, layers, faces, reports, topology, shapes, voxels, material, graphs, outlines, files):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL

FLAGSHIP = "mesh_region_report"
