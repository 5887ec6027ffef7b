"""Summaries of models and readiness checks: counts by vocabulary, conditions, loads, interfaces, bindings and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import validate as v

#: Cell types that fill space and that lie on a surface, in our spelling and others' (fixed values).
SOLID = ("tet4", "tet10", "hex8", "hex20", "wedge6", "pyramid5", "tetra", "hexahedron", "wedge", "pyramid")
SURFACE = ("tri3", "tri6", "quad4", "quad8", "triangle", "quad")


def mesh_summary(cells: DataFrame) -> DataFrame:
    """One row: cells, those that fill space and those on surfaces, and the distinct types, regions and materials (AGG-28)."""
    kind = F.lower("cell_type")
    return cells.agg(
        F.count("*").alias("cells"), F.count_if(kind.isin(*SOLID)).alias("solid"), F.count_if(kind.isin(*SURFACE)).alias("surface"), F.count_distinct(kind).alias("types"),
        F.count_distinct("region").alias("regions"), F.count_distinct("material").alias("materials"),
    )


def mesh_readiness(cells: DataFrame, dimension: Column) -> DataFrame:
    """(model, code, severity) of meshes by model: empty, only surfaces, or space-filling without `dimension` 3 (VAL-07).

    `cells`: (model, cell_type), null type for a model without cells; `dimension` is an aggregate over a model's rows.
    """
    kind = F.lower("cell_type")
    own = cells.groupBy("model").agg(F.count("cell_type").alias("cells"), F.count_if(kind.isin(*SOLID)).alias("solid"), F.count_if(kind.isin(*SURFACE)).alias("surface"), dimension.alias("dimension"))
    rules = [
        (F.col("cells") == 0, "mesh.empty", "error"),
        ((F.col("surface") > 0) & (F.col("solid") == 0), "mesh.surface_only", "error"),
        ((F.col("solid") > 0) & (F.coalesce("dimension", F.lit(0)) != 3), "mesh.dimension", "warning"),
    ]
    found = F.array_compact(F.array(*(F.when(on, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))) for on, code, level in rules)))
    return own.select("model", F.explode(found).alias("i")).select("model", "i.code", "i.severity")


def condition_summary(conditions: DataFrame) -> DataFrame:
    """One row: conditions, degrees of freedom (tokens parted by , or ;, one at least), distinct targets and stages (AGG-29)."""
    tokens = F.filter(F.transform(F.split(F.coalesce("dof", F.lit("")), "[,;]", -1), F.trim), lambda t: t != "")
    return conditions.agg(
        F.count("*").alias("conditions"), F.coalesce(F.sum(F.greatest(F.size(tokens), F.lit(1))), F.lit(0)).alias("dofs"), F.count_distinct("target").alias("targets"), F.count_distinct("stage").alias("stages")
    )


def load_kind(kind: Column) -> Column:
    """body, nodal or surface, by what a load's kind contains; a missing kind is a surface load (AGG-30)."""
    k = F.lower(F.coalesce(kind, F.lit("surface_load")))
    return F.when(k.contains("body") | k.contains("gravity"), "body").when(k.contains("nodal") | k.contains("point"), "nodal").otherwise("surface")


def load_summary(loads: DataFrame) -> DataFrame:
    """Loads and their stages by kind (AGG-30)."""
    return loads.groupBy(load_kind(F.col("kind")).alias("kind")).agg(F.count("*").alias("loads"), F.count_distinct("stage").alias("stages"))


def interface_summary(interfaces: DataFrame, materials: DataFrame) -> DataFrame:
    """By contact mode (frictional if missing): interfaces, distinct materials, and those that `materials` doesn't have (AGG-31)."""
    known = materials.select(F.col("material").alias("known")).distinct()
    own = interfaces.withColumn("mode", F.coalesce("mode", F.lit("frictional"))).groupBy("mode", "material").agg(F.count("*").alias("n")).join(known, F.col("material") == F.col("known"), "left")
    missing = F.col("material").isNotNull() & F.col("known").isNull()
    return own.groupBy("mode").agg(F.sum("n").alias("interfaces"), F.count("material").alias("materials"), F.count_if(missing).alias("missing"))


def contact_readiness(interfaces: DataFrame, materials: DataFrame) -> DataFrame:
    """(interface, code): interfaces without a material, with an unknown one, or with one whose stiffnesses aren't both above zero (VAL-09)."""
    m = materials.select(F.col("material").alias("known"), "kn", "ks")
    out = interfaces.select("interface", F.when(F.col("material") != "", F.col("material")).alias("material")).join(m, F.col("material") == F.col("known"), "left")
    weak = ~F.coalesce((F.col("kn") > 0) & (F.col("ks") > 0), F.lit(False))
    code = F.when(F.col("material").isNull(), "interface.material_missing").when(F.col("known").isNull(), "interface.material_undefined").when(weak, "interface.stiffness_invalid")
    return out.select("interface", code.alias("code")).where("code is not null")


def material_mapping(cells: DataFrame, library: DataFrame) -> DataFrame:
    """(material, use, cells): cells by material; use is mapped, missing (not in the library), unused (no cells) or unmapped (cells without one) (JOIN-17, JOIN-30)."""
    own = cells.groupBy(F.when(F.col("material") != "", F.col("material")).alias("material")).agg(F.count("*").alias("cells"))
    both = own.join(library.select(F.col("material").alias("known")).distinct(), F.col("material") == F.col("known"), "full")
    use = F.when(F.coalesce("material", "known").isNull(), "unmapped").when(F.col("known").isNull(), "missing").when(F.col("material").isNull(), "unused").otherwise("mapped")
    return both.select(F.coalesce("material", "known").alias("material"), use.alias("use"), F.coalesce("cells", F.lit(0)).alias("cells"))


def interface_conformity(candidates: DataFrame, materialised: DataFrame) -> DataFrame:
    """By mode: candidates (pair, mode), those that were materialised (pair), and whether all were (VAL-06, JOIN-27)."""
    done = materialised.select(F.col("pair").alias("done")).distinct()
    out = candidates.join(done, F.col("pair") == F.col("done"), "left").groupBy("mode").agg(F.count("*").alias("candidates"), F.count("done").alias("materialised"))
    return out.withColumn("conforms", F.col("candidates") == F.col("materialised"))


def materialise(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(interface, a, b, material): an interface for every candidate of two different, named sides that doesn't exist yet; each once, with a default material (JOIN-27)."""
    name = F.concat(F.lit("interface_"), F.col("a"), F.lit("_"), F.col("b"))
    new = candidates.where("a <> '' and b <> '' and a <> b").select(name.alias("interface"), "a", "b").distinct()
    return new.join(existing.select("interface"), "interface", "left_anti").withColumn("material", F.lit("default_interface"))


def request_status(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """By status: requests for interfaces (a, b, mode, exact) against the pairs of regions with shared nodes (a, b, shared) (MUT-19).

    invalid without both sides, review for unknown modes, release for released boundaries, present if asked for before
    (the first by `seq` counts), pending if exact matches are wanted and no node is shared, else materialised.
    """
    n = nodes.select(F.col("a").alias("na"), F.col("b").alias("nb"), "shared")
    own = requests.withColumns({"na": F.least("a", "b"), "nb": F.greatest("a", "b")}).join(n, ["na", "nb"], "left")
    firsts = requests.where("mode in ('contact', 'tie') and a <> b").groupBy(F.least("a", "b").alias("na"), F.greatest("a", "b").alias("nb")).agg(F.min("seq").alias("first"))
    own = own.join(firsts, ["na", "nb"], "left")
    status = (
        F.when(F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == F.col("b")), "invalid").when(F.col("mode") == "release", "release").when(~F.col("mode").isin("contact", "tie"), "review")
        .when(F.col("seq") > F.col("first"), "present").when(F.col("exact") & F.coalesce(F.col("shared") == 0, F.lit(True)), "pending").otherwise("materialised")
    )
    return own.groupBy(status.alias("status")).agg(F.count("*").alias("requests"))


def asset_summary(assets: DataFrame) -> DataFrame:
    """By request type and policy: assets, those that can be materialised and that need review, and their area (AGG-13)."""
    return assets.groupBy("request", "policy").agg(F.count("*").alias("assets"), F.count_if("ready").alias("ready"), F.count_if(~F.col("ready")).alias("review"), F.sum("area").alias("area"))


def result_records(fields: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per stage: fields, values, and a metric under the first of its names that has a value (AGG-22, AGG-34, AGG-35).

    `metrics`: (stage, and the metric's names as columns, in order).
    """
    own = fields.groupBy("stage").agg(F.count_distinct("field").alias("fields"), F.count("value").alias("values"))
    names = [c for c in metrics.columns if c != "stage"]
    return own.join(metrics.select("stage", F.coalesce(*names).alias("metric")), "stage", "full").fillna(0, ["fields", "values"])


def block_records(objects: DataFrame) -> DataFrame:
    """Per region: objects, whether all are visible and all locked, the first bound material, and how many stages it is active in (AGG-19, AGG-20, AGG-36)."""
    return objects.groupBy("region").agg(
        F.count("*").alias("objects"), F.bool_and("visible").alias("visible"), F.bool_and("locked").alias("locked"), F.min("material").alias("material"), F.count_distinct("stage").alias("stages")
    )


def acceptance(packages: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """(package, accepted, reason): rejected if not valid for engineering, or if its benchmark was; one without a benchmark counts as passed (VAL-11)."""
    out = packages.join(benchmarks.select("package", F.col("accepted").alias("passed")), "package", "left")
    reason = F.when(~F.coalesce("valid", F.lit(False)), "not_valid").when(~F.coalesce("passed", F.lit(True)), "benchmark")
    return out.select("package", reason.isNull().alias("accepted"), reason.alias("reason"))


def binding_checks(faces: DataFrame) -> DataFrame:
    """Issues of topology bindings (entity, kind, material, phase, role): volumes without a material, anything without a phase, faces without a role (VAL-13, VAL-15)."""
    return v.report(
        v.violations(faces.where("kind = 'solid'"), F.col("material").isNotNull(), "binding.material_missing", "entity"),
        v.violations(faces, F.col("phase").isNotNull(), "binding.phase_missing", "entity"),
        v.violations(faces.where("kind = 'face'"), F.col("role").isNotNull(), "binding.role_missing", "entity", severity="warning"),
    )


def case_checks(cases: DataFrame, regions: DataFrame, stages: DataFrame) -> DataFrame:
    """Issues of analysis cases: none of its regions known, no stage, or a stage that activates an unknown region (VAL-02, VAL-12)."""
    none = cases.select("case").join(stages.select("case").distinct(), "case", "left_anti")
    known = cases.join(regions.select("region").distinct(), "region", "left_semi").select("case").distinct()
    lost = cases.select("case").distinct().join(known, "case", "left_anti")
    return v.report(
        v.violations(none.distinct(), F.lit(False), "case.no_stage", "case"), v.violations(lost, F.lit(False), "case.no_region", "case"),
        v.orphans(stages, "region", regions, "region", "case.unknown_region", severity="warning", target="case"),
    )


def all_gates(*gates: DataFrame) -> DataFrame:
    """One row from (gate, issues) rows: gates, those with issues, the names of these, and the status (VAL-04, VAL-10, VAL-03)."""
    rows = reduce(DataFrame.unionByName, gates)
    bad = F.sort_array(F.collect_list(F.when(F.col("issues") > 0, F.col("gate"))))  # one row a gate
    out = rows.agg(F.count("*").alias("gates"), F.count_if(F.col("issues") > 0).alias("failed"), F.array_join(bad, ",").alias("blockers"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "blocked").otherwise("ready"))
