"""Resource statistics (A10, A10p, A11, A14, A15) and change capture.

Changes are aggregated per resource before they meet resources, so no
resource row is multiplied by its change count unless the ``_parity``
operator asks for the source's inflated totals.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from ..schemas import conform, enum_rank
from ._plan import ordered

Tables = Mapping[str, DataFrame]
AREA = "decimal(38,2)"

# --- fixed values: reasons written with captured changes ---------------------
QUANTITY_REASON = "Auto record: quantity change"
AREA_REASON = "Auto record: area change"
STAGE_REASON_PREFIX = "Auto record: growth stage changed from "
NEW_RESOURCE_REASON = "新增资源记录"


def change_counts(tables: Tables) -> DataFrame:
    """Per resource: number of changes, signed quantity and area change, last change."""
    c = tables["resource_changes"]
    add = F.col("change_type") == "ADD"
    amt = F.coalesce(F.col("change_amount"), F.lit(0))
    area = F.coalesce(F.col("change_area"), F.lit(0))
    return c.groupBy("resource_id").agg(
        F.count("change_id").alias("changes"),
        F.sum(F.when(add, amt).otherwise(-amt)).alias("net_q"),
        F.sum(F.when(add, area).otherwise(-area)).alias("net_a"),
        F.max("changed_at").alias("last_change_time"))


def _res_regions(tables: Tables) -> DataFrame:
    r = tables["regions"].select("region_id", "region_name", "region_type")
    return tables["resources"].join(r, "region_id")


def resource_summary(tables: Tables, sort: bool = True) -> DataFrame:
    """Per region and type: quantity, area, number of change records, last change (exact)."""
    j = _res_regions(tables).join(change_counts(tables), "resource_id", "left")
    out = j.groupBy("region_name", "resource_type").agg(
        F.sum(F.coalesce("quantity", F.lit(0))).cast("bigint").alias("current_quantity"),
        F.sum(F.coalesce("area", F.lit(0))).cast(AREA).alias("current_area"),
        F.sum(F.coalesce("changes", F.lit(0))).cast("bigint").alias("change_records"),
        F.max("last_change_time").alias("last_change_time"))
    return ordered(out, "region_name", enum_rank("resource_type", "resources", "resource_type"), sort=sort)


def resource_summary_parity(tables: Tables, sort: bool = True) -> DataFrame:
    """The source's totals: each resource counted once per change row (at least once)."""
    j = _res_regions(tables).join(change_counts(tables), "resource_id", "left")
    k = F.greatest(F.coalesce(F.col("changes"), F.lit(0)), F.lit(1))
    out = j.groupBy("region_name", "resource_type").agg(
        F.sum(F.coalesce("quantity", F.lit(0)) * k).cast("bigint").alias("current_quantity"),
        F.sum(F.coalesce("area", F.lit(0)) * k).cast(AREA).alias("current_area"),
        F.sum(F.coalesce("changes", F.lit(0))).cast("bigint").alias("change_records"),
        F.max("last_change_time").alias("last_change_time"))
    return ordered(out, "region_name", enum_rank("resource_type", "resources", "resource_type"), sort=sort)


def resource_net_change(tables: Tables, sort: bool = True) -> DataFrame:
    """Per region, type, species: max quantity, changes, net quantity/area change, last change.

    Every change that is not ADD counts as a subtraction (STATUS_UPDATE too,
    with its amount normally NULL -> 0).
    """
    j = _res_regions(tables).join(change_counts(tables), "resource_id", "left")
    out = j.groupBy("region_name", "resource_type", "species_name").agg(
        F.max("quantity").alias("current_quantity"),
        F.sum(F.coalesce("changes", F.lit(0))).cast("bigint").alias("change_count"),
        F.coalesce(F.sum("net_q"), F.lit(0)).cast("bigint").alias("net_quantity_change"),
        F.coalesce(F.sum("net_a"), F.lit(0)).cast(AREA).alias("net_area_change"),
        F.max("last_change_time").alias("last_change_time"))
    return ordered(out, "region_name", "resource_type", "species_name", sort=sort)


def resource_totals(tables: Tables) -> DataFrame:
    """Per region, type, species and stage: total quantity and area."""
    out = _res_regions(tables).groupBy("region_name", "resource_type", "species_name", "growth_stage").agg(
        F.sum(F.coalesce("quantity", F.lit(0))).cast("bigint").alias("total_quantity"),
        F.sum(F.coalesce("area", F.lit(0))).cast(AREA).alias("total_area"))
    return out


def region_resources(tables: Tables) -> DataFrame:
    """Every region: number of resources, total quantity and area (0 when empty)."""
    per_region = tables["resources"].groupBy("region_id").agg(
        F.count("resource_id").alias("resource_count"),
        F.sum(F.coalesce("quantity", F.lit(0))).alias("q"),
        F.sum(F.coalesce("area", F.lit(0))).alias("a"))
    r = tables["regions"].select("region_id", "region_name", "region_type")
    out = r.join(per_region, "region_id", "left")
    return out.select("region_id", "region_name", "region_type",
                      F.coalesce("resource_count", F.lit(0)).cast("bigint").alias("resource_count"),
                      F.coalesce("q", F.lit(0)).cast("bigint").alias("total_quantity"),
                      F.coalesce("a", F.lit(0)).cast(AREA).alias("total_area"))


def change_entries():
    """The change rows between an old (oq, oa, os) and a new (nq, na, ns) quantity, area and stage, as an array."""
    null_i, null_a = F.lit(None).cast("int"), F.lit(None).cast("decimal(12,2)")
    return F.array_compact(F.array(
        F.when(F.col("oq") != F.col("nq"), F.struct(
            F.when(F.col("nq") > F.col("oq"), "ADD").otherwise("REDUCE").alias("change_type"),
            F.lit(QUANTITY_REASON).alias("change_reason"),
            F.abs(F.col("nq") - F.col("oq")).cast("int").alias("change_amount"),
            null_a.alias("change_area"), F.lit(1).alias("seq"))),
        F.when(F.col("oa") != F.col("na"), F.struct(
            F.when(F.col("na") > F.col("oa"), "ADD").otherwise("REDUCE").alias("change_type"),
            F.lit(AREA_REASON).alias("change_reason"), null_i.alias("change_amount"),
            F.abs(F.col("na") - F.col("oa")).cast("decimal(12,2)").alias("change_area"), F.lit(2).alias("seq"))),
        F.when(F.col("os") != F.col("ns"), F.struct(
            F.lit("STATUS_UPDATE").alias("change_type"),
            F.concat(F.lit(STAGE_REASON_PREFIX), F.col("os"), F.lit(" to "), F.col("ns")).alias("change_reason"),
            null_i.alias("change_amount"), null_a.alias("change_area"), F.lit(3).alias("seq")))))


def capture_resource_changes(old: DataFrame, new: DataFrame, changed_at=None,
                             operator_id=None) -> DataFrame:
    """Change rows between two versions of ``resources`` (the update trigger, set-based).

    Quantity and area changes give ADD / REDUCE with the absolute amount, a
    stage change gives STATUS_UPDATE; no row when either side is NULL or
    equal.  A resource only in ``new`` gives one ADD row with its quantity
    and area.  change_id is left NULL (see ``sources.ingest.assign_ids``).
    """
    ts = F.current_timestamp().cast("timestamp_ntz") if changed_at is None \
        else F.lit(changed_at).cast("timestamp_ntz")
    op = F.lit(operator_id).cast("bigint")
    o = old.select("resource_id", F.col("quantity").alias("oq"), F.col("area").alias("oa"),
                   F.col("growth_stage").alias("os"))
    n = new.select("resource_id", F.col("quantity").alias("nq"), F.col("area").alias("na"),
                   F.col("growth_stage").alias("ns"))
    j = o.join(n, "resource_id")
    updates = j.select("resource_id", F.explode(change_entries()).alias("e")).select(
        "resource_id", "e.change_type", "e.change_reason", "e.change_amount", "e.change_area", "e.seq")
    added = new.join(old.select("resource_id"), "resource_id", "left_anti").select(
        "resource_id", F.lit("ADD").alias("change_type"), F.lit(NEW_RESOURCE_REASON).alias("change_reason"),
        F.col("quantity").cast("int").alias("change_amount"),
        F.col("area").cast("decimal(12,2)").alias("change_area"), F.lit(0).alias("seq"))
    out = updates.unionByName(added).select("*", ts.alias("changed_at"), op.alias("operator_id"))
    return conform(out, "resource_changes")
