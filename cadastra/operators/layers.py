"""The attribute layers by configuration, and the enrichment of lots with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators.relational import joined_distinct, joined_ordered, left_join_all
from cadastra.operators.spatial import centroids, geometry_join
from cadastra.sources.tables import written

@dataclass(frozen=True)
class Layer:
    """One attribute layer: which table, which columns under which names, and how its values are brought to one row a lot."""

    name: str
    table: str
    columns: dict[str, str]
    not_null: list[str]
    place: str = "buffered"
    history: bool = False
    geometry: str = "geometry"
    maxima: tuple[str, ...] = ()


# The attribute layers, their tables, the columns under the names that they get, and the columns that must not be null.
CATALOGUE = [
    Layer("suburb", "Suburbs", {"SUBURBNAME": "suburbname", "POSTCODE": "postcode"}, ["SUBURBNAME"], place="centroid"),
    Layer("lga", "Local_Government_Area", {"LGANAME": "lga_name", "COUNCILNAME": "council_name"}, ["LGANAME"], place="centroid"),
    Layer("lep", "Local_Environmental_Plan", {"EPI_NAME": "lep_name", "LGA_NAME": "lep_lga_name", "CURRENCY_DATE": "lep_currency_date", "LAY_CLASS": "lep_lay_class"}, ["EPI_NAME"]),
    Layer("dcp", "Development_Control_Plan_LGA_Based", {"PLAN_NAME": "dcp_plan_name", "LGA_NAME": "dcp_lga_name", "COUNCIL_NAME": "dcp_council_name", "PLAN_TYPE": "dcp_plan_type"}, ["PLAN_NAME"]),
    Layer("lzn", "Land_Zoning_Map", {"SYM_CODE": "lzn_sym_code", "LAY_CLASS": "lzn_lay_class", "EPI_NAME": "lzn_epi_name", "LABEL": "lzn_label"}, ["SYM_CODE", "LAY_CLASS"]),
    Layer("lzn_historic", "land_zoning_map_historic", {"sym_code": "historic_zone", "lay_class": "historic_lay_class", "amendment": "historic_amendment", "commenced_datetime": "historic_commenced_date", "published_datetime": "historic_published_date"}, ["amendment"], history=True),
    Layer("fsr", "Floor_Space_Ratio_Map", {"SYM_CODE": "fsr_sym_code", "LAY_CLASS": "fsr_lay_class", "LABEL": "fsr_label", "FSR": "fsr_value", "EPI_NAME": "fsr_epi_name"}, ["FSR"]),
    Layer("hob", "Height_of_Buildings_Map", {"SYM_CODE": "hob_sym_code", "MAX_B_H": "hob_max_height", "UNITS": "hob_units", "MAX_B_H_M": "hob_max_height_m", "EPI_NAME": "hob_epi_name"}, ["MAX_B_H"]),
    Layer("minlotsize", "Minimum_Lot_Size", {"SYM_CODE": "mls_sym_code", "LAY_CLASS": "mls_lay_class", "LOT_SIZE": "mls_lot_size", "UNITS": "mls_units", "EPI_NAME": "mls_epi_name"}, ["LOT_SIZE"]),
    Layer("activestreetfront", "Active_Street_Frontages", {"LAY_CLASS": "asf_lay_class", "EPI_NAME": "asf_epi_name", "LGA_NAME": "asf_lga_name"}, ["LAY_CLASS"]),
    Layer("lmr", "lmr", {"buffer": "buffer", "lmr_permissible": "lmr_permissible", "lmr_height_rfb": "lmr_height_rfb", "lmr_height_sth": "lmr_height_sth"}, ["geom"]),
    Layer("foreshorebuildline", "Foreshore_Building_Line", {"LAY_CLASS": "fbl_lay_class", "EPI_NAME": "fbl_epi_name", "LGA_NAME": "fbl_lga_name"}, ["LAY_CLASS"]),
    Layer("greenfieldhousecode", "Greenfield_Housing_Code_Area", {"LAY_CLASS": "ghc_lay_class"}, ["LAY_CLASS"]),
    Layer("flood", "Flood_Planning_Map", {"LAY_CLASS": "floodmapping"}, ["LAY_CLASS"]),
    Layer("bushfire", "Bushfire_Prone_Land", {"d_Category": "bushfireproneland"}, ["d_Category"]),
    Layer("acidsulfatesoils", "Acid_Sulfate_Soils", {"LAY_CLASS": "ass_lay_class"}, ["LAY_CLASS"]),
    Layer("biodiversity", "Terrestrial_Biodiversity", {"LAY_CLASS": "biodiversity"}, ["LAY_CLASS"]),
    Layer("groundwater", "Groundwater_Vulnerability", {"LAY_CLASS": "groundwatervulnerability"}, ["LAY_CLASS"]),
    Layer("landslide", "Landslide_Risk_Land", {"LAY_CLASS": "landsliderisk"}, ["LAY_CLASS"]),
    Layer("biodiversitymap", "Biodiversity_Map", {"LAY_CLASS": "biomap_lay_class", "LAY_NAME": "biomap_lay_name", "LABEL": "biomap_label", "EPI_NAME": "biomap_epi_name"}, ["LAY_CLASS"]),
    Layer("biodiversityvalues", "Biodiversity_Values", {"BOSET_Class": "biovalue_boset_class", "BV_Category": "biovalue_category"}, ["BV_Category"]),
    Layer("envsensitiveland", "Environmentally_Sensitive_Land", {"LAY_CLASS": "envsensi_lay_class", "EPI_NAME": "envsensi_epi_name", "LGA_NAME": "envsensi_lga_name"}, ["LAY_CLASS"]),
    Layer("wilderness", "Identified_Wilderness", {"NAME": "wilderness_name"}, ["NAME"]),
    Layer("mineralresource", "Mineral_and_Resource_Land", {"LAY_CLASS": "mineral_lay_class", "EPI_NAME": "mineral_epi_name", "EPI_TYPE": "mineral_epi_type"}, ["LAY_CLASS"]),
    Layer("natresbiodiversity", "Natural_Resources_Biodiversity_Map", {"LAY_CLASS": "nrbio_lay_class", "EPI_NAME": "nrbio_epi_name", "EPI_TYPE": "nrbio_epi_type"}, ["LAY_CLASS"]),
    Layer("natressensitivity", "Natural_Resources_Sensitivity_Map", {"LAY_CLASS": "nrsensi_lay_class", "LAY_NAME": "nrsensi_lay_name", "EPI_NAME": "nrsensi_epi_name"}, ["LAY_CLASS"]),
    Layer("natreswater", "Natural_Resources_Water_Map", {"LAY_CLASS": "nrwater_lay_class", "LAY_NAME": "nrwater_lay_name", "EPI_NAME": "nrwater_epi_name"}, ["LAY_CLASS"]),
    Layer("salinity", "Salinity", {"LAY_CLASS": "salinity_lay_class", "EPI_NAME": "salinity_epi_name"}, ["LAY_CLASS"]),
    Layer("koalahabitat", "koala_habitat_map", {"lay_name": "koala_lay_name", "lay_class": "koala_lay_class"}, ["lay_class"]),
    Layer("coastalwetlands", "Coastal_Wetlands", {"LABEL": "coastal_wetlands", "MAP_NAME": "cwet_map_name", "EPI_NAME": "cwet_epi_name"}, ["LABEL"]),
    Layer("coastalenvironment", "Coastal_Environment_Area_Map", {"LABEL": "coastal_environment_area", "MAP_NAME": "cenv_map_name", "EPI_NAME": "cenv_epi_name"}, ["LABEL"]),
    Layer("coastaluse", "Coastal_Use_Area_Map", {"LABEL": "coastal_use_area", "MAP_NAME": "cuse_map_name", "EPI_NAME": "cuse_epi_name"}, ["LABEL"]),
    Layer("drinkingwatercatch", "Drinking_Water_Catchment", {"LAY_CLASS": "drinking_water_catchment", "LGA_NAME": "dwc_lga_name", "EPI_NAME": "dwc_epi_name"}, ["LAY_CLASS"]),
    Layer("riparianland", "Riparian_Land_and_Watercourses", {"LAY_CLASS": "riparianlandwatercourse", "LAY_NAME": "rip_lay_name", "EPI_NAME": "rip_epi_name"}, ["LAY_CLASS"]),
    Layer("minesubsidence", "Mine_Subsidence_District", {"DISTRICTNAME": "mine_subsidence_district"}, ["DISTRICTNAME"]),
    Layer("scenicprotection", "Scenic_Protection_Land", {"LAY_CLASS": "scenicprotectionland", "LGA_NAME": "scenic_lga_name", "EPI_NAME": "scenic_epi_name"}, ["LAY_CLASS"]),
    Layer("heritage", "EPI_Heritage", {"H_NAME": "h_name", "H_ID": "h_id", "LAY_CLASS": "heritage_class"}, ["H_NAME"]),
    Layer("pnf", "PNF_Approvals", {"CONTROLLIN": "pnf_controllin"}, ["CONTROLLIN"]),
    Layer("bct", "BCT_Agreements", {"CONTROLLIN": "bct_controllin"}, ["CONTROLLIN"]),
    Layer("airportnoise", "airport_noise", {"anef_code": "airport_anef_code"}, ["anef_code"]),
    Layer("floodsdf", "flood_sfd_1aep", {"ogc_fid": "floodsdf_ogc_fid"}, ["ogc_fid"], geometry="wkb_geometry"),
    Layer("crownreserves", "crown_council_reserves", {"reserve_name": "crown_reserve_name"}, ["reserve_name"]),
    Layer("contamination", "contamination_sites", {"sitename": "contamination_sitename"}, ["sitename"]),
    Layer("ramsarwetland", "ramsar_wetlands", {"source": "ramsar_source", "refcode": "ramsar_refcode"}, ["refcode"]),
    Layer("specialcontrolledarea", "special_and_controlled_areas_wnsw", {"class": "sca_class", "label": "sca_label", "legislation": "sca_legislation"}, ["class"]),
    Layer("localcomplying", "Local_Complying_Exclusion", {"LAY_CLASS": "localcomplying_lay_class"}, ["LAY_CLASS"]),
    Layer("npwsestate", "national_parks_and_wildlife_service_estate", {"ogc_fid": "npws_ogc_fid"}, ["ogc_fid"]),
    Layer("localprovision", "local_provisions", {"lay_name": "localprov_lay_name", "lay_class": "localprov_lay_class"}, ["lay_class"]),
    Layer("landreservation", "land_reservation_acquisition", {"lra_type": "landres_lra_type", "lay_class": "landres_lay_class", "label": "landres_label"}, ["lra_type"]),
]


def layer_rows(source: DataFrame, layer: Layer) -> DataFrame:
    """(id, geometry, target columns) of a layer's source rows that count; open-ended rows of a history don't."""
    rows = source.filter(" and ".join(f"`{c}` is not null" for c in layer.not_null) or "true")
    if layer.history and "published_datetime" in source.columns:
        rows = rows.filter(~F.col("published_datetime").cast("string").like("9999%"))
    return rows.select(F.expr("uuid()").alias("id"), F.col(layer.geometry).alias("geometry"), *[F.col(a).alias(b) for a, b in layer.columns.items()])


def brought_together(rows: DataFrame, layer: Layer, keys: list[str]) -> DataFrame:
    """One row a lot: distinct values sorted and joined, histories by date, maxima where they are asked for."""
    targets = list(layer.columns.values())
    dated = next((c for c in targets if "from_date" in c or "commenced_date" in c), None) if layer.history else None

    def one(c: str):
        if c in layer.maxima:
            return F.max(c).alias(c)
        if dated:
            return joined_ordered(F.col(c), [F.col(dated).cast("string"), F.col(c).cast("string")]).alias(c)
        return joined_distinct(F.col(c)).alias(c)

    return rows.groupBy(*keys).agg(*[one(c) for c in targets])


def enrich_layer(lots: DataFrame, source: DataFrame, layer: Layer, cell: float, shrink: float = 9e-6) -> DataFrame:
    """(lot_id, target columns): a layer's values for the lots (lot_id, geometry) that meet it: the lot drawn in a little, or its centroid."""
    rows = written(layer_rows(source, layer), f"layer-{layer.name}")  # written with its ids, which a recomputation would not give again
    places = lots.select(F.col("lot_id").alias("id"), "geometry")
    places = centroids(places) if layer.place == "centroid" else places
    pairs = geometry_join(places, rows.select("id", "geometry").filter("geometry is not null"), cell, shrink if layer.place == "buffered" else 0.0)
    met = pairs.join(rows.withColumnRenamed("id", "b_id"), "b_id").withColumnRenamed("a_id", "lot_id").drop("geometry")
    return brought_together(met, layer, ["lot_id"])


def enrich(lots: DataFrame, sources: dict[str, DataFrame], cell: float, layers: list[Layer] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """lots with the columns of every layer whose table is given, and the errors of layers that failed, which are left out.

    Layers without a table are left out too; lots without a value keep null. Each layer is written before the next, so that one that fails
    blocks none of the others.
    """
    parts, failed = [], {}
    for x in layers or CATALOGUE:
        if x.table in sources:
            try:
                parts.append(written(enrich_layer(lots, sources[x.table], x, cell), f"lots-{x.name}"))
            except PySparkException as e:
                failed[x.name] = str(e).splitlines()[0][:300]
    return left_join_all(lots, parts, ["lot_id"]), failed


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> str:
    """Write a layer as a table in buckets of its lot keys, sorted by them; its name."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(name)
    return name


def wide_table(spark: SparkSession, lots: str, layers: list[str], keys: list[str]) -> DataFrame:
    """The lots' table with the columns of each layer's, all in the same number of buckets of the keys: merged bucket by bucket, without a shuffle.

    Layers have a row a lot at most. A lot without a row keeps null; keys that are null in a layer meet nothing.
    """
    out = spark.table(lots)
    for name in layers:
        # a merge, as a small layer would else be sent to all
        out = out.join(spark.table(name).hint("merge"), keys, "left")
    return out
