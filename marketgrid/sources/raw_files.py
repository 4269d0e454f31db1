"""Raw inputs of a warehouse build, derived from the driver tables.

What a user has before any warehouse exists: the yearly site file, area
polygons whose ids carry county codes, census rows, the overlap of old and new
areas, loan records, the register of institutions. Areas are quarter-degree
tiles in which a customer or a part falls; every 29th site reports a county
beside its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrid.sources.driver_tables import DriverTables, _lat, _lon, _pad


def _cell(axis: str, key: str) -> str:
    """Row or column number of the tile a key's position falls in."""
    at = f"({_lon(key)} + 93)" if axis == "x" else f"({_lat(key)} - 36)"
    return f"cast(floor({at} * 4) as int)"


def _county(i: str, j: str) -> str:
    """Number of the county of four by four tiles."""
    return f"(({i}) div 4 * 20 + ({j}) div 4 + 1)"


def _area(i: str, j: str) -> str:
    return f"concat({_pad(_county(i, j), 5)}, {_pad(i, 3)}, {_pad(j, 3)})"


class RawFiles(DriverTables):
    """Lazy raw frames over one folder of driver tables."""

    def _areas(self) -> DataFrame:
        """Tiles (i, j) with their area id, county number n and figures of the parts in them."""
        keys = self.raw("part").selectExpr("p_partkey as k", "cast(round(p_retailprice * 100) as bigint) as cents").unionByName(
            self.raw("customer").selectExpr("c_custkey as k", "100000 + c_custkey % 50000 as cents"))
        at = keys.selectExpr(f"{_cell('x', 'k')} as i", f"{_cell('y', 'k')} as j", "cents")
        return at.groupBy("i", "j").agg(F.expr("sum(cents) div count(1) as level")).selectExpr(
            "*", f"{_county('i', 'j')} as n", f"{_area('i', 'j')} as area")

    def polygons(self) -> DataFrame:
        """Outlines of the areas, every other one with a hole."""
        return self.rings(self._areas().selectExpr("i", "j", "area as poly_id"))

    def census(self) -> DataFrame:
        """One row per area: code parts, label and the six measures; some are suppressed or empty."""
        return self._areas().selectExpr(
            "left(area, 2) as state", "substr(area, 3, 3) as county", "right(area, 6) as tract",
            f"concat('Tract ', i, '.', j, '; County ', {_pad('n', 5)}, '; Plains') as NAME",
            "cast(case when (i * 3 + j) % 23 = 0 then null when (i + j) % 19 = 0 then 0"
            " else 400 + (i * 37 + j * 211) % 2600 end as double) as households",
            "cast(case when (i * 5 + j) % 13 <> 0 then level end as double) as median_family_income",
            "cast(level - 1000 * (i % 5) as double) as median_hh_income", "cast(level * 4 as double) as median_home_value",
            "cast((i * 37 + j * 211) % 2600 as double) as owner_occupied_units",
            "cast(1000 + (i * 91 + j * 17) % 5000 as double) as population",
        )

    def area_kinds(self) -> DataFrame:
        """County to metropolitan area and tier; a county without a row counts as rural."""
        return self._areas().select("n").distinct().filter("n % 7 <> 3").selectExpr(
            f"{_pad('n', 5)} as county_fips", f"case when n % 4 <> 0 then {_pad('n', 5)} end as cbsa",
            f"case when n % 4 <> 0 then concat('Area ', {_pad('n', 5)}) end as cbsa_title",
            "case n % 3 when 0 then 'metro' when 1 then 'micro' else 'rural' end as tier")

    def area_income(self) -> DataFrame:
        """Family income per metropolitan area; some are suppressed."""
        return self._areas().select("n").distinct().filter("n % 7 <> 3 and n % 4 <> 0").selectExpr(
            f"{_pad('n', 5)} as cbsa",
            "case when n % 11 = 0 then -666666666D else 90000D + (n * 137) % 60000 end as area_family_income")

    def overlaps(self) -> DataFrame:
        """Each area lies in one old area; some are new land without one."""
        return self._areas().filter("(i + j) % 9 <> 0").selectExpr(
            "area as child", "concat('old', area) as parent", "100 + i as land_part")

    def old_counts(self) -> DataFrame:
        return self._areas().selectExpr(
            "concat('old', area) as parent",
            "cast(case when (i + 2 * j) % 11 = 0 then -666666666 else 300 + (i * 31 + j * 173) % 2000 end as double)"
            " as households_old")

    def sites(self) -> DataFrame:
        """The yearly file with counties on the map, and the total of the institution on the rows of main offices."""
        key = "cast(UNINUMBR as bigint)"
        county = _county(_cell("x", key), _cell("y", key))
        beside = f"(case when {county} % 20 < 11 then {county} + 1 else {county} - 1 end)"
        return super().sod().drop("tract_geoid").withColumns({
            "STCNTYBR": F.expr(_pad(f"(case when {key} % 29 = 0 then {beside} else {county} end)", 5)),
            "DEPSUM": F.expr("case when BKMO = '1' then 10 * DEPSUMBR else 0 end"),
        })

    def loans(self) -> DataFrame:
        """Loan records; the area is the tile of the applicant, some have none, some name an area nobody describes."""
        line = self.raw("lineitem").select(
            "l_orderkey", "l_suppkey", "l_returnflag", "l_linenumber", "l_extendedprice")
        order = self.raw("orders").selectExpr(
            "o_orderkey", f"case when o_custkey % 97 <> 0 then {_area(_cell('x', 'o_custkey'), _cell('y', 'o_custkey'))} end"
            " as area")
        return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
            "area as census_tract", "lpad(cast(l_suppkey as string), 20, '0') as lei", "l_returnflag as loan_purpose",
            "cast(l_linenumber as string) as action_taken",
            "case when l_suppkey % 19 = 0 then 'Exempt'"
            " else cast(cast(round(l_extendedprice * 100) as bigint) as string) end as loan_amount",
            "case when l_orderkey % 3 <> 0 then cast(40 + (l_suppkey * 7 + l_linenumber) % 90 as string) else 'NA' end"
            " as tract_to_msa_income_percentage",
        )
