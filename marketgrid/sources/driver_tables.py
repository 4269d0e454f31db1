"""Star-schema tables derived from the order/customer/lineitem parquet files.

The mapping is plain integer arithmetic over the keys, so any other engine can
repeat it.  Tracts, counties and branches grow with the number of customers:
a customer is a branch, every 1,500 customers open a new set of tracts and
every 15,000 a new set of counties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrid.functions import columns as C
from marketgrid.plans.warehouse import INDEX_WEIGHTS, WEIGHT_SCHEMA, Warehouse

CERTS = 40
#: Order lines that one task sorts, joins or groups.
TASK_LINES = 1_000_000
SUBJECT_CERT = "00000"


# -- pieces of SQL text used by several tables --------------------------------
def _pad(number: str, width: int) -> str:
    """Integer to text with leading zeros; wider numbers are kept whole."""
    text = f"cast({number} as string)"
    return f"lpad({text}, greatest({width}, length({text})), '0')"


def _cert(slot: str) -> str:
    return f"(case when {slot} < 6 then '{SUBJECT_CERT}' else {_pad(slot, 5)} end)"


_YEAR_CERT = _cert(f"(case when c % 17 = 0 and year >= 1998 then (c + 7) % {CERTS} else c % {CERTS} end)")
_BASE_CERT = _cert(f"(c % {CERTS})")
_ID = _pad("c", 8)
_PARENT = f"concat(county_no, {_pad('p', 6)})"
_SERVICE = "case when c % 10 < 6 then '11' when c % 10 < 8 then '12' when c % 10 = 8 then '21' else '23' end"


def _lon(key: str) -> str:
    return f"(-93 + (({key} * 3700711) % 7000003) / 1000000.0D)"


def _lat(key: str) -> str:
    return f"(36 + (({key} * 9100717) % 11000009) / 1000000.0D)"


class DriverTables:
    """Lazy frames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- keys ---------------------------------------------------------------
    def branch_keys(self) -> DataFrame:
        """Customer key (c) with county number (q), tract slot (k), old tract slot (p), state."""
        # 25 nations: a fixed dimension, small at any scale factor
        nation = self.raw("nation").select("n_nationkey", "n_regionkey")
        keys = self.raw("customer").selectExpr(
            "c_custkey as c", "c_nationkey", "c_acctbal as bal",
            "c_nationkey + 25 * (c_custkey div 15000) as q",
            "(c_custkey % 7) + 7 * ((c_custkey % 15000) div 1500) as k",
            "((c_custkey % 7) div 2) + 4 * ((c_custkey % 15000) div 1500)"
            " + case when c_custkey % 13 = 0 then 1 else 0 end as p",
        )
        code = _pad("(case when (q + 2 * k) % 31 = 0 then 980000 + k else k end)", 6)
        return keys.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
            "c", "q", "k", "p", "bal", f"{_pad('n_regionkey', 2)} as state",
            f"{_pad('q', 5)} as county_no",
            f"case when c % 97 <> 0 then concat({_pad('q', 5)}, {code}) end as tract_geoid",
        )

    def located_keys(self) -> DataFrame:
        return self.branch_keys().filter("tract_geoid is not null")

    # -- facts --------------------------------------------------------------
    def _branch_year(self) -> DataFrame:
        """Cents per customer and year; long arithmetic keeps sums exact."""
        return self.raw("orders").groupBy(F.expr("o_custkey as c"), F.expr("year(o_orderdate) as year")).agg(
            F.expr("sum(cast(round(o_totalprice * 100) as bigint)) as cents")
        )

    def fact_branch_deposits(self) -> DataFrame:
        return self._branch_year().selectExpr(
            f"{_ID} as uninumbr", f"{_YEAR_CERT} as cert", "year", "(cents + 50) div 100 as deposits",
            "case when c % 53 = 0 then 10 * ((cents + 50) div 100) else 0 end as institution_total_deposits",
        )

    def _line_parts(self) -> int:
        """Tasks for the order lines, so that what one of them holds doesn't grow with the table (a count of footers)."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.raw("lineitem").count() // TASK_LINES))

    def _placed_lines(self) -> DataFrame:
        """Order lines with the tract of the ordering customer."""
        line = self.raw("lineitem").select(
            "l_orderkey", "l_suppkey", "l_returnflag", "l_linenumber", "l_extendedprice"
        ).repartition(self._line_parts(), "l_orderkey")
        tract = self.branch_keys().select("c", "tract_geoid")
        order_tract = self.raw("orders").select("o_orderkey", "o_custkey").join(
            tract, F.col("o_custkey") == F.col("c")
        ).select("o_orderkey", "tract_geoid")
        return line.join(order_tract, F.col("l_orderkey") == F.col("o_orderkey"))

    def fact_tract_lending(self) -> DataFrame:
        return (
            # a few records name a tract that no tract row describes
            self._placed_lines().filter("tract_geoid is not null").withColumn("tract_geoid", F.expr(
                "case when l_orderkey % 997 = 5 then concat(left(tract_geoid, length(tract_geoid) - 6), '999999')"
                " else tract_geoid end"))
            .repartition(self._line_parts(), "tract_geoid", "l_suppkey", "l_returnflag", "l_linenumber")
            .groupBy("tract_geoid", "l_suppkey", "l_returnflag", "l_linenumber")
            .agg(
                F.expr("count(1) as record_count"),
                F.expr("sum(cast(round(l_extendedprice * 100) as bigint)) as cents"),
            )
            .selectExpr(
                "tract_geoid", "lpad(cast(l_suppkey as string), 20, '0') as lei", "l_returnflag as loan_purpose",
                "cast(l_linenumber as string) as action_taken", "record_count", "cents / 100.0D as total_amount",
            )
            .withColumn("action_class", C.action_class("action_taken"))
        )

    def loan_records(self) -> DataFrame:
        """Unaggregated application records, all text, some without a tract."""
        return self._placed_lines().selectExpr(
            "tract_geoid as census_tract", "lpad(cast(l_suppkey as string), 20, '0') as lei",
            "l_returnflag as loan_purpose",
            # code 9 is not in the code list
            "case when l_orderkey % 499 = 7 then '9' else cast(l_linenumber as string) end as action_taken",
            "case when l_suppkey % 19 = 0 then 'Exempt'"
            " else cast(cast(round(l_extendedprice * 100) as bigint) as string) end as loan_amount",
            # every third tract reports no ratio at all
            "case when cast(tract_geoid as bigint) % 3 <> 0 then cast(40 + (l_suppkey * 7 + l_linenumber) % 90 as string)"
            " else 'NA' end as tract_to_msa_income_percentage",
        )

    def area_income(self) -> DataFrame:
        """Family income per area, the mean of its tracts; small areas are suppressed."""
        return self.dim_tract().filter("cbsa is not null").groupBy("cbsa").agg(
            F.expr("case when cbsa % 7 = 0 then -666666666D else round(avg(median_family_income)) end"
                   " as area_family_income"))

    # -- dimensions -----------------------------------------------------------
    def dim_branch(self) -> DataFrame:
        span = self._branch_year().groupBy(F.expr("c as sc")).agg(
            F.expr("min(year) as first_year"), F.expr("max(year) as last_year")
        )
        here = "tract_geoid is not null"
        return self.branch_keys().join(span, F.col("c") == F.col("sc"), "left").selectExpr(
            f"{_ID} as uninumbr", f"{_BASE_CERT} as cert", f"concat('Bank ', {_BASE_CERT}) as institution_name",
            "concat(cast(c % 900 + 1 as string), ' West Main Street') as address",
            "concat('City ', cast(c % 83 as string)) as city", "state",
            f"case when {here} and c % 29 = 0 then {_pad('(q + 1)', 5)} else county_no end as county_fips",
            f"case when {here} then {_lat('c')} end as latitude",
            f"case when {here} then {_lon('c')} end as longitude",
            "tract_geoid", f"{_SERVICE} as service_type",
            "case when c % 53 = 0 then '1' when c % 59 = 0 then null else '0' end as is_main_office",
            "first_year", "last_year",
            "case when c % 33 = 0 then 2.5D when c % 11 = 0 then 0.7D else 0D end as position_drift_miles",
            "case when c % 22 = 0 then 'relocation' when c % 11 = 0 then 'regeocode' else 'stable' end as drift_kind",
            f"case when {here} then c % 29 <> 0 end as county_agrees",
            f"case when {here} then 'ok' else 'missing_coordinates' end as validity",
            f"c % {CERTS} < 6 as is_subject_bank",
        )

    def dim_tract(self) -> DataFrame:
        base = self.located_keys().groupBy("tract_geoid", "county_no", "q", "k").agg(
            F.expr("min_by(bal, c) as bal_first"), F.expr("max_by(bal, c) as bal_last")
        ).selectExpr(
            "*",
            "cast(case when (q * 3 + k) % 23 = 0 then null when (q + k) % 19 = 0 then 0"
            " else 400 + (q * 37 + k * 211) % 2600 end as double) as hh",
            "case when round(bal_first * 10) >= 0 then round(bal_first * 10) end as fam",
            "case when round(bal_last * 8) >= 0 then round(bal_last * 8) end as inc",
            "case when (q * 7 + k) % 13 <> 0 then cast(40 + (q * 13 + k * 17) % 90 as double) end as pct",
            "case when (q * 2 + k) % 17 <> 0 then ((q * 5 + k * 3) % 40 - 12) / 10.0D end as growth",
        )
        center = "(7 * q + k + 3)"
        return base.selectExpr(
            "tract_geoid", "county_no as county_fips", "concat('County ', county_no) as county_name",
            "case when q % 4 <> 0 then county_no end as cbsa",
            "case when q % 4 <> 0 then concat('Area ', county_no) end as cbsa_title",
            "case q % 3 when 0 then 'metro' when 1 then 'micro' else 'rural' end as tier",
            "hh * 2.5D as population", "hh as households", "round(hh * 9D) / 10D as households_2019",
            "growth as household_growth_pct", "growth as household_growth_pct_tract",
            "case when (q * 2 + k) % 17 = 0 then 'parent_suppressed'"
            " when (q + k) % 5 = 0 then 'cluster' else 'direct' end as growth_basis",
            "cast(null as string) as growth_cluster", "1L as cluster_tracts", "inc as median_hh_income",
            "fam as median_family_income", "inc * 4 as median_home_value",
            "round(hh * 0.6D) as owner_occupied_units", "pct as tract_to_area_income_pct", "pct < 80 as lmi_flag",
            "case when pct is null then '' when k % 5 = 0 then 'acs_fallback' else 'ffiec_ratio' end as lmi_basis",
            f"{_lat(center)} as centroid_lat", f"{_lon(center)} as centroid_lon",
        ).withColumn("tract_status", C.tract_status("tract_geoid", "households", "median_family_income"))

    def dim_institution(self) -> DataFrame:
        """One row per certificate: 35 rows at any scale."""
        return self.spark.range(CERTS).filter("id = 0 or id >= 6").selectExpr(
            f"{_cert('id')} as cert", f"concat('Bank ', {_cert('id')}) as institution_name",
            f"{_pad('(id + 1000)', 7)} as fed_rssd",
            "case when id % 2 = 0 then lpad(cast(id as string), 20, '0') end as lei",
            "case when id % 2 = 0 then 'exact_rssd' else 'no_lei_for_rssd' end as match_quality",
            "case when id % 2 = 0 then 'fed_rssd == institutionId2017' else '' end as match_method",
            "id = 0 as is_subject_bank", "date'2002-01-01' as attribute_as_of_date",
        )

    def vintages(self) -> DataFrame:
        """Years present in the deposit fact."""
        return self.raw("orders").select(F.expr("year(o_orderdate) as year")).distinct()

    def dim_year(self) -> DataFrame:
        return self.vintages().withColumn("sod_as_of_date", C.as_of_date("year"))

    # -- raw yearly site file ----------------------------------------------
    def sod(self) -> DataFrame:
        """Branch-year records in the column names of the yearly file."""
        moved, island = "c % 11 = 0 and year >= 1998", "c % 101 = 0 and year < 1997"
        keys = self.branch_keys().withColumnRenamed("c", "bc")
        return self._branch_year().join(keys, F.col("c") == F.col("bc")).selectExpr(
            f"{_YEAR_CERT} as CERT", f"{_ID} as UNINUMBR", "year as YEAR", "state as STALPBR",
            f"case when c % 29 = 0 then {_pad('(q + 1)', 5)} else county_no end as STCNTYBR",
            f"concat('Bank ', {_YEAR_CERT}) as NAMEFULL",
            f"case when {moved} and c % 22 = 0 then concat(cast(c % 900 + 2 as string), ' East Oak Road')"
            " when year >= 1999 then concat(cast(c % 900 + 1 as string), ' W. Main St')"
            " else concat(cast(c % 900 + 1 as string), ' West Main Street') end as ADDRESBR",
            "concat('City ', cast(c % 83 as string)) as CITYBR", f"{_SERVICE} as BRSERTYP",
            "case when c % 53 = 0 then '1' else '0' end as BKMO",
            # a few sites book corporate balances, some of them in early years only
            "(case when c % 71 = 0 and (year < 1998 or c % 142 = 0) then 40 else 1 end)"
            " * ((cents + 50000) div 100000) as DEPSUMBR",
            f"case when tract_geoid is not null then case when {island} then 0D"
            f" when {moved} then {_lat('c')} + 0.01D else {_lat('c')} end end as SIMS_LATITUDE",
            f"case when tract_geoid is not null then case when {island} then 0D else {_lon('c')} end end"
            " as SIMS_LONGITUDE",
            "case when c % 9 <> 0 then concat('06/30/', cast(1985 + c % 15 as string)) end as SIMS_ESTABLISHED_DATE",
            "tract_geoid",
        )

    # -- areas ----------------------------------------------------------------
    def tract_overlaps(self) -> DataFrame:
        """New tract x old tract land overlaps, with slivers and water-only rows."""
        return self.located_keys().selectExpr(
            "tract_geoid as child", f"{_PARENT} as parent",
            "case when c % 37 = 0 then 0 when c % 39 = 0 then 1 else c % 900 + 100 end as land",
        ).groupBy("child", "parent").agg(F.expr("sum(land) as land_part"))

    def old_tract_counts(self) -> DataFrame:
        """Old tracts with their households; negative means suppressed."""
        return self.located_keys().selectExpr(
            f"{_PARENT} as parent",
            "cast(case when (q + p) % 11 = 0 then -666666666 else 300 + (q * 31 + p * 173) % 2000 end as double) as h",
        ).groupBy("parent").agg(F.expr("max(h) as households_old"))

    def tile_polygons(self) -> DataFrame:
        """Quarter-degree squares around supplier positions, every other one with a hole.

        Vertices run counter-clockwise outside and clockwise in the hole; rings
        are not closed.
        """
        tiles = self.raw("supplier").selectExpr(
            f"cast(floor(({_lon('s_suppkey')} + 93) * 4) as int) as i",
            f"cast(floor(({_lat('s_suppkey')} - 36) * 4) as int) as j",
        ).distinct()
        return self.rings(tiles.selectExpr(
            "i", "j", "concat(lpad(cast(i as string), 3, '0'), lpad(cast(j as string), 3, '0')) as poly_id"))

    @staticmethod
    def rings(tiles: DataFrame) -> DataFrame:
        """Vertices of tiles (i, j, poly_id)."""
        outer = "array(array(0D, 0D), array(4D, 0D), array(4D, 4D), array(0D, 4D))"
        hole = "array(array(1D, 1D), array(1D, 3D), array(3D, 3D), array(3D, 1D))"
        rings = tiles.selectExpr(
            "i", "j", "poly_id", f"posexplode(case when (i + j) % 2 = 0 then array({outer}, {hole}) else array({outer}) end)"
            " as (ring, pts)"
        )
        return rings.selectExpr("i", "j", "poly_id", "ring + 1 as ring_id", "posexplode(pts) as (seq, pt)").selectExpr(
            "poly_id", "ring_id", "seq",
            "-93 + (i + pt[0] / 4) / 4 as lon", "36 + (j + pt[1] / 4) / 4 as lat",
        )

    def branch_points(self) -> DataFrame:
        """Located branches as degrees."""
        return self.located_keys().selectExpr(f"{_ID} as uninumbr", f"{_lon('c')} as lon", f"{_lat('c')} as lat")

    def register(self) -> DataFrame:
        """Institution register: certificate and register number; some lack one or both."""
        return self.spark.range(CERTS).filter("(id = 0 or id >= 6) and id % 13 <> 0 or id = 0").selectExpr(
            f"{_cert('id')} as CERT",
            f"case when id % 11 = 7 then '' else {_pad('(id + 1000)', 7)} end as fed_rssd",
        )

    def lei_lookup(self) -> DataFrame:
        """(rssd, lei) pairs for the lenders that have a supplier row."""
        return self.raw("supplier").filter("s_suppkey % 2 = 0").selectExpr(
            f"{_pad('(s_suppkey + 1000)', 7)} as rssd", "lpad(cast(s_suppkey as string), 20, '0') as lei"
        )

    def assets(self) -> DataFrame:
        """Assets per certificate in thousands, from the deposits filed under it."""
        return self.fact_branch_deposits().groupBy(F.col("cert").alias("CERT")).agg(
            F.expr("sum(deposits) div 1000 as asset_k"))

    def state_totals(self) -> DataFrame:
        """Published totals: the same aggregate with one state-year gone, one altered."""
        per_state = self._branch_year().join(self.branch_keys().select("c", "state"), "c").groupBy("year", "state").agg(
            F.expr("count(1) as n"), F.expr("sum((cents + 50) div 100) as d")
        )
        extra = self.vintages().selectExpr("max(year) as year").selectExpr(
            "year + 1 as year", "'00' as state", "1L as branches", "1.0D as deposits_thousands"
        )
        return per_state.filter("not (year = 1996 and state = '01')").selectExpr(
            "year", "state", "n + case when year = 1997 and state = '02' then 1 else 0 end as branches",
            "d / 1000.0D * case when year = 1998 and state = '03' then 1.002D else 1D end as deposits_thousands",
        ).unionByName(extra)

    def index_weights(self) -> DataFrame:
        return self.spark.createDataFrame(INDEX_WEIGHTS, WEIGHT_SCHEMA)

    def warehouse(self) -> Warehouse:
        return Warehouse.from_tables(self)
