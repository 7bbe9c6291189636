"""Domain tables derived from the given test tables.

The expressions are plain SQL that Spark and the checking engine read alike, so that both
sides of a check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

YEAR = "year(o_orderdate)"


def span(first: str, last: str) -> str:
    """Text ``YYYY-yy`` from two year expressions."""
    return f"concat(CAST({first} AS STRING), '-', lpad(CAST(({last}) % 100 AS STRING), 2, '0'))"


SEASON = span(YEAR, f"{YEAR} + 1")

RAW_SITE = (
    "CASE n_nationkey WHEN 0 THEN 'Junju' WHEN 1 THEN 'Ngerenya' WHEN 2 THEN 'Kadzinuni-Mauveni' ELSE n_name END"
)
LONG_SITE = (
    "CASE n_nationkey WHEN 0 THEN 'Junju (Kilifi B)' WHEN 1 THEN 'Ngerenya (Kilifi A)' "
    "WHEN 2 THEN 'Kadziununi-Mauveni (Kilifi C)' ELSE n_name END"
)
SHORT_SITE = (
    "CASE n_nationkey WHEN 0 THEN 'Kilifi B' WHEN 1 THEN 'Kilifi A' WHEN 2 THEN 'Kilifi C' ELSE n_name END"
)

PERIOD_REPAIR = {"1995-1996": "1995-96"}

HB = "CASE WHEN l_linenumber <> 7 OR n_nationkey = 4 THEN l_quantity / 4 END"

ADMISSIONS = {
    "site": RAW_SITE,
    "period": f"CASE WHEN n_nationkey % 5 = 0 AND {YEAR} = 1995 THEN '1995-1996' ELSE {SEASON} END",
    "adm_month": "CAST(month(o_orderdate) AS INT)",
    "adm_year": f"CAST({YEAR} AS INT)",
    "sex": "CASE WHEN l_orderkey % 2 = 0 THEN 'M' ELSE 'F' END",
    "age_years": "CASE WHEN l_orderkey % 97 <> 0 THEN CAST(l_orderkey % 10 AS INT) END",
    "age_months": "CAST(l_orderkey % 120 AS DOUBLE)",
    "temperature": "36 + l_discount * 40",
    "fever": "CASE l_suppkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' ELSE 'unk' END",
    "fever_days": "CAST(l_linenumber AS DOUBLE)",
    "convulsions": "CASE l_partkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' ELSE '?' END",
    "fits_per_24h": "CAST(l_linenumber % 4 AS DOUBLE)",
    "nasal_flaring": "CASE WHEN l_linenumber = 6 THEN NULL WHEN l_suppkey % 2 = 0 THEN 'Y' ELSE 'N' END",
    "intercostal_recession": "CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_suppkey % 2 = 0 THEN 'Y' ELSE 'N' END",
    "deep_breathing": "CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_linestatus = 'F' THEN 'Y' ELSE 'N' END",
    "unconscious": "CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_tax >= 0.065 THEN 'Y' ELSE 'N' END",
    "apvu": (
        "CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 4 = 0 THEN 'A' WHEN l_partkey % 4 = 1 THEN 'P' "
        "WHEN l_partkey % 4 = 2 THEN 'V' ELSE 'U' END"
    ),
    "bcs": "CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_partkey % 6 AS INT) END",
    "pallor": (
        "CASE WHEN l_linenumber <= 2 THEN 'Severe' WHEN l_linenumber <= 4 THEN 'Mild' "
        "WHEN l_linenumber = 5 THEN 'None' END"
    ),
    "hb_level": HB,
    "transfusion": "CASE l_returnflag WHEN 'A' THEN 'Y' WHEN 'R' THEN 'N' END",
    "outcome": (
        "CASE l_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'D' WHEN 2 THEN 'Unknown' ELSE 'T' END"
    ),
    "sma": f"CASE WHEN ({HB}) < 5 THEN 'Y' END",
}

LOCATIONS = {
    "country": "r_name",
    "site": LONG_SITE,
    "period": f"CASE WHEN n_nationkey = 2 THEN '2018-19' ELSE {SEASON} END",
}
LOCATION_FACTS = {
    "pr_dates": "period",
    "detection_method": "CASE n_nationkey % 3 WHEN 0 THEN 'RDT' WHEN 1 THEN 'Microsopy' ELSE 'Microscopy' END",
    "latitude": "n_nationkey * CAST(0.5 AS DOUBLE) - 5",
    "longitude": "n_nationkey * CAST(0.25 AS DOUBLE) + 30",
    "hbas": "CAST(n_nationkey % 20 AS DOUBLE)",
    "hospital_min_dist": "CAST(n_nationkey % 3 AS DOUBLE)",
    "hospital_max_dist": "CAST(n_nationkey % 3 + 10 AS DOUBLE)",
    "itn": "CAST(n_nationkey * 4 AS DOUBLE)",
    "irs": "CASE n_nationkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' WHEN 2 THEN '[N]' END",
    "rainfall": "CAST(800 + n_nationkey AS DOUBLE)",
    "altitude": "CAST(n_nationkey * 50 AS DOUBLE)",
    "pr_c": "CAST(20 + n_nationkey AS DOUBLE)",
}

POPULATION_PERIOD = f"CASE WHEN n_nationkey = 2 THEN '2017-19' ELSE {SEASON} END"
POPULATION_AGE = "o_orderkey % 10"
POPULATION = {
    "n_nationkey": "n_nationkey",
    "file_id": f"concat({RAW_SITE}, ' ', period)",
    "age": (
        "CASE WHEN n_nationkey = 9 AND period = '1998-99' AND age_group = 5 THEN NULL "
        "WHEN age_group = 0 THEN '3m-11m' ELSE concat(CAST(age_group AS STRING), 'y') END"
    ),
    "pyor": (
        "CASE WHEN n_nationkey = 7 AND period = '1999-00' AND age_group = 3 THEN NULL "
        "ELSE CAST(n AS DOUBLE) * 50 END"
    ),
}

SURVEYS = {
    "site": f"concat({SHORT_SITE}, ', ', country)",
    "period": "period",
    "min_age": "n_nationkey % 4 + CAST(0.5 AS DOUBLE)",
    "max_age": "CAST(5 + n_nationkey * 4 AS DOUBLE)",
    "number": "n_examined",
    "positives": "n_positive",
}

SITE_INDEXES = range(1, 21)
EFFECT_INDEXES = range(1, 17)
EVENT_INDEXES = 10


def draw_columns(first: int) -> dict[str, str]:
    """Parameters of a draw from an array whose first position is ``first``."""

    def e(i: int) -> str:
        return f"CAST(embedding[{i + first}] AS DOUBLE)"

    columns = {
        "chain": "CAST(vec_id % 4 AS INT)",
        "iteration": "vec_id",
        "intercept": f"-6 + 0.5 * {e(0)}",
        "beta1": f"1 + {e(1)}",
        "beta2": f"exp({e(6)})",
        "r": f"5 + {e(7)}",
        "alpha_parm[1]": f"-6 + 0.5 * {e(0)}",
        "alpha_parm[2]": f"1 + {e(2)}",
        "betas[1]": f"1 + {e(1)}",
        "betas[2]": f"-1 + {e(3)}",
        "sigma": f"2 + abs({e(4)})",
        "PR_crit": f"0.25 + 0.2 * {e(5)}",
    }
    for i in SITE_INDEXES:
        columns[f"PR_corrected[{i}]"] = (
            f"greatest(least(0.3 + {e(7 + i)}, CAST(0.75 AS DOUBLE)), CAST(0.01 AS DOUBLE))"
        )
        columns[f"estimated_admissions[{i}]"] = f"50 + 100 * abs({e(27 + i)})"
    for i in EFFECT_INDEXES:
        columns[f"RE[{i}]"] = e(47 + i)
    return columns


DRAWS_LONG = {
    "model": "event_type",
    "chain": "CAST(event_id % 4 AS INT)",
    "iteration": "event_id",
    "parameter": "concat(event_type, '[', CAST(user_id % 10 AS STRING), ']')",
    "idx": "CAST(user_id % 10 AS INT)",
    "value": "value",
}


def projected(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS `{name}`" for name, sql in columns.items()])


class Testbed:
    """The given tables of one folder, bound to the domain tables."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def _orders(self, regions: bool = False) -> DataFrame:
        nations = self.table("nation")
        if regions:
            nations = nations.join(self.table("region"), self._on("n_regionkey", "r_regionkey"))
        customers = self.table("customer").join(nations, self._on("c_nationkey", "n_nationkey"))
        return self.table("orders").join(customers, self._on("o_custkey", "c_custkey"))

    @staticmethod
    def _on(left: str, right: str) -> Column:
        return F.col(left) == F.col(right)

    def admissions(self) -> DataFrame:
        # both sides grow with the data: shuffle them on the order, never broadcast one
        joined = self.table("lineitem").join(self._orders().hint("merge"), self._on("l_orderkey", "o_orderkey"))
        return projected(joined, ADMISSIONS)

    def locations(self) -> DataFrame:
        keyed = self._orders(regions=True).selectExpr(
            "n_nationkey", "o_orderstatus", *[f"{sql} AS {name}" for name, sql in LOCATIONS.items()]
        )
        counted = keyed.groupBy("n_nationkey", *LOCATIONS).agg(
            _agg("count(*)", "n_examined"), _agg("count_if(o_orderstatus = 'P')", "n_positive")
        )
        facts = {"n_nationkey": "n_nationkey", **{c: c for c in LOCATIONS}, **LOCATION_FACTS}
        return projected(counted, {**facts, "n_examined": "n_examined", "n_positive": "n_positive"})

    def locations_raw(self) -> DataFrame:
        return self.locations().drop("n_nationkey")

    def population_parts(self) -> list[DataFrame]:
        keyed = self._orders().selectExpr(
            "n_nationkey", "n_name", f"{POPULATION_PERIOD} AS period", f"{POPULATION_AGE} AS age_group"
        )
        counted = keyed.groupBy("n_nationkey", "n_name", "period", "age_group").agg(_agg("count(*)", "n"))
        parts = projected(counted, POPULATION)
        return [parts.where(f"n_nationkey % 2 = {half}").drop("n_nationkey") for half in (0, 1)]

    def surveys(self) -> DataFrame:
        named = self.locations().join(self.table("nation").select("n_nationkey", "n_name"), "n_nationkey")
        return projected(named, SURVEYS)

    def draws_wide(self) -> DataFrame:
        return projected(self.table("embeddings"), draw_columns(0))

    def draws_long(self) -> DataFrame:
        return projected(self.table("events"), DRAWS_LONG)


def _agg(sql: str, name: str) -> Column:
    return F.expr(sql).alias(name)
