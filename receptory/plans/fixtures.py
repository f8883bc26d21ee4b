"""Receptor rows and HLA types derived from the driver's tables; one text for both engines."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from receptory.operators.keep import kept

_AA = "'ACDEFGHIKLMNPQRSTVWY'"


def _pick(place: str) -> str:
    return f"substr({_AA}, cast(1 + {place} as int), 1)"


TCR = f"""
select row_idx, case when o % 2 = 0 then 'sample' else 'reference' end as role,
  'CAS' || {_pick("q % 20")} || {_pick("d")} || {_pick("(s % 20)")}
  || case when o % 2 = 0 and s % 25 = 3 then 'WDQY' else '' end || {_pick("t")}
  || substr({_pick("(p % 20)")} || {_pick("(p * 7 % 19)")} || {_pick("(o % 17)")} || {_pick("(o * 3 % 13)")}, 1, cast(ln % 5 as int))
  || case rf when 'A' then 'QYF' when 'N' then 'EAF' else 'YTF' end as cdr3,
  'TRBV' || cast(1 + s % 12 as string) as v_gene, 'TRBJ' || cast(1 + p % 7 as string) as j_gene,
  'D' || cast(ck as string) || case ck % 3 when 0 then ':CMV+' when 1 then ':CMV-' else ':CMVNA' end as subject, q as count
from (select l_orderkey * 8 + l_linenumber as row_idx, l_orderkey as o, l_linenumber as ln, l_partkey as p, l_suppkey as s, l_returnflag as rf,
  cast(round(l_quantity) as bigint) as q, cast(round(l_discount * 100) as bigint) as d, cast(round(l_tax * 100) as bigint) as t, o_custkey % 200 as ck
  from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey)
"""
HLA = """
select subject, 'HLA-A*0' || cast(n % 5 as string) as allele from (select distinct subject, cast(regexp_extract(subject, 'D([0-9]+)', 1) as int) as n from {tcr}) where n % 4 <> 0
union all
select subject, 'HLA-B*0' || cast(n % 7 as string) as allele from (select distinct subject, cast(regexp_extract(subject, 'D([0-9]+)', 1) as int) as n from {tcr}) where n % 4 <> 0
"""


def tcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TCR, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


class Receptors:
    """What one query reads of the receptor rows, which are worked out once and stored for it."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def tcr(self) -> DataFrame:
        return kept(tcr(self.spark, self.sf_dir))

    @property
    def sample(self) -> DataFrame:
        return self.tcr.where("role = 'sample'").drop("role")

    @property
    def reference(self) -> DataFrame:
        return self.tcr.where("role = 'reference'").select("cdr3")

    @property
    def hla(self) -> DataFrame:
        return self.spark.sql(HLA, tcr=self.sample)


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tcr(spark, sf_dir).where("role = 'sample'").drop("role")


def tcr_sql() -> str:
    return TCR.format(lineitem="lineitem", orders="orders")
