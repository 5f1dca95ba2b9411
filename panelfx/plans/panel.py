"""Analysis tables derived from the driver tables.

``order_panel``  one row per order: year, segment, region, binary treatment
                 (priority URGENT/HIGH) and outcome ln(total price).
``firm_panel``   the survey-like panel of FIXTURES.md §2: one row per
                 customer and order year with planted missing values, codes
                 and bad text, built with the DataFrame API.

Both are lazy plans; column pruning and filters reach the parquet scans.
The only broadcast is ``nation`` (the TPC-H nation table has exactly 25 rows
by definition).  ``customer`` grows with the data and is joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (orders
            .join(customer, orders.o_custkey == customer.c_custkey)
            .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").cast("long").alias("year"),
                    F.col("c_mktsegment").alias("segment"),
                    F.col("n_regionkey").alias("region"),
                    F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("t"),
                    F.ln("o_totalprice").alias("y")))


ORDER_PANEL_SQL = """
  select o_orderkey as id, year(o_orderdate) as year, c_mktsegment as segment, n_regionkey as region,
         case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end as t,
         ln(o_totalprice) as y
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
"""

# Year from which the new code wave applies in the fixture.
CODE_WAVE_CUTOFF = 1997
CODE_COLUMNS = ("dti_iot", "dti_cloud", "dti_ai", "dti_bigdata")


def _count_if(cond):
    return F.sum(F.when(cond, 1).otherwise(0))


def firm_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")

    # Pre-aggregate lineitem per order (partial aggregation before the
    # shuffle), so the join with orders moves one row per order.
    li = (lineitem.groupBy("l_orderkey")
          .agg(F.sum("l_quantity").alias("qty"),
               F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("mat"),
               F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("eng"),
               F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("dsc"),
               F.count(F.lit(1)).alias("n_lines")))
    o = (orders.join(li, orders.o_orderkey == li.l_orderkey, "left")
         .select(F.col("o_custkey"), F.year("o_orderdate").cast("long").alias("yr"), "o_totalprice",
                 F.col("o_orderpriority").alias("pri"), F.col("o_orderstatus").alias("st"),
                 *[F.coalesce(c, F.lit(0)).alias(c) for c in ("qty", "mat", "eng", "dsc", "n_lines")]))
    urgent = F.col("pri") == "1-URGENT"
    g = (o.groupBy(F.col("o_custkey").alias("firm_id"), "yr")
         .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("revenue"),
              F.sum("qty").alias("employees"), F.sum("mat").alias("materials"),
              F.sum("eng").alias("energy"), F.sum("dsc").alias("dsc"), F.sum("n_lines").alias("n_lines"),
              _count_if(urgent & (F.col("st") == "F")).alias("a"),
              _count_if(urgent & (F.col("st") == "O")).alias("b"),
              _count_if(urgent & (F.col("st") == "P")).alias("c"),
              _count_if((F.col("pri") == "2-HIGH") & (F.col("st") == "F")).alias("d")))
    fid, yr = F.col("firm_id"), F.col("yr")
    new_wave = yr >= CODE_WAVE_CUTOFF + 1

    def code(cnt: str):
        c = F.col(cnt)
        return (F.when(c > 0, F.least(c + F.when(new_wave, 1).otherwise(0), F.lit(6)))
                .when(new_wave & (fid % 2 == 0), F.lit(1)))

    return (g.join(customer, fid == customer.c_custkey)
            .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(fid.alias("firm_id"), yr.alias("year"), F.col("c_mktsegment").alias("sector"),
                    F.col("n_nationkey").alias("industry_2digit"), F.col("n_regionkey").alias("region"),
                    "revenue", "employees", F.col("c_acctbal").alias("capital"), "materials", "energy",
                    F.when((fid * 7 + yr) % 5 == 0, F.lit(None)).otherwise(F.col("dsc")).alias("debt"),
                    F.when((fid * 3 + yr * 11) % 7 < 2, F.lit(None)).otherwise(F.col("n_lines")).alias("rd_employees"),
                    F.when(fid % 13 == 0, F.lit("n/a")).when(fid % 17 == 0, F.lit(None).cast("string"))
                     .otherwise(F.col("n_orders").cast("string")).alias("exports_txt"),
                    F.when(fid % 11 == 0, F.lit(None).cast("string")).when(fid % 3 == 0, F.lit("Y"))
                     .when(fid % 3 == 1, F.lit("N")).otherwise(F.lit("*")).alias("has_subsidiaries"),
                    code("a").alias("dti_iot"), code("b").alias("dti_cloud"),
                    code("c").alias("dti_ai"), code("d").alias("dti_bigdata")))


# The same fixture as SQL text (runs unchanged in DuckDB); oracles inline it.
FIRM_PANEL_SQL = """
with li as (
  select l_orderkey, sum(l_quantity) qty, sum(l_extendedprice*(1-l_discount)) mat, sum(l_extendedprice*l_tax) eng,
         sum(l_extendedprice*l_discount) dsc, count(*) n_lines
  from lineitem group by l_orderkey),
o as (
  select o_custkey, year(o_orderdate) yr, o_totalprice, o_orderpriority pri, o_orderstatus st,
         coalesce(qty,0) qty, coalesce(mat,0) mat, coalesce(eng,0) eng, coalesce(dsc,0) dsc, coalesce(n_lines,0) n_lines
  from orders left join li on o_orderkey=l_orderkey),
g as (
  select o_custkey firm_id, yr, count(*) n_orders, sum(o_totalprice) revenue, sum(qty) employees, sum(mat) materials,
         sum(eng) energy, sum(dsc) dsc, sum(n_lines) n_lines,
         sum(case when pri='1-URGENT' and st='F' then 1 else 0 end) a, sum(case when pri='1-URGENT' and st='O' then 1 else 0 end) b,
         sum(case when pri='1-URGENT' and st='P' then 1 else 0 end) c, sum(case when pri='2-HIGH' and st='F' then 1 else 0 end) d
  from o group by o_custkey, yr)
select firm_id, yr as year, c_mktsegment as sector, n_nationkey as industry_2digit, n_regionkey as region,
  revenue, employees, c_acctbal as capital, materials, energy,
  case when (firm_id*7+yr) % 5 = 0 then null else dsc end as debt,
  case when (firm_id*3+yr*11) % 7 < 2 then null else n_lines end as rd_employees,
  case when firm_id % 13 = 0 then 'n/a' when firm_id % 17 = 0 then null else cast(n_orders as varchar(20)) end as exports_txt,
  case when firm_id % 11 = 0 then null when firm_id % 3 = 0 then 'Y' when firm_id % 3 = 1 then 'N' else '*' end as has_subsidiaries,
  case when a>0 then least(a + case when yr>=1998 then 1 else 0 end, 6) when yr>=1998 and firm_id % 2 = 0 then 1 end as dti_iot,
  case when b>0 then least(b + case when yr>=1998 then 1 else 0 end, 6) when yr>=1998 and firm_id % 2 = 0 then 1 end as dti_cloud,
  case when c>0 then least(c + case when yr>=1998 then 1 else 0 end, 6) when yr>=1998 and firm_id % 2 = 0 then 1 end as dti_ai,
  case when d>0 then least(d + case when yr>=1998 then 1 else 0 end, 6) when yr>=1998 and firm_id % 2 = 0 then 1 end as dti_bigdata
from g join customer on firm_id=c_custkey join nation on c_nationkey=n_nationkey
"""
