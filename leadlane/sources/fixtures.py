"""Order-domain views over the driver's TPC-H-style parquet tables.

The driver data has no work orders, so the six views below derive them with
integer arithmetic (see FIXTURES.md). ``load_views`` builds them with the
DataFrame API (column pruning reaches every parquet scan); ``VIEW_SQL`` holds
the same definitions as DuckDB SQL for the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mat(key) -> F.Column:
    """Material number: the family (first six characters) varies with the key, and no two keys share a number."""
    return F.concat(F.lit("MAT"), F.lpad((key % 1000).cast("string"), 3, "0"),
                    F.lpad(F.floor(key / 1000).cast("string"), 6, "0"))


def _line(key) -> F.Column:
    """Twenty parts share a production line, so the number of lines follows the data."""
    return F.floor(key / 20).cast("long")


def fg_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A rule on the key leaves some materials without master data; all other parts are there.
    p = _table(spark, sf_dir, "part").filter(F.col("p_partkey") % 67 != 5)
    return p.select(
        _mat(F.col("p_partkey")).alias("material"),
        F.col("p_name").alias("material_description"),
        F.concat(F.lit("L"), _line(F.col("p_partkey")).cast("string")).alias("production_line"),
        F.when(F.col("p_size") % 3 == 0, 5.0).otherwise(30.0).cast("double").alias("constraint_factor"),
        (F.col("p_size") % 7).cast("double").alias("earliest_start_days"),
        (F.lit(1.0) + (F.col("p_size") % 8).cast("double") / 2).alias("total_production_time"),
    )


def capacity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One row a line; a rule on the line's number leaves some lines without capacity.
    k = F.col("k")
    p = _table(spark, sf_dir, "part").select(_line(F.col("p_partkey")).alias("k")).distinct().filter(k % 12 != 11)
    return p.select(
        F.concat(F.lit("L"), k.cast("string")).alias("production_line"),
        (10 + k % 5).cast("double").alias("cap_mo"),
        (11 + k % 4).cast("double").alias("cap_tu"),
        (12 + k % 3).cast("double").alias("cap_we"),
        (11 + k % 2).cast("double").alias("cap_th"),
        (8 + k % 5).cast("double").alias("cap_fr"),
    )


def history_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work orders = lineitem aggregated on (orderkey, linenumber), dated by orders.

    Lines are dealt by ``l_orderkey`` once: the grouping on (orderkey, linenumber)
    and the join on the order need no other exchange.
    """
    li = (_table(spark, sf_dir, "lineitem").repartition("l_orderkey")
          .groupBy("l_orderkey", "l_linenumber")
          .agg(F.min("l_partkey").alias("pk"), F.sum("l_quantity").alias("qty")))
    o = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), F.col("o_orderdate").cast("date").alias("od"), F.col("o_orderstatus").alias("st"))
    t = li.join(o, li.l_orderkey == o.o_orderkey, "inner").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pn"),
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), "pk", "qty", "od", "st")
    pn, pk, od = F.col("pn"), F.col("pk"), F.col("od")
    finish_offset = (pn * 7 + pk) % 24 + F.when(pn % 97 == 0, 40).otherwise(0)
    return t.select(
        pn.alias("production_number"),
        F.col("ok").alias("sales_doc"),
        F.col("ln").alias("item"),
        _mat(pk).alias("material"),
        F.col("qty").alias("order_quantity"),
        od.alias("created_date"),
        F.date_add(od, (pn % 6).cast("int")).alias("planned_start_date"),
        F.date_add(od, (pn % 6 + 1 + pk % 5).cast("int")).alias("planned_finish_date"),
        F.date_add(od, (pn % 5).cast("int")).alias("actual_start_date"),
        F.when(F.col("st") == "O", F.lit(None).cast("date"))
         .otherwise(F.date_add(od, finish_offset.cast("int"))).alias("actual_finish_date"),
        F.when(pk % 4 == 0, "CVC").otherwise("VSC").alias("mrp_controller"),
        F.when(pn % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("SUP"), (pk % 3).cast("string"))).alias("production_supervisor"),
    )


def shortage_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    sign = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    amount = F.when(F.col("l_discount") >= 0.07, F.col("l_quantity") * F.col("l_discount")).otherwise(F.lit(0.0))
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("production_number"),
        F.col("l_suppkey").alias("component_material"),
        F.col("l_quantity").alias("required_qty"),
        (sign * amount).alias("shortage_qty"),
    )


def production_orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = F.col("o_orderdate").cast("date")
    return o.select(
        k.alias("order_id"),
        _mat(c).alias("material_id"),
        (1000 + 1000 * (c % 3)).cast("string").alias("plant"),
        F.when(c % 2 == 0, "ZP01").otherwise("ZP02").alias("order_type"),
        d.alias("planned_start"),
        F.date_add(d, (10 + k % 9).cast("int")).alias("planned_finish"),
        F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("date"))
         .otherwise(F.date_add(d, (6 + (k * 5) % 17).cast("int"))).alias("actual_finish"),
        F.col("o_totalprice").alias("planned_qty"),
        F.when(F.col("o_orderstatus") == "O", "REL").otherwise("CNF").alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
    )


def scored_view(history: DataFrame) -> DataFrame:
    """Deterministic model stand-in so roll-ups have an SQL oracle."""
    pn = F.col("production_number")
    fin, cre = F.col("actual_finish_date"), F.col("created_date")
    actual = (F.when(fin.isNull(), F.lit(None).cast("double"))
              .when(F.date_sub(fin, 1) < cre, F.lit(1.0))
              .otherwise(F.datediff(fin, cre).cast("double")))
    return history.select(
        "production_number", "material", "order_quantity", "planned_start_date", "planned_finish_date",
        actual.alias("actual"),
        (F.lit(1.0) + ((pn * 13) % 160).cast("double") / 10).alias("predicted"),
        (((pn * 17) % 1001).cast("double") / 1000).alias("delay_probability"),
    )


class Views:
    """Lazily built fixture views for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    def table(self, name: str) -> DataFrame:
        return _table(self.spark, self.sf_dir, name)

    @property
    def fg(self):
        return self._get("fg", lambda: fg_view(self.spark, self.sf_dir))

    @property
    def capacity(self):
        return self._get("capacity", lambda: capacity_view(self.spark, self.sf_dir))

    @property
    def history(self):
        return self._get("history", lambda: history_view(self.spark, self.sf_dir))

    @property
    def shortage(self):
        return self._get("shortage", lambda: shortage_view(self.spark, self.sf_dir))

    @property
    def production_orders(self):
        return self._get("production_orders", lambda: production_orders_view(self.spark, self.sf_dir))

    @property
    def scored(self):
        return self._get("scored", lambda: scored_view(self.history))


# DuckDB text of the same views (FIXTURES.md), inlined as CTEs by the oracles.
VIEW_SQL = {
    "fg": """select 'MAT' || lpad(cast(p_partkey % 1000 as string), 3, '0') || lpad(cast(p_partkey // 1000 as string), 6, '0') as material, p_name as material_description,
  'L' || cast(p_partkey // 20 as string) as production_line,
  cast(case when p_size % 3 = 0 then 5 else 30 end as double) as constraint_factor,
  cast(p_size % 7 as double) as earliest_start_days,
  cast(1 as double) + cast(p_size % 8 as double) / 2 as total_production_time
from part where p_partkey % 67 <> 5""",
    "capacity": """select 'L' || cast(k as string) as production_line,
  cast(10 + k % 5 as double) as cap_mo, cast(11 + k % 4 as double) as cap_tu,
  cast(12 + k % 3 as double) as cap_we, cast(11 + k % 2 as double) as cap_th,
  cast(8 + k % 5 as double) as cap_fr
from (select distinct p_partkey // 20 as k from part) lines where k % 12 <> 11""",
    "history": """select pn as production_number, ok as sales_doc, ln as item,
  'MAT' || lpad(cast(pk % 1000 as string), 3, '0') || lpad(cast(pk // 1000 as string), 6, '0') as material, qty as order_quantity,
  od as created_date, od + cast(pn % 6 as int) as planned_start_date,
  od + cast(pn % 6 + 1 + pk % 5 as int) as planned_finish_date,
  od + cast(pn % 5 as int) as actual_start_date,
  case when st = 'O' then null
       else od + cast((pn * 7 + pk) % 24 + case when pn % 97 = 0 then 40 else 0 end as int) end as actual_finish_date,
  case when pk % 4 = 0 then 'CVC' else 'VSC' end as mrp_controller,
  case when pn % 11 = 0 then null else 'SUP' || cast(pk % 3 as string) end as production_supervisor
from (select l_orderkey * 10 + l_linenumber as pn, l_orderkey as ok, l_linenumber as ln,
        min(l_partkey) as pk, sum(l_quantity) as qty, min(cast(o_orderdate as date)) as od,
        min(o_orderstatus) as st
      from lineitem join orders on l_orderkey = o_orderkey group by l_orderkey, l_linenumber) t""",
    "shortage": """select l_orderkey * 10 + l_linenumber as production_number, l_suppkey as component_material,
  l_quantity as required_qty,
  cast(case when l_returnflag = 'R' then -1 else 1 end as double)
    * case when l_discount >= 0.07 then l_quantity * l_discount else cast(0 as double) end as shortage_qty
from lineitem""",
    "production_orders": """select o_orderkey as order_id, 'MAT' || lpad(cast(o_custkey % 1000 as string), 3, '0') || lpad(cast(o_custkey // 1000 as string), 6, '0') as material_id,
  cast(1000 + 1000 * (o_custkey % 3) as string) as plant,
  case when o_custkey % 2 = 0 then 'ZP01' else 'ZP02' end as order_type,
  cast(o_orderdate as date) as planned_start,
  cast(o_orderdate as date) + cast(10 + o_orderkey % 9 as int) as planned_finish,
  case when o_orderstatus = 'O' then null
       else cast(o_orderdate as date) + cast(6 + (o_orderkey * 5) % 17 as int) end as actual_finish,
  o_totalprice as planned_qty, case when o_orderstatus = 'O' then 'REL' else 'CNF' end as status,
  cast(substring(o_orderpriority, 1, 1) as int) as priority
from orders""",
    "scored": """select production_number, material, order_quantity, planned_start_date, planned_finish_date,
  case when actual_finish_date is null then null
       when actual_finish_date - interval '1' day < created_date then cast(1 as double)
       else cast(datediff('day', created_date, actual_finish_date) as double) end as actual,
  cast(1 as double) + cast((production_number * 13) % 160 as double) / 10 as predicted,
  cast((production_number * 17) % 1001 as double) / 1000 as delay_probability
from history""",
}

VIEW_DEPS = {"scored": ["history"]}
VIEW_ORDER = ["fg", "capacity", "history", "shortage", "production_orders", "scored"]


def with_views(body: str, views: list[str], extra_ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the fixture views it needs (plus extra named CTEs)."""
    need = set(views)
    for v in list(need):
        need.update(VIEW_DEPS.get(v, []))
    parts = [f"{v} as ({VIEW_SQL[v]})" for v in VIEW_ORDER if v in need]
    parts += [f"{n} as ({q})" for n, q in (extra_ctes or [])]
    return "with " + ",\n".join(parts) + "\n" + body
