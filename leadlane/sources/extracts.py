"""ERP extract semantics as DataFrame filters and joins.

The reference generates query text with IN-lists of at most 500 keys; here
the key lists stay distributed and become semi joins, so filters and
projections reach the scan (JDBC or parquet pushdown) and no key list passes
through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import strip_leading_zeros_opensql


def fg_extract(master: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Project the finished-goods master to the extract's columns
    (``columns`` maps source column -> output name)."""
    return master.select(*[F.col(s).alias(t) for s, t in columns.items()])


def capacity_as_of(capacity: DataFrame, plant: str, as_of: str, plant_col: str = "plant",
                   valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Capacity rows of one plant valid on ``as_of`` (both bounds inclusive)."""
    d = F.to_date(F.lit(as_of))
    return capacity.filter((F.col(plant_col) == plant) & d.between(F.col(valid_from), F.col(valid_to)))


def history_extract(orders: DataFrame, texts: DataFrame, fg_materials: DataFrame, date_from: str, date_to: str,
                    material: str = "material", created: str = "created_date", lang_col: str = "language",
                    lang: str = "E") -> DataFrame:
    """Orders joined with their material text in one language, restricted to
    FG materials (left semi join) and a creation-date range."""
    t = texts.filter(F.col(lang_col) == lang).drop(lang_col)
    o = orders.filter(F.col(created).between(F.to_date(F.lit(date_from)), F.to_date(F.lit(date_to))))
    keys = fg_materials.select(material).filter(F.col(material).isNotNull()).distinct()
    return o.join(keys, material, "left_semi").join(t, material, "inner")


def shortage_extract(components: DataFrame, orders: DataFrame, plant: str, key: str = "production_number",
                     plant_col: str = "plant") -> DataFrame:
    """Component rows of extracted orders in one plant (semi join on the order)."""
    return components.filter(F.col(plant_col) == plant).join(orders.select(key).distinct(), key, "left_semi")


def order_extract(orders: DataFrame, start: str, end: str, top: int | None = None, skip: int = 0,
                  start_col: str = "actual_start_date", finish_col: str = "actual_finish_date",
                  key: str = "production_number") -> DataFrame:
    """Finished orders started in [start, end], newest first, optional paging
    (``top``/``skip`` applied on a total order, so pages are stable)."""
    df = orders.filter(F.col(finish_col).isNotNull()
                       & F.col(start_col).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    df = df.orderBy(F.desc(start_col), F.desc(key))
    if skip:
        df = df.offset(skip)
    return df.limit(top) if top else df


def order_history_view(header: DataFrame, order_data: DataFrame, sales_items: DataFrame, texts: DataFrame,
                       status: DataFrame, key: str = "production_number", closed_pattern: str = "%CLSD%",
                       excluded_type: str = "TEST") -> DataFrame:
    """Header left-joined with order data, sales item, text and status;
    finished, status like '%CLSD%', order type not TEST."""
    df = header.join(order_data, key, "left").join(sales_items, key, "left").join(texts, key, "left") \
        .join(status, key, "left")
    return df.filter(F.col("actual_finish_date").isNotNull() & F.col("system_status").like(closed_pattern)
                     & (F.coalesce(F.col("order_type"), F.lit("")) != excluded_type))


def material_view(materials: DataFrame, texts: DataFrame, prefix: str = "CDX", key: str = "material") -> DataFrame:
    """Materials not flagged for deletion whose number starts with a prefix."""
    m = materials.filter(~F.coalesce(F.col("deletion_flag"), F.lit(False)) & F.col(key).startswith(prefix))
    return m.join(texts, key, "left")


def capacity_view(work_centres: DataFrame, capacity: DataFrame, plant: str, line_prefix: str,
                  key: str = "capacity_id") -> DataFrame:
    """Work centres left-joined with capacity, one plant and line prefix."""
    wc = work_centres.filter((F.col("plant") == plant) & F.col("work_centre").startswith(line_prefix))
    return wc.join(capacity, key, "left")


def distinct_keys(df: DataFrame, col: str, strip_zeros: bool = False) -> DataFrame:
    """Distinct non-blank keys (kept distributed; feeds a semi join)."""
    k = F.trim(F.col(col).cast("string"))
    k = strip_leading_zeros_opensql(k) if strip_zeros else k
    return df.select(k.alias(col)).filter(F.col(col).isNotNull() & (F.col(col) != "")).distinct()


# --- C9 / C10 / C11 / C12: extract normalisation --------------------------------------------

def _odata_qty(c: str):
    return F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))


def transform_odata_orders(records: DataFrame, fields: dict[str, str], qty_fields: list[str],
                           date_fields: list[str], key: str = "production_number") -> DataFrame:
    """OData order records -> history rows. ``fields`` maps record field ->
    column; quantities default to 0; ``/Date(ms)/`` dates are converted; records
    without a key are rejected (use ``rejected_odata_orders`` for the side output)."""
    from ..functions.clean import odata_date, strip_leading_zeros_odata
    exprs = []
    for src, dst in fields.items():
        if dst in qty_fields:
            exprs.append(_odata_qty(src).alias(dst))
        elif dst in date_fields:
            exprs.append(F.to_date(odata_date(src)).alias(dst))
        elif dst == key:
            exprs.append(strip_leading_zeros_odata(src).alias(dst))
        else:
            exprs.append(F.col(src).cast("string").alias(dst))
    return records.select(*exprs).filter(F.col(key).isNotNull() & (F.col(key) != ""))


def rejected_odata_orders(records: DataFrame, key_field: str) -> DataFrame:
    """C9 side output: records that cannot become an order row."""
    return records.filter(F.col(key_field).isNull() | (F.col(key_field).cast("string") == ""))


def transform_master_rows(records: DataFrame, fields: dict[str, str], numeric: list[str]) -> DataFrame:
    """Material master, line capacity or FG extract rows -> typed columns;
    keys lose leading zeros, numbers parse ANSI-safely (bad -> null)."""
    from ..functions.clean import strip_leading_zeros_opensql
    exprs = []
    for src, dst in fields.items():
        if dst in numeric:
            exprs.append(F.trim(F.col(src).cast("string")).try_cast("double").alias(dst))
        elif dst in ("material", "production_number"):
            exprs.append(strip_leading_zeros_opensql(src).alias(dst))
        else:
            exprs.append(F.trim(F.col(src).cast("string")).alias(dst))
    return records.select(*exprs)


def transform_shortage_extract(components: DataFrame, required: str = "required_qty",
                               withdrawn: str = "withdrawn_qty") -> DataFrame:
    """shortage = required - withdrawn (may be negative: an over-issue, which
    the order roll-up later turns into a shortage through the absolute value)."""
    req = F.coalesce(F.col(required).cast("string").try_cast("double"), F.lit(0.0))
    wd = F.coalesce(F.col(withdrawn).cast("string").try_cast("double"), F.lit(0.0))
    return components.withColumns({required: req, "shortage_qty": req - wd})
