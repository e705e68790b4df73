"""Canonical schemas and the source-header mappings that must match the ERP
exports (fixed values)."""

from pyspark.sql.types import (DateType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType, TimestampType)

# Export header -> canonical column (work-order history extract).
HISTORY_HEADERS = {
    "Sales Order": "sales_doc", "Sales Order Item": "item", "Order": "production_number",
    "Material Number": "material", "Material description": "material_description",
    "System Status": "system_status", "Order quantity (GMEIN)": "order_quantity",
    "Confirmed quantity (GMEIN)": "confirmed_quantity", "Basic start date": "planned_start_date",
    "Basic finish date": "planned_finish_date", "Actual finish date": "actual_finish_date",
    "Actual start time": "actual_start_date", "Unit of measure (=GMEIN)": "unit", "Created on": "created_date",
    "Entered by": "entered_by", "Prodn Supervisor": "production_supervisor", "MRP controller": "mrp_controller",
}

# Finished-goods master headers (note the misspelt earliest-start header of the export).
FG_HEADERS = {
    "Production Line": "production_line", "Material": "material", "Material Description": "fg_material_description",
    "Constraint": "constraint_factor", "earlist strart date": "earliest_start_days",
    "Total production Time": "total_production_time", "TPT Factor": "tpt_factor",
}

# Line capacity headers, weekday form and legacy single column.
CAPACITY_HEADERS = {
    "Production Line": "production_line", "Capacity Mo": "cap_mo", "Capacity Tu": "cap_tu",
    "Capacity We": "cap_we", "Capacity Th": "cap_th", "Capacity Fr": "cap_fr", "Capacity": "line_capacity",
}

# Shortage headers, ERP export dialect then template dialect.
SHORTAGE_HEADERS = {
    "Order": "production_number", "Material": "component_material", "Description": "component_description",
    "Reqmnt qty": "required_qty", "Available qty": "available_qty", "Shortage qty": "shortage_qty",
    "ReqmtsDate": "requirement_date",
    "Component Material": "component_material", "Component Description": "component_description",
    "Required Qty": "required_qty", "Available Qty": "available_qty", "Shortage Qty": "shortage_qty",
    "Requirement Date": "requirement_date",
}

HISTORY_DATES = ["planned_start_date", "planned_finish_date", "actual_finish_date", "actual_start_date", "created_date"]
HISTORY_NUMBERS = ["order_quantity", "confirmed_quantity"]

HISTORY = StructType([
    StructField("sales_doc", StringType()), StructField("item", StringType()),
    StructField("production_number", StringType()), StructField("material", StringType()),
    StructField("material_description", StringType()), StructField("system_status", StringType()),
    StructField("order_quantity", DoubleType()), StructField("confirmed_quantity", DoubleType()),
    StructField("planned_start_date", TimestampType()), StructField("planned_finish_date", TimestampType()),
    StructField("actual_finish_date", TimestampType()), StructField("actual_start_date", TimestampType()),
    StructField("unit", StringType()), StructField("created_date", TimestampType()),
    StructField("entered_by", StringType()), StructField("production_supervisor", StringType()),
    StructField("mrp_controller", StringType()),
])

FG = StructType([
    StructField("production_line", StringType()), StructField("material", StringType()),
    StructField("fg_material_description", StringType()), StructField("constraint_factor", DoubleType()),
    StructField("earliest_start_days", DoubleType()), StructField("total_production_time", DoubleType()),
    StructField("tpt_factor", DoubleType()),
])

CAPACITY = StructType([StructField("production_line", StringType())]
                      + [StructField(c, DoubleType()) for c in ("cap_mo", "cap_tu", "cap_we", "cap_th", "cap_fr")])

SHORTAGE = StructType([
    StructField("production_number", StringType()), StructField("component_material", StringType()),
    StructField("component_description", StringType()), StructField("required_qty", DoubleType()),
    StructField("available_qty", DoubleType()), StructField("shortage_qty", DoubleType()),
    StructField("requirement_date", DateType()),
])

PRODUCTION_ORDERS = StructType([
    StructField("order_id", LongType()), StructField("material_id", StringType()), StructField("plant", StringType()),
    StructField("order_type", StringType()), StructField("planned_start", TimestampType()),
    StructField("planned_finish", TimestampType()), StructField("actual_finish", TimestampType()),
    StructField("planned_qty", DoubleType()), StructField("status", StringType()), StructField("priority", IntegerType()),
])

RAW_ORDERS = StructType([StructField("id", StringType()), StructField("payload", StringType())])
