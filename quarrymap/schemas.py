"""Table schemas (DDL) and closed vocabularies. Every table is keyed by `analysis_id` first."""

from __future__ import annotations

IMPORT = "struct<module:string,names:array<string>,level:int,line_number:int,is_from:boolean,raw:string>"
SYMBOL = "struct<name:string,kind:string,line_start:int,line_end:int,decorators:array<string>,docstring:string>"

RAW_FILES = "analysis_id string, path string, size_bytes bigint, kind string, content string"
PARSED = (
    "analysis_id string, path string, parse_status string, parse_warning string, docstring string, line_count int, "
    "estimated_complexity int, has_main_block boolean, framework_hints array<string>, module_level_start int, module_level_end int, "
    f"imports array<{IMPORT}>, symbols array<{SYMBOL}>, lines array<string>"
)

# Categories and their importance bonus.
CATEGORY_BONUS = {
    "Entry Point": 20.0,
    "API / Routes": 12.0,
    "Services": 10.0,
    "Models / Data": 8.0,
    "Core / Domain": 10.0,
    "Configuration": 6.0,
    "CLI": 8.0,
    "Scripts": 4.0,
    "Tests": 2.0,
    "Utilities": 4.0,
    "Migrations": 3.0,
    "Other": 0.0,
}
