"""Row types."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _of(fields: str) -> T.StructType:
    """Without a running session, as fromDDL needs one."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


#: A block as version files hold it.
BLOCK = _of("type string, text string, img_path string, table_body string, page_idx int, parent string, source_file string, order int, text_level int")
KINDS = ("image", "table", "text")
#: A block of one version of one document; pos is its place among the version's blocks of its kind.
ARTIFACT = _of("document string, version int, id string, kind string, pos int, text string, img_path string, table_body string, page_idx int, parent string, source_file string, ord int")
#: A link between a block of version k (sid) and one of version k + 1 (rid).
EDGE = _of("document string, kind string, k int, sid string, rid string, score double, is_near boolean")
CELL_CHANGE = "struct<col_index:int,col_header:string,old:string,new:string>"
CHANGE = f"struct<pair_key:string,change_type:string,description:string,change_description:string,formatting_only:boolean,confidence:double,row_changes:array<struct<row_key:string,change_type:string,change_description:string,cell_changes:array<{CELL_CHANGE}>>>,added_rows:array<struct<row_key:string,row_values:array<string>>>,deleted_rows:array<struct<row_key:string,row_values:array<string>>>>"
LABELS = ("Major Change", "Minor Change", "No Change", "New", "Deleted", "Skipped", "Unidentified")
EVENT = _of("task_id string, kind string, type string, completed_ratio int, message string, ts timestamp")
