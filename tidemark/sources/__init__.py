from .files import read_orders_csv, read_tables, replace_parts, write_csv, write_table
from .tables import SCHEMAS, Sources
from .testdata import SCOPE as TESTDATA_SCOPE
from .testdata import load_testdata

__all__ = [
    "read_orders_csv", "read_tables", "replace_parts", "write_csv", "write_table", "SCHEMAS",
    "Sources", "TESTDATA_SCOPE", "load_testdata",
]
