from .fixtures import fixture_tables  # noqa: F401
from .raw import RawTables, read_csv_tables, read_parquet_tables, rejected_lines, write_raw  # noqa: F401
from .tables import read_table, write_table  # noqa: F401
