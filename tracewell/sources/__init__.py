"""Tables, derived inputs and shared storage."""
from .tables import columns_of, run_sql, table, use_all_cores
from .fixtures import fixture, with_fixtures

__all__ = ["columns_of", "fixture", "run_sql", "table", "use_all_cores", "with_fixtures"]
