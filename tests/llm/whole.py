import duckdb
from conftest import SMALL


def table(name, *columns):
    """A whole table of the smallest input as a list of tuples."""
    return duckdb.sql(f"select {', '.join(columns)} from '{SMALL}/{name}.parquet'").fetchall()
