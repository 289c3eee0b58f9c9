"""Reading, incremental staging and writing of tables."""
