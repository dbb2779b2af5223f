"""The library's operators as queries over the shared test tables, with SQL oracles."""
