"""The library's operators run on the given star-schema tables, with a SQL oracle for each."""
