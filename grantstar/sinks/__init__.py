"""Writers: tables, result files and reports."""
