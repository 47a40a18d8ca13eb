"""filelens subpackage."""
