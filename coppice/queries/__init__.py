"""One query for each operator, over the star-schema tables, and its SQL for DuckDB."""

from . import binning, fits, losses, models, splits

QUERIES = binning.QUERIES | losses.QUERIES | splits.QUERIES | models.QUERIES | fits.QUERIES
ORACLE = binning.ORACLE | losses.ORACLE | splits.ORACLE | models.ORACLE | fits.ORACLE
