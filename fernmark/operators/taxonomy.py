"""Species tables: synthetic rows, unique short names, groups, and lookup of names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernmark.operators.lookup import key_table
from fernmark.scratch import kept, small

#: Rows for what is no species: unknown, several, none. Fixed values.
SYNTHETIC = ("_UNK", "_MUL", "_NON")


def with_synthetic(species: DataFrame) -> DataFrame:
    """The table with a row for each synthetic species; columns without a value are null."""
    rows = species.sparkSession.createDataFrame([(s, s, s, s) for s in SYNTHETIC], "species_code string, sci_name string, com_name string, banding_code string")
    return species.unionByName(rows, allowMissingColumns=True)


def shorthands(species: DataFrame, order: str = "taxon_order") -> DataFrame:
    """Adds ``shorthand``: the first of banding code, common name, species code that no earlier row took.

    Each choice depends on all before, so the table, which is a dimension of some
    ten thousand rows, is one group.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([order, "species_code"])
        taken: set[str] = set()
        chosen = []
        for candidates in rows[["banding_code", "com_name", "species_code"]].itertuples(index=False):
            name = next((c for c in candidates if c is not None and c == c and c not in taken), None)
            taken.add(name)
            chosen.append(name)
        return pd.DataFrame({"species_code": rows["species_code"], "shorthand": chosen})

    small = species.select("species_code", "com_name", "banding_code", order).withColumn("_all", F.lit(0))
    names = small.groupBy("_all").applyInPandas(choose, "species_code string, shorthand string")
    return species.join(names, "species_code")


def lookup(queries: DataFrame, species: DataFrame, query_col: str = "query", order: str = "taxon_order") -> DataFrame:
    """Adds ``species_code`` to queries by any of the names; several names at once are ``_MUL``, unknown ones null."""
    keys = key_table(species, ["banding_code", "species_code", "com_name", "sci_name"], "species_code", order)
    normal = F.replace(F.lower(F.trim(query_col)), F.lit("'"), F.lit(""))
    found = queries.withColumn("_key", normal).join(small(kept(keys.withColumnRenamed("key", "_key"), "names")), "_key", "left")
    several: Column = F.contains(F.col(query_col), F.lit(","))
    return found.withColumn("species_code", F.when(several, F.lit("_MUL")).otherwise(F.col("id"))).drop("_key", "id")


def with_ordinal(rows: DataFrame, species: DataFrame, key: str, order: list[Column], name: str = "taxon_ord") -> DataFrame:
    """Adds the place of each row's species in taxonomic order, from 0; rows of no known species have none. The table of
    species is a dimension of some ten thousand rows, so its order is one window."""
    at = species.select(key, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).alias(name))
    return rows.join(small(kept(at, "order")), key, "left")
