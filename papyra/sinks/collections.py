"""Vector collections as catalog tables (I1-I4): fixed dimension and metric as table properties."""

from __future__ import annotations

from pyspark.sql import SparkSession

POINT_DDL = "id STRING, vector ARRAY<FLOAT>, payload STRUCT<text_id: STRING, text: STRING, document_name: STRING>"


def create_collection(spark: SparkSession, name: str, location: str, dim: int, metric: str = "cosine",
                      shards: int = 4) -> None:
    """An external Parquet table; dimension/metric recorded for the C10 check, bucketed by id."""
    spark.sql(f"CREATE TABLE {name} ({POINT_DDL}) USING parquet CLUSTERED BY (id) INTO {shards} BUCKETS "
              f"LOCATION '{location}' TBLPROPERTIES ('dim' = '{dim}', 'metric' = '{metric}')")


def delete_collection(spark: SparkSession, name: str) -> None:
    """I2."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def collection_exists(spark: SparkSession, name: str) -> bool:
    """I3."""
    return spark.catalog.tableExists(name)


def list_collections(spark: SparkSession) -> list[str]:
    """I4: names of the tables carrying a vector dimension property."""
    out = []
    for t in spark.catalog.listTables():
        props = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {t.name}").collect()}
        if "dim" in props:
            out.append(t.name)
    return out


def collection_dim(spark: SparkSession, name: str) -> int:
    props = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return int(props["dim"])
