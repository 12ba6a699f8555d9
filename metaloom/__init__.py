"""ETL-metadata, lineage and corpus analytics as Spark DataFrame jobs."""
