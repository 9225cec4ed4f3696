"""From a landed API response to a brief per app: rows, CSV, seeded sample, one line per sampled review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus import lexicons as LX
from chorus.operators.select import bullets, seeded_sample
from chorus.sinks.export import csv_cells
from chorus.sources.landed import first_then_nonempty, flatten_api_responses, read_csv


def review_rows(responses: DataFrame, csv_path: str | None = None) -> DataFrame:
    """The first row of each review id and platform, if it has a text.  With ``csv_path`` the rows are written there, a folder
    per app, and read back as a later run would read them."""
    rows = first_then_nonempty(flatten_api_responses(responses))
    if csv_path is None:
        return rows
    cells = csv_cells(rows, rows.columns)
    (cells.write.mode("overwrite").partitionBy("app_name").option("header", True).option("escape", '"').csv(csv_path))
    back = read_csv(responses.sparkSession, csv_path)
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema.fields])


def app_briefs(responses: DataFrame, csv_path: str | None = None, sample: int = LX.SAMPLE_SIZE, seed: str = "42") -> DataFrame:
    """(app_name, count, bullets, text_key) per app, of at most ``sample`` reviews chosen by a hash of their id."""
    rows = review_rows(responses, csv_path)
    chosen = seeded_sample(rows, "app_name", "review_id", sample, seed=seed)
    return bullets(chosen.select("app_name", "pos", "review_id", "rating", "review_text"), "app_name", "review_text")
