"""CSV and JSON outputs of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaksift.operators import clusters as C
from weaksift.operators import summaries as U


def flat(rows: DataFrame, separator: str = "; ") -> DataFrame:
    """Arrays as joined text and maps as JSON, for formats without nesting."""
    columns = []
    for field in rows.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), separator)
        elif isinstance(field.dataType, (T.MapType, T.StructType)):
            column = F.to_json(column)
        columns.append(column.alias(field.name))
    return rows.select(*columns)


def write_csv(rows: DataFrame, path: str, separator: str = "; ") -> None:
    """A folder of CSV parts, each with the header; quotes are doubled and line breaks kept."""
    flat(rows, separator).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_csv(run: dict[str, DataFrame], root: str, run_id: str) -> dict[str, str]:
    """The five CSV outputs of a run."""
    outputs = {
        "evidence_items": run["evidence_rows"].drop("item_no", "category_ord"),
        "normalized_items": run["prepared_items"].select(
            [c for c in run["prepared_items"].columns if not c.startswith("found_")]
        ),
        "section_summary": U.section_summary(run["category_summaries"]),
        "excluded_items": run["excluded_items"],
        "evidence_clusters": C.cluster_table(run["clusters"]),
    }
    paths = {}
    for name, rows in outputs.items():
        paths[name] = f"{root}/{run_id}_{name}"
        write_csv(rows, paths[name])
    return paths


def export_json(run: dict[str, DataFrame], root: str, run_id: str) -> dict[str, str]:
    """Every stage of a run as JSON lines."""
    paths = {}
    for name, rows in run.items():
        paths[name] = f"{root}/{run_id}_{name}"
        write_json(rows, paths[name])
    return paths


def export_review(review: DataFrame, root: str, run_id: str) -> dict[str, str]:
    """The review sheet and its label template."""
    paths = {"csv": f"{root}/{run_id}_cluster_review", "labels": f"{root}/{run_id}_cluster_review_labels"}
    write_csv(review, paths["csv"])
    write_json(C.label_template(review), paths["labels"])
    return paths
