"""Small result tables as text, manifests, and graph exports."""

from __future__ import annotations

import json
import shutil
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A report is a page, not a table scan: larger results belong in a sink.
MOST_ROWS = 10_000


def _rows(df: DataFrame) -> list[list[str]]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} rows")
    return [["" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v) for v in r] for r in rows]


def markdown_table(df: DataFrame) -> str:
    """A Markdown table of a small result."""
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, _rows(df))])


def latex_table(df: DataFrame) -> str:
    """A LaTeX tabular of a small result."""
    escape = lambda c: "".join({"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}.get(x, x) for x in c)
    body = [" & ".join(map(escape, r)) + r" \\" for r in [df.columns, *_rows(df)]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", body[0], r"\hline", *body[1:], r"\end{tabular}"])


def write_manifest(path: str, counts: dict[str, DataFrame], **facts) -> dict:
    """A JSON manifest with the row count of each table and further facts."""
    made = {"written_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "rows": {k: df.count() for k, df in counts.items()}, **facts}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(made, ensure_ascii=False, indent=2), encoding="utf-8")
    return made


def keep_backup(path: str) -> str | None:
    """Copies a file or folder beside itself before it is overwritten; None where there is nothing."""
    p = Path(path)
    if not p.exists():
        return None
    to = p.with_name(f"{p.name}.{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}.bak")
    (shutil.copytree if p.is_dir() else shutil.copy2)(p, to)
    return str(to)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by type and edges by relation as partitioned CSV."""
    flat = F.regexp_replace("label", "\r\n|\r|\n", "\\\\n")
    nodes.withColumn("label", flat).write.mode("overwrite").option("header", True).partitionBy("node_type").csv(f"{path}/nodes")
    edges.write.mode("overwrite").option("header", True).partitionBy("relation").csv(f"{path}/edges")


def graph_script(node_types: list[str], relations: list[str]) -> str:
    """A load script for property-graph importers."""
    nodes = [f"LOAD CSV WITH HEADERS FROM 'file:///nodes/node_type={t}' AS r MERGE (n:{t.title()} {{id: r.node_id}}) SET n.label = r.label;" for t in node_types]
    edges = [f"LOAD CSV WITH HEADERS FROM 'file:///edges/relation={t}' AS r MATCH (a {{id: r.source}}), (b {{id: r.target}}) MERGE (a)-[:{t.upper()}]->(b);" for t in relations]
    return "\n".join(nodes + edges)
