"""Writers. Tables go out in one overwrite with fixed columns; paths must stay below their base."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame


def check_path(path: str | Path, base: str | Path | None = None) -> Path:
    """``path`` below ``base``, or a relative path without parent steps."""
    path = Path(path)
    if base is None:
        if ".." in path.parts:
            raise ValueError(f"path leaves its folder: {path}")
        return path
    base = Path(base).resolve()
    full = (path if path.is_absolute() else base / path).resolve()
    if base != full and base not in full.parents:
        raise ValueError(f"path leaves {base}: {path}")
    return full


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if kind == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(kind).save(path)


def latex_table(rows: list[dict], columns: list[str], digits: int = 2) -> str:
    """A LaTeX tabular of a few collected rows."""
    text = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    head = [r"\begin{tabular}{" + "l" + "r" * (len(columns) - 1) + "}", r"\hline", " & ".join(columns) + r" \\", r"\hline"]
    body = [" & ".join(text(r[c]) for c in columns) + r" \\" for r in rows]
    return "\n".join([*head, *body, r"\hline", r"\end{tabular}"])
