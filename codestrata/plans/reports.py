"""Short reports of bounded tables, as Markdown and as a diagram of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame

MOST_ROWS = 200  # a report is read by people; the tables behind it are never cut


def markdown(df: DataFrame, title: str, rows: int = 20) -> str:
    """The first rows of an ordered table."""
    found = df.limit(min(rows, MOST_ROWS)).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in found]) + "\n"


def diagram(edges: DataFrame, rows: int = 40) -> str:
    """edges(src, dst, weight) in Mermaid, the heaviest ones."""
    found = edges.orderBy(edges["weight"].desc(), "src", "dst").limit(min(rows, MOST_ROWS)).collect()
    names = {n: f"n{k}" for k, n in enumerate(dict.fromkeys(x for r in found for x in (r["src"], r["dst"])))}
    out = ["graph LR", *(f'  {k}["{str(n).replace(chr(34), chr(39))}"]' for n, k in names.items())]
    return "\n".join(out + [f"  {names[r['src']]} -->|{r['weight']}| {names[r['dst']]}" for r in found]) + "\n"
