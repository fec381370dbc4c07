"""What an evaluation leaves in a directory: relations, sizes, counters, witnesses."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_relation(df: DataFrame, path: str, delimiter: str = ",") -> int:
    """One file that is a valid input file again; rows are streamed, a partition at a time.  Returns their number."""
    n = 0
    line = F.concat_ws(delimiter, *[F.col(f"`{c}`").cast("string") for c in df.columns]) if df.columns != ["__unit"] else F.lit("")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        for row in df.select(line.alias("line")).toLocalIterator(prefetchPartitions=True):
            f.write(row[0] + "\n")
            n += 1
    return n


def write_relation_parts(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """The same lines as a folder of part files, written by the executors: for relations too large for one file."""
    df.select(F.concat_ws(delimiter, *[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("line")).write.mode("overwrite").text(path)


def write_result(result, directory: str, delimiter: str = ",") -> None:
    """csvs/<Relation>.csv, csvs/size.txt, csvs/stats.json and, if rows were explained, csvs/explain.jsonl."""
    folder = os.path.join(directory, "csvs")
    os.makedirs(folder, exist_ok=True)
    sizes = []
    for decl in result.program.outputs():
        if decl.name in result.relations:
            n = write_relation(result.relations[decl.name], os.path.join(folder, f"{decl.name}.csv"), delimiter)
            if n:
                sizes.append(f"{decl.name}: ((), (), {n})\n")
    with open(os.path.join(folder, "size.txt"), "w") as f:
        f.writelines(sizes)
    with open(os.path.join(folder, "stats.json"), "w") as f:
        json.dump(result.stats, f, indent=2)
    if result.witnesses:
        with open(os.path.join(folder, "explain.jsonl"), "w") as f:
            f.writelines(json.dumps(w) + "\n" for w in result.witnesses)
