"""Files that reader and writer checks derive from the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import Inputs
from tidewake.operators.provenance import arrow_place
from tidewake.session import stage_folder


def folder(t: Inputs, name: str) -> str:
    """A fresh folder beside the stages of the session."""
    return f"{stage_folder(t.spark)}/checks-{name}-{uuid.uuid4().hex}"


def written(t: Inputs, name: str, df: DataFrame, fmt: str, **options) -> str:
    path = folder(t, name) + "/data"
    writer = df.write.options(**options)
    if fmt in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    elif fmt == "text":
        writer.text(path)
    else:
        writer.format(fmt).save(path)
    return path


def written_each(t: Inputs, name: str, lines: DataFrame, order: str, head: str = "", sep: str = "\n", tail: str = "\n") -> str:
    """One file per ``file`` (a path below the folder): ``head``, its ``value`` in ``order`` joined by ``sep``, ``tail``.

    Tasks write their files line by line, so no file is a row and no commit lists or moves files one after another."""
    path = folder(t, name) + "/data"

    def run(batches):
        system, inner, _ = arrow_place(path)
        current, stream, made = None, None, set()
        for batch in batches:
            for file, value in zip(batch["file"], batch["value"]):
                if file != current:
                    if stream is not None:
                        stream.write(tail.encode())
                        stream.close()
                    place = f"{inner}/{file}"
                    parent = place.rsplit("/", 1)[0]
                    if parent not in made:
                        system.create_dir(parent, recursive=True)
                        made.add(parent)
                    current, stream = file, system.open_output_stream(place)
                    stream.write((head + value).encode())
                else:
                    stream.write((sep + value).encode())
            yield batch[["file"]]
        if stream is not None:
            stream.write(tail.encode())
            stream.close()

    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    placed = lines.select("file", "value", F.col(order).alias("__order")).repartition(parts, "file").sortWithinPartitions("file", "__order")
    placed.select("file", "value").mapInPandas(run, "file string").write.format("noop").mode("overwrite").save()
    return path
