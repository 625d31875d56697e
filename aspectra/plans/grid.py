"""Parameter grids and the runner of experiments."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Grid:
    """All combinations of parameter values, of one dict or several; names are in alphabetical order, the last one changes fastest."""

    def __init__(self, grid: dict[str, list] | list[dict[str, list]]) -> None:
        self.grids = [grid] if isinstance(grid, dict) else list(grid)

    def __iter__(self):
        for g in self.grids:
            names = sorted(g)
            for values in itertools.product(*(g[n] for n in names)):
                yield dict(zip(names, values, strict=True))

    def __len__(self) -> int:
        total = 0
        for g in self.grids:
            n = 1
            for v in g.values():
                n *= len(v)
            total += n
        return total

    def __getitem__(self, k: int) -> dict[str, Any]:
        """The k-th combination, by the digits of k in mixed radix."""
        if k < 0:
            raise IndexError(k)
        for g in self.grids:
            names = sorted(g)
            size = 1
            for n in names:
                size *= len(g[n])
            if k < size:
                out = {}
                for n in reversed(names):
                    k, digit = divmod(k, len(g[n]))
                    out[n] = g[n][digit]
                return {n: out[n] for n in names}
            k -= size
        raise IndexError("no such combination")

    def table(self, spark: SparkSession) -> DataFrame:
        """(config_id, key, value): a row for each parameter of each combination."""
        rows = [(i, k, str(v)) for i, c in enumerate(self) for k, v in c.items()]
        return spark.createDataFrame(rows, "config_id int, key string, value string")


def tasks(params: DataFrame, corpora: DataFrame) -> DataFrame:
    """Each combination with each corpus; both are lists that a person writes."""
    return params.crossJoin(F.broadcast(corpora))


def chunks(df: DataFrame, order: str, n: int) -> DataFrame:
    """df with `chunk`: rows in the order of an integer column that counts them from 0, n to a chunk."""
    return df.withColumn("chunk", F.floor(F.col(order) / n))


def _write(sink: str, text: str) -> None:
    """Writes a file, in place of the one before: of a url into the store that it names, else on this machine."""
    if "://" not in sink:
        with open(sink, "w") as f:
            f.write(text)
        return
    spark = SparkSession.active()
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def run(grid: Iterable[dict[str, Any]], corpora: list[str], model: Callable[[dict[str, Any], str], DataFrame], sink: str, every: int = 8) -> list[dict]:
    """Runs a model on each combination and corpus; its rows go to a JSON file, written again after `every` tasks.

    A task that fails leaves its error among the results, and the others go on. Results are a few rows of scores for each task.
    """
    out: list[dict] = []

    def save() -> None:
        names = sorted({k for r in out for k in r})
        _write(sink, json.dumps({"names": names, "data": [[r.get(n) for n in names] for r in out]}))

    for k, (params, corpus) in enumerate(itertools.product(grid, corpora), 1):
        try:
            out += [params | {"corpus": corpus} | r.asDict() for r in model(params, corpus).collect()]
        except Exception as e:  # noqa: BLE001
            out.append(params | {"corpus": corpus, "error": str(e)[:300]})
        if k % every == 0:
            save()
    save()
    return out
