"""Folds over ordered rows, for rules in which a row's answer depends on earlier answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable, added: T.StructType) -> DataFrame:
    """df with the columns `added`, made by going through each key's rows in order.

    step(state, row) returns (state, values of the added columns). Rows are
    dealt by key and sorted inside each task, which reads them as a stream and
    holds one key's state at a time: a key may have more rows than fit in
    memory. `order` has to be total within a key.
    """
    names = list(df.columns)
    return column_fold(df, keys, order, names, start, lambda state, *values: step(state, dict(zip(names, values))), added)


def column_fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], object], step: Callable, added: T.StructType) -> DataFrame:
    """ordered_fold for rules that need a few columns: step(state, *inputs). The other columns stay Arrow data.

    Rows are dealt by a hash of the keys: a deal by the keys themselves is left
    out by Spark where df comes dealt so from a join, whose partitions it may
    still split or read by mapper, and a key would no longer be whole.
    """
    names = added.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            column = {n: batch.column(batch.schema.get_field_index(n)) for n in {*keys, *inputs}}
            found = zip(*(column[n].to_pylist() for n in keys)), zip(*(column[n].to_pylist() for n in inputs))
            made = []
            for now, values in zip(*found):
                if now != key:
                    key, state = now, start()
                state, value = step(state, *values)
                made.append(value)
            new = [pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    dealt = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, T.StructType(df.schema.fields + added.fields))
