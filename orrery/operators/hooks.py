"""Places for a user's own encoder or tokenizer: functions over batches of texts, run where the rows are."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _applied(df: DataFrame, text: str, out: str, kind: str, arrow: pa.DataType, f: Callable, batch: int) -> DataFrame:
    place = df.columns.index(text)
    schema = f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, `{out}` {kind}"

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                c = b.slice(at, batch)
                made = f([x or "" for x in c.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array([list(x) for x in made], arrow)], [*c.schema.names, out])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str, f: Callable[[list[str]], list], out: str = "embedding", batch: int = 128) -> DataFrame:
    """``df`` with a vector for each text; f takes up to ``batch`` texts (null: empty) and gives as many vectors."""
    return _applied(df.withColumn(text, F.col(text).cast("string")), text, out, "array<float>", pa.list_(pa.float32()), f, batch)


def tag(df: DataFrame, text: str, f: Callable[[list[str]], list], out: str = "tokens", batch: int = 128) -> DataFrame:
    """``df`` with each text's tokens as structs (base, pos), for noun_compounds; f gives lists of such pairs."""
    kind = pa.list_(pa.struct([("base", pa.string()), ("pos", pa.string())]))
    pairs = lambda texts: [[{"base": b, "pos": p} for b, p in toks] for toks in f(texts)]
    return _applied(df.withColumn(text, F.col(text).cast("string")), text, out, "array<struct<base:string,pos:string>>", kind, pairs, batch)
