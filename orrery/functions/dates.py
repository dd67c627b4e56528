"""Dates by a vote of the whole column, in two steps: fit, then transform."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidate formats in order; the serial number of spreadsheets comes last.
FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyy-M-d HH:mm:ss", "yyyyMMdd", "yyyy")
SERIAL = "serial"
SERIAL_EPOCH = "1899-12-30"
SERIAL_ABOVE = 30000


def _parsed(c: Column, fmt: str) -> Column:
    if fmt == SERIAL:
        days = F.try_to_number(c, F.lit("9999999"))
        return F.date_add(F.lit(SERIAL_EPOCH).cast("date"), days.cast("int")).cast("timestamp_ntz")
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


@dataclass(frozen=True)
class DateParser:
    """The format that a column's values agree on, and the share that it parses."""

    format: str
    ratio: float

    @classmethod
    def fit(cls, df: DataFrame, col: str) -> "DateParser":
        return cls.fit_all(df, [col])[col]

    @classmethod
    def fit_all(cls, df: DataFrame, cols: list[str]) -> dict[str, "DateParser"]:
        """One aggregate over all the columns; nulls count against every format.

        The first format that parses over half the values wins. Without one,
        numbers of a mean above 30000 are serial days; failing that, years
        are read though few parse.
        """
        asked = []
        for k, col in enumerate(cols):
            c = F.col(col).cast("string")
            number = F.try_to_number(c, F.lit("9999999"))
            shares = [F.avg(_parsed(c, f).isNotNull().cast("int")).alias(f"f{i}") for i, f in enumerate(FORMATS)]
            asked += [x.alias(f"c{k}_{name}") for x, name in zip([*shares, F.avg(number), F.avg(number.isNotNull().cast("int"))], [*(f"f{i}" for i in range(len(FORMATS))), "mean", "numbers"])]
        got = df.agg(*asked).first().asDict()
        return {col: cls._chosen({k.removeprefix(f"c{i}_"): v for k, v in got.items() if k.startswith(f"c{i}_")}) for i, col in enumerate(cols)}

    @classmethod
    def _chosen(cls, got: dict) -> "DateParser":
        for i, f in enumerate(FORMATS):
            if (got[f"f{i}"] or 0) > 0.5:
                return cls(f, got[f"f{i}"])
        if got["mean"] is not None and got["mean"] > SERIAL_ABOVE:
            return cls(SERIAL, got["numbers"])
        return cls("yyyy", got[f"f{FORMATS.index('yyyy')}"] or 0.0)

    def transform(self, c: Column) -> Column:
        return _parsed(c.cast("string"), self.format)
