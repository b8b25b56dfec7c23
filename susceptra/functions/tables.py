"""Table functions for SQL: sequences from the lines of FASTA files, and the events of difference strings."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_TOKEN = re.compile(r":[0-9]+|=[A-Za-z]+|\*[a-z][a-z]|\+[a-z]+|-[a-z]+")


class FastaRecords:
    """`fasta_records(TABLE(lines) PARTITION BY file ORDER BY place)`: lines with columns file and line -> a row for each record.

    Lines come in order, so a record is held until the next header only. Text before the first header and records without
    a sequence give no row; white space goes, and a-z are raised.
    """

    def __init__(self) -> None:
        self.file, self.header, self.parts = None, None, []

    def _record(self):
        sequence = "".join(self.parts)
        if self.header is not None and sequence:
            yield self.file, self.header, sequence

    def eval(self, row):
        line = row["line"] or ""
        if line.startswith(">"):
            yield from self._record()
            self.file, self.header, self.parts = row["file"], line[1:].strip(), []
        else:
            self.parts.append(re.sub(r"\s+", "", line).translate(_RAISED))

    def terminate(self):
        yield from self._record()


_RAISED = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


class CsEvents:
    """`cs_events(cs)`: the events of a difference string with their places in target and query; an unknown token raises, null has none."""

    def eval(self, cs: str):
        at = target = query = number = 0
        while cs is not None and at < len(cs):
            token = _TOKEN.match(cs, at)
            if token is None:
                raise ValueError(f"an unsupported token at {at}")
            sign, body = token[0][0], token[0][1:]
            size = int(body) if sign == ":" else 1 if sign == "*" else len(body)
            yield number, sign, size, target, query
            number, at = number + 1, token.end()
            target += size if sign != "+" else 0
            query += size if sign != "-" else 0


def register(spark: SparkSession) -> None:
    """Makes both known to SQL by their names; rows travel pickled, as Arrow would make a frame of each call's few rows."""
    spark.udtf.register("fasta_records", udtf(FastaRecords, returnType="file string, header string, sequence string", useArrow=False))
    spark.udtf.register("cs_events", udtf(CsEvents, returnType="number int, sign string, size int, target int, query int", useArrow=False))
