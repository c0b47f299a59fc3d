"""Source files that do not parse: per file all errors and the first cause, and rates per repository and language.

Every text is lexed and parsed where it is read (one Arrow pass, no shuffle); only the small verdicts move.

Files of unknown extensions and null texts have no verdict (``valid`` is null).  Empty texts and texts of
comments only are valid.  A null path has no verdict.  Repeated rows give repeated verdicts; other columns of
the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.islands import language
from lodegraph.llm.syntax import LANGUAGES, PARSERS, errors

VERDICT = "path string, language string, valid boolean, n_errors int, first_line int, first_cause string, errors array<struct<line:int,message:string>>"


def verdicts(texts: DataFrame) -> DataFrame:
    """One row per row of (path, text): language, valid, n_errors, first_line, first_cause, errors."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"]):
                ext = language(path)
                if text is None or ext not in PARSERS:
                    rows.append((path, LANGUAGES.get(ext), None, None, None, None, None))
                    continue
                found = errors(ext, text)
                first = found[0] if found else (None, None)
                rows.append((path, LANGUAGES[ext], not found, len(found), *first, found))
            out = pd.DataFrame(rows, columns=["path", "language", "valid", "n_errors", "first_line", "first_cause", "errors"], dtype=object)
            yield out

    return texts.select("path", "text").mapInPandas(parse, VERDICT)


def rates(found: DataFrame) -> DataFrame:
    """(repository, language, n_files, n_invalid, invalid_rate) over the files with a verdict."""
    counted = found.filter("valid is not null").groupBy(F.substring_index("path", "/", 1).alias("repository"), "language")
    out = counted.agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.when(F.col("valid"), 0).otherwise(1)).alias("n_invalid"))
    return out.withColumn("invalid_rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
