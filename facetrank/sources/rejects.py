"""Loading of text lines with a separate account of those that can't be read.

What a line should hold is said by its fields (`Field`). The lines of an Arrow batch are checked in three steps, each by
whole columns: the quote rule; the number of fields, from the invalid-row callback of pyarrow's CSV reader, which reads
every field as a string; the casts of the fields, whose failing cells are labelled.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.functions.runtime import ship, spread

#: Lines are parsed in blocks of about this many bytes, whatever the size of the Arrow batch.
BLOCK = 16 << 20


def quote_rule(separator: str) -> str:
    """A field holds no quote at all, or is wholly enclosed in quotes with every inner quote doubled."""
    sep = re.escape(separator)
    field = rf'(?:[^"{sep}]*|"(?:[^"]|"")*")'
    return rf"(?s)\A{field}(?:{sep}{field})*\z"


def _matches(column: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(column, pattern), False).to_numpy(zero_copy_only=False)


def _existing_times(column: pa.Array) -> np.ndarray:
    """Whether each text is an existing date and time as yyyyMMddHHmmss."""
    good = _matches(column, r"\A[0-9]{14}\z")
    digits = pc.if_else(pa.array(good), column, pa.scalar("00010101000000"))
    part = lambda a, b: pc.cast(pc.utf8_slice_codeunits(digits, a, b), pa.int32()).to_numpy(zero_copy_only=False)
    year, month, day, hour, minute, second = (part(*x) for x in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14)))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.where((month >= 1) & (month <= 12), month, 0)]
    days = days + ((month == 2) & leap)
    return good & (year >= 1) & (day >= 1) & (day <= days) & (hour < 24) & (minute < 60) & (second < 60)


#: How numbers are written, and what makes a list of tokens not empty.
NUMBER = r"\A(?:[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)?\z"
SOME_TOKEN = r"[^;\s\x0b\x1c-\x1f\x85\pZ]"


@dataclass(frozen=True)
class Field:
    """A field of a line. kind: text, time (yyyyMMddHHmmss, kept as text), number (DOUBLE; empty is null) or tokens (a
    list split at `;`, with at least one that isn't blank). A text must match `pattern`, if there is one."""

    name: str
    kind: str = "text"
    pattern: str | None = None

    @property
    def spark_type(self) -> str:
        return "double" if self.kind == "number" else "string"

    def cast(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The column as the field's type, and which of its cells could be cast."""
        if self.kind == "time":
            return column, _existing_times(column)
        if self.kind == "number":
            return _numbers(column)
        pattern = SOME_TOKEN if self.kind == "tokens" else self.pattern
        return column, np.ones(len(column), dtype=bool) if pattern is None else _matches(column, pattern)


def _numbers(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What isn't written as a number fails, also where a cast would take it (`NaN`, `inf`, `1.`)."""
    good = _matches(column, NUMBER)
    texts = pc.if_else(pa.array(good) if len(good) else pa.array([], pa.bool_()), pc.replace_substring_regex(column, r"\A\+|\A\z", ""), pa.scalar(None, pa.string()))
    texts = pc.if_else(pc.equal(texts, ""), pa.scalar(None, pa.string()), texts)
    try:
        return pc.cast(texts, pa.float64()), good
    except pa.ArrowInvalid:
        # Some cell goes beyond what the reader takes; they are read one by one.
        return pa.array([None if t is None else float(t) for t in texts.to_pylist()], pa.float64()), good


#: A line of a keyword-set file.
KEYWORD_SET = (Field("id", pattern=r"\Anw[0-9]{10}\z"), Field("article_ts", "time"), Field("tokens", "tokens"), Field("positive_sentiment", "number"))


def parse(lines: pa.Array, expected: Sequence[Field] = KEYWORD_SET, separator: str = ",") -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """(reason, detail, fields) of each line; reason is None for a correct line, fields hold nulls where it isn't one."""
    n, called = len(lines), [f.name for f in expected]
    reason = np.full(n, None, dtype=object)
    detail = np.full(n, None, dtype=object)
    present = pc.is_valid(lines).to_numpy(zero_copy_only=False)
    reason[~present], detail[~present] = "columns", "0 fields"
    well_quoted = present & _matches(lines, quote_rule(separator))
    reason[present & ~well_quoted] = "quoting"

    rows = np.flatnonzero(well_quoted)
    kept: list[pa.Table] = []
    if len(rows):
        some = lines.take(pa.array(rows))
        # Line ends inside a line would start a new row of the CSV; they stand aside as code points that don't occur.
        text = pc.binary_join(pa.array([some.to_pylist()]), "").to_pylist()[0] if _matches(some, r"[\r\n]").any() else ""
        stand_ins = dict(zip("\r\n", (c for c in map(chr, range(0xE000, 0xF8FF)) if c not in text)))
        if text:
            for mark, other in stand_ins.items():
                some = pc.replace_substring(some, mark, other)
        numbered = pc.binary_join_element_wise(pc.cast(pa.array(rows), pa.string()), some, separator)
        sizes = np.cumsum(pc.binary_length(numbered).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(sizes // BLOCK)) + 1).tolist(), len(rows)]

        def reject(row: pacsv.InvalidRow) -> str:
            i = int(row.text.partition(separator)[0])
            reason[i], detail[i] = "columns", f"{row.actual_columns - 1} fields"
            return "skip"

        names = ["row", *called]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            data = ("\n".join(numbered.slice(a, b - a).to_pylist()) + "\n").encode()
            kept.append(
                pacsv.read_csv(
                    io.BytesIO(data),
                    pacsv.ReadOptions(column_names=names, use_threads=False, block_size=len(data) + 1),
                    pacsv.ParseOptions(delimiter=separator, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=reject),
                    pacsv.ConvertOptions(
                        column_types={"row": pa.int64()} | dict.fromkeys(called, pa.string()),
                        strings_can_be_null=False,
                    ),
                )
            )
    fields = [pa.nulls(n, pa.float64() if f.kind == "number" else pa.string()) for f in expected]
    if kept:
        table = pa.concat_tables(kept).combine_chunks()
        at = table["row"].to_numpy()
        columns = {f: table[f].combine_chunks() if table[f].num_chunks != 1 else table[f].chunk(0) for f in called}
        if text:
            for f in called:
                for mark, other in stand_ins.items():
                    columns[f] = pc.replace_substring(columns[f], other, mark)
        good = np.ones(len(at), dtype=bool)
        labels = np.full(len(at), "", dtype=object)
        for f in expected:
            columns[f.name], right = f.cast(columns[f.name])
            good &= right
            labels[~right] += f" {f.name}"
        reason[at[~good]] = "value"
        detail[at[~good]] = [x.strip() for x in labels[~good]]
        place = np.full(n, -1, dtype=np.int64)
        place[at[good]] = np.flatnonzero(good)
        taken = pa.array(place, mask=place < 0)
        fields = [columns[f].take(taken) for f in called]
    return reason, detail, fields


def read_lines(lines: DataFrame, key: str = "line_id", text: str = "raw_line", fields: Sequence[Field] = KEYWORD_SET, separator: str = ",") -> DataFrame:
    """Each line with its reading: (line_id, reason, detail, and the fields by name).

    reason is null for a correct line, whose fields then follow (tokens as ARRAY<STRING>, trimmed and without blank or
    repeated ones; numbers null where the field is empty). Otherwise it is `quoting` if a field breaks the quote rule,
    else `columns` if there are not exactly as many fields (a null line has none, an empty line one), else `value`;
    detail then says how many fields or which ones. Every line comes out once, also for repeated or null keys; an
    empty table gives no rows; other columns of `lines` are ignored.
    """
    fields = tuple(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            reason, detail, columns = parse(batch.column(1), fields, separator)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(reason, pa.string()), pa.array(detail, pa.string()), *columns],
                names=["line_id", "reason", "detail", *(f.name for f in fields)],
            )

    key_type = lines.schema[key].dataType.simpleString()
    read = spread(lines.select(key, F.col(text).cast("string").alias(text))).mapInArrow(
        run, f"line_id {key_type}, reason string, detail string, " + ", ".join(f"`{f.name}` {f.spark_type}" for f in fields)
    )
    blank = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
    split = lambda c: F.array_distinct(F.filter(F.transform(F.split(c, ";"), lambda t: F.regexp_replace(t, blank, "")), lambda t: t != ""))
    return read.withColumns({f.name: split(F.col(f"`{f.name}`")) for f in fields if f.kind == "tokens"})


def rejected(lines: DataFrame, **how) -> DataFrame:
    return read_lines(lines, **how).where("reason is not null").select("line_id", "reason", "detail")


def loaded(lines: DataFrame, **how) -> DataFrame:
    return read_lines(lines, **how).where("reason is null").drop("reason", "detail")


ship(__name__)
