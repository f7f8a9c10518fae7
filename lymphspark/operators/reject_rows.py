"""Load delimited records and set apart those that cannot be loaded, each with the reason.

Structure is judged by the Arrow CSV reader, whose invalid-row callback hands over every record with a wrong number of
columns; all fields are read as strings, and the typed kinds are then checked column by column on whole vectors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lymphspark.session import ship_package

#: A layout table describes files by hand and is read at the driver; more fields than this are refused.
MAX_LAYOUT_FIELDS = 100_000

RESULT = "file_name string, is_valid boolean, reason string, bad_fields array<string>, fields map<string,string>"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    allowed: str
    required: bool


@dataclass(frozen=True)
class Layout:
    delimiter: str
    fields: tuple[Field, ...]


def read_layouts(layouts: DataFrame) -> dict[str, Layout]:
    """Layouts by file name. Repeated rows count once; of two rows for one field number the first by name holds."""
    cols = ["file_name", "field_no", "field_name", "delimiter", "value_kind", "allowed_values", "is_required"]
    rows = layouts.select(*cols).filter("file_name is not null and field_no is not null").distinct().limit(MAX_LAYOUT_FIELDS + 1).collect()
    if len(rows) > MAX_LAYOUT_FIELDS:
        raise ValueError(f"the layout table has over {MAX_LAYOUT_FIELDS} fields")
    by: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: [str(x) for x in r]):
        by.setdefault(r.file_name, {}).setdefault(r.field_no, r)
    out = {}
    for name, fields in by.items():
        own = [fields[k] for k in sorted(fields)]
        made = tuple(Field(r.field_name or f"field_{r.field_no}", (r.value_kind or "text").strip().lower(), r.allowed_values or "", bool(r.is_required)) for r in own)
        out[name] = Layout(own[0].delimiter or "", made)
    return out


def load_records(records: DataFrame, layouts: DataFrame, id_col: str = "raw_id", file_col: str = "file_name", line_col: str = "raw_line") -> DataFrame:
    """One row per record: its id, ``file_name``, ``is_valid``, ``reason``, ``bad_fields`` and ``fields`` (name to value).

    A record is valid if its quoting is sound, it has exactly the fields of its layout, required fields aren't blank, and
    fields that aren't blank hold a value of their kind (choice, int, date; text is free). Values of the typed kinds come
    out trimmed, choices in lower case. Records that fail only by a cell keep their fields; structural rejects have null.

    Null records and records of files without a layout are rejects with that reason. An empty record is one blank field.
    Repeated rows are judged each. An empty table gives an empty result. Other columns of the input are not looked at.
    """
    ship_package(records.sparkSession)
    known = read_layouts(layouts)
    kind = records.schema[id_col].dataType.simpleString()
    chosen = records.select(F.col(id_col).alias("raw_id"), F.col(file_col).cast("string").alias("file_name"), F.col(line_col).cast("string").alias("raw_line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield judge(batch, known)

    return chosen.mapInArrow(run, f"raw_id {kind}, {RESULT}").withColumnRenamed("raw_id", id_col)


def judge(batch: pa.RecordBatch, known: dict[str, Layout]) -> pa.RecordBatch:
    n = batch.num_rows
    ids, files, lines = batch.column(0), batch.column(1), batch.column(2)
    reason = np.full(n, None, dtype=object)
    bad: list[list[str]] = [[] for _ in range(n)]
    cells: list[dict[str, str] | None] = [None] * n
    reason[~lines.is_valid().to_numpy(zero_copy_only=False)] = "the record is null"
    codes = files.dictionary_encode()
    at = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    reason[(at < 0) & (reason == None)] = "no file name"  # noqa: E711
    for code, name in enumerate(codes.dictionary.to_pylist()):
        own = np.flatnonzero((at == code) & (reason == None))  # noqa: E711
        layout = known.get(name)
        if layout is None:
            reason[own] = "no layout for this file"
        elif len(layout.delimiter) != 1 or layout.delimiter in '"\r\n':
            reason[own] = "the layout has no usable delimiter"
        elif len(own):
            _judge_file(own, lines.take(pa.array(own)), layout, reason, bad, cells)
    valid = pa.array([r is None for r in reason], pa.bool_())
    offsets, keys, items = [0], [], []
    for c in cells:
        if c:
            keys += c.keys()
            items += c.values()
        offsets.append(len(keys))
    fields = pa.MapArray.from_arrays(pa.array([None if c is None else o for c, o in zip(cells, offsets)] + [offsets[-1]], pa.int32()), pa.array(keys, pa.string()), pa.array(items, pa.string()))
    out = [ids, pa.array(files), valid, pa.array(list(reason), pa.string()), pa.array(bad, pa.list_(pa.string())), fields]
    return pa.RecordBatch.from_arrays(out, names=["raw_id", "file_name", "is_valid", "reason", "bad_fields", "fields"])


def _judge_file(own: np.ndarray, lines: pa.Array, layout: Layout, reason: np.ndarray, bad: list, cells: list) -> None:
    d = re.escape(layout.delimiter)
    quoted = '"(?:[^"]|"")*"'
    whole = lambda free: rf"\A(?:{quoted}|{free}*)(?:{d}(?:{quoted}|{free}*))*\z"
    sound = pc.match_substring_regex(lines, whole(f'[^"{d}]')).to_numpy(zero_copy_only=False)
    reason[own[~sound]] = "unsound quoting"
    unbroken = pc.match_substring_regex(lines, whole(f'[^"{d}\\r\\n]')).to_numpy(zero_copy_only=False)
    reason[own[sound & ~unbroken]] = "a line break outside quotes"
    keep = np.flatnonzero(unbroken)
    if not len(keep):
        return
    names = [f"f{k}" for k in range(len(layout.fields))]
    wrong: dict[int, int] = {}

    def reject(row) -> str:
        wrong[int(row.text.split(layout.delimiter, 1)[0])] = row.actual_columns - 1
        return "skip"

    text = "\n".join(f"{i}{layout.delimiter}{line}" for i, line in zip(keep, lines.take(pa.array(keep)).to_pylist())) + "\n"
    data = text.encode()
    read = csv.read_csv(
        pa.BufferReader(data),
        read_options=csv.ReadOptions(use_threads=False, block_size=min(len(data) + 1024, 2**31 - 1), column_names=["i", *names]),
        parse_options=csv.ParseOptions(delimiter=layout.delimiter, quote_char='"', double_quote=True, escape_char=False, newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=reject),
        convert_options=csv.ConvertOptions(column_types={"i": pa.int64()} | dict.fromkeys(names, pa.string()), strings_can_be_null=False, null_values=[], check_utf8=False),
    ).combine_chunks()
    for i, found in wrong.items():
        reason[own[i]] = f"{found} fields instead of {len(names)}"
    rows = own[read.column("i").to_numpy()]
    values = []
    failed: dict[int, list[str]] = {}
    for field, name in zip(layout.fields, names):
        raw = read.column(name).combine_chunks()
        value, fault = check_cells(raw if isinstance(raw, pa.Array) else pa.concat_arrays(raw.chunks), field)
        values.append(value.to_pylist())
        for k in np.flatnonzero(fault != ""):
            failed.setdefault(int(k), []).append(f"{field.name}: {fault[k]}")
            bad[rows[k]].append(field.name)
    labels = [f.name for f in layout.fields]
    for k, (row, got) in enumerate(zip(rows, zip(*values))):
        cells[row] = dict(zip(labels, got))
        if k in failed:
            reason[row] = "; ".join(failed[k])


def check_cells(raw: pa.Array, field: Field) -> tuple[pa.Array, np.ndarray]:
    """The field's values as they are loaded, and for each cell what is wrong with it, or an empty string."""
    trimmed = pc.utf8_trim_whitespace(raw)
    blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    fault = np.full(len(raw), "", dtype=object)
    value = raw
    if field.kind == "choice":
        value = pc.utf8_lower(trimmed)
        choices = pa.array([c.strip().lower() for c in field.allowed.split("|")], pa.string())
        fault[~pc.is_in(value, value_set=choices).to_numpy(zero_copy_only=False)] = "not one of the choices"
    elif field.kind == "int":
        value = trimmed
        digits = pc.match_substring_regex(trimmed, r"\A[0-9]+\z").to_numpy(zero_copy_only=False)
        fault[~digits] = "not a whole number in plain digits"
        low, _, high = field.allowed.partition("..")
        bare = pc.utf8_ltrim(trimmed, characters="0")
        short = pc.less_equal(pc.binary_length(bare), 18).to_numpy(zero_copy_only=False)
        fault[digits & ~short] = "outside the limits"
        fit = digits & short
        number = pc.if_else(pa.array(fit), pc.if_else(pc.equal(bare, ""), "0", bare), "0").cast(pa.int64()).to_numpy()
        if low.strip():
            fault[fit & (number < int(low))] = "outside the limits"
        if high.strip():
            fault[fit & (number > int(high))] = "outside the limits"
    elif field.kind == "date":
        value = trimmed
        shaped = pc.match_substring_regex(trimmed, r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
        safe = pc.if_else(shaped, trimmed, "0001-01-01")
        y, m, day = (pc.utf8_slice_codeunits(safe, a, b).cast(pa.int64()).to_numpy() for a, b in ((0, 4), (5, 7), (8, 10)))
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        lengths = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
        month = np.where((m >= 1) & (m <= 12), m, 0)
        there = (y >= 1) & (day >= 1) & (day <= lengths[month] + ((month == 2) & leap))
        shaped = shaped.to_numpy(zero_copy_only=False)
        fault[~shaped] = "not a date written YYYY-MM-DD"
        fault[shaped & ~there] = "not an existing date"
    fault[blank] = "blank, but required" if field.required else ""
    return value, fault
