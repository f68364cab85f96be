"""Results as JSON envelopes and as text tables, whole whatever their size: rows are fetched a partition at a time and kept on disk, not in memory."""

from __future__ import annotations

import io
import json
import tempfile
from collections.abc import Iterator
from typing import IO, TextIO

from stratalog.engine import Result

#: Bytes of a result that are held in memory; what is more goes to a temporary file.
SPOOL_BYTES = 8 << 20


def envelope(data=None, error: Exception | None = None) -> str:
    body = {"success": error is None, "data": data, "error": {"message": str(error), "type": getattr(error, "code", "INTERNAL")} if error else None}
    return json.dumps(body, default=str)


def _rows(result: Result) -> Iterator[list]:
    return (list(r) for r in result.rows.toLocalIterator(prefetchPartitions=True))


def spooled_envelope(result: Result) -> IO[bytes]:
    """The envelope of a result with all its rows, as a file at its beginning. Errors of its rows come up here, before anything is sent."""
    out = tempfile.SpooledTemporaryFile(SPOOL_BYTES)
    try:
        if result.rows is None:
            out.write(envelope({"message": result.message, "rowsAffected": result.affected, "executionTimeMs": result.millis}).encode())
        else:
            out.write(f'{{"success": true, "data": {{"columns": {json.dumps(result.rows.columns)}, "rows": ['.encode())
            n = 0
            for n, r in enumerate(_rows(result), 1):
                out.write(((", " if n > 1 else "") + json.dumps(r, default=str)).encode())
            out.write(f'], "rowCount": {n}, "truncated": false, "executionTimeMs": {json.dumps(result.millis)}}}, "error": null}}'.encode())
    except BaseException:
        out.close()
        raise
    out.seek(0)
    return out


def write_table(result: Result, out: TextIO) -> None:
    """Print all rows of a result. The widths need every row, so the cells wait in a temporary file."""
    if result.error:
        print(f"Error: {result.error}", file=out)
        return
    if result.rows is None:
        print(f"{result.message} ({result.millis:.1f} ms)", file=out)
        return
    columns, n = result.rows.columns, 0
    widths = [len(c) for c in columns]
    with tempfile.SpooledTemporaryFile(SPOOL_BYTES, "w+", encoding="utf-8", newline="\n") as cells:
        for n, r in enumerate(_rows(result), 1):
            row = ["NULL" if v is None else str(v) for v in r]
            widths = [max(w, len(v)) for w, v in zip(widths, row, strict=True)]
            cells.write(json.dumps(row) + "\n")
        cells.seek(0)
        rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        line = lambda row: "| " + " | ".join(v.ljust(w) for v, w in zip(row, widths, strict=True)) + " |"
        print(rule, line(columns), rule, sep="\n", file=out)
        for text in cells:
            print(line(json.loads(text)), file=out)
    print(rule, f"{n} row(s) ({result.millis:.1f} ms)", sep="\n", file=out)


def text_table(result: Result) -> str:
    """What ``write_table`` prints."""
    out = io.StringIO()
    write_table(result, out)
    return out.getvalue().rstrip("\n")
