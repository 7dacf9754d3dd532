"""What is sent of a file: complete lines, scrubbed, compressed where that helps."""

from __future__ import annotations

import gzip

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.functions.text import scrub

#: Rows and bytes of contents that a task packs or unpacks at a time.
ROWS, BYTES = 500, 8_000_000
#: Level of compression.
LEVEL = 6


def complete_lines(path: Column, content: Column) -> Column:
    """A file's text (invalid UTF-8 replaced); of .jsonl files the part after the last line end goes, unless it is all there is."""
    text = F.make_valid_utf8(content.cast("string"))
    tail = F.char_length(F.substring_index(text, "\n", -1))
    whole = F.substring(text, F.lit(1), F.char_length(text) - tail)
    return F.when(path.endswith(".jsonl") & F.contains(text, F.lit("\n")), whole).otherwise(text)


def _slices(batches, column: str):
    """Batches again, of ROWS rows and BYTES bytes at most; a longer content is alone."""
    for whole in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < whole.num_rows:
            before = ends[at - 1] if at else 0
            stop = min(at + ROWS, max(at + 1, int(np.searchsorted(ends, before + BYTES, "right"))))
            yield whole.slice(at, stop - at)
            at = stop


def _compressed(mode: str):
    def run(batches):
        for batch in _slices(batches, "raw"):
            raw = [x or b"" for x in batch.column("raw").to_pylist()]
            packed = [gzip.compress(x, LEVEL, mtime=0) if mode != "raw" else x for x in raw]
            use = [mode == "gzip" or (mode == "auto" and len(p) < len(x)) for p, x in zip(packed, raw)]
            content = [p if u else x for p, x, u in zip(packed, raw, use)]
            columns = [batch.column("path"), pa.array(content, pa.binary()), pa.array(["gzip" if u else "raw" for u in use]), pa.array(map(len, raw), pa.int64()), pa.array(map(len, content), pa.int64())]
            yield pa.record_batch(columns, names=["path", "content", "codec", "raw_bytes", "stored_bytes"])

    return run


def payloads(files: DataFrame, mode: str = "auto") -> DataFrame:
    """(path, content, codec, raw_bytes, stored_bytes) of files (path, content: binary).

    mode: auto (gzip where that is smaller), gzip or raw. Null contents are empty ones; no files: no rows.
    """
    if mode not in ("auto", "gzip", "raw"):
        raise ValueError(f"no mode {mode}")
    clean = files.select("path", F.encode(scrub(complete_lines(F.col("path"), F.col("content"))), "utf-8").alias("raw"))
    return clean.mapInArrow(_compressed(mode), "path string, content binary, codec string, raw_bytes long, stored_bytes long")


def unpacked(stored: DataFrame) -> DataFrame:
    """(path, content) of payloads (path, content, codec): decompressed where the codec says so or, without one, where the content is gzip. Content that is damaged fails the job."""
    codec = F.col("codec") if "codec" in stored.columns else F.lit(None).cast("string")

    def run(batches):
        for batch in _slices(batches, "content"):
            paths, out, size = [], [], 0
            for path, x, c in zip(batch.column("path"), batch.column("content"), batch.column("codec").to_pylist()):
                x = x.as_py()
                paths.append(path.as_py())
                out.append(x if x is None or not (c == "gzip" or c is None and x[:2] == b"\x1f\x8b") else gzip.decompress(x))
                size += len(out[-1] or b"")
                if size >= BYTES:  # what was small when packed may be large
                    yield pa.record_batch([pa.array(paths, batch.column("path").type), pa.array(out, pa.binary())], names=["path", "content"])
                    paths, out, size = [], [], 0
            if paths:
                yield pa.record_batch([pa.array(paths, batch.column("path").type), pa.array(out, pa.binary())], names=["path", "content"])

    return stored.select("path", "content", codec.alias("codec")).mapInArrow(run, "path string, content binary")


def fetched(wanted: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of wanted (path, codec, raw_bytes, stored_bytes, sha256): those that kept (with the same columns and content) doesn't have in that state, and the kept rows that are good."""
    signature = ["path", "codec", "raw_bytes", "stored_bytes", "sha256"]
    return wanted.join(kept.select(*signature), signature, "left_anti"), kept.join(wanted.select(*signature), signature, "left_semi")
