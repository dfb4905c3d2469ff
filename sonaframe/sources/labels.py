"""Label lists (pipe separated) and label JSONL: readers, parsers, writers.

A label list line is ``path|speaker|language|text`` with no header.  A line
that does not split into exactly four fields is rejected, not repaired (text
holding ``|`` is rejected too).  Splitting uses limit -1 so trailing empty
fields are counted.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL_FIELDS = ("path", "speaker", "lang", "text")
REASON_FIELD_COUNT = "field_count"


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*"
_GLOB = {"*": "[^/]*", "?": "[^/]", "{": "(", "}": ")", ",": "|"}


def path_pattern(path: str) -> str:
    """A Java pattern of the files that one given path names: the path itself or what lies below it.

    Scheme and host are left out; a relative path may follow any folder;
    ``* ? [] {}`` are globs.
    """
    bare = re.sub(_SCHEME, "/", path).rstrip("/")
    out, braces, i = [], 0, 0
    while i < len(bare):
        c = bare[i]
        if c == "[" and "]" in bare[i:]:
            end = bare.index("]", i)
            out.append(bare[i: end + 1])
            i = end
        elif c in "{}" or c == "," and braces or c in "*?":
            braces += {"{": 1, "}": -1}.get(c, 0)
            out.append(_GLOB[c])
        else:
            out.append(re.escape(c))
        i += 1
    return ("^" if bare.startswith("/") or not bare else "^(.*/)?") + "".join(out) + r"(/|\z)"


def file_path(c: Column) -> Column:
    """The path of a file as given to the reader: percent escapes decoded, without scheme and host."""
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), _SCHEME, "/")


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text files as ``(source_file, line_no, line)``.

    ``line_no`` orders lines as they would be read one file after another:
    by the place of the path in ``paths``, the file's name, the start of the
    split in the file, and the row of the split.  (Spark packs files into
    partitions by size, so that a row number alone is not in file order.)
    A file belongs to the longest given path that is the file itself or a
    folder above it (whole names, globs allowed).
    It orders duplicates for "last line wins" rules and is not dense.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.text(given)
    file = F.col("_metadata.file_path")
    path, place = file_path(file), F.lit(len(given))
    # the shortest path is tested last, so it goes innermost
    for i, p in sorted(enumerate(given), key=lambda x: (len(x[1].rstrip("/")), -x[0])):
        place = F.when(path.rlike(path_pattern(p)), F.lit(i)).otherwise(place)
    return df.select(
        file.alias("source_file"),
        F.struct(place.alias("place"), path.alias("file"), F.col("_metadata.file_block_start").alias("start"),
                 F.monotonically_increasing_id().alias("row")).alias("line_no"),
        F.col("value").alias("line"),
    )


def parse_label_lines(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Split label lines; adds the four fields, ``n_fields`` and ``reject_reason``.

    Accepted rows have ``reject_reason`` null; fields are null on rejects.
    """
    parts = F.split(F.col(line_col), r"\|", -1)
    ok = F.size(parts) == 4
    fields = [F.when(ok, F.get(parts, i)).alias(name) for i, name in enumerate(LABEL_FIELDS)]
    return df.select(
        "*",
        *fields,
        F.size(parts).cast("long").alias("n_fields"),
        F.when(~ok, F.lit(REASON_FIELD_COUNT)).alias("reject_reason"),
    )


def split_label_fields(df: DataFrame, line_col: str = "line", sep: str = "|") -> DataFrame:
    """S1, lenient loader: every line split into ``fields`` (any count, no check)."""
    return df.withColumn("fields", F.split(F.col(line_col), re.escape(sep), -1))


def read_label_list(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Read and parse label list files."""
    return parse_label_lines(read_lines(spark, paths))


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def format_label_line(path: Column | str = "path", speaker: Column | str = "speaker",
                      lang: Column | str = "lang", text: Column | str = "text") -> Column:
    """``path|speaker|LANG|text``; language upper-cased, line stripped.

    A null field is empty, and a line break inside a field becomes a space,
    so that a record is always one line of four fields.
    """
    cols = [F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"[\r\n]+", " ")
            for c in (path, speaker, lang, text)]
    return strip_ws(F.concat_ws("|", cols[0], cols[1], F.upper(cols[2]), cols[3]))


def label_line_reason(path: str = "path", speaker: str = "speaker", lang: str = "lang", text: str = "text") -> Column:
    """``field_count`` for a record that a label line cannot hold (a ``|`` inside a field), else null."""
    bars = [F.coalesce(F.contains(F.col(c), F.lit("|")), F.lit(False)) for c in (path, speaker, lang, text)]
    return F.when(bars[0] | bars[1] | bars[2] | bars[3], F.lit(REASON_FIELD_COUNT))


def write_label_list(df: DataFrame, out_path: str, mode: str = "overwrite") -> DataFrame:
    """Write the records that a label line can hold; returns the others with ``reject_reason``."""
    reason = label_line_reason()
    df.where(reason.isNull()).select(format_label_line().alias("value")).write.mode(mode).text(out_path)
    return df.withColumn("reject_reason", reason).where(F.col("reject_reason").isNotNull())


def parse_label_json(df: DataFrame, json_col: str = "value", text_key: str = "text",
                     path_key: str = "wav_path") -> DataFrame:
    """Pull the caller-chosen text and path keys out of JSON records.

    The keys are parameters, so the record schema stays dynamic; a record
    that is not JSON yields nulls.
    """
    return df.select(
        "*",
        F.get_json_object(F.col(json_col), f"$.{text_key}").alias("text"),
        F.get_json_object(F.col(json_col), f"$.{path_key}").alias("path"),
    )


def read_label_json(spark: SparkSession, paths: str | Sequence[str], text_key: str = "text",
                    path_key: str = "wav_path") -> DataFrame:
    return parse_label_json(read_lines(spark, paths), "line", text_key, path_key)


def to_json_line(cols: Sequence[str]) -> Column:
    """One JSON object per row; non-ASCII characters are written as is."""
    return F.to_json(F.struct(*[F.col(c) for c in cols]))


def write_json(df: DataFrame, out_path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(out_path)
