"""Payloads whose fields come, go, change name and change type: one table of all, and every change.

Each payload is parsed once into leaves ``(path, tag, text)``; the tags are the alternatives of a
tagged union: integer, decimal, text, flag, list and null. Schemas are fused by union of
(path, tag), never by widening, so a path that was an integer here and a text there keeps both.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.sources.tables import cut

LEAF = "struct<path:string,tag:string,text:string>"
NUMERIC = ("integer", "decimal")
#: A new name's value lies within 1 % of the old one's last value.
RENAME_TOLERANCE = 0.01


class _Lexeme(str):
    """A number as it stands in the payload."""

    __slots__ = ()


class _Whole(_Lexeme):
    __slots__ = ()


class _Broken(_Lexeme):
    __slots__ = ()


def _refuse(name: str):
    raise ValueError(name)


def _written(value) -> str:
    """JSON text of a value, numbers as they stood."""
    if isinstance(value, _Lexeme):
        return str(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(_written, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{json.dumps(k)}: {_written(v)}" for k, v in value.items()) + "}"
    return json.dumps(value)


def leaves_of(payload: str | None) -> list[tuple[str, str, str | None]] | None:
    """The leaves of a payload, sorted by path; None if it can't be read as a JSON object.

    Nested objects give dotted names, lists are leaves, an empty object has none. NaN and Infinity
    are no JSON and make a payload unreadable. Of a name that occurs twice the later value holds.
    """
    if payload is None:
        return None
    try:
        top = json.loads(payload, parse_int=_Whole, parse_float=_Broken, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    if not isinstance(top, dict):
        return None
    found: dict[str, tuple[str, str | None]] = {}
    todo = [("", top)]
    while todo:
        prefix, node = todo.pop()
        for name, value in node.items():
            path = prefix + name
            if isinstance(value, dict):
                todo.append((path + ".", value))
            elif value is None:
                found[path] = ("null", None)
            elif isinstance(value, bool):
                found[path] = ("flag", "true" if value else "false")
            elif isinstance(value, _Whole):
                found[path] = ("integer", str(value))
            elif isinstance(value, _Broken):
                found[path] = ("decimal", str(value))
            elif isinstance(value, str):
                found[path] = ("text", value)
            else:
                found[path] = ("list", _written(value))
    return [(p, *found[p]) for p in sorted(found)]


def parse_files(files: DataFrame) -> DataFrame:
    """One row per distinct file: ``series_id, written_at, file_id, readable, leaves``.

    A redelivered file is one file (the copy received first holds); rows without file_id are no files.
    """
    kept = files.filter(F.col("file_id").isNotNull()).select("file_id", "series_id", "written_at", "received_at", "payload")
    one = kept.groupBy("file_id").agg(F.min_by(F.struct("series_id", "written_at", "payload"), F.struct(F.col("received_at").isNull(), "received_at")).alias("f"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            leaves = [leaves_of(p) for p in b["payload"]]
            yield pd.DataFrame({
                "series_id": b["series_id"], "written_at": b["written_at"], "file_id": b["file_id"],
                "readable": [x is not None for x in leaves],
                "leaves": [[{"path": p, "tag": t, "text": v} for p, t, v in x or []] for x in leaves],
            })

    flat = one.select("file_id", "f.series_id", "f.written_at", "f.payload")
    return flat.mapInPandas(parse, f"series_id bigint, written_at timestamp, file_id bigint, readable boolean, leaves array<{LEAF}>")


# --- the tagged union of one series, fused file by file and segment by segment ---------------------
# A union maps each path of the last file to its branch ``[field, inside, open, tag, text]``: the name under
# which the field first appeared (renames keep it), whether that was inside the segment, whether the
# segment has given the path no alternative yet, and the alternative that holds with its last value.
# A segment is ``{"series", "fresh", "pieces"}``: ``fresh`` says that its last series begins inside it, a piece holds
# the leaves of its first file and the union after its last. Segments compose, so a series may be fused in any
# grouping. A segment has a further piece only where a path that is still open ends while numeric ones begin,
# since what precedes decides whether that is a rename; a path is open no more than once, so pieces are few.

#: Segments composed by one task; more of them take another round.
FAN_IN = 64


def fuse(union: dict, leaves: dict) -> tuple[dict, list[tuple[str, str, str]]]:
    """The union after a file ``{path: (tag, text)}``, and what the file changes: (kind, before, after).

    A path that only one side has is removed or added, or renamed if two such paths have numeric values of
    one type within RENAME_TOLERANCE; renames are matched greedily by closeness of the values, ties by names,
    each path once. An alternative that differs from the one that held makes a path retyped.
    """
    gone = sorted(p for p in union if p not in leaves)
    new = sorted(p for p in leaves if p not in union)
    pairs = []
    for g in gone:
        tag, text = union[g][3:]
        if tag not in NUMERIC:
            continue
        a = float(text)
        for n in new:
            if leaves[n][0] == tag:
                b = float(leaves[n][1])
                if abs(a - b) <= RENAME_TOLERANCE * abs(a):
                    pairs.append((abs(a - b) / abs(a) if a else 0.0, g, n))
    source: dict[str, str] = {}
    for _, g, n in sorted(pairs):
        if g not in source.values() and n not in source:
            source[n] = g
    changes = [("renamed", g, n) for n, g in source.items()]
    changes += [("removed", g, "") for g in gone if g not in source.values()]
    changes += [("added", "", n) for n in new if n not in source]
    out = {}
    for p, (tag, text) in leaves.items():
        was = union.get(p)
        if was and tag != "null" and was[3] is not None and was[3] != tag:
            changes.append(("retyped", p, p))
        field, inside = (was or union[source[p]])[:2] if was or p in source else (p, True)
        if tag != "null":
            out[p] = [field, inside, False, tag, text]
        elif was:
            out[p] = [field, inside, *was[2:]]
        else:
            out[p] = [field, inside, False, None, None]
    return out, changes


def _beginning(leaves: dict, inside: bool) -> dict:
    """The union of a series' (or, not ``inside``, a segment's) first file."""
    return {p: [p, inside, tag == "null" and not inside, *((None, None) if tag == "null" else (tag, text))] for p, (tag, text) in leaves.items()}


def _undecided(union: dict, leaves: dict) -> bool:
    """Could an open path that ends here be renamed?"""
    return any(b[2] and p not in leaves for p, b in union.items()) and any(p not in union and tag in NUMERIC for p, (tag, _) in leaves.items())


def _go_on(start: dict, union: dict) -> dict:
    """The union of a piece, whose first file left ``start``, seen from before the piece."""
    out = {}
    for p, (field, inside, opened, tag, text) in union.items():
        if not inside:
            field, inside = start[field][:2]
        if opened:
            # Null in every file of the piece: what held at its start still holds.
            opened, tag, text = start[p][2:]
        out[p] = [field, inside, opened, tag, text]
    return out


def compose(before: dict | None, segment: dict) -> dict:
    """The segment of both, ``before`` directly preceding ``segment``; None: nothing precedes it."""
    if segment["fresh"]:
        return segment
    todo = list(segment["pieces"])
    if before is not None and before["series"] == segment["series"]:
        fresh, pieces = before["fresh"], list(before["pieces"])
    else:
        one = todo.pop(0)
        fresh, pieces = True, [{"first": one["first"], "union": _go_on(_beginning(one["first"], True), one["union"])}]
    for piece in todo:
        last = pieces[-1]
        if _undecided(last["union"], piece["first"]):
            pieces.append(piece)
        else:
            pieces[-1] = {"first": last["first"], "union": _go_on(fuse(last["union"], piece["first"])[0], piece["union"])}
    return {"series": segment["series"], "fresh": fresh, "pieces": pieces}


def one_file(series: int | None, leaves: dict) -> dict:
    """The segment of a single file."""
    return {"series": series, "fresh": False, "pieces": [{"first": leaves, "union": _beginning(leaves, False)}]}


def _by_path(leaves) -> dict:
    return {x["path"]: (x["tag"], x["text"]) for x in leaves}


def _series(value) -> int | None:
    return None if pd.isna(value) else int(value)


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["series_id", "written_at", "file_id"], na_position="first")


def _segment(pdf: pd.DataFrame) -> pd.DataFrame:
    """The segment of one chunk, as JSON."""
    pdf = _ordered(pdf)
    first, last = _series(pdf["series_id"].iloc[0]), _series(pdf["series_id"].iloc[-1])
    own = pdf["leaves"][pdf["series_id"].isna() if last is None else pdf["series_id"] == last]
    state = one_file(last, _by_path(own.iloc[0]))
    if first != last:
        state = compose(None, state)
    for leaves in own.iloc[1:]:
        state = compose(state, one_file(last, _by_path(leaves)))
    return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "state": [json.dumps(state)]})


def _read_state(text) -> dict | None:
    return None if text is None or pd.isna(text) else json.loads(text)


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of neighbouring segments: what precedes each of them in the group, and the segment of the group."""
    rows, held = [], None
    for chunk, text in pdf.sort_values("chunk")[["chunk", "state"]].itertuples(index=False):
        rows.append((False, int(chunk), None if held is None else json.dumps(held)))
        # The group's first segment keeps its own relative start: what precedes the group is joined on the way down.
        held = json.loads(text) if held is None else compose(held, json.loads(text))
    rows.append((True, int(pdf["chunk"].iloc[0]) // FAN_IN, json.dumps(held)))
    return pd.DataFrame(rows, columns=["whole", "chunk", "state"])


def _join_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for above, own in zip(b["above"], b["state"]):
            above, own = _read_state(above), _read_state(own)
            out.append(json.dumps(own and compose(above, own) or above))
        yield pd.DataFrame({"chunk": b["chunk"], "state": out})


def preceding_states(segments: DataFrame, chunks: int) -> DataFrame:
    """``chunk, state``: for each chunk the composed segment of all chunks before it ("null": none).

    Rounds of FAN_IN neighbours upwards, then the same groups downwards; no task sees more than FAN_IN
    states, a state being the fields of one series.
    """
    levels = []
    while True:
        done = cut(segments.groupBy(F.floor(F.col("chunk") / FAN_IN).alias("g")).applyInPandas(_round, "whole boolean, chunk bigint, state string"), "states")
        levels.append(done.filter("not whole").select("chunk", "state"))
        if chunks <= FAN_IN:
            break
        segments, chunks = done.filter("whole").select("chunk", "state"), -(-chunks // FAN_IN)
    above = levels.pop()
    while levels:
        own = levels.pop()
        up = above.select(F.col("chunk").alias("g"), F.col("state").alias("above"))
        above = own.withColumn("g", F.floor(F.col("chunk") / FAN_IN)).join(up, "g", "left").select("chunk", "state", "above").mapInPandas(_join_states, "chunk bigint, state string")
    return above


def replay(files: DataFrame, emit: Callable, schema: str, chunk_files: int = 20_000) -> DataFrame:
    """``emit(series_id, file_id, written_at, leaves, union, changes)`` rows of every readable file in its series' order.

    Files of a series are ordered by (written_at, file_id); a null written_at comes first; a null series_id is
    a series of its own; ``union`` is the one after the file, ``changes`` is None for a series' first file.

    A series may hold a third of all files, so no task holds a whole series. The files are parsed and written
    once, range partitioned by (series, time, id) into chunks of about ``chunk_files``; the chunks' segments are
    composed in rounds, and each chunk fuses its files once more from the union before it.
    """
    parsed = cut(parse_files(files).filter("readable").drop("readable"), "files")
    # The number of rows stands in the footers of the files just written.
    chunks = max(1, -(-parsed.count() // chunk_files))
    ranged = parsed.repartitionByRange(chunks, F.col("series_id"), F.col("written_at"), F.col("file_id"))
    fixed = cut(ranged.withColumn("chunk", F.spark_partition_id().cast("bigint")), "drift")
    states = preceding_states(fixed.groupBy("chunk").applyInPandas(_segment, "chunk bigint, state string"), chunks)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        held = _read_state(before["state"].iloc[0]) if len(before) else None
        held = held and compose(None, held)
        series, union = (held["series"], held["pieces"][-1]["union"]) if held else (None, None)
        rows: list[tuple] = []
        for s, f, t, leaves in zip(*(_ordered(pdf)[c] for c in ("series_id", "file_id", "written_at", "leaves"))):
            s, leaves = _series(s), _by_path(leaves)
            if union is None or s != series:
                series, union, changes = s, _beginning(leaves, True), None
            else:
                union, changes = fuse(union, leaves)
            rows += emit(s, f, t, leaves, union, changes)
        return pd.DataFrame(rows, columns=names).astype({"series_id": "Int64", "file_id": "int64"})

    return fixed.groupBy("chunk").cogroup(states.groupBy("chunk")).applyInPandas(run, schema)


def drift_report(files: DataFrame, chunk_files: int = 20_000) -> DataFrame:
    """Every change between neighbouring readable files of a series, read off the series' tagged union.

    Result: ``series_id, file_id, change_kind, field_before, field_after`` as TESTDATA.md defines them. An empty
    table gives no rows; a series' first file no change. Order of files and nulls: ``replay``.
    """
    emit = lambda s, f, t, leaves, union, changes: [(s, f, *c) for c in changes or ()]
    return replay(files, emit, "series_id bigint, file_id bigint, change_kind string, field_before string, field_after string", chunk_files)


def fused_schema(files: DataFrame) -> DataFrame:
    """The tagged union of all schemas: ``path, tag, files, first_seen, last_seen, alternatives, canonical``.

    One row per alternative of a path. ``canonical`` is the type of the path's canonical column: the
    only non-null alternative; ``decimal`` where integers and decimals meet; ``text`` otherwise.
    """
    leaf = parse_files(files).filter("readable").select("written_at", F.explode("leaves").alias("l"))
    each = leaf.groupBy("l.path", "l.tag").agg(F.count("*").alias("files"), F.min("written_at").alias("first_seen"), F.max("written_at").alias("last_seen"))
    tags = each.groupBy("path").agg(F.array_sort(F.collect_set("tag")).alias("alternatives"))
    kinds = F.array_remove("alternatives", "null")
    canonical = F.when(F.size(kinds) == 0, "null").when(F.size(kinds) == 1, kinds[0]).when(F.size(F.array_except(kinds, F.array(*map(F.lit, NUMERIC)))) == 0, "decimal").otherwise("text")
    return each.join(tags, "path").withColumn("canonical", canonical)


def consistent_table(files: DataFrame, chunk_files: int = 20_000) -> DataFrame:
    """All files in one table, a row per (file, field) with typed branches and a canonical value.

    ``series_id, file_id, written_at, field, path, tag, lexeme, as_integer, as_decimal, as_flag, as_text, as_list,
    canonical_number``: ``field`` is the name under which the field first appeared in its series, so a renamed
    field goes on under its old name; ``path`` is its name in this file. The branch of the value's own type
    holds it, the others are null; whole numbers beyond 64 bits are held by ``lexeme``, the value as it stands,
    alone. ``canonical_number`` also reads numbers written as text, flags as 0 and 1, and lists of one number.
    """
    emit = lambda s, f, t, leaves, union, changes: [(s, f, t, union[p][0], p, tag, text) for p, (tag, text) in leaves.items()]
    leaf = replay(files, emit, "series_id bigint, file_id bigint, written_at timestamp, field string, path string, tag string, lexeme string", chunk_files)
    branch = lambda tag, kind: F.when(F.col("tag") == tag, F.col("lexeme").try_cast(kind))
    inner = F.regexp_extract("lexeme", r"^\[\s*([^,\[\]\s]+)\s*\]$", 1)
    number = F.when(F.col("tag").isin("integer", "decimal", "text"), F.col("lexeme").try_cast("double")).when(F.col("tag") == "flag", (F.col("lexeme") == "true").cast("double")).when(F.col("tag") == "list", F.regexp_replace(inner, '"', "").try_cast("double"))
    return leaf.select(
        "series_id", "file_id", "written_at", "field", "path", "tag", "lexeme",
        branch("integer", "bigint").alias("as_integer"), branch("decimal", "double").alias("as_decimal"), branch("flag", "boolean").alias("as_flag"),
        F.when(F.col("tag") == "text", F.col("lexeme")).alias("as_text"), F.when(F.col("tag") == "list", F.col("lexeme")).alias("as_list"), number.alias("canonical_number"),
    )


def wide_table(consistent: DataFrame) -> DataFrame:
    """A row per file, ``series_id, file_id, written_at`` and a column per field of ``consistent_table``.

    A column has the field's canonical type: double if it ever was a number, boolean if it was always a flag, else
    text, where every value is its lexeme. Values that aren't numbers in any reading stay in a column
    ``<field>!<tag>`` of their own. The columns come from the distinct (field, tag), thus from the schema alone.
    """
    kinds: dict[str, set] = {}
    for r in consistent.select("field", "tag").distinct().toLocalIterator():
        kinds.setdefault(r["field"], set()).add(r["tag"])
    columns: list = []
    used: Counter = Counter()
    for name in sorted(kinds):
        # Column names are blind to case: of names that differ by it alone the later ones are numbered.
        used[name.lower()] += 1
        column = name if used[name.lower()] == 1 else f"{name}~{used[name.lower()]}"
        tags = kinds[name] - {"null"}
        mine = F.col("field") == name
        number = tags & set(NUMERIC)
        whole = F.col("canonical_number") if number else F.col("as_flag") if tags == {"flag"} else F.col("lexeme")
        columns.append(F.max(F.when(mine, whole)).alias(column))
        if number:
            columns += [F.max(F.when(mine & (F.col("tag") == t) & F.col("canonical_number").isNull(), F.col("lexeme"))).alias(f"{column}!{t}") for t in sorted(tags - set(NUMERIC))]
    return consistent.groupBy("series_id", "file_id", "written_at").agg(F.count("*").alias("n_fields"), *columns)
