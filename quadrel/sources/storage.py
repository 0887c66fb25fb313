"""Datasets in a folder: Parquet for each component and one metadata file for each version.

Every save, append, assignment or resize writes new folders with what it adds or changes, and
then a metadata file that lists every component's folders, so readers see the old state or the
new one and nothing is written twice. A metadata file is named by its version, one more than
the version it was made from, and is put there only if no other writer has; a writer that comes
second begins again or, where its matrix is out of date, is refused. Layers are partitioned by
bands of columns and sorted by rows within files, so column ranges prune folders and row ranges
skip row groups. Folders that no version lists are removed by ``vacuum``; ``compact`` joins a
component's parts. Data files go through Spark's readers and writers, metadata files through
the file system that Spark uses for the path.
"""

from __future__ import annotations

import datetime
import json
import uuid
from dataclasses import replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrel.matrix import COL, MAIN, ROW, TILE, AnnotatedMatrix, Block, Origin, align_attributes, differing_globals, fill_value
from quadrel.operators.validate import validate_schema, validate_spec

SPEC_VERSION = "3.0.0"
BAND = 4096  # columns of a folder
ROWS = 65_536  # rows of a band that one task writes


STAMP = "%Y%m%dT%H%M%S.%fZ"


class Conflict(RuntimeError):
    """Another writer has put the next version there first."""


def timestamp(after: str | None = None) -> str:
    """Now; at least a microsecond later than ``after``, whatever this machine's clock says."""
    now = datetime.datetime.now(datetime.timezone.utc).strftime(STAMP)
    if after is None or now > after:
        return now
    return (datetime.datetime.strptime(after, STAMP) + datetime.timedelta(microseconds=1)).strftime(STAMP)


def version_tuple(version: str) -> tuple[int, ...]:
    return tuple(int(x) for x in (version or "0.0.0").split("."))


def compare_versions(a: str, b: str) -> int:
    """-1, 0 or 1, by numbers."""
    x, y = version_tuple(a), version_tuple(b)
    return (x > y) - (x < y)


def new(spark: SparkSession, attrs: dict | None = None) -> AnnotatedMatrix:
    """An empty matrix; columns are appended to it, rows come with the first."""
    attrs = {k: "None" if v is None else v for k, v in (attrs or {}).items()}
    rows, cols = spark.createDataFrame([], f"{ROW} long"), spark.createDataFrame([], f"{COL} long")
    empty = spark.createDataFrame([], f"{ROW} long, {COL} long, value double")
    return AnnotatedMatrix(rows, cols, {MAIN: empty}, 0, 0, attrs={"CreationDate": timestamp(), "SPEC_VERSION": SPEC_VERSION, **attrs})


def safe(name: str) -> str:
    return "main" if name == MAIN else "x" + name.encode().hex()


UNSOUND = "layers may not hold null, NaN or infinite values"


def write_layer(entries: DataFrame, folder: str, width: int) -> None:
    """A folder a band of ``width`` columns; a task writes a range of a band's rows."""
    banded = entries.withColumn("band", F.floor(F.col(COL) / width).cast("int"))
    dealt = banded.repartition(F.col("band"), F.floor(F.col(ROW) / ROWS))
    write_sound(dealt.sortWithinPartitions("band", ROW, COL), folder, "band")


def write_sound(entries: DataFrame, folder: str, *by: str) -> None:
    """A value that is no number stops the write, so entries are worked out once; no version
    lists what was written by then."""
    value = F.col("value").cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    sound = entries.withColumn("value", F.when(bad, F.raise_error(F.lit(UNSOUND))).otherwise(F.col("value")))
    try:
        sound.write.partitionBy(*by).parquet(folder)
    except PySparkException as error:
        if UNSOUND not in str(error):
            raise
        raise ValueError(UNSOUND) from None


def layer_part(name: str, version: str) -> str:
    """Folder of what one save or append adds to a layer."""
    return f"layers/{safe(name)}/part={version}"


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, a function from text to its path objects)."""
    jvm = spark.sparkContext._jvm
    to_path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to_path


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the metadata files, ascending; raises FileNotFoundError if there are none."""
    fs, to_path = file_system(spark, path)
    folder = to_path(f"{path}/_meta")
    names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    found = sorted(int(n[1:-4]) for n in names if n.startswith("v") and n.endswith(".txt"))
    if not found:
        raise FileNotFoundError(f"no dataset at {path}")
    return found


def meta_file(path: str, version: int) -> str:
    return f"{path}/_meta/v{version:012d}.txt"


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """Put the file of ``meta["version"]`` there whole, or raise Conflict if there is one."""
    from py4j.protocol import Py4JJavaError

    jvm = spark.sparkContext._jvm
    fs, to_path = file_system(spark, path)
    made, target = to_path(f"{path}/_meta/.{uuid.uuid4().hex}"), to_path(meta_file(path, meta["version"]))
    stream = fs.create(made, False)
    try:
        stream.write(bytearray(json.dumps(meta).encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(made, target, never)  # fails if the target is there
    except Py4JJavaError as error:
        fs.delete(made, False)
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        raise Conflict(f"version {meta['version']} of {path} is there already") from None


def current_version(spark: SparkSession, path: str) -> int:
    try:
        return versions(spark, path)[-1]
    except FileNotFoundError:
        return 0


def metadata(spark: SparkSession, path: str) -> dict:
    """The last version's metadata, the only file that is read; raises FileNotFoundError if
    there is no dataset. Any other trouble in reading it is raised as it is."""
    fs, to_path = file_system(spark, path)
    stream = fs.open(to_path(meta_file(path, versions(spark, path)[-1])))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def new_part(folder: str, **more) -> dict:
    """Metadata of one folder of a component. ``hidden``: bands that a later part has anew;
    ``limit``: [rows, columns] (or ends of an axis) from which on nothing is there; ``block``:
    the folder holds rows with values and columns, whose cells are all pairs."""
    return {"folder": folder, **more}


def save(matrix: AnnotatedMatrix, path: str, changed: dict[str, str] | None = None) -> None:
    """Write a dataset. What a matrix that was opened at this path still holds unchanged is
    not written again and keeps its time stamps; of a layer whose cells were assigned only the
    bands that hold them are. ``changed``: component -> stamp to set. Raises Conflict if the
    dataset has changed since the matrix was opened."""
    spark, part = matrix.spark, f"v{uuid.uuid4().hex}"
    origin = matrix.origin if matrix.origin and matrix.origin.path == path else None
    old = origin.meta if origin else None
    version = current_version(spark, path)
    if old and old["version"] != version:
        raise Conflict(f"the dataset is at version {version}, the matrix was opened at {old['version']}")
    now = timestamp(metadata(spark, path)["last_modified"] if version else None)
    same = lambda component, df: origin is not None and origin.parts.get(component) is df
    patched = lambda name, df: origin is not None and name in matrix.patches and matrix.patches[name].layer is df
    width = old["band"] if old else BAND
    meta = {"version": version + 1, "spec": SPEC_VERSION, "band": width, "shape": list(matrix.shape), "attrs": matrix.attrs, "last_modified": now, "layers": {}, "row_graphs": {}, "col_graphs": {}, "tables": {}}
    stamps = {}
    for name, entries in matrix.layers.items():
        component = f"layers/{name}"
        if same(component, entries):
            meta["layers"][name], stamps[component] = old["layers"][name], old["modified"][component]
            continue
        stamps[component] = now
        if patched(name, entries):
            meta["layers"][name] = write_patch(matrix, name, path, part, width)
            continue
        write_layer(entries, f"{path}/{layer_part(name, part)}", width)
        meta["layers"][name] = {"type": entries.schema["value"].dataType.simpleString(), "parts": [new_part(layer_part(name, part))]}
    for key, table in (("row_attrs", matrix.rows), ("col_attrs", matrix.cols)):
        names = [c for c in table.columns if c not in (ROW, COL)]
        if same(key, table):
            meta[key] = old[key]
        else:
            table.write.parquet(f"{path}/{part}/{key}")
            meta[key] = {"schema": table.schema.jsonValue(), "parts": [new_part(f"{part}/{key}", fills={})]}
        known = old["modified"] if old and f"{key}/*" not in matrix.touched else {}
        stamps.update({f"{key}/{c}": now if f"{key}/{c}" in matrix.touched else known.get(f"{key}/{c}", now) for c in names})
    for key in ("row_graphs", "col_graphs", "tables"):
        for name, edges in getattr(matrix, key).items():
            component = f"{key}/{name}"
            if same(component, edges):
                meta[key][name], stamps[component] = old[key][name], old["modified"][component]
                continue
            edges.write.parquet(f"{path}/{part}/{key}/{safe(name)}")
            meta[key][name], stamps[component] = [new_part(f"{part}/{key}/{safe(name)}")], now
    for k, v in matrix.attrs.items():
        stamps[f"attrs/{k}"] = old["modified"].get(f"attrs/{k}", now) if old and k in old["attrs"] and old["attrs"][k] == v else now
    write_meta(spark, path, meta | {"modified": {**stamps, **(changed or {})}})


def write_patch(matrix: AnnotatedMatrix, name: str, path: str, part: str, width: int) -> dict:
    """Write the bands that hold assigned cells anew and hide them in the older parts. Gives
    the layer's metadata. The list of touched bands (a number a band) is collected."""
    entry = json.loads(json.dumps(matrix.origin.meta["layers"][name]))
    cells, blocks = matrix.patches[name].cells, matrix.patches[name].blocks
    columns = [df.select(COL) for df in ([] if cells is None else [cells]) + [b.cols for b in blocks]]
    bands = reduce(DataFrame.unionByName, columns).select(F.floor(F.col(COL) / width).cast("int").alias("band")).distinct()
    touched = sorted(r.band for r in bands.collect())
    if not touched:
        return entry
    kept = matrix.origin.banded[name].where(F.col("band").isin(touched)).select(ROW, COL, "value")
    if cells is not None:
        kept = kept.join(cells.select(ROW, COL), [ROW, COL], "left_anti")
    kept = reduce(lambda df, b: b.outside(df), blocks, kept)
    if cells is not None:
        kept = kept.unionByName(cells.withColumn("value", F.col("value").cast(entry["type"])))
    write_layer(kept, f"{path}/{layer_part(name, part)}", width)
    for p in entry["parts"]:
        p["hidden"] = sorted({*p.get("hidden", []), *touched})
    entry["parts"].append(new_part(layer_part(name, part)))
    for i, b in enumerate(blocks):
        folder = f"{part}/blocks/{safe(name)}/{i}"
        write_sound(b.rows, f"{path}/{folder}/rows")
        b.cols.write.parquet(f"{path}/{folder}/cols")
        entry["parts"].append(new_part(folder, block=True))
    return entry


def read_attributes(spark: SparkSession, path: str, entry: dict, ix: str) -> DataFrame:
    """An attribute table from its parts; a part without an attribute has the fill for it. A
    part without a folder is a range of positions that a resize added."""
    schema = T.StructType.fromJson(entry["schema"])
    alike: dict[str, list[dict]] = {}
    for part in entry["parts"]:
        alike.setdefault(json.dumps([part["fills"], part.get("limit"), part.get("range")], sort_keys=True), []).append(part)
    tables = []
    for parts in alike.values():
        if "range" in parts[0]:
            table = spark.range(*parts[0]["range"]).select(F.col("id").cast(schema[ix].dataType).alias(ix), *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != ix]).select(*schema.names)
        else:
            table = spark.read.schema(schema).parquet(*[f"{path}/{p['folder']}" for p in parts])
        fills = {k: F.lit(v).cast(schema[k].dataType) for k, v in parts[0]["fills"].items() if k in schema.names}
        table = table.withColumns(fills) if fills else table
        tables.append(table if parts[0].get("limit") is None else table.where(F.col(ix) < parts[0]["limit"]))
    return reduce(DataFrame.unionByName, tables)


def read_banded(spark: SparkSession, path: str, name: str, entry: dict, width: int) -> DataFrame:
    """A layer's entries with ``part`` and ``band``, without what later versions hide."""
    reader = spark.read.schema(f"{ROW} long, {COL} long, value {entry['type']}, part string, band int").option("basePath", f"{path}/layers/{safe(name)}")
    listed = [p for p in entry["parts"] if not p.get("block")]
    out = reader.parquet(*[f"{path}/{p['folder']}" for p in listed])
    for p in listed:
        other = F.col("part") != p["folder"].rpartition("part=")[2]
        if p.get("hidden"):
            out = out.where(other | ~F.col("band").isin(p["hidden"]))
        if p.get("limit"):
            out = out.where(other | ((F.col(ROW) < p["limit"][0]) & (F.col(COL) < p["limit"][1])))
    return reduce(DataFrame.unionByName, [read_block(spark, path, entry, p, width) for p in entry["parts"] if p.get("block")], out)


def read_block(spark: SparkSession, path: str, entry: dict, part: dict, width: int) -> DataFrame:
    """A block's cells as ``read_banded`` gives them; what is hidden is left out of its tables."""
    run = lambda ix, size: F.coalesce("run", F.floor(F.col(ix) / size).cast("long"))  # noqa: E731  none in blocks that were stored without
    rows = spark.read.schema(f"{ROW} long, value {entry['type']}, run long").parquet(f"{path}/{part['folder']}/rows").withColumn("run", run(ROW, TILE[0]))
    cols = spark.read.schema(f"{COL} long, run long").parquet(f"{path}/{part['folder']}/cols").withColumn("run", run(COL, TILE[1])).withColumn("band", F.floor(F.col(COL) / width).cast("int"))
    if part.get("hidden"):
        cols = cols.where(~F.col("band").isin(part["hidden"]))
    if part.get("limit"):
        rows, cols = rows.where(F.col(ROW) < part["limit"][0]), cols.where(F.col(COL) < part["limit"][1])
    return Block(rows, cols).cells().select(ROW, COL, "value", F.lit(part["folder"]).alias("part"), "band")


def read_graph(spark: SparkSession, path: str, parts: list[dict]) -> DataFrame:
    def one(p: dict) -> DataFrame:
        edges = spark.read.parquet(f"{path}/{p['folder']}")
        return edges if p.get("limit") is None else edges.where((F.col("a") < p["limit"]) & (F.col("b") < p["limit"]))

    return reduce(DataFrame.unionByName, map(one, parts))


def connect(spark: SparkSession, path: str, validate: bool = True, full: bool = False) -> AnnotatedMatrix:
    """Open a dataset lazily. ``validate`` checks what the schemas show and reads no data;
    ``full`` checks all values, which reads and shuffles every layer."""
    meta = metadata(spark, path)
    bands = {n: read_banded(spark, path, n, e, meta["band"]) for n, e in meta["layers"].items()}
    layers = {n: b.select(ROW, COL, "value") for n, b in bands.items()}
    tables = {key: read_attributes(spark, path, meta[key], ix) for key, ix in (("row_attrs", ROW), ("col_attrs", COL))}
    graphs = {key: {n: read_graph(spark, path, p) for n, p in meta[key].items()} for key in ("row_graphs", "col_graphs", "tables")}
    parts = {f"layers/{n}": e for n, e in layers.items()} | tables | {f"{key}/{n}": g for key, own in graphs.items() for n, g in own.items()}
    made = AnnotatedMatrix(tables["row_attrs"], tables["col_attrs"], layers, *meta["shape"], **graphs, attrs=meta["attrs"], origin=Origin(path, meta, parts, bands, meta["band"]))
    if validate or full:
        report = validate_spec(made) if full else validate_schema(made)
        if report.errors:
            raise ValueError("; ".join(report.errors))
    return made


def last_modified(spark: SparkSession, path: str, component: str | None = None) -> str:
    """Time stamp of the dataset, or of a component ("layers/x", "row_attrs/Gene", ...)."""
    meta = metadata(spark, path)
    return meta["last_modified"] if component is None else meta["modified"][component]


def changes_since(spark: SparkSession, path: str, since: str) -> dict[str, list[str]]:
    """Names of the components changed after a time stamp, by kind."""
    out: dict[str, list[str]] = {k: [] for k in ("row_attrs", "col_attrs", "row_graphs", "col_graphs", "layers")}
    for component, stamp in metadata(spark, path)["modified"].items():
        kind, name = component.split("/", 1)
        if kind in out and stamp > since:
            out[kind].append(name)
    return {k: sorted(v) for k, v in out.items()}


ATTEMPTS = 20  # of a writer that others come before


def append(spark: SparkSession, path: str, batch: AnnotatedMatrix, fill_values: dict | str | None = None, attrs: dict | None = None) -> None:
    """Create the dataset, or append the batch's columns to it as ``add_columns`` does, with
    ``attrs`` set. Only the batch is written; the files that are there stay as they are."""
    add_matrix(spark, path, batch, fill_values=fill_values, attrs=attrs, same_layers=True)


def add_matrix(
    spark: SparkSession, path: str, other: AnnotatedMatrix, key: str | None = None, fill_values: dict | str | None = None, convert_attrs: bool = False,
    include_graphs: bool = False, union_layers: bool = False, attrs: dict | None = None, same_layers: bool = False,
) -> None:
    """Add another matrix's columns to a stored dataset, which is created if there is none.

    With ``key`` the other matrix's rows are put in the stored order of that attribute (both
    must hold the same unique values), while its layers are written. Layers that the dataset
    has and the other lacks are an error, further ones are left out; with ``union_layers`` both
    are zeros on the other side. ``convert_attrs`` turns globals that differ into column
    attributes, ``include_graphs`` appends same-named column graphs. Everything that is there
    already stays as it is: stored columns get values of new attributes in metadata. A writer
    that another one comes before begins again on the new state.
    """
    for _ in range(ATTEMPTS):
        try:
            return _extend(spark, path, other, key, fill_values, convert_attrs, include_graphs, union_layers, attrs or {}, same_layers)
        except Conflict:
            continue
    raise Conflict(f"{ATTEMPTS} attempts to write to {path}")


def _extend(spark, path, batch, key, fill_values, convert_attrs, include_graphs, union_layers, attrs, same_layers) -> None:
    try:
        current = connect(spark, path, validate=False)
    except FileNotFoundError:
        current = None
    if current is None or not current.n_cols:
        return save(replace(batch, attrs={**(current.attrs if current else {}), **batch.attrs, **attrs}, origin=None), path)
    if batch.n_rows != current.n_rows:
        raise ValueError("the matrices need the same number of rows")
    if same_layers and set(batch.layers) != set(current.layers):
        raise ValueError("the matrices need the same layers")
    missing = set(current.layers) - set(batch.layers)
    if missing and not union_layers:
        raise ValueError(f"layers {sorted(missing)} are missing")
    if key is not None:
        batch = batch.aligned_rows(current, key)
    part, meta = f"v{uuid.uuid4().hex}", json.loads(json.dumps(current.origin.meta))
    now = timestamp(meta["last_modified"])
    shift = (F.col(COL) + F.lit(current.n_cols)).cast("long")
    layers = {n: e for n, e in batch.layers.items() if union_layers or n in current.layers}
    for name, entries in layers.items():
        entry = meta["layers"].setdefault(name, {"type": entries.schema["value"].dataType.simpleString(), "parts": []})
        write_layer(entries.select(F.col(ROW).cast("long").alias(ROW), shift.alias(COL), F.col("value").cast(entry["type"]).alias("value")), f"{path}/{layer_part(name, part)}", meta["band"])
        entry["parts"].append(new_part(layer_part(name, part)))
        meta["modified"][f"layers/{name}"] = now
    ours, fills = batch.cols, {}
    if convert_attrs:
        for k in differing_globals(current.attrs, batch.attrs):
            if k not in current.cols.columns:
                fills[k] = str(current.attrs.get(k, ""))
            if k not in ours.columns:
                ours = ours.withColumn(k, F.lit(str(batch.attrs.get(k, ""))))
            meta["attrs"].pop(k, None)
            meta["modified"].pop(f"attrs/{k}", None)
    stored = current.cols.withColumns({k: F.lit(v) for k, v in fills.items()}) if fills else current.cols
    mine, theirs = align_attributes(stored, ours.withColumn(COL, shift), COL, fill_values)
    theirs.select(*[F.col(c).cast(mine.schema[c].dataType).alias(c) for c in mine.columns]).write.parquet(f"{path}/{part}/col_attrs")
    for name in set(mine.columns) - set(current.cols.columns):
        for p in meta["col_attrs"]["parts"]:
            p["fills"][name] = fills[name] if name in fills else fill_value(batch.cols.schema, name, fill_values)
    meta["col_attrs"]["schema"] = mine.schema.jsonValue()
    meta["col_attrs"]["parts"].append(new_part(f"{part}/col_attrs", fills={}))
    meta["modified"] = {k: v for k, v in meta["modified"].items() if not k.startswith("col_attrs/")} | {f"col_attrs/{c}": now for c in mine.columns if c != COL} | {f"attrs/{k}": now for k in attrs}
    if include_graphs:
        for name in set(current.col_graphs) & set(batch.col_graphs):
            moved = F.lit(current.n_cols).cast("long")
            batch.col_graphs[name].select((F.col("a") + moved).alias("a"), (F.col("b") + moved).alias("b"), F.col("w").cast("double").alias("w")).write.parquet(f"{path}/{part}/col_graphs/{safe(name)}")
            meta["col_graphs"][name].append(new_part(f"{part}/col_graphs/{safe(name)}"))
            meta["modified"][f"col_graphs/{name}"] = now
    meta["attrs"].update(attrs)
    write_meta(spark, path, meta | {"version": meta["version"] + 1, "shape": [current.n_rows, current.n_cols + batch.n_cols], "last_modified": now})


def combine(spark: SparkSession, path: str, matrices: list[AnnotatedMatrix], key: str | None = None, attrs: dict | None = None, convert_attrs: bool = False, fill_values: dict | str | None = None) -> AnnotatedMatrix:
    """Write all matrices' columns side by side to a new dataset, one after the other, each
    written once; rows follow the first one's ``key``."""
    if not matrices:
        raise ValueError("nothing to combine")
    save(replace(matrices[0], attrs={**matrices[0].attrs, **(attrs or {})}, origin=None), path)
    for m in matrices[1:]:
        add_matrix(spark, path, m, key, fill_values, convert_attrs)
    return connect(spark, path)


def combine_selected(spark: SparkSession, path: str, matrices: list[AnnotatedMatrix], selections: list | None = None, key: str | None = None, skip_attrs: list[str] | None = None, attrs: dict | None = None) -> AnnotatedMatrix:
    """Write chosen columns of all matrices to a new dataset with the union of their layers,
    one matrix after the other. Rows are sorted by ``key``. A column attribute that a matrix
    lacks is 0, or "", for its columns; row attributes are those of the first matrix."""
    if not matrices:
        raise ValueError("nothing to combine")
    skip = skip_attrs or []
    for n, (m, chosen) in enumerate(zip(matrices, selections or [None] * len(matrices), strict=True)):
        m = replace(m, rows=m.rows.drop(*skip), cols=m.cols.drop(*skip), origin=None) if skip else m
        m = m.view(None, chosen)
        if n:
            known = connect(spark, path, validate=False)
            for table, seen, what in ((m.cols, known.cols, "attribute"), *((m.layers[k].select("value"), known.layers[k].select("value"), f"layer {k!r},") for k in m.layers if k in known.layers)):
                for c in set(table.columns) & set(seen.columns) - {COL}:
                    if table.schema[c].dataType.simpleString() != seen.schema[c].dataType.simpleString():
                        raise ValueError(f"{what} {c!r} has several types")
            add_matrix(spark, path, m, key, fill_values="auto", union_layers=True)
        else:
            save(replace(m.permute(0, key) if key else m, attrs=dict(attrs or {}), row_graphs={}, col_graphs={}, origin=None), path)
    return connect(spark, path)


# --- shapes, parts and folders ------------------------------------------------------------


def resize(spark: SparkSession, path: str, n_rows: int | None = None, n_cols: int | None = None) -> None:
    """Change a stored dataset's shape. Coordinates stay where they are; what falls outside is
    hidden from readers and dropped when its component is next written. New positions hold
    zeros, and 0 or "" as attributes. Only metadata is written."""
    meta = metadata(spark, path)
    before, now = list(meta["shape"]), timestamp(meta["last_modified"])
    after = [old if n is None else n for old, n in zip(before, (n_rows, n_cols), strict=True)]
    if min(after) < 0:
        raise ValueError("a shape has no negative sides")
    least = lambda old, n: n if old is None else min(old, n)
    for name, entry in meta["layers"].items():
        for p in entry["parts"]:
            p["limit"] = [min(a, b) for a, b in zip(p.get("limit") or before, after, strict=True)]
        meta["modified"][f"layers/{name}"] = now
    for axis, (key, graphs) in enumerate((("row_attrs", "row_graphs"), ("col_attrs", "col_graphs"))):
        if after[axis] == before[axis]:
            continue
        for p in meta[key]["parts"]:
            p["limit"] = least(p.get("limit"), after[axis])
        if after[axis] > before[axis]:
            schema = T.StructType.fromJson(meta[key]["schema"])
            fills = {f.name: fill_value(schema, f.name, "auto") for f in schema if f.name not in (ROW, COL)}
            meta[key]["parts"].append({"range": [before[axis], after[axis]], "fills": {k: v for k, v in fills.items() if v is not None}})
        for parts in meta[graphs].values():
            for p in parts:
                p["limit"] = least(p.get("limit"), after[axis])
        meta["modified"].update({k: now for k in meta["modified"] if k.startswith((f"{key}/", f"{graphs}/"))})
    write_meta(spark, path, meta | {"version": meta["version"] + 1, "shape": after, "last_modified": now})


def compact(spark: SparkSession, path: str, most: int = 1) -> list[str]:
    """Write components of more than ``most`` parts, or with hidden entries, as one part each.
    Their values and time stamps stay. Gives their names."""
    m = connect(spark, path, validate=False)
    meta = m.origin.meta
    worn = lambda parts: len(parts) > most or any(p.get("hidden") or p.get("limit") or "range" in p for p in parts)
    anew = lambda df: df.select("*")
    layers = {n: anew(e) if worn(meta["layers"][n]["parts"]) else e for n, e in m.layers.items()}
    tables = {k: anew(t) if worn(meta[key]["parts"]) else t for k, key, t in (("rows", "row_attrs", m.rows), ("cols", "col_attrs", m.cols))}
    graphs = {key: {n: anew(g) if worn(meta[key][n]) else g for n, g in getattr(m, key).items()} for key in ("row_graphs", "col_graphs")}
    done = [f"layers/{n}" for n in layers if layers[n] is not m.layers[n]] + [f"{key}/{n}" for key, own in graphs.items() for n in own if own[n] is not getattr(m, key)[n]]
    done += [key for k, key in (("rows", "row_attrs"), ("cols", "col_attrs")) if tables[k] is not getattr(m, k)]
    if done:
        save(replace(m, layers=layers, **tables, **graphs), path, changed=meta["modified"])
    return done


def vacuum(spark: SparkSession, path: str, hours: float = 24.0) -> int:
    """Remove folders that the last version does not list and older metadata, if they are
    older than ``hours``, so that running writers and readers keep theirs. Gives their number."""
    meta = metadata(spark, path)
    fs, to_path = file_system(spark, path)
    parts = [p for e in meta["layers"].values() for p in e["parts"]] + [p for k in ("row_attrs", "col_attrs") for p in meta[k]["parts"]] + [p for k in ("row_graphs", "col_graphs", "tables") for own in meta[k].values() for p in own]
    used = {p["folder"] for p in parts if "folder" in p}
    tops = {f.partition("/")[0] for f in used}
    old = int((datetime.datetime.now(datetime.timezone.utc).timestamp() - hours * 3600) * 1000)
    ls = lambda folder: list(fs.listStatus(to_path(folder))) if fs.exists(to_path(folder)) else []
    unused = [x for layer in ls(f"{path}/layers") for x in ls(layer.getPath().toString()) if f"layers/{layer.getPath().getName()}/{x.getPath().getName()}" not in used]
    unused += [x for x in ls(path) if x.getPath().getName().startswith("v") and x.getPath().getName() not in tops]
    unused += [x for x in ls(f"{path}/_meta") if x.getPath().getName() != meta_file("", meta["version"]).rpartition("/")[2]]
    gone = [x for x in unused if x.getModificationTime() <= old]
    for x in gone:
        fs.delete(x.getPath(), True)
    return len(gone)


# --- sinks of text ------------------------------------------------------------------------


def export_lines(matrix: AnnotatedMatrix, layer: str = MAIN) -> DataFrame:
    """(line_no, line): the tab-separated export. Column attributes come first, one a line,
    then the row attributes' names, then every row with all its values, zeros included.

    A row's values are gathered into one dense array, so this is for matrices whose rows fit
    in a task, as any such text has lines of that length.
    """
    row_names, col_names = matrix.names(0), matrix.names(1)
    number = "long" if matrix.layer(layer).schema["value"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "double"
    zero, n = "0" if number == "long" else "0.0", matrix.n_cols
    entries = matrix.layer(layer).groupBy(ROW).agg(F.collect_list(F.struct(COL, F.col("value").cast(number).cast("string").alias("value"))).alias("_e"))
    attributes = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in row_names]) if row_names else F.array().cast("array<string>")
    joined = matrix.rows.join(entries, ROW, "left").select((F.col(ROW) + len(col_names) + 1).cast("long").alias("line_no"), attributes.alias("a"), F.col(f"_e.{COL}").alias("at"), F.col("_e.value").alias("v"))

    def filled(batches):
        import pyarrow as pa

        for batch in batches:
            lines = []
            for a, at, v in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                values = [zero] * n
                for place, text in zip(at or (), v or (), strict=True):
                    values[place] = text
                lines.append("\t".join([*a, "", *values]) + "\t")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], names=["line_no", "line"])

    body = joined.mapInArrow(filled, "line_no long, line string")
    heads = None
    for i, name in enumerate(col_names):
        gathered = matrix.cols.agg(F.transform(F.array_sort(F.collect_list(F.struct(COL, F.coalesce(F.col(name).cast("string"), F.lit("")).alias("v")))), lambda s: s["v"]).alias("v"))
        head = gathered.select(F.lit(i).cast("long").alias("line_no"), F.concat(F.lit("\t" * len(row_names) + name + "\t"), F.array_join("v", "\t"), F.lit("\t")).alias("line"))
        heads = head if heads is None else heads.unionByName(head)
    names = matrix.spark.createDataFrame([(len(col_names), "".join(f"{n}\t" for n in row_names) + "\t" + "\t" * matrix.n_cols)], "line_no long, line string")
    return (names if heads is None else heads.unionByName(names)).unionByName(body)


def export(matrix: AnnotatedMatrix, path: str, layer: str = MAIN, format: str = "tab") -> None:
    """Write ``export_lines`` in order, as text files that follow each other by name."""
    if format != "tab":
        raise NotImplementedError("only 'tab' is supported")
    export_lines(matrix, layer).orderBy("line_no").select("line").write.text(path)


def to_html(matrix: AnnotatedMatrix, layer: str = MAIN, most: int = 10) -> str:
    """The upper left corner as an HTML table, with attributes."""
    from html import escape

    rows = matrix.rows.where(F.col(ROW) < most).orderBy(ROW).collect()
    cols = matrix.cols.where(F.col(COL) < most).orderBy(COL).collect()
    cells = {(r[ROW], r[COL]): r["value"] for r in matrix.layer(layer).where((F.col(ROW) < most) & (F.col(COL) < most)).collect()}
    row_names, col_names = matrix.names(0), matrix.names(1)
    out = [f"<p>({matrix.n_rows} rows, {matrix.n_cols} columns, {len(matrix.layers)} layers)"]
    out += [f"<br>{escape(str(k))}: <em>{escape(str(v))}</em>" for k, v in matrix.attrs.items()]
    line = lambda items, tag="td": "<tr>" + "".join(f"<{tag}>{escape(str(x))}</{tag}>" for x in items) + "</tr>"
    more = ["..."] if matrix.n_cols > most else []
    out += ["</p><table>", *[line([""] * len(row_names) + [n] + [c[n] for c in cols] + more) for n in col_names], line([*row_names, "", *[""] * len(cols), *more], "th")]
    out += [line([r[n] for n in row_names] + [""] + [cells.get((r[ROW], c[COL]), 0) for c in cols] + more) for r in rows]
    if matrix.n_rows > most:
        out.append(line(["..."] * (len(row_names) + 1 + len(cols) + len(more))))
    return "".join([*out, "</table>"])
