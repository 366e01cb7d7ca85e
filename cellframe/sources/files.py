"""Files: snapshots, extended XYZ, VTK grids and point sets, component tables and plots."""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain
from cellframe.operators.cells import KEY
from cellframe.operators.ranking import dense_number
from cellframe.runtime import join_checked, text

FORCE = {"fx", "fy", "fz"}


def write_dump(df: DataFrame, domain: Domain, path: str, timestep: int = 0, time: float = 0.0, compression: str = "zstd", by_cells: bool = False) -> None:
    """A snapshot of all fields but the force: Parquet beside a JSON header of domain, time and step.

    With by_cells rows are sorted by cell inside the files, so that a reader's box
    filter skips row groups.
    """
    kept = df.select(*(c for c in df.columns if c not in FORCE))
    if by_cells:
        kept = domain.with_cells(kept, ("__i", "__j", "__k")).sortWithinPartitions("__k", "__j", "__i").drop("__i", "__j", "__k")
    kept.write.mode("overwrite").option("compression", compression).parquet(f"{path}/particles")
    head = {"domain": dataclasses.asdict(domain) | {"mirror": sorted(domain.mirror)}, "timestep": timestep, "time": time}
    text(df.sparkSession, f"{path}/header.json", json.dumps(head))


def read_dump(spark: SparkSession, path: str, filter_=None) -> tuple[DataFrame, Domain, int, float]:
    """Particles (forces 0), domain, step and time of a snapshot.

    Positions are wrapped along periodic axes. On closed ones those less than a
    thousandth of a cell outside are put on the border; farther ones raise when
    read, as does more than one particle at the origin.
    """
    head = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/header.json").collect()))
    d = head["domain"]
    domain = Domain(tuple(d["bmin"]), tuple(d["bmax"]), tuple(d["grid_dims"]), d["cell_size"], tuple(d["periodic"]), frozenset(d["mirror"]), d["expandable"], tuple(d["xform"]))
    df = spark.read.parquet(f"{path}/particles")
    if filter_ is not None:
        df = df.where(filter_)
    if df.where("rx = 0 and ry = 0 and rz = 0").limit(2).count() > 1:
        raise ValueError("more than one particle lies at the origin")
    df = domain.wrap(df)
    near = domain.cell_size * 1e-3
    for i, a in enumerate(AXES):
        if not domain.periodic[i]:
            r, lo, hi = F.col(f"r{a}"), domain.bmin[i], domain.bmax[i]
            far = (r < lo - near) | (r > hi + near)
            df = df.withColumn(f"r{a}", F.when(far, F.raise_error(F.lit("a particle lies outside the domain")).cast("double")).otherwise(F.least(F.greatest(r, F.lit(lo)), F.lit(hi))))
    return df.withColumns({f: F.lit(0.0) for f in sorted(FORCE)}), domain, head["timestep"], head["time"]


def xyz_lines(df: DataFrame, types: DataFrame | None = None, fields: tuple[str, ...] = (".*",)) -> DataFrame:
    """One text column: type name (XX if unknown), position, then the fields the patterns match in full."""
    names = [c for c in df.columns if c not in ("type", "rx", "ry", "rz") and any(re.fullmatch(p, c) for p in fields)]
    if types is not None:
        named = types.groupBy("type").agg(F.first("name").alias("__name"))
        df = join_checked(df, named, ["type"], "left", named.count())
    label = F.coalesce(F.col("__name"), F.lit("XX")) if types is not None else F.lit("XX")
    whole = {n for n, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint")}
    parts = ["%s", *["% .10e"] * 3, *("% 10d" if n in whole else "% .10e" for n in names)]
    return df.select(F.format_string(" ".join(parts), label, *(F.col(f"r{a}") for a in AXES), *(F.col(n) for n in names)).alias("value"))


def write_xyz(df: DataFrame, domain: Domain, path: str, types: DataFrame | None = None, fields: tuple[str, ...] = (".*",), time: float = 0.0) -> None:
    """Extended XYZ: a folder of line parts in order, and its header file.

    The header holds the count, the lattice vectors and the columns; the parts
    follow it when they are put together.
    """
    names = [c for c in df.columns if c not in ("type", "rx", "ry", "rz") and any(re.fullmatch(p, c) for p in fields)]
    m, size = domain.matrix, domain.size
    vectors = " ".join(f"{m[i, j] * size[j]:.10e}" for j in range(3) for i in range(3))
    columns = ":".join(["species:S:1", "pos:R:3", *(f"{n}:{'I' if t in ('int', 'bigint') else 'R'}:1" for n in names for t in [dict(df.dtypes)[n]])])
    lines = xyz_lines(df, types, fields)
    lines.write.mode("overwrite").text(path)
    text(df.sparkSession, f"{path}/_header", f'{df.count()}\nLattice="{vectors}" Properties={columns} Time={time}\n')


def read_cell_values(spark: SparkSession, path: str, domain: Domain, subdiv: int, name: str, order: str = "F") -> DataFrame:
    """V with one field from an ASCII structured-points file of scalars; its dimensions must be those of the grid.

    Values are numbered across lines on the executors: lines keep their place by
    file offset, and a value's number is its line's start plus its place in it.
    """
    lines = spark.read.text(path, lineSep="\n").withColumn("n", F.monotonically_increasing_id())
    head = {}
    top = lines.orderBy("n").limit(64).collect()
    start = None
    for r in top:
        words = r.value.split()
        if words[:1] == ["DIMENSIONS"]:
            head["dims"] = tuple(map(int, words[1:4]))
        if words[:1] == ["SCALARS"] and len(words) > 3 and words[3] != "1":
            raise ValueError("only scalars can be read")
        if words[:1] == ["LOOKUP_TABLE"]:
            start = r.n
            break
    want = tuple(d * subdiv for d in domain.grid_dims)
    if start is None or head.get("dims") != want:
        raise ValueError(f"expected a grid of {want} points, found {head.get('dims')}")
    values = lines.where(F.col("n") > start).select("n", F.posexplode(F.filter(F.split(F.trim("value"), r"\s+"), lambda s: s != "")).alias("p", "v"))
    numbered = dense_number(values, ["n", "p"], "at")
    nx, ny, nz = want
    at = F.col("at")
    fast = (at % nx, F.floor(at / nx) % ny, F.floor(at / (nx * ny))) if order == "F" else (F.floor(at / (ny * nz)), F.floor(at / nz) % ny, at % nz)
    keys = {}
    for c, s, k in zip(KEY[:3], KEY[3:], fast):
        keys |= {c: F.floor(k / subdiv).cast("int"), s: (k % subdiv).cast("int")}
    return numbered.select(*(keys[k].alias(k) for k in KEY), F.col("v").cast("double").alias(name))


#: Sub-cells along an axis of an image piece at most, so that a piece stays some megabytes.
PIECE_CELLS = 64
#: Particles of a point piece at most.
PIECE_POINTS = 100_000


def write_grid(cells: DataFrame, domain: Domain, subdiv: int, path: str, fields: list[str]) -> None:
    """Cell values as VTK image data: a piece a block of cells (PIECE_CELLS an axis at most), and the file that names them.

    Absent sub-cells, and null values, are 0; a sub-cell with several rows has the
    value of one of them.
    """
    n = [d * subdiv for d in domain.grid_dims]
    side = [min(PIECE_CELLS, k) for k in n]
    blocks = [-(-k // w) for k, w in zip(n, side)]
    spacing, origin = domain.cell_size / subdiv, domain.bmin

    def ends(block: int) -> list[tuple[int, int]]:
        at = (block % blocks[0], block // blocks[0] % blocks[1], block // (blocks[0] * blocks[1]))
        return [(i * w, min((i + 1) * w, k)) for i, w, k in zip(at, side, n)]

    def extent(block: int) -> str:
        return " ".join(f"{lo} {hi}" for lo, hi in ends(block))

    def piece(frame: pd.DataFrame) -> pd.DataFrame:
        block = int(frame["block"].iloc[0])
        (x0, x1), (y0, y1), (z0, z1) = ends(block)
        held = frame[frame["kx"].notna()]
        x, y, z = (held[k].to_numpy(int) for k in ("kx", "ky", "kz"))
        out = [f'<?xml version="1.0"?>\n<VTKFile type="ImageData" version="0.1" byte_order="LittleEndian">\n<ImageData WholeExtent="{extent(block)}" Origin="{origin[0]} {origin[1]} {origin[2]}" Spacing="{spacing} {spacing} {spacing}">\n<Piece Extent="{extent(block)}">\n<CellData>']
        for f in fields:
            grid = np.zeros((z1 - z0, y1 - y0, x1 - x0))
            grid[z - z0, y - y0, x - x0] = np.nan_to_num(held[f].to_numpy(float))
            out.append(f'<DataArray type="Float64" Name="{f}" format="ascii">\n{" ".join(map(repr, grid.ravel().tolist()))}\n</DataArray>')
        out.append("</CellData>\n</Piece>\n</ImageData>\n</VTKFile>\n")
        return pd.DataFrame({"name": [f"piece-{block}.vti"], "content": ["\n".join(out)]})

    at = [(F.col(c) * subdiv + F.col(s)).alias(k) for c, s, k in zip(KEY[:3], KEY[3:], ("kx", "ky", "kz"))]
    values = cells.select(*at, *(F.col(f).cast("double").alias(f) for f in fields))
    i, j, k = (F.floor(F.col(c) / w).cast("long") for c, w in zip(("kx", "ky", "kz"), side))
    values = values.withColumn("block", i + blocks[0] * (j + blocks[1] * k))
    every = cells.sparkSession.range(blocks[0] * blocks[1] * blocks[2]).select(F.col("id").alias("block"))  # empty blocks are written too
    pieces = values.unionByName(every, allowMissingColumns=True).groupBy("block").applyInPandas(piece, "name string, content string")
    names = _write_named(pieces, path)
    parts = "\n".join(f'<Piece Extent="{extent(int(m[1]))}" Source="{PurePosixPath(path).name}/{m[0]}"/>' for m in (re.fullmatch(r"piece-(\d+)\.vti", x) for x in names))
    arrays = "\n".join(f'<PDataArray type="Float64" Name="{f}"/>' for f in fields)
    text(cells.sparkSession, f"{path}.pvti", f'<?xml version="1.0"?>\n<VTKFile type="PImageData" version="0.1" byte_order="LittleEndian">\n<PImageData WholeExtent="0 {n[0]} 0 {n[1]} 0 {n[2]}" GhostLevel="0" Origin="{origin[0]} {origin[1]} {origin[2]}" Spacing="{spacing} {spacing} {spacing}">\n<PCellData>\n{arrays}\n</PCellData>\n{parts}\n</PImageData>\n</VTKFile>\n')


def _write_named(pieces: DataFrame, path: str) -> list[str]:
    """Each row (name, content) as a file of that name under path, in whatever file system it is; the names.

    Spark's committer writes the rows, a folder a name, so a task that runs twice
    leaves one file; the driver then moves each to its name. What stood under path
    before goes.
    """
    spark = pieces.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(conf)
    parts = f"{path}.parts"
    pieces.select("name", F.col("content").alias("value")).write.mode("overwrite").partitionBy("name").text(parts)
    fs.delete(at(path), True)
    fs.mkdirs(at(path))
    names = []
    for folder in fs.listStatus(at(parts)):
        name = folder.getPath().getName().removeprefix("name=")
        if folder.isDirectory():
            for file in fs.listStatus(folder.getPath()):
                if file.getPath().getName().startswith("part-"):
                    if not fs.rename(file.getPath(), at(f"{path}/{name}")):
                        raise OSError(f"{name} couldn't be moved to {path}")
                    names.append(name)
    fs.delete(at(parts), True)
    return sorted(names)


def write_points(df: DataFrame, path: str, fields: list[str]) -> None:
    """Particles as VTK point sets: pieces of at most PIECE_POINTS points, and the file that names them. Null numbers are written as nan."""

    def piece(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        count = 0
        for whole in frames:
            for start in range(0, len(whole), PIECE_POINTS):
                frame = whole.iloc[start : start + PIECE_POINTS]
                spots = " ".join(f"{v!r}" for row in frame[["rx", "ry", "rz"]].to_numpy(float).tolist() for v in row)
                arrays = "\n".join(f'<DataArray type="{"Int64" if frame[f].dtype.kind in "iu" else "Float64"}" Name="{f}" format="ascii">{" ".join(map(repr, frame[f].tolist()))}</DataArray>' for f in fields)
                content = f'<?xml version="1.0"?>\n<VTKFile type="PolyData" version="0.1" byte_order="LittleEndian">\n<PolyData>\n<Piece NumberOfPoints="{len(frame)}" NumberOfVerts="0" NumberOfLines="0" NumberOfStrips="0" NumberOfPolys="0">\n<Points>\n<DataArray type="Float64" NumberOfComponents="3" format="ascii">{spots}</DataArray>\n</Points>\n<PointData>\n{arrays}\n</PointData>\n</Piece>\n</PolyData>\n</VTKFile>\n'
                yield pd.DataFrame({"name": [f"piece-{TaskContext.get().partitionId()}-{count}.vtp"], "content": [content]})
                count += 1

    names = _write_named(df.select("rx", "ry", "rz", *fields).mapInPandas(piece, "name string, content string"), path)
    kinds = dict(df.dtypes)
    arrays = "\n".join(f'<PDataArray type="{"Int64" if kinds[f] in ("int", "bigint") else "Float64"}" Name="{f}"/>' for f in fields)
    parts = "\n".join(f'<Piece Source="{PurePosixPath(path).name}/{n}"/>' for n in names)
    text(df.sparkSession, f"{path}.pvtp", f'<?xml version="1.0"?>\n<VTKFile type="PPolyData" version="0.1" byte_order="LittleEndian">\n<PPolyData GhostLevel="0">\n<PPoints><PDataArray type="Float64" NumberOfComponents="3"/></PPoints>\n<PPointData>\n{arrays}\n</PPointData>\n{parts}\n</PPolyData>\n</VTKFile>\n')


def _pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """The whole texts of the pieces that an index file names."""
    index = "\n".join(r.value for r in spark.read.text(f"{path}.{end}").collect())  # one line a piece
    names = re.findall(r'Source="[^"]*/([^"/]+)"', index)
    return spark.read.text([f"{path}/{n}" for n in names], wholetext=True) if names else spark.createDataFrame([], "value string")


def _array(content: str, name: str | None, kind=float) -> list:
    found = re.search(r"<DataArray[^>]*NumberOfComponents[^>]*>([^<]*)<" if name is None else rf'<DataArray[^>]*Name="{re.escape(name)}"[^>]*>([^<]*)<', content)
    return [kind(x) for x in found[1].split()]


def read_points(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """rx, ry, rz and fields of a point set written by write_points; whole numbers come back as longs."""
    index = "\n".join(r.value for r in spark.read.text(f"{path}.pvtp").collect())
    whole = {f: f'type="Int64" Name="{f}"' in index for f in fields}

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["value"]:
                r = np.array(_array(content, None)).reshape(-1, 3)
                yield pd.DataFrame({"rx": r[:, 0], "ry": r[:, 1], "rz": r[:, 2], **{f: _array(content, f, int if whole[f] else float) for f in fields}})

    return _pieces(spark, path, "pvtp").mapInPandas(rows, "rx double, ry double, rz double" + "".join(f", `{f}` {'long' if whole[f] else 'double'}" for f in fields))


def read_grid(spark: SparkSession, path: str, field: str) -> DataFrame:
    """kx, ky, kz (sub-cells of the whole grid) and a field of an image written by write_grid."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["value"]:
                x0, x1, y0, y1, z0, z1 = map(int, re.search(r'<Piece Extent="([^"]*)"', content)[1].split())
                z, y, x = np.meshgrid(range(z0, z1), range(y0, y1), range(x0, x1), indexing="ij")
                yield pd.DataFrame({"kx": x.ravel(), "ky": y.ravel(), "kz": z.ravel(), field: _array(content, field)})

    return _pieces(spark, path, "pvti").mapInPandas(rows, f"kx int, ky int, kz int, `{field}` double")


def write_component_table(table: DataFrame, path: str, gyration: bool = True, extra: tuple[str, ...] = ()) -> None:
    """label ; count ; centre ; gyration ; fields, ordered by label."""
    names = ["label", "count", *(f"center_{a}" for a in AXES), *((f"gyr_{p}{q}" for p in AXES for q in AXES) if gyration else ()), *extra]
    table.select(*names).orderBy("label").write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_plots(plots: DataFrame, path: str, separator: str = ";", multicolumns: bool = False) -> None:
    """plot, bin, x, y: a folder of files a plot, or one table with a column a plot (positions of the first)."""
    if not multicolumns:
        plots.select("plot", "x", "y").repartitionByRange("plot", "x").sortWithinPartitions("plot", "x").write.mode("overwrite").partitionBy("plot").option("sep", separator).csv(path)
        return
    names = [r.plot for r in plots.select("plot").distinct().orderBy("plot").collect()]  # one row a plot
    wide = plots.groupBy("bin").pivot("plot", names).agg(F.first("y"))
    spots = plots.where(F.col("plot") == (names[0] if names else "")).select("bin", F.col("x").alias("pos"))
    spots.join(wide, "bin").orderBy("bin").drop("bin").write.mode("overwrite").option("sep", separator).option("header", True).csv(path)


def ascii_plot(plot: DataFrame, marks: int = 10, scaling: float = 1.0) -> str:
    """A bar of # a bin, the greatest as long as `marks`; for plots of some thousand bins."""
    rows = plot.orderBy("bin").limit(4096).collect()
    top = max((abs(r.y) for r in rows), default=0.0) or 1.0
    return "\n".join(f"{r.x: .6e} {r.y: .6e} {'#' * round(marks * scaling * abs(r.y) / top)}" for r in rows)


def describe(domain: Domain) -> str:
    return "\n".join([f"bounds      = {domain.bmin} .. {domain.bmax}", f"grid        = {' x '.join(map(str, domain.grid_dims))} cells of {domain.cell_size}", f"periodic    = {domain.periodic}", f"mirror      = {sorted(domain.mirror)}", f"expandable  = {domain.expandable}", f"xform       = {domain.xform}", f"volume      = {domain.volume()}"])


def describe_grid(domain: Domain, ghost_layers: int = 0) -> str:
    g, far = ghost_layers, domain.cell_size * ghost_layers
    rows = [("origin", tuple(lo - far for lo in domain.bmin)), ("cell size", domain.cell_size), ("dims", tuple(d + 2 * g for d in domain.grid_dims)), ("dims no ghost", domain.grid_dims), ("ghost layers", g)]
    rows += [("bounds", (tuple(lo - far for lo in domain.bmin), tuple(hi + far for hi in domain.bmax))), ("bounds no ghost", (domain.bmin, domain.bmax))]
    return "\n".join(f"{n:16}= {v}" for n, v in rows)


def stats_line(timestep: int, time: float, stats) -> str:
    return f"{timestep:9d} {time:13.6e} {stats.n:12d} {stats.sum_v2:16.9e} {stats.max_vel:13.6e} {stats.max_acc:13.6e}"
